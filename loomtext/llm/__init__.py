"""Operations of a training-data pipeline at corpus scale, each in a module of its own."""
