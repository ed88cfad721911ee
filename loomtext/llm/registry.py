"""The queries of this subpackage and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from . import ann, bpe_transducer, exact_dedup, jaccard, license_scan, packing, phrases, pipeline, quality, sharding, suffix_dedup, token_counts, vector_codes, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_token_counts": token_counts.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_sharding": sharding.query,
        "op6_bpe_transducer": bpe_transducer.query,
        "op7_ann": ann.query,
        "op8_quality": quality.query,
        "op9_packing": packing.query,
        "op10_jaccard_join": jaccard.query,
        "op11_license_scan": license_scan.query,
        "op12_vector_codes": vector_codes.query,
        "op13_phrases": phrases.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    held = {"op1_warc": warc.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op10_jaccard_join": jaccard.ORACLE, "op11_license_scan": license_scan.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_phrases": phrases.ORACLE, "pipeline": pipeline.ORACLE_SQL}
    return {k: v for k, v in held.items() if v}
