"""Python regular expressions on Spark: native where the JVM's engine can be made to mean the same, an Arrow UDF elsewhere."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running_sums

#: Python's classes as members of a JVM class; a word character is a letter, any number or an underscore.
WORD, DIGIT, SPACE = r"\p{L}\p{N}_", r"\p{Nd}", r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_WORD, ASCII_DIGIT, ASCII_SPACE = "a-zA-Z0-9_", "0-9", r" \t-\r"


class Unsafe(ValueError):
    """What the JVM's engine might take otherwise."""


def _char(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else f"\\x{{{code:x}}}"


@lru_cache(1)
def _cased() -> tuple[str, ...]:
    """The characters that have another case."""
    return tuple(c for c in map(chr, range(0x110000)) if c.lower() != c or c.upper() != c)


@lru_cache(4096)
def _either_case(python: str, jvm: str, flags: int) -> str:
    """A class for the JVM that means one of Python's without regard to case: it is tried on every character that has a case."""
    plain, own = re.compile(python, flags & ~re.I), re.compile(python, flags)
    more, less = [], []
    for c in _cased():
        with_, without = own.fullmatch(c), plain.fullmatch(c)
        if bool(with_) != bool(without):
            (more if with_ else less).append(_char(ord(c)))
    own = f"(?![{''.join(less)}]){jvm}" if less else jvm
    return f"(?:[{''.join(more)}]|{own})" if more else f"(?:{own})"


class _Translation:
    """A parsed pattern written for the JVM, where each node says in itself what its flags mean."""

    def __init__(self, pattern: str, flags: int):
        parsed = _parser.parse(pattern, flags)
        flags = parsed.state.flags
        if flags & ~(re.I | re.M | re.S | re.U | re.A | re.X):
            raise Unsafe("flags")
        self.least = parsed.getwidth()[0]
        self.text = self.sequence(parsed, flags, False)

    def sequence(self, nodes, flags: int, repeated: bool) -> str:
        return "".join(self.node(kind, value, flags, repeated) for kind, value in nodes)

    def node(self, kind, value, flags: int, repeated: bool) -> str:
        if kind is op.LITERAL:
            return self.one_of(value, flags)
        if kind is op.NOT_LITERAL:
            return self.one_of(value, flags, "^")
        if kind is op.ANY:
            return "(?s:.)" if flags & re.S else r"[^\n]"
        if kind is op.IN:
            return self.members(value, flags)
        if kind is op.BRANCH:
            return "(?:" + "|".join(self.sequence(v, flags, repeated) for v in value[1]) + ")"
        if kind is op.SUBPATTERN:
            group, add, remove, nodes = value
            return ("(?:" if group is None else "(") + self.sequence(nodes, flags & ~remove | add, repeated) + ")"
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, nodes = value
            if high != 1 and nodes.getwidth()[0] == 0:
                raise Unsafe("a repeat of what may be empty")
            high = "" if high is op.MAXREPEAT else high
            tail = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}[kind]
            return f"(?:{self.sequence(nodes, flags, True)}){{{low},{high}}}{tail}"
        if kind is op.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags, repeated)})"
        if kind in (op.ASSERT, op.ASSERT_NOT):
            way, nodes = value
            return f"(?{'<' if way < 0 else ''}{'=' if kind is op.ASSERT else '!'}{self.sequence(nodes, flags, repeated)})"
        if kind is op.AT:
            return self.place(value, flags)
        if kind is op.GROUPREF and not repeated and not flags & re.I:
            return f"(?:\\{value})"
        raise Unsafe(str(kind))

    def place(self, where, flags: int) -> str:
        word = ASCII_WORD if flags & re.A else WORD
        edge = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
        inner = f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}]))"
        start, end = (r"(?:\A|(?<=\n))", r"(?:\z|(?=\n))") if flags & re.M else (r"\A", r"(?=\n?\z)")
        known = {op.AT_BEGINNING: start, op.AT_BEGINNING_STRING: r"\A", op.AT_END: end, op.AT_END_STRING: r"\z", op.AT_BOUNDARY: edge, op.AT_NON_BOUNDARY: inner}
        if where not in known:
            raise Unsafe(str(where))
        return known[where]

    def one_of(self, code: int, flags: int, lead: str = "") -> str:
        return self.members([*([(op.NEGATE, None)] if lead else []), (op.LITERAL, code)], flags)

    def members(self, value, flags: int) -> str:
        kinds = {op.CATEGORY_WORD: ("w", WORD, ASCII_WORD), op.CATEGORY_DIGIT: ("d", DIGIT, ASCII_DIGIT), op.CATEGORY_SPACE: ("s", SPACE, ASCII_SPACE)}
        kinds |= {no: (kinds[yes][0].upper(), *(f"[^{x}]" for x in kinds[yes][1:])) for no, yes in ((op.CATEGORY_NOT_WORD, op.CATEGORY_WORD), (op.CATEGORY_NOT_DIGIT, op.CATEGORY_DIGIT), (op.CATEGORY_NOT_SPACE, op.CATEGORY_SPACE))}
        lead, parts, python = "", [], []
        for kind, x in value:
            if kind is op.NEGATE:
                lead = "^"
            elif kind is op.LITERAL:
                parts.append(_char(x))
                python.append(f"\\U{x:08x}")
            elif kind is op.RANGE:
                parts.append(f"{_char(x[0])}-{_char(x[1])}")
                python.append(f"\\U{x[0]:08x}-\\U{x[1]:08x}")
            elif kind is op.CATEGORY and x in kinds:
                name, wide, narrow = kinds[x]
                parts.append(narrow if flags & re.A else wide)
                python.append(f"\\{name}")
            else:
                raise Unsafe(str(kind))
        if lead and any(p.startswith("[^") for p in parts):
            # Said by a lookahead, so that nothing hangs on how the JVM negates unions.
            own = "(?:(?![" + "".join(parts) + "])(?s:.))"
        elif len(value) == 1 and value[0][0] is op.LITERAL:
            own = parts[0]
        else:
            own = f"[{lead}{''.join(parts)}]"
        return _either_case(f"[{lead}{''.join(python)}]", own, flags & (re.I | re.A)) if flags & re.I else own


@lru_cache(256)
def _translated(pattern: str, flags: int) -> tuple[str | None, int]:
    try:
        own = _Translation(pattern, flags)
    except Unsafe:
        return None, _parser.parse(pattern, flags).getwidth()[0]
    return own.text, own.least


def native_pattern(pattern: str, flags: int = 0) -> str | None:
    """The pattern written for the JVM's engine, or None where that might take it otherwise.

    Refused are matches of nothing (the JVM finds them inside characters beyond 16 bits, too),
    repeats of what may be empty, conditional groups, references in repeats or without regard to case.
    """
    text, least = _translated(pattern, int(flags))
    return text if least > 0 else None


def match_width(pattern: str, flags: int = 0) -> int:
    """The fewest characters that a match can have."""
    return _translated(pattern, int(flags))[1]


def count_matches(text: Column, pattern: str, flags: int = 0, engine: str = "auto") -> Column:
    """Matches of a Python pattern in a string, zero-length ones too; null for null."""
    own = native_pattern(pattern, flags) if engine == "auto" else pattern if engine == "native" else None
    if own is not None:
        return F.regexp_count(text, F.lit(own)).cast("long")
    re.compile(pattern, flags)

    @F.pandas_udf("long")
    def counted(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, flags)
        return pd.Series([None if v is None else sum(1 for _ in compiled.finditer(v)) for v in values], dtype="Int64")

    return counted(text)


def match_spans(text: Column, pattern: str) -> Column:
    """``match_atoms`` on the JVM, for a text of atoms without blanks that are joined by a space, and a pattern written for the JVM that matches something.

    Matches alternate with the gaps that splitting leaves, and places follow from their lengths; the
    atoms that start before a place are the blanks before it, and the first one.
    """
    nothing = F.array().cast("array<struct<start:int,end:int,first:int,last:int>>")
    blank = lambda x: F.substring(x, -1, 1) == " "
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    pairs = lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.flatten(F.zip_with(F.slice(F.split(t, pattern, -1), 1, F.size(found)), found, lambda g, m: F.array(g, m))))
    joined = lambda values, others, name: F.zip_with(values, others, lambda v, o: F.struct(v.alias("v"), o.alias(name)))

    def spans(parts: Column) -> Column:
        """Gaps and matches in turn, from the first gap on."""
        n = F.size(parts)
        gap, before = F.slice(F.concat(F.array(F.lit("")), parts), 1, n), F.slice(F.concat(F.array(F.lit(""), F.lit("")), parts), 1, n)
        ends = running_sums(F.transform(parts, lambda x: F.length(x).cast("bigint")))
        blanks_to = running_sums(F.transform(parts, lambda x: blanks(x).cast("bigint")))
        whole = joined(joined(joined(joined(parts, gap, "gap"), before, "before"), ends, "end"), blanks_to, "blanks")
        matches = F.filter(whole, lambda p, i: i % 2 == 1)

        def match(p: Column) -> Column:
            x, gap, before, end, last = p["v"]["v"]["v"]["v"], p["v"]["v"]["v"]["gap"], p["v"]["v"]["before"], p["v"]["end"], p["blanks"]
            start = end - F.length(x)
            # An atom that starts right where the match does belongs to it, not to what is before.
            own = blank(F.when(F.length(gap) > 0, gap).otherwise(before))
            first = F.when(start == 0, F.lit(0)).otherwise(last - blanks(x) + F.when(own, 0).otherwise(1))
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), first.cast("int").alias("first"), last.cast("int").alias("last"))

        return F.filter(F.transform(matches, match), lambda m: m["first"] <= m["last"])

    return F.coalesce(let(let(text, pairs), lambda parts: F.when(F.size(parts) > 0, spans(parts))), nothing)


def match_atoms(texts: Column, pattern: str) -> Column:
    """For the texts of consecutive atoms, joined by a space: the pattern's matches that reach an atom's start.

    An array of (start, end, first, last): the span in code points and the atoms (from 0) whose
    start lies in it, both ends included.
    """
    re.compile(pattern)

    @F.pandas_udf("array<struct<start:int,end:int,first:int,last:int>>")
    def spans(values: pd.Series) -> pd.Series:
        from bisect import bisect_left, bisect_right
        from itertools import accumulate

        compiled, out = re.compile(pattern), []
        for v in values:
            parts = [] if v is None else list(v)
            starts = list(accumulate((len(p) + 1 for p in parts[:-1]), initial=0)) if parts else []
            found = []
            for m in compiled.finditer(" ".join(parts)):
                first, last = bisect_left(starts, m.start()), bisect_right(starts, m.end()) - 1
                if first <= last:
                    found.append({"start": m.start(), "end": m.end(), "first": first, "last": last})
            out.append(found)
        return pd.Series(out)

    return spans(texts)
