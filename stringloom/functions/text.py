"""Text analysers and grams as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space, and the steps of the presets.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PRESETS = {
    "person-name": ("lowercase", "fold_diacritics", "strip_punctuation", "strip_words:mr,mrs,ms,dr,prof", "sort_tokens"),
    "identifier": ("lowercase", "trim"),
    "domain": ("lowercase", "trim", "idna"),
    "free-text": ("lowercase", "fold_diacritics", "strip_punctuation"),
}
PLAIN = ("lowercase", "fold_diacritics", "strip_punctuation", "sort_tokens", "trim", "idna")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda t: t != "")


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Characters that are a base with marks, and their bases, by canonical decomposition."""
    bare = lambda x: unicodedata.normalize("NFC", "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"))
    pairs = [(x, bare(x)) for x in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000)))]
    pairs = [(x, y) for x, y in pairs if y != x and len(y) == 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def fold(c: Column) -> Column:
    """Without diacritics: marked letters become their bases, and marks of their own go. ASCII is left as it is."""
    marked = F.regexp_replace(F.translate(c, *_folds()), r"\p{Mn}+", "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(marked)


@F.pandas_udf(StringType())
def _idna(s: pd.Series) -> pd.Series:
    try:
        import idna
    except ImportError:
        return s

    def one(x: str | None) -> str | None:
        if not x:
            return x
        try:
            mapped = idna.uts46_remap(x, std3_rules=False, transitional=False)
            return ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in mapped.split("."))
        except (idna.IDNAError, UnicodeError):
            return x

    return s.map(one)


def idna(c: Column) -> Column:
    bare = F.regexp_replace(c, r"^\.+|\.+$", "")
    return F.when(F.octet_length(bare) == F.char_length(bare), bare).otherwise(_idna(bare))


def lowercase(c: Column) -> Column:
    return F.lower(F.translate(c, "Σİ", "σi"))  # one letter at a time, whatever its place in a word


def strip_punctuation(c: Column) -> Column:
    kept = F.transform(tokens(c), lambda t: F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{Nd}\-]", ""), r"^-+|-+$", ""))
    return F.array_join(F.filter(kept, lambda t: t != ""), " ")


def steps_of(steps: str | tuple[str, ...]) -> tuple[str, ...]:
    """The steps of a preset's name or of a list; unknown ones and stray arguments are errors."""
    if isinstance(steps, str):
        if steps not in PRESETS:
            raise ValueError(f"unknown preset {steps!r}")
        return PRESETS[steps]
    for step in steps:
        name, colon, words = step.partition(":")
        if name == "strip_words":
            if not [w for w in words.split(",") if w.strip()]:
                raise ValueError("strip_words needs words")
        elif name not in PLAIN or colon:
            raise ValueError(f"unknown step {step!r}")
    return tuple(steps)


def _keeps(drop: list[str]):
    return lambda t: ~F.regexp_replace(t, r"^\.+|\.+$", "").isin(drop)


def analyze(c: Column, steps: str | tuple[str, ...]) -> Column:
    for step in steps_of(steps):
        name, _, words = step.partition(":")
        if name == "strip_words":
            drop = [w.strip() for w in words.split(",") if w.strip()]
            c = F.array_join(F.filter(tokens(c), _keeps(drop)), " ")
        elif name == "sort_tokens":
            c = F.array_join(F.array_sort(tokens(c)), " ")
        else:
            c = {"lowercase": lowercase, "fold_diacritics": fold, "strip_punctuation": strip_punctuation, "trim": collapse, "idna": idna}[name](c)
    return collapse(c)


def char_grams(c: Column, n: int) -> Column:
    """Distinct n-grams of code points in order; a shorter string is its own only gram, an empty one has none."""
    size = F.char_length(c)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(c)).otherwise(F.array_distinct(cut))


def grams(c: Column, sizes: tuple[int, ...] = (2, 3), strip_spaces: bool = False) -> Column:
    c = F.replace(c, F.lit(" "), F.lit("")) if strip_spaces else c
    return F.array_distinct(F.concat(*(char_grams(c, n) for n in sizes)))


def parents(c: Column) -> Column:
    """The string and its parent domains of two labels at least, nearest first."""
    parts = F.split(c, r"\.")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.filter(up, lambda x: x != "")


def register(spark) -> None:
    """The analysers for SQL: fold_diacritics(s), idna_domain(s), parent_suffixes(s) as a table function of (level, suffix)."""
    import pandas as pd
    from pyspark.sql.functions import udtf

    @udtf(returnType="level int, suffix string")
    class Suffixes:
        def eval(self, s: str):
            while s:
                yield self.level, s
                self.level += 1
                s = s.partition(".")[2]
                if "." not in s:
                    return

        def __init__(self):
            self.level = 0

    def bare(s: pd.Series) -> pd.Series:
        marks = lambda x: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))
        return s.map(lambda x: x if x is None or x.isascii() else marks(x))

    spark.udf.register("fold_diacritics", F.pandas_udf(bare, StringType()))
    spark.udf.register("idna_domain", _idna)
    spark.udtf.register("parent_suffixes", Suffixes)
