"""Text normalisation as Column expressions.

Everything here stays inside whole-stage codegen.  Spark has no Unicode
normaliser, so accents are folded with one ``translate`` whose table is derived
from the Unicode database; the few code points that decompose to *several*
characters (ligatures, vulgar fractions) go through ``fold_distinct``, which
sends only the distinct strings that still need it to Arrow.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

APOSTROPHES = "’'"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A long CASE over an expensive expression would repeat that expression in every branch; a
    lambda variable holds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decomposed(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.category(c).startswith("M"))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings of every BMP code point that folds to exactly one ASCII character."""
    pairs = []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        base = _decomposed(chr(code))
        if len(base) == 1 and ord(base) < 128:
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_marks(text: Column) -> Column:
    """Compatibility-fold accented letters to their base letter and drop combining marks."""
    source, target = accent_table()
    return F.translate(F.regexp_replace(text, r"\p{M}", ""), source, target)


def squash(text: Column) -> Column:
    """Lower-case already folded text and reduce it to ``[a-z0-9%]`` words."""
    bare = F.regexp_replace(F.lower(text), f"[{APOSTROPHES}]", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9%]+", " "))


def fold_text(text: Column) -> Column:
    """Matching key of a name or title: no accents, no apostrophes, single spaces."""
    return squash(strip_marks(text))


@lru_cache(maxsize=1)
def _expanding_class() -> str:
    """Regex class of the code points that ``strip_marks`` leaves but that fold to ASCII.

    These are the ligatures, fractions and letter-like symbols that decompose to several
    characters, and everything foldable beyond the basic plane.
    """
    handled = set(accent_table()[0])
    points = [c for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000))
              if chr(c) not in handled and any(ord(x) < 128 for x in _decomposed(chr(c)))]
    ranges, start = [], points[0]
    for here, following in zip(points, [*points[1:], None]):
        if following != here + 1:
            ranges.append(f"\\x{{{start:X}}}-\\x{{{here:X}}}")
            start = following
    return "[" + "".join(ranges) + "]"


@F.pandas_udf(StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else "".join(_decomposed(c) for c in s))


#: Nothing in these ranges folds to more than one character; most text stays inside them.
_PLAIN_RANGES = r"[^\x00-\xBB\xBF-\u0131]"


def needs_full_fold(text: Column) -> Column:
    """A character expands when folded.  The wide class is tried only on text that leaves the plain ranges."""
    return F.coalesce(text.rlike(_PLAIN_RANGES) & text.rlike(_expanding_class()), F.lit(False))


def fold_distinct(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out`` = the fully folded ``column``.

    Ordinary rows are folded in place.  Only strings with a character that expands go
    through Arrow, each distinct one once.
    """
    plain = df.filter(~needs_full_fold(F.col(column))).withColumn(out, fold_text(F.col(column)))
    rest = df.filter(needs_full_fold(F.col(column)))
    folded = rest.select(column).distinct().withColumn(out, squash(_nfkd(F.col(column))))
    return plain.unionByName(rest.join(folded, column))


def name_key(text: Column) -> Column:
    """Conversion-table key of an ingredient name."""
    joined = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit("and")), r"\s+", " ")
    return F.regexp_replace(F.trim(joined), "^[ ,.;:]+|[ ,.;:]+$", "")


def swedish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "ÅÄÖ", "åäö"))


def contains_folded(text: Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(swedish_lower(text), F.lit(needle.lower()))


def first_text(*candidates: Column) -> Column:
    """First alternative that is a non-blank string, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


#: Words that describe preparation, not identity (fixed values).
PREPARATION_WORDS = (
    "finely|coarsely|freshly|chopped|diced|minced|sliced|grated|shredded|peeled|seeded|sifted|softened|melted|"
    "beaten|divided|packed|crushed|rinsed|drained|large|medium|small|optional"
)
#: Qualifiers that may remain next to a recognised food without making it doubtful (fixed values).
NEUTRAL_QUALIFIERS = "organic|extra virgin|fresh|frozen|dried|ground|raw|boneless|skinless"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def strip_preparation(folded: Column) -> Column:
    return collapse(F.regexp_replace(folded, rf"\b(?:{PREPARATION_WORDS})\b", " "))


def leftover_words(cleaned: Column, alias: Column) -> Column:
    """What remains of a name once its alias and the neutral qualifiers are removed."""
    at = F.position(alias, cleaned)
    without = F.when(
        at > 0, F.concat(F.substring(cleaned, F.lit(1), at - 1), F.substring(cleaned, at + F.length(alias), F.length(cleaned)))
    ).otherwise(cleaned)
    return collapse(F.regexp_replace(without, rf"\b(?:{NEUTRAL_QUALIFIERS})\b", " "))
