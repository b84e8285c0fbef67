"""Text normal forms as column expressions.

Two keys must not be confused: ``rule_key`` keeps ``+ - & .`` and turns d with stroke into a space; ``eval_key`` keeps
letters and digits alone and folds d with stroke to d.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"
ACCENTED = "À-ỹ"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: what a lambda takes from outside is made again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """Null to empty; runs of white space to one space; trimmed."""
    return F.trim(F.regexp_replace(null_to_empty(c), BLANKS, " "))


def single_line(c: Column) -> Column:
    """A cell fit for CSV: line ends and tabs are white space too."""
    return clean(c)


@cache
def _plain_letters() -> tuple[str, str]:
    """Precomposed characters of the Latin, Greek and Cyrillic blocks, and what stays without marks."""
    source, target = "", ""
    for point in range(0xC0, 0x1F00):
        c = chr(point)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        bare = unicodedata.normalize("NFC", bare)
        if len(bare) == 1 and bare != c:
            source, target = source + c, target + bare
    return source, target


def without_accents(c: Column) -> Column:
    source, target = _plain_letters()
    return F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")


def rule_key(c: Column) -> Column:
    s = F.lower(without_accents(clean(c)))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s+\-&.]+", " "), r"\s+", " "))


def eval_key(c: Column) -> Column:
    s = F.lower(F.translate(without_accents(null_to_empty(c)), "đĐ", "dD"))
    return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    """The rule key without white space."""
    return F.regexp_replace(rule_key(c), r"\s+", "")


def compact_alnum(c: Column) -> Column:
    return F.regexp_replace(rule_key(c), r"[^a-z0-9]+", "")


def first_of_each(items: Column, key=lambda x: x) -> Column:
    """Short arrays: the first element of each key, in order; empty keys go."""

    def once(x: Column) -> Column:
        return F.transform(F.filter(x, lambda r, i: (r["key"] != "") & (F.array_position(F.transform(x, lambda y: y["key"]), r["key"]) == i + 1)), lambda r: r["item"])

    return bound(F.transform(items, lambda x: F.struct(x.alias("item"), key(x).alias("key"))), once)


def split_labels(c: Column) -> Column:
    """The labels of a cell joined by +, ; or comma."""
    return F.filter(F.transform(F.split(clean(c), r"\s*\+\s*|;|,"), clean), lambda x: x != "")


def join_labels(labels: Column) -> Column:
    return F.array_join(first_of_each(F.transform(labels, clean), rule_key), " + ")


def is_label(c: Column) -> Column:
    return (clean(c) != "") & ~F.lower(clean(c)).isin("nan", "none", "null") & (F.length(rule_key(c)) >= 2)


def without_repeated_tokens(c: Column) -> Column:
    """Tokens that equal the one before, whatever the case, go."""
    keep = lambda tokens: F.filter(tokens, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(tokens, i - 1))))
    return F.array_join(bound(F.split(clean(c), " "), keep), " ")


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """Unicode NFC; only texts with combining marks leave the JVM's plain path."""
    return F.when(c.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}]"), F.pandas_udf(_compose, "string")(c)).otherwise(c)


def recognised_line(c: Column) -> Column:
    """A recognised line without noise: control, CJK, kana, Hangul and pictograph characters and stray symbols become
    spaces; slashes and hyphens close up; ``50 +`` at a word's end becomes ``50+`` and ``K2+D3`` becomes ``K2 + D3``."""
    return _without_noise(composed(null_to_empty(c)))


def _without_noise(s: Column) -> Column:
    s = F.regexp_replace(s, r"[\p{C}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{1F300}-\x{1FAFF}]", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\s +\-/%.,:&()\[\]   -     　]", " ")
    s = clean(s)
    s = F.regexp_replace(F.regexp_replace(s, r"\s*/\s*", "/"), r"\s*-\s*", "-")
    s = F.regexp_replace(s, r"(?U)\b([A-Za-zÀ-ỹ0-9]+)\s*\+\s*(?=$|\s)", "$1+")
    s = F.regexp_replace(s, r"(?<=[A-Za-zÀ-ỹ0-9])\s*\+\s*(?=[A-Za-zÀ-ỹ0-9])", " + ")
    return clean(s)


def recognised_text(c: Column) -> Column:
    """The cleaned lines of a block, each once whatever its case, joined by spaces."""
    by_line = lambda t: F.transform(F.split(F.translate(t, "\r", "\n"), "\n"), _without_noise)
    # a lambda of one element: the Python step stays outside, as lambdas may not hold it
    return F.get(F.transform(F.array(composed(null_to_empty(c))), lambda t: F.array_join(first_of_each(by_line(t), F.lower), " ")), F.lit(0))
