"""Edit distance, token overlap and error classes, each in the profiles that its users need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, eval_key, null_to_empty

PARTLY_WRONG = ("partial_too_short", "partial_too_long", "wrong_partial_overlap", "wrong_no_overlap")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(null_to_empty(c), r"(?U)^\s+|\s+$", "")


def no_text(c: Column) -> Column:
    """Empty, or a spelled-out null."""
    return F.lower(trimmed(c)).isin("", "none", "nan", "null")


def char_error_rate(truth: Column, guess: Column, profile: str = "metric") -> Column:
    """``metric``: trimmed, at most 1. ``eval``: untrimmed, without a cap. ``target``: as metric, spelled-out nulls are empty."""
    if profile == "eval":
        truth, guess = null_to_empty(truth), null_to_empty(guess)
    elif profile == "target":
        truth, guess = (F.when(no_text(c), F.lit("")).otherwise(trimmed(c)) for c in (truth, guess))
    else:
        truth, guess = trimmed(truth), trimmed(guess)
    rate = F.levenshtein(truth, guess) / F.length(truth)
    if profile != "eval":
        rate = F.least(rate, F.lit(1.0))
    return F.when(truth == "", (guess != "").cast("double")).otherwise(rate)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def _f1(common: Column, n_truth: Column, n_guess: Column) -> Column:
    precision, recall = common / n_guess, common / n_truth
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def token_f1(truth: Column, guess: Column) -> Column:
    """Over sets of lower-cased tokens, accents kept."""
    a, b = (F.array_distinct(_tokens(F.lower(trimmed(c)))) for c in (truth, guess))
    blank = (trimmed(truth) == "") & (trimmed(guess) == "")
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(blank, 1.0).when(either, 0.0).otherwise(_f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)))


def shared_count(a: Column, b: Column) -> Column:
    """How many elements two arrays share, repeats counted: sorted, both are walked once."""

    def walk(x: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            left, right = F.get(x["a"], at["i"]), F.get(x["b"], at["j"])
            same, less = left == right, left < right
            move = lambda c: F.coalesce(c.cast("int"), F.lit(0))
            return F.struct((at["i"] + move(same | less)).alias("i"), (at["j"] + move(same | ~less)).alias("j"), (at["n"] + move(same)).alias("n"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        return F.aggregate(F.concat(x["a"], x["b"]), start, step, lambda at: at["n"])

    return bound(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")), walk)


def multiset_f1(truth: Column, guess: Column) -> Column:
    """Over multisets of evaluation-key tokens."""

    def score(x: Column) -> Column:
        empty = (F.size(x["a"]) == 0).cast("int") + (F.size(x["b"]) == 0).cast("int")
        both = F.when(empty == 0, shared_count(x["a"], x["b"]))
        return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(bound(both, lambda n: _f1(n, F.size(x["a"]), F.size(x["b"]))))

    return bound(F.struct(_tokens(eval_key(truth)).alias("a"), _tokens(eval_key(guess)).alias("b")), score)


def error_class(guess: Column, truth: Column) -> Column:
    g, t = eval_key(guess), eval_key(truth)
    a, b = F.split(g, " "), F.split(t, " ")
    return (
        F.when((g == "") & (t == ""), "true_blank").when(g == "", "miss").when(t == "", "false_fill").when(g == t, "correct")
        .when(F.size(F.array_except(a, b)) == 0, "partial_too_short").when(F.size(F.array_except(b, a)) == 0, "partial_too_long")
        .when(F.arrays_overlap(a, b), "wrong_partial_overlap").otherwise("wrong_no_overlap")
    )
