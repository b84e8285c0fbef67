"""Candidate texts of an item, their features, and the choice between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ACCENT_CLASS, joined_features, line_counts, number, with_text_features
from ..functions.text import clean
from .crops import MERGED, WHOLE, candidate_arrays
from .lines import CROPS, MERGES, POLICIES, first_by

CATEGORICAL = ["candidate_name", "candidate_type", "source_variant"]
NUMERIC = [
    "num_lines", "avg_line_score", "median_line_score", "avg_area_ratio", "text_len", "word_count", "char_count", "digit_count", "alpha_count", "upper_count", "accent_count",
    "digit_ratio", "alpha_ratio", "upper_ratio", "accent_ratio", "junk_ratio", "is_blank", "has_digit", "has_accent", "has_dot", "has_plus", "line_score_x_num_lines", "area_x_num_lines",
    "raw_text_len", "raw_word_count", "raw_num_lines", "raw_avg_line_score", "raw_digit_ratio", "raw_alpha_ratio", "raw_junk_ratio",
    "rel_text_len_vs_raw", "rel_word_count_vs_raw", "rel_num_lines_vs_raw", "delta_score_vs_raw", "delta_junk_vs_raw",
]
RAW = ["text_len", "word_count", "num_lines", "avg_line_score", "digit_ratio", "alpha_ratio", "junk_ratio"]


@dataclass
class Candidates:
    """Candidates of each item as one array: ``df`` has the key, ``_texts`` and ``_c``.

    Features are sums over lines, so texts are put together only where they are asked for. What is chosen is chosen
    within the row, without an exchange.
    """

    df: DataFrame
    key: str
    profile: str
    crops: list[str]
    merges: list[str]

    @classmethod
    def of(cls, lines: DataFrame, key: str, merges: bool = False, crops=CROPS, profile: str = "live", features: bool = True, policies: tuple[str, ...] = POLICIES) -> Candidates:
        """``lines``: key, line_idx, ord, line_text, line_score, area_ratio."""
        pairs = [list(p) for p in MERGES] if merges else []
        crops = [tuple(c) for c in crops]
        shown = lines.where(F.col(key).isNotNull()).withColumn("_text", clean(F.col("line_text")))
        counts = line_counts(F.col("_text"), profile) if features else {}
        one = F.struct("ord", "line_idx", F.lower("_text").alias("low"), F.col("line_score").cast("double").alias("score"), F.col("area_ratio").cast("double").alias("area"), F.col("line_text").rlike(ACCENT_CLASS).cast("int").alias("accented"), (F.length("_text") >= 8).cast("int").alias("long"), *(v.alias(f"of_{k}") for k, v in counts.items()), F.col("_text").alias("text"))
        rows = shown.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_l"))
        sums = [f"of_{k}" for k in counts]
        kind = "array<struct<kind:int,variant:int,policy:int,places:array<int>,num_lines:bigint,avg_line_score:double,median_line_score:double,avg_area_ratio:double" + "".join(f",{k}:bigint" for k in sums) + ",candidate_name:string,cand_ord:int" + (",text_len:int,junk:double,rank_score:double" if features else "") + ">>"

        @F.arrow_udf(kind)
        def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = list(candidate_arrays(batch, crops, policies, pairs, sums))
                yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.null()))

        fields = [c for c in ("line_idx", "low", "score", "area", "accented", "long", *sums)]
        slim = F.transform("_l", lambda x: F.struct(*(x[c].alias(c) for c in fields)))
        df = rows.select(key, F.transform("_l", lambda x: x["text"]).alias("_texts"), slim.alias("_l")).select(key, "_texts", made(F.col("_l")).alias("_c"))
        return cls(df, key, profile, [c[0] for c in crops], ["+".join(p) for p in pairs])

    def fields(self, c: Column, features: bool = True) -> dict[str, Column]:
        """All columns of a candidate but its text."""
        listed = lambda names: F.array(*map(F.lit, names or [""]))
        names = {
            "candidate_name": c["candidate_name"], "candidate_type": F.get(F.array(F.lit("existing_variant"), F.lit("single_variant_line_policy"), F.lit("merged_line_policy")), c["kind"]),
            "source_variant": F.when(c["kind"] == MERGED, F.get(listed(self.merges), c["variant"])).otherwise(F.get(listed(self.crops), c["variant"])), "cand_ord": c["cand_ord"],
        }
        stats = {k: c[k] for k in ("num_lines", "avg_line_score", "median_line_score", "avg_area_ratio")}
        return names | stats | (self.features(c) if features else {})

    def features(self, c: Column) -> dict[str, Column]:
        counted = ("n", "dot", "plus", "alpha", "digit", "upper", "accent", "words", "bad", "null")
        return joined_features({k: c[f"of_{k}"] for k in counted}, F.size(c["places"]), self.profile)

    def text(self, c: Column) -> Column:
        return F.array_join(F.transform(c["places"], lambda i: F.get(F.col("_texts"), i)), " ")

    def rows(self, features: bool = True) -> DataFrame:
        """A row for each candidate; with ``features`` all that ``with_features`` gives."""
        raw = F.get("_c", F.lit(self.crops.index("raw"))) if "raw" in self.crops else F.get(F.slice("_c", 1, 0), F.lit(0))  # whole crops come first
        split = self.df.select(self.key, "_texts", *([raw.alias("_raw")] if features else []), F.explode("_c").alias("_c"))
        c = F.col("_c")
        out = split.select("*", *(v.alias(k) for k, v in self.fields(c, features).items())).withColumn("ocr_text", self.text(c))
        if features:
            r = F.col("_raw")
            of_raw = self.features(r) | {k: r[k] for k in ("num_lines", "avg_line_score")}
            out = with_lines(out)
            out = with_relative(out, {f"raw_{k}": F.when(r.isNotNull(), of_raw[k]).cast("double") for k in RAW}, self.profile)
        return out.drop("_texts", "_raw", "_c")

    def chosen(self, predicted: Callable[[Column], Column] | None = None, evidence: bool = False) -> DataFrame:
        """key, candidate_name, ocr_text and rank_score of the candidate that ``choose`` takes (live profile; ``predicted``: of a candidate
        with its name), and with ``evidence`` the text that ``evidence`` makes."""

        def numbers(c: Column) -> Column:
            ties = [(-c["text_len"]).alias("t0"), c["cand_ord"].alias("t1"), c["candidate_name"].alias("t2")]
            score, places = -c["rank_score"], c["places"].alias("places")
            order = predicted(c) if predicted else F.lit(None).cast("double")
            return F.struct(F.struct(score.alias("a"), *ties, places).alias("best"), F.struct(order.alias("a"), c["junk"].alias("b"), *ties, score.alias("s"), places).alias("model"))

        made = self.df.withColumn("_n", F.transform("_c", numbers)).withColumn("_best", F.array_min(F.transform("_n", lambda n: n["best"])))
        best = F.col("_best")
        pick = F.struct(best["t2"].alias("name"), best["a"].alias("s"), best["places"].alias("places"))
        if predicted:
            made = made.withColumn("_model", F.array_min(F.filter(F.transform("_n", lambda n: n["model"]), lambda m: m["a"].isNotNull())))
            model = F.col("_model")
            pick = F.when(F.size(model["places"]) > 0, F.struct(model["t2"].alias("name"), model["s"].alias("s"), model["places"].alias("places"))).otherwise(pick)
        made = made.withColumn("_pick", pick)
        out = made.select(self.key, F.col("_pick.name").alias("candidate_name"), self.text(F.col("_pick")).alias("ocr_text"), (-F.col("_pick.s")).alias("rank_score"), "_texts", "_c")
        if not evidence:
            return out.drop("_texts", "_c")
        whole = F.filter(F.array_sort(F.transform(F.filter("_c", lambda c: (c["kind"] == WHOLE) & (F.size(c["places"]) > 0)), lambda c: F.struct(c["variant"].alias("variant"), c["places"].alias("places")))), lambda c: F.size(c["places"]) > 0)
        parts = F.concat(F.array("ocr_text", "ocr_text"), F.transform(whole, self.text))
        text = F.array_join(F.filter(parts, lambda x, i: (i == 0) | (x != "")), " || ")
        return out.select(self.key, "ocr_text", F.trim(text).alias("evidence_text"))


def candidates(lines: DataFrame, key: str, merges: bool = False, crops=CROPS) -> DataFrame:
    """A candidate for every crop (blank ones too) and for every line policy that keeps text.

    ``lines``: key, line_idx, ord, line_text, line_score, area_ratio.
    """
    shown = [key, "candidate_name", "candidate_type", "source_variant", "cand_ord", "num_lines", "avg_line_score", "median_line_score", "avg_area_ratio", "ocr_text"]
    return Candidates.of(lines, key, merges, crops, features=False).rows(features=False).select(*shown)


def relative_to_raw(df: DataFrame, key: str, is_raw: Column, profile: str = "live") -> DataFrame:
    """raw_*, rel_* and delta_* columns. live divides by max(1, raw) and takes a missing raw row as zeros; lcf divides by
    raw + 1 and leaves what depends on a missing raw row null. Computing twice gives the same: old columns go first."""
    df = df.drop(*(c for c in df.columns if c.startswith(("raw_", "rel_")) or c in ("delta_score_vs_raw", "delta_junk_vs_raw")))
    by = Window.partitionBy(key)
    return with_relative(df, {f"raw_{c}": F.max(F.when(is_raw, F.col(c))).over(by).cast("double") for c in RAW}, profile)


def with_relative(df: DataFrame, raw: dict[str, Column], profile: str = "live") -> DataFrame:
    """What ``relative_to_raw`` adds, from the raw row's values."""
    out = df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in raw.items()} if profile == "live" else raw)
    under = lambda c: F.greatest(F.lit(1.0), c) if profile == "live" else F.coalesce(c, F.lit(0.0)) + 1.0
    rel = {f"rel_{c}_vs_raw": F.col(c) / under(F.col(f"raw_{c}")) for c in ("text_len", "word_count", "num_lines")}
    return out.withColumns(rel | {"delta_score_vs_raw": F.col("avg_line_score") - F.col("raw_avg_line_score"), "delta_junk_vs_raw": F.col("junk_ratio") - F.col("raw_junk_ratio")})


def with_lines(df: DataFrame) -> DataFrame:
    lines = F.coalesce(F.col("num_lines").cast("double"), F.lit(0.0))
    return df.withColumns({"line_score_x_num_lines": F.coalesce("avg_line_score", F.lit(0.0)) * lines, "area_x_num_lines": F.coalesce("avg_area_ratio", F.lit(0.0)) * lines})


def with_features(df: DataFrame, key: str, profile: str = "live") -> DataFrame:
    """The 35 numeric features of each candidate."""
    made = with_lines(with_text_features(df, "ocr_text", profile))
    return relative_to_raw(made, key, F.col("candidate_name") == "variant::raw", profile)


def rank_score(of: Callable[[str], Column] = F.col) -> Column:
    """The choice without a model: sure lines and many words count for a candidate, junk and merging against it."""
    return 4.0 * F.coalesce(of("avg_line_score"), F.lit(0.0)) + F.least(F.coalesce(of("word_count"), F.lit(0)), F.lit(40)) / 10.0 - 3.0 * F.coalesce(of("junk_ratio"), F.lit(0.0)) - F.when(of("candidate_type") == "merged_line_policy", 2.0).otherwise(0.0)


def rank_features(df: DataFrame) -> DataFrame:
    """What the rank score and its ties are made of, and no more."""
    return with_text_features(df, "ocr_text", only=("text_len", "word_count", "junk_ratio"))


def choose(df: DataFrame, key: str, predicted: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The chosen candidate of each item: lowest predicted error, or, without a prediction or if that is blank, the best rank score.

    Both choices are made in one aggregation with partial results before the exchange. ``keep`` names the columns that
    come along: what is not asked for is not computed.
    """
    ranked = df.withColumn("rank_score", rank_score())
    row = F.struct("ocr_text", *(c for c in keep or ranked.columns if c not in (key, "ocr_text")))
    ties = [-F.col("text_len"), F.col("cand_ord"), F.col("candidate_name")]
    picks = [F.min_by(row, F.struct((-F.col("rank_score")).alias("a"), *(t.alias(f"t{k}") for k, t in enumerate(ties)))).alias("_best")]
    if predicted is not None:
        order = F.struct(F.col(predicted).alias("a"), F.col("junk_ratio").alias("b"), *(t.alias(f"t{k}") for k, t in enumerate(ties)))
        picks.append(F.min_by(row, F.when(F.col(predicted).isNotNull(), order)).alias("_model"))
    out = ranked.groupBy(key).agg(*picks)
    if predicted is not None:
        out = out.withColumn("_best", F.when(F.trim("_model.ocr_text") != "", F.col("_model")).otherwise(F.col("_best")))
    return out.select(key, "_best.*")


def prepared(df: DataFrame, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, missing: float | None = 0.0) -> DataFrame:
    """Every feature column present and of its kind; numbers that are missing or not finite become ``missing``."""
    have = set(df.columns)
    cats = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in categorical}
    nums = {c: (number(F.col(c)) if missing is not None else F.col(c).try_cast("double")) if c in have else F.lit(missing).cast("double") for c in numeric}
    return df.withColumns(cats | nums)


def score_candidates(df: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``scorer`` adds ``predicted``; None means the choice without a model."""
    return choose(df, key) if scorer is None else choose(scorer(prepared(df)), key, "predicted")


def filled_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those columns that hold any value, found in one pass."""
    have = [c for c in columns if c in df.columns]
    counts = df.agg(*(F.count(c).alias(c) for c in have)).first() if have else {}
    return [c for c in have if counts[c]]


def best_variant(df: DataFrame, key: str, predicted: str = "pred_cer") -> DataFrame:
    if predicted not in df.columns:
        raise ValueError(f"no column {predicted}")
    return first_by(df, [key], F.asc_nulls_last(predicted), F.asc("variant"))


def router_features(report: DataFrame, key: str, variants: list[str]) -> DataFrame:
    """Features of whole crops: text features, differences from the raw crop, quality columns if there, one column for each crop."""
    need = [key, "variant", "ocr_text", "avg_score", "num_lines"]
    if absent := [c for c in need if c not in report.columns]:
        raise ValueError(f"missing columns: {absent}")
    df = report.where(F.col("variant").isin(variants)).withColumns({"ocr_text": F.coalesce("ocr_text", F.lit("")), "avg_score": number(F.col("avg_score")), "num_lines": number(F.col("num_lines"))})
    df = with_text_features(df, "ocr_text", "router")
    by = Window.partitionBy(key)
    raw = {f"raw_{c}": F.coalesce(F.max(F.when(F.col("variant") == "raw", F.col(c))).over(by), F.lit(0)) for c in ("avg_score", "num_lines", "text_len", "word_count", "line_count_text", "is_blank_pred")}
    df = df.withColumns(raw).withColumns({f"{n}_minus_raw": F.col(c) - F.col(f"raw_{c}") for n, c in (("score", "avg_score"), ("num_lines", "num_lines"), ("text_len", "text_len"), ("word_count", "word_count"))})
    quality = [c for c in ("width", "height", "long_side", "short_side", "mean_brightness", "contrast_std", "blur_laplacian_var", "dark_pixel_ratio") if c in report.columns]
    return df.withColumns({c: number(F.col(c)) for c in quality} | {f"variant__{v}": (F.col("variant") == v).cast("int") for v in variants})


def blank_features(df: DataFrame, key: str) -> DataFrame:
    """Twelve aggregates over an item's candidates."""
    named = [f(F.col(c)).alias(f"{n}_{s}") for c, s in (("text_len", "text_len"), ("word_count", "word_count"), ("avg_line_score", "score"), ("num_lines", "num_lines")) for n, f in (("max", F.max), ("mean", F.avg))]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cand_count"), F.count_if(F.col("text_len") > 0).alias("nonblank_cand_count"), *named, F.min("junk_ratio").alias("min_junk_ratio"), F.avg("junk_ratio").alias("mean_junk_ratio"))


def blank_pivot(df: DataFrame, key: str, variants: list[str]) -> DataFrame:
    """``metric__variant`` columns of the whole crops, for a fixed list of crops: one aggregation, no pivot job."""
    own = F.col("candidate_type") == "existing_variant"
    return df.groupBy(key).agg(*(F.max(F.when(own & (F.col("source_variant") == v), F.col(c))).alias(f"{c}__{v}") for c in ("text_len", "word_count", "num_lines", "avg_line_score", "junk_ratio") for v in variants))


def evidence(chosen: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """key, ocr_text (chosen) and evidence_text: the chosen text, again, and each crop's text that is not blank."""
    whole = df.where((F.col("candidate_type") == "existing_variant") & (F.col("ocr_text") != "")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_ord", "ocr_text"))), lambda x: x["ocr_text"]).alias("_all"))
    joined = chosen.select(key, "ocr_text").join(whole, key, "left")
    parts = F.concat(F.array("ocr_text", "ocr_text"), F.coalesce("_all", F.array().cast("array<string>")))
    text = F.array_join(F.filter(parts, lambda x, i: (i == 0) | (x != "")), " || ")
    return joined.select(key, "ocr_text", F.trim(text).alias("evidence_text"))
