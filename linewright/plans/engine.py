"""The whole plan behind one object: from lines or texts to brands and products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import candidates as cd
from ..operators import vocabulary as vc
from ..operators.extract import cascade, rule_rows
from ..operators.submission import columns_of, completed
from ..operators.vocabulary import Rule


@dataclass
class Engine:
    """Vocabularies and thresholds; ``scorer`` adds ``predicted`` to candidates, None chooses without a model."""

    brands: list = field(default_factory=list)
    products: list = field(default_factory=list)
    aliases: list = field(default_factory=list)
    brand_rules: list = field(default_factory=list)
    product_rules: list = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    suppressed: dict = field(default_factory=dict)
    scorer: Callable[[DataFrame], DataFrame] | None = None
    phrase_threshold: float = 6.3
    alias_threshold: float = 5.0
    margin: float = 0.5
    merges: bool = False

    @classmethod
    def from_labels(cls, labels: DataFrame, brand_rules: list[Rule] = [], product_rules: list[Rule] = [], **more) -> Engine:  # noqa: B006
        """Gazetteers and aliases from labelled rows (brand_name, product_name); rules as given."""
        spark = labels.sparkSession
        gazetteer = vc.brand_gazetteer(labels)
        named = gazetteer.select(F.xxhash64("norm").alias("canonical_ord"), F.col("brand").alias("canonical"), F.lit(0).cast("long").alias("alias_ord"), F.col("brand").alias("alias"))
        return cls(vc.collected(gazetteer), vc.collected(vc.product_gazetteer(labels)), vc.collected(vc.alias_table(named)), rule_rows(brand_rules, spark) if brand_rules else [], rule_rows(product_rules, spark) if product_rules else [], **more)

    def predict_text(self, df: DataFrame, key: str, text: str = "ocr_text") -> DataFrame:
        """key, ocr_text, brand_name, product_name and the stages' own answers, from texts alone."""
        shown = clean(F.col(text))
        return self._extract(df.select(key, shown.alias("ocr_text"), F.when(shown != "", F.concat_ws(" || ", shown, shown)).otherwise(F.lit("")).alias("evidence_text")), key)

    def predict_lines(self, lines: DataFrame, key: str) -> DataFrame:
        """The same from line records: candidates, their choice, evidence of all crops, extraction."""
        made = cd.with_features(cd.candidates(lines, key, self.merges), key)
        chosen = cd.choose(made, key, keep=["ocr_text"]) if self.scorer is None else cd.choose(self.scorer(cd.prepared(made)), key, "predicted", ["ocr_text"])
        return self._extract(cd.evidence(chosen, made, key), key)

    def submission(self, lines: DataFrame, items: DataFrame, key: str = "image_id", phase: str = "phase2") -> DataFrame:
        """Predictions for every item of a catalog; items without lines are blank."""
        fields = columns_of(phase)[1:]
        return completed(self.predict_lines(lines, key), items, key, fields)

    def _extract(self, df: DataFrame, key: str) -> DataFrame:
        return cascade(df, key, self.brands, self.products, self.aliases, self.brand_rules, self.product_rules, self.rules, self.suppressed, self.phrase_threshold, self.alias_threshold, self.margin)


def text_columns(df: DataFrame, key: str) -> list[str]:
    """Columns that hold evidence by their names."""
    return [c for c in df.columns if c != key and any(part in c.lower() for part in ("ocr", "text", "variant", "selected"))]


def with_evidence(df: DataFrame, key: str) -> DataFrame:
    """``evidence_text``, from the text columns if it is not there."""
    if "evidence_text" in df.columns:
        return df
    return df.withColumn("evidence_text", F.concat_ws(" || ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns(df, key))))


def feature_lists(bundle: dict) -> tuple[list[str], list[str], list[str]]:
    """Categorical, numeric and all features of a model bundle, under any of the keys that bundles use, else the defaults."""
    pick = lambda *names: next((list(map(str, bundle[n])) for n in names if bundle.get(n) is not None), [])
    cats = pick("cat_cols", "categorical_cols", "category_cols") or list(cd.CATEGORICAL)
    nums = pick("num_cols", "numeric_cols", "numeric_features") or list(cd.NUMERIC)
    return tuple(list(dict.fromkeys(x)) for x in (cats, nums, pick("feature_cols", "features", "input_cols", "columns") or cats + nums))  # type: ignore[return-value]
