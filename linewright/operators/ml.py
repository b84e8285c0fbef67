"""Learned parts: the two-head product model and scorers for candidates and blanks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import trimmed
from .candidates import CATEGORICAL, NUMERIC, prepared
from .lines import spread


def word_grams(c: Column, least: int = 2, most: int = 4) -> Column:
    """Character n-grams within words padded by a space on either side; a word shorter than n gives itself once."""
    padded = F.transform(F.filter(F.split(F.lower(trimmed(c)), r"(?U)\s+"), lambda t: t != ""), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))

    def grams(n: int) -> Column:
        return F.flatten(F.transform(padded, lambda t: F.when(F.length(t) <= n, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))))

    return F.concat(*(grams(n) for n in range(least, most + 1)))


def _balanced(df: DataFrame, label: str) -> DataFrame:
    """A weight that gives every class the same sum."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(sizes.join(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))), label)  # a row for each class


class ProductModel:
    """Rules first; else a gate says whether there is a product at all; else the class of the second head."""

    def __init__(self, rule: Callable[[Column], Column] | None = None, min_class_count: int = 3, threshold: float = 0.60, max_features: int = 3000):
        self.rule, self.min_class_count, self.threshold, self.max_features = rule, min_class_count, threshold, max_features
        self.gate: PipelineModel | None = None
        self.classes: PipelineModel | None = None
        self.n_train = self.n_classes = 0

    def _features(self, name: str) -> list:
        return [CountVectorizer(inputCol="grams", outputCol=f"{name}_tf", vocabSize=self.max_features, minDF=2.0), IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf"), Normalizer(inputCol=f"{name}_idf", outputCol=f"{name}_x")]

    def fit(self, labels: DataFrame, text: str = "ocr_text", product: str = "product_name") -> ProductModel:
        rows = spread(labels.select(trimmed(F.col(text)).alias("text"), trimmed(F.col(product)).alias("product"))).withColumn("grams", word_grams(F.col("text"))).withColumn("has", (F.col("product") != "").cast("double")).cache()
        self.n_train = rows.count()
        if rows.select("has").distinct().count() == 2:
            head = LogisticRegression(featuresCol="gate_x", labelCol="has", weightCol="weight", maxIter=100, probabilityCol="gate_p", rawPredictionCol="gate_raw", predictionCol="gate_y")
            self.gate = Pipeline(stages=[*self._features("gate"), head]).fit(_balanced(rows, "has"))
        known = rows.where("text != '' AND product != ''")
        common = known.groupBy("product").count().where(F.col("count") >= self.min_class_count).select("product")
        known = known.join(F.broadcast(common), "product", "left_semi") if common.limit(100_001).count() <= 100_000 else known.join(common, "product", "left_semi")
        self.n_classes = known.select("product").distinct().count()
        if self.n_classes:
            index = StringIndexer(inputCol="product", outputCol="class", stringOrderType="alphabetAsc").fit(known)
            head = LogisticRegression(featuresCol="class_x", labelCol="class", weightCol="weight", maxIter=100, probabilityCol="class_p", rawPredictionCol="class_raw", predictionCol="class_y")
            body = Pipeline(stages=[*self._features("class"), head]).fit(_balanced(index.transform(known), "class"))
            self.classes = PipelineModel(stages=[*body.stages, IndexToString(inputCol="class_y", outputCol="class_name", labels=index.labels)])
        rows.unpersist()
        return self

    def predict(self, df: DataFrame, text: str = "ocr_text") -> DataFrame:
        """Adds ``predicted_product``."""
        out = spread(df).withColumns({"_text": trimmed(F.col(text))}).withColumn("grams", word_grams(F.col("_text")))
        sure, name = F.lit(False), F.lit("")
        if self.gate is not None and self.classes is not None:
            out = self.classes.transform(self.gate.transform(out))
            sure, name = vector_to_array("gate_p")[1] >= self.threshold, F.col("class_name")
        ruled = self.rule(F.col("_text")) if self.rule else F.lit("")
        ruled = F.coalesce(ruled, F.lit(""))
        return out.select(*df.columns, F.when(F.col("_text") == "", "").when(ruled != "", ruled).when(sure, name).otherwise("").alias("predicted_product"))

    def summary(self) -> str:
        return f"ProductModel(train={self.n_train}, classes={self.n_classes}, features<={self.max_features}, threshold={self.threshold})"


def _vectors(df: DataFrame, numeric: list[str], categorical: list[str]) -> list:
    names = [f"{c}_i" for c in categorical]
    return [StringIndexer(inputCols=categorical, outputCols=names, handleInvalid="keep"), OneHotEncoder(inputCols=names, outputCols=[f"{c}_v" for c in categorical]), VectorAssembler(inputCols=[*numeric, *(f"{c}_v" for c in categorical)], outputCol="features")]


def fit_router(df: DataFrame, target: str, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, trees: int = 20) -> Callable[[DataFrame], DataFrame]:
    """A scorer that adds the predicted error of each candidate, for ``score_candidates``."""
    rows = prepared(df, numeric, categorical)
    model = Pipeline(stages=[*_vectors(rows, numeric, categorical), GBTRegressor(featuresCol="features", labelCol=target, predictionCol="predicted", maxIter=trees, seed=1)]).fit(rows)
    return lambda frame: model.transform(prepared(frame, numeric, categorical)).select(*frame.columns, "predicted")


def fit_blank_gate(df: DataFrame, label: str, numeric: list[str], threshold: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """A scorer that adds ``should_blank`` from an item's blank features."""
    body = Pipeline(stages=[VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="keep"), LogisticRegression(labelCol=label, maxIter=50)]).fit(prepared(df, numeric, []))
    return lambda frame: body.transform(prepared(frame, numeric, [])).select(*frame.columns, (vector_to_array("probability")[1] >= threshold).alias("should_blank"))
