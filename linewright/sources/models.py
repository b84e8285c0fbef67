"""Bundles of fitted models: folders that any session can load again, with nothing in place of what cannot be loaded."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import SparkSession

_LOADED: dict[tuple[str, str], PipelineModel | None] = {}


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def save_bundle(path: str, models: Mapping[str, MLWritable]) -> None:
    """One folder for each model, as a pipeline of that one stage if it is none yet."""
    for name, model in models.items():
        whole = model if isinstance(model, PipelineModel) else PipelineModel([model])
        whole.write().overwrite().save(f"{path}/{name}")
        _LOADED.pop((path, name), None)


def load_model(spark: SparkSession, path: str, name: str) -> PipelineModel | None:
    """The model, loaded once for a process; None where there is none or it does not load: callers then take their fallback."""
    key = (path, name)
    if key not in _LOADED:
        where, files = _file_system(spark, f"{path}/{name}")
        try:
            _LOADED[key] = PipelineModel.load(f"{path}/{name}") if files.exists(where) else None
        except Exception:  # noqa: BLE001  a damaged bundle is as good as none
            _LOADED[key] = None
    return _LOADED[key]


def load_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, PipelineModel | None]:
    return {name: load_model(spark, path, name) for name in names}


def bundle_bytes(spark: SparkSession, path: str) -> int:
    """The size of all files of a bundle; 0 where there is none."""
    where, files = _file_system(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0
