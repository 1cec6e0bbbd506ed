"""Model store with versions: a published model is never written again, and what is current is one row in a log.

    <root>/versions/<n>/    model, metadata and importances of version n, complete before anything names it
    <root>/log/<seq>/       the version that is current from this entry on; the highest entry counts

A reader that looks while a version is written sees the one before. Going back is a new entry for an old version. Numbers
come from one publisher at a time; an entry that is there already is never replaced, so a second one at once fails.
"""

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.sources import tables

LOG = "seq INT, version INT"
_loaded = {}


def log(spark: SparkSession, root: str) -> DataFrame:
    """(seq, version) of every entry; an unfinished one has no row."""
    try:
        return spark.read.schema(LOG).json(f"{root}/log/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def current(spark: SparkSession, root: str):
    """The current version, None before the first."""
    row = log(spark, root).agg(F.max_by("version", "seq")).first()
    return row[0]


def pin(spark: SparkSession, root: str, version: int):
    """Makes a version current from now on."""
    last = log(spark, root).agg(F.max("seq")).first()[0]
    seq = 0 if last is None else last + 1
    spark.createDataFrame([(seq, version)], LOG).coalesce(1).write.mode("error").json(f"{root}/log/{seq}")


def publish(model: PipelineModel, metadata: DataFrame, importance: DataFrame, root: str) -> int:
    """Stores a model as a new version and makes it current; returns the version."""
    spark = metadata.sparkSession
    version = (log(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    tables.save_model(model, metadata, importance, f"{root}/versions/{version}")
    pin(spark, root, version)
    return version


def load(spark: SparkSession, root: str, version: int = None):
    """(version, model): the current one unless another is named. A version does not change, so it is read once per session."""
    version = current(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"no model in {root}")
    key = (spark.sparkContext.applicationId, root, version)
    if key not in _loaded:
        _loaded[key] = PipelineModel.load(f"{root}/versions/{version}/model")
    return version, _loaded[key]
