"""Requests to score: defaults for optional fields, rejects for missing required ones."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.schemas import REQUEST


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch=64) -> DataFrame:
    """JSON files as a stream; the file limit bounds a micro-batch, and with it the rows of any one user."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(path)


def parse_requests(messages: DataFrame, value="value") -> DataFrame:
    """Requests from a column of JSON texts, such as a message queue delivers."""
    parsed = F.from_json(F.col(value).cast("string"), REQUEST, {"allowSingleQuotes": "false"})
    return messages.select(parsed.alias("r")).select("r.*")


def valid_requests(raw: DataFrame):
    """(accepted with defaults filled in, rejected with the names of the missing fields)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in C.REQUEST_REQUIRED]))
    defaults = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in C.REQUEST_DEFAULTS.items()}
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in C.REQUEST_REQUIRED])
    accepted = raw.where(complete).withColumns(defaults)
    rejected = raw.where(~complete).withColumn(
        "error", F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return accepted, rejected
