"""Readers of the corpus tables, and results that are written once and read again."""

from pyspark.sql import DataFrame, SparkSession

from riskflow.session import fresh_dir


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the cluster's shared folder: it survives lost executors and cuts the lineage."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list:
    """A column name that `df` does not have for each of `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
