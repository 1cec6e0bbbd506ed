"""Reading and writing the package's tables. Text formats have explicit schemas; Parquet tables carry their own."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import config as C
from riskflow.schemas import canonical, transaction_file


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw or enhanced transactions; columns get their short names and the time is parsed.

    The header line gives the order of the columns, the package their types; no data is read to find types. Fields are
    read as text and converted one by one: whole numbers may be written `1.0`, as other programs do for columns with
    gaps. A field that is no value of its type becomes null, and its column is named in `unreadable`.
    """
    files = spark.read.option("header", True)
    header = files.csv(path).columns
    kinds = transaction_file(header)
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = files.schema(text).option("enforceSchema", False).csv(path).toDF(*[canonical(c) for c in header])

    def value(name, kind):
        if name == "ts":
            return F.col(name).try_cast("timestamp")
        if isinstance(kind, T.StringType):
            return F.col(name)
        number = F.col(name).try_cast("double")
        return number if isinstance(kind, T.DoubleType) else F.when(number == F.floor(number), number.try_cast(kind))

    values = {canonical(f.name): value(canonical(f.name), f.dataType) for f in kinds}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in values.items()]))
    return raw.select(*[v.alias(c) for c, v in values.items()], F.when(F.size(bad) > 0, bad).alias("unreadable"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw or enhanced transactions stored as Parquet, with either naming."""
    raw = spark.read.parquet(path)
    return parse_time(raw.toDF(*[canonical(c) for c in raw.columns]))


def parse_time(df: DataFrame) -> DataFrame:
    """`ts` as a timestamp; doing it twice changes nothing."""
    return df.withColumn("ts", F.col("ts").try_cast("timestamp"))


def raw_names(df: DataFrame) -> DataFrame:
    """Back to the column names of the raw file; calculated columns keep theirs."""
    known = {canonical(c): c for c in C.RAW_COLUMNS}
    return df.toDF(*[known.get(c, c) for c in df.columns])


def drop_repeated(df: DataFrame, key="transaction_id") -> DataFrame:
    """One row per transaction id: the earliest. Copies are reduced on the map side first."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("ts", F.xxhash64(*rest))).alias("__row"))
            .select(key, "__row.*"))


def write_history(df: DataFrame, path: str, mode="overwrite", files_per_day=None):
    """History store: a folder per day, rows clustered by user inside it.

    Range partitioning by (day, user, time) splits a heavy user over several files and keeps the value
    ranges of the files narrow, so a user filter or a time filter skips most of them.
    """
    dated = df.withColumn("txn_date", F.to_date("ts"))
    keys = ["txn_date", "user_id", "ts"]
    placed = dated.repartitionByRange(files_per_day, *keys) if files_per_day else dated.repartitionByRange(*keys)
    (placed.sortWithinPartitions(*keys).write.mode(mode).partitionBy("txn_date").parquet(path))


def read_history(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """History rows in [since, until); the bounds prune day folders and row groups."""
    df = spark.read.parquet(path)
    if since is not None:
        bound = F.lit(since).cast("timestamp")
        df = df.where((F.col("txn_date") >= F.to_date(bound)) & (F.col("ts") >= bound))
    if until is not None:
        bound = F.lit(until).cast("timestamp")
        df = df.where((F.col("txn_date") <= F.to_date(bound)) & (F.col("ts") < bound))
    return df


def write_history_by_user(df: DataFrame, name: str, path: str, buckets: int):
    """History table `name` whose files are bucketed by user and sorted by time: a join or an aggregation by user, such as
    the history pass of a scoring run, reads it without a shuffle of its rows.

    A heavy user is in one bucket; choose this layout where users are many and even, and the one by day elsewhere.
    """
    (df.repartition(buckets, "user_id").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "user_id").sortBy("user_id", "ts").saveAsTable(name))


def read_history_by_user(spark: SparkSession, name: str, since=None, until=None) -> DataFrame:
    """Rows of a bucketed history table in [since, until); the bounds skip row groups, the buckets stay."""
    df = spark.table(name)
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col("ts") < F.lit(until).cast("timestamp"))
    return df


def history_of(history: DataFrame, users: DataFrame) -> DataFrame:
    """Only the rows of users that occur in `users`: the batch form of a lookup by user.

    The engine broadcasts the users where it measures them to be few, and the history is then filtered where it is read.
    """
    return history.join(users.select("user_id").distinct(), "user_id", "left_semi")


def write_json(df: DataFrame, path: str, mode="overwrite"):
    """Profiles, scenarios, metadata. Null fields are kept, so each record has the same keys."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode="overwrite"):
    """Times keep their microseconds."""
    (df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def save_model(model: PipelineModel, metadata: DataFrame, importance: DataFrame, path: str):
    """Encoders and trees as one unit, with metadata and importances next to it."""
    model.write().overwrite().save(f"{path}/model")
    for key in [k for k in _models if k[1] == path]:
        del _models[key]
    write_json(metadata, f"{path}/metadata")
    write_csv(importance, f"{path}/importance")


_models = {}


def load_model(path: str) -> PipelineModel:
    """The saved model; read once per session and save, however often it is asked for."""
    key = (SparkSession.active().sparkContext.applicationId, path)
    if key not in _models:
        _models[key] = PipelineModel.load(f"{path}/model")
    return _models[key]
