"""Model training as a Spark ML pipeline: encode, assemble, boosted trees."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.operators import metrics
from riskflow.session import shared_dir

_CATEGORICAL = [c.lower() for c in C.CATEGORICAL_FEATURES]
_FEATURES = [c.lower() for c in C.MODEL_FEATURES]
_BLOCK_BITS = 20  # the cuts of a split are looked for in one of 2^20 blocks of hash values
_MAX_LABELS = 10_000


# --- label encoding as tables ----------------------------------------------------------------

def label_dictionary(df: DataFrame, columns=None) -> DataFrame:
    """(field, value, code): codes 0, 1, ... in alphabetical order per field; a missing value is 'nan'."""
    columns = columns or _CATEGORICAL
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))
                               .alias("value")) for c in columns])
    distinct = df.select(F.inline(pairs)).distinct()
    return distinct.withColumn("code", F.row_number().over(W.partitionBy("field").orderBy("value")) - 1)


def encode(df: DataFrame, dictionary: DataFrame, columns=None, suffix="_code") -> DataFrame:
    """Adds one code column per categorical column; a value the dictionary lacks gets 0.

    Plain joins: the engine measures the dictionary, broadcasts it where it is small, and splits frequent values
    where it is not.
    """
    for c in columns or _CATEGORICAL:
        codes = dictionary.where(F.col("field") == c).select(F.col("value").alias("__value"),
                                                             F.col("code").alias(c + suffix))
        df = (df.withColumn("__value", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
              .join(codes, "__value", "left").drop("__value").fillna(0, [c + suffix]))
    return df


# --- split -----------------------------------------------------------------------------------

def _quotas(counts: DataFrame, size: str, share: float, name: str) -> DataFrame:
    """Adds `name`: how many rows of each label go to a part of the given share, rounded up as a whole.

    `counts` has one row per label. Each label gets its proportion rounded down; the rows that are left go to
    the labels with the largest remainders.
    """
    whole = W.partitionBy()
    exact = F.ceil(F.sum(size).over(whole) * F.lit(share)) * F.col(size) / F.sum(size).over(whole)
    left = F.ceil(F.sum(size).over(whole) * F.lit(share)) - F.sum(F.floor("__exact")).over(whole)
    order = W.orderBy(F.desc(F.col("__exact") - F.floor("__exact")), F.desc(size))
    return (counts.withColumn("__exact", exact)
            .withColumn("__extra", (F.row_number().over(order) <= left).cast("int"))
            .withColumn(name, (F.floor("__exact") + F.col("__extra")).cast("long")).drop("__exact", "__extra"))


def split_sizes(df: DataFrame, label="fraud_label", test=C.TEST_SHARE, validation=C.VALIDATION_SHARE):
    """Rows of each label per part: one row per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__all"))
    tested = _quotas(counts, "__all", test, "n_test").withColumn("__rest", F.col("__all") - F.col("n_test"))
    both = _quotas(tested, "__rest", validation, "n_validation")
    return both.select(label, "n_test", "n_validation",
                       (F.col("__rest") - F.col("n_validation")).alias("n_train"))


def stratified_split(df: DataFrame, label="fraud_label", key="transaction_id", seed=C.SEED,
                     test=C.TEST_SHARE, validation=C.VALIDATION_SHARE) -> DataFrame:
    """Adds `split`: exact shares per label, in the order of a hash of the row key.

    The last test row and the last validation row of each label are looked for in narrow columns: rows are counted per
    label and block of hash values, and only the blocks that hold a cut are sorted. What comes out, two places per label, is
    compared with every row, so no wide row is shuffled.
    """
    def place(column=F.col):
        return F.struct(F.xxhash64(column(key), F.lit(seed)).alias("hash"), column(key).alias("key"))

    narrow = df.select(label, place().alias("at"))
    narrow = narrow.withColumn("block", F.shiftright("at.hash", 64 - _BLOCK_BITS).cast("int"))  # rises with the hash
    blocks = narrow.groupBy(label, "block").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "group", F.shiftright("block", _BLOCK_BITS // 2))  # so that no window holds all blocks
    groups = blocks.groupBy(label, "group").agg(F.sum("size").alias("of")).withColumn("base", F.sum("of").over(
        W.partitionBy(label).orderBy("group").rowsBetween(W.unboundedPreceding, -1)))
    inside = W.partitionBy(label, "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("size").over(inside), F.lit(0))
    sizes = split_sizes(df, label, test, validation)
    lasts = F.array(F.struct(F.lit("test").alias("part"), F.col("n_test").alias("last")),
                    F.struct(F.lit("validation").alias("part"), (F.col("n_test") + F.col("n_validation")).alias("last")))
    wanted = (blocks.join(groups, [label, "group"]).withColumn("start", start)
              .join(sizes.select(label, F.inline(lasts)), label)
              .where("start < last AND last <= start + size").select(label, "block", "part", (F.col("last") - F.col("start")).alias("nth")))
    order = W.partitionBy(label, "part").orderBy("at")
    found = (narrow.join(wanted, [label, "block"]).withColumn("n", F.row_number().over(order)).where("n = nth")
             .groupBy(label).agg(*[F.max(F.when(F.col("part") == p, F.col("at"))).alias(f"__last_{p}") for p in ("test", "validation")]))
    rows = found.limit(_MAX_LABELS + 1).collect()
    if len(rows) > _MAX_LABELS:
        raise ValueError(f"{label} has more than {_MAX_LABELS} values: not a label")
    places = df.sparkSession.createDataFrame(rows, found.schema)  # a row per label: at most _MAX_LABELS
    split = (F.when(place() <= F.col("__last_test"), "test")
             .when(place() <= F.col("__last_validation"), "validation").otherwise("train"))
    return (df.join(F.broadcast(places), label, "left").withColumn("split", split)
            .drop("__last_test", "__last_validation"))


# --- model -----------------------------------------------------------------------------------

def fit(train: DataFrame, label="fraud_label", trees=C.TREES, depth=C.TREE_DEPTH, rate=C.LEARNING_RATE,
        seed=C.SEED, fraud_ratio=None, encoders_from=None) -> PipelineModel:
    """Encoders plus boosted trees as one saved-and-loaded unit.

    Encoders are fitted on `encoders_from` (all rows, as the batch script does) or on `train`. Codes are plain
    numbers for the trees; a value unseen at fitting time gets code 0, a missing number 0.
    """
    shared_dir(train.sparkSession)  # the boosting residuals are checkpointed every few trees
    indexed = [f"{c}_idx" for c in _CATEGORICAL]
    text = ", ".join(f"coalesce(cast({c} AS string), 'nan') AS {c}_text" for c in _CATEGORICAL)
    as_text = SQLTransformer(statement=f"SELECT *, {text} FROM __THIS__")
    indexer = StringIndexer(inputCols=[f"{c}_text" for c in _CATEGORICAL], outputCols=indexed,
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    source = encoders_from if encoders_from is not None else train
    encoders = Pipeline(stages=[as_text, indexer]).fit(source.select(*_CATEGORICAL))
    sizes = [len(labels) for labels in encoders.stages[1].labelsArray]
    codes = [f"CASE WHEN {i} >= {n} THEN 0D ELSE {i} END AS {c}_in"
             for c, i, n in zip(_CATEGORICAL, indexed, sizes)]
    numbers = [f"coalesce(cast({c} AS double), 0D) AS {c}_in" for c in _FEATURES if c not in _CATEGORICAL]
    as_numbers = SQLTransformer(statement=f"SELECT *, {', '.join(codes + numbers)} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"{c}_in" for c in _FEATURES], outputCol="features")
    prepare = PipelineModel(stages=encoders.stages + [as_numbers, assembler])
    if fraud_ratio is None:
        fraud_ratio = metrics.class_balance(train, label).first()["fraud_ratio"] or 1.0
    weighted = prepare.transform(train).select(
        "features", F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, float(fraud_ratio)).otherwise(1.0).alias("weight")).persist()
    trees_model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth,
                                stepSize=rate, maxIter=trees, seed=seed, checkpointInterval=10).fit(weighted)
    weighted.unpersist()
    return PipelineModel(stages=prepare.stages + [trees_model])


def score(df: DataFrame, model: PipelineModel, keep=None) -> DataFrame:
    """Adds `fraud_probability`; the model's working columns are dropped."""
    out = model.transform(df).withColumn("fraud_probability", vector_to_array("probability")[1])
    return out.select(*(keep or df.columns), "fraud_probability")


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance), 22 rows, most important first."""
    weights = [float(w) for w in model.stages[-1].featureImportances.toArray()]
    rows = list(zip(C.MODEL_FEATURES, weights))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def top_features(importance: DataFrame, k=10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def model_metadata(spark, auc, fraud_ratio, training_rows) -> DataFrame:
    """One row that describes a trained model."""
    row = (C.MODEL_FEATURES, len(C.MODEL_FEATURES), float(auc), float(fraud_ratio), int(training_rows),
           C.CATEGORICAL_FEATURES)
    return spark.createDataFrame([row], "features array<string>, n_features int, auc_score double, "
                                        "fraud_ratio double, training_samples long, "
                                        "categorical_features array<string>")
