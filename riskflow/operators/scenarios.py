"""Five labelled demo transactions, one per attack type."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C


def scenario_samples(enhanced: DataFrame, velocity=C.VELOCITY_SCENARIO_COUNT, takeover=C.TAKEOVER_AMOUNT,
                     deviation=C.DEVIATION_SCENARIO_RATIO, distance=C.GEOGRAPHIC_DISTANCE,
                     photo="photos/uploads/deepfake_demo.jpg") -> DataFrame:
    """The first matching transaction of every scenario, in (ts, transaction_id) order.

    `enhanced` should be a stored table: a first scan of the tested columns finds the first time of each
    scenario, a second one fetches the rows of these times. Neither sorts or shuffles rows. A scenario without a
    match has no row.
    """
    fraud = F.col("fraud_label") == 1
    tests = [(F.col("fraud_label") == 0) & (F.col("risk_score") < C.CLEAN_RISK_BELOW),
             fraud & (F.col("daily_transaction_count") > velocity),
             fraud & (F.col("transaction_amount") > takeover),
             fraud & (F.col("amount_deviation_ratio") > deviation),
             fraud & (F.col("transaction_distance") > distance)]
    times = enhanced.agg(*[F.min(F.when(t, F.unix_micros("ts"))).alias(f"t{i}") for i, t in enumerate(tests)]).first()
    hits = [t & (F.col("ts") == F.timestamp_micros(F.lit(times[i]))) for i, t in enumerate(tests) if times[i] is not None]
    names = [n for i, n in enumerate(C.SCENARIO_NAMES) if times[i] is not None]
    matched = F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n in zip(hits, names)])) \
        if hits else F.array().cast("array<string>")
    candidates = enhanced.where(reduce(lambda a, b: a | b, hits, F.lit(False)))
    first = (candidates.select(F.explode(matched).alias("scenario_name"), F.struct(*enhanced.columns).alias("row"))
             .groupBy("scenario_name").agg(F.min_by("row", F.col("row.transaction_id")).alias("row"))
             .select("scenario_name", "row.*"))
    takeover_row = F.col("scenario_name") == C.SCENARIO_NAMES[2]
    return first.withColumns({
        "uploaded_photo_path": F.when(takeover_row, F.lit(photo)),
        "biometric_match_score": F.when(takeover_row, F.lit(C.TAKEOVER_MATCH_SCORE)),
        "deepfake_confidence": F.when(takeover_row, F.lit(C.TAKEOVER_DEEPFAKE_CONFIDENCE))})
