"""Photo-check responses: nested JSON to flat columns, and the risk factors in them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.text import number_text, rounded, template
from riskflow.operators.replies import is_json_object, parse_photo
from riskflow.schemas import BIOMETRIC


def parsed(response="response") -> Column:
    return F.from_json(F.col(response), BIOMETRIC, {"allowSingleQuotes": "false"})


def _false(c) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _zero(c) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def risk_factors(r="r") -> Column:
    """List of messages in rule order.

    A missing quality score counts as perfect here although it is shown as 0. Eyes count as hidden unless
    reported open; sunglasses only when reported.
    """
    checks = f"{r}.liveness_check.checks"
    similarity, quality = F.col(f"{r}.face_comparison.similarity"), F.col(f"{r}.quality_check.quality_score")
    rules = {
        "face_mismatch": (~_false(f"{r}.face_comparison.match"),
                          [F.coalesce(number_text(similarity), F.lit("0"))]),
        "deepfake": (~_false(f"{r}.quality_check.is_real"), []),
        "liveness": (~_false(f"{r}.liveness_check.is_live"), []),
        "low_quality": (quality.try_cast("double") < C.PHOTO_QUALITY_MIN, [number_text(quality)]),
        "eyes": (~F.coalesce(F.col(checks)["eyes_open"], F.lit(False)), []),
        "sunglasses": (F.coalesce(~F.col(checks)["no_sunglasses"], F.lit(False)), []),
    }
    return F.array_compact(F.array(*[F.when(test, template(C.PHOTO_FACTOR_FORMATS[name], *shown))
                                     for name, (test, shown) in rules.items()]))


def flatten(df: DataFrame, response="response") -> DataFrame:
    """One column per reported value, with the defaults for missing keys; a response that is no JSON object
    gets an `error` instead of values."""
    r = df.withColumn("r", parsed(response))
    mean = (_zero("r.face_comparison.confidence") + _zero("r.quality_check.confidence") +
            _zero("r.liveness_check.confidence")) / 3
    emotion = F.get("r.quality_check.emotions", F.lit(0))
    result = F.coalesce("r.verification_result", F.lit("UNKNOWN"))
    no_pose = F.create_map().cast("map<string,double>")
    no_checks = F.create_map().cast("map<string,boolean>")
    out = r.withColumns({
        "error": F.when(~is_json_object(response), F.lit("photo check returned no JSON object")),
        "is_authentic": (result == "VERIFIED") & _false("r.face_comparison.match") &
        _false("r.quality_check.is_real") & _false("r.liveness_check.is_live"),
        "verification_result": result,
        "overall_confidence": rounded(mean, 2),
        "face_matched": _false("r.face_comparison.match"),
        "face_similarity": _zero("r.face_comparison.similarity"),
        "face_confidence": _zero("r.face_comparison.confidence"),
        "is_real": _false("r.quality_check.is_real"),
        "real_confidence": _zero("r.quality_check.confidence"),
        "quality_score": _zero("r.quality_check.quality_score"),
        "is_live": _false("r.liveness_check.is_live"),
        "liveness_score": _zero("r.liveness_check.liveness_score"),
        "liveness_confidence": _zero("r.liveness_check.confidence"),
        "checks_passed": F.coalesce("r.liveness_check.checks", no_checks),
        "brightness": _zero("r.quality_check.quality_metrics.brightness"),
        "sharpness": _zero("r.quality_check.quality_metrics.sharpness"),
        "pose": F.coalesce("r.quality_check.pose", no_pose),
        "top_emotion": F.coalesce(emotion["type"], F.lit("UNKNOWN")),
        "emotion_confidence": F.coalesce(emotion["confidence"], F.lit(0.0)),
        "photo_risk_factors": risk_factors("r"),
        "raw_reason": F.coalesce("r.reason", F.lit("")),
    })
    return out.drop("r")


def photo_result(responses: DataFrame, said: DataFrame = None) -> DataFrame:
    """The photo branch per transaction: the checks, what the model said about them, and the final verdict.

    responses: transaction_id, response. said: transaction_id, reply; a transaction without a reply, or no `said` at all,
    has no verdict. `error` is that of the check, else that of the reply; a failed check has no verdict.
    """
    checks = flatten(responses).drop("response")
    if said is None:
        return checks.withColumn("photo_verdict", F.lit(None).cast("string"))
    read = parse_photo(said.select("transaction_id", "reply")).select(
        "transaction_id", F.col("verdict").alias("photo_verdict"), F.col("risk_assessment").alias("photo_findings"),
        F.col("recommended_action").alias("photo_action"), F.col("reasoning").alias("photo_reasoning"),
        F.col("error").alias("reply_error"))
    out = checks.join(read, "transaction_id", "left").withColumn("error", F.coalesce("error", "reply_error")).drop("reply_error")
    return out.withColumn("photo_verdict", F.when(F.col("error").isNull(), F.col("photo_verdict")))


def photo_requests(requests: DataFrame, photo="photo_path", threshold=C.SIMILARITY_THRESHOLD):
    """(rows for the photo check, rows rejected with an error). Rows without a photo are in neither."""
    with_photo = requests.where(F.coalesce(photo, F.lit("")) != "")
    named = F.coalesce(F.col("user_id").cast("string"), F.lit("")) != ""
    ready = with_photo.where(named).withColumn("similarity_threshold", F.lit(threshold))
    rejected = with_photo.where(~named).withColumn("error", F.lit("missing user_id"))
    return ready, rejected
