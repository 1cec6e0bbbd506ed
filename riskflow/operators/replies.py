"""Model replies: JSON inside text that may not parse.

A reply is read as strictly as a JSON document should be: the text is parsed once as the only member of an
object and once as the only element of an array. Text that is complete JSON on its own survives both;
trailing text, several documents, code fences and single quotes fail at least one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import config as C
from riskflow.functions.text import template
from riskflow.functions.times import col
from riskflow.schemas import ASSESSMENT_REPLY, MONITOR_REPLY, PHOTO_REPLY

_STRICT = {"allowSingleQuotes": "false", "allowComments": "false"}


def is_json(text) -> Column:
    text = col(text)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v STRING, bad STRING",
                         {**_STRICT, "columnNameOfCorruptRecord": "bad"})
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    return F.coalesce(member["bad"].isNull() & (F.size(element) == 1), F.lit(False))


def is_json_object(text) -> Column:
    return is_json(text) & F.coalesce(col(text).rlike(r"^\s*\{"), F.lit(False))


def _read(df: DataFrame, reply: str, schema: str, fallback, verdict_field=None) -> DataFrame:
    """One column per reply field, plus `error` for a reply that is missing or is JSON but no object.

    fallback(text, error) gives the values used when the text is no JSON object. The text is parsed in one
    projection and the fields are taken from the result in the next, so each parse happens once per row.
    """
    text = F.col(reply)
    parsed = df.withColumns({"__json": is_json(text), "__object": text.rlike(r"^\s*\{"),
                             "__fields": F.from_json(text, schema, _STRICT)})
    error = (F.when(text.isNull(), F.lit("no reply"))
             .when(F.col("__json") & ~F.col("__object"), F.lit("reply is not a JSON object")))
    good = F.coalesce(F.col("__json") & F.col("__object"), F.lit(False))
    otherwise = fallback(text, error)
    columns = {}
    for name in T.StructType.fromDDL(schema).names:
        value = F.col(f"__fields.{name}")
        if name == verdict_field:  # an absent key differs from null; the keys are read only where it matters
            keys = F.map_keys(F.from_json(text, "map<string,string>", _STRICT))
            value = (F.when(value.isNotNull(), value)
                     .when(~F.coalesce(F.array_contains(keys, name), F.lit(False)), F.lit(C.REPLY_VERDICT)))
        columns[name] = F.when(good, value).otherwise(otherwise.get(name, F.lit(None)))
    return parsed.withColumns({**columns, "error": error}).drop("__json", "__object", "__fields")


def _texts(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def parse_monitor(df: DataFrame, reply="reply") -> DataFrame:
    """Adds verdict (REVIEW when absent), risk_factors, recommended_action, reasoning and error."""
    return _read(df, reply, MONITOR_REPLY, lambda text, error: {
        "verdict": F.lit(C.REPLY_VERDICT), "risk_factors": _texts([C.MONITOR_FALLBACK_FACTOR]),
        "recommended_action": F.lit(C.MANUAL_REVIEW), "reasoning": text}, "verdict")


def parse_photo(df: DataFrame, reply="reply") -> DataFrame:
    """Like the monitor reply; the verdict is always text, so an explicit null reads "None"."""
    out = _read(df, reply, PHOTO_REPLY, lambda text, error: {
        "verdict": F.lit(C.REPLY_VERDICT), "risk_assessment": _texts([C.PHOTO_FALLBACK_FINDING]),
        "recommended_action": F.lit(C.MANUAL_REVIEW), "reasoning": text}, "verdict")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("None")))


def parse_assessment(df: DataFrame, reply="reply") -> DataFrame:
    """Adds the assessment columns.

    Bad JSON gives REVIEW / 50 / MEDIUM and the first 500 characters of the text; a reply that is missing or
    no object gives REVIEW / 0 / UNKNOWN with an error. Keys absent from a good reply stay null.
    """
    bad, broken = C.ASSESSMENT_FALLBACK, C.ASSESSMENT_ERROR

    def fallback(text, error):
        def either(on_error, on_text):
            return F.when(error.isNotNull(), on_error).otherwise(on_text)
        return {
            "final_verdict": F.lit(C.REPLY_VERDICT), "recommended_action": F.lit(C.MANUAL_REVIEW),
            "confidence_score": either(F.lit(broken["confidence_score"]), F.lit(bad["confidence_score"])),
            "risk_level": either(F.lit(broken["risk_level"]), F.lit(bad["risk_level"])),
            "risk_summary": either(template(broken["risk_summary"], error), F.lit(bad["risk_summary"])),
            "key_findings": either(_texts(broken["key_findings"]), _texts(bad["key_findings"])),
            "decision_reasoning": either(F.lit(broken["decision_reasoning"]),
                                         F.substring(text, 1, C.REPORT_EXCERPT))}

    out = _read(df, reply, ASSESSMENT_REPLY, fallback)
    return out.withColumn("confidence_score", F.col("confidence_score").try_cast("double"))
