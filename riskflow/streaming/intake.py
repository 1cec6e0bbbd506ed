"""Intake of requests as JSON texts: accepted ones with defaults, and a dead-letter sink for all others.

A text is accepted if it is one strict JSON object (`operators.replies`) with every required field readable. Any other goes
to the dead letters with its raw text and the reason; accepted and rejected rows together are the input, in every micro-batch.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.operators import replies
from riskflow.schemas import REQUEST
from riskflow.streaming.jobs import replace_folder


def judged(messages: DataFrame, value="value") -> DataFrame:
    """`messages` with `request`, the parsed fields, and `reason`, null for an accepted text."""
    text = F.col(value).cast("string")
    parsed = messages.withColumns({"request": F.from_json(text, REQUEST, {"allowSingleQuotes": "false"}), "__object": replies.is_json_object(text),
                                   "__json": replies.is_json(text)})
    missing = F.array_compact(F.array(*[F.when(F.col(f"request.{c}").isNull(), F.lit(c)) for c in C.REQUEST_REQUIRED]))
    reason = (F.when(text.isNull() | (F.trim(text) == ""), F.lit("empty")).when(~F.col("__json"), F.lit("not JSON"))
              .when(~F.col("__object"), F.lit("not a JSON object"))
              .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))
    return parsed.withColumn("reason", reason).drop("__object", "__json")


def accepted(rows: DataFrame, value="value") -> DataFrame:
    """The requests of accepted texts next to the other columns of the message."""
    rest = [c for c in rows.columns if c not in ("request", "reason", value)]
    clash = [c for c in REQUEST.names if c in rest]
    out = rows.where("reason IS NULL").select(*[c for c in rest if c not in clash], "request.*")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in C.REQUEST_DEFAULTS.items()})


def rejected(rows: DataFrame, value="value") -> DataFrame:
    """The raw texts of all others with the reason."""
    return rows.where("reason IS NOT NULL").drop("request").withColumn(value, F.col(value).cast("string"))


def writer(value="value", write=replace_folder):
    """foreachBatch writer: requests below `accepted`, dead letters below `rejected`. The texts are parsed once."""
    def write_both(batch: DataFrame, batch_id: int, path: str):
        rows = judged(batch, value).persist()
        try:
            write(accepted(rows, value), batch_id, f"{path}/accepted")
            write(rejected(rows, value), batch_id, f"{path}/rejected")
        finally:
            rows.unpersist()
    return write_both
