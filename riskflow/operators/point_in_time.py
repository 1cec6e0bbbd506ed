"""Per-user history features as of every single transaction.

Spark's sliding RANGE frame recomputes the frame for each row, which is quadratic for a busy user, and one
user's rows are one task. Here every transaction becomes a few signed events instead: it enters all counters
at its own time and leaves the limited ones when their horizon has passed. A running sum over the events of a
user, in time order, is then the sliding aggregate: linear, one shuffle, one sort.

A hot user (see `skew`) is cut into slices of about equally many events, each a window partition of its own. The cuts
are quantiles of (time, kind, id) in a sample of the user's events, so neither a single old row, nor a burst, nor
rows of one microsecond make a large slice. The cuts have a row per slice; what earlier slices
hand over (net sums, the newest times) has one too and meets the rows where they are.

History of a row = earlier rows of the same user in (ts, transaction_id) order; horizons include their edge. A row
without a user has no history and is nobody's. An amount that is no finite number, or beyond MAX_AMOUNT, is left out of
sums and of the counts that averages divide by; a missing one counts as 0.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import config as C
from riskflow.functions.times import DAY_US, HOUR_US, micros
from riskflow.operators.skew import HotKeys, hot_keys
from riskflow.operators.values import KNOWN_FIELDS

# Exact type for sums that are added and later taken away again.
MONEY = "DECIMAL(38,10)"
MAX_AMOUNT = 1e15
SAMPLES = 30  # sampled rows per slice of a hot user

ALL, LAST_24H, LAST_7D, TODAY, TIMES, FIRST, TOP = "all", "24h", "7d", "today", "times", "first", "top"
EVERYTHING = (ALL, LAST_24H, LAST_7D, TODAY, TIMES, FIRST)

# An event of a row without a time counts 0: the row keeps its place in the result but is nobody's history.
_ONE = "CAST(__t IS NOT NULL AS BIGINT)"
READABLE = f"(transaction_amount IS NULL OR abs(transaction_amount) <= {MAX_AMOUNT}D)"  # NaN is above all numbers
_AMOUNT = f"IF(__t IS NULL OR NOT {READABLE}, 0D, coalesce(CAST(transaction_amount AS DOUBLE), 0D))"
_AMOUNTS = f"{_ONE} * CAST({READABLE} AS BIGINT)"
_FAILED = f"{_ONE} * coalesce(CAST(is_failed AS BIGINT), 0)"
_FRAUD = f"{_ONE} * coalesce(CAST(fraud_label = 1 AS BIGINT), 0)"

# Per horizon: counter -> what a row adds, and when the row leaves (None = never).
_COUNTERS = {
    ALL: ({"all_n": _ONE, "all_amount": _AMOUNT, "all_amounts": _AMOUNTS, "all_fraud": _FRAUD}, None),
    LAST_24H: ({"n_24h": _ONE}, f"__t + {24 * HOUR_US}"),
    LAST_7D: ({"n_7d": _ONE, "amount_7d": f"CAST({_AMOUNT} AS {MONEY})", "amounts_7d": _AMOUNTS, "failed_7d": _FAILED},
              f"__t + {7 * DAY_US}"),
    # the last microsecond of the day: events of one time come after the rows of that time
    TODAY: ({"n_today": _ONE}, "unix_micros(CAST(date_add(to_date(ts), 1) AS TIMESTAMP)) - 1"),
}
_TYPES = {"all_amount": "DOUBLE", "amount_7d": MONEY}


def _counters(parts) -> list:
    return [c for p in parts if p in _COUNTERS for c in _COUNTERS[p][0]]


def _events(rows: DataFrame, user: str, parts) -> DataFrame:
    """(user, at, kind 0 = enters / 1 = leaves, tie, seen, counters, row): one entering event per row."""
    names = _counters(parts)
    carried = [c for c in rows.columns if c not in (user, "__t")]
    row = "named_struct({})".format(", ".join(f"'{c}', `{c}`" for c in carried))

    def event(at, kind, amounts, seen, payload):
        sums = "".join(", '{}', {}".format(
            c, amounts.get(c, f"CAST(0 AS {_TYPES.get(c, 'BIGINT')})")) for c in names)
        return f"named_struct('at', {at}, 'kind', {kind}, 'tie', transaction_id, 'seen', {seen}{sums}, 'row', {payload})"

    adds = {c: expression for p in parts if p in _COUNTERS for c, expression in _COUNTERS[p][0].items()}
    events = [event("__t", 0, adds, "__t", row)]
    for p in parts:
        if p in _COUNTERS and _COUNTERS[p][1]:
            takes = {c: f"CAST(-({e}) AS {_TYPES.get(c, 'BIGINT')})"
                     for c, e in _COUNTERS[p][0].items()}
            events.append(event(_COUNTERS[p][1], 1, takes, "CAST(NULL AS BIGINT)", "NULL"))
    return rows.selectExpr(user, f"inline(array({', '.join(events)}))")


_PLACE = "named_struct('at', at, 'kind', kind, 'tie', tie)"


def _cuts(events: DataFrame, user: str) -> DataFrame:
    """(user, cuts): where each slice after the first begins, for every hot user; a row per hot user.

    `events` has the hot users' events with their `size` and `pieces`. The sample depends on the events alone, and its
    result is fetched, so every use of the slices sees the same ones.
    """
    sample = events.where(f"pmod(xxhash64(tie, kind, at), {1 << 30}) < {1 << 30} * least(1D, pieces * {SAMPLES} / size)")
    order = f"PARTITION BY {user} ORDER BY at, kind, tie"
    tiles = sample.selectExpr(user, f"{_PLACE} AS cut", f"CAST((row_number() OVER ({order}) - 1) * pieces DIV "
                                                        f"count(*) OVER (PARTITION BY {user}) AS INT) AS tile")
    cuts = (tiles.where("tile > 0").groupBy(user, "tile").agg(F.min("cut").alias("cut"))
            .groupBy(user).agg(F.sort_array(F.collect_list("cut")).alias("cuts")))
    return events.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _sliced(events: DataFrame, hot: HotKeys, user: str) -> DataFrame:
    """Slice number of each event; events after a hot user's last row change nothing and are dropped.

    Rows without a user are spread: each is a slice of its own.
    """
    nobody = "CAST(pmod(xxhash64(tie), 2147483647) AS INT)"
    if not hot:
        return events.withColumn("slice", F.expr(f"IF({user} IS NULL, {nobody}, 0)"))
    marked = hot.attach(events, user).where("coalesce(at <= hi, true)").drop("lo", "hi", "top")
    cuts = _cuts(marked.where("pieces IS NOT NULL").select(user, "at", "kind", "tie", "size", "pieces"), user)
    of_hot = f"coalesce(size(filter(cuts, c -> c <= {_PLACE})), 0)"
    return (marked.join(F.broadcast(cuts), user, "left")
            .withColumn("slice", F.expr(f"IF({user} IS NULL, {nobody}, {of_hot})")).drop("cuts", "size"))


def _carried(sliced: DataFrame, user: str, parts) -> DataFrame:
    """For each slice of a hot user: sums and the three newest times of all earlier slices."""
    names = _counters(parts)
    cut = sliced.where("pieces IS NOT NULL")
    earlier = f"OVER (PARTITION BY {user} ORDER BY slice ROWS BETWEEN"
    out = cut.groupBy(user, "slice").agg(F.expr("count(seen)").alias("n_rows"),
                                         *[F.expr(f"sum({c})").alias(c) for c in names])
    out = out.selectExpr(user, "slice", *[f"sum({c}) {earlier} UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_{c}"
                                          for c in names])
    if TIMES not in parts:
        return out
    newest = f"row_number() OVER (PARTITION BY {user}, slice ORDER BY seen DESC, row.transaction_id DESC)"
    times = (cut.where("seen IS NOT NULL").selectExpr(user, "slice", "seen", f"{newest} AS place")
             .where(f"place <= {C.RAPID_ROWS}").groupBy(user, "slice")
             .agg(F.expr("sort_array(collect_list(seen), false)").alias("times")))
    # Every row of `times` holds at least one time, so the three rows before it hold the three newest.
    handed = f"flatten(collect_list(times) {earlier} {C.RAPID_ROWS} PRECEDING AND 1 PRECEDING))"
    times = times.selectExpr(user, "slice",
                             f"slice(sort_array({handed}, false), 1, {C.RAPID_ROWS}) AS before_times")
    return out.join(times, [user, "slice"], "left")


def _first_in_slice(local: DataFrame, user: str) -> DataFrame:
    """new_<field>: first row of the slice with its value. The rows are placed already; each field is a sort."""
    for field, c in KNOWN_FIELDS.items():
        order = f"PARTITION BY {user}, slice, row.{c} ORDER BY at IS NULL, at, row.transaction_id"
        local = local.selectExpr("*", f"coalesce(at IS NOT NULL AND row.{c} != '' AND "
                                      f"row_number() OVER ({order}) = 1, false) AS new_{field}")
    return local


def _first_of_all(local: DataFrame, sliced: DataFrame, user: str) -> DataFrame:
    """For hot users a first row counts only in the first slice that has the value."""
    pairs = ", ".join(f"named_struct('field', '{f}', 'value', row.{c})" for f, c in KNOWN_FIELDS.items())
    starts = (sliced.where("pieces IS NOT NULL AND seen IS NOT NULL").selectExpr(user, "slice", f"inline(array({pairs}))")
              .where("value != ''").groupBy(user, "field", "value").agg(F.min("slice").alias("first_slice")))
    for field, c in KNOWN_FIELDS.items():
        side = starts.where(F.col("field") == field).selectExpr(f"{user} AS __user", "value AS __value", "first_slice")
        # only first rows have a partner; the others get a key that is spread and matches nothing
        local = local.withColumns({
            "__key_user": F.expr(f"IF(new_{field}, {user}, NULL)"),
            "__key_value": F.expr(f"IF(new_{field}, row.{c}, concat('\\0', row.transaction_id))")})
        match = F.col("__key_value").eqNullSafe(F.col("__value")) & F.col("__key_user").eqNullSafe(F.col("__user"))
        local = (local.join(side, match, "left")
                 .withColumn(f"new_{field}", F.expr(f"new_{field} AND slice = coalesce(first_slice, slice)"))
                 .drop("__key_user", "__key_value", "__user", "__value", "first_slice"))
    return local


def busy_users(txn: DataFrame, user="user_id") -> HotKeys:
    """Hot users with the time span and the largest amount of their rows."""
    return hot_keys(txn.select(user, micros("ts").alias("__t"), "transaction_amount"), user,
                    [F.min("__t").alias("lo"), F.max("__t").alias("hi"), F.max("transaction_amount").alias("top")])


def point_in_time(txn: DataFrame, user="user_id", parts=EVERYTHING, hot: HotKeys = None) -> DataFrame:
    """Adds to every transaction what was known about its user just before it; `parts` limits the work.

    Of a row without a user all counts and flags are 0 and all averages null.

    all    hist_count, hist_avg_amount, hist_fraud and previous_fraudulent_activity (0/1): all earlier rows
    24h    count_24h
    7d     count_7d, failed_transaction_count_7d, avg_transaction_amount_7d (null without rows)
    today  daily_transaction_count: earlier rows of the same calendar day
    times  rapid_succession: the three newest earlier rows lie within 24 h and span less than one hour
    first  is_new_device, is_new_location, is_new_merchant (0/1): no earlier row has the value; an empty or
           missing value, or a row without a time, is never new
    top    user_max_amount: the largest amount of all rows of the user, earlier and later ones (not in EVERYTHING)
    """
    rows = txn.withColumn("__t", micros("ts"))
    hot = busy_users(txn, user) if hot is None else hot
    sliced = _sliced(_events(rows, user, parts), hot, user)
    window = f"PARTITION BY {user}, slice ORDER BY at, kind, tie"
    before = f"OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lags = [f"lag(seen, {k}) IGNORE NULLS OVER ({window}) AS t{k}" for k in range(1, C.RAPID_ROWS + 1)] \
        if TIMES in parts else []
    local = sliced.selectExpr(user, "slice", "at", "kind", "row", f"count(seen) {before} AS place", *lags,
                              *[f"sum({c}) {before} AS sum_{c}" for c in _counters(parts)]).where("kind = 0")
    if FIRST in parts:
        local = _first_in_slice(local, user)
    if TOP in parts:  # the rows are placed already; the maximum of a hot user is known from the search for hot users
        local = local.withColumn("slice_max", F.expr(f"max(row.transaction_amount) OVER (PARTITION BY {user}, slice)"))
        if hot:
            local = local.join(F.broadcast(hot.frame.select(user, "top")), user, "left")
    if hot:
        local = local.join(_carried(sliced, user, parts), [user, "slice"], "left")
        if FIRST in parts:
            local = _first_of_all(local, sliced, user)

    def total(name):
        return f"(coalesce(sum_{name}, 0) + coalesce(before_{name}, 0))" if hot else f"coalesce(sum_{name}, 0)"

    def newest(k):
        """Time of the k-th newest earlier row: of this slice, or handed over by the earlier ones."""
        return f"IF(place >= {k}, t{k}, get(before_times, CAST({k} - 1 - place AS INT)))" if hot else f"t{k}"

    rapid = (f"coalesce({newest(C.RAPID_ROWS)} >= at - {C.RECENT_HOURS * HOUR_US} AND "
             f"{newest(1)} - {newest(C.RAPID_ROWS)} < {C.RAPID_HOURS * HOUR_US}, false)")
    results = {
        ALL: {"hist_count": total("all_n"),
              "hist_avg_amount": f"CAST({total('all_amount')} AS DOUBLE) / nullif({total('all_amounts')}, 0)",
              "hist_fraud": total("all_fraud"),
              "previous_fraudulent_activity": f"CAST({total('all_fraud')} > 0 AS INT)"},
        LAST_24H: {"count_24h": total("n_24h")},
        LAST_7D: {"count_7d": total("n_7d"),
                  "avg_transaction_amount_7d": f"CAST({total('amount_7d')} AS DOUBLE) / nullif({total('amounts_7d')}, 0)",
                  "failed_transaction_count_7d": f"CAST({total('failed_7d')} AS INT)"},
        TODAY: {"daily_transaction_count": f"CAST({total('n_today')} AS INT)"},
        TIMES: {"rapid_succession": rapid},
        FIRST: {f"is_new_{f}": f"CAST(new_{f} AS INT)" for f in KNOWN_FIELDS},
        TOP: {"user_max_amount": "coalesce(top, slice_max)" if hot else "slice_max"},
    }
    nothing = {"hist_avg_amount": "CAST(NULL AS DOUBLE)", "avg_transaction_amount_7d": "CAST(NULL AS DOUBLE)",
               "rapid_succession": "false", "user_max_amount": "CAST(NULL AS DOUBLE)"}
    added = [f"IF({user} IS NULL, {nothing.get(name, '0')}, {e}) AS {name}" for p in parts for name, e in results[p].items()]
    kept = [c if c == user else f"row.`{c}` AS `{c}`" for c in txn.columns]
    return local.selectExpr(*kept, *added)
