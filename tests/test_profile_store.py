"""Profiles from parts: equal to a pass over all rows, with late, corrected and deleted days; plans read the days asked for."""

import random
from datetime import datetime, timedelta

from riskflow.operators import history, partials, profiles
from riskflow.sources import profile_store, tables

SCHEMA = ("transaction_id long, user_id string, ts timestamp, transaction_amount double, account_balance double, previous_fraudulent_activity int, "
          "is_weekend int, fraud_label int, device_type string, location string, merchant_category string, card_type string")


def rows(n, seed=1):
    draw = random.Random(seed)
    return [(i, draw.choice(["a", "a", "a", "b", None, f"u{draw.randrange(9)}"]),
             None if draw.random() < 0.03 else datetime(2024, 1, 1) + timedelta(minutes=draw.randrange(14 * 1440)),
             draw.choice([None, float(draw.randrange(1, 20000))]), float(i), draw.choice([0, 1, None]), draw.choice([0, 1, None]), draw.choice([0, 1, None]),
             *[draw.choice([None, "", *[f"{c}{k}" for k in range(12)]]) for c in "dlmc"]) for i in range(n)]


def same(a, b, digits=8):
    plain = lambda df: sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in
                               df.select(*sorted(df.columns)).collect()), key=repr)
    assert plain(a) == plain(b)


def test_parts_in_any_order_equal_the_whole(spark, tmp_path):
    root = str(tmp_path / "parts")
    every = rows(900)
    whole = spark.createDataFrame(every, SCHEMA)
    frame = lambda keep: spark.createDataFrame([r for r in every if keep(r)], SCHEMA)
    day = lambda r: r[2].day if r[2] else 0
    profile_store.write(frame(lambda r: day(r) > 9), root, 1)
    profile_store.write(frame(lambda r: 0 < day(r) <= 9 and r[0] % 3), root, 2)
    profile_store.write(frame(lambda r: 0 < day(r) <= 9 and r[0] % 3 == 0), root, 3)
    profile_store.write(frame(lambda r: day(r) == 0), root, 4)
    profile_store.write(spark.createDataFrame(rows(50, 2), SCHEMA).where("day(ts) = 5").selectExpr(
        *["user_id || 'x' AS user_id" if c == "user_id" else c for c in whole.columns]), root, 5, whole=True)  # wrong rows in place of a day
    profile_store.write(frame(lambda r: day(r) == 5), root, 6, whole=True)
    same(profile_store.training_profile(spark, root), profiles.training_profile(whole))
    recent = profiles.recent_counts(whole, "2024-01-14 10:00:00")
    got = profile_store.serving_profile(spark, root, recent)
    want = profiles.serving_profile(whole, "2024-01-14 10:00:00")
    named = got.where("user_id IS NOT NULL")
    same(named, want.where("user_id IS NOT NULL").select(*named.columns))
    same(profile_store.newest(spark, root, 7).select("user_id", "transaction_id", "rank"),
         history.newest(whole, 7).select("user_id", "transaction_id", "rank"))


def test_days_whose_rows_are_gone(spark, tmp_path):
    root = str(tmp_path / "parts")
    whole = spark.createDataFrame(rows(300), SCHEMA)
    profile_store.write(whole, root, 1)
    profile_store.write(whole.limit(0), root, 2, whole=True, days=["2024-01-03", "2024-01-04"])
    same(profile_store.training_profile(spark, root), profiles.training_profile(whole.where("ts IS NULL OR day(ts) NOT IN (3, 4)")))


def test_merging_is_associative(spark):
    txn = spark.createDataFrame(rows(400, 3), SCHEMA)
    parts = partials.totals(txn)
    steps = partials.merged_totals(partials.merged_totals(parts, partials.DAY))
    same(steps.drop("newest"), partials.merged_totals(parts).drop("newest"))
    values = partials.value_parts(txn)
    same(partials.merged_values(partials.merged_values(values, partials.DAY)), partials.merged_values(values))


def test_a_refresh_reads_its_days_only(spark, tmp_path):
    stored, root = str(tmp_path / "history"), str(tmp_path / "parts")
    whole = spark.createDataFrame(rows(600, 4), SCHEMA).where("ts IS NOT NULL")
    tables.write_history(whole, stored)
    profile_store.refresh(spark, stored, root, 1, "2024-01-01", "2024-01-14")
    late = whole.where("day(ts) = 7").selectExpr(*["transaction_id + 10000 AS transaction_id" if c == "transaction_id" else c for c in whole.columns])
    tables.write_history(late, stored, mode="append")
    profile_store.refresh(spark, stored, root, 2, "2024-01-07", "2024-01-07")
    same(profile_store.training_profile(spark, root), profiles.training_profile(whole.unionByName(late)))
    new = profile_store.days_of(spark, stored, "2024-01-07", "2024-01-07")
    plan = partials.totals(new)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_date" in plan
    read = {r[0].split("txn_date=")[1].split("/")[0] for r in new.select("_metadata.file_path").distinct().collect()}
    assert read == {"2024-01-07"}
    of_day = profile_store.recent_counts(spark, stored, "2024-01-09 06:00:00")
    same(of_day, profiles.recent_counts(whole.unionByName(late), "2024-01-09 06:00:00"))
