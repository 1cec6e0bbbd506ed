import zlib
from collections import Counter, defaultdict

import pytest

from riskflow.llm import sharding

SCHEMA = "doc_id long, text string, shard int, size long, arc int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def placed(spark, rows, **more):
    return sharding.shard(frame(spark, rows).repartition(4), **more).collect()


def test_rows_law(spark):
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(1003)]
    got = placed(spark, rows)
    loads = Counter(r["shard"] for r in got)
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {i: (t or "").encode() for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(b) + 16, zlib.crc32(b)) for i, b in by_id.items()}
    again = placed(spark, rows[::-1])
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_plan_against_a_walk_key_by_key():
    """Keys one by one, round by round: every waiting key asks the next open point clockwise."""
    points, owners = sharding.ring(5, 8)
    counts = [3 if i % 4 else 20 for i in range(len(points))]
    capacity = sharding.capacities(sum(counts), 5)
    room, place = list(capacity), {}
    waiting = [(arc, arc, k) for arc, n in enumerate(counts) for k in range(n)]
    while waiting:
        later = []
        for point, arc, k in sorted(waiting):
            if room[owners[point]]:
                room[owners[point]] -= 1
                place[arc, k] = owners[point]
            else:
                later.append((point, arc, k))
        waiting = []
        for point, arc, k in later:
            at = point
            while True:
                at = (at + 1) % len(owners)
                if room[owners[at]]:
                    break
            waiting.append((at, arc, k))
    got = {}
    for arc, first, n, s, _ in sharding.runs(counts, owners, capacity):
        got |= {(arc, k): s for k in range(first, first + n)}
    assert got == place


def test_slack_bounds_loads_and_keeps_keys_in_place(spark):
    rows = [(i, "t") for i in range(4000)]
    moves = {}
    for slack in (0.0, 0.2):
        a = {r["doc_id"]: r["shard"] for r in placed(spark, rows, shards=20, slack=slack)}
        b = {r["doc_id"]: r["shard"] for r in placed(spark, rows, shards=21, slack=slack)}
        assert max(Counter(a.values()).values()) <= 4000 * (1 + slack) / 20 + 1
        moves[slack] = sum(a[i] != b[i] for i in a) / len(a)
    # a modulo would move 95 %; the least that any balanced scheme can move is 5 %
    assert moves[0.2] < 0.15 and moves[0.0] < 0.5, moves


def test_most_keys_stay_with_their_own_shard(spark):
    got = placed(spark, [(i, "t") for i in range(5000)], slack=0.25)
    assert sum(r["moved"] for r in got) < 0.1 * len(got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "x"), (None, None), (None, "x")], [(7, "same")] * 90, [(i, "") for i in range(39)]])
def test_few_and_repeated_rows(spark, rows):
    got = placed(spark, rows)
    loads = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and (not rows or max(loads.values()) - (min(loads.values()) if len(loads) == 40 else 0) <= 1)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)


def test_capacity_must_suffice():
    with pytest.raises(ValueError):
        sharding.runs([5], [0], [4])
