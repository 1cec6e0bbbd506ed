"""Every registered query of the subpackage over whole tables: against its SQL, or a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import __spark_entry__ as entry
import check
from riskflow.llm import decontam, langid
from riskflow.llm.oracle import ORACLE
from riskflow.llm.queries import QUERIES
from tests.llm import test_chat, test_packing, test_simhash, test_sketches, test_token_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert check.compare(spark, check.connect(FOLDER), name, FOLDER) is None


def test_op3(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = test_chat.expected(table)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(spark, "op3_chat")}
    assert got == want and got[-1][2] == 21


def test_op4(spark, docs):
    scores = {}

    def walk(node, word):
        for b, child in node.items():
            if b == -1:
                scores[bytes(word)] = child
            else:
                walk(child, word + [b])
    walk(test_token_counts.tc.vocabulary(test_token_counts.PATH), [])
    words = {i: regex.findall(public_tokenizers.PATTERN, t or "") for i, t in docs}
    known = {w: test_token_counts.brute(scores, w) for ws in words.values() for w in ws[:400]}
    for ws in words.values():
        for w in ws[400:]:
            if w not in known:
                known[w] = test_token_counts.brute(scores, w)
    assert {tuple(r) for r in rows(spark, "op4_token_counts")} == {(i, len(ws), sum(known[w] for w in ws)) for i, ws in words.items()}


def test_op5(spark, docs):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((tuple(r[n] for n in names) for r in rows(spark, "op5_fingerprints")), key=repr)
    assert got == test_sketches.brute(docs)
    text = dict(docs)
    order = sorted(text, reverse=True)
    errors = []
    for g in got:
        a, b = test_sketches.shingles(text[g[0]]), test_sketches.shingles(text[order[(order.index(g[0]) + 1) % len(order)]])
        errors.append(abs(g[6] - len(a & b) / max(1, len(a | b))))
    assert max(errors) < 0.2 and np.mean(errors) < 0.02


def test_op6(spark, docs):
    got = rows(spark, "op6_sharding")
    loads = Counter(r["shard"] for r in got)
    assert len(got) == len(docs) and max(loads.values()) - min(loads.values()) <= 1 and set(loads) <= set(range(40))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = {i: len((t or "").encode()) + 16 for i, t in docs}
    assert all(r["size"] == size[r["doc_id"]] and r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_op7(spark, docs):
    assert sorted(map(tuple, rows(spark, "op7_simhash")), key=repr) == test_simhash.brute_ids(docs)


def test_op8(spark, docs):
    t = Tokenizer.from_file(test_packing.PATH)
    sequences, tokens = test_packing.check(docs, rows(spark, "op8_packing"), lambda x: t.encode(x, add_special_tokens=False).ids)
    assert sequences <= 1.01 * -(-tokens // 2048) + 1


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op9_langid")}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert set(got) == set(truth)
    unseen = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in unseen]) >= 0.97
    assert all((got[i]["lang_pred"] == langid.UNKNOWN) == (not any(c.isalpha() for c in t or "")) for i, t in docs)


def contaminated(docs, items):
    """Documents with a stretch within the edit budget of an item: one alignment over all texts in a row."""
    gap = np.full(60, 0xF0000, np.uint32)
    codes = [decontam.plain(t or "") for _, t in docs]
    long = np.concatenate([x for c in codes for x in (c, gap)])
    of = np.concatenate([np.full(len(c) + 60, i) for c, (i, _) in zip(codes, docs)])
    found, at = set(), np.arange(len(long) + 1)
    for item, text in items:
        row, a = np.zeros(len(long) + 1, np.int32), decontam.plain(text)
        for c in a:
            new = np.empty_like(row)
            new[0] = row[0] + 1
            new[1:] = np.minimum(row[:-1] + (long != c), row[1:] + 1)
            row = (np.minimum.accumulate(new - at) + at).astype(np.int32)
        found |= {(int(of[min(e, len(of)) - 1]), item) for e in np.flatnonzero(row <= decontam.budget(len(a)))}
    return found


def test_op10(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op10_decontam")}
    assert got == contaminated(docs, items) and got
