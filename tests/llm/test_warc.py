import hashlib

from riskflow.llm import warc
from riskflow.session import fresh_dir

SCHEMA = "page_id long, url string, html string, digest string, id long, bytes long"


def archived(spark, rows):
    folder = fresh_dir(spark, "t")
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    warc.write_archive(df, folder)
    return warc.read_records(spark, folder).collect()


def test_records_round_trip(spark):
    long, short = "é" * 60, "short"
    rows = [(5, "http://a/x", long), (3, "http://b/\r\nEvil: 1", long), (9, None, long), (1, "u", short), (2, "u", short),
            (7, "u", None), (8, "u", ""), (None, "u", long), (4, "u", "z" * 100_000), (3, "again", long),
            (11, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    got = archived(spark, rows)
    assert len(got) == len(rows)
    assert sorted(repr(r["page_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
    html = {(p, h or "") for p, _, h in rows}
    for r in got:
        body = bytes(r["payload"])
        assert (r["page_id"], body.decode()) in html
        assert r["payload_digest"] == hashlib.sha256(body).hexdigest() and r["payload_bytes"] == len(body) and r["verified"]
        if body.decode() == long and r["page_id"] != 3:
            assert (r["record_type"], r["refers_to"]) == ("revisit", 3)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and b"Evil" not in fields
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        http, _, sent = rest[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert sent == (body if r["record_type"] == "response" else b"")


def test_payload_bytes_are_stored_once(spark):
    folder = fresh_dir(spark, "t")
    df = spark.createDataFrame([(i, "u", "same " * 50, "", 0, 0) for i in range(500)], SCHEMA).repartition(7)
    warc.write_archive(df, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 1
    assert spark.read.parquet(f"{folder}/headers").count() == 500


def test_damaged_payload_is_seen(spark):
    folder, other = fresh_dir(spark, "t"), fresh_dir(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "good " * 50, "", 0, 0)], SCHEMA), folder)
    bad = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "first_id", "CAST('bad' AS BINARY) payload")
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    row = warc.read_records(spark, other).first()
    assert not row["verified"] and row["payload_digest"] == hashlib.sha256(b"bad").hexdigest()


def test_empty_table(spark):
    assert archived(spark, []) == []


def test_ids_that_are_all_null(spark):
    got = archived(spark, [(None, "u", "y" * 200), (None, "v", "y" * 200)])
    assert [(r["record_type"], r["refers_to"]) for r in got] == [("response", None)] * 2
