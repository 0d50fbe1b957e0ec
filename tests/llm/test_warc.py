import gzip
import hashlib
from datetime import UTC, datetime

import duckdb
import pandas as pd

from millrace.llm import warc

BIG = "<p>" + "é" * 600
ROWS = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (None, "http://a/n", BIG), (7, "u", "short"), (8, "u", "short"),
    (9, "u", None), (10, "u", ""), (11, "u\r\nWARC/1.1", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (12, "u", "x" * 999), (13, "u", "x" * 999),
    (14, "u", "x" * 1000), (15, "u", "x" * 1000), (15, "u", "x" * 1000), (16, "u", "\n" * 2000), (17, "u", "y" * 300_000),
]
SCHEMA = "page_id long, url string, html string, HTML string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    warc.write_archives(frame(spark, ROWS), str(tmp_path / "w"), per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(ROWS)
    payload = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    texts = {i: h or "" for i, _, h in ROWS}
    for r in got:  # every payload comes back, a revisit's from the record that it refers to
        assert payload[r.payload_digest] == texts[r.page_id].encode() and r.payload_bytes == len(texts[r.page_id].encode())
        assert r.payload_digest == hashlib.sha1(texts[r.page_id].encode()).hexdigest()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    revisits = [(i, k, o) for i, k, o in kinds if k == "revisit"]
    assert revisits == [(0, "revisit", 5), (1, "revisit", 5), (3, "revisit", 5), (14, "revisit", 15)]
    ids = {r.page_id: r.record_id for r in got}
    assert all(r.refers_to_id == ids[r.refers_to] and not r.payload for r in got if r.record_type == "revisit")


def test_empty_table(spark, tmp_path):
    warc.write_archives(frame(spark, []), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).collect() == []


def test_query_equals_sql(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    pd.DataFrame([(100 + i, u, h) for i, (_, u, h) in enumerate(ROWS)], columns=["page_id", "url", "html"]).to_parquet(tmp_path / "sf/pages.parquet")
    got = {tuple(r) for r in warc.query(spark, str(tmp_path / "sf")).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/sf/pages.parquet'")
    assert got == set(con.sql(warc.SQL).fetchall())


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", chr(97 + i % 26) * n) for i, n in enumerate([10] * 30 + [3000] * 20 + [20_000] * 5 + [90_000] * 2)]
    when = datetime(2031, 5, 4, 3, 2, 1, tzinfo=UTC)
    warc.write_archives(frame(spark, rows).coalesce(1), str(tmp_path / "w"), per_file=12, file_bytes=40_000, when=when)
    held = [list(warc.parsed(gzip.decompress(f.read_bytes()))) for f in (tmp_path / "w").rglob("*.txt.gz")]
    assert sum(map(len, held)) == len(rows) and max(map(len, held)) <= 12
    assert all(len(own) == 1 or sum(len(body) for _, body in own) <= 40_000 for own in held)
    assert {head["warc-date"] for own in held for head, _ in own} == {"2031-05-04T03:02:01Z"}
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=False).collect()
    assert len(got) == len(rows) and {r.payload for r in got} == {None}
