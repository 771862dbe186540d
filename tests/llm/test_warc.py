import base64
import hashlib

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import queries, warc  # noqa: E402

SCHEMA = "page_id long, url string, html string, digest string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for k, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    out = []
    for k, html in rows:
        again = k is not None and first[html or ""] < k
        out.append((k, len((html or "").encode()), digest(html), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    forged = f"x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    rows = [(5, "a"), (3, "a"), (9, None), (8, ""), (7, forged), (2, forged), (1, "é🙂\n"), (None, "a"), (4, "a"), (6, "x" * 100_000), (3, "a")]
    df = spark.createDataFrame([(k, None if k == 5 else "http://x/%0A\r\ny", h, "z") for k, h in rows], SCHEMA)
    path = warc.write(df)
    got = warc.read(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert {r.payload for r in got if r.record_type == "response"} == {h or "" for _, h in rows}
    assert {r.url for r in got} == {None, "http://x/%0A\r\ny"} and all(r.payload is None for r in got if r.record_type == "revisit")


def test_empty_table(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], SCHEMA))).collect() == []


def test_broken_archives_are_told():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [r["payload"] for r in warc.parse(good * 2)] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(warc.parse(good.replace(b": 2", b": 1")))


def test_query_equals_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = queries.QUERIES["op5_warc"](spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(pages)
