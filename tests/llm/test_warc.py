import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.warc import END, VERSION, cuts, op10_warc, read_archives, read_chunks, write_archives

MARK = (END + VERSION).decode()


def expected(rows):
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(k, top.get(h or "", k))
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        again = k is not None and len(b) >= 1000 and top[h or ""] > k
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cuts():
    rng = random.Random(2)
    for _ in range(300):
        block = b"".join(rng.choice([b"x", b"\r\n", END, VERSION, END + VERSION, b"WARC"]) for _ in range(rng.randint(0, 60)))
        body, size, before = memoryview(block), rng.randint(15, 40), rng.choice([0, 9])
        spans = list(cuts(body, size, before))
        parts = [block[a:b] for a, b in spans]
        assert b"".join(parts) == block and (all(parts) or not block)
        assert all(len(p) <= size - before * (i == 0) for i, p in enumerate(parts))
        assert not any(END + VERSION in END + p for p in parts)


def test_round_trip(spark, tmpdir_path):
    long = "é→" * 40_000
    pages = [(1, "http://a/1", "x" * 999), (2, None, "x" * 999), (3, "u\r\nWARC-Type: x é", "y" * 1000), (4, "u", "y" * 1000),
             (9, "u", "y" * 1000), (9, "u", "y" * 1000), (None, "u", "y" * 1000), (5, "u", None), (6, "u", ""), (7, "u", long),
             (8, "u", long), (10, "u", MARK), (11, "u", "a" + MARK * 50 + END.decode()), (12, "u", VERSION.decode() * 3),
             (13, "u", "\r\n\r\n"), (14, "u", "\n\r\n"), (14, "u", "other"), (15, "u", "�\x00")]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, key int, _key int").repartition(3)
    for segment in (200, 5000, 1 << 20):
        path = f"{tmpdir_path}/w{segment}"
        write_archives(df, path, segment=segment)
        assert got(read_archives(spark, path)) == expected(pages)
    assert max(len(r.data) for r in read_chunks(spark, f"{tmpdir_path}/w5000").collect()) <= 5000


def test_running_digests(spark, tmpdir_path):
    """Every chunk carries the digest of the payload so far; one that is
    changed is found where it is."""
    body = "".join(str(i % 7) for i in range(9000))
    path = f"{tmpdir_path}/w"
    write_archives(spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string"), path, segment=1000)
    at = 0
    for r in read_chunks(spark, path).orderBy("chunk").collect():
        at += len(r.data)
        assert r.so_far == hashlib.sha1(body[:at].encode()).hexdigest() and r.data == body[at - len(r.data):at].encode()
    assert at == 9000
    lines = spark.read.text(path, lineSep=MARK).select(F.regexp_replace("value", "X-Digest-So-Far: sha1:.", "X-Digest-So-Far: sha1:x").alias("value"))
    lines.write.text(f"{path}2", lineSep=MARK)
    with pytest.raises(Exception, match="doesn't agree with the digest so far"):
        read_archives(spark, f"{path}2").collect()


def test_hot_payload_and_split_files(spark, tmpdir_path):
    rng = random.Random(4)
    pages = [(i, "u", "z" * 2000 if i % 3 == 0 else f"{rng.random()} " * rng.randint(0, 90)) for i in range(900)]
    write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), f"{tmpdir_path}/w", segment=700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        assert got(read_archives(spark, f"{tmpdir_path}/w")) == expected(pages)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty(spark, tmpdir_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmpdir_path}/w")
    assert read_archives(spark, f"{tmpdir_path}/w").count() == 0


def test_query_makes_chunks(spark, monkeypatch):
    found = []
    monkeypatch.setattr(warc, "read_archives", lambda s, path: found.append(read_chunks(s, path).count()) or read_archives(s, path))
    op10_warc(spark, "/root/testdata/sf0.1").count()
    assert found[0] > 20


def test_query_on_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op10_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected(rows)
