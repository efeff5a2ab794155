import hashlib

import pytest
from pyspark.sql import functions as F

from strataline.llm import common as C
from strataline.llm import warc as W

PAGES = "page_id long, url string, html string"


def rows():
    big = "<p>" + "x" * 200 + "</p>"
    out = [(i, f"http://a/{i}", f"<html>{i} é</html>" * (i % 9 + 1)) for i in range(40)]
    out += [(i, f"http://hot/{i}", big) for i in range(100, 140)]  # a large group of equal payloads
    out += [(50, None, None), (51, "http://a/%0A\r\nX: y", ""), (52, "http://a", "short"), (53, "http://a", "short"), (None, "http://n", big), (None, None, None), (54, "http://long", "é" * 300000)]
    return out + [(100, "http://hot/100", big), (39, "http://a/39", out[39][2])]


def brute(pages):
    first, used, out = {}, set(), []
    for i, _, html in sorted(pages, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (html or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        if i is not None and len(raw) >= 100:
            first.setdefault(d, i)
        n = sum(1 for a, _, b in pages if a is not None and (b or "") == (html or ""))
        many = d in first and n > 1 and i is not None
        response = not many or (first[d] == i and (i, d) not in used)
        used.add((i, d))
        out.append((i, len(raw), d, "response" if response else "revisit", None if response else first[d]))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [64 << 20, 2000])
def test_round_trip(spark, roll):
    pages = spark.createDataFrame(rows(), PAGES)
    root = C.scratch(spark, "test-warc")
    manifest = W.write(pages.selectExpr("*", "'clash' payload_digest", "'clash' part", "1 uid"), root, roll_bytes=roll)
    assert manifest.count() > (10 if roll == 2000 else 0)
    got = W.read(spark, root).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows())
    assert sorted(((r.page_id, r.url) for r in got), key=str) == sorted(((i, u or "") for i, u, _ in rows()), key=str)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    again = C.scratch(spark, "test-warc")
    assert sorted(map(tuple, W.write(pages.orderBy("html"), again, roll_bytes=roll).collect())) == sorted(map(tuple, manifest.collect()))
    for path in (root, again):
        C.remove(spark, path)


def test_shards_do_not_follow_the_session(spark):
    """100,000 pages, ids dense here and sparse there: equal files at any number of partitions."""
    ids = F.when(F.col("id") < 60000, F.col("id")).when(F.col("id") < 99990, F.col("id") * 1000).otherwise(F.shiftleft("id", 40))
    pages = spark.range(100_000).select(ids.alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.when(F.col("id") % 9 > 0, F.repeat(F.sha2(F.col("id").cast("string"), 256), 2)).otherwise("x" * 150).alias("html"))
    pages = pages.unionByName(spark.range(3000).selectExpr("cast(null as bigint) page_id", "'u' url", "concat('n', id) html"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n, source in (("4", pages), ("7", pages.repartition(3).orderBy("html"))):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        root = C.scratch(spark, "test-warc")
        manifest = W.write(source, root, shard_bytes=1 << 20, roll_bytes=100_000)
        found.append(sorted(map(tuple, manifest.collect())))
        assert W.read(spark, root).count() == 103_000
        C.remove(spark, root)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    shards = {f[0].split("-")[1] for f in found[0]}
    assert found[0] == found[1] and 40 < len(shards) < 140 and len(found[0]) > len(shards)


def test_shards_keep_to_their_target(spark):
    rows = [(i, 100) for i in range(1000)] + [(5, 5000), (1 << 62, 100), (-(1 << 62), 100)]
    starts = W.shard_starts(spark.createDataFrame(rows, "page_id long, n long"), 1000)
    total = {}
    for i, n in rows:
        k = sum(s <= i for s in starts)
        total.setdefault(k, []).append((i, n))
    assert min(total) == 1 and all(sum(n for _, n in x) <= 1000 or len({i for i, _ in x}) == 1 for x in total.values())
    assert len(starts) < 250
    placed = W.with_shard(spark.createDataFrame([(i, "ab") for i, _ in rows], "page_id long, payload_digest string"), starts, None)
    assert all(r.shard == sum(s <= r.page_id for s in starts) - 1 for r in placed.collect())


def test_empty(spark):
    root = C.scratch(spark, "test-warc")
    assert W.write(spark.createDataFrame([], PAGES), root).count() == 0
    assert W.read(spark, root).count() == 0
    C.remove(spark, root)


def test_damage_is_found():
    good = W.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert W.parse(good)["body"] == b"payload"
    with pytest.raises(ValueError, match="block"):
        W.parse(good.replace(b"payload\r\n", b"paylOad\r\n"))
