import random
import zlib

from brute import jump

from docproof.llm.sharding import shards


def test_places_equal_the_published_hash(spark):
    rng = random.Random(3)
    ids = [*range(40), *[rng.randrange(-(2**63), 2**63) for _ in range(200)], None, 5, 5]
    docs = spark.createDataFrame([(i, None if k % 7 == 0 else f"té{k}", "x") for k, i in enumerate(ids)], "doc_id long, text string, shard string")
    rows = shards(docs, 24, parts=5).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 24) and r.grown_shard == jump(r.doc_id or 0, 25) and r.law == "key"
        assert r.grown_shard in (r.shard, 24)
    texts = sorted((None if k % 7 == 0 else f"té{k}") or "" for k in range(len(ids)))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts)
    for shard in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in own]
        assert keys == sorted(keys)


def test_one_key_and_empty_table(spark):
    docs = spark.createDataFrame([(9, "same")] * 500, "doc_id long, text string")
    rows = shards(docs, 24, parts=8).collect()
    assert sorted(r.slot for r in rows) == list(range(500)) and {r.shard for r in rows} == {jump(9, 24)}
    assert shards(docs.limit(0), 24).count() == 0
