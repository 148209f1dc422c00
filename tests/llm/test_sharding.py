"""Shards against a plain loop, and their laws."""

import zlib

from terraloom.llm import sharding


def test_contiguous_shards(docs, no_docs):
    got = sharding.sharded(docs, 4).collect()
    rows = {(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()}
    assert {(r.size, r.text_crc32) for r in got} == {(len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in rows}
    total, at, slots, last = sum(r.size for r in got), 0, {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.shard == (2 * at + r.size) * 4 // (2 * total) and r.shard >= last
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard], last, at = r.slot + 1, r.shard, at + r.size
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sharding.sharded(no_docs, 4).count() == 0


def test_equal_ids_keep_all_rows(spark):
    frame = spark.createDataFrame([(1, "same")] * 200 + [(2, "x")], "doc_id long, text string").repartition(5)
    got = sharding.sharded(frame, 8).collect()
    assert len(got) == 201 and len({(r.shard, r.slot) for r in got}) == 201
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 10


def test_shards_are_written_and_read(spark, docs, tmp_path):
    unique = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null").drop("shard")
    path = str(tmp_path / "shards")
    sharding.write_shards(unique, sharding.sharded(unique, 4), path)
    back = [r for s in range(4) for r in sharding.shard_documents(spark, path, s).collect()]
    assert sorted((r.doc_id, r.text or "") for r in back) == sorted((r.doc_id, r.text or "") for r in unique.collect())
