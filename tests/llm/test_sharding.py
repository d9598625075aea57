import zlib

from personyear.llm import sharding
from personyear.session import new_folder


def _written(spark, docs, **options):
    path = new_folder(spark, "shards")
    schema = sharding.write_shards(docs, path, **options)
    return sharding.read_shards(spark, path, schema)


def _slots(rows):
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_every_row_is_in_one_slot(spark, documents):
    rows = _written(spark, documents, shards=5, bucket_bytes=10_000).collect()
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows) == sorted(map(tuple, documents.collect()))
    assert _slots(rows) and {r.shard for r in rows} == set(range(5))
    assert max(r.bucket for r in rows) > 3


def test_the_law(spark, documents):
    rows = _written(spark, documents, shards=40).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and any(r.grown_shard == 40 for r in rows)
    more = {r.doc_id: r.shard for r in _written(spark, documents.limit(50), shards=41).collect()}
    grown = {r.doc_id: r.grown_shard for r in rows}
    assert all(grown[k] == s for k, s in more.items())


def test_shuffled_the_same_way_each_time_and_by_seed(spark, documents):
    def order(seed, tasks):
        rows = _written(spark, documents.repartition(tasks), shards=2, seed=seed).collect()
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]

    first = order(7, 1)
    assert first == order(7, 6) and first != order(8, 1) and first != sorted(first)


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumnRenamed("lang", "shard").withColumnRenamed("source", "place")
    rows = _written(spark, docs, shards=3).collect()
    assert len(rows) == odd.count() and _slots(rows)
    assert _written(spark, empty).collect() == []
    sizes = odd.select("text", sharding.record_bytes("text").alias("size")).collect()
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in sizes)


def test_no_python_in_the_plan(spark, documents):
    path = new_folder(spark, "shards")
    schema = sharding.write_shards(documents, path)
    plan = sharding.read_shards(spark, path, schema)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_checksums_of_the_query(spark):
    from personyear.llm.queries import op8_sharding

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op8_sharding(spark, folder).collect():
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
