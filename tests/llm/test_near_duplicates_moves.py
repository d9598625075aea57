import os

from pyspark.sql import functions as F

from personyear import session
from personyear.llm import near_duplicates
from tests.llm.conftest import SCHEMA


def test_every_given_id_is_marked_and_few_others(spark):
    ids = [*range(-30, 3000, 7), 2**62, -(2**63)]
    docs = spark.createDataFrame([(i,) for i in [*range(-50, 20_000), 2**62, -(2**63), None]], "id long")
    marked = near_duplicates._marked(docs, spark.createDataFrame([(i,) for i in ids], "id long")).where("marked")
    found = {r.id for r in marked.collect()}
    assert found >= set(ids) and len(found) < len(ids) + 50
    assert near_duplicates._marked(docs, docs.limit(0)).where("marked").count() == 0


def test_components_are_those_of_a_plain_join(spark):
    """Copies, links, ids of two texts and texts without words."""
    rows = [(1, "a b"), (2, "a b"), (3, "c"), (4, "d"), (4, "e"), (5, "c"), (5, "f"), (6, None), (6, "g"), (7, ""), (None, "a b"), (8, "h")]
    docs = spark.createDataFrame(rows, "id long, text string")
    pointed = spark.createDataFrame(
        [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 3), (5, 5), (6, None), (6, 6), (7, None), (None, 1), (8, 8)], "id long, point long"
    )
    points = pointed.where("point is not null").select(F.col("point").alias("id"))
    met = spark.createDataFrame([(3, 3), (5, 3), (8, 4), (4, 4)], "node long, component long")
    plain = points.distinct().join(met.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    expected = docs.join(plain, "id").select("id", "component", "text").where("text <> ''")
    found = near_duplicates._with_components(docs, points, pointed, met).where("text <> ''")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_the_shuffle_holds_no_text_without_a_pair(spark, tmp_path):
    """One pair and many other texts: what is joined with the pair is filtered where it is read."""
    rows = [(i, f"text {i} " + "x" * 200, None, None, None) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), "text")
    pairs = spark.createDataFrame([(3, 5)], "a long, b long")
    plan = near_duplicates._texts_of(pairs, docs)._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("getbit")
    assert after and "SortMergeJoin" in before
    assert sorted(r.id for r in near_duplicates._texts_of(pairs, docs).collect()) == [3, 5]


def test_tables_in_between_are_deleted(spark, documents):
    def tables():
        return {x for x in os.listdir(session.shared_folder(spark).removeprefix("file:")) if x.startswith(("signatures", "points", "pairs", "texts", "early"))}

    before = tables()
    found = near_duplicates.near_duplicates(documents)
    assert tables() == before
    assert found.count() == documents.count()
