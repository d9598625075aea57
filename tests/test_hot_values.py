"""Values shared by many records, where they meet their similar values."""

import hashlib
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from personyear.operators import fuzzy

SCHEMA = "state string, name_first string, name_last string, index long"
FIELDS = [fuzzy.Field("name_first"), fuzzy.Field("name_last")]


def word(text, letters):
    """Letters that follow from the text, unlike those of other texts."""
    return "".join(chr(97 + x % 26) for x in hashlib.sha256(text.encode()).digest()[:letters])


def people(spark, first, count):
    """A fifth of the records have one first name, another fifth none."""
    rows = []
    for i in range(first, first + count):
        name = {0: "margaret", 1: None}.get(i % 5, word(f"f{i % 997}", 8))
        rows.append(("S", name, word(f"l{i % 331}", 9), i))
    rows.append(("S", "margarets", word("l1", 9), first + count))
    return spark.createDataFrame(rows, SCHEMA)


def test_a_hot_value_is_dealt_and_its_counts_stay(spark, monkeypatch):
    one, two = people(spark, 0, 2000), people(spark, 5000, 2000)
    plain = fuzzy.field_agreements(one.unionByName(two), FIELDS)
    assert plain.cells == {}
    monkeypatch.setattr(fuzzy, "CELL_ROWS", 16)
    dealt = fuzzy.field_agreements(one.unionByName(two), FIELDS)
    cells = {row.v: row.cells for row in dealt.cells["name_first"].collect()}
    assert cells["margaret"] == 50 and None not in cells and "margarets" not in cells
    totals = [
        Counter(map(tuple, fuzzy.PairCounts(one, two, FIELDS, found, ["state"]).totals().collect())) for found in (plain, dealt)
    ]
    assert totals[0] == totals[1] and len(totals[0]) > 4


def test_no_task_has_ten_times_the_median(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "CELL_ROWS", 16)
    records = people(spark, 0, 4000)
    found = fuzzy.field_agreements(records, FIELDS)
    similar = found["name_first"].toDF("name_first", "other", "level")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "20", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sizes, rows = [], []
        for cells in (None, found.cells["name_first"]):
            met = fuzzy.meet_similar(records, similar, "name_first", cells)
            sizes.append([r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()])
            rows.append(Counter(map(tuple, met.select("name_first", "index", "other", "level").collect())))
        assert rows[0] == rows[1]
        assert max(sizes[0]) > 5 * median(sizes[0])
        assert max(sizes[1]) < 3 * median(sizes[1])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
