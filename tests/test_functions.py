import pandas as pd
import pytest
from pyspark.sql import functions as F

from personyear.functions import labels, names, numbers, text
from personyear.functions.similarity import similarity
from personyear.operators.project import clean_names


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("r")).first().r


@pytest.mark.parametrize(
    "name, expected",
    [
        ("John Jones Jr", ("john", None, "jones", "jr")),
        ("John J.P. Jones Jr", ("john", "jp", "jones", "jr")),
        ("Jr John J P Jones", ("john", "j p", "jones", "jr")),
        ("Jones, John J P Jr", ("jones", "john j", "p", "jr")),
        ("Cher", ("cher", None, "cher", None)),
        (None, (None, None, None, None)),
    ],
)
def test_first_middle_last(spark, name, expected):
    assert tuple(one(spark, names.first_middle_last("v"), name)) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Jones, John J", ("john", "j", "jones", None)),
        ("Jones, John J. Jr", ("john", "j", "jones", "jr")),
        ("Jones Jr, John J P", ("john", "j p", "jones", "jr")),
        ("Jensen James II, John J Patrick, jr", ("john", "j patrick", "jensen james", "ii jr")),
        ("Jones John J Jr", (None, None, "jones john j", None)),
    ],
)
def test_last_comma_first_middle(spark, name, expected):
    assert tuple(one(spark, names.last_comma_first_middle("v"), name)) == expected


def test_other_name_formats(spark):
    assert tuple(one(spark, names.last_suffix_first("v"), "Smith, JR, Ann B")) == ("Ann", "B", "Smith", "JR")
    assert tuple(one(spark, names.last_suffix_first("v"), "Smith, Ann")) == ("Ann", None, "Smith", None)
    assert tuple(one(spark, names.last_first_suffix("v"), "SMITH,III,DIANA M")) == ("DIANA", "M", "SMITH", "III")
    assert tuple(one(spark, names.last_first_suffix("v"), "SMITH,ANN M,JR")) == ("ANN", "M", "SMITH", "JR")
    assert tuple(one(spark, names.last_first_other("v"), "Smith,,Ann Bea Cee, Sr")) == ("ann", "bea cee", "smith", "sr")
    given = spark.createDataFrame([("Ann Bea Cee Dee",)], "v string")
    first, middle = names.split_given("v", 1)
    assert tuple(given.select(first, middle).first()) == ("Ann", "Bea")


def test_numbers(spark):
    assert one(spark, numbers.parse_money("v"), "$1,234.50") == 1234.5
    assert one(spark, numbers.to_number("v"), "Not Provided") is None
    assert one(spark, numbers.to_number("v"), "12d") is None
    assert one(spark, numbers.half_even_bucket("v", 5000), 12500.0, "double") == 10000.0
    assert one(spark, numbers.half_even_bucket("v", 5000), 17500.0, "double") == 20000.0
    assert one(spark, numbers.half_even("v", 2), 69.195, "double") == 69.19
    assert one(spark, numbers.half_even("v", 1), 0.25, "double") == 0.2
    assert one(spark, numbers.scaled_text("v", 100.0), "0.5") == "50"
    assert one(spark, numbers.leading_file_year("v"), "2012-2013_salary.csv") == 2013
    assert one(spark, numbers.leading_file_year("v"), "2008_Teacher_Salary.csv") == 2008
    assert one(spark, numbers.fiscal_file_year("v"), "Staff FY07.csv") == 2008
    assert one(spark, numbers.school_year_label("v"), 2013, "int") == "2012_2013"


def test_text(spark):
    assert one(spark, text.pad_left("v", 6), "1234567") == "1234567"
    assert one(spark, text.pad_left("v", 6), "12") == "000012"
    assert one(spark, text.replace_first("v", "a", "$x"), "banana") == "b$xnana"
    assert one(spark, text.extract("v", r"(\d+)", 1), "none") is None
    assert one(spark, text.part("v", ",", 3), "a,b") is None
    assert one(spark, text.prefix_to_suffix("v", "CITY OF", "CITY"), "CITY OF ROME") == "ROME CITY"
    assert one(spark, text.repair_bytes("v"), "MUÑOZ") == "MUNOZ"
    assert clean_names(["Last Name.", "Last Name", "A-B"]) == ["last_name", "last_name.1", "ab"]


def test_labels(spark):
    flag = labels.keyword_flag("v", ["teach", "tchr"], ["sub", "aide"])
    assert one(spark, flag, "substitute teacher") is False
    assert one(spark, flag, "math teacher") is True
    assert one(spark, flag, None) is None
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert rows.where(labels.not_member("v", ["a"])).count() == 2
    assert one(spark, F.coalesce(labels.member("v", ["a"]), F.lit(True)), None) is False


def test_similarity_known_values():
    left = pd.Series(["martha", "dixon", "dwayne", "abc", "a", ""])
    right = pd.Series(["marhta", "dicksonx", "duane", "xyz", "a", "a"])
    found = similarity(left, right).round(4).tolist()
    assert found == [0.9611, 0.8133, 0.84, 0.0, 1.0, 0.0]
