"""Changes of tables with their guards on small tables."""

import datetime

from cartulary.operators import relational as R
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_update_delete(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, owner string, text string")
    new = spark.createDataFrame([("n", 2, "b"), ("m", 3, "a"), ("l", 3, "a")], "text string, id int, owner string")
    whole = R.insert_or_ignore(t, new, "id")
    assert rows(whole) == [(1, "a", "x"), (2, "b", "y"), (3, "a", "l")]
    changes = spark.createDataFrame([(1, "a", "X"), (2, "a", "Y"), (9, "a", "Z")], "id int, owner string, text string")
    assert rows(R.owned_update(whole, changes, "id", "owner", "text")) == [(1, "a", "X"), (2, "b", "y"), (3, "a", "l")]
    assert rows(R.without_children(whole, spark.createDataFrame([("a",), ("a",), ("q",)], "owner string"), "owner")) == [(2, "b", "y")]
    assert R.insert_or_ignore(t.limit(0), new.limit(0), "id").count() == 0


def test_refresh_and_reconcile(spark):
    index = spark.createDataFrame([(1, "s", "Un  título"), (2, "s", "Otro"), (3, "s", "Tres"), (4, "s", None)], "i int, section string, title string")
    meta = spark.createDataFrame([(1, "n", " Un título "), (2, "", "Otro distinto"), (4, "n", "Cuatro"), (5, "n", "x")], "i int, section string, title string")
    assert rows(R.refreshed(index, meta, "i", "title", ["section"])) == [(1, "n", "Un  título", False), (2, "s", "Otro", True), (3, "s", "Tres", False), (4, "n", None, True)]
    old, new = datetime.date(2024, 5, 1), datetime.date(2025, 1, 1)
    c = spark.createDataFrame([(1, old), (2, None), (3, None)], "i int, day date")
    assert rows(R.reconciled(c, {"day": spark.createDataFrame([(1,), (2,), (2,)], "i int")}, "i", F.lit(new))) == [(1, old), (2, new), (3, None)]
