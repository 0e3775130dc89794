from pyspark.sql import functions as F

from corpusgraph.operators.graph import link_components
from corpusgraph.storage import discard, stash


def test_discard(spark):
    import os

    a = stash(spark.range(5).toDF("x"), "kept")
    b = stash(a.select((F.col("x") + 1).alias("y")), "made")
    path = a._stashed
    assert os.path.isdir(path.removeprefix("file:"))
    discard(a, b.filter("y > 1"))
    assert not os.path.exists(path.removeprefix("file:"))
    assert b.count() == 5
    discard(a)
    assert b.agg(F.sum("y")).first()[0] == 15


def test_a_class_of_many_nodes(spark):
    """One class of 100 000 nodes, as a hub and as a chain of hubs."""
    n = 100_000
    links = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") % 100).alias("b"))
    links = links.unionByName(spark.range(1, 100).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))
    found = link_components(links).agg(F.count("*").alias("n"), F.max("label").alias("m")).first()
    assert (found.n, found.m) == (n, 0)
