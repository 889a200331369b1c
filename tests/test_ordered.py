"""Sliced groups give exactly what plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import ordered as O
from threadlens.operators.skew import join_dimension


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [
        (None if rnd.random() < 0.05 else rnd.choice("aaaaab"), rnd.randrange(40), i, rnd.choice([None, 1, 2, 5]))
        for i in range(400)
    ]
    return spark.createDataFrame(data, "k string, t int, i int, v int").cache()


def both(rows, fn, cols):
    out = []
    for limit in (10_000, 25):
        o = O.slice_groups(rows, ["k"], ["t", "i"], limit)
        assert o.sliced == (limit == 25)
        out.append(sorted(map(repr, fn(o).result().select("i", *cols).collect())))
    return out


@pytest.mark.parametrize("fn, cols", [
    (lambda o: O.running_sum(o, F.coalesce("v", F.lit(0)), "s"), ["s"]),
    (lambda o: O.row_numbers(o, "n"), ["n"]),
    (lambda o: O.previous_row(o, ["t", "i"], "p"), ["p"]),
    (lambda o: O.next_row(o, ["t", "i"], "p"), ["p"]),
    (lambda o: O.last_known(o, F.col("v"), "x"), ["x"]),
    (lambda o: O.last_known(o, F.col("v"), "x", strict=True), ["x"]),
    (lambda o: O.next_known(o, F.col("v"), "x", strict=True), ["x"]),
    (lambda o: O.last_known(o, F.when(F.col("v") == 5, F.struct("t", "i")), "x", strict=True), ["x"]),
])
def test_sliced_equals_plain(rows, fn, cols):
    plain, sliced = both(rows, fn, cols)
    assert plain == sliced


def test_one_tie_block_is_split_too(spark):
    """All rows share key and time; only the last order column differs."""
    df = spark.range(300).select(F.lit("hot").alias("k"), F.lit(1).alias("t"), F.col("id").alias("i"))
    o = O.row_numbers(O.slice_groups(df, ["k"], ["t", "i"], 50), "n")
    assert o.df.groupBy(O.SLICE).count().agg(F.max("count")).first()[0] <= 150
    assert o.result().where("n <> i + 1").count() == 0


def test_global_order(rows):
    o = O.slice_groups(rows, [], ["t", "i"], 30)
    got = O.row_numbers(o, "n").result().orderBy("t", "i").select("n").collect()
    assert [r["n"] for r in got] == list(range(1, 401))


def test_salted_join(spark):
    facts = spark.range(500).select(F.when(F.col("id") < 400, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = facts.unionByName(spark.range(3).select(F.lit(None).cast("string").alias("k"), (F.col("id") + 1000).alias("id")))
    dim = spark.createDataFrame([("hot", 1), ("450", 2)], "k string, v int")
    plain = join_dimension(facts, dim, ["k"], ["id"], hot_rows=10_000)
    salted = join_dimension(facts, dim, ["k"], ["id"], hot_rows=100, salts=8)
    assert sorted(map(repr, plain.select("k", "id", "v").collect())) == sorted(map(repr, salted.select("k", "id", "v").collect()))
    assert salted.count() == 503


def test_rows_without_a_key_and_very_hot_keys_are_spread(spark, no_broadcast):
    """500 rows without a key and 500 of one key fall into many tasks, though few salts are asked for."""
    k = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 101 == 0, F.col("id").cast("string"))
    facts = spark.range(1000).select(k.alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1), ("101", 2)], "k string, v int")
    joined = join_dimension(facts, dim, ["k"], ["id"], hot_rows=50, salts=2)
    plain = facts.join(dim, "k", "left")
    assert sorted(map(repr, joined.select("k", "id", "v").collect())) == sorted(map(repr, plain.select("k", "id", "v").collect()))
    for kind in (F.col("k").isNull(), F.col("k") == "hot"):
        largest = joined.where(kind).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 200 < plain.where(kind).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    only_null = join_dimension(facts.where("k IS NULL OR k <> 'hot'"), dim, ["k"], ["id"], hot_rows=50)
    assert only_null.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
    assert only_null.where("v = 2").count() == 1 and only_null.count() == 500
