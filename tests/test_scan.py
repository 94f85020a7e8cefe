import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators.scan import State, block_of, scan


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_states_match_a_plain_loop(spark, rows):
    rng = random.Random(rows)
    data = [(k, p, rng.choice([None, None, "a", "b"]), rng.choice([None, 1, 2, 5])) for k in ("x", "y", None) for p in range(25)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "k string, p long, v string, n long")
    states = [State("filled", "last", F.col("v")), State("total", "sum", F.col("n")), State("mixed", "xor", F.col("n"))]
    got = scan(df, ["k"], ["p"], states, block_of(F.col("p"), rows))
    assert got.columns == ["k", "p", "v", "n", "filled", "total", "mixed"]
    want, now = [], {}
    for k, p, v, n in data:
        filled, total, mixed = now.get(k, (None, 0, 0))
        now[k] = (v if v is not None else filled, total + (n or 0), mixed ^ (n or 0))
        want.append((k, p, v, n, *now[k]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_segments_of_any_length_lie_in_many_blocks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("doc"), F.col("id").alias("p"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    got = scan(df, ["doc"], ["p"], [State("f", "last", F.col("v"))], block_of(F.col("p"), 4096))
    assert got.filter("f <> p - p % 1000").isEmpty()
    assert got.groupBy(F.floor(F.col("p") / 4096)).count().count() == 49


def test_no_rows_no_keys_and_states_that_replace(spark):
    none = spark.createDataFrame([], "p long, v string")
    assert scan(none, [], ["p"], [State("v", "last", F.col("v"))], F.lit(0)).collect() == []
    some = spark.createDataFrame([(2, None), (1, "a")], "p long, v string")
    assert sorted(map(tuple, scan(some, [], ["p"], [State("v", "last", F.col("v"))], F.lit(0)).collect())) == [(1, "a"), (2, "a")]
