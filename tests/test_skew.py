"""Eager aggregation against the join that it replaces."""

import random

from pyspark.sql import functions as F

from brindle.operators import skew


def frames(spark, n=400):
    rng = random.Random(3)
    key = lambda: rng.choice([None, "", "hot", "hot", "hot", "a", "b", f"k{rng.randint(0, 30)}"])
    left = spark.createDataFrame([(key(), rng.choice([None, 1, 2, 3]), "x") for _ in range(n)], "k string, v long, left_rows string")
    right = spark.createDataFrame([(key(), rng.choice([None, 5, 7]), "y") for _ in range(n)], "k string, w long, join_key string")
    return left, right


def test_equals_the_join(spark):
    left, right = frames(spark)
    got = {r.join_key: r for r in skew.eager_join_aggregate(left, right, F.col("k"), F.col("k"), {"v": F.col("v")}, {"w": F.col("w")}).collect()}
    joined = left.select("k", "v").join(right.select("k", "w"), "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    for r in joined.collect():
        g = got[r.k]
        assert (g.pair_rows, g.pair_v_sum, g.pair_w_sum) == (r.n, r.v, r.w)
    assert sum(g.pair_rows for g in got.values()) == sum(r.n for r in joined.collect())
    assert None not in got


def test_frequent_keys_count_null_rows_in_the_total(spark):
    a = spark.createDataFrame([("x",)] * 5 + [(None,)] * 94 + [("y",)], "k string")
    b = spark.createDataFrame([("z",)] * 19 + [(None,)], "k string")
    got = {tuple(r) for r in skew.frequent_keys(a, b, F.col("k"), F.col("k"), ("l", "r"), 0.05).collect()}
    assert got == {("l", "x", 5, 100), ("r", "z", 19, 20)}  # a tie at the share is in


def test_products_beyond_64_bits(spark):
    many = spark.createDataFrame([("k", 2**62), ("k", 2**62), ("k", None)], "k string, v long")
    got = skew.eager_join_aggregate(many, many, F.col("k"), F.col("k"), {"v": F.col("v")}, {"w": F.col("v")}).first()
    assert (got.pair_rows, int(got.left_v_sum), int(got.pair_v_sum), int(got.pair_w_sum)) == (9, 2**63, 3 * 2**63, 3 * 2**63)
    halves = skew.eager_join_aggregate(many, many, F.col("k"), F.col("k"), {"x": F.lit(0.5)}).first()
    assert halves.pair_x_sum == 4.5


def test_shares_of_many_places(spark):
    a = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [("z",)] * 2, "k string")
    run = lambda share: {r.key_value for r in skew.frequent_keys(a, a.limit(0), F.col("k"), F.col("k"), ("l", "r"), share).collect()}
    assert run(0.4285714285714) == {"x"} and run(0.4285714285715) == set() and run(4e-7) == {"x", "y", "z"}


def test_empty_sides(spark):
    left, right = frames(spark, 50)
    none = left.limit(0)
    assert skew.eager_join_aggregate(none, right.limit(0), F.col("k"), F.col("k")).count() == 0
    one = skew.eager_join_aggregate(none, right, F.col("k"), F.col("k"))
    assert one.agg(F.sum("pair_rows")).first()[0] == 0 and one.count() > 0
    assert skew.frequent_keys(none, right.limit(0), F.col("k"), F.col("k"), ("l", "r"), 0.1).count() == 0


def test_roll_up(spark):
    left, right = frames(spark)
    s = skew.eager_join_aggregate(left, right, F.col("k"), F.col("k"))
    got = skew.roll_up(s, [F.substring("join_key", 1, 1).alias("first")], ["left_rows", "pair_rows"])
    assert got.agg(F.sum("left_rows")).first()[0] == left.where("k is not null").count()
