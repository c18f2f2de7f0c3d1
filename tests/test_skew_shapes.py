"""Plans that must hold for hot keys: what is folded before it is shuffled, what is cut into pieces, what is broadcast."""

from pyspark.sql import functions as F

from brindle.operators import layouts, ordering, skew


def test_a_hot_stream_is_cut_into_pieces(spark):
    rows = [(i, {"p": "hot"}, i, f"INFO line {i}") for i in range(4000)] + [(9000 + i, {"p": f"cold{i}"}, i, "INFO x") for i in range(100)]
    df = spark.createDataFrame(rows, "entry_id long, labels map<string,string>, ts_ns long, line string")
    keyed = df.select(ordering.stream_key("labels").alias("stream"), "ts_ns", "entry_id")
    sizes = [r["n"] for r in ordering.ordered_pieces(keyed, "stream", "ts_ns", "entry_id", pieces=8).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert layouts.assemble_records(df).count() == 4100


def test_labels_in_another_order_are_one_stream(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), (None,), ({},)], "labels map<string,string>")
    k = [r[0] for r in df.select(ordering.stream_key("labels")).collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[0] != k[2]


def test_hot_keys_are_folded_before_the_shuffle(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    plan = skew.eager_join_aggregate(left, left, F.col("k"), F.col("k"))._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange hashpartitioning")[1:]:
        assert "partial_count" in part.split("Exchange")[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
