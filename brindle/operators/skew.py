"""Per-key results over two skewed inputs by eager aggregation.

A join of two inputs on a key of which a few values hold most rows makes the tasks of those keys do nearly all
the work, and the join's rows are the product of both sides. When only aggregates of the join are wanted, the
join never has to happen on rows: each side is folded to one compact state per key first (Spark folds map-side,
so a hot key costs one row per input partition), the states are joined one to one, and the aggregates of the
joined rows follow algebraically: counts multiply, a sum of one side is multiplied by the other side's count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import reaches

#: Products of counts and sums leave 64 bits at the sizes aimed at.
_WIDE = "decimal(38,0)"


def fold_by_key(df: DataFrame, key: Column, sums: Mapping[str, Column], prefix: str) -> DataFrame:
    """One compact state per non-null key: its rows, and the sum and count of each measure.

    Columns: join_key, <prefix>_rows, and <prefix>_<m>_sum, <prefix>_<m>_n for each measure m.
    Null keys are left out, as in any equi-join; an empty input gives no state. Null measures count in rows only.
    """
    renamed = df.select(key.alias("join_key"), *[c.alias(n) for n, c in sums.items()])
    cols = [F.count(F.lit(1)).alias(f"{prefix}_rows")]
    for name in sums:
        measure = F.col(name).cast("decimal(20,0)") if isinstance(renamed.schema[name].dataType, T.IntegralType) else F.col(name)
        cols += [F.sum(measure).alias(f"{prefix}_{name}_sum"), F.count(name).alias(f"{prefix}_{name}_n")]
    return renamed.where(F.col("join_key").isNotNull()).groupBy("join_key").agg(*cols)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    how: str = "full",
) -> DataFrame:
    """Aggregates of `left JOIN right ON left_key = right_key` per key, without joining a single row.

    Columns: join_key; left_rows and right_rows (0 where a side lacks the key); pair_rows, the number of rows
    the join would have; and for each measure m of a side pair_<m>_sum, its sum over the joined rows, next to
    that side's own <side>_<m>_sum. Counts of pairs and sums of whole numbers are decimal(38,0), so that no product overflows. Null keys never join and are left out. Extra columns with any name are ignored:
    only the given expressions are read. Ties and repeated rows count as often as they stand. Empty inputs give an
    empty result (or, for how="full", the other side's keys).
    """
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    if clash := left_sums.keys() & right_sums.keys():
        raise ValueError(f"measures named on both sides: {sorted(clash)}")
    a = fold_by_key(left, left_key, left_sums, "left")
    b = fold_by_key(right, right_key, right_sums, "right")
    j = a.join(b, "join_key", how)
    zero = F.lit(0).cast("long")
    out = j.withColumn("left_rows", F.coalesce("left_rows", zero)).withColumn("right_rows", F.coalesce("right_rows", zero))
    rows = {side: F.col(f"{side}_rows").cast("decimal(19,0)") for side in ("left", "right")}
    out = out.withColumn("pair_rows", (rows["left"] * rows["right"]).cast(_WIDE))
    for side, other, measures in (("left", "right", left_sums), ("right", "left", right_sums)):
        for m in measures:
            own = F.col(f"{side}_{m}_sum")
            whole = isinstance(out.schema[f"{side}_{m}_sum"].dataType, T.DecimalType)
            out = out.withColumn(f"pair_{m}_sum", (own * rows[other]).cast(_WIDE) if whole else own * F.col(f"{other}_rows"))
    return out


def roll_up(states: DataFrame, by: Sequence[str | Column], sums: Sequence[str]) -> DataFrame:
    """Combine per-key states into coarser groups: the algebraic last step after eager_join_aggregate."""
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def frequent_keys(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, kinds: tuple[str, str], share: float
) -> DataFrame:
    """Keys that hold at least `share` of all rows of a side: columns kind, key_value, key_rows, all_rows.

    Both sides are folded and the states joined by eager_join_aggregate; a side's total is the sum of its states and
    of its rows with a null key, which count in the total and are no case themselves. The comparison is exact, for a share of
    any number of places. Empty inputs give no rows.
    """
    # Rows with a null key stay in the totals: they are folded under a struct that no real key equals.
    wrap = lambda k: F.struct(k.isNull().alias("none"), k.alias("value"))
    states = eager_join_aggregate(left, right, wrap(left_key), wrap(right_key))
    per_kind = states.select(
        F.col("join_key.none").alias("none"),
        F.col("join_key.value").alias("key_value"),
        F.inline(
            F.array(
                F.struct(F.lit(kinds[0]).alias("kind"), F.col("left_rows").alias("key_rows")),
                F.struct(F.lit(kinds[1]).alias("kind"), F.col("right_rows").alias("key_rows")),
            )
        ),
    ).where(F.col("key_rows") > 0)
    totals = roll_up(per_kind, ["kind"], ["key_rows"]).withColumnRenamed("key_rows", "all_rows")
    # Two rows, one for each kind.
    return (
        per_kind.join(F.broadcast(totals), "kind")
        .where(~F.col("none") & reaches(F.col("key_rows"), F.col("all_rows"), share))
        .select("kind", "key_value", "key_rows", "all_rows")
    )
