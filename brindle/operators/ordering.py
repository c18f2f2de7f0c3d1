"""Order-dependent work on streams of any skew.

A window partitioned by stream puts a hot stream into one task. Here rows are range-partitioned by (stream, time, id)
instead, so that a hot stream is cut into as many pieces as its size calls for; each piece is handled in order by one task, and
only the two ends of each piece, a number of rows bounded by the number of pieces, are looked at together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_key(labels: str | Column) -> Column:
    """A 64-bit key of the set of label pairs: the order of the keys in the map means nothing; null is the empty set."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.xxhash64(F.coalesce(F.sort_array(F.map_entries(c)), F.array().cast("array<struct<key:string,value:string>>")))


def piece_count(df: DataFrame) -> int:
    """Number of pieces: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_pieces(df: DataFrame, *order: str, pieces: int | None = None) -> DataFrame:
    """df in globally ordered pieces: partition i holds rows before those of partition i + 1, each sorted."""
    return df.repartitionByRange(pieces or piece_count(df), *order).sortWithinPartitions(*order)
