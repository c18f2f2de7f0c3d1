"""Rules on a stream: one Structured Streaming query that enforces them batch by batch.

Deduping, rollups and counters are per interval of arrival: each micro-batch is folded by itself, so no late line is lost to a watermark and the
counts of all outputs sum to the lines that came in. Each output is written under its batch's number and replaced when a batch is repeated after a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.enforce import Layout, check_rules, enforce
from brindle.operators.mining import LineRule

OUTPUTS = ("kept", "records", "archive", "volume")


def start_enforcement(
    stream: DataFrame, rules: Sequence[LineRule], out: str, checkpoint: str, stream_cols: Sequence[str] = ("service",), layout: Layout = Layout(), interval: str | None = "10 seconds", level_keys: Sequence[str] = (), shadow: bool = False
) -> StreamingQuery:
    """Start the query. Outputs are Parquet folders of `out`, partitioned by batch. interval: how long lines are folded together; None runs through what is there and ends."""
    check_rules(rules)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            done = enforce(batch, rules, stream_cols, layout, level_keys, shadow)
            for name in OUTPUTS:
                getattr(done, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
