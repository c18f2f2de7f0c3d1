"""Log views of tables, file sources of logs, and decoders of a log store's JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import table

NS = 10**9


def events_as_logs(spark: SparkSession, d: str) -> DataFrame:
    """The events table as logs: labels service_name and pod, ts_ns, line (text), props (JSON text)."""
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return e.select(
        F.create_map(F.lit("service_name"), F.col("event_type"), F.lit("pod"), F.concat(F.lit("pod-"), (F.col("user_id") % 4).cast("string"))).alias("labels"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.concat(level, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.lit(" took "), F.floor("value").cast("string"), F.lit("ms")).alias("line"),
        "props",
    )


def day_pruned(path: str, spark: SparkSession, start_ns: int, end_ns: int) -> DataFrame:
    """Logs written by write_by_day in [start, end): only the days of the range are listed and read."""
    day = 86_400 * NS
    df = spark.read.parquet(path)
    return df.where((F.col("day") >= start_ns // day) & (F.col("day") <= (end_ns - 1) // day) & (F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns)).drop("day")


def write_by_day(df: DataFrame, path: str) -> None:
    """Logs to Parquet, one folder a day (UTC); rows without a time are refused."""
    day = F.expr(f"ts_ns div {86_400 * NS}")
    checked = df.withColumn("ts_ns", F.when(F.col("ts_ns").isNull(), F.raise_error(F.lit("a log row has no time")).cast("long")).otherwise(F.col("ts_ns")))
    checked.withColumn("day", day).write.partitionBy("day").mode("append").parquet(path)


def in_range(df: DataFrame, start_ns: int, end_ns: int, ts_col: str = "ts_ns") -> DataFrame:
    """df, failing on the first row outside [start, end)."""
    t = F.col(ts_col)
    ok = (t >= start_ns) & (t < end_ns)
    return df.withColumn(ts_col, F.when(ok, t).otherwise(F.raise_error(F.concat(F.lit("row outside the range asked for: "), t.cast("string"))).cast("long")))


_STREAMS = "struct<status:string,data:struct<resultType:string,result:array<struct<stream:map<string,string>,values:array<array<string>>>>>>"
_VECTOR = "struct<status:string,data:struct<resultType:string,result:array<struct<metric:map<string,string>,value:array<string>>>>>"


def decode_streams(df: DataFrame, column: str = "body") -> DataFrame:
    """labels, ts_ns, line of the answers to range queries for lines: {"data": {"result": [{"stream": {...}, "values": [[ns, line], ...]}]}}."""
    j = df.select(F.from_json(column, _STREAMS).alias("j"))
    streams = j.select(F.explode("j.data.result").alias("s"))
    values = streams.select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    return values.select("labels", F.col("v")[0].cast("long").alias("ts_ns"), F.col("v")[1].alias("line"))


def decode_vector(df: DataFrame, column: str = "body") -> DataFrame:
    """labels, at_s, value of the answers to instant queries."""
    j = df.select(F.from_json(column, _VECTOR).alias("j"))
    s = j.select(F.explode("j.data.result").alias("s"))
    return s.select(F.col("s.metric").alias("labels"), F.col("s.value")[0].cast("double").alias("at_s"), F.col("s.value")[1].cast("double").alias("value"))


def synthetic_logs(spark: SparkSession, n: int, seed: int = 1, start_ns: int = 1_767_571_200 * NS, partitions: int | None = None) -> DataFrame:
    """A corpus of known templates: service, template_id, severity, message, line, ts_ns, labels. The same rows for the same n and seed."""
    corpus = [
        ("kiln", False, "batch", "INFO", "INFO batch {num6} fired at {deg} for {ms}", 300),
        ("kiln", False, "idle", "INFO", "INFO kiln idle", 120),
        ("kiln", False, "probe", "INFO", "INFO probe /ready answered {code} in {ms}", 260),
        ("kiln", False, "door-open", "DEBUG", "DEBUG door sensor {hex8} reads open", 60),
        ("kiln", False, "door-shut", "DEBUG", "DEBUG door sensor {hex8} reads shut", 40),
        ("kiln", False, "vent", "WARN", "WARN vent {small} sticks near {ip}", 30),
        ("kiln", False, "overheat", "ERROR", "ERROR kiln overheated to {deg} because of {cause}", 12),
        ("ferry", False, "boarded", "INFO", "INFO passenger {user} boarded deck {small}", 220),
        ("ferry", False, "late", "WARN", "WARN passenger {user} missed the gate and boarded late", 18),
        ("ferry", False, "token", "INFO", "INFO manifest holds the text <ip> for {user}", 6),
        ("loom", True, "woven", "INFO", "cloth {num6} woven on frame {hex16}", 160),
        ("loom", True, "shuttle", "INFO", "shuttle passed in {ms}", 280),
        ("loom", True, "snag", "ERROR", "cloth {num6} failed at {stage}", 14),
    ]
    words = {"code": ["200", "204", "429", "503"], "cause": ["fuel", "fan", "sensor"], "user": ["ines", "jorn", "kofi", "lena", "mira", "noor"], "stage": ["warp", "weft", "trim"]}
    draw = lambda salt, mod: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(mod))
    hexed = lambda salt, width: F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(f"{seed}|{salt}")), 256), 1, width)
    pick = lambda name: F.element_at(F.array(*map(F.lit, words[name])), (draw(name, len(words[name])) + 1).cast("int"))
    value = {
        "ms": F.concat((draw("ms", 250) + 1).cast("string"), F.lit("ms")), "deg": F.concat((draw("d", 400) + 900).cast("string"), F.lit("C")), "hex16": hexed("h", 16), "hex8": hexed("k", 8), "num6": F.lpad(draw("n", 10**6).cast("string"), 6, "0"),
        "small": (draw("s", 5) + 1).cast("string"), "ip": F.concat(F.lit("10."), draw("i", 250).cast("string"), F.lit("."), draw("j", 250).cast("string"), F.lit("."), draw("l", 250).cast("string")),
        **{w: pick(w) for w in words},
    }
    import re

    def text(pattern: str):
        parts = re.split(r"\{(\w+)\}", pattern)
        return F.concat(*[value[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])

    total, at = sum(c[5] for c in corpus), 0
    place = draw("template", total)
    out = {k: F.lit(None).cast("string") for k in ("service", "template_id", "severity", "message", "line")}
    for service, structured, tid, severity, pattern, weight in corpus:
        here = (place >= at) & (place < at + weight)
        m = text(pattern)
        line = F.to_json(F.struct(F.lit(severity.lower()).alias("level"), m.alias("msg"))) if structured else m
        for k, v in {"service": F.lit(service), "template_id": F.lit(tid), "severity": F.lit(severity), "message": m, "line": line}.items():
            out[k] = F.when(here, v).otherwise(out[k])
        at += weight
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    df = rows.select("id", (F.lit(start_ns) + F.col("id") * 1_000_000).alias("ts_ns"), *[c.alias(k) for k, c in out.items()])
    return df.withColumn("labels", F.create_map(F.lit("service_name"), F.col("service")))
