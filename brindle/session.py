"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 4, shuffle_partitions: int = 8, app: str = "brindle") -> SparkSession:
    """A local session with the settings that the operators assume (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs: that of spark.checkpoint.dir or of setCheckpointDir.

    Where neither is set, a local master gets a temporary folder; a cluster gets an error, as its executors don't see the driver's disk.
    """
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", "") or "":
        return named.rstrip("/")
    if not (kept := sc._jsc.sc().getCheckpointDir()).isEmpty():
        return kept.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_written: dict[str, SparkSession] = {}


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that materialize wrote; without arguments, those of all. They are removed at the end of the process in any case."""
    paths = [t._brindle_path for t in tables if hasattr(t, "_brindle_path")] if tables else list(_written)
    for path in paths:
        if (spark := _written.pop(path, None)) is not None and spark.sparkContext._jsc is not None:
            _remove(spark, path)


def _at_end() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already
        _written.clear()


atexit.register(_at_end)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and the files survive the loss of executors.

    Columns that a reader doesn't name aren't read. The files stay until release() or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def reaches(part: Column, whole: Column | int, share: float) -> Column:
    """part is at least share of whole, in exact arithmetic: both are counts, share any decimal number of at most 15 places."""
    f = Fraction(str(share))
    if not 0 < f <= 1 or f.denominator >= 10**15:
        raise ValueError(f"not a share: {share}")
    whole = whole if isinstance(whole, Column) else F.lit(whole)
    wide = lambda c: c.cast("decimal(20,0)")
    times = lambda n: F.lit(n).cast("decimal(16,0)")
    return wide(part) * times(f.denominator) >= wide(whole) * times(f.numerator)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table of that name in a folder of test or production tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def place(df: DataFrame, name: str) -> int:
    """Position of the column of that name; one that differs in letter case counts only where none is equal."""
    found = [i for i, n in enumerate(df.columns) if n == name] or [i for i, n in enumerate(df.columns) if n.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns renamed __c0, __c1, ... so that no two names can clash."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of df, renamed: narrow(df, id="doc_id") has the one column id.

    Columns are found by position, so that others whose names differ in letter case only, or that have the new names, do no harm.
    """
    return by_place(df).select(*[F.col(f"__c{place(df, old)}").alias(new) for new, old in columns.items()])
