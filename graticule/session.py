"""Session helpers: settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a counted side is broadcast. The broadcast rows of this library
#: hold a handful of numbers or short texts, so a million of them stay well under the
#: 8 GB broadcast limit and fit in an executor.
BROADCAST_ROWS = 1_000_000


def local_session(cores: int | str = 8, app: str = "graticule") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only
    on a local master with nothing set; on a cluster that is an error, because a
    machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the session's process ends."""
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(hadoop)
    return path


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives lost executors like a reliable checkpoint does, and
    Parquet gives later joins real size statistics.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of an equi-join that grows with the data: joined by shuffle, never broadcast.

    Without this Spark goes by file sizes, and a table of many like rows is a few MB on disk but
    a thousand in the driver that collects it for a broadcast.
    """
    return df.hint("merge")


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than ``limit + 1``."""
    return df.limit(limit + 1).count() <= limit


def spread_out(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, by all columns or those named: for few bytes that make much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or df.columns))


# -- bits of a set: a filter of fixed size that lets through all members and few others ------

#: 64-bit words of a set's bits (1 MB), whatever the size of the set.
_WORDS = 1 << 17


def _bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(_WORDS * 64))


def bits_of(df: DataFrame, column: str) -> Column:
    """The set of a column's values as an array of words with one bit for each value's hash."""
    at = df.select(_bit(F.col(column)).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_at % 64))")).alias("_set"))
    full = df.sparkSession.range(_WORDS).join(words, F.col("id") == F.col("_word"), "left")
    order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_set", F.lit(0)).alias("_set"))))
    return full.agg(F.transform(order, lambda x: x["_set"])).scalar()


def among(value: Column, bits: Column) -> Column:
    """False only for values that are not in the set behind ``bits``."""
    return F.getbit(F.get(bits, F.shiftright(_bit(value), 6).cast("int")), (_bit(value) % 64).cast("int")) == 1
