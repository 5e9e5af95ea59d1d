"""Shared storage: tables that cut lineage and survive lost executors.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where
that is unset, as in tests on one machine, a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new path below the shared folder, as a URI or a path that executors and driver both reach."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.startswith("local"):
            top = _OWN.setdefault("dir", None) or _OWN.update(dir=tempfile.mkdtemp(prefix="ledgerloom-")) or _OWN["dir"]
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return f"{top.rstrip('/')}/ledgerloom/{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is built and run within go when its run ends, not when the driver collects its garbage."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def _write(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Writes and reads again; shuffle files of the write go when it ends."""
    spark = df.sparkSession
    with tidy(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: its size is then known to the planner, and its lineage is cut."""
    return _write(df, shared_dir(df.sparkSession))


class Scratch:
    """Stored tables of one computation, removed together or one by one when nothing will read them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        path = shared_dir(self.spark)
        out = _write(df, path, codec)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            self._delete(path)

    def clear(self, *keep: DataFrame) -> None:
        """Removes all but the tables named."""
        for path in [p for p, t in self.paths.items() if not any(t is x for x in keep)]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        del self.paths[path]
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def salt_of(n: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def spread_join(left: DataFrame, small: DataFrame, key: str, by: Column | str, salts: int = 32, how: str = "left") -> DataFrame:
    """left joined with one row of ``small`` per key, nulls equal.

    ``small`` is a stored aggregate; the planner broadcasts it when its written
    size is under the session's threshold. Else both sides are dealt by key and
    a salt of ``by``, so that a key with a third of all rows meets many tasks.
    """
    names = [c for c in small.columns if c != key]
    wide = stored(small.select(F.col(key).alias("_key"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt"), *names))
    salted = left.withColumn("_left_salt", salt_of(salts, by))
    return salted.join(wide, salted[key].eqNullSafe(wide["_key"]) & (salted["_left_salt"] == wide["_salt"]), how).drop("_key", "_salt", "_left_salt")


#: A marks table has so many words of 64 bits at most: 16 MB, whatever the input.
MARK_WORDS = 1 << 21


def _told(table: np.ndarray, hashes: pa.Array) -> np.ndarray:
    h = hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    word = table[(h & np.uint64(MARK_WORDS - 1)).astype(np.int64)]
    return (word >> ((h >> np.uint64(21)) & np.uint64(63))) & np.uint64(1) == 1


class Marks:
    """A set of 64-bit hashes as one bit each, of 16 MB at most. Members are always told as such; others rarely, more often in a larger set.

    It spares whole texts a shuffle: rows without a mark are surely not in the
    set, and an exact join decides about the rest.
    """

    def __init__(self, hashes: DataFrame, column: str):
        spark = hashes.sparkSession
        bit = F.pmod(F.shiftrightunsigned(F.col(column), 21), F.lit(64)).cast("int")
        words = hashes.groupBy(F.col(column).bitwiseAND(F.lit(MARK_WORDS - 1)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
        table = np.zeros(MARK_WORDS, np.uint64)
        table[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        self.shipped = spark.sparkContext.broadcast(table)

    def has(self, hashes: Column) -> Column:
        shipped = self.shipped

        def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in it:
                yield pa.array(_told(shipped.value, batch), pa.bool_())

        return F.arrow_udf(run, "boolean")(hashes)

    def having(self, hashes: Column, values: Column, kind: str, f: Callable[[pa.Array], pa.Array]) -> Column:
        """A struct: whether a row is marked, and as ``value`` what f, over arrays, gives for the marked rows' values.

        A filter by ``has`` below another Python function takes two Python workers for each task, and executors
        keep all the workers that once ran together; this takes one. Marked as not deterministic: else a filter
        that a join infers is pushed below it, and f is run twice.
        """
        shipped = self.shipped

        def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for batch, rows in it:
                told = _told(shipped.value, batch)
                place = pa.array(np.cumsum(told) - 1, pa.int64(), mask=~told)
                yield pa.StructArray.from_arrays([pa.array(told, pa.bool_()), f(rows.filter(pa.array(told))).take(place)], ["marked", "value"])

        return F.arrow_udf(run, f"marked boolean, value {kind}").asNondeterministic()(hashes, values)
