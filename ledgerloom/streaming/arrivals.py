"""State that outlives a batch: mail filed again when its invoice comes late, and files that have stopped growing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILED = "id bigint, key string, sent timestamp, invoice_sent timestamp, action string"


class Refiling:
    """Mail (id, key, sent, invoice boolean) filed by the earliest invoice of its key, in whatever order both arrive.

    A mail that is no invoice is filed once an invoice of its key was sent no
    later than it: ``filed`` where that was known on arrival, ``filed again``
    where the invoice came in a later batch. What arrived is kept below ``folder``,
    by batch: the mail, the earliest invoice of each key, and what was filed. A
    batch reads what batches before it have left and replaces its own folders, so
    that one that is run again after a failure has the same outcome. Keys meet by
    joins, of which AQE splits those with a large key; no key's mail is held by a task.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _before(self, table: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.folder}/{table}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(path).filter(F.col("batch") < batch).drop("batch")

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def __call__(self, arrived: DataFrame, batch: int) -> None:
        """Takes one batch, as foreachBatch gives it; rows without a key or a time are kept and never filed."""
        arrived = arrived.select("id", F.col("key").cast("string").alias("key"), F.col("sent").cast("timestamp").alias("sent"), "invoice").persist()
        try:
            mail = arrived.filter(~F.coalesce("invoice", F.lit(False))).select("id", "key", "sent")
            new = arrived.filter("invoice and sent is not null and key is not null").groupBy("key").agg(F.min("sent").alias("first"))
            known = self._before("invoices", batch, "key string, first timestamp").groupBy("key").agg(F.min("first").alias("first"))
            old_mail = self._before("mail", batch, "id bigint, key string, sent timestamp")
            now = new.unionByName(known).groupBy("key").agg(F.min("first").alias("invoice_sent"))
            fresh = mail.join(now, "key").filter(F.col("sent") >= F.col("invoice_sent")).withColumn("action", F.lit("filed"))
            moved = new.join(known.withColumnRenamed("first", "was"), "key", "left").filter(F.col("was").isNull() | (F.col("first") < F.col("was")))
            again = old_mail.join(moved, "key").filter((F.col("sent") >= F.col("first")) & (F.col("was").isNull() | (F.col("sent") < F.col("was"))))
            again = again.withColumnRenamed("first", "invoice_sent").withColumn("action", F.lit("filed again"))
            names = [c.split()[0] for c in FILED.split(", ")]
            self._write(fresh.select(names).unionByName(again.select(names)), "filed", batch)
            self._write(mail, "mail", batch)
            self._write(new, "invoices", batch)
        finally:
            arrived.unpersist()

    def filed(self) -> DataFrame:
        """id, key, sent, the invoice's time, action, and the batch that filed it."""
        return self.spark.read.schema(f"{FILED}, batch bigint").parquet(f"{self.folder}/filed")

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        """Handles what has arrived of a stream and stops; a later call goes on from the checkpoint."""
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


LOOKS = ("path", "length", "modified", "seen")
LEFT = "path string, length bigint, modified timestamp, seen timestamp"


def stood_still(looks: DataFrame, settle_seconds: float = 2.0, forget: str = "1 hour") -> DataFrame:
    """Of looks at files (path, length, modified, seen), those at which a file has settled: path, length, modified, seen.

    A file settles at the first look at least ``settle_seconds`` after one at which
    it had the same size and time of change, with nothing else in between; a
    file that changes afterwards settles anew. Looks may come in any order within
    a batch. A stream keeps the last look of each path, and lets go of paths not
    seen for ``forget`` of event time; a table gives the same rows by windows.
    """
    rows = looks.select("path", F.col("length").cast("long").alias("length"), F.col("modified").cast("timestamp").alias("modified"), F.col("seen").cast("timestamp").alias("seen")).filter("path is not null and seen is not null")
    if rows.isStreaming:
        state = "length bigint, modified timestamp, since timestamp, last timestamp, left boolean"
        held = rows.withWatermark("seen", forget).groupBy("path")
        return held.applyInPandasWithState(lambda key, batches, s: _look(key, batches, s, settle_seconds, pd.Timedelta(forget)), LEFT, state, "append", GroupStateTimeout.EventTimeTimeout)
    w = Window.partitionBy("path").orderBy("seen", "length", "modified")
    same = F.struct("length", "modified")
    rows = rows.withColumn("_new", F.coalesce((~same.eqNullSafe(F.lag(same).over(w))).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w))
    inside = Window.partitionBy("path", "_g")
    due = F.col("seen").cast("double") - F.min("seen").over(inside).cast("double") >= settle_seconds
    first = rows.withColumn("_due", due).filter("_due").withColumn("_n", F.row_number().over(inside.orderBy("seen")))
    return first.filter("_n = 1").select(*LOOKS)


def _look(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, settle: float, forget: pd.Timedelta) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held, out = state.getOption, []
    rows = pd.concat(batches).sort_values(["seen", "length", "modified"], na_position="first")
    for length, modified, seen in rows[["length", "modified", "seen"]].itertuples(index=False):
        length, modified = (None if pd.isna(length) else int(length)), (None if pd.isna(modified) else modified)
        if held is None or (held[0], held[1]) != (length, modified):
            held = (length, modified, seen, seen, False)
        left = held[4]
        if not left and (seen - held[2]).total_seconds() >= settle:
            out.append((key[0], length, modified, seen))
            left = True
        held = (length, modified, held[2], max(held[3], seen), left)
    state.update(held)
    state.setTimeoutTimestamp(max(int((held[3] + forget).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=LOOKS).astype({"length": "Int64", "modified": "datetime64[ns]", "seen": "datetime64[ns]"})
