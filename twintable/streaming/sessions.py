"""Visits over a stream: merging interval state under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.operators.sessions import as_visits, distinct_events, gap_us, merge_intervals, opened_intervals

_KINDS = {
    "seen": "event string, user string, us bigint, batch bigint",
    "open": "user string, lo bigint, hi bigint, n bigint, batch bigint",
    "closed": "user string, lo bigint, hi bigint, n bigint, batch bigint",
    "taken": "user string, lo bigint, of bigint, batch bigint",
    "progress": "watermark bigint, batch bigint",
}


class IntervalState:
    """The visits of a stream of events, as intervals in tables of a shared ``folder``.

    Every event opens an interval of the gap's length. Intervals that the watermark (the latest time seen less
    ``lateness``) hasn't passed are open: each micro-batch reads them, merges its own and writes them anew, so
    what a batch touches is bounded by gap, lateness and users, not by history. Passed ones are closed and
    only appended. An event later than that is no loss: the closed visits that its interval overlaps are
    taken back, merged with it and closed again. Redelivered events are found among those seen, null ids are
    events of their own, as in ``sessionize``, whose result ``visits`` gives at any time.

    Every batch writes folders of its own number over, so a batch that is run again gives the same.
    """

    def __init__(self, spark: SparkSession, folder: str, user: str = "user_id", ts: str = "event_timestamp", event_id: str = "event_id", gap_minutes: float = 30, lateness_minutes: float = 120):
        self.spark, self.folder, self.columns = spark, folder, (user, ts, event_id)
        self.gap, self.lateness = gap_us(gap_minutes), gap_us(lateness_minutes)

    def _read(self, kind: str, before: int | None = None) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _KINDS[kind])
        df = self.spark.read.schema(_KINDS[kind]).parquet(f"{self.folder}/{kind}")
        return df if before is None else df.where(F.col("batch") < before)

    def _write(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{kind}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        schema = df.schema
        return self.spark.read.schema(schema).parquet(path)

    def _closed(self, before: int | None = None) -> DataFrame:
        """Closed visits that no later batch took back."""
        taken = self._read("taken", before).select("user", "lo", F.col("of").alias("batch"))
        return self._read("closed", before).join(taken, ["user", "lo", "batch"], "left_anti")

    def advance(self, events: DataFrame, batch: int) -> None:
        """Takes in a micro-batch; for ``foreachBatch``."""
        col = F.col
        came = distinct_events(events, *self.columns)
        span = came.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
        last = self._read("progress", batch).orderBy(col("batch").desc()).first()
        watermark, previous = (last["watermark"], last["batch"]) if last else (-(1 << 62), -1)
        if span["lo"] is None:
            return
        seen = self._read("seen", batch).where(col("us").between(span["lo"], span["hi"])).drop("batch")
        fresh = came.join(seen, ["event", "user", "us"], "left_anti")
        new = self._write(opened_intervals(fresh, self.gap), "new", batch)
        self._write(fresh.where("event is not null").select("event", "user", "us"), "seen", batch)
        # A closed visit ends more than a gap before the watermark, so only intervals that start before it can touch one.
        late = new.where(col("lo") < watermark).select("user", col("lo").alias("l"), col("hi").alias("h"))
        near = (col("closed.lo") <= col("h") + self.gap) & (col("closed.hi") >= col("l") - self.gap)
        again = self._closed(batch).alias("closed").join(late.alias("late"), (col("closed.user") == col("late.user")) & near, "left_semi")
        again = self._write(again.select("user", "lo", "hi", "n", col("batch").alias("of")), "again", batch)
        self._write(again.select("user", "lo", "of"), "taken", batch)
        held = self._read("open", batch).where(col("batch") == previous).drop("batch")
        merged = self._write(merge_intervals(held.unionByName(new).unionByName(again.drop("of")), self.gap), "merged", batch)
        watermark = max(watermark, span["hi"] - self.lateness)
        passed = col("hi") + self.gap < watermark
        self._write(merged.where(passed), "closed", batch)
        self._write(merged.where(~passed), "open", batch)
        self._write(self.spark.createDataFrame([(watermark,)], "watermark bigint"), "progress", batch)

    def visits(self) -> DataFrame:
        """All visits so far, open ones included, like ``sessionize``."""
        last = self._read("progress").agg(F.max("batch")).first()[0]
        still = self._read("open").where(F.col("batch") == (-1 if last is None else last))
        return as_visits(self._closed().unionByName(still).drop("batch"), self.columns[0])


def stream_sessions(events: DataFrame, folder: str, **options) -> IntervalState:
    """Runs over what the stream ``events`` holds now, in micro-batches, and returns the state.

    ``folder`` keeps state and progress: called again, only events that came since are taken in.
    """
    state = IntervalState(events.sparkSession, f"{folder}/state", **options)
    query = events.writeStream.foreachBatch(state.advance).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").start()
    query.awaitTermination()
    return state
