"""Streams over append-only logs; each sink's final state equals the batch operator over the whole log."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.closure import extend_closure
from ..sources.ntriples import append_new


def ingest_stream(spark: SparkSession, source: str, schema, sink: str, keys: list[str], checkpoint: str, by: Column | None = None, parts: int = 64):
    """Files of ``source`` appended to the Parquet table ``sink``, keys already there left out.

    The table is dealt to folders by ``by``, an expression over the keys (else by their hash to ``parts`` folders): a batch is compared with
    the folders of its own keys only.  Each run (named by its checkpoint) and batch writes to folders of its own and overwrites them, so a
    batch that runs again after a failure counts once, and a new run never touches an older one's rows.  A batch's done marker is Spark's
    own commit file, written last.
    """
    from ..functions.shared import cut

    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    part = (F.pmod(F.xxhash64(*keys), F.lit(parts)) if by is None else by).cast("string")
    kinds = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema), *T.StructType.fromDDL("part string, run string, batch long")])

    def write(batch: DataFrame, number: int) -> None:
        new = cut(batch.dropDuplicates(keys).withColumn("part", part))
        folders = [r.part for r in new.select("part").distinct().collect()]  # folder names, not keys
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if folders and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            there = spark.read.schema(kinds).parquet(sink).where(F.col("part").isin(folders) & ((F.col("run") != run) | (F.col("batch") < number)))
            new = append_new(new, there, keys)
        new = cut(new.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number).cast("long")))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "run", "batch").parquet(sink)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now goes through the stream into the shared folder; the rows of its batches (the last one if complete)."""
    from ..functions.shared import new_path

    spark = stream.sparkSession
    path, last = new_path(spark, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:  # nothing was there
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{path}/batch={last[-1]}") if mode == "complete" else rows.parquet(*[f"{path}/batch={k}" for k in sorted(set(last))])


def heads_stream(log: DataFrame) -> DataFrame:
    """Newest head of each (perspective, subject) as a streaming aggregate; the later of equal times by digest."""
    return log.groupBy("perspective", "subject").agg(F.max(F.struct("ts", "head")).alias("m")).select("perspective", "subject", "m.ts", "m.head")


QUORUM = "review long, present long, reached boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class keyed_state:  # noqa: N801  used as `with keyed_state(spark):` around the start of a query
    """State that is kept by key on disk, which map state and timers need, for queries that start inside; then as it was."""

    name = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.name, None)
        self.conf.set(self.name, ROCKS)

    def __exit__(self, *_):
        self.conf.unset(self.name) if self.before is None else self.conf.set(self.name, self.before)


class Quorum(StatefulProcessor):
    """Distinct voters of a review: one entry a voter, so a batch reads and writes only the voters that it has."""

    def __init__(self, needed: int):
        self.needed = needed

    def init(self, handle):
        self.voters = handle.getMapState("voters", "reviewer long", "seen boolean")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        before = n = self.count.get()[0] if self.count.exists() else 0
        for f in rows:
            for x in f.loc[f["vote"] != "absent", "reviewer"].unique():
                if not self.voters.containsKey((int(x),)):
                    self.voters.updateValue((int(x),), (True,))
                    n += 1
        if n != before:
            self.count.update((n,))
            yield pd.DataFrame({"review": [key[0]], "present": [n], "reached": [n >= self.needed]})

    def close(self):
        pass


def quorum_stream(votes: DataFrame, needed: int) -> DataFrame:
    """(review, present, reached) again whenever a review's distinct voters change; start it inside ``keyed_state``."""
    return votes.groupBy("review").transformWithStateInPandas(Quorum(needed), QUORUM, "Update", "None")


class Steps(StatefulProcessor):
    """Tells of each step of a bucket of keys when event time has passed it, without a further row of its key.

    Steps that wait are kept as pieces, one for the rows that came together, each with the steps of many keys; only the next time at which any
    is due has a timer.  When it is over the pieces are read, and what isn't due yet is put back as one.
    """

    kept = pa.schema([("key", pa.int64()), ("state", pa.string()), ("at", pa.int64())])

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "steps binary")
        self.next = handle.getValueState("next", "at long")

    def piece(self, steps):
        return (pa.RecordBatch.from_pandas(steps, self.kept, preserve_index=False).serialize().to_pybytes(),)

    def wake(self, at):
        """A timer for steps due at ``at``, in place of one for later."""
        before = self.next.get()[0] if self.next.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        first = []
        for f in rows:
            wait = f["waits"].to_numpy(bool)
            if not wait.all():
                yield f.loc[~wait, self.kept.names].assign(bucket=key[0])
            if wait.any():
                steps = f.loc[wait, self.kept.names]
                self.waiting.appendValue(self.piece(steps))
                first.append(int(steps["at"].min()) // 1000)
        if first:
            self.wake(min(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        steps = pa.Table.from_batches([pa.ipc.read_record_batch(x, self.kept) for (x,) in self.waiting.get()]).to_pandas()
        over = (steps["at"] // 1000 <= timerValues.getCurrentWatermarkInMs()).to_numpy()
        self.next.clear()
        if over.all():
            self.waiting.clear()
        else:
            rest = steps[~over]
            self.waiting.put([self.piece(rest)])
            self.wake(int(rest["at"].min()) // 1000)
        if over.any():
            yield steps[over].assign(bucket=key[0])

    def close(self):
        pass


def steps_stream(rows: DataFrame, late: str, buckets: int = 256) -> DataFrame:
    """(key, state, ts) for each step of each key's schedule as event time passes it.

    ``rows``: key (long), ts and steps (array of state and at; one without ``at`` comes with the row).  The first row of a key has its schedule;
    rows that come again change nothing.  Rows later than ``late`` behind the newest are left out by the watermark, and steps are told once the
    watermark has reached them, to the millisecond.  Keys are told apart by Spark's own state; their steps wait in ``buckets`` of many keys.
    Start it inside ``keyed_state``.
    """
    first = rows.select("key", F.col("ts").cast("timestamp").alias("ts"), "steps").withWatermark("ts", late).dropDuplicates(["key"])
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))  # no nulls among keys: pandas would take them all for floats
    each = first.select(bucket.alias("bucket"), F.coalesce("key", F.lit(0)).alias("key"), "ts", F.explode("steps").alias("step"))
    at = F.col("step.at").cast("timestamp")
    each = each.select("bucket", "key", "ts", "step.state", F.unix_micros(F.coalesce(at, "ts")).alias("at"), at.isNotNull().alias("waits"))
    told = each.groupBy("bucket").transformWithStateInPandas(Steps(), "bucket long, key long, state string, at long", "Append", "EventTime")
    return told.select(F.when(F.col("bucket") >= 0, F.col("key")).alias("key"), "state", F.timestamp_micros("at").alias("ts"))


def token_steps(issued: Column, delay: Column, life: Column) -> Column:
    """Schedule of a token: early until ``delay`` seconds are over, then active for ``life`` seconds, then expired."""
    at = lambda s: F.timestamp_millis(F.unix_millis(issued.cast("timestamp")) + (s * 1000).cast("long"))
    return F.array(F.struct(F.lit("early").alias("state"), F.lit(None).cast("timestamp").alias("at")), F.struct(F.lit("active").alias("state"), at(delay).alias("at")), F.struct(F.lit("expired").alias("state"), at(delay + life).alias("at")))


def review_steps(closes: Column) -> Column:
    """Schedule of a review: open at once, closed when its time is over."""
    return F.array(F.struct(F.lit("open").alias("state"), F.lit(None).cast("timestamp").alias("at")), F.struct(F.lit("closed").alias("state"), closes.cast("timestamp").alias("at")))


def run_timers(rows: DataFrame, late: str) -> DataFrame:
    """All that is there now through ``steps_stream``, timers included, into the shared folder."""
    with keyed_state(rows.sparkSession):
        return run_to_end(steps_stream(rows, late), "append")


def token_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each kind by hour of event time; rows later than ``late`` behind the newest are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def audit_stream(changes: DataFrame, path: str, checkpoint: str):
    """Permission changes appended as they come."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def follow_stream(events: DataFrame, follows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Notices from a stream of events (subject, event_type, ts): followers of the subject who asked for that kind of event.

    ``follows``: (follower, target, subject), ``kinds``: (follower, event_type); both are tables that the stream is joined to.
    """
    return follow_fanout(events, follows).join(kinds, ["follower", "event_type"])


def follow_fanout(events: DataFrame, follows: DataFrame) -> DataFrame:
    """Notices for followers of an event's subject or of what it is part of; ``follows`` has (follower, target, subject)."""
    return events.join(follows, "subject").select("follower", "target", "subject", "event_type", "ts")


def follow_ancestors(events: DataFrame, closure: DataFrame, follows: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices of a batch of ``events`` (subject, part_of, event_type, ts) for followers of the subject or of anything that it is part of.

    ``closure``: (node, ancestor) so far; ``follows``: (follower, target); ``kinds``: (follower, event_type) that each wants to hear of.
    Also the pairs by which the closure grows: subjects of the batch below what they are part of.
    """
    new = extend_closure(closure, events.where("part_of is not null").select(F.col("subject").alias("a"), F.col("part_of").alias("b")))
    above = events.select("subject").distinct()
    above = above.select("subject", F.col("subject").alias("target")).union(
        above.join(closure.unionByName(new).withColumnRenamed("node", "subject"), "subject").select("subject", F.col("ancestor").alias("target"))
    ).distinct()
    heard = events.join(above, "subject").join(follows, "target").join(kinds, ["follower", "event_type"])
    return heard.select("follower", "target", "subject", "event_type", "ts"), new


def follow_ancestors_stream(events: DataFrame, closure: str, follows: DataFrame, kinds: DataFrame, notices: str, checkpoint: str):
    """Notices of a stream of events into the table ``notices``; the table ``closure`` (node, ancestor) grows by each batch's new pairs.

    A batch reads the pairs of earlier batches (batch -1 holds those from the start) and overwrites its own folder in both tables.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        known = spark.read.schema("node string, ancestor string, batch long").parquet(closure).where(F.col("batch") < number).select("node", "ancestor")
        heard, new = follow_ancestors(batch, known, follows, kinds)
        new.write.mode("overwrite").parquet(f"{closure}/batch={number}")
        heard.write.mode("overwrite").parquet(f"{notices}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
