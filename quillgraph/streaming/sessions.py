"""Streams of document updates: debounce, change detection, and document sessions.

Sessions keep their state in buckets of documents. A micro-batch writes new versions of the
buckets that it touches and a list of the version of each bucket, so it costs what its buckets
hold, and one that runs again after a failure starts from the state before it and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillgraph.operators import graph, sync
from quillgraph.plans.work import work_dir
from quillgraph.sources import sidecar

EVENTS = "doc_id string, seq long, event string, entity_id string, detail string"
#: Milliseconds. An editor's pause, and the pause and longest wait of callbacks.
EDITOR_PAUSE, CALLBACK_PAUSE, CALLBACK_MOST = 150, 500, 2000


def skip_empty(updates: DataFrame, text: str = "text") -> DataFrame:
    return updates.where(F.coalesce(F.trim(text), F.lit("")) != "")


def consecutive_changes(updates: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Updates whose value differs from the one before it of the same key; A, B, A are three."""
    schema = updates.select(key, *order, value).schema
    fields = schema.fieldNames()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(order, kind="stable")
        values = rows[value].tolist()
        last = state.get[0] if state.exists else None
        keep = [v != (values[i - 1] if i else last) for i, v in enumerate(values)]
        if values:
            state.update((values[-1],))
        yield rows[keep][fields]

    return updates.select(key, *order, value).groupBy(key).applyInPandasWithState(run, schema, f"last {schema[value].dataType.simpleString()}", "append", GroupStateTimeout.NoTimeout)


def debounce(updates: DataFrame, key: str, value: str, time: str = "ts", pause: str = "150 milliseconds", late: str = "0 seconds") -> DataFrame:
    """The last value before each pause: one row a session, when the watermark is past it."""
    sessions = updates.withWatermark(time, late).groupBy(key, F.session_window(time, pause).alias("w"))
    found = sessions.agg(F.max_by(value, time).alias(value), F.count("*").alias("n_updates"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), value, "n_updates")


def fire_times(times: list[int], pause: int, most: int) -> list[tuple[int, int]]:
    """(index of the last update, time) of each callback: after a pause, or when the first update has waited for `most`."""
    out: list[tuple[int, int]] = []
    first = None
    for i, t in enumerate(times):
        if first is not None and t >= min(times[i - 1] + pause, first + most):
            out.append((i - 1, min(times[i - 1] + pause, first + most)))
            first = None
        if first is None:
            first = t
    if first is not None:
        out.append((len(times) - 1, min(times[-1] + pause, first + most)))
    return out


def debounce_most(updates: DataFrame, key: str, value: str, time: str = "ts", pause: int = CALLBACK_PAUSE, most: int = CALLBACK_MOST, late: str = "0 seconds") -> DataFrame:
    """Callbacks (key, fired_ms, value) with a longest wait, in the updates' own time.

    The wait that is open when a batch ends is kept as state, with a timer at the time
    it fires: the next update of its key or the watermark, whichever comes first, shows
    that it has fired. Updates later than `late` behind the newest are dropped, as in
    `debounce`; of updates of one millisecond the largest value counts.
    """
    kind = updates.schema[value].dataType.simpleString()
    schema = f"{key} {updates.schema[key].dataType.simpleString()}, fired_ms long, {value} {kind}"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["__ms", value], kind="stable")
        held = list(zip(*state.get)) if state.exists else []
        all_rows = sorted(held + list(zip(rows["__ms"].tolist(), rows[value].tolist())), key=lambda r: r[0])
        fired = fire_times([t for t, _ in all_rows], pause, most)
        done = fired if state.hasTimedOut else fired[:-1]
        rest = all_rows[(done[-1][0] + 1 if done else 0) :]
        if rest:
            state.update(([t for t, _ in rest], [v for _, v in rest]))
            # Rows at the watermark or after it have a wait that ends after it.
            state.setTimeoutTimestamp(fired[-1][1])
        else:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(done), "fired_ms": [t for _, t in done], value: [all_rows[i][1] for i, _ in done]})

    timed = updates.withWatermark(time, late).select(key, time, F.unix_millis(time).alias("__ms"), value)
    return timed.groupBy(key).applyInPandasWithState(run, schema, f"times array<long>, held array<{kind}>", "append", GroupStateTimeout.EventTimeTimeout)


def replay(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table, and read the table."""
    spark = stream.sparkSession
    out, marks = work_dir(spark, name), work_dir(spark, f"{name}-marks")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class SessionStore:
    """Open documents with their entities and triples. `process` is a sink for `foreachBatch`.

    Updates are rows (doc_id, seq, kind, source, sidecar) of kinds open, update and
    close; of several updates of a document in one batch the last counts, as after a
    pause. Opening an open document changes nothing. An update without a source is a
    `parse-error` and keeps the old state; rows without a doc_id are left out.

    State is dealt to `buckets` by a hash of doc_id; a batch reads and writes those of
    its own documents. Choose the number so that one bucket fits a few tasks; it is also
    the bound of what the driver lists.
    """

    TABLES = ("docs", "entities", "triples")

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path or work_dir(spark, "sessions"), buckets
        self.version = 0
        none = spark.createDataFrame([], sidecar.GRAPH)
        empty = (spark.createDataFrame([], "doc_id string, source string"), sidecar.entities_of(none), sidecar.triples_of(none))
        self.schemas = {name: df.schema for name, df in zip(self.TABLES, empty)}
        self._save(0, dict.fromkeys(range(buckets), 0), *empty)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _save(self, version: int, held: dict[int, int], *tables: DataFrame) -> None:
        """Write tables as `version`, then which version holds each bucket: without that list a version doesn't count."""
        for name, df in zip(self.TABLES, tables):
            df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/v={version}")
        self.spark.createDataFrame(sorted(held.items()), "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/v{version}")

    def _held(self, version: int) -> dict[int, int]:
        return {r["bucket"]: r["v"] for r in self.spark.read.parquet(f"{self.path}/held/v{version}").collect()}

    def _read(self, name: str, held: dict[int, int]) -> DataFrame:
        """Buckets of a table, each from its version: one scan, pruned by partition."""
        schema, base = self.schemas[name], f"{self.path}/{name}"
        if not held:
            return self.spark.createDataFrame([], schema)
        of = {v: sorted(b for b in held if held[b] == v) for v in sorted(set(held.values()))}
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("v", LongType()), StructField("bucket", IntegerType())])).option("basePath", base).parquet(*(f"{base}/v={v}" for v in of))
        wanted = reduce(Column.__or__, ((F.col("v") == v) & F.col("bucket").isin(buckets) for v, buckets in of.items()))
        return rows.where(wanted).select(*schema.fieldNames())

    def _forget(self, old: dict[int, int], held: dict[int, int]) -> None:
        """Delete buckets of versions that neither the state before a batch nor the one after it holds."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for name in self.TABLES:
            for b in (b for b in old if old[b] != held[b]):
                at = path(f"{self.path}/{name}/v={old[b]}/bucket={b}")
                at.getFileSystem(conf).delete(at, True)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the state; of older versions only the one before the last batch is kept."""
        return self._read(name, self._held(self.version if version is None else version))

    def process(self, batch: DataFrame, epoch: int) -> None:
        """State v(epoch) and this batch give state v(epoch + 1) and events; running an epoch again gives the same."""
        batch = batch.where("doc_id is not null")
        held = self._held(epoch)
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}
        docs, entities, triples = (self._read(n, {b: held[b] for b in touched}) for n in self.TABLES)
        unread = batch.where("kind = 'update' and source is null").join(docs.select("doc_id"), "doc_id", "left_semi")
        batch = batch.where("not (kind = 'update' and source is null)")
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct("seq", "kind", "source", "sidecar"), "seq").alias("u")).select("doc_id", "u.*")
        opened = batch.where("kind = 'open'").join(docs, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(F.struct("seq", "source", "sidecar"), "seq").alias("u")).select("doc_id", "u.*")
        graphs = sidecar.parse_sidecars(opened.where("sidecar is not null").select("doc_id", F.col("sidecar").alias("text"))).persist()
        at = opened.select("doc_id", "seq")
        events = [
            opened.select("doc_id", "seq", F.lit("document-opened").alias("event"), F.lit("").alias("entity_id"), F.length("source").cast("string").alias("detail")),
            graphs.where("error is not null").join(at, "doc_id").select("doc_id", "seq", F.lit("sidecar-error").alias("event"), F.lit("").alias("entity_id"), F.col("error").alias("detail")),
            unread.select("doc_id", "seq", F.lit("parse-error").alias("event"), F.lit("").alias("entity_id"), F.lit("no source").alias("detail")),
        ]
        entities = entities.unionByName(sidecar.entities_of(graphs))
        triples = triples.unionByName(sidecar.triples_of(graphs))
        docs = docs.unionByName(opened.select("doc_id", "source"))
        changed = last.where("kind = 'update'").join(docs.withColumnRenamed("source", "old_source"), "doc_id").select("doc_id", "seq", "old_source", F.col("source").alias("new_source"))
        moved = sync.sync(entities.join(changed, "doc_id", "left_semi"), triples.join(changed, "doc_id", "left_semi"), changed)
        entities = entities.join(changed, "doc_id", "left_anti").unionByName(moved.select(*entities.columns))
        docs = docs.join(changed, "doc_id", "left_anti").unionByName(changed.select("doc_id", F.col("new_source").alias("source")))
        closed = last.where("kind = 'close'").select("doc_id")
        docs, entities, triples = (d.join(closed, "doc_id", "left_anti") for d in (docs, entities, triples))
        after = held | dict.fromkeys(touched, epoch + 1)
        self._save(epoch + 1, after, docs, entities, triples)
        docs, entities, triples = (self._read(n, dict.fromkeys(touched, epoch + 1)) for n in self.TABLES)
        seqs = last.select("doc_id", "seq").join(docs.select("doc_id"), "doc_id")
        status = graph.status_counts(seqs, entities, triples)
        events += [
            entities.join(seqs, "doc_id").select("doc_id", "seq", F.lit("entities-updated").alias("event"), "entity_id", sidecar.anchor_text(F.col("span_start"), F.col("span_end")).alias("detail")),
            status.join(seqs, "doc_id").select("doc_id", "seq", F.lit("sidecar-status").alias("event"), F.lit("").alias("entity_id"), F.concat_ws(",", "synced", "stale", "detached", "total_triples").alias("detail")),
            graph.stale_report(entities, docs).join(seqs, "doc_id").select("doc_id", "seq", F.lit("stale-anchors").alias("event"), "entity_id", F.col("new_text").alias("detail")),
        ]
        out = events[0]
        for more in events[1:]:
            out = out.unionByName(more)
        out.write.mode("overwrite").parquet(f"{self.path}/events/epoch={epoch}")
        graphs.unpersist()
        if epoch:
            self._forget(self._held(epoch - 1), held)
        self.version = epoch + 1

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events")

    def is_open(self) -> DataFrame:
        """Ids of open documents."""
        return self.table("docs").select("doc_id")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process all of a stream that is there now; returns the events."""
        marks = work_dir(self.spark, "session-marks")
        stream.writeStream.foreachBatch(self.process).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return self.events()


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> None:
    """One frame of events for each kind that has a sink."""
    for kind, sink in sinks.items():
        sink(events.where(F.col("event") == kind))
