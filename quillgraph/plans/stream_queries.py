"""Queries that run streams over all that is there, and read what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.plans.corpus import table
from quillgraph.plans.work import work_dir
from quillgraph.streaming import sessions

ALL: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        ALL[name] = (fn, sql)
        return fn

    return put


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type")
def stream_dedupe(spark, sf):
    changed = sessions.consecutive_changes(event_stream(spark, sf), "user_id", "event_type", ["ts", "event_id"])
    return sessions.replay(changed, "changes").select("user_id", "event_id", "event_type")


@query("hash_text_dedupe", "SELECT user_id, count(*) AS n FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> value GROUP BY user_id")
def hash_text_dedupe(spark, sf):
    hashed = event_stream(spark, sf).withColumn("digest", F.xxhash64("value"))
    changed = sessions.consecutive_changes(hashed, "user_id", "digest", ["ts", "event_id"])
    return sessions.replay(changed, "hashes").groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_skip_empty", "SELECT event_id FROM events WHERE trim(event_type) <> '' AND event_type <> 'click'")
def stream_skip_empty(spark, sf):
    blanked = event_stream(spark, sf).withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type")).otherwise("  "))
    return sessions.replay(sessions.skip_empty(blanked, "event_type").select("event_id"), "kept")


@query("stream_debounce_editor", """WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM g),
 f AS (SELECT user_id, w, max(epoch_us(ts)) AS last_us, count(*) AS n_updates FROM s GROUP BY ALL) SELECT user_id, n_updates, last_us FROM f WHERE (last_us + 600000000) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events)""")
def stream_debounce_editor(spark, sf):
    found = sessions.debounce(event_stream(spark, sf), "user_id", "event_id", "ts", "10 minutes")
    out = sessions.replay(found, "pauses")
    return out.select("user_id", "n_updates", (F.unix_micros("end") - 600000000).alias("last_us"))


@query("stream_debounce_callback", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
 w AS (SELECT user_id, event_id, i, ms, ms AS began FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, e.ms, CASE WHEN e.ms >= least(w.ms + 600000, w.began + 3600000) THEN e.ms ELSE w.began END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1),
 f AS (SELECT user_id, began, max(i) AS i, arg_max(event_id, i) AS event_id, least(max(ms) + 600000, began + 3600000) AS fired_ms FROM w GROUP BY user_id, began)
 SELECT user_id, fired_ms, event_id FROM f WHERE fired_ms < (SELECT max(epoch_us(ts) // 1000) FROM events) OR EXISTS (FROM e WHERE e.user_id = f.user_id AND e.i = f.i + 1)""")
def stream_debounce_callback(spark, sf):
    return sessions.replay(sessions.debounce_most(event_stream(spark, sf), "user_id", "event_id", "ts", 600_000, 3_600_000), "callbacks")


UPDATES_SQL = "u AS (SELECT c_custkey::VARCHAR AS doc_id, c_custkey AS k, c_name, strlen(c_name) AS n FROM customer)"


def updates(spark, sf):
    """Three batches of updates a customer's document: opened with a sidecar, words put before it, closed for some."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.cast("string").alias("doc_id"), k.alias("k"), "c_name")
    side = F.concat(F.lit('@source-hash "sha256:00" .\n_:w [0..'), F.octet_length("c_name").cast("string"), F.lit('] a schema:Person ; sd:snippet "'), "c_name", F.lit('" .\n_:d [0..] sd:about _:w .\n'))
    side = F.when(F.col("k") % 10 == 9, F.lit("no sidecar")).otherwise(side)
    opened = c.select("doc_id", F.lit(1).cast("long").alias("seq"), F.lit("open").alias("kind"), F.concat("c_name", F.lit(" here")).alias("source"), side.alias("sidecar"))
    moved = c.where("k % 2 = 0").select("doc_id", F.lit(2).cast("long").alias("seq"), F.lit("update").alias("kind"), F.concat(F.lit("Hi "), "c_name", F.lit(" here")).alias("source"), F.lit(None).cast("string").alias("sidecar"))
    closed = c.where("k % 5 = 0").select("doc_id", F.lit(3).cast("long").alias("seq"), F.lit("close").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("sidecar"))
    return opened, moved, closed


def update_stream(spark, sf):
    """The batches as files that a stream reads one at a time, in order."""
    folder = work_dir(spark, "updates")
    for batch in updates(spark, sf):
        batch.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_sessions(spark, sf):
    store = sessions.SessionStore(spark)
    return store, store.run(update_stream(spark, sf))


@query("stream_update_source", f"WITH {UPDATES_SQL} SELECT doc_id, 1::BIGINT AS seq, 'w' AS entity_id, '[0..' || n || ']' AS span FROM u WHERE k % 10 <> 9 UNION ALL SELECT doc_id, 2, 'w', '[3..' || n + 3 || ']' FROM u WHERE k % 2 = 0")
def stream_update_source(spark, sf):
    _, events = run_sessions(spark, sf)
    return events.where("event = 'entities-updated' and entity_id = 'w'").select("doc_id", "seq", "entity_id", F.col("detail").alias("span"))


@query("sink_events", f"WITH {UPDATES_SQL} SELECT 'document-opened' AS event, count(*) AS n FROM u UNION ALL SELECT 'sidecar-error', count(*) FILTER (k % 10 = 9) FROM u UNION ALL SELECT 'sidecar-status', count(*) + count(*) FILTER (k % 2 = 0) FROM u UNION ALL SELECT 'entities-updated', 2 * (count(*) FILTER (k % 10 <> 9) + count(*) FILTER (k % 2 = 0)) FROM u")
def sink_events(spark, sf):
    return run_sessions(spark, sf)[1].groupBy("event").agg(F.count("*").alias("n"))


@query("session_registry", f"WITH {UPDATES_SQL} SELECT doc_id FROM u WHERE k % 5 <> 0")
def session_registry(spark, sf):
    return run_sessions(spark, sf)[0].is_open()


@query("session_state", f"WITH {UPDATES_SQL} SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'Hi ' ELSE '' END || c_name || ' here' AS source FROM u WHERE k % 5 <> 0")
def session_state(spark, sf):
    return run_sessions(spark, sf)[0].table("docs")


@query("stream_reconnect", "SELECT c_custkey FROM customer")
def stream_reconnect(spark, sf):
    """A stream that stops and starts again from its checkpoint, with more data there: each row once."""
    source, out, marks = (work_dir(spark, f"reconnect-{n}") for n in ("in", "out", "marks"))
    customers = table(spark, sf, "customer").select("c_custkey")
    for half in (0, 1):
        customers.where(F.col("c_custkey") % 2 == half).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(customers.schema).parquet(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(customers.schema).parquet(out)
