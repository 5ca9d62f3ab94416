"""Streaming operators run over the driver tables to their end.

Output of a run goes to a fresh folder below the shared checkpoint folder and is read back as a
table. Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.extraction import ITEM_COLUMNS
from threadloom.plans import contexts as C
from threadloom.plans import exports as E
from threadloom.plans.registry import ORACLES as _EXTRACTED
from threadloom.plans import sessions as L
from threadloom.plans.inputs import LEXICON
from threadloom.plans.registry import query, run_folder, table, texts
from threadloom.streaming import idle_sessions as Z
from threadloom.sources import sessions as S
from threadloom.streaming import landing, upserts
from threadloom.streaming.snapshots import BucketedSnapshot


def finish(stream: DataFrame, folder: str, each) -> None:
    """Run a stream over all input there is, then stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


_WINDOWS = (
    "WITH g AS (SELECT user_id AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), "
    "n AS (SELECT path, ts, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) "
    "SELECT path, min(ts) AS started, max(ts) AS ended, count(*) AS entries FROM n GROUP BY path, s"
)


@query("z1_session_windows", _WINDOWS)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts")
    return Z.session_windows(rows, "6 hours")


def event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("z1_session_windows_stream", _WINDOWS)
def _(spark, sf_dir):
    folder = run_folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{folder}/landing")
    closed = Z.session_windows(spark.readStream.schema(rows.schema).parquet(f"{folder}/landing"), "6 hours", lateness="1 day")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    finish(closed, folder, keep)
    # an entry of no session, long after the last one, lets the watermark pass every open window
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 7 DAY")).alias("ts")).select(F.lit(None).cast(rows.schema["path"].dataType).alias("path"), "ts")
    end.write.mode("append").parquet(f"{folder}/landing")
    finish(closed, folder, keep)
    local = {c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}
    return spark.read.parquet(f"{folder}/out").drop("batch").withColumns(local)


_IDLE_MS = 6 * 3_600_000
_IDLE = (
    f"{L._E.replace(' FROM events', ', epoch_us(ts) AS us FROM events')}, mid AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS us FROM events), "
    "early AS (SELECT e.* FROM e, mid WHERE e.us < mid.us), "
    f"paused AS (SELECT path FROM early GROUP BY path HAVING max(us) // 1000 + {_IDLE_MS} < (SELECT max(us) // 1000 FROM early)), "
    "gone_on AS (SELECT DISTINCT path FROM e, mid WHERE e.us >= mid.us), "
    "emitted AS (SELECT 1 AS emission, early.* FROM early JOIN paused USING (path) UNION ALL "
    "SELECT CASE WHEN path IN (SELECT path FROM paused) THEN 2 ELSE 1 END AS emission, e.* FROM e WHERE path IN (SELECT path FROM gone_on) OR path NOT IN (SELECT path FROM paused)) "
    "SELECT path, emission, count(*) AS message_count, coalesce(min(timestamp) FILTER (tool IS NULL), '') AS started_at, coalesce(arg_min('b' || (k % 3), seq), '') AS git_branch, "
    f"count(DISTINCT k) FILTER (tool IN ('Write', 'Edit')) AS files_changed, coalesce(arg_max({L._ACTION}, seq) FILTER (tool IS NOT NULL), '') AS last_action, "
    "least(20, count(DISTINCT k) FILTER (tool = 'Bash')) AS commands, "
    "CASE WHEN arg_max(k, seq) FILTER (tool IS NOT NULL AND seq % 3 = 0) >= 1 THEN least(100, CAST(round_even((arg_max(k, seq) FILTER (tool IS NOT NULL AND seq % 3 = 0) * 1000 + 7) / 2000.0, 0) AS INTEGER)) END AS context_usage_pct "
    "FROM emitted GROUP BY path, emission"
)


@query("z1_idle_summaries", f"WITH {_IDLE}")
def _(spark, sf_dir):
    """Half the log lands, sessions go idle and are summarised; the rest lands, and those that go on are summarised anew."""
    folder = run_folder(spark)
    lines = L.session_lines(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts")), "seq")
    us = F.unix_micros("ts")
    mid, last = lines.agg(F.floor((F.min(us) + F.max(us)) / 2), F.max(us)).first()
    end = lines.filter(us == last).limit(1).withColumns({"path": F.lit("/logs/end.jsonl"), "ts": F.col("ts") + F.expr("INTERVAL 30 DAY"), "line": F.lit('{"type": "user", "message": {"content": "end"}}')})
    each = Z.summarise_idle(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    with Z.keyed_state(spark):
        for wave in (lines.filter(us < mid), lines.filter(us >= mid), end):
            wave.write.mode("append").parquet(f"{folder}/landing")
            landed = spark.readStream.schema(lines.schema).parquet(f"{folder}/landing")
            finish(Z.idle_sessions(S.read_session_entries(landed), _IDLE_MS / 1000, at="ts"), folder, each)
    by_batch = Window.partitionBy("path").orderBy("batch")
    return spark.read.parquet(f"{folder}/out").select(
        "path", F.row_number().over(by_batch).cast("bigint").alias("emission"), "message_count", "started_at", "git_branch", "files_changed", "last_action",
        F.size("commands_run").cast("bigint").alias("commands"), "context_usage_pct",
    )


_LANDED = _EXTRACTED["flagship_export_to_summary"]


@query("z2_landing_ingest", f"SELECT conv_id, decisions, tasks, constraints, open_questions FROM ({_LANDED})")
def _(spark, sf_dir):
    folder = run_folder(spark)
    source = F.when(F.crc32("path") % 2 == 0, "claude").otherwise("chatgpt")
    payload = F.concat(F.lit('{"source": "'), source, F.lit('", "conversation": '), "content", F.lit("}"))
    bad = table(spark, sf_dir, "conversations").filter("role = 'system'").select(F.lit('{"source": "other", "conversation": {"a": 1}}').alias("value"))
    E.claude_files(spark, sf_dir).select(payload.alias("value")).unionByName(bad).write.text(f"{folder}/landing")
    arriving = spark.readStream.text(f"{folder}/landing").select(F.concat_ws("#", "_metadata.file_path", F.xxhash64("value")).alias("path"), "value")

    def keep(name: str):
        return lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")

    finish(arriving, folder, landing.landing_ingest(keep("items"), keep("rejects"), LEXICON))
    items = spark.read.parquet(f"{folder}/items")
    names = {"decision": "decisions", "task": "tasks", "constraint": "constraints", "open_question": "open_questions"}
    return items.groupBy("conv_id").agg(*[F.count_if(F.col("section") == s).alias(n) for s, n in names.items()])


@query("z2_landing_rejects", (
    "SELECT error, CASE WHEN error = 'read' THEN count(DISTINCT l_orderkey) ELSE count(*) END AS n FROM (SELECT l_orderkey, CASE l_linenumber % 6 WHEN 0 THEN 'Invalid JSON' WHEN 1 THEN 'Unknown source ' || chr(39) || 'other' || chr(39) "
    "WHEN 2 THEN chr(39) || 'conversation' || chr(39) || ' field is required' WHEN 5 THEN 'read' ELSE 'No messages found in conversation' END AS error FROM lineitem) GROUP BY 1"
))
def _(spark, sf_dir):
    folder = run_folder(spark)
    bodies = [
        "{broken", '{"source": "other", "conversation": {"a": 1}}', '{"source": "claude"}', '{"source": "claude", "conversation": {"chat_messages": "oops"}}',
        '{"source": "gemini", "conversation": {"title": "no activity"}}', '{"source": "claude", "conversation": {"uuid": "@", "chat_messages": [{"sender": "human", "text": "TODO: add a test for the loader"}]}}',
    ]
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    path = F.concat_ws("-", "l_orderkey", "l_linenumber")
    texts(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(path.alias("path"), F.replace(body, F.lit("@"), path).alias("value")).write.parquet(f"{folder}/landing")
    stream = spark.readStream.schema("path STRING, value STRING").parquet(f"{folder}/landing")

    def keep(name: str):
        return lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")

    finish(stream, folder, landing.landing_ingest(keep("items"), keep("rejects"), LEXICON))
    counted = spark.read.parquet(f"{folder}/rejects").groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    read = spark.read.parquet(f"{folder}/items").agg(F.count_distinct("conv_id").alias("n"))
    return counted.unionByName(read.select(F.lit("read").alias("error"), "n"))


@query("z3_incremental_context_upsert", (
    f"WITH {C._DELTA} SELECT project_id, section, seq, label, text FROM saved UNION ALL SELECT project_id, section, seq, label, text FROM added"
))
def _(spark, sf_dir):
    folder = run_folder(spark)
    saved, fresh = C.saved_and_fresh(spark, sf_dir)
    fresh.write.parquet(f"{folder}/fresh")
    saved.select("project_id", *ITEM_COLUMNS).write.parquet(f"{folder}/snapshot/version=0")
    each = upserts.incremental_upsert(
        lambda n: spark.read.parquet(f"{folder}/snapshot/version={n}"),
        lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/snapshot/version={n + 1}"),
        lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/conflicts/batch={n}"),
        lambda: C.TODAY,
    )
    finish(spark.readStream.schema(spark.read.parquet(f"{folder}/fresh").schema).parquet(f"{folder}/fresh"), folder, each)
    latest = spark.read.parquet(f"{folder}/snapshot")
    return latest.join(latest.agg(F.max("version").alias("version")), "version").select("project_id", "section", F.col("ord.seq").alias("seq"), "label", "text")


@query("z3_bucketed_upsert", (
    f"WITH {C._DELTA} SELECT project_id, section, seq, label, text, 0 AS conflict FROM saved UNION ALL SELECT project_id, section, seq, label, text, 0 FROM added "
    "UNION ALL SELECT project_id, 'decision', seq, label, text, 1 FROM revised"
))
def _(spark, sf_dir):
    """Two batches on a snapshot of eight buckets, the second of one bucket's projects alone."""
    folder = run_folder(spark)
    saved, fresh = C.saved_and_fresh(spark, sf_dir)
    snapshot = BucketedSnapshot(f"{folder}/snapshot", buckets=8)
    snapshot.commit(saved.select("project_id", *ITEM_COLUMNS), "start")
    conflicts = f"{folder}/conflicts"
    each = upserts.bucketed_upsert(snapshot, lambda df, n: df.write.mode("overwrite").parquet(f"{conflicts}/batch={n}"), lambda: C.TODAY, "fresh")
    for wave in (fresh.filter(snapshot.bucket() > 0), fresh.filter(snapshot.bucket() == 0)):
        wave.write.mode("append").parquet(f"{folder}/fresh")
        finish(spark.readStream.schema(fresh.schema).parquet(f"{folder}/fresh"), folder, each)
    shown = ["project_id", "section", F.col("ord.seq").alias("seq"), "label", "text"]
    items, revised = snapshot.read(spark).select(*shown), spark.read.parquet(conflicts).select(*shown)
    return items.withColumn("conflict", F.lit(0)).unionByName(revised.withColumn("conflict", F.lit(1)))
