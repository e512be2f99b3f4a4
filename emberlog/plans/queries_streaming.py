"""Registered plans on streams of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators.nextevent import NextEventModel
from emberlog.plans import detection, fixtures, queries_sequences, views
from emberlog.plans.queries_detectors import ORACLE as DETECTORS
from emberlog.plans.queries_detectors import SAME_DIRECTION, _vectors, directions_of
from emberlog.plans.queries_features import ORACLE as BATCH
from emberlog.plans.views import text
from emberlog.session import scratch_path
from emberlog.streaming import cluster, next_event, sink, windows


def _event_stream(spark, sf):
    """The events file as a stream with the same columns as ``fixtures.event_lines``."""
    raw = spark.readStream.schema(fixtures.EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return fixtures.line_columns(raw)


def stream_tw_counts(spark, sf):
    """Same counts as ``tw_grid``, computed incrementally."""
    timed = _event_stream(spark, sf).withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("string"), "UTC"))
    counts = windows.windowed_counts(timed, 24, 6)
    path = scratch_path(spark, "stream-counts")
    sink.run_available(counts, scratch_path(spark, "stream-state"), sink.batch_writer(path))
    table = sink.latest(spark.read.parquet(path), ["start", "event"], ["cnt", "bad"])
    return table.select(F.unix_timestamp("start").alias("start"), "event", "cnt", "bad")


def _clustered_stream(spark, sf, max_dist):
    """The cluster model after all micro-batches of session vectors."""
    _, vectors = _vectors(spark, sf)
    source = scratch_path(spark, "vectors-in")
    vectors.repartitionByRange(4, "first_line").select("session_id", "features").write.parquet(source)
    stream = (
        spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    )
    path = scratch_path(spark, "clusters")
    sink.run_available(stream, scratch_path(spark, "stream-state"), cluster.cluster_updater(path, max_dist), mode="append")
    return cluster.load_clusters(spark, path, cluster.last_version(spark, path))


def stream_cluster(spark, sf):
    """Representatives after all micro-batches."""
    model = _clustered_stream(spark, sf, 0.3)
    return model.reps.select("cluster", text(F.col("center").cast("array<string>")).alias("center"), "size")


def stream_directions(spark, sf):
    """Representatives at a tiny limit: one for each direction, however the batches were cut."""
    return directions_of(_clustered_stream(spark, sf, SAME_DIRECTION))


def stream_next_event(spark, sf):
    """Same hits as ``topg_hit``, with sessions arriving as a stream."""
    sequences = views.user_sequences(spark, sf)
    model = NextEventModel.fit(detection.train_windows(sequences), views.H).staged()
    test = sequences.where("split = 'test' and chunk = 0").select("session_id")
    rows = _event_stream(spark, sf).select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), "line_no", "event"
    )
    wins = next_event.stream_windows(rows.join(test, "session_id"), views.H)
    path = scratch_path(spark, "stream-hits")
    write = sink.batch_writer(path)

    def score(batch, batch_id):
        # Read twice below; the stateful step must run once.
        batch.persist()
        write(model.hits(batch, views.G).select("session_id", "pos", "hit"), batch_id)
        batch.unpersist()

    sink.run_available(wins, scratch_path(spark, "stream-state"), score, mode="append")
    return spark.read.parquet(path).select("session_id", "pos", F.col("hit").cast("int").alias("hit"))


IDLE_MINUTES = 12 * 60


def stream_next_event_idle(spark, sf):
    """Hits of a stream whose sessions end after half a day of silence; windows lie inside episodes."""
    sequences = views.user_sequences(spark, sf)
    model = NextEventModel.fit(detection.train_windows(sequences), views.H).staged()
    test = sequences.where("split = 'test' and chunk = 0").select("session_id")
    rows = _event_stream(spark, sf).select(
        F.concat(F.lit("u"), "user_id").alias("session_id"),
        "line_no",
        "event",
        F.to_utc_timestamp(F.col("ts").cast("string"), "UTC").alias("ts"),
    )
    wins = next_event.stream_windows(rows.join(test, "session_id"), views.H, IDLE_MINUTES)
    path = scratch_path(spark, "idle-windows")
    sink.run_available(wins, scratch_path(spark, "stream-state"), sink.batch_writer(path), mode="append")
    hits = model.hits(spark.read.parquet(path).drop("batch_id"), views.G)
    return hits.select("session_id", "episode", "pos", F.col("hit").cast("int").alias("hit"))


QUERIES = {f.__name__: f for f in (stream_tw_counts, stream_cluster, stream_directions, stream_next_event, stream_next_event_idle)}

EPISODES = """timed as (select r.session_id, r.line_no, r.event, ts,
    lag(ts) over (partition by r.session_id order by r.line_no) as before from user_rows r join ev using (line_no)),
opened as (select *, max(case when before is null or ts - before >= interval 12 hour then line_no end)
    over (partition by session_id order by line_no) as episode from timed),
episodes as (select session_id, episode, list(event order by line_no) as e from opened
    group by session_id, episode),
idle_wins as (select session_id, episode, i as pos, e[i + 1 : i + 4] as ctx, e[i + 5] as nxt from (
    select *, unnest(range(len(e) - 4)) as i from episodes where len(e) > 4))"""

ORACLE = {
    "stream_tw_counts": BATCH["tw_grid"],
    "stream_directions": DETECTORS["clu_online_directions"],
    "stream_next_event": queries_sequences.ORACLE["topg_hit"],
    "stream_next_event_idle": queries_sequences.model_sql(
        """select session_id, episode, pos, cast(hit as int) as hit from idle_wins join hits using (ctx, nxt)
        where session_id in (select session_id from user_split where split = 'test')""",
        queries_sequences.WINDOWS,
        queries_sequences.NEXT_MODEL,
        queries_sequences.HITS,
        EPISODES,
    ),
}
