import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import seqwin, sessions, timewin
from emberlog.operators.clustering import ClusterModel
from emberlog.streaming import cluster, next_event, sink, windows


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream that gets the given frames as one micro-batch each."""

    def build(frames):
        folder = tmp_path / "in"
        for i, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(str(folder / f"part={i:03d}"))
        schema = frames[0].schema
        return (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True)
            .parquet(str(folder))
        )

    return build


def pieces(df, key, cuts):
    return [df.where((F.col(key) >= a) & (F.col(key) < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("idle", [None, 60])
def test_stream_windows_equal_batch_windows(spark, make_rows, arriving, tmp_path, idle):
    rng = random.Random(9)
    rows = make_rows({s: [rng.choice("ABC") for _ in range(n)] for s, n in (("a", 30), ("b", 7), ("c", 2), ("d", 4))})
    rows = rows.drop("bad").withColumn("ts", F.timestamp_seconds((F.col("line_no") + 9_999) * 60)).cache()
    stream = next_event.stream_windows(arriving(pieces(rows, "line_no", [0, 5, 6, 20, 100])), 3, idle)
    path = str(tmp_path / "out")
    sink.run_available(stream, str(tmp_path / "state"), sink.batch_writer(path), mode="append")
    got = sorted((r["session_id"], r["pos"], r["context"], r["next"]) for r in spark.read.parquet(path).collect())
    chunks = sessions.session_chunks(sessions.with_positions(rows))
    batch = seqwin.next_event_windows(chunks, 3).collect()
    assert got == sorted((r["session_id"], r["pos"], r["context"], r["next"]) for r in batch)


def test_idle_sessions_end(spark, arriving, tmp_path):
    """Episodes do not depend on how the rows were cut into batches, and silent sessions leave the state."""
    rng = random.Random(12)
    rows, minute = [], {"a": 0, "b": 0, "c": 0}
    for line in range(240):
        # Session c falls silent early, for good.
        name = rng.choice("ab" if line > 60 else "abc")
        minute[name] += rng.choice([1, 5, 29, 30, 31, 90]) if rng.random() < 0.2 else 1
        rows.append((name, line, rng.choice("xyz"), minute[name]))
    # The clock of all sessions must move on together, so that no row is late.
    for name in minute:
        later = max(minute.values()) + 1
        rows.append((name, 240 + ord(name), "x", later + 600 if name != "c" else minute["c"]))
    rows.sort(key=lambda r: (r[3], r[1]))
    rows = [(s, i, e, m) for i, (s, _, e, m) in enumerate(rows)]
    want, last, line, opened = [], {}, {}, {}
    for s, i, e, m in rows:
        if s not in last or m - last[s] >= 30:
            line[s], opened[s] = [], i
        line[s].append(e)
        last[s] = m
        if len(line[s]) > 2:
            want.append((s, opened[s], len(line[s]) - 3, line[s][-3:-1], e))
    frame = spark.createDataFrame(rows, "session_id string, line_no bigint, event string, m bigint")
    frame = frame.select("session_id", "line_no", "event", F.timestamp_seconds((F.col("m") + 9_999) * 60).alias("ts")).cache()
    for number, cuts in enumerate(([0, 1000], [0, 1, 50, 51, 140, 200, 1000])):
        folder = tmp_path / str(number)
        folder.mkdir()
        for k, piece in enumerate(pieces(frame, "line_no", cuts)):
            piece.coalesce(1).write.parquet(str(folder / "in" / f"part={k:03d}"))
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        stream = next_event.stream_windows(source.parquet(str(folder / "in")), 2, 30, lateness="10 minutes")
        path = str(folder / "out")
        ended = sink.run_available(stream, str(folder / "state"), sink.batch_writer(path), mode="append")
        got = [(r.session_id, r.episode, r.pos, r.context, r.next) for r in spark.read.parquet(path).collect()]
        assert sorted(got) == sorted(want)
        # Only the sessions whose last event is within the idle time of the watermark are kept.
        assert ended.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2


def test_stream_counts_equal_grid(spark, arriving, tmp_path):
    rows = spark.range(200).select(
        F.timestamp_seconds(F.col("id") * 1800).alias("ts"),
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("event"),
        (F.col("id") % 7 == 0).cast("int").alias("bad"),
        "id",
    )
    stream = windows.windowed_counts(arriving(pieces(rows, "id", [0, 50, 120, 200])), 6, 2)
    path = str(tmp_path / "out")
    sink.run_available(stream, str(tmp_path / "state"), sink.batch_writer(path))
    got = sink.latest(spark.read.parquet(path), ["start", "event"], ["cnt", "bad"])
    expected = timewin.grid_counts(rows, 6, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("seeds", [8, 1000])
def test_stream_clusters_account_for_every_vector(spark, arriving, tmp_path, monkeypatch, seeds):
    sizes, fit = [], ClusterModel.fit_offline.__func__

    def watched(cls, vectors, *options):
        sizes.append(vectors.select("features").distinct().count())
        return fit(cls, vectors, *options)

    monkeypatch.setattr(ClusterModel, "fit_offline", classmethod(watched))
    rng = random.Random(10)
    data = [(i, [float(rng.randint(0, 3)), float(rng.randint(0, 3)), 1.0]) for i in range(60)]
    rows = spark.createDataFrame(data, "id bigint, features array<double>")
    path = str(tmp_path / "clusters")
    stream = arriving(pieces(rows, "id", [0, 20, 45, 60]))
    sink.run_available(stream, str(tmp_path / "state"), cluster.cluster_updater(path, 0.2, seeds), mode="append")
    assert cluster.last_version(spark, path) == 2
    model = cluster.load_clusters(spark, path, 2)
    assert model.reps.agg(F.sum("size")).first()[0] == 60
    # The first batch is not clustered as a whole.
    assert max(sizes) <= seeds
