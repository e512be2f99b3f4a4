"""Registered plans: event-count features, time windows, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.sequences import sigmoid_nonzero
from emberlog.operators import collect, features, parse, sessions, split, timewin
from emberlog.operators.features import FeatureModel
from emberlog.plans import fixtures, queries_sequences, queries_sessions, views
from emberlog.plans.ctes import with_parts as sql
from emberlog.plans.views import r6, text
from emberlog.session import scratch_path, stage
from emberlog.sources import readers, writers

MIN_COUNT = 180

# --- features ----------------------------------------------------------------------------


def _counts(spark, sf):
    return features.event_counts(fixtures.day_rows(spark, sf))


def _split_counts(spark, sf):
    """Counts with ``split``, written once: fit and transform both read them."""
    parts = views.day_split(spark, sf).select("session_id", "split")
    return stage(_counts(spark, sf).join(parts, "session_id"), "counts")


def _part(counts, name):
    return counts.where(F.col("split") == name).drop("split")


def feat_counts(spark, sf):
    return _counts(spark, sf)


def feat_vocab(spark, sf):
    return features.vocabulary_with_df(_part(_split_counts(spark, sf), "train")).select("event", "idx")


def feat_min_count(spark, sf):
    return features.vocabulary_with_df(_part(_split_counts(spark, sf), "train"), MIN_COUNT)


def feat_oov_fit(spark, sf):
    train = _part(_split_counts(spark, sf), "train")
    return features.oov_counts(train, features.vocabulary_with_df(train, MIN_COUNT))


def feat_oov_transform(spark, sf):
    counts = _split_counts(spark, sf)
    vocab = features.vocabulary_with_df(_part(counts, "train"), MIN_COUNT)
    return features.oov_counts(_part(counts, "test"), vocab)


def feat_tfidf(spark, sf):
    train = _part(_split_counts(spark, sf), "train")
    model = FeatureModel.fit(train, "tf-idf", oov=True, min_count=MIN_COUNT)
    return model.transform_sparse(train).select("session_id", "event", r6("x").alias("x"))


def _dense(model, counts):
    wide = model.transform(counts).select("session_id", F.posexplode("features").alias("idx", "x"))
    return wide.select("session_id", F.col("idx").cast("bigint").alias("idx"), r6("x").alias("x"))


def feat_zero_mean(spark, sf):
    train = _part(_split_counts(spark, sf), "train")
    return _dense(FeatureModel.fit(train, None, "zero-mean"), train)


def feat_sigmoid(spark, sf):
    x = sigmoid_nonzero(F.col("cnt").cast("double"))
    return _counts(spark, sf).select("session_id", "event", r6(x).alias("x"))


def feat_transform(spark, sf):
    counts = _split_counts(spark, sf)
    model = FeatureModel.fit(_part(counts, "train"), "tf-idf", "zero-mean", oov=True, min_count=MIN_COUNT)
    return _dense(model, _part(counts, "test"))


def class_weights(spark, sf):
    rows = features.class_weights(views.day_heads(spark, sf), "balanced")
    return rows.select("session_id", r6("class_weight").alias("class_weight"))


# --- time windows ------------------------------------------------------------------------

EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def tw_rows(spark, sf):
    lines = fixtures.event_lines(spark, sf)
    return lines.select("line_no", F.expr(EPOCH.format("ts")).alias("t"), "ts", "event", "bad")


def _windows(spark, sf, hours=24, step=6):
    rows = tw_rows(spark, sf)
    plan = timewin.WindowPlan.of(rows, hours, step)
    return rows, plan, timewin.members(rows, plan)


def tw_members(spark, sf):
    """Three shapes: overlapping, tumbling, and a step longer than the window."""
    out = None
    for hours, step in ((24, 6), (6, 6), (1, 2)):
        part = _windows(spark, sf, hours, step)[2].select(F.lit(f"{hours}/{step}").alias("shape"), "win", "line_no")
        out = part if out is None else out.union(part)
    return out


def tw_bounds(spark, sf):
    rows, plan, _ = _windows(spark, sf, 1, 2)
    return timewin.bounds(rows, plan)


def tw_grid(spark, sf):
    slots = timewin.grid_counts(tw_rows(spark, sf), 24, 6)
    return slots.select(F.expr(EPOCH.format("start")).alias("start"), "event", "cnt", "bad")


def tw_counts(spark, sf):
    return timewin.counts(_windows(spark, sf)[2])


def tw_labels(spark, sf):
    rows, plan, found = _windows(spark, sf, 1, 2)
    return timewin.labels(found, timewin.all_windows(rows, plan))


def tw_summary(spark, sf):
    rows, plan, found = _windows(spark, sf)
    return timewin.summary(found, timewin.all_windows(rows, plan), rows)


def tw_from_bounds(spark, sf):
    """Windows taken from stored bounds instead of being derived again."""
    rows, plan, _ = _windows(spark, sf)
    path = scratch_path(spark, "bounds")
    writers.write_bounds(timewin.bounds(rows, plan), path)
    return timewin.members_from_bounds(rows, readers.read_bounds(spark, path)).select("win", "line_no")


# --- sources and sinks -------------------------------------------------------------------


def src_raw_lines(spark, sf):
    path = scratch_path(spark, "raw")
    writers.write_lines(fixtures.hdfs_log(spark, sf), path)
    return readers.read_lines(spark, path)


def _structured_hdfs(spark, sf):
    return parse.structured_hdfs(fixtures.hdfs_log(spark, sf), fixtures.templates_hdfs(spark))


def src_structured(spark, sf):
    path = scratch_path(spark, "structured")
    writers.write_structured(writers.hdfs_table(_structured_hdfs(spark, sf)), path, "csv")
    return readers.read_structured(spark, path)


def _day_instances(spark, sf, values=("event",)):
    rows = sessions.with_positions(fixtures.day_rows(spark, sf))
    heads = views.day_heads(spark, sf).select("session_id", "label")
    return sessions.session_chunks(rows, values, halo=0).join(heads, "session_id")


def src_instances(spark, sf):
    path = scratch_path(spark, "instances")
    writers.write_sessions(_day_instances(spark, sf), path, "csv")
    back = readers.read_instances(spark, path)
    return back.select("session_id", "chunk", text("events").alias("events"), "label")


def src_rich_instances(spark, sf):
    path = scratch_path(spark, "rich")
    writers.write_sessions(_day_instances(spark, sf, ("event", "time", "pid")), path, "csv")
    zipped = readers.read_rich_instances(spark, path).select(
        "session_id", "label", F.explode(F.arrays_zip("events", "times", "pids")).alias("e")
    )
    return zipped.select("session_id", "label", "e.events", "e.times", "e.pids")


def src_sequences(spark, sf):
    """Two-column sequence file, split class-wise by row number."""
    path = scratch_path(spark, "sequences")
    first = views.day_heads(spark, sf).select("session_id", "first_line")
    cells = _day_instances(spark, sf).join(first, "session_id")
    quoted = F.concat(F.lit('"'), writers._list_literal("events"), F.lit('",'), F.col("label").cast("string"))
    body = cells.select((F.col("first_line") + 1).alias("line_no"), quoted.alias("value"))
    head = spark.createDataFrame([(0, "EventSequence,Label")], "line_no bigint, value string")
    writers.write_lines(head.union(body), path)
    rows = readers.read_bare_instances(spark, path)
    keyed = rows.withColumn("session_id", F.format_string("%020d", "row_no")).withColumn("first_line", F.col("row_no"))
    parts = split.split_uniform(keyed, 0.35, 0.6)
    return parts.select("row_no", text("events").alias("events"), "label", "split")


def src_labels(spark, sf):
    path = scratch_path(spark, "labels")
    rows = queries_sessions._block_rows(spark, sf)
    writers.write_labels(fixtures.block_labels(spark, sf, rows), path)
    return readers.read_labels(spark, path)


def src_anomaly_list(spark, sf):
    path = scratch_path(spark, "anomalies")
    rows = queries_sessions._uuid_rows(spark, sf)
    writers.write_anomaly_list(fixtures.anomaly_ids(spark, sf, rows), path)
    return readers.read_anomaly_list(spark, path)


def src_templates(spark, sf):
    """The catalogue, read back, with the lines each template was the first to match."""
    path = scratch_path(spark, "templates")
    writers.write_templates(fixtures.templates_hdfs(spark), path)
    catalogue = readers.read_templates(spark, path)
    fields = parse.hdfs_fields(fixtures.hdfs_log(spark, sf))
    used = parse.match_templates(fields, catalogue).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return catalogue.join(used, "idx", "left").select(
        "idx", "pattern", F.coalesce("n", F.lit(0)).alias("n_lines")
    )


def templates_wildcard(spark, sf):
    path = scratch_path(spark, "wildcards")
    quoted = F.concat(F.lit('"'), "template", F.lit('"'))
    rows = fixtures.templates_openstack(spark).select((F.col("idx") + 1).alias("line_no"), quoted.alias("value"))
    head = spark.createDataFrame([(0, "EventTemplate")], "line_no int, value string")
    writers.write_lines(head.union(rows), path)
    catalogue = parse.wildcard_patterns(readers.read_wildcard_templates(spark, path))
    fields = parse.openstack_fields(fixtures.openstack_log(spark, sf))
    used = parse.match_templates(fields, catalogue).groupBy("idx").agg(F.count(F.lit(1)).alias("n_lines"))
    return catalogue.join(used, "idx").select("idx", "template", "pattern", "n_lines")


def src_template_lookup(spark, sf):
    path = scratch_path(spark, "lookup")
    writers.write_template_lookup(queries_sequences.event_templates(spark, sf), path)
    return readers.read_template_lookup(spark, path)


def snk_structured(spark, sf):
    path = scratch_path(spark, "structured")
    writers.write_structured(writers.hdfs_table(_structured_hdfs(spark, sf)), path)
    return spark.read.parquet(path).groupBy(F.col("EventId").alias("event_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("LineId").alias("first_id"), F.max("Arg0").alias("max_arg0")
    )


def snk_structured_openstack(spark, sf):
    path = scratch_path(spark, "structured")
    patterns = parse.wildcard_patterns(fixtures.templates_openstack(spark))
    table = parse.structured_openstack(fixtures.openstack_log(spark, sf), patterns)
    writers.write_structured(writers.openstack_table(table), path, "csv")
    return readers.read_structured(spark, path, "openstack")


def snk_sessions(spark, sf):
    path = scratch_path(spark, "sessions")
    writers.write_sessions(_day_instances(spark, sf), path)
    return spark.read.parquet(path).select("session_id", "chunk", text("events").alias("events"), "label")


def snk_outcomes(spark, sf):
    path = scratch_path(spark, "outcomes")
    heads = views.user_heads(spark, sf).select("session_id", "first_line")
    rendered = collect.render(queries_sequences.outcome_chunks(spark, sf).join(heads, "session_id"))
    writers.write_outcomes(rendered, path)
    return readers.read_outcomes(spark, path)


def snk_tw_bounds(spark, sf):
    rows, plan, _ = _windows(spark, sf)
    path = scratch_path(spark, "bounds")
    writers.write_bounds(timewin.bounds(rows, plan), path)
    return readers.read_bounds(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        feat_counts, feat_vocab, feat_min_count, feat_oov_fit, feat_oov_transform, feat_tfidf, feat_zero_mean,
        feat_sigmoid, feat_transform, class_weights, tw_members, tw_bounds, tw_grid, tw_counts, tw_labels,
        tw_summary, tw_from_bounds, src_raw_lines, src_structured, src_instances, src_rich_instances,
        src_sequences, src_labels, src_anomaly_list, src_templates, templates_wildcard, src_template_lookup,
        snk_structured, snk_structured_openstack, snk_sessions, snk_outcomes, snk_tw_bounds,
    )
}

COUNTS = """counts as (select session_id, event, split, count(*) as cnt
    from day_rows join (select session_id, split from day_split) using (session_id) group by all),
train as (select * from counts where split = 'train')"""

VOCAB = """vocab as (select event, row_number() over (order by event) - 1 as idx, df from (
    select event, count(*) as df from train group by event having count(*) >= 180))"""

# Columns of the fitted model (with the out-of-vocabulary one), idf and mean of the weighted column.
MODEL = """kept as (select session_id, split, event, cnt from counts join vocab using (event)
    union all select session_id, split, '_OOV', count(*) from counts
        where event not in (select event from vocab) group by session_id, split),
columns as (select event, idx from vocab union all select '_OOV', (select count(*) from vocab)),
model as (select event, idx, ln(n / (coalesce(df, 0) + 1e-8::double)) as idf, coalesce(total, 0) as total, n
    from columns left join (select event, count(*) as df, sum(cnt) as total from kept where split = 'train'
        group by event) using (event),
    (select count(distinct session_id) as n from train))"""


def _feat_sql(select: str, *steps: str) -> str:
    return sql("", "day_rows", "day_split").rstrip() + ",\n" + ",\n".join((COUNTS, *steps)) + "\n" + select


_OOV_SQL = """select session_id, sum(cast(event not in (select event from vocab) as int)) as oov
    from counts where split = '{}' group by session_id"""

TW_ROWS = "rows as (select line_no, cast(floor(epoch(ts)) as bigint) as t, event, bad from ev)"


def _tw(hours: int, step: int, tag: str = "") -> str:
    """All windows and their members by the definition, as a range join."""
    w, s = hours * 3600, step * 3600
    return f"""span{tag} as (select *, (select max(t) from rows where t < t0 + {w}) as e0
        from (select min(t) as t0, max(t) as tm from rows)),
    all{tag} as (select unnest(range(cast(floor((tm - e0) / {s}) as bigint) + 2)) as win, t0, tm, e0 from span{tag}
        where tm >= t0 + {w}),
    member{tag} as (select win, r.* from all{tag} a join rows r on
        (win = 0 and t < t0 + {w}) or (win >= 1 and t < e0 + win * {s} and (t >= t0 + win * {s}
            or (win = 1 and t > e0) or (win > 1 and t >= e0 + (win - 1) * {s}))))"""


def _tw_sql(select: str, *steps: str) -> str:
    return sql("", "ev").rstrip() + ",\n" + ",\n".join((TW_ROWS, *steps)) + "\n" + select


_BOUNDS = """select win, coalesce(s, last_value(e ignore nulls) over w) as start_index,
        last_value(e ignore nulls) over w as end_index
    from (select distinct win from all_) left join (select win, min(line_no) as s, max(line_no) + 1 as e
        from member_ group by win) using (win)
    window w as (order by win rows unbounded preceding)"""

ORACLE = {
    "feat_counts": sql("select session_id, event, count(*) as cnt from day_rows group by all", "day_rows"),
    "feat_vocab": _feat_sql(
        "select event, row_number() over (order by event) - 1 as idx from (select distinct event from train)"
    ),
    "feat_min_count": _feat_sql("select event, idx, df from vocab", VOCAB),
    "feat_oov_fit": _feat_sql(_OOV_SQL.format("train"), VOCAB),
    "feat_oov_transform": _feat_sql(_OOV_SQL.format("test"), VOCAB),
    "feat_tfidf": _feat_sql(
        """select session_id, event, round(cnt * idf, 6) + 0.0 as x from kept join model using (event)
        where split = 'train'""",
        VOCAB,
        MODEL,
    ),
    "feat_zero_mean": _feat_sql(
        """select s.session_id, c.idx, round(coalesce(k.cnt, 0) - c.mean, 6) + 0.0 as x
        from (select distinct session_id from train) s,
            (select event, row_number() over (order by event) - 1 as idx,
                sum(cnt) / (select count(distinct session_id) from train) as mean from train group by event) c
        left join train k on k.session_id = s.session_id and k.event = c.event"""
    ),
    "feat_sigmoid": sql(
        """select session_id, event, round(1 / (1 + exp(-count(*)::double)), 6) as x
        from day_rows group by session_id, event""",
        "day_rows",
    ),
    "feat_transform": _feat_sql(
        """select s.session_id, m.idx, round(coalesce(k.cnt, 0) * m.idf - m.total * m.idf / m.n, 6) + 0.0 as x
        from (select distinct session_id from counts where split = 'test') s, model m
        left join kept k on k.session_id = s.session_id and k.event = m.event and k.split = 'test'""",
        VOCAB,
        MODEL,
    ),
    "class_weights": sql(
        """select session_id, round(count(*) over () / (2 * count(*) over (partition by label)), 6)
            as class_weight from day_seq""",
        "day_seq",
    ),
    "tw_members": _tw_sql(
        """select '24/6' as shape, win, line_no from member_a union all select '6/6', win, line_no from member_b
        union all select '1/2', win, line_no from member_c""",
        _tw(24, 6, "_a"),
        _tw(6, 6, "_b"),
        _tw(1, 2, "_c"),
    ),
    "tw_bounds": _tw_sql(_BOUNDS, _tw(1, 2, "_")),
    "tw_grid": _tw_sql(
        """select start, event, count(*) as cnt, max(bad) as bad from (
            select event, bad, (t // 21600 - k) * 21600 as start, t from rows, (select unnest(range(4)) as k))
        where start > t - 86400 group by start, event"""
    ),
    "tw_counts": _tw_sql("select win, event, count(*) as cnt from member_ group by win, event", _tw(24, 6, "_")),
    "tw_labels": _tw_sql(
        """select win, coalesce(max(bad), 0) as label from (select distinct win from all_)
        left join (select win, bad from member_) using (win) group by win""",
        _tw(1, 2, "_"),
    ),
    "tw_summary": _tw_sql(
        """select (select count(*) from all_) as windows,
            (select count(distinct win) from member_ where bad = 1) as anomalies,
            (select count(distinct event) from rows) as events""",
        _tw(24, 6, "_"),
    ),
    "tw_from_bounds": _tw_sql("select win, line_no from member_", _tw(24, 6, "_")),
    "src_raw_lines": sql(
        "select row_number() over (order by line_no) as line_no, value from hdfs_log", "hdfs_log"
    ),
    "src_structured": sql(
        """select row_number() over (order by line_no) as line_no, content,
            coalesce(event_id, '') as event_id from hdfs_structured""",
        "hdfs_structured",
    ),
    "src_instances": sql(
        "select session_id, 0 as chunk, array_to_string(events, ',') as events, label from day_seq", "day_seq"
    ),
    "src_rich_instances": sql(
        """select session_id, max(bad) over (partition by session_id) as label, event as events, time as times,
            pid as pids from day_rows""",
        "day_rows",
    ),
    "src_sequences": sql(
        """select row_number() over (order by first_line) - 1 as row_no, array_to_string(events, ',') as events,
            label, split from day_split""",
        "day_split",
    ),
    "src_labels": sql("select session_id as BlockId, mark as Label from block_labels", "block_labels"),
    "src_anomaly_list": sql(
        "select distinct session_id as value from uuid_rows join ev using (line_no) where ev.value > 250",
        "uuid_rows",
        "ev",
    ),
    "src_templates": sql(
        """select idx, pattern, count(line_no) as n_lines
        from hdfs_templates left join hdfs_matched using (idx) group by idx, pattern""",
        "hdfs_matched",
        "hdfs_templates",
    ),
    "templates_wildcard": sql(
        """select idx, template, replace(replace(replace(replace(replace(replace(template, '[', '\\['),
            ']', '\\]'), '.', '\\.'), '(', '\\('), ')', '\\)'), '<*>', '(.*)') as pattern, count(*) as n_lines
        from (values (0, '[instance: <*>] VM Started (Lifecycle Event)'),
            (1, '<*> done, instance <*> took <*> ms')) as t(idx, template)
        join openstack_structured using (idx) group by idx, template""",
        "openstack_structured",
    ),
    "src_template_lookup": sql(
        """select distinct event as EventId, upper(event_type) || ' step ' || split_part(event, ':', 2)
            || ' of <*>' as EventTemplate from ev""",
        "ev",
    ),
    "snk_structured": sql(
        """select coalesce(event_id, '') as event_id, count(*) as n_lines, min(n) as first_id,
            max(case idx when 0 then regexp_extract(content, '^Receiving block (.*) src: (.*)', 1)
                when 1 then regexp_extract(content, '^Receiving (.*)', 1)
                when 2 then regexp_extract(content, '^Verification succeeded for (.*)', 1)
                when 3 then regexp_extract(content, '^Got exception while serving (.*) to (.*)', 2)
                when 4 then regexp_extract(content, '^Moved (.*) to (.*)', 1) else '' end) as max_arg0
        from (select *, row_number() over (order by line_no) as n from hdfs_structured) group by 1""",
        "hdfs_structured",
    ),
    "snk_structured_openstack": sql(
        "select line_id as line_no, content, event_id from openstack_structured", "openstack_structured"
    ),
    "snk_sessions": sql(
        "select session_id, 0 as chunk, array_to_string(events, ',') as events, label from day_seq", "day_seq"
    ),
    "snk_outcomes": queries_sequences._verdict_sql(
        "select outcome, array_to_string(events, ' ') as value from tagged", queries_sequences._ALL
    ),
    "snk_tw_bounds": _tw_sql(_BOUNDS, _tw(24, 6, "_")),
}
