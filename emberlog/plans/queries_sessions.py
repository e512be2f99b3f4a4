"""Registered plans: parsing, sessions, splits and the flagship detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import parse, sessions, split
from emberlog.plans import detection, fixtures, views
from emberlog.plans.ctes import with_parts as sql
from emberlog.plans.views import text
from emberlog.session import stage


def _hdfs_matched(spark, sf, arguments=False):
    fields = parse.hdfs_fields(fixtures.hdfs_log(spark, sf))
    return parse.match_templates(fields, fixtures.templates_hdfs(spark), arguments)


def _block_rows(spark, sf):
    lines = _hdfs_matched(spark, sf)
    return sessions.block_rows(lines, "line_no", F.coalesce("event_id", F.lit("")).alias("event"))


def _staged_block_rows(spark, sf):
    """The text is parsed once, however often the rows are read afterwards."""
    return stage(_block_rows(spark, sf), "block-rows")


def _openstack(spark, sf):
    patterns = parse.wildcard_patterns(fixtures.templates_openstack(spark))
    return parse.match_templates(parse.openstack_fields(fixtures.openstack_log(spark, sf)), patterns)


def _uuid_rows(spark, sf):
    lines = _openstack(spark, sf).where("idx is not null")
    return sessions.uuid_rows(lines, "line_no", F.col("event_id").alias("event"))


# --- parsing -----------------------------------------------------------------------------


def parse_hdfs_tokens(spark, sf):
    return parse.hdfs_fields(fixtures.hdfs_log(spark, sf), cut_comma=False)


def parse_cut_comma(spark, sf):
    return parse.hdfs_fields(fixtures.hdfs_log(spark, sf)).select("line_no", "content")


def parse_match_template(spark, sf):
    return _hdfs_matched(spark, sf).where("idx is not null").select("line_no", "event_id", "event_template")


def parse_args(spark, sf):
    matched = _hdfs_matched(spark, sf, arguments=True).where("idx is not null")
    return matched.select("line_no", "event_id", text("args", "|").alias("args"))


def parse_stop_short(spark, sf):
    lines = fixtures.hdfs_log_short(spark, sf)
    kept = parse.hdfs_until_short(lines, "stop").select("line_no", F.lit("stop").alias("mode"))
    return kept.union(parse.hdfs_until_short(lines, "skip").select("line_no", F.lit("skip").alias("mode")))


def parse_unmatched_kept(spark, sf):
    return _hdfs_matched(spark, sf).select(
        "line_no",
        "content",
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce("event_template", F.lit("")).alias("event_template"),
    )


def parse_openstack_tokens(spark, sf):
    return parse.openstack_fields(fixtures.openstack_log(spark, sf))


def parse_openstack_valid(spark, sf):
    return _openstack(spark, sf).where("idx is not null").select("line_no", "event_id", "event_template", "content")


def parse_line_id(spark, sf):
    kept = parse.number_lines(_openstack(spark, sf).where("idx is not null"))
    return kept.select("line_id", "line_no")


# --- sessions ----------------------------------------------------------------------------


def session_ids_blk(spark, sf):
    return _block_rows(spark, sf).select("line_no", "session_id")


def session_ids_uuid(spark, sf):
    return _uuid_rows(spark, sf).select("line_no", "session_id")


def sessions_build(spark, sf):
    rows = _staged_block_rows(spark, sf)
    chunks = sessions.session_chunks(sessions.with_positions(rows), halo=0)
    numbered = sessions.with_seq_no(sessions.session_heads(rows)).select("session_id", "seq_no", "n_events")
    return chunks.join(numbered, "session_id").select(
        "session_id", "seq_no", "n_events", "chunk", text("events").alias("events")
    )


def sessions_label(spark, sf):
    rows = _staged_block_rows(spark, sf)
    labels = fixtures.block_labels(spark, sf, rows)
    return sessions.label_from_table(sessions.session_heads(rows), labels).select("session_id", "n_events", "label")


def sessions_label_list(spark, sf):
    rows = stage(_uuid_rows(spark, sf), "uuid-rows")
    listed = fixtures.anomaly_ids(spark, sf, rows)
    return sessions.label_from_list(sessions.session_heads(rows), listed).select("session_id", "n_events", "label")


def sessions_unlabelled(spark, sf):
    heads = sessions.session_heads(_staged_block_rows(spark, sf))
    return split.split_sessions(heads, 0.5, "uniform", labelled=False).select("session_id", "seq_no", "split")


# --- splits ------------------------------------------------------------------------------


def split_uniform(spark, sf):
    return split.split_uniform(views.day_heads(spark, sf), 0.5).select("session_id", "label", "split")


def split_uniform3(spark, sf):
    return split.split_uniform(views.day_heads(spark, sf), 0.35, 0.6).select("session_id", "label", "split")


def split_balanced(spark, sf):
    parts = split.split_uniform(views.day_heads(spark, sf), 0.3, 0.6, balanced=True)
    return parts.select("session_id", "label", "split")


def split_sequential(spark, sf):
    parts = split.split_sequential(views.day_heads(spark, sf), 0.35, 0.6)
    return parts.select("session_id", "seq_no", "split")


def split_index(spark, sf):
    return split.split_index(views.day_heads(spark, sf), 0.35, 0.6).select("row_idx", "split")


def split_shuffle(spark, sf):
    parts = split.split_uniform(views.day_heads(spark, sf), 0.35, 0.6).where("split = 'train'")
    return split.shuffled(parts, seed=7).select("session_id", "shuffle_no")


def split_summary(spark, sf):
    return split.split_summary(split.split_uniform(views.day_heads(spark, sf), 0.35, 0.6))


QUERIES = {
    "next_event_report": detection.next_event_report,
    "parse_hdfs_tokens": parse_hdfs_tokens,
    "parse_cut_comma": parse_cut_comma,
    "parse_match_template": parse_match_template,
    "parse_args": parse_args,
    "parse_stop_short": parse_stop_short,
    "parse_unmatched_kept": parse_unmatched_kept,
    "parse_openstack_tokens": parse_openstack_tokens,
    "parse_openstack_valid": parse_openstack_valid,
    "parse_line_id": parse_line_id,
    "session_ids_blk": session_ids_blk,
    "session_ids_uuid": session_ids_uuid,
    "sessions_build": sessions_build,
    "sessions_label": sessions_label,
    "sessions_label_list": sessions_label_list,
    "sessions_unlabelled": sessions_unlabelled,
    "split_uniform": split_uniform,
    "split_uniform3": split_uniform3,
    "split_balanced": split_balanced,
    "split_sequential": split_sequential,
    "split_index": split_index,
    "split_shuffle": split_shuffle,
    "split_summary": split_summary,
}

# Windows of padded sequences: h + 1 = 5 events, session lengths here are above 5 or padded to it.
WINDOWS = """wins as (
    select session_id, label, split, i as pos, e[i + 1 : i + 4] as ctx, e[i + 5] as nxt from (
        select *, unnest(range(len(e) - 4)) as i from (
            select session_id, label, split, case when n_events < 5
                then list_concat([ '_PAD' for x in range(5 - n_events)], events) else events end as e
            from user_split)))"""

# Context suffix counts of distinct normal training windows, and the longest known suffix of every
# distinct context to be scored.
NEXT_MODEL = """train as (select distinct ctx, nxt from wins where split = 'train' and label = 0),
suffixes as (select k, list_slice(ctx, 5 - k, 4) as suf, nxt, count(*) as cnt
    from train, (select unnest(range(5)) as k) group by all),
support as (select k, suf, sum(cnt) as total from suffixes group by k, suf),
asked as (select distinct ctx from wins),
best as (select ctx, max(k) as k from asked, (select unnest(range(5)) as k) join support using (k)
    where suf = list_slice(ctx, 5 - k, 4) group by ctx),
known as (select ctx, k, list_slice(ctx, 5 - k, 4) as suf, total from best join support using (k)
    where suf = list_slice(ctx, 5 - k, 4))"""

HITS = """pairs as (select distinct ctx, nxt from wins),
targets as (select p.ctx, p.nxt, n.k, n.suf, n.total, coalesce(s.cnt, 0) as target
    from pairs p join known n using (ctx)
    left join suffixes s on s.k = n.k and s.suf = n.suf and s.nxt = p.nxt),
hits as (select ctx, t.nxt, count(s.cnt) < 5 as hit from targets t
    left join suffixes s on s.k = t.k and s.suf = t.suf and s.cnt > t.target group by ctx, t.nxt)"""

VERDICT = """verdict as (select session_id, label, sum(cast(not hit as int)) as mismatches, count(*) as n_windows,
    cast(sum(cast(not hit as int)) / count(*) > 0.65::double as int) as pred
    from wins join hits using (ctx, nxt) where split = 'test' group by session_id, label)"""

CONFUSION = """conf as (select
    count(*) filter (where pred = 1 and label > 0) as tp, count(*) filter (where pred = 0 and label = 0) as tn,
    count(*) filter (where pred = 1 and label = 0) as fp, count(*) filter (where pred = 0 and label > 0) as fn
    from verdict)"""


def model_sql(select: str, *steps: str) -> str:
    return sql("", "user_split").rstrip() + ",\n" + ",\n".join(steps) + "\n" + select


_STRAT = """select session_id, label, case when r < {train} then 'train' when r < {test} then 'validate'
    else 'test' end as split from (
    select *, row_number() over (partition by label order by first_line, session_id) - 1 as r,
        count(*) over (partition by label) as c, (select count(*) from day_seq where label = 1) as p
    from day_seq)"""

_RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"""

ORACLE = {
    "next_event_report": model_sql(
        f"select tp, tn, fp, fn, {_RATIOS} from conf", WINDOWS, NEXT_MODEL, HITS, VERDICT, CONFUSION
    ),
    "parse_hdfs_tokens": sql(
        "select line_no, date, time, pid, level, component, raw_content as content from hdfs_fields", "hdfs_fields"
    ),
    "parse_cut_comma": sql("select line_no, content from hdfs_fields", "hdfs_fields"),
    "parse_match_template": sql(
        "select line_no, event_id, event_template from hdfs_structured where idx is not null", "hdfs_structured"
    ),
    "parse_args": sql(
        """select line_no, event_id, case idx
            when 0 then regexp_extract(content, '^Receiving block (.*) src: (.*)', 1)
            when 1 then regexp_extract(content, '^Receiving (.*)', 1)
            when 2 then regexp_extract(content, '^Verification succeeded for (.*)', 1)
            when 3 then regexp_extract(content, '^Got exception while serving (.*) to (.*)', 2)
            else regexp_extract(content, '^Moved (.*) to (.*)', 1) || '|'
                || regexp_extract(content, '^Moved (.*) to (.*)', 2) end as args
        from hdfs_structured where idx is not null""",
        "hdfs_structured",
    ),
    "parse_stop_short": sql(
        """select line_no, 'stop' as mode from hdfs_short
            where line_no < (select min(line_no) from hdfs_short where len(string_split(value, ' ')) < 6)
        union all select line_no, 'skip' from hdfs_short where len(string_split(value, ' ')) >= 6""",
        "hdfs_short",
    ),
    "parse_unmatched_kept": sql(
        """select line_no, content, coalesce(event_id, '') as event_id,
            coalesce(event_template, '') as event_template from hdfs_structured""",
        "hdfs_structured",
    ),
    "parse_openstack_tokens": sql(
        "select line_no, logrecord, date, time, pid, level, component, addr, content from openstack_fields",
        "openstack_fields",
    ),
    "parse_openstack_valid": sql(
        """select line_no, event_id, content, case idx when 0 then '[instance: <*>] VM Started (Lifecycle Event)'
            else '<*> done, instance <*> took <*> ms' end as event_template from openstack_structured""",
        "openstack_structured",
    ),
    "parse_line_id": sql("select line_id, line_no from openstack_structured", "openstack_structured"),
    "session_ids_blk": sql("select line_no, session_id from block_rows", "block_rows"),
    "session_ids_uuid": sql("select line_no, session_id from uuid_rows", "uuid_rows"),
    "sessions_build": sql(
        """select session_id, seq_no, n_events, chunk, string_agg(event, ',' order by pos) as events from (
            select session_id, event, row_number() over (partition by session_id order by line_no) - 1 as pos,
                pos // 1024 as chunk from block_rows)
        join (select session_id, n_events, row_number() over (order by first_line, session_id) - 1 as seq_no
            from block_heads) using (session_id) group by session_id, seq_no, n_events, chunk""",
        "block_heads",
    ),
    "sessions_label": sql(
        """select session_id, n_events, cast(mark = 'Anomaly' as int) as label
        from block_heads join block_labels using (session_id)""",
        "block_heads",
        "block_labels",
    ),
    "sessions_label_list": sql(
        """select session_id, count(*) as n_events, cast(max(value) > 250 as int) as label
        from uuid_rows join ev using (line_no) group by session_id""",
        "uuid_rows",
        "ev",
    ),
    "sessions_unlabelled": sql(
        """select session_id, seq_no, case when seq_no < floor(0.5::double * n) then 'train' else 'test' end as split
        from (select session_id, row_number() over (order by first_line, session_id) - 1 as seq_no,
            count(*) over () as n from block_heads)""",
        "block_heads",
    ),
    "split_uniform": sql(
        _STRAT.format(train="floor(0.5::double * c)", test="floor(0.5::double * c)"), "day_seq"
    ),
    "split_uniform3": sql("select session_id, label, split from day_split", "day_split"),
    "split_balanced": sql(
        _STRAT.format(
            train="floor(0.3::double * p)",
            test="""(case when label = 1 then c - floor(0.6::double * c)
                else floor(floor(0.3::double * p) * 1.33::double) end)""",
        ),
        "day_seq",
    ),
    "split_sequential": sql(
        """select session_id, r as seq_no, case when r < floor(0.35::double * n) then 'train'
            when r < n - floor(0.6::double * n) then 'validate' else 'test' end as split
        from (select session_id, row_number() over (order by first_line, session_id) - 1 as r,
            count(*) over () as n from day_seq)""",
        "day_seq",
    ),
    "split_index": sql(
        "select row_number() over (order by first_line, session_id) - 1 as row_idx, split from day_split", "day_split"
    ),
    "split_shuffle": sql(
        """select session_id, row_number() over (order by md5('7:' || session_id), session_id) - 1 as shuffle_no
        from day_split where split = 'train'""",
        "day_split",
    ),
    "split_summary": sql(
        """select coalesce(split, 'total') as split, count(*) as total,
            coalesce(sum(label), 0) as anomaly, count(*) - coalesce(sum(label), 0) as normal
        from day_split group by rollup (split)""",
        "day_split",
    ),
}
