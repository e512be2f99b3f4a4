"""Named SQL fragments the oracle queries are put together from (same views as ``fixtures``)."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    # name: (needs, body)
    "ev": (
        (),
        """select event_id as line_no, ts, user_id, event_type, value,
            event_type || ':' || cast(least(cast(floor(value / 25) as int), 3) as varchar) as event,
            cast(event_type = 'error' and value > 100 as int) as bad,
            cast(event_type = 'error' and value > 200 as int) as bad200
        from events""",
    ),
    "user_rows": (("ev",), "select 'u' || user_id as session_id, line_no, event, bad200 as bad from ev"),
    "day_rows": (
        ("ev",),
        """select 'u' || user_id || 'd' || strftime(ts, '%Y%m%d') as session_id, line_no, event, event_type,
            bad, strftime(ts, '%H%M%S') as time, cast(user_id as varchar) as pid from ev""",
    ),
    "user_seq": (
        ("user_rows",),
        """select session_id, min(line_no) as first_line, count(*) as n_events, max(bad) as label,
            list(event order by line_no) as events from user_rows group by session_id""",
    ),
    "day_seq": (
        ("day_rows",),
        """select session_id, min(line_no) as first_line, count(*) as n_events, max(bad) as label,
            list(event order by line_no) as events from day_rows group by session_id""",
    ),
    "hdfs_log": (
        ("ev",),
        """select line_no, strftime(ts, '%y%m%d') || ' ' || strftime(ts, '%H%M%S') || ' ' || user_id || ' '
            || case when event_type = 'error' then 'WARN' else 'INFO' end || ' dfs.' || event_type || ': '
            || case event_type
                when 'view' then 'Receiving block blk_' || user_id || ' src: /10.0.0.' || user_id
                when 'click' then 'Verification succeeded for blk_-' || (user_id + 1)
                when 'error' then 'Got exception while serving blk_' || user_id || ' to /10.0.0.' || user_id
                when 'purchase' then 'Moved blk_' || user_id || ' to blk_' || day(ts) || ', done'
                else 'heartbeat' end as value
        from ev""",
    ),
    "hdfs_short": (
        ("hdfs_log", "ev"),
        """select l.line_no, case when e.value = (select max(value) from ev)
                then array_to_string(string_split(l.value, ' ')[1:5], ' ') else l.value end as value
        from hdfs_log l join ev e using (line_no)""",
    ),
    "hdfs_fields": (
        ("hdfs_log",),
        """select line_no, t[1] as date, t[2] as time, t[3] as pid, t[4] as level,
            t[5][:-2] as component, array_to_string(t[6:], ' ') as raw_content,
            string_split(array_to_string(t[6:], ' '), ',')[1] as content
        from (select line_no, string_split(value, ' ') as t from hdfs_log)""",
    ),
    "hdfs_matched": (
        ("hdfs_fields",),
        """select *, case
                when regexp_matches(content, '^(?:Receiving block (.*) src: (.*))') then 0
                when regexp_matches(content, '^(?:Receiving (.*))') then 1
                when regexp_matches(content, '^(?:Verification succeeded for (.*))') then 2
                when regexp_matches(content, '^(?:Got exception while serving (.*) to (.*))') then 3
                when regexp_matches(content, '^(?:Moved (.*) to (.*))') then 4 end as idx
        from hdfs_fields""",
    ),
    "hdfs_templates": (
        (),
        """select * from (values (0, 'Receiving block (.*) src: (.*)'), (1, 'Receiving (.*)'),
            (2, 'Verification succeeded for (.*)'), (3, 'Got exception while serving (.*) to (.*)'),
            (4, 'Moved (.*) to (.*)')) as t(idx, pattern)""",
    ),
    "hdfs_structured": (
        ("hdfs_matched", "hdfs_templates"),
        """select m.*, 'E' || m.idx as event_id, t.pattern as event_template
        from hdfs_matched m left join hdfs_templates t using (idx)""",
    ),
    "block_rows": (
        ("hdfs_structured",),
        """select distinct unnest(regexp_extract_all(content, '(blk_-?\\d+)', 1)) as session_id, line_no,
            coalesce(event_id, '') as event from hdfs_structured""",
    ),
    "block_labels": (
        ("block_rows", "ev"),
        """select session_id, case when max(bad200) > 0 then 'Anomaly' else 'Normal' end as mark
        from block_rows join ev using (line_no) group by session_id""",
    ),
    "block_heads": (
        ("block_rows",),
        """select session_id, min(line_no) as first_line, count(*) as n_events from block_rows
        group by session_id""",
    ),
    "openstack_log": (
        ("ev",),
        """select line_no, 'api.log ' || strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') || ' '
            || user_id || ' INFO svc.api ' || case event_type when 'signup' then 'no bracket here'
            else '[req-' || line_no || '] ' || case event_type
                when 'click' then '[instance: ' || u || '] VM Started (Lifecycle Event)'
                when 'error' then 'unexpected failure in ' || u
                else event_type || ' done, instance ' || u || ' took ' || user_id || ' ms' end end as value
        from (select *, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-'
                || substr(m, 17, 4) || '-' || substr(m, 21, 12) as u
            from (select *, md5(cast(user_id as varchar)) as m from ev))""",
    ),
    "openstack_fields": (
        ("openstack_log",),
        """select *, substr(rest, 2, p - 2) as addr, substr(rest, p + 2) as content from (
            select *, instr(rest, ']') as p from (
                select line_no, t[1] as logrecord, t[2] as date, t[3] as time, t[4] as pid, t[5] as level,
                    t[6] as component, array_to_string(t[7:], ' ') as rest, len(t) as n_tokens
                from (select line_no, string_split(value, ' ') as t from openstack_log)))
        where n_tokens >= 8 and p > 0""",
    ),
    "openstack_structured": (
        ("openstack_fields",),
        """select *, 'E' || idx as event_id, row_number() over (order by line_no) as line_id from (
            select *, case
                when regexp_matches(content, '^(?:\\[instance: (.*)\\] VM Started \\(Lifecycle Event\\))') then 0
                when regexp_matches(content, '^(?:(.*) done, instance (.*) took (.*) ms)') then 1 end as idx
            from openstack_fields) where idx is not null""",
    ),
    "uuid_rows": (
        ("openstack_structured",),
        """select * from (select regexp_extract(content,
            '.*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}).*', 1) as session_id,
            line_no, event_id as event from openstack_structured) where session_id <> ''""",
    ),
    # Class-stratified three-way split, 0.35 / rest / 0.6, of the two session views.
    "user_split": (("user_seq",), "__SPLIT__user_seq"),
    "day_split": (("day_seq",), "__SPLIT__day_seq"),
}

_SPLIT = """select *, case when r < floor(0.35::double * c) then 'train'
        when r < c - floor(0.6::double * c) then 'validate' else 'test' end as split from (
    select *, row_number() over (partition by label order by first_line, session_id) - 1 as r,
        count(*) over (partition by label) as c from {seq})"""


def with_parts(select: str, *names: str) -> str:
    """A statement: the named fragments, with what they need, then ``select``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    bodies = []
    for name in order:
        body = PARTS[name][1]
        if body.startswith("__SPLIT__"):
            body = _SPLIT.format(seq=body.removeprefix("__SPLIT__"))
        bodies.append(f"{name} as ({body})")
    return "with " + ",\n".join(bodies) + "\n" + select if bodies else select
