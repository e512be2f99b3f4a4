"""Registered plans: vocabulary, padding, windows, next-event and likelihood models, decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.sequences import one_hot_label
from emberlog.operators import collect, evaluate, likelihood, seqwin, sessions
from emberlog.operators.nextevent import suffix_counts, vocabulary_list
from emberlog.plans import detection, fixtures, views
from emberlog.plans.ctes import with_parts as sql
from emberlog.plans.queries_sessions import (
    _RATIOS,
    CONFUSION,
    HITS,
    NEXT_MODEL,
    VERDICT,
    WINDOWS,
    model_sql,
)
from emberlog.plans.views import r6, text
from emberlog.session import stage

H = views.H


# --- vocabulary, padding, encodings ------------------------------------------------------


def seq_vocab(spark, sf):
    return seqwin.vocabulary(fixtures.day_rows(spark, sf))


def seq_vocab_pad(spark, sf):
    return seqwin.vocabulary(fixtures.day_rows(spark, sf), with_pad=True)


def seq_pad_left(spark, sf):
    padded = seqwin.padded_left(views.day_chunks(spark, sf), 8)
    return padded.select("session_id", "chunk", text("events").alias("events"))


def seq_pad_right(spark, sf):
    return seqwin.fixed_length(views.user_chunks(spark, sf), 50).select("session_id", text("events").alias("events"))


def seq_index(spark, sf):
    vocab = stage(seqwin.vocabulary(fixtures.user_rows(spark, sf), with_pad=True), "vocabulary")
    fixed = seqwin.fixed_length(views.user_chunks(spark, sf), 50)
    places = seqwin.indexed(fixed, "events", vocab, ["session_id"])
    return places.select("session_id", text(F.col("events").cast("array<string>")).alias("indexes"))


# --- windows -----------------------------------------------------------------------------


def win_next(spark, sf):
    wins = seqwin.next_event_windows(views.day_chunks(spark, sf), H)
    return wins.select("session_id", "pos", text("context").alias("context"), "next")


def win_same_length(spark, sf):
    wins = seqwin.windows(views.user_chunks(spark, sf), H + 1)
    parts = seqwin.with_context(wins.withColumn("whole", text("win")), H)
    return parts.select("session_id", "pos", "whole", text("context").alias("context"), "next")


def win_reconstruct(spark, sf):
    wins = seqwin.windows(views.day_chunks(spark, sf), H)
    return wins.select("session_id", "pos", text("win").alias("win"))


def win_counts_per_seq(spark, sf):
    return seqwin.windows_per_session(views.day_heads(spark, sf), H, lower_bound=H + 1)


def win_count_vector(spark, sf):
    vocab = stage(seqwin.vocabulary(fixtures.day_rows(spark, sf)), "vocabulary")
    chunks = seqwin.padded_left(views.day_chunks(spark, sf), H + 1)
    counted = seqwin.count_vectors(seqwin.next_event_windows(chunks, H), "context", vocab, vocab.count())
    return counted.select("session_id", "pos", text(F.col("counts").cast("array<string>")).alias("counts"))


def win_train_dedup(spark, sf):
    normal = views.user_sequences(spark, sf).where("split = 'train' and label = 0")
    return seqwin.distinct_windows(views.padded_windows(normal, H + 1)).select(text("win").alias("win"), "weight")


def _positioned_day(spark, sf, condition):
    parts = views.day_split(spark, sf).where(condition)
    return sessions.with_positions(fixtures.day_rows(spark, sf).join(parts.select("session_id"), "session_id"))


def seq_train_dedup(spark, sf):
    return seqwin.distinct_sequences(_positioned_day(spark, sf, "split = 'train' and label = 0"))


def win_reconstruct_dedup(spark, sf):
    parts = views.day_split(spark, sf).where("split = 'train'").select("session_id")
    wins = seqwin.windows(views.day_chunks(spark, sf).join(parts, "session_id"), H)
    return seqwin.distinct_windows(wins).select(text("win").alias("win"), "weight")


def win_score_distinct(spark, sf):
    wins = seqwin.windows(views.day_chunks(spark, sf), H)
    scored = seqwin.score_distinct(
        wins, "win", lambda d: d.withColumn("score", F.size(F.array_distinct("win")).cast("bigint"))
    )
    return scored.select("session_id", "pos", "score")


def label_onehot(spark, sf):
    hot = one_hot_label(F.col("label")).cast("array<string>")
    return views.day_heads(spark, sf).select("session_id", text(hot).alias("onehot"))


# --- next-event model --------------------------------------------------------------------


def next_counts(spark, sf):
    train = detection.train_windows(views.user_sequences(spark, sf))
    return suffix_counts(train, H).select("k", text("suffix").alias("suffix"), "next", "cnt")


def next_dist(spark, sf):
    wins, model, _ = detection.next_event_windows(spark, sf, "test")
    known = model.lookup(wins.groupBy("context").agg(F.collect_set("next").alias("nexts")))
    return known.select("context", "k", "total", F.explode("dist").alias("next", "cnt")).select(
        text("context").alias("context"), "k", "next", r6(F.col("cnt") / F.col("total")).alias("p")
    )


def topg_hit(spark, sf):
    wins, model, _ = detection.next_event_windows(spark, sf, "test")
    return model.hits(wins, views.G).select("session_id", "pos", F.col("hit").cast("int").alias("hit"))


def seq_verdict(spark, sf):
    return detection.next_event_scored(spark, sf).select("session_id", "mismatches", "n_windows", "pred")


def confusion(spark, sf):
    return evaluate.confusion(detection.next_event_scored(spark, sf))


def prf1(spark, sf):
    return evaluate.evaluate(detection.next_event_scored(spark, sf)).select(
        *[r6(c).alias(c) for c in ("precision", "recall", "f1")]
    )


def select_by_f1(spark, sf):
    """Candidates: how many of the most frequent next events pass (g = 3, 5, 7, 9)."""
    wins, model, sequences = detection.next_event_windows(spark, sf, "validate")
    choices = F.posexplode(F.array(*[F.lit(g) for g in (3, 5, 7, 9)])).alias("candidate_no", "g")
    labels = sequences.where("split = 'validate' and chunk = 0").select("session_id", "label")
    rows = model.ahead(wins).select("session_id", "ahead", choices).join(labels, "session_id")
    judged = rows.groupBy("candidate_no", "g", "session_id", "label").agg(
        (F.avg((F.col("ahead") >= F.col("g")).cast("double")) > views.MAX_MISMATCH).cast("int").alias("pred")
    )
    reports = evaluate.evaluate(judged, ["candidate_no", "g"])
    named = reports.withColumn("candidate", F.concat(F.lit("g="), F.col("g").cast("string")))
    return evaluate.select_by_f1(named).select("candidate", r6("f1").alias("f1"))


# --- likelihood --------------------------------------------------------------------------


def _likelihood(spark, sf):
    """Window log-likelihoods and ``session_id, label, split`` of the sessions outside training."""
    sequences = views.day_sequences(spark, sf)
    # Which of several equal sequences is kept makes no difference to the counts.
    spots = seqwin.chunk_positions(sequences.where("split = 'train'")).withColumn("line_no", F.lit(0))
    first = seqwin.distinct_sequences(spots).select("session_id")
    model = likelihood.fit_window_model(sequences.join(first, "session_id"), H).staged()
    asked = sequences.where("split <> 'train'")
    parts = asked.where("chunk = 0").select("session_id", "label", "split")
    return likelihood.window_log_likelihood(model, asked, H), parts


def win_loglik(spark, sf):
    return _likelihood(spark, sf)[0].select("session_id", "pos", r6("ll").alias("ll"))


def seq_min_loglik(spark, sf):
    wins, _ = _likelihood(spark, sf)
    return likelihood.session_scores(wins).select("session_id", r6("score").alias("score"))


def _scores(spark, sf):
    wins, parts = _likelihood(spark, sf)
    return likelihood.session_scores(wins).join(parts, "session_id")


def ll_by_class(spark, sf):
    kind = F.when(F.col("label") > 0, "anomalous").otherwise("normal")
    rows = _scores(spark, sf).where("split = 'validate'")
    return rows.select("session_id", kind.alias("kind"), r6("score").alias("score"))


def _rounded_scores(spark, sf):
    """Scores rounded once, so equal sessions tie exactly wherever they are computed."""
    return stage(_scores(spark, sf).withColumn("score", r6("score")), "scores")


def best_boundary(spark, sf):
    best = evaluate.best_boundary(_rounded_scores(spark, sf).where("split = 'validate'"))
    return best.select(*[r6(c).alias(c) for c in ("boundary", "precision", "recall", "f1")])


def boundary_eval(spark, sf):
    scores = _rounded_scores(spark, sf)
    boundary = evaluate.best_boundary(scores.where("split = 'validate'")).select("boundary").scalar()
    report = evaluate.evaluate(evaluate.apply_boundary(scores.where("split = 'test'"), boundary))
    return report.select("tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# --- outcome collection ------------------------------------------------------------------


def _tagged(spark, sf):
    scored = detection.next_event_scored(spark, sf)
    heads = views.user_heads(spark, sf).select("session_id", "first_line")
    return collect.tag_outcomes(scored).join(heads, "session_id")


def outcome_tag(spark, sf):
    return collect.tag_outcomes(detection.next_event_scored(spark, sf), ("tp", "fp", "fn")).select(
        "session_id", "outcome"
    )


def outcome_sample(spark, sf):
    return collect.sample_outcomes(_tagged(spark, sf), 10).select("session_id", "outcome")


def event_templates(spark, sf):
    """``EventId, EventTemplate`` lookup for the event symbols of the table."""
    lines = fixtures.event_lines(spark, sf)
    worded = F.concat(F.upper("event_type"), F.lit(" step "), F.substring_index("event", ":", -1), F.lit(" of <*>"))
    return lines.select(F.col("event").alias("EventId"), worded.alias("EventTemplate")).distinct()


def outcome_chunks(spark, sf):
    """Chunks of all scored sessions with their bucket."""
    kept = collect.sample_outcomes(_tagged(spark, sf), None).select("session_id", "outcome")
    plain = sessions.session_chunks(sessions.with_positions(fixtures.user_rows(spark, sf)), halo=0)
    return plain.join(kept, "session_id")


def outcome_templates(spark, sf):
    named = collect.expand_templates(outcome_chunks(spark, sf), event_templates(spark, sf))
    return named.select("session_id", "outcome", "chunk", text("events", "|").alias("events"))


def outcome_render(spark, sf):
    chunks = outcome_chunks(spark, sf)
    lines = collect.render(chunks).select("session_id", F.lit("line").alias("form"), "text")
    block = collect.render(chunks, one_event_per_line=True).select("session_id", F.lit("block").alias("form"), "text")
    return lines.union(block)


QUERIES = {
    f.__name__: f
    for f in (
        seq_vocab, seq_vocab_pad, seq_pad_left, seq_pad_right, seq_index, win_next, win_same_length,
        win_reconstruct, win_counts_per_seq, win_count_vector, win_train_dedup, seq_train_dedup,
        win_reconstruct_dedup, win_score_distinct, label_onehot, next_counts, next_dist, topg_hit, seq_verdict,
        confusion, prf1, select_by_f1, win_loglik, seq_min_loglik, ll_by_class, best_boundary, boundary_eval,
        outcome_tag, outcome_sample, outcome_templates, outcome_render,
    )
}

_VOCAB = "select event, row_number() over (order by event) - 1 as idx from (select distinct event from {rows}{pad})"

_FIXED = """select session_id, (events || ['_PAD' for x in range(50)])[1:50] as e from user_seq"""

LIKELIHOOD = """train_seq as (select distinct events from day_split where split = 'train'),
train as (select e[1:3] as ctx, e[4] as nxt, count(*) as w from (
    select events[i + 1 : i + 4] as e from (select events, unnest(range(len(events) - 3)) as i from train_seq))
    group by ctx, nxt),
suffixes as (select k, list_slice(ctx, 4 - k, 3) as suf, nxt, sum(w) as cnt
    from train, (select unnest(range(4)) as k) group by all),
support as (select k, suf, sum(cnt) as total from suffixes group by k, suf),
wins as (select session_id, label, split, i as pos, e[i + 1 : i + 3] as ctx, e[i + 4] as nxt from (
    select *, unnest(range(len(e) - 3)) as i from (
        select session_id, label, split, case when n_events < 4
            then list_concat(['_PAD' for x in range(4 - n_events)], events) else events end as e
        from day_split where split <> 'train'))),
pairs as (select distinct ctx, nxt from wins),
best as (select ctx, max(k) as k from (select distinct ctx from wins), (select unnest(range(4)) as k)
    join support using (k) where suf = list_slice(ctx, 4 - k, 3) group by ctx),
lls as (select p.ctx, p.nxt, ln(greatest(coalesce(f.cnt, 0) / s.total, 1e-7::double)) as ll
    from pairs p join best b using (ctx) join support s on s.k = b.k and s.suf = list_slice(p.ctx, 4 - b.k, 3)
    left join suffixes f on f.k = b.k and f.suf = s.suf and f.nxt = p.nxt),
win_ll as (select session_id, label, split, pos, ll from wins join lls using (ctx, nxt)),
scores as (select session_id, label, split, round(min(ll), 6) + 0.0 as score from win_ll
    group by session_id, label, split)"""

_BOUNDARY = """cand as (select score, sum(cast(label > 0 as int)) as anom, sum(cast(label = 0 as int)) as norm
    from scores where split = 'validate' group by score),
summed as (select score, anom, sum(anom) over (order by score) as ca, sum(norm) over (order by score) as cn,
    sum(anom) over () as n from cand),
boundary as (select score as boundary, ca / (ca + cn) as precision, ca / n as recall from summed
    where anom > 0 order by (n + cn) / ca, score limit 1)"""


def _ll_sql(select: str, *steps: str) -> str:
    return sql("", "day_split").rstrip() + ",\n" + ",\n".join((LIKELIHOOD, *steps)) + "\n" + select


def _verdict_sql(select: str, *steps: str) -> str:
    return model_sql(select, WINDOWS, NEXT_MODEL, HITS, VERDICT, *steps)


_OUTCOME = """case when pred = 1 and label > 0 then 'tp' when pred = 1 then 'fp' when label > 0 then 'fn'
    else 'tn' end"""

_SAMPLE = f"""picked as (select session_id, outcome, events from (select *, row_number() over (
        partition by outcome order by first_line, session_id) as n from (
        select session_id, {_OUTCOME} as outcome, first_line, events
        from verdict join (select session_id, first_line, events from user_seq) using (session_id))) where n <= 10)"""

_ALL = f"""tagged as (select session_id, {_OUTCOME} as outcome, events
    from verdict join (select session_id, events from user_seq) using (session_id))"""

ORACLE = {
    "seq_vocab": sql(_VOCAB.format(rows="day_rows", pad=""), "day_rows"),
    "seq_vocab_pad": sql(_VOCAB.format(rows="day_rows", pad=" union select '_PAD'"), "day_rows"),
    "seq_pad_left": sql(
        """select session_id, 0 as chunk, array_to_string(case when n_events < 8
            then list_concat(['_PAD' for x in range(8 - n_events)], events) else events end, ',') as events
        from day_seq""",
        "day_seq",
    ),
    "seq_pad_right": sql(f"select session_id, array_to_string(e, ',') as events from ({_FIXED})", "user_seq"),
    "seq_index": sql(
        f"""select session_id, string_agg(idx, ',' order by pos) as indexes from (
            select session_id, unnest(e) as event, unnest(range(50)) as pos from ({_FIXED}))
        join ({_VOCAB.format(rows="user_rows", pad=" union select '_PAD'")}) using (event) group by session_id""",
        "user_seq",
    ),
    "win_next": sql(
        """select session_id, i as pos, array_to_string(events[i + 1 : i + 4], ',') as context,
            events[i + 5] as next
        from (select *, unnest(range(len(events) - 4)) as i from day_seq)""",
        "day_seq",
    ),
    "win_same_length": sql(
        """select session_id, i as pos, array_to_string(events[i + 1 : i + 5], ',') as whole,
            array_to_string(events[i + 1 : i + 4], ',') as context, events[i + 5] as next
        from (select *, unnest(range(len(events) - 4)) as i from user_seq)""",
        "user_seq",
    ),
    "win_reconstruct": sql(
        """select session_id, i as pos, array_to_string(events[i + 1 : i + 4], ',') as win
        from (select *, unnest(range(len(events) - 3)) as i from day_seq)""",
        "day_seq",
    ),
    "win_counts_per_seq": sql(
        "select session_id, greatest(n_events, 5) - 3 as n_windows from day_seq", "day_seq"
    ),
    "win_count_vector": sql(
        f"""select session_id, pos, string_agg(c, ',' order by idx) as counts from (
            select session_id, i as pos, idx, len(list_filter(e[i + 1 : i + 4], lambda x: x = event)) as c from (
                select *, unnest(range(len(e) - 4)) as i from (
                    select session_id, case when n_events < 5
                        then list_concat(['_PAD' for x in range(5 - n_events)], events) else events end as e
                    from day_seq)), ({_VOCAB.format(rows="day_rows", pad="")}))
        group by session_id, pos""",
        "day_seq",
    ),
    "win_train_dedup": model_sql(
        """select array_to_string(ctx, ',') || ',' || nxt as win, count(*) as weight from wins
        where split = 'train' and label = 0 group by ctx, nxt""",
        WINDOWS,
    ),
    "seq_train_dedup": sql(
        """select arg_min(session_id, first_line) as session_id, n_events, count(*) as weight
        from day_split where split = 'train' and label = 0 group by events, n_events""",
        "day_split",
    ),
    "win_reconstruct_dedup": sql(
        """select array_to_string(events[i + 1 : i + 4], ',') as win, count(*) as weight
        from (select *, unnest(range(len(events) - 3)) as i from day_split where split = 'train') group by 1""",
        "day_split",
    ),
    "win_score_distinct": sql(
        """select session_id, i as pos, len(list_distinct(events[i + 1 : i + 4])) as score
        from (select *, unnest(range(len(events) - 3)) as i from day_seq)""",
        "day_seq",
    ),
    "label_onehot": sql(
        "select session_id, case when label = 1 then '0,1' else '1,0' end as onehot from day_seq", "day_seq"
    ),
    "next_counts": model_sql(
        "select k, array_to_string(suf, ',') as suffix, nxt as next, cnt from suffixes", WINDOWS, NEXT_MODEL
    ),
    "next_dist": model_sql(
        """select array_to_string(ctx, ',') as context, k.k, s.nxt as next, round(s.cnt / k.total, 6) as p
        from known k join suffixes s on s.k = k.k and s.suf = k.suf
        where ctx in (select ctx from wins where split = 'test')""",
        WINDOWS,
        NEXT_MODEL,
    ),
    "topg_hit": model_sql(
        """select session_id, pos, cast(hit as int) as hit from wins join hits using (ctx, nxt)
        where split = 'test'""",
        WINDOWS,
        NEXT_MODEL,
        HITS,
    ),
    "seq_verdict": _verdict_sql("select session_id, mismatches, n_windows, pred from verdict"),
    "confusion": _verdict_sql("select tp, tn, fp, fn from conf", CONFUSION),
    "prf1": _verdict_sql(f"select {_RATIOS} from conf", CONFUSION),
    "select_by_f1": model_sql(
        """select candidate, round(f1, 6) as f1 from (
            select g, 'g=' || g as candidate, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from (
                select g, count(*) filter (where pred and label > 0) as tp,
                    count(*) filter (where pred and label = 0) as fp,
                    count(*) filter (where not pred and label > 0) as fn
                from (select g, session_id, label, avg(cast(ahead >= g as double)) > 0.65::double as pred
                    from wins join (select ctx, t.nxt, count(s.cnt) as ahead from targets t
                        left join suffixes s on s.k = t.k and s.suf = t.suf and s.cnt > t.target
                        group by ctx, t.nxt) using (ctx, nxt), (select unnest([3, 5, 7, 9]) as g)
                    where split = 'validate' group by g, session_id, label)
                group by g)) order by f1 desc, g limit 1""",
        WINDOWS,
        NEXT_MODEL,
        HITS,
    ),
    "win_loglik": _ll_sql("select session_id, pos, round(ll, 6) + 0.0 as ll from win_ll"),
    "seq_min_loglik": _ll_sql("select session_id, score from scores"),
    "ll_by_class": _ll_sql(
        """select session_id, case when label > 0 then 'anomalous' else 'normal' end as kind, score
        from scores where split = 'validate'"""
    ),
    "best_boundary": _ll_sql(
        """select round(boundary, 6) as boundary, round(precision, 6) as precision, round(recall, 6) as recall,
            round(2 * precision * recall / (precision + recall), 6) as f1 from boundary""",
        _BOUNDARY,
    ),
    "boundary_eval": _ll_sql(
        f"select tp, tn, fp, fn, {_RATIOS} from conf",
        _BOUNDARY,
        """verdict as (select label, cast(score <= (select boundary from boundary) as int) as pred
            from scores where split = 'test')""",
        CONFUSION,
    ),
    "outcome_tag": _verdict_sql(
        f"select session_id, outcome from (select session_id, {_OUTCOME} as outcome from verdict) where outcome <> 'tn'"
    ),
    "outcome_sample": _verdict_sql("select session_id, outcome from picked", _SAMPLE),
    "outcome_templates": _verdict_sql(
        """select session_id, outcome, 0 as chunk, array_to_string([e || ' ' || upper(split_part(e, ':', 1))
            || ' step ' || split_part(e, ':', 2) || ' of <*>' for e in events], '|') as events from tagged""",
        _ALL,
    ),
    "outcome_render": _verdict_sql(
        """select session_id, 'line' as form, array_to_string(events, ' ') as text from tagged
        union all select session_id, 'block', array_to_string(events, chr(10)) || chr(10) from tagged""",
        _ALL,
    ),
}
