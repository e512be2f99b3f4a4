"""Registered plans: Gram matrix, subspace, invariants, clustering, forest, classifiers, trained sequence models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from emberlog.functions.sequences import PAD, cosine_distance
from emberlog.operators import classifiers, clustering, evaluate, features, gram, invariants, seqwin, split
from emberlog.operators.clustering import ClusterModel
from emberlog.operators.detectors import FITS, Detector
from emberlog.operators.gram_classifier import GramClassifier
from emberlog.operators.iforest import ForestModel
from emberlog.operators.invariants import InvariantModel
from emberlog.operators.nextevent import vocabulary_list
from emberlog.operators.pca import PcaModel
from emberlog.operators.sequence_models import (
    NextEventSoftmax,
    gram_presence,
    linear_predictor,
    score_with,
)
from emberlog.plans import detection, fixtures, views
from emberlog.plans.ctes import with_parts as sql
from emberlog.plans.queries_sessions import _STRAT
from emberlog.plans.views import r6, text
from emberlog.session import stage

H = views.H


def _vectors(spark, sf):
    """``session_id, first_line, n_events, label, split, features``: counts per event, written once."""
    rows = fixtures.day_rows(spark, sf)
    vocab = vocabulary_list(seqwin.vocabulary(rows))
    heads = split.split_uniform(views.day_heads(spark, sf), views.TRAIN, views.TEST)
    wide = features.count_vectors(features.event_counts(rows), vocab).join(heads, "session_id")
    return vocab, stage(wide, "vectors")


def _distinct(vectors):
    return features.distinct_vectors(vectors.select("features"))


def _per_session(vectors, scored, *columns):
    """Results on distinct vectors back to every session."""
    return vectors.select("session_id", "features").join(scored.select("features", *columns), "features")


# --- Gram matrix and subspace ------------------------------------------------------------


def gram_counts(spark, sf):
    """Every pair of events, also those that never meet."""
    vocab, vectors = _vectors(spark, sf)
    name = F.array(*[F.lit(v) for v in vocab])
    rows = gram.gram_rows(_distinct(vectors))
    both = rows.union(rows.where("i < j").select("j", "i", "g"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(len(vocab) - 1).cast("bigint"))
    every = spark.range(len(vocab)).select(F.col("id").alias("i"), F.explode(places).alias("j"))
    return every.join(both, ["i", "j"], "left").select(
        name[F.col("i")].alias("event_a"), name[F.col("j")].alias("event_b"), F.coalesce(F.col("g"), F.lit(0.0)).cast("bigint").alias("g")
    )


def _pca(spark, sf):
    vocab, vectors = _vectors(spark, sf)
    return vectors, PcaModel.fit(_distinct(vectors.where("split = 'train'")), len(vocab), n_components=0.8)


def pca_fit(spark, sf):
    _, model = _pca(spark, sf)
    rows = [
        (i, j, float(v), model.threshold, model.n_components) for (i, j), v in np.ndenumerate(model.projector)
    ]
    return spark.createDataFrame(rows, "i int, j int, c double, threshold double, n_components int")


def pca_score(spark, sf):
    vectors, model = _pca(spark, sf)
    test = vectors.where("split = 'test'")
    return _per_session(test, model.score(_distinct(test)), "spe", "pred").drop("features")


def pca_score_fixed(spark, sf):
    """Residual after removing the common level of all counts (a fixed projector)."""
    vocab, vectors = _vectors(spark, sf)
    k = len(vocab)
    model = PcaModel(np.full((k, 1), k**-0.5), 2.1)
    scored = _per_session(vectors, model.score(_distinct(vectors)), "spe", "pred")
    return scored.select("session_id", r6("spe").alias("spe"), "pred")


# --- invariants --------------------------------------------------------------------------

INVARIANT_SHARE = 0.4


def inv_dimension(spark, sf):
    vocab, vectors = _vectors(spark, sf)
    distinct = _distinct(vectors)
    n = distinct.agg(F.sum("weight").alias("n")).first()["n"]
    found = invariants.space_dimension(distinct, gram.gram_matrix(distinct, len(vocab)), n, 0.5, 0.3)
    return spark.createDataFrame([(found,)], "dimension int")


def inv_zero_columns(spark, sf):
    """Occupied rows per column, padding column included (it is always empty)."""
    rows = fixtures.day_rows(spark, sf)
    counts = features.event_counts(rows).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    every = seqwin.vocabulary(rows, with_pad=True)
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "event", "left").select(
        "event", n.alias("n_rows"), (n == 0).cast("int").alias("is_zero")
    )


def inv_validate(spark, sf):
    """All column pairs and triples of events with the weights that hold often enough."""
    from itertools import combinations

    vocab, vectors = _vectors(spark, sf)
    distinct = _distinct(vectors)
    n = distinct.agg(F.sum("weight").alias("n")).first()["n"]
    sets = [c for size in (2, 3) for c in combinations(range(len(vocab)), size)]
    good = invariants.validate(distinct, gram.gram_matrix(distinct, len(vocab)), n, sets, INVARIANT_SHARE)
    rows = [(",".join(vocab[i] for i in c), [float(x) for x in w]) for c, w in good.items()]
    return spark.createDataFrame(rows, "columns string, weights array<double>")


def inv_mine(spark, sf):
    vocab, vectors = _vectors(spark, sf)
    model = InvariantModel.fit(_distinct(vectors), len(vocab), percentage=INVARIANT_SHARE)
    rows = [(",".join(vocab[i] for i in c), [float(x) for x in w]) for c, w in model.invariants.items()]
    return spark.createDataFrame(rows, "columns string, weights array<double>")


def inv_predict(spark, sf):
    """Fixed invariants: as many cheap clicks as views, and signups + purchases = 2 errors of the next price."""
    vocab, vectors = _vectors(spark, sf)
    place = {v: i for i, v in enumerate(vocab)}
    fixed = {
        (place["click:0"], place["view:0"]): [1.0, -1.0],
        (place["error:1"], place["purchase:1"], place["signup:1"]): [-2.0, 1.0, 1.0],
    }
    scored = InvariantModel(fixed).predict(_distinct(vectors))
    return _per_session(vectors, scored, "pred").select("session_id", "pred")


# --- clustering --------------------------------------------------------------------------


def _length_means(vectors):
    """``cluster, center, size``: the mean vector of all sessions of equal length."""
    rows = vectors.select(F.col("n_events").alias("cluster"), "features", F.lit(1.0).alias("weight"))
    return clustering.representatives(rows)


def clu_distance(spark, sf):
    """Distance of each session to the mean of the sessions of its own length."""
    _, vectors = _vectors(spark, sf)
    pairs = vectors.join(_length_means(vectors), F.col("n_events") == F.col("cluster"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    d = cosine_distance(
        dot("features", "center"), F.sqrt(dot("features", "features")), F.sqrt(dot("center", "center"))
    )
    return pairs.select("session_id", r6(d).alias("distance"))


def clu_nearest(spark, sf):
    _, vectors = _vectors(spark, sf)
    found = clustering.nearest(_distinct(vectors), _length_means(vectors))
    return _per_session(vectors, found, "distance").select("session_id", r6("distance").alias("distance"))


def clu_predict(spark, sf):
    _, vectors = _vectors(spark, sf)
    model = ClusterModel(_length_means(vectors), 0.3)
    return _per_session(vectors, model.predict(_distinct(vectors)), "pred").select("session_id", "pred")


def clu_pairs(spark, sf):
    """All pairs of distinct vectors within the distance limit, each once."""
    _, vectors = _vectors(spark, sf)
    numbered = stage(clustering.number_vectors(_distinct(vectors)), "numbered")
    pairs = clustering.close_pairs(numbered, 0.1)
    a = numbered.select(F.col("id").alias("a"), text(F.col("features").cast("array<int>").cast("array<string>")).alias("x"))
    b = numbered.select(F.col("id").alias("b"), text(F.col("features").cast("array<int>").cast("array<string>")).alias("y"))
    return pairs.join(a, "a").join(b, "b").select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), r6("d").alias("d")
    )


def clu_offline(spark, sf):
    _, vectors = _vectors(spark, sf)
    numbered = stage(clustering.number_vectors(_distinct(vectors)), "numbered")
    clusters = clustering.complete_linkage(numbered, 0.3)
    return numbered.join(clusters, "id").select(
        text(F.col("features").cast("array<string>")).alias("features"), "weight", "cluster"
    )


def _reps(model):
    return model.reps.select("cluster", text(F.col("center").cast("array<string>")).alias("center"), "size")


def clu_representatives(spark, sf):
    _, vectors = _vectors(spark, sf)
    return _reps(ClusterModel.fit_offline(vectors.select("features")))


def clu_bootstrap(spark, sf):
    """Clusters of the first 1,000 sessions, then all others joined or clustered on their own."""
    _, vectors = _vectors(spark, sf)
    return _reps(ClusterModel.fit_online(vectors, num_bootstrap_samples=1000))


def clu_online(spark, sf):
    _, vectors = _vectors(spark, sf)
    return _reps(ClusterModel.fit_online(vectors, num_bootstrap_samples=500))


# Below the distance of any two different directions of these counts, so clusters are whole directions.
SAME_DIRECTION = 1e-6


def direction(column):
    """A vector divided by its sum, as text."""
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    return text(F.transform(column, lambda x: F.format_string("%.4f", x / total)))


def clu_directions(spark, sf):
    """Offline clusters at a tiny limit: the distinct vectors and sessions of every direction."""
    _, vectors = _vectors(spark, sf)
    numbered = stage(clustering.number_vectors(_distinct(vectors)), "numbered")
    clustered = numbered.join(clustering.complete_linkage(numbered, SAME_DIRECTION), "id")
    return clustered.groupBy("cluster").agg(
        F.min(direction(F.col("features"))).alias("direction"),
        F.count(F.lit(1)).alias("n_vectors"),
        F.sum("weight").cast("bigint").alias("n_sessions"),
    ).drop("cluster")


def directions_of(model):
    return model.reps.select(direction(F.col("center")).alias("direction"), F.col("size").cast("bigint").alias("n_sessions"))


def clu_online_directions(spark, sf):
    """Bootstrap and online clusters at a tiny limit, which no order of the sessions can change."""
    _, vectors = _vectors(spark, sf)
    return directions_of(ClusterModel.fit_online(vectors, SAME_DIRECTION, num_bootstrap_samples=500))


# --- isolation forest --------------------------------------------------------------------


def ifo_fit(spark, sf):
    _, vectors = _vectors(spark, sf)
    model = ForestModel.fit(vectors.where("split = 'train'"))
    leaves = F.sum((F.col("feature") < 0).cast("bigint"))
    return model.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), leaves.alias("leaves"))


def ifo_predict(spark, sf):
    _, vectors = _vectors(spark, sf)
    model = ForestModel.fit(vectors.where("split = 'train'"))
    test = vectors.where("split = 'test'")
    return _per_session(test, model.predict(_distinct(test)), "score", "pred").drop("features")


def ifo_fixed(spark, sf):
    """Scores of a fixed forest: one tree for each event, in which sessions with the event end early."""
    vocab, vectors = _vectors(spark, sf)
    trees = spark.range(len(vocab)).select(F.col("id").cast("int").alias("tree"))
    shape = F.array(
        *[
            F.struct(F.lit(node).cast("bigint").alias("node"), feature.alias("feature"), F.lit(cut).alias("cut"), F.lit(depth).alias("depth"))
            for node, feature, cut, depth in (
                (1, F.col("tree"), 0.5, 0.0),
                (2, F.lit(-1), 0.0, 9.0),
                (3, F.col("tree"), 1.5, 0.0),
                (6, F.lit(-1), 0.0, 4.0),
                (7, F.lit(-1), 0.0, 2.0),
            )
        ]
    )
    model = ForestModel(trees.select("tree", F.inline(shape)), 256, 0.52)
    scored = _per_session(vectors, model.predict(_distinct(vectors)), "score", "pred")
    return scored.select("session_id", r6("score").alias("score"), "pred")


# --- supervised --------------------------------------------------------------------------


def _supervised(spark, sf, fit):
    vocab, vectors = _vectors(spark, sf)
    model = fit(vectors.where("split = 'train'").select("features", "label"), len(vocab))
    test = vectors.where("split = 'test'")
    return _per_session(test, model.predict(_distinct(test)), "pred").select("session_id", "pred")


def lr_predict(spark, sf):
    return _supervised(spark, sf, lambda t, k: classifiers.logistic_regression(t, class_weight="balanced"))


def svm_predict(spark, sf):
    return _supervised(spark, sf, lambda t, k: classifiers.linear_svm(t, class_weight="balanced"))


def svm_l1_predict(spark, sf):
    return _supervised(spark, sf, lambda t, k: classifiers.SparseSvm.fit(t, k, class_weight="balanced"))


def svm_fixed(spark, sf):
    """Margins of fixed weights: the place of each event less ten, and an offset."""
    vocab, vectors = _vectors(spark, sf)
    model = classifiers.SparseSvm(np.append(np.arange(len(vocab)) - 10.0, 4.0) / 8.0)
    return _per_session(vectors, model.predict(_distinct(vectors)), "margin", "pred").select("session_id", "margin", "pred")


def dt_predict(spark, sf):
    return _supervised(spark, sf, lambda t, k: classifiers.decision_tree(t, max_depth=8, class_weight="balanced"))


def model_report(spark, sf):
    """Fit, predict and evaluate every classical detector on the same split."""
    _, vectors = _vectors(spark, sf)
    train, test = vectors.where("split = 'train'"), vectors.where("split = 'test'")
    options = {"invariants": {"percentage": INVARIANT_SHARE}}
    report = None
    for name in FITS:
        row = Detector(name, options.get(name, {})).fit(train).evaluate(test)
        row = row.select(F.lit(name).alias("model"), *row.columns)
        report = row if report is None else report.unionByName(row)
    return report


def report_fixed(spark, sf):
    """The report of detectors with fixed parameters, over distinct vectors with weights."""
    vocab, vectors = _vectors(spark, sf)
    k = len(vocab)
    distinct = _distinct(vectors)
    scored = {
        "clustering": ClusterModel(_length_means(vectors), 0.3).predict(distinct),
        "pca": PcaModel(np.full((k, 1), k**-0.5), 2.1).score(distinct),
    }
    parts = [df.select("features", "pred", F.lit(name).alias("model")) for name, df in scored.items()]
    labelled = vectors.groupBy("features", "label").agg(F.count(F.lit(1)).alias("weight"))
    rows = parts[0].unionByName(parts[1]).join(labelled, "features")
    report = evaluate.evaluate(rows, ["model"], weight="weight")
    return report.select("model", "tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# --- trained sequence models -------------------------------------------------------------


def _softmax(spark, sf, with_counts):
    sequences = views.user_sequences(spark, sf)
    vocab = vocabulary_list(seqwin.vocabulary(fixtures.user_rows(spark, sf)))
    model = NextEventSoftmax.fit(detection.train_windows(sequences), H, vocab, with_counts, max_iter=10)
    wins = views.padded_windows(sequences.where("split = 'test'"), H + 1)
    hits = model.hits(seqwin.with_context(wins, H), views.G)
    return evaluate.session_verdict(hits, views.MAX_MISMATCH)


def next_softmax(spark, sf):
    return _softmax(spark, sf, with_counts=False)


def next_softmax_counts(spark, sf):
    return _softmax(spark, sf, with_counts=True)


def _grams(spark, sf):
    parts = split.split_uniform(views.day_heads(spark, sf), 0.3, 0.6, balanced=True)
    fixed = seqwin.fixed_length(views.day_chunks(spark, sf), 50)
    return gram_presence(fixed).join(parts.select("session_id", "label", "split"), "session_id")


def ngram_features(spark, sf):
    grams = _grams(spark, sf)
    return grams.select("session_id", "label", "split", F.explode("grams").alias("gram"))


def ngram_classify(spark, sf):
    grams = stage(_grams(spark, sf), "grams")
    model = GramClassifier.fit(grams.where("split = 'train'"))
    return model.predict(grams.where("split = 'test'")).select("session_id", "label", "pred")


def ngram_fixed(spark, sf):
    """The verdicts of fixed weights: one for each gram by its length, whatever the grams are."""
    grams = stage(_grams(spark, sf), "grams")
    weights = grams.select(F.explode("grams").alias("gram")).distinct().withColumn("weight", (F.length("gram") % 7 - 3) / 8.0)
    model = GramClassifier(weights, 0.0625)
    return model.margin(grams).select("session_id", "label", "margin", (F.col("margin") > 0).cast("int").alias("pred"))


def score_udf(spark, sf):
    """A plugged-in predictor over index-encoded windows: here a weighted sum of the slots."""
    symbols = seqwin.vocabulary(fixtures.day_rows(spark, sf)).withColumn("idx", F.col("idx") + 1)
    vocab = stage(symbols.union(spark.createDataFrame([(PAD, 0)], "event string, idx bigint")), "vocabulary")
    wins = seqwin.windows(seqwin.padded_left(views.day_chunks(spark, sf), H), H)
    coded = seqwin.indexed(wins, "win", vocab, ["session_id", "pos"]).withColumn("slots", F.col("win").cast("array<double>"))
    scored = score_with(coded, "slots", linear_predictor([0.5, 1.0, 2.0, 4.0]), H)
    return scored.select("session_id", "pos", r6("score").alias("score"))


QUERIES = {"gram": gram_counts} | {
    f.__name__: f
    for f in (
        pca_fit, pca_score, pca_score_fixed, inv_dimension, inv_zero_columns, inv_validate, inv_mine, inv_predict,
        clu_distance, clu_nearest, clu_predict, clu_pairs, clu_offline, clu_representatives, clu_bootstrap,
        clu_online, clu_directions, clu_online_directions, report_fixed, ifo_fit, ifo_predict, ifo_fixed, lr_predict, svm_predict, svm_l1_predict, svm_fixed, dt_predict, model_report,
        next_softmax, next_softmax_counts, ngram_features, ngram_classify, ngram_fixed, score_udf,
    )
}

EVENT_COUNTS = """tc as (select session_id, c.event, count(d.line_no) as x
    from (select distinct session_id from day_rows) s
    join (select distinct event from day_rows) c on true
    left join day_rows d using (session_id, event) group by session_id, c.event)"""

NEAREST = """vec as (select session_id, n_events, list(x order by event) as v
    from tc join day_seq using (session_id) group by session_id, n_events),
mean as (select n_events, list(m order by event) as m from (
    select n_events, event, avg(x) as m from tc join day_seq using (session_id)
    group by n_events, event) group by n_events),
dist as (select session_id, v.n_events as n, m.n_events as rep,
    1 - list_dot_product(v.v::double[], m.m) / (sqrt(list_dot_product(v.v::double[], v.v::double[]))
        * sqrt(list_dot_product(m.m, m.m)) + 1e-8::double) as raw from vec v, mean m),
near as (select session_id, min(case when raw < 1e-8::double then 0 else raw end) as distance from dist
    group by session_id)"""


def _count_sql(select: str, *steps: str) -> str:
    return sql("", "day_rows", "day_seq").rstrip() + ",\n" + ",\n".join((EVENT_COUNTS, *steps)) + "\n" + select


ORACLE = {
    "gram": _count_sql(
        """select a.event as event_a, b.event as event_b, cast(sum(a.x * b.x) as bigint) as g
        from tc a join tc b using (session_id) group by a.event, b.event"""
    ),
    "pca_score_fixed": _count_sql(
        """select session_id, round(spe, 6) + 0.0 as spe, cast(spe > 2.1::double as int) as pred from (
            select session_id, sum(x * x) - sum(x) * sum(x) / count(*) as spe from tc group by session_id)"""
    ),
    "inv_zero_columns": sql(
        """select event, count(session_id) as n_rows, cast(count(session_id) = 0 as int) as is_zero
        from (select distinct event from day_rows union all select '_PAD')
        left join (select distinct session_id, event from day_rows) using (event) group by event""",
        "day_rows",
    ),
    "inv_predict": _count_sql(
        """select session_id, cast(abs(sum(case event when 'click:0' then x when 'view:0' then -x else 0 end))
            + abs(sum(case event when 'error:1' then -2 * x when 'purchase:1' then x when 'signup:1' then x
                else 0 end)) > 1e-6 as int) as pred from tc group by session_id"""
    ),
    "clu_distance": _count_sql(
        """select session_id, round(case when raw < 1e-8::double then 0 else raw end, 6) + 0.0 as distance
        from dist where n = rep""",
        NEAREST,
    ),
    "clu_nearest": _count_sql("select session_id, round(distance, 6) + 0.0 as distance from near", NEAREST),
    "clu_predict": _count_sql("select session_id, cast(distance > 0.3 as int) as pred from near", NEAREST),
    "clu_pairs": _count_sql(
        """select x, y, round(d, 6) + 0.0 as d from (
            select a.t as x, b.t as y, greatest(1 - list_dot_product(a.v, b.v)
                / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8::double), 0) as d
            from u a, u b where a.t < b.t) where d <= 0.1::double""",
        NEAREST,
        "u as (select distinct v::double[] as v, array_to_string(v, ',') as t from vec)",
    ),
    "score_udf": sql(
        """select session_id, i as pos, round(0.5::double * s[i + 1] + s[i + 2] + 2 * s[i + 3] + 4 * s[i + 4], 6) as score
        from (select *, unnest(range(len(s) - 3)) as i from (
            select session_id, list(idx order by pos) as s from (
                select session_id, pos, coalesce(v.idx, 0) as idx from (
                    select session_id, unnest(e) as event, unnest(range(len(e))) as pos from (
                        select session_id, case when n_events < 4
                            then list_concat(['_PAD' for x in range(4 - n_events)], events) else events end as e
                        from day_seq))
                left join (select event, row_number() over (order by event) as idx
                    from (select distinct event from day_rows)) v using (event))
            group by session_id))""",
        "day_seq",
    ),
}

DIRECTIONS = """dirs as (select array_to_string([format('{:.4f}', x / list_sum(v)) for x in v], ',') as direction,
    v from vec)"""
ORACLE["clu_directions"] = _count_sql(
    """select direction, count(distinct v) as n_vectors, count(*) as n_sessions from dirs group by direction""",
    NEAREST,
    DIRECTIONS,
)
ORACLE["clu_online_directions"] = _count_sql(
    "select direction, count(*) as n_sessions from dirs group by direction", NEAREST, DIRECTIONS
)
ORACLE["report_fixed"] = f"""select model, tp, tn, fp, fn,
    round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) + 0.0 as precision,
    round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) + 0.0 as recall,
    round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) + 0.0 as f1
from (select model, count(*) filter (pred = 1 and label > 0) as tp, count(*) filter (pred = 0 and label = 0) as tn,
        count(*) filter (pred = 1 and label = 0) as fp, count(*) filter (pred = 0 and label > 0) as fn
    from (select 'clustering' as model, session_id, pred from ({ORACLE["clu_predict"]})
        union all select 'pca', session_id, pred from ({ORACLE["pca_score_fixed"]}))
    join ({sql("select session_id, label from day_seq", "day_seq")}) using (session_id) group by model)"""

ORACLE["ngram_features"] = (
    sql("", "day_seq").rstrip()
    + ",\nparts as ("
    + _STRAT.format(
        train="floor(0.3::double * p)",
        test="""(case when label = 1 then c - floor(0.6::double * c)
                else floor(floor(0.3::double * p) * 1.33::double) end)""",
    )
    + ")\n"
    + """select distinct session_id, label, split, array_to_string(e[i + 1 : i + n], ' ') as gram from (
        select *, unnest(range(len(e) - n + 1)) as i from (
            select session_id, label, split, events[1:50] as e, unnest([3, 4, 5]) as n
            from day_seq join parts using (session_id, label)))"""
)

ORACLE["ngram_fixed"] = (
    sql("", "day_seq").rstrip()
    + f""",
grams as ({ORACLE["ngram_features"]})
select session_id, label, margin, cast(margin > 0 as int) as pred from (
    select session_id, s.label, 0.0625::double + coalesce(sum((length(gram) % 7 - 3) / 8.0::double), 0) as margin
    from day_seq s left join grams using (session_id) group by session_id, s.label)"""
)

ORACLE["ifo_fixed"] = _count_sql(
    """select session_id, round(score, 6) + 0.0 as score, cast(score > 0.52::double as int) as pred from (
        select session_id, power(2.0::double, -avg(case when x <= 0.5 then 9.0 when x <= 1.5 then 4.0 else 2.0 end::double)
            / (2 * (ln(255.0::double) + 0.5772156649015329::double) - 2 * 255 / 256.0::double)) as score
        from tc group by session_id)"""
)

ORACLE["svm_fixed"] = _count_sql(
    """select session_id, margin, cast(margin > 0 as int) as pred from (
        select session_id, 0.5::double + sum(x * (place - 10) / 8.0::double) as margin from tc
        join (select event, row_number() over (order by event) - 1 as place from (select distinct event from day_rows))
        using (event) group by session_id)"""
)
