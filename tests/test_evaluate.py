import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import collect, evaluate


def scores(spark, normal, anomalous):
    rows = [(float(s), 0) for s in normal] + [(float(s), 1) for s in anomalous]
    return spark.createDataFrame(rows, "score double, label int")


def naive_boundary(normal, anomalous):
    best = None
    for b in sorted(set(anomalous)):
        caught, wrong = sum(a <= b for a in anomalous), sum(n <= b for n in normal)
        cost = (len(anomalous) + wrong) / caught
        if best is None or cost < best[0]:
            best = (cost, b, caught / (caught + wrong), caught / len(anomalous))
    return best[1:]


def test_boundary_by_hand(spark):
    row = evaluate.best_boundary(scores(spark, [-1, -2], [-3, -2])).first()
    assert row["boundary"] == -2
    assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((2 / 3, 1.0, 0.8))


@pytest.mark.parametrize("seed", range(4))
def test_boundary_equals_trying_every_score(spark, seed):
    rng = random.Random(seed)
    normal = [-rng.randint(0, 12) for _ in range(rng.randint(0, 30))]
    anomalous = [-rng.randint(2, 15) for _ in range(rng.randint(1, 20))]
    row = evaluate.best_boundary(scores(spark, normal, anomalous)).first()
    assert (row["boundary"], row["precision"], row["recall"]) == pytest.approx(naive_boundary(normal, anomalous))


def test_report_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    row = evaluate.evaluate(df).first()
    assert (row["tp"], row["tn"], row["precision"], row["recall"], row["f1"]) == (0, 2, 0.0, 0.0, 0.0)


def test_verdict_is_strictly_above_the_rate(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "session_id string, hit boolean")
    got = {r["session_id"]: r["pred"] for r in evaluate.session_verdict(df, 0.5).collect()}
    assert got == {"a": 0, "b": 1}


def test_earliest_candidate_wins_a_tie(spark):
    df = spark.createDataFrame([(0, "x", 0.5), (1, "y", 0.7), (2, "z", 0.7)], "candidate_no int, candidate string, f1 double")
    assert evaluate.select_by_f1(df).first()["candidate"] == "y"


def test_outcomes(spark):
    rows = [(f"s{i}", i, i % 2, int(i > 3)) for i in range(8)]
    df = spark.createDataFrame(rows, "session_id string, first_line bigint, label int, pred int")
    tagged = collect.tag_outcomes(df)
    got = {r["session_id"]: r["outcome"] for r in tagged.collect()}
    assert got["s0"] == "tn" and got["s1"] == "fn" and got["s4"] == "fp" and got["s5"] == "tp"
    sampled = collect.sample_outcomes(tagged, 1).collect()
    assert sorted(r["session_id"] for r in sampled) == ["s0", "s1", "s4", "s5"]
    assert collect.sample_outcomes(tagged, None).count() == 8
    assert {r["outcome"] for r in collect.tag_outcomes(df, ("fp",)).collect()} == {"fp"}


def test_render_and_templates(spark):
    chunks = spark.createDataFrame([("s", 0, ["E1", "E2"])], "session_id string, chunk bigint, events array<string>")
    table = spark.createDataFrame([("E1", "one"), ("E2", "two")], "EventId string, EventTemplate string")
    named = collect.expand_templates(chunks, table)
    assert named.first()["events"] == ["E1 one", "E2 two"]
    assert collect.render(chunks).first()["text"] == "E1 E2"
    assert collect.render(named, one_event_per_line=True).first()["text"] == "E1 one\nE2 two\n"
    with pytest.raises(Exception, match="no template"):
        collect.expand_templates(chunks, table.where(F.col("EventId") == "E1")).collect()


def test_no_anomaly_has_no_boundary(spark):
    with pytest.raises(Exception, match="no anomalous session"):
        evaluate.best_boundary(scores(spark, [-1, -2], [])).collect()


@pytest.mark.parametrize("row", [(None, 1), (1, None)])
def test_unknown_verdicts_are_an_error(spark, row):
    df = spark.createDataFrame([(1, 1), row], "pred int, label int")
    with pytest.raises(Exception, match="is null"):
        evaluate.confusion(df).collect()


def test_weighted_confusion(spark):
    df = spark.createDataFrame([(1, 1, 3), (0, 1, 2), (1, 0, 4), (0, 0, 5)], "pred int, label int, weight int")
    assert tuple(evaluate.confusion(df, weight="weight").first()) == (3, 5, 4, 2)
