import random

import pytest

from emberlog.operators import timewin
from emberlog.operators.timewin import WindowPlan


def rows_of(spark, times, bad=()):
    data = [(i, t, f"e{i % 3}", int(i in bad)) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "line_no bigint, t bigint, event string, bad int")


def plan_of(rows, width, step):
    """A plan with the width and step given in seconds."""
    return WindowPlan.of(rows, width / timewin.HOUR, step / timewin.HOUR)


def walked(times, width, step):
    """Windows by walking the two ends along the log: the definition."""
    n, low, high = len(times), 0, 0
    start, end = times[0], None
    while high < n and times[high] < start + width:
        end = times[high]
        high += 1
    if high == n:
        return []
    out = [(low, high)]
    while high < n:
        start, end = start + step, end + step
        old_high = high
        while low < old_high and times[low] < start:
            low += 1
        while high < n and times[high] < end:
            high += 1
        out.append((low, high))
    return out


def test_by_hand(spark):
    rows = rows_of(spark, [0, 3, 9, 12, 20])
    plan = plan_of(rows, 10, 5)
    assert (plan.first_end, plan.last) == (9, 3)
    got = {}
    for r in timewin.members(rows, plan).collect():
        got.setdefault(r["win"], set()).add(r["t"])
    assert got == {0: {0, 3, 9}, 1: {9, 12}, 2: {12}, 3: {20}}


def test_log_shorter_than_a_window_has_none(spark):
    rows = rows_of(spark, [0, 1])
    plan = plan_of(rows, 10, 5)
    assert timewin.members(rows, plan).count() == 0
    assert timewin.all_windows(rows, plan).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_members_equal_walking(spark, seed):
    rng = random.Random(seed)
    times = sorted(rng.randint(0, 60) for _ in range(rng.randint(2, 40)))
    width, step = rng.choice([(10, 5), (7, 7), (4, 9), (15, 4)])
    rows = rows_of(spark, times)
    plan = plan_of(rows, width, step)
    expected = walked(times, width, step)
    got = sorted((r["win"], r["line_no"]) for r in timewin.members(rows, plan).collect())
    assert got == [(k, i) for k, (a, b) in enumerate(expected) for i in range(a, b)]
    if expected:
        bounds = timewin.bounds(rows, plan, width=8)
        filled = {r["win"]: (r["start_index"], r["end_index"]) for r in bounds.collect()}
        assert len(filled) == len(expected)
        assert all(filled[k] == (a, b) for k, (a, b) in enumerate(expected) if a < b)
        assert all(filled[k][0] == filled[k][1] for k, (a, b) in enumerate(expected) if a >= b)
        again = timewin.members_from_bounds(rows, bounds, block=4).collect()
        assert sorted((r["win"], r["line_no"]) for r in again) == got


def test_labels_and_counts(spark):
    rows = rows_of(spark, [0, 3, 9, 12, 40], bad={3})
    plan = plan_of(rows, 10, 5)
    found, every = timewin.members(rows, plan), timewin.all_windows(rows, plan)
    labels = {r["win"]: r["label"] for r in timewin.labels(found, every).collect()}
    assert labels == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    counts = {(r["win"], r["event"]): r["cnt"] for r in timewin.counts(found).collect()}
    assert counts[0, "e0"] == 1 and counts[1, "e0"] == 1
    total = timewin.summary(found, every, rows).first()
    assert (total["windows"], total["anomalies"], total["events"]) == (8, 2, 3)
