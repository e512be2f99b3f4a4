import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlog.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_rows(spark):
    """Log rows from ``{session: [events]}``; sessions take turns, so lines interleave."""

    def build(sessions, label=None):
        label = label or {}
        rows, line, longest = [], 0, max(map(len, sessions.values()))
        for i in range(longest):
            for name, events in sessions.items():
                if i < len(events):
                    rows.append((name, line, events[i], label.get(name, 0)))
                    line += 1
        return spark.createDataFrame(rows, "session_id string, line_no bigint, event string, bad int")

    return build
