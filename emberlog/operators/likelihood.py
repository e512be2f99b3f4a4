"""Window log-likelihood: how probable the last event of a window is after the ones before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import seqwin
from emberlog.operators.nextevent import NextEventModel, session_min_likelihood
from emberlog.operators.sessions import CHUNK_LEN, HALO


def fit_window_model(
    train_chunks: DataFrame, width: int, distinct: bool = False, chunk_len: int = CHUNK_LEN, halo: int = HALO
) -> NextEventModel:
    """Fit on the windows of unpadded training sessions; ``distinct`` counts each window once."""
    wins = seqwin.windows(train_chunks, width, chunk_len, halo)
    weighted = seqwin.distinct_windows(wins)
    if distinct:
        weighted = weighted.withColumn("weight", F.lit(1))
    return NextEventModel.fit(seqwin.with_context(weighted, width - 1), width - 1)


def window_log_likelihood(
    model: NextEventModel, chunks: DataFrame, lower_bound: int, chunk_len: int = CHUNK_LEN, halo: int = HALO
) -> DataFrame:
    """``session_id, pos, ll`` over the windows of left-padded sessions."""
    width = model.h + 1
    if lower_bound < width:
        raise ValueError("the padding bound must be at least the window width")
    padded = seqwin.padded_left(chunks, lower_bound, chunk_len)
    wins = seqwin.with_context(seqwin.windows(padded, width, chunk_len, halo), model.h)
    return model.log_likelihood(wins).select("session_id", "pos", "ll")


def session_scores(window_ll: DataFrame) -> DataFrame:
    """A session is as likely as its least likely window."""
    return session_min_likelihood(window_ll)
