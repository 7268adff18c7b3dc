"""Live drift monitor: the CUSUM of every series as its points arrive."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "held array<long>, v array<double>, mu double, sd double, s_hi double, s_lo double, last long"
OUTPUT = "series string, us long, v double, s_hi double, s_lo double, signal string"


def stream_cusum(points: DataFrame, k: float = 0.5, h: float = 4.0, baseline_n: int = 28, delay: str = "0 seconds", idle: dt.timedelta = dt.timedelta(days=28)) -> DataFrame:
    """(series, at, v) points in, accumulators and signals out.

    Points wait in the state until the watermark, ``delay`` behind the latest point of all series, has reached them, and
    are charted in order of time; files and batches may bring them in any order within ``delay``. The baseline is the
    first ``baseline_n`` points. A series that has fewer is charted on what it has once the watermark is ``idle`` past
    its last point. A point not after one already charted cannot be charted any more: it comes out with signal ``late``
    and without accumulators. A row with neither series nor value is no point but moves the watermark: one far enough
    ahead ends a run, so that all points come out.
    """
    want, idle_us = max(2, baseline_n), idle // dt.timedelta(microseconds=1)

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = [(int(us), float(v)) for rows in batches for us, v in zip(rows["us"], rows["v"]) if not (pd.isna(key[0]) and pd.isna(v))]
        held, values, mu, sd, hi, lo, last = state.get if state.exists else ([], [], None, None, 0.0, 0.0, None)
        late = sorted(p for p in new if last is not None and p[0] <= last)
        todo = sorted([*zip(held or [], values or []), *(p for p in new if last is None or p[0] > last)])
        now = state.getCurrentWatermarkMs()
        ready = [p for p in todo if p[0] // 1000 <= now]
        if mu is None and (len(ready) >= want or (ready and (todo[-1][0] + idle_us) // 1000 <= now)):
            base = [v for _, v in ready[:want]]
            mu = sum(base) / len(base)
            sd = math.sqrt(sum((v - mu) ** 2 for v in base) / max(1, len(base) - 1)) or 1e-9
        out = [(key[0], us, v, None, None, "late") for us, v in late]
        if mu is not None:
            for us, v in ready:
                x = (v - mu) / sd
                hi, lo, last = max(0.0, hi + x - k), max(0.0, lo - x - k), us
                out.append((key[0], us, v, hi, lo, "high" if hi > h else "low" if lo > h else None))
            todo = todo[len(ready) :]
        if todo or mu is not None:
            state.update(([int(us) for us, _ in todo], [float(v) for _, v in todo], mu, sd, float(hi), float(lo), last))
        if todo:
            due = todo[0][0] if mu is not None else todo[want - 1][0] if len(todo) >= want else todo[-1][0] + idle_us
            # A timer fires when the watermark is past it.
            state.setTimeoutTimestamp(max(due // 1000 - 1, now))
        if out:
            yield pd.DataFrame(out, columns=["series", "us", "v", "s_hi", "s_lo", "signal"])

    # Spark drops rows behind the watermark by the column that bears it. After the watermark is taken, a column that is never
    # late bears it instead, so that late points come here too.
    never = F.timestamp_seconds(F.lit(9_200_000_000)).alias("_never", metadata={"spark.watermarkDelayMs": 0})
    timed = points.withWatermark("at", delay).select("series", F.unix_micros("at").alias("us"), F.col("v").cast("double").alias("v"), never)
    charted = timed.groupBy("series").applyInPandasWithState(advance, OUTPUT, STATE, "append", "EventTimeTimeout")
    return charted.select("series", F.timestamp_micros("us").alias("at"), "v", "s_hi", "s_lo", "signal")
