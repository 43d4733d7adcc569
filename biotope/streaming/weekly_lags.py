"""Lags and trailing sums of weekly values along a stream, from a short ring of weeks per site."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from biotope.session import ship_package

LATENESS = "14 days"
DAY_MS = 86_400_000
#: Days without a new week after which a site's ring is given up.
SILENT_DAYS = 2 * 366


def emitted(ring: list, week: int, value: float | None, lags: Sequence[int], width: int) -> list:
    """Values ``lags`` weeks back and the sum of the ``width`` weeks before, NULL unless all are known; the ring moves on."""
    before = [v for _, v in ring]
    row = [before[-k] if len(before) >= k else None for k in lags]
    trailing = before[-width:]
    row.append(sum(trailing) if len(trailing) == width and None not in trailing else None)
    ring.append([week, value])
    del ring[: max(0, len(ring) - max([width, *lags]))]
    return row


def weekly_lags(
    weeks: DataFrame, site: str = "site", week: str = "week_start", value: str = "cases_a", lags: Sequence[int] = (1, 2), width: int = 4, lateness: str = LATENESS
) -> DataFrame:
    """(site, week, value, lag_k ..., prev_sum, repeated) of each week of a stream.

    A week waits until the watermark has passed its start, so weeks may come in any order within ``lateness``; an
    event-time timer brings out those of sites that fall silent. Lags count the site's weeks, as the batch
    operators do. A week that is there a second time has ``repeated`` true and no lags, and changes none; of weeks that
    arrive together the smaller value comes first. A week behind the watermark is left out (``streaming.late`` keeps
    such rows where the days are made). State is the last ``max(width, lags)`` weeks and the waiting ones.
    """
    ship_package(weeks.sparkSession)
    kinds = dict(weeks.dtypes)
    names = [f"lag_{k}" for k in lags]
    out = ", ".join([f"{site} {kinds[site]}", f"{week} date", f"{value} double", *[f"{n} double" for n in names], "prev_sum double", "repeated boolean"])
    columns = [site, week, value, *names, "prev_sum", "repeated"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"ring": [], "waiting": []}
        ring, waiting, rows = held["ring"], held["waiting"], []
        if not state.hasTimedOut:
            for part in parts:
                for at, v in zip(part["at"], part["v"], strict=True):
                    waiting.append([int(at), None if pd.isna(v) else float(v)])
        mark = state.getCurrentWatermarkMs()
        for at, v in sorted((w for w in waiting if w[0] <= mark), key=lambda w: (w[0], w[1] is None, w[1])):
            again = bool(ring) and at <= ring[-1][0]
            rows.append((key[0], pd.Timestamp(at, unit="ms").date(), v, *([None] * (len(lags) + 1) if again else emitted(ring, at, v, lags, width)), again))
        waiting = [w for w in waiting if w[0] > mark]
        if state.hasTimedOut and not waiting and not rows:
            state.remove()
        else:
            state.update((json.dumps({"ring": ring, "waiting": waiting}),))
            newest = ring[-1][0] if ring else mark
            state.setTimeoutTimestamp(max(mark + 1, min(w[0] for w in waiting) if waiting else newest + SILENT_DAYS * DAY_MS))
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({c: "float64" for c in [value, *names, "prev_sum"]})

    timed = weeks.select(F.col(site), F.col(week).cast("timestamp").alias("week_time"), F.col(value).cast("double").alias("v")).where("week_time is not null")
    marked = timed.withWatermark("week_time", lateness).withColumn("at", F.unix_millis("week_time"))
    return marked.groupBy(site).applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)
