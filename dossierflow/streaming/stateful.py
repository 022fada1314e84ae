"""Keyed state over events: admission by a sliding window, a circuit breaker. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], taken: list[float], window_s: float, limit: int) -> tuple[list[bool], list[float]]:
    """Which calls are admitted, and the admitted ones that still count. Refused calls do not fill the window."""
    out = []
    for t in times:
        taken = [x for x in taken if x > t - window_s]
        out.append(len(taken) < limit)
        if out[-1]:
            taken.append(t)
    return out, taken


def _in_order(events: DataFrame, key: str, ts: str, tie: str, others: list[str], out: str, start: Callable, step: Callable) -> DataFrame:
    """``(key, tie, out)`` by ``step(rows, state) -> values, state`` over each key's rows in the order of time, then ``tie``.

    Keys are dealt to partitions and sorted there; a task holds a batch and
    one key's state, so a key may have any number of rows. Null keys are one key.
    """
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, start()
        for batch in batches:
            parts = []
            for k, rows in batch.groupby("__key", sort=False):
                if k != name:
                    name, state = k, start()
                values, state = step(rows, state)
                parts.append(pd.DataFrame({"key": rows["__own"], "tie": rows["__tie"], out: values}))
            yield pd.concat(parts) if parts else pd.DataFrame({"key": [], "tie": [], out: []})

    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = events.select(named.alias("__key"), F.col(key).cast("string").alias("__own"), F.col(tie).cast("string").alias("__tie"), F.col(tie).alias("__order"), F.unix_micros(ts).alias("at"), *others)
    rows = rows.repartition("__key").sortWithinPartitions("__key", "at", "__order").drop("__order")
    kind = "boolean" if out == "admitted" else "string"
    done = rows.mapInPandas(run, f"key string, tie string, {out} {kind}")
    return done.select(F.col("key").cast(kinds[key]).alias(key), F.col("tie").cast(kinds[tie]).alias(tie), out)


def admission_batch(events: DataFrame, key: str, ts: str, tie: str, window_s: float, limit: int) -> DataFrame:
    """``(key, tie, admitted)``; a key's calls in the order of time, then ``tie``. Its state is at most ``limit`` times."""
    return _in_order(events, key, ts, tie, [], "admitted", list, lambda rows, taken: admit((rows["at"] / 1e6).tolist(), taken, window_s, limit))


def admission_stream(events: DataFrame, key: str, ts: str, tie: str, window_s: float, limit: int) -> DataFrame:
    """The same over a stream: the admitted times of a key are its state, at most ``limit`` of them."""
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        group = pd.concat(list(batches)).sort_values([ts, tie])
        ok, taken = admit((group[ts].astype("int64") / 1e6).tolist(), taken, window_s, limit)
        state.update((taken,))
        yield pd.DataFrame({key: group[key], tie: group[tie], "admitted": ok})

    rows = events.select(key, tie, F.unix_micros(ts).alias(ts))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, admitted boolean", "taken array<double>", "append", GroupStateTimeout.NoTimeout)


def breaker(calls: list[tuple[float, bool]], failures: int = 5, reset_s: float = 30.0, state: tuple[int, float | None] = (0, None)) -> tuple[list[str], tuple[int, float | None]]:
    """The state that each call meets (closed, open, or half-open after ``reset_s``), and what is left: failures in a row and when it opened."""
    (count, opened), out = state, []
    for t, ok in calls:
        met = "closed" if opened is None else "open" if t - opened < reset_s else "half_open"
        out.append(met)
        if met == "open":
            continue
        if ok:
            count, opened = 0, None
        else:
            count += 1
            if met == "half_open" or count >= failures:
                opened = t
    return out, (count, opened)


def breaker_states(events: DataFrame, key: str, ts: str, tie: str, ok: str, failures: int = 5, reset_s: float = 30.0) -> DataFrame:
    """``(key, tie, state)``; a key's calls in the order of time, then ``tie``."""
    calls = lambda rows: list(zip((rows["at"] / 1e6).tolist(), rows["ok"].tolist(), strict=True))
    return _in_order(events.withColumn("ok", F.col(ok)), key, ts, tie, ["ok"], "state", lambda: (0, None), lambda rows, state: breaker(calls(rows), failures, reset_s, state))


def breaker_stream(events: DataFrame, key: str, ts: str, tie: str, ok: str, failures: int = 5, reset_s: float = 30.0) -> DataFrame:
    """The same over a stream: a key's state is its failures in a row and when it opened."""
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (0, None)
        group = pd.concat(list(batches)).sort_values([ts, tie])
        met, held = breaker(list(zip((group[ts] / 1e6).tolist(), group[ok].tolist(), strict=True)), failures, reset_s, held)
        state.update(held)
        yield pd.DataFrame({key: group[key], tie: group[tie], "state": met})

    rows = events.select(key, tie, ok, F.unix_micros(ts).alias(ts))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, state string", "failures int, opened double", "append", GroupStateTimeout.NoTimeout)
