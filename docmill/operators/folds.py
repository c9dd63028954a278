"""Sequential rules over ordered events: limiters and cooldowns.

A rule keeps a small state for each key. Rows are shuffled by key, sorted, and streamed through the rule in
Arrow batches, so memory is bounded by a batch and a state however many rows a key has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from math import inf, nan

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule makes a function from (seconds, value) to an outcome. It goes on from a state, a list of numbers that the function
#: keeps as its ``state``; without one it starts anew.
Rule = Callable[..., Callable[[float, float], bool]]


def _with_state(step: Callable[[float, float], bool], state: list[float] | deque[float]) -> Callable[[float, float], bool]:
    step.state = state
    return step


def fixed_window(rate: float, size: float) -> Rule:
    """A window opens at the first request ``size`` or later after the last one opened; it admits ``rate * size``."""

    def start(state: list[float] | None = None):
        held, most = state or [-inf, 0.0], int(rate * size)  # when it opened, and how many it has admitted

        def step(at: float, _: float) -> bool:
            if at - held[0] >= size:
                held[:] = [at, 0.0]
            ok = held[1] < most
            held[1] += ok
            return ok

        return _with_state(step, held)

    return start


def sliding_window(rate: float, size: float) -> Rule:
    """At most ``rate * size`` admitted requests in any ``size`` seconds."""

    def start(state: list[float] | None = None):
        log, most = deque(state or ()), int(rate * size)

        def step(at: float, _: float) -> bool:
            while log and at - log[0] >= size:
                log.popleft()
            if ok := len(log) < most:
                log.append(at)
            return ok

        return _with_state(step, log)

    return start


def token_bucket(rate: float, size: float) -> Rule:
    def start(state: list[float] | None = None):
        held = state or [float(size), nan]  # tokens, and the time of the last request

        def step(at: float, _: float) -> bool:
            tokens = min(size, held[0] + (at - held[1] if held[1] == held[1] else 0.0) * rate)
            ok = tokens >= 1
            held[:] = [tokens - ok, at]
            return ok

        return _with_state(step, held)

    return start


def leaky_bucket(rate: float, size: float) -> Rule:
    def start(state: list[float] | None = None):
        held = state or [0.0, nan]  # volume, and the time of the last request

        def step(at: float, _: float) -> bool:
            volume = max(0.0, held[0] - (at - held[1] if held[1] == held[1] else 0.0) * rate)
            ok = volume < size
            held[:] = [volume + ok, at]
            return ok

        return _with_state(step, held)

    return start


def least_gap(seconds: float) -> Rule:
    def start(state: list[float] | None = None):
        held = state or [-inf]  # when one was last admitted

        def step(at: float, _: float) -> bool:
            ok = at - held[0] >= seconds
            held[0] = at if ok else held[0]
            return ok

        return _with_state(step, held)

    return start


def cooldown(bound: float, seconds: float) -> Rule:
    """Fires where the value is over ``bound`` and ``seconds`` have passed since it last fired."""

    def start(state: list[float] | None = None):
        held = state or [-inf]  # when it last fired

        def step(at: float, value: float) -> bool:
            ok = value > bound and at - held[0] >= seconds
            held[0] = at if ok else held[0]
            return ok

        return _with_state(step, held)

    return start


def fold(df: DataFrame, key: str, time: str, tie: str, value: str, rule, output: str, kind: str = "boolean") -> DataFrame:
    """``df`` and the outcome of ``rule`` for each row, taken by ``key`` in the order of ``time`` and ``tie``. Rows without key or time are one key and come first."""
    names = df.columns

    def run(batches):
        state, current, begun = None, None, False
        for pdf in batches:
            out = []
            seconds = pdf[time].astype("int64").to_numpy() / 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[pd.Series(pdf[time]).dt.unit]
            for k, at, v in zip(pdf[key], seconds, pdf[value]):
                k = None if pd.isna(k) else k
                if not begun or k != current:
                    state, current, begun = rule(), k, True
                out.append(state(at, v))
            yield pdf.assign(**{output: out})[[*names, output]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(run, f"{schema}, `{output}` {kind}")


def all_admit(df: DataFrame, keys: list[tuple[str, Rule]], time: str, tie: str, output: str) -> DataFrame:
    """Requests that pass one limiter after another: each sees only what those before it have admitted."""
    admitted, names = df, df.columns
    for key, rule in keys:
        admitted = fold(admitted, key, time, tie, tie, rule, output).where(output).select(*names)
    marked = admitted.select(tie).withColumn(output, F.lit(True))
    return df.join(marked, tie, "left").withColumn(output, F.coalesce(output, F.lit(False)))
