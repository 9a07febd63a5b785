"""Series over a stream of raw rows in event time: dense panels, recurrences and forecasts, from (series_id, at, amount) rows to results in one stateful step.

A series' rows fall into windows of ``Grid.width`` milliseconds, numbered from ``Grid.origin``; a window's number is its step t. Rows may come in any order.
The watermark is that of the windows' ends: when no row of an open window can be more than ``Grid.delay`` late any more, a timer closes it, empty
ones with the fill, and the series' steps go on in order. Rows of closed windows are late: they are dropped and counted (``runs.late_rows``), never an error.

A series' state is its open windows, at most as many as the delay has, and what its learner holds, both of fixed size; it lives in the state store and goes on after
a restart. A series silent for ``Grid.idle`` steps stops its timer and fills the gap when it wakes; after ``Grid.forget`` more it is dropped and would start anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelcast.functions.kernels import OnlineSeries, recurred


@dataclass(frozen=True)
class Grid:
    """Windows of ``width`` from ``origin``, in milliseconds, and what becomes of the rows in one.

    combine: ``sum`` adds amounts (to 4 decimals, as ``dense_panel`` does); ``one`` takes a step's value once, however often it comes (the least, if
    copies differ). fill: the value of an empty window; None holds the last one. since: steps from the ``origin`` on, or from a series' ``first`` row.
    """

    origin: int
    width: int
    delay: str
    combine: str = "sum"
    fill: float | None = 0.0
    since: str = "origin"
    idle: int | None = None
    forget: int | None = None

    def __post_init__(self):
        if self.combine not in ("sum", "one") or self.since not in ("origin", "first"):
            raise ValueError("combine is sum or one, since is origin or first")
        if self.forget and (self.since == "origin" or not self.idle):
            raise ValueError("only series that start at their first row and go idle can be forgotten")


class Panel:
    """The closed steps themselves."""

    FIELDS: tuple[str, ...] = ()
    OUT = "series_id string, t long, value double"

    def start(self) -> dict:
        return {}

    def packed(self, held: dict) -> list[bytes]:
        return []

    def unpacked(self, packed: list[bytes]) -> dict:
        return {}

    def step(self, held: dict, t0: int, x) -> dict:
        import numpy as np

        return {"t": t0 + np.arange(len(x)), "value": x}


class Oscillators:
    """h_t = lambda h_{t-1} + b x_t for (radius, angle, b) of the bank: real parts, then imaginary parts."""

    FIELDS = ("h",)
    OUT = "series_id string, t long, context array<double>"

    def __init__(self, bank):
        import numpy as np

        self.turns, self.gain = np.array([r * np.exp(1j * t) for r, t, _ in bank], dtype=complex), np.array([b for _, _, b in bank], dtype=float)

    def start(self) -> dict:
        return {"h": self.turns * 0}

    def packed(self, held: dict) -> list[bytes]:
        return [held["h"].tobytes()]

    def unpacked(self, packed: list[bytes]) -> dict:
        import numpy as np

        return {"h": np.frombuffer(packed[0], dtype=complex)}

    def step(self, held: dict, t0: int, x) -> dict:
        import numpy as np

        h = recurred(x[:, None] * self.gain, self.turns, held["h"])
        held["h"] = h[-1]
        return {"t": t0 + np.arange(len(x)), "context": list(np.concatenate([h.real, h.imag], axis=1))}


class Forecasts(OnlineSeries):
    """Update, then forecast, as ``OnlineSeries`` does; each forecast comes out when its target has."""

    OUT = "series_id string, t long, r int, yhat double, err double"

    def step(self, held: dict, t0: int, x) -> dict:
        return dict(zip(("t", "r", "yhat", "err"), self.advance(held, t0, x), strict=True))


class Steps(StatefulProcessor):
    """Collects a series' rows into open windows and hands closed ones, in order, to a learner."""

    def __init__(self, grid: Grid, learner):
        self.grid, self.learner = grid, learner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", ", ".join(["next long", "silent long", "timer long", "last double", "opened binary", "amounts binary", *(f"{f} binary" for f in self.learner.FIELDS)]))

    def _load(self):
        import numpy as np

        row = self.state.get()
        if row is None:
            return None
        t, silent, timer, last, opened, amounts, *fields = row
        windows = dict(zip(np.frombuffer(bytes(opened), dtype=np.int64).tolist(), np.frombuffer(bytes(amounts), dtype=float).tolist(), strict=True))
        return t, silent, timer, last, windows, self.learner.unpacked([bytes(f) for f in fields])

    def _store(self, t: int, silent: int, timer: int, last: float, windows: dict, held: dict) -> None:
        import numpy as np

        opened, amounts = np.array(list(windows), dtype=np.int64), np.array(list(windows.values()), dtype=float)
        self.state.update((int(t), int(silent), int(timer), float(last), opened.tobytes(), amounts.tobytes(), *self.learner.packed(held)))

    def _ring_at(self, step: int) -> int:
        """Set the timer for the end of a step."""
        at = self.grid.origin + (step + 1) * self.grid.width
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        g = pd.concat(list(rows))
        by = g.groupby("step")["amount"]
        came = (by.sum() if self.grid.combine == "sum" else by.min()).to_dict()
        loaded = self._load()
        if loaded is None:
            t, silent, timer, last, windows, held = (0 if self.grid.since == "origin" else min(came)), 0, 0, float("nan"), {}, self.learner.start()
        else:
            t, silent, timer, last, windows, held = loaded
        for step, v in came.items():
            if step >= t:
                old = windows.get(step)
                windows[step] = v if old is None else old + v if self.grid.combine == "sum" else min(old, v)
        if timer and silent and windows:  # a sleeper wakes: its timer may lie far off
            self.handle.deleteTimer(timer)
            timer = 0
        if not timer and windows:
            timer = self._ring_at(t)
        self._store(t, silent, timer, last, windows, held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np
        import pandas as pd

        loaded = self._load()
        if loaded is None:  # the series was forgotten
            return
        t, silent, _, last, windows, held = loaded
        upto = (timerValues.getCurrentWatermarkInMs() - self.grid.origin) // self.grid.width
        if self.grid.forget and not windows and silent >= self.grid.idle:
            self.state.clear()
            return
        if upto <= t:
            self._store(t, silent, self._ring_at(t), last, windows, held)
            return
        x = np.array([windows.pop(k, np.nan) for k in range(t, upto)])
        if self.grid.combine == "sum":
            x = np.round(x, 4)
        came = np.flatnonzero(~np.isnan(x))
        silent = len(x) - 1 - int(came[-1]) if len(came) else silent + len(x)
        asleep = bool(self.grid.idle) and silent >= self.grid.idle and not windows
        if asleep:  # the silent steps are filled when the series wakes, if it does
            x = x[: int(came[-1]) + 1 if len(came) else 0]
        if self.grid.fill is None:
            x = pd.Series(np.concatenate([[last], x])).ffill().to_numpy()[1:]
        else:
            x = np.where(np.isnan(x), self.grid.fill, x)
        if len(x):
            last = x[-1]
            out = pd.DataFrame(self.learner.step(held, int(t), x))
            if len(out):
                out.insert(0, "series_id", pd.Series([key[0]] * len(out), dtype=object))
                yield out
        t += len(x)
        timer = 0 if asleep and not self.grid.forget else self._ring_at(upto - 1 + self.grid.forget if asleep else upto)
        self._store(t, silent, timer, last, windows, held)

    def close(self) -> None:
        pass


def in_steps(facts: DataFrame, grid: Grid, learner) -> DataFrame:
    """Run a learner over a stream of (series_id, at TIMESTAMP, amount) rows."""
    step = F.floor((F.unix_micros("at") - F.lit(grid.origin * 1000)) / F.lit(grid.width * 1000)).cast("long")
    rows = facts.select("series_id", step.alias("step"), F.col("amount").cast("double").alias("amount")).where("step >= 0 AND amount IS NOT NULL")
    timed = rows.withColumn("ends", F.timestamp_millis(F.lit(grid.origin) + (F.col("step") + 1) * grid.width)).withWatermark("ends", grid.delay)
    return timed.groupBy("series_id").transformWithStateInPandas(Steps(grid, learner), learner.OUT, "append", "eventTime")


def dense_steps(facts: DataFrame, grid: Grid) -> DataFrame:
    """(series_id, t, value): every closed step of every series."""
    return in_steps(facts, grid, Panel())


def oscillator_steps(facts: DataFrame, grid: Grid, bank) -> DataFrame:
    """(series_id, t, context): what ``features.oscillators`` gives on the dense panel."""
    return in_steps(facts, grid, Oscillators(bank))


def forecast_steps(facts: DataFrame, grid: Grid, train_end: int, first: int, horizon: int, lookback: int, cadence: int, bins: int = 8, lam: float = 1e-3, online: bool = True, bank=(), plain: bool = False) -> DataFrame:
    """(series_id, t, r, yhat, err): what ``online.sweep`` gives on the dense panel, fit and features included, each forecast as soon as its target has come."""
    return in_steps(facts, grid, Forecasts(train_end, first, horizon, lookback, cadence, bins, lam, online, tuple(bank), plain))
