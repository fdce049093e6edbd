"""Forest-loss alerts kept up by a stream: the state machine of ``operators.bayts``, a state each pixel, continued from earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.bayts import NAMES, STATE, Rules

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after(s: tuple, date: float, orbit: int, pnf: float, vh: float, wetland: bool, r: Rules) -> tuple:
    """The state after an observation (the same rules as ``operators.bayts.step``)."""
    before, changed, flag, flagged_by, first, confirmed = s
    if flag != 2 and (max(first, confirmed) - date) * 365 > r.max_days:
        flag = 0
    pnf = vh if wetland and s[2] == 1 else pnf
    same = flagged_by in (0, orbit) or pnf >= r.min_non_forest
    prior = before if flag == 0 else changed
    if flag == 1 and not same:
        p = changed
    elif flag == 0 and pnf < r.min_non_forest:
        p = 0.0
    else:
        p = prior * pnf / (prior * pnf + (1 - prior) * (1 - pnf))
    now = flag
    if flag == 1 and same:
        now = 0 if p < r.min_change else 1 if p < r.high_confidence else 2
    elif flag == 0:
        now = 0 if pnf < r.min_non_forest else 1 if p < r.high_confidence else 2
    if now == 0:
        return (pnf, p, 0, 0, 0.0, 0.0)
    if now == flag:
        return (pnf, p, now, flagged_by, first, confirmed)
    return (pnf, p, now, orbit, date if now == 1 else first, date if now == 2 else confirmed)


class Monitor(StatefulProcessor):
    """Folds a pixel's observations in order of date and orbit; those older than what it has folded are late: counted, not folded."""

    def __init__(self, key: str, rules: Rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"{STATE}, last double, late long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else (0.5, 0.0, 0, 0, 0.0, 0.0, float("-inf"), 0)
        s, last, late = tuple(kept[:6]), kept[6], kept[7]
        batch = pd.concat(list(rows)).sort_values(["date", "orbit"])  # a pixel's part of one micro-batch
        for date, orbit, pnf, vh, wetland in batch[["date", "orbit", "pnf", "vh_pnf", "wetland"]].itertuples(index=False, name=None):
            if date < last:
                late += 1
                continue
            s, last = after(s, date, int(orbit), pnf, vh, bool(wetland), self.rules), date
        self.state.update((*s, last, late))
        yield pd.DataFrame([(*key, *s, late)], columns=[self.key, *NAMES, "late"])

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers) -> None:
        row = initial.iloc[0]
        held = (float(row[n]) if n not in ("flag", "flag_orbit") else int(row[n]) for n in NAMES)
        self.state.update((*held, float(row["last"]) if "last" in row and pd.notna(row["last"]) else float("-inf"), 0))

    def close(self) -> None:
        pass


def monitored(stream: DataFrame, key: str, rules: Rules = Rules(), initial: DataFrame | None = None) -> DataFrame:
    """A stream of ``(key, <state>, late)`` after each micro-batch, of a stream of ``(key, date, orbit, pnf, vh_pnf, wetland)``.

    ``initial`` ``(key, <state>)``, and ``last``, the date up to which it holds, if there is one: the states to begin with. The state
    store is RocksDB, so that states beyond memory lie on disk and only changed ones are written at each checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(stream.dtypes)[key]
    start = None if initial is None else initial.groupBy(key)
    return stream.groupBy(key).transformWithStateInPandas(Monitor(key, rules), f"`{key}` {kind}, {STATE}, late long", "Update", "None", start)
