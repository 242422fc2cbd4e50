"""The running score over a stream: state per capability is the score and the count. running_scores() takes rows that arrive in order per key;
ordered_scores() takes them in any order within a delay, and folds them by their time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.workers import sent_by_value

sent_by_value(__name__)


def running_scores(rows: DataFrame, keys: list[str], key_schema: str, order: str, score: str) -> DataFrame:
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, n = state.get if state.exists else (0.0, 0)
        for x in pd.concat(list(batches)).sort_values(order, kind="stable")[score]:
            s, n = (float(x) if n == 0 else float(round((s * n + x) / (n + 1)))), n + 1
        state.update((s, n))
        yield pd.DataFrame([(*key, int(s), n)], columns=[*keys, "score", "observations"])

    return rows.groupBy(*keys).applyInPandasWithState(fold, f"{key_schema}, score int, observations int", "s double, n int", "update", GroupStateTimeout.NoTimeout)


class _Ordered(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; a timer at the first of them folds all that are due, by time and number."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, score int")
        self.held = handle.getValueState("held", "s double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [x for b in rows for x in b.iloc[:, -3:].itertuples(index=False, name=None)]
        new = [tuple(map(int, x)) for x in new]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due = [x for x in rows if x[0] <= now]
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if due:
            s, n = self.held.get() if self.held.exists() else (0.0, 0)
            out = []
            for at, seq, x in due:
                s, n = (float(x) if n == 0 else float(round((s * n + x) / (n + 1)))), n + 1
                out.append((*key, at, seq, int(s), n))
            self.held.update((s, n))
            yield pd.DataFrame(out, columns=[*self.keys, "at_ms", "seq", "score", "observations"])

    def close(self) -> None:
        pass


def ordered_scores(rows: DataFrame, keys: list[str], key_schema: str, at: str, seq: str, score: str, delay: str = "10 minutes") -> DataFrame:
    """keys, at, seq, score, observations: the running score after every row, once the watermark (the latest time seen, less ``delay``) has passed it.
    Rows come in any order within the delay, and are folded by time, then by ``seq``; those that come later than that are left out, as Spark does.
    Needs the RocksDB state store. A key's state is what waits and two numbers.
    """
    x = rows.withWatermark(at, delay).select(*keys, at, F.unix_millis(at).alias("at_ms"), F.col(seq).cast("long").alias("seq_no"), F.col(score).cast("int").alias("points"))
    out = x.groupBy(*keys).transformWithStateInPandas(_Ordered(keys), f"{key_schema}, at_ms long, seq long, score int, observations long", "append", "eventtime")
    return out.select(*keys, F.timestamp_millis("at_ms").alias(at), "seq", "score", "observations")
