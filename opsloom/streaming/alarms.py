"""Alarms on a stream: breaches in a row per key, and keys that fall silent.

Interval means are computed by Spark and reach the alarm as intervals close.  The state of a key
is its run of breaches and its last interval; an event-time timer wakes a key that has stayed
silent, so absence is found by the watermark alone, without a further message of that key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from opsloom.operators.metrics import AlarmRule
from opsloom.streaming.runs import utc_wall

_SCHEMA = "key string, bucket timestamp_ntz, v double, run int, state string"


class AlarmProcessor(StatefulProcessor):
    """State per key: breaches in a row, the start of the last closed interval, and the timer set for it."""

    def __init__(self, rule: AlarmRule, seconds: int, absent: int):
        self.rule, self.seconds, self.absent = rule, seconds, absent

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "run int, last bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row per closed interval of the key: at most as many as intervals in a batch
        pdf = pd.concat(list(rows)).sort_values("bucket")
        ops = {">": lambda v: v > self.rule.threshold, ">=": lambda v: v >= self.rule.threshold, "<": lambda v: v < self.rule.threshold, "<=": lambda v: v <= self.rule.threshold}
        starts = pdf["bucket"].to_numpy().astype("datetime64[s]").astype("int64").tolist()
        run, last, timer = self.seen.get() or (0, None, None)
        out = []
        for at, v, breach in zip(starts, pdf["v"].tolist(), ops[self.rule.op](pdf["v"].round(9)).tolist()):
            if self.absent and last is not None and at - last > self.absent * self.seconds:
                out.append((last + self.absent * self.seconds, None, 0, "ABSENT"))
                run = 0
            run = run + 1 if breach else 0
            out.append((at, v, run, "FIRING" if run >= self.rule.pending else "PENDING" if breach else "OK"))
            last = at
        if self.absent:
            if timer is not None:
                self.handle.deleteTimer(timer)
            # the end of the interval in which the silence becomes long enough
            timer = (last + (self.absent + 1) * self.seconds) * 1000
            self.handle.registerTimer(timer)
        self.seen.update((run, last, timer))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, last, _ = self.seen.get()
        self.seen.clear()
        yield self._rows(key, [(last + self.absent * self.seconds, None, 0, "ABSENT")])

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["bucket", "v", "run", "state"])
        out.insert(0, "key", key[0])
        out["bucket"] = pd.to_datetime(out["bucket"], unit="s")
        out["v"] = out["v"].astype(float)
        return out

    def close(self) -> None:
        pass


def alarm_stream(df: DataFrame, ts: str, value: str, late: str, window: str, key: str, rule: AlarmRule, absent: int = 0) -> DataFrame:
    """``key, bucket, v, run, state`` per closed interval of ``window``: OK, PENDING or FIRING as in the batch alarm.

    With ``absent``, a key without a row in that many intervals after its last one gives one row
    ABSENT, at the start of the last of these intervals, with a null value.  It comes once the
    watermark has passed that interval, whether or not the key ever comes back; the key's state
    ends with it and a later row starts anew.  The rows do not depend on how the stream is cut into batches.
    """
    seconds = df.sparkSession.sql(f"SELECT unix_timestamp(timestamp'1970-01-01 00:00:00' + interval {window}) - unix_timestamp(timestamp'1970-01-01 00:00:00')").first()[0]
    means = df.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.avg(value).alias("v"))
    # the time of the closed window carries the watermark on to the alarm
    rows = means.select(F.col(key).cast("string").alias("key"), F.window_time("window").alias("time"), utc_wall("window.start").alias("bucket"), "v")
    mode = "EventTime" if absent else "None"
    return rows.groupBy("key").transformWithStateInPandas(AlarmProcessor(rule, int(seconds), absent), _SCHEMA, "Append", mode)
