"""Live symbols: merged last values, forming and closed bars, staleness by timer, breadth.

A symbol's state is what its newest trade, quote and security messages said, each as of
its own time, and the bars that may still change, by their start. Late messages that the
watermark lets through go to the bar they belong to, and replace a last value only if
nothing newer is known. A timer closes a bar when the watermark passes its end; another
tells that a quote is stale when it passes the quote's time by ``stale`` without a newer one.

Rows out are events of three kinds: ``state`` (the merged values after a batch of
messages), ``closed`` (a bar that no longer changes) and ``stale``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The kinds of messages and the field each one tells.
FIELDS = {"purchase": "trade", "view": "quote", "signup": "security"}
LAST = ", ".join(f"{f} double, {f}_at long, {f}_id long" for f in FIELDS.values()) + ", messages long, warned long"
BAR = "open double, high double, low double, close double, n long, first_at long, first_id long, last_at long, last_id long"
OUT = "user_id long, kind string, at timestamp, trade double, quote double, security double, messages long, open double, high double, low double, close double, n long"
_LAST = [c.split()[0] for c in LAST.split(", ")]
_BAR = [c.split()[0] for c in BAR.split(", ")]
_OUT = [c.split()[0] for c in OUT.split(", ")]
_NONE = {c: None for c in _OUT}


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class Live(StatefulProcessor):
    """``bar`` and ``stale`` are in milliseconds; messages have their time in microseconds (``us``)."""

    def __init__(self, bar: int, stale: int):
        self.bar, self.stale = bar, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.bars = handle.getMapState("bars", "start long", BAR)

    def close(self) -> None:
        pass

    def _held(self) -> dict:
        if not self.last.exists():
            return dict.fromkeys(_LAST) | {"messages": 0}
        return {c: None if pd.isna(v) else v for c, v in zip(_LAST, self.last.get(), strict=True)}

    def _row(self, key: tuple, kind: str, at: int, **more) -> dict:
        return _NONE | {"user_id": key[0], "kind": kind, "at": _time(at)} | more

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, touched, newest = self._held(), {}, 0
        for part in rows:
            for us, event_id, kind, value in zip(part["us"].tolist(), part["event_id"].tolist(), part["event_type"].tolist(), part["value"].tolist(), strict=True):
                held["messages"] += 1
                newest = max(newest, us)
                field = FIELDS.get(kind)
                if field and (held[f"{field}_at"] is None or (us, event_id) >= (held[f"{field}_at"], held[f"{field}_id"])):
                    held |= {field: value, f"{field}_at": us, f"{field}_id": event_id}
                start = us // 1000 // self.bar * self.bar
                if start not in touched:
                    touched[start] = dict(zip(_BAR, self.bars.getValue((start,)), strict=True)) if self.bars.containsKey((start,)) else None
                b = touched[start]
                if b is None:
                    touched[start] = dict(zip(_BAR, (value, value, value, value, 1, us, event_id, us, event_id), strict=True))
                    continue
                b |= {"high": max(b["high"], value), "low": min(b["low"], value), "n": b["n"] + 1}
                if (us, event_id) < (b["first_at"], b["first_id"]):
                    b |= {"open": value, "first_at": us, "first_id": event_id}
                if (us, event_id) >= (b["last_at"], b["last_id"]):
                    b |= {"close": value, "last_at": us, "last_id": event_id}
        for start, b in touched.items():
            self.bars.updateValue((start,), tuple(b[c] for c in _BAR))
            self.handle.registerTimer(start + self.bar)
        if held["quote_at"] is not None and held["quote_at"] != held["warned"]:
            self.handle.registerTimer(held["quote_at"] // 1000 + self.stale)
        self.last.update(tuple(held[c] for c in _LAST))
        told = self._row(key, "state", newest // 1000, **{f: held[f] for f in FIELDS.values()}, messages=held["messages"])
        yield pd.DataFrame([told], columns=_OUT)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        start = due - self.bar
        # A bar's end and a quote's limit may fall together; each is looked at.
        if self.bars.containsKey((start,)):
            b = dict(zip(_BAR, self.bars.getValue((start,)), strict=True))
            self.bars.removeKey((start,))
            out.append(self._row(key, "closed", start, **{c: b[c] for c in ("open", "high", "low", "close", "n")}))
        held = self._held()
        if held["quote_at"] is not None and held["quote_at"] // 1000 + self.stale == due and held["warned"] != held["quote_at"]:
            held["warned"] = held["quote_at"]
            self.last.update(tuple(held[c] for c in _LAST))
            out.append(self._row(key, "stale", due, quote=held["quote"]))
        if out:
            yield pd.DataFrame(out, columns=_OUT)


def live(events: DataFrame, bar: int, stale: int, late: str = "10 minutes") -> DataFrame:
    """The events of all symbols; ``bar`` and ``stale`` in seconds. Needs the RocksDB state store."""
    rows = events.select("user_id", "event_id", "event_type", "value", "ts", F.unix_micros("ts").alias("us")).filter("user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL")
    grouped = rows.withWatermark("ts", late).groupBy("user_id")
    return grouped.transformWithStateInPandas(Live(bar * 1000, stale * 1000), OUT, "Append", "eventTime")


def breadth(states: DataFrame) -> DataFrame:
    """From the newest state of each symbol: how many trade above, below and at their quote, and how many have none."""
    now = states.filter("kind = 'state'").groupBy("user_id").agg(F.max_by(F.struct("trade", "quote"), "messages").alias("s")).select("s.*")
    known = F.col("trade").isNotNull() & F.col("quote").isNotNull()
    return now.agg(
        F.count_if(known & (F.col("trade") > F.col("quote"))).alias("above"), F.count_if(known & (F.col("trade") < F.col("quote"))).alias("below"),
        F.count_if(known & (F.col("trade") == F.col("quote"))).alias("level"), F.count_if(~known).alias("unknown"),
    )
