"""What goes out to a target, as one guard with its own memory: pauses, repeats, recent texts and failed sends.

The transition is one function of a target's memory and an event. The batch form runs it over a target's events in order; the
streaming form keeps the memory in map and value states between batches and lets timers forget what has run out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fernglass.streaming.guards import MICRO, carried

#: Seconds that requests, texts and events are kept in mind, those of recent texts, and how many of the latter.
TTL, RECENT, DEPTH = 120, 600, 12
#: An event: what it is (send, failed, control), what it is known by, and what it says.
INPUT = ["kind", "event", "request", "payload", "token_until", "who", "action", "until"]


def fresh() -> dict:
    return {"marks": {}, "ring": [], "pauses": {}}


def _text_key(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def forget(state: dict, now: int) -> dict:
    """The memory without what has run out: marks older than TTL, recent texts older than RECENT, pauses that have ended."""
    return {
        "marks": {k: t for k, t in state["marks"].items() if now - t <= TTL * MICRO},
        "ring": [(k, t) for k, t in state["ring"] if now - t <= RECENT * MICRO],
        "pauses": {who: until for who, until in state["pauses"].items() if until is None or until > now},
    }


def step(state: dict, now, kind, event, request, payload, token_until, who, action, until) -> tuple[dict, str]:
    """The memory after an event, and what becomes of it.

    control: `who` (admin or user) pauses, until a time or for good, or resumes its own pause. While an administrator's
    pause lasts nothing goes out, whatever the user says; after it the user's counts.
    failed: the event's mark is taken off, so it may be sent again; its text and request stay in mind.
    send: in this order blank, paused, suppressed (request or text went out up to TTL ago), duplicate (the event did), recent
    (the same text but for case and spaces is among the last DEPTH in RECENT), else reply while the token lasts, or push.
    Events without a time change nothing.
    """
    if now is None:
        return state, "untimed"
    state = forget(state, now)
    if kind == "control":
        who = "admin" if who == "admin" else "user"
        if action == "pause" and (until is None or until > now):
            state["pauses"][who] = until
        elif action == "resume":
            state["pauses"].pop(who, None)
        return state, "noted"
    if kind == "failed":
        return state, "unmarked" if state["marks"].pop(f"e:{event}", None) is not None else "unknown"
    text = (payload or "").strip()
    if not text:
        return state, "blank"
    if "admin" in state["pauses"] or "user" in state["pauses"]:
        return state, "paused"
    marks, digest = state["marks"], f"h:{hashlib.sha256(text.encode()).hexdigest()}"
    if digest in marks or request and f"r:{request}" in marks:
        return state, "suppressed"
    if request:
        marks[f"r:{request}"] = now
    marks[digest] = now
    if event and f"e:{event}" in marks:
        return state, "duplicate"
    if event:
        marks[f"e:{event}"] = now
    key = _text_key(text)
    if any(k == key for k, _ in state["ring"]):
        return state, "recent"
    state["ring"] = [*state["ring"], (key, now)][-DEPTH:]
    return state, "reply" if token_until is not None and token_until >= now else "push"


def _rows(events: DataFrame, ts: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return events.withColumns({"now_micros": micros(ts), "token_micros": micros("token_until"), "until_micros": micros("until")})


_STEP = ["now_micros", "kind", "event", "request", "payload", "token_micros", "who", "action", "until_micros"]


def outcomes(events: DataFrame, *, target: str, ts: str, tie: str) -> DataFrame:
    """events (target, ts, tie and INPUT) with `outcome`, by a target's events in order."""
    return carried(_rows(events, ts), [target], ["now_micros", tie], _STEP, step, start=fresh, out="outcome", kind="string").drop("now_micros", "token_micros", "until_micros")


class Guard(StatefulProcessor):
    """The guard of a target in a stream."""

    def __init__(self, target: str, tie: str):
        self.target, self.tie = target, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getMapState("marks", "mark string", "at long")
        self.ring = handle.getValueState("ring", "texts array<string>, times array<long>")
        self.pauses = handle.getMapState("pauses", "who string", "until long")

    def _load(self) -> dict:
        state = fresh()
        if self.marks.exists():
            state["marks"] = {k[0]: v[0] for k, v in self.marks.iterator()}
        if self.pauses.exists():
            state["pauses"] = {k[0]: v[0] for k, v in self.pauses.iterator()}
        if self.ring.exists():
            texts, times = self.ring.get()
            state["ring"] = list(zip(texts, times))
        return state

    def _save(self, before: dict, after: dict) -> None:
        for stored, name in ((self.marks, "marks"), (self.pauses, "pauses")):
            for k in before[name].keys() - after[name].keys():
                stored.removeKey((k,))
            for k, v in after[name].items():
                if k not in before[name] or before[name][k] != v:
                    stored.updateValue((k,), (v,))
        if after["ring"] != before["ring"]:
            self.ring.update(([k for k, _ in after["ring"]], [t for _, t in after["ring"]])) if after["ring"] else self.ring.clear()
        ends = [t + TTL * MICRO for t in after["marks"].values()] + [t + RECENT * MICRO for _, t in after["ring"]] + [t for t in after["pauses"].values() if t is not None]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frames = [f for f in rows if len(f)]
        if not frames:  # a call for timers alone
            return
        pdf = pd.concat(frames).sort_values(["now_micros", self.tie], kind="stable", na_position="first")
        before = self._load()
        state, got = {k: v.copy() for k, v in before.items()}, []
        for values in pdf[_STEP].astype(object).where(pdf[_STEP].notna(), None).itertuples(index=False, name=None):
            state, outcome = step(state, *(int(v) if i in (0, 5, 8) and v is not None else v for i, v in enumerate(values)))
            got.append(outcome)
        self._save(before, state)
        yield pd.DataFrame({self.target: pdf[self.target], self.tie: pdf[self.tie], "outcome": got})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        before = self._load()
        self._save(before, forget(before, (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000))
        return iter(())

    def close(self) -> None:
        pass


def outcomes_stream(events: DataFrame, *, target: str, ts: str, tie: str, lateness: str = "150 seconds") -> DataFrame:
    """The streaming twin of outcomes: target, tie, outcome. It needs the RocksDB state store. Events of a batch are taken in order; those
    behind the watermark are dropped, and timers at event time forget what has run out."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    timed = _rows(events, ts).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    out = f"{target} {kinds[target]}, {tie} {kinds[tie]}, outcome string"
    return timed.groupBy(target).transformWithStateInPandas(Guard(target, tie), out, "append", "eventTime")
