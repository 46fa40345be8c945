"""Event guards: duplicate suppression, lateness, pauses, rate limits, sessions. Batch forms and streaming twins.

A guard that keeps its last accepted event is no window frame, so its transition is one function that both forms run: the
batch form over a key's events in order, the streaming form over a batch's events with the state between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T

MICRO = 1_000_000


def keep_after_gap(times, last, ttl: float, inclusive: bool = True):
    """Which of a key's ordered times stay, and the last one kept: a time goes if it is at most `ttl` (below it, if not
    inclusive) after the last that stayed. The gap counts from what stayed, not from what came."""
    keep = []
    for t in times:
        gone = last is not None and (t - last <= ttl if inclusive else t - last < ttl)
        keep.append(not gone)
        if not gone:
            last = t
    return keep, last


def consecutive(texts, times, state, ttl: float, lengths=None, least: int = 0):
    """Reasons to skip utterances: empty; too_short, where its length is below the least; duplicate, the text accepted last
    again in less than `ttl`; A, B, A all pass."""
    text, at = state
    out = []
    for t, when, n in zip(texts, times, lengths or [least] * len(texts)):
        cleaned = (t or "").strip()
        reason = "empty" if not cleaned else "too_short" if n < least else "duplicate" if text == cleaned and at is not None and when - at < ttl else None
        out.append(reason)
        if reason is None:
            text, at = cleaned, when
    return out, (text, at)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def carried(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, *, start: Callable, out: str, kind: str) -> DataFrame:
    """Add `out` (of type `kind`): what step(state, values of inputs) gives as (state, result), along each key's rows in order.

    Rows are dealt by key and sorted inside partitions; a task streams over them and holds a batch and one key's state,
    however many rows the key has. A key's rows are one task's work, since each result depends on those before."""
    names, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ins, ks = [names.index(c) for c in inputs], [names.index(c) for c in keys]

    def run(batches):
        import pyarrow as pa

        now, state = None, None
        for b in batches:
            results = []
            values = zip(*(b.column(i).to_pylist() for i in ins))
            for key, v in zip(zip(*(b.column(i).to_pylist() for i in ks)), values):
                if state is None or key != now:
                    now, state = key, start()
                state, result = step(state, *v)
                results.append(result)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, types[kind])], [*names, out])

    import pyarrow as pa

    types = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kinds}, `{out}` {kind}")


def ttl_dedupe(events: DataFrame, keys: list[str], *, ts: str, tie: str, ttl_seconds: int = 120, inclusive: bool = True) -> DataFrame:
    """Events that stay when a key's event goes at most ttl after the last that stayed; equal times in the order of `tie`. An
    event without a time stays and counts for nothing. See carried for how a key of many events is handled."""
    ttl = ttl_seconds * MICRO

    def step(state, t):
        if t is None:
            return state, True
        gone = state[0] is not None and (t - state[0] <= ttl if inclusive else t - state[0] < ttl)
        return (state if gone else (t,)), not gone

    marked = carried(events.withColumn("_t", _micros(ts)), keys, ["_t", tie], ["_t"], step, start=lambda: (None,), out="_keep", kind="boolean")
    return marked.where("_keep").select(events.columns)


def accepted_events(events: DataFrame, *, message: str, user: str, text: str, ts: str, tie: str, sent: Column | None = None, ttl_seconds: int = 120, most_seconds: int = 150) -> DataFrame:
    """Incoming events that are to be handled: not sent (`sent`, if known) longer ago than most_seconds; then not of a message id
    accepted up to ttl ago, an id being noted even where the text is refused after it; then not of a user and text (trimmed)
    accepted up to ttl ago. Events without an id, or without a text, pass that check; a null user is one user."""
    if sent is not None:
        events = on_time(events, event_ts=sent, now=F.col(ts), most_seconds=most_seconds)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    by_id = ttl_dedupe(events.where(~blank(message)), [message], ts=ts, tie=tie, ttl_seconds=ttl_seconds).unionByName(events.where(blank(message)))
    keyed = by_id.where(~blank(text)).withColumn("_k", F.sha1(F.concat_ws(":", F.coalesce(F.col(user).cast("string"), F.lit("anon")), F.trim(text))))
    return ttl_dedupe(keyed, ["_k"], ts=ts, tie=tie, ttl_seconds=ttl_seconds).drop("_k").unionByName(by_id.where(blank(text)))


def utterance_gate(events: DataFrame, *, user: str, text: str, ts: str, tie: str, ttl_seconds: int = 120, least: int = 2) -> DataFrame:
    """The key columns with `reason`: null for accepted utterances; too short are those below `least` characters without spaces."""
    length = F.length(T.search_form(F.col(text)))
    rows = events.select(user, tie, text, _micros(ts).alias("_t"), length.alias("_n"))

    def step(state, t, when, n):
        (reason,), state = consecutive([t], [when], state, ttl_seconds * MICRO, [n], least)
        return state, reason

    return carried(rows, [user], ["_t", tie], [text, "_t", "_n"], step, start=lambda: (None, None), out="reason", kind="string").select(user, tie, "reason")


def suppressed(responses: DataFrame, *, scope: str, request: str, payload: str, ts: str, tie: str, ttl_seconds: int = 120) -> DataFrame:
    """responses with `suppressed`: the request id, or the same text (trimmed), went out in the scope (a user, a channel) up to
    ttl ago. What is suppressed isn't noted; a blank text is never suppressed. The state of a scope holds what went out
    in the last ttl."""
    ttl = ttl_seconds * MICRO
    rows = responses.withColumns({"_t": _micros(ts), "_h": F.when(F.trim(payload) != "", F.sha2(F.trim(payload), 256)), "_r": F.col(request).cast("string")})

    def step(sent, t, text, asked):
        if text is None:
            return sent, False
        sent = {k: at for k, at in sent.items() if t - at <= ttl}
        if ("r", asked) in sent or ("h", text) in sent:
            return sent, True
        if asked:
            sent["r", asked] = t
        sent["h", text] = t
        return sent, False

    return carried(rows, [scope], ["_t", tie], ["_t", "_h", "_r"], step, start=dict, out="suppressed", kind="boolean").drop("_t", "_h", "_r")


def outbound(responses: DataFrame, *, scope: str, request: str, payload: str, token_until: str, ts: str, tie: str) -> DataFrame:
    """responses that go out, with `way`: reply while the reply token lasts, push after it or without one; blank and suppressed
    ones are left out. A sink that writes by batch id (foreachBatch) and takes failed rows again needs no more state."""
    rows = suppressed(responses, scope=scope, request=request, payload=payload, ts=ts, tie=tie).where("not suppressed").where(F.trim(payload) != "")
    return rows.withColumn("way", F.when(F.col(token_until) >= F.col(ts), "reply").otherwise("push")).drop("suppressed")


def answered_before(questions: DataFrame, *, user: str, key: str, ts: str, tie: str, depth: int = 10) -> DataFrame:
    """questions with `repeated`: the key is among the last `depth` that the user was answered. Repeated ones don't move up."""

    def step(last, k):
        if k in last:
            return last, True
        return (*last, k)[-depth:], False

    return carried(questions, [user], [ts, tie], [key], step, start=tuple, out="repeated", kind="boolean")


def remembered(events: DataFrame, *, user: str, value: str, ts: str, tie: str, ttl: str = "15 minutes") -> DataFrame:
    """events with `known`: the last value that isn't null at or before each event of the user; every event keeps it alive for
    the ttl, and it is forgotten where events are further apart."""
    by_user = Window.partitionBy(user).orderBy(ts, tie)
    gap = F.coalesce((F.col(ts) - F.lag(ts).over(by_user) > F.expr(f"interval {ttl}")).cast("int"), F.lit(0))
    rows = events.withColumn("_g", gap)
    rows = rows.withColumn("_s", F.sum("_g").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(user, "_s").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("known", F.last(value, ignorenulls=True).over(inside)).drop("_g", "_s")


def flags(changes: DataFrame, users: DataFrame, *, user: str, flag: str, ts: str) -> DataFrame:
    """users with `flag`: the newest of each user's changes, false without one. Changes are known by the hash of the user."""
    newest = changes.groupBy(T.user_hash(F.col(user)).alias("_h")).agg(F.max_by(flag, ts).alias(flag))
    return users.withColumn("_h", T.user_hash(F.col(user))).join(newest, "_h", "left").drop("_h").withColumn(flag, F.coalesce(flag, F.lit(False)))


def on_time(events: DataFrame, *, event_ts: Column, now: Column, most_seconds: int = 150) -> DataFrame:
    """Events without a time, or at most so many seconds old; 0 lets all pass."""
    if not most_seconds:
        return events
    return events.where(event_ts.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(event_ts.cast("timestamp")) <= most_seconds * MICRO))


def sessions(events: DataFrame, *, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """user, start, end, n of runs of events less than a gap apart; end is the last event plus the gap."""
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limit(events: DataFrame, *, user: str, ts: str, window: str, limit: int) -> DataFrame:
    """user, start, n, refused of tumbling windows with more events than the limit."""
    per = events.groupBy(user, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return per.where(F.col("n") > limit).select(user, F.col("w.start").alias("start"), "n", (F.col("n") - limit).alias("refused"))


def pause_state(controls: DataFrame, probes: DataFrame, *, user: str, ts: str, tie: str) -> DataFrame:
    """user, tie, paused of probe events: whether the latest control (action, until) at or before each says paused and hasn't
    ended. An as-of join: both sides in one order per user, the last control carried forward."""
    rows = controls.select(user, ts, F.col(tie).alias("_tie"), F.lit(0).alias("_side"), F.struct("action", "until").alias("_c")).unionByName(probes.select(user, ts, F.col(tie).alias("_tie"), F.lit(1).alias("_side"), F.lit(None).cast("struct<action:string,until:timestamp_ntz>").alias("_c")))
    w = Window.partitionBy(user).orderBy(ts, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_c", ignorenulls=True).over(w)
    found = rows.withColumn("_l", last).where("_side = 1")
    paused = F.coalesce((F.col("_l.action") == "pause") & (F.col("_l.until").isNull() | (F.col("_l.until") > F.col(ts))), F.lit(False))
    return found.select(user, F.col("_tie").alias(tie), paused.alias("paused"))


def newest_generation(rows: DataFrame, *, key: str, generation: str) -> DataFrame:
    """Rows of each key's largest generation; older ones are stale. The largest is an aggregate that is joined back."""
    newest = rows.groupBy(F.col(key).alias("_k")).agg(F.max(generation).alias("_g"))
    return rows.join(newest, F.col(key).eqNullSafe(F.col("_k")) & (F.col(generation) == F.col("_g"))).drop("_k", "_g")


def _stream_state(events: DataFrame, keys: list[str], ts: str):
    """Events as a stream may be keyed: event time as TIMESTAMP, as watermarks and state need it."""
    if events.schema[ts].dataType.simpleString() != "timestamp":
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withColumn("_t", F.unix_micros(ts)).groupBy(*keys)


def ttl_dedupe_stream(events: DataFrame, keys: list[str], *, ts: str, tie: str, ttl_seconds: int = 120, lateness: str = "150 seconds") -> DataFrame:
    """The streaming twin of ttl_dedupe: keys, tie, ts of events that stay. State is one time per key, dropped when the watermark
    is the ttl past it; events behind the watermark are dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = ", ".join(f"{k} {kinds[k]}" for k in [*keys, tie]) + f", {ts} timestamp"

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["_t", tie], kind="stable")
        keep, last = keep_after_gap(pdf["_t"].tolist(), state.get[0] if state.exists else None, ttl_seconds * MICRO)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pdf[keep][[*keys, tie, ts]]

    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return _stream_state(timed, keys, ts).applyInPandasWithState(run, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def utterance_gate_stream(events: DataFrame, *, user: str, text: str, ts: str, tie: str, ttl_seconds: int = 120, least: int = 2, lateness: str = "150 seconds") -> DataFrame:
    """The streaming twin of utterance_gate; state is a user's last accepted text and its time, dropped when the watermark is
    the ttl past it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["_t", tie], kind="stable")
        reasons, new = consecutive(pdf[text].tolist(), pdf["_t"].tolist(), state.get if state.exists else (None, None), ttl_seconds * MICRO, pdf["_n"].tolist(), least)
        if new[1] is not None:
            state.update(new)
            state.setTimeoutTimestamp(max(new[1] // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({user: pdf[user], tie: pdf[tie], "reason": reasons})

    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_n", F.length(T.search_form(F.col(text)))).withWatermark(ts, lateness)
    return _stream_state(timed, [user], ts).applyInPandasWithState(run, f"{user} {kinds[user]}, {tie} {kinds[tie]}, reason string", "text string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(events: DataFrame, *, user: str, ts: str, window: str, limit: int, lateness: str = "150 seconds") -> DataFrame:
    """The streaming twin of rate_limit: windows are given out when the watermark has passed them."""
    per = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(user, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return per.where(F.col("n") > limit).select(user, F.col("w.start").alias("start"), "n", (F.col("n") - limit).alias("refused"))


def sessions_stream(events: DataFrame, *, user: str, ts: str, gap: str = "30 minutes", lateness: str = "150 seconds") -> DataFrame:
    """The streaming twin of sessions."""
    return sessions(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness), user=user, ts=ts, gap=gap)


def refresh_index(batch: DataFrame, path: str, *, key: str, order: str) -> None:
    """For foreachBatch: the newest version of each changed document goes to a new version of the index table, then the
    version file is moved, so readers see the old table or the new one."""
    from fernglass.sources.files import publish

    spark = batch.sparkSession
    old = publish(spark, path)
    rows = batch if old is None else old.unionByName(batch)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    publish(spark, path, newest)
