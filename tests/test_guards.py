"""Guards: time limits at their bounds, and streaming twins beside the batch forms."""

import datetime as dt

from fernglass.streaming import guards as G

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """(id, user, text, seconds)"""
    return spark.createDataFrame([(i, u, t, T0 + dt.timedelta(microseconds=round(s * 1e6))) for i, u, t, s in rows], "id long, user long, text string, ts timestamp_ntz")


def brute(rows, ttl, inclusive=True):
    last, keep = {}, []
    for i, u, t, s in sorted(rows, key=lambda r: (r[3], r[0])):
        gap = None if (u, t) not in last else s - last[u, t]
        if gap is None or (gap > ttl if inclusive else gap >= ttl):
            keep.append(i)
            last[u, t] = s
    return sorted(keep)


ROWS = [(1, 1, "a", 0), (2, 1, "a", 60), (3, 1, "a", 120), (4, 1, "a", 120.000001), (5, 1, "b", 1), (6, 2, "a", 0), (7, 2, "a", 119), (8, 2, "a", 121), (9, 2, "a", 240), (10, 2, "a", 242)]


def test_gap_counts_from_the_last_kept(spark):
    got = sorted(r.id for r in G.ttl_dedupe(events(spark, ROWS), ["user", "text"], ts="ts", tie="id", ttl_seconds=120).collect())
    assert got == brute(ROWS, 120) == [1, 4, 5, 6, 8, 10]
    got = sorted(r.id for r in G.ttl_dedupe(events(spark, ROWS), ["user", "text"], ts="ts", tie="id", ttl_seconds=120, inclusive=False).collect())
    assert got == brute(ROWS, 120, False)


def test_utterance_gate(spark):
    rows = [(1, 1, "aa", 0), (2, 1, "bb", 1), (3, 1, "aa", 2), (4, 1, "aa ", 3), (5, 1, "", 4), (6, 1, "aa", 122), (7, 1, None, 123), (8, 1, "　a ", 124)]
    got = {r.id: r.reason for r in G.utterance_gate(events(spark, rows), user="user", text="text", ts="ts", tie="id").collect()}
    assert got == {1: None, 2: None, 3: None, 4: "duplicate", 5: "empty", 6: None, 7: "empty", 8: "too_short"}


def test_lateness_bound(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1, "a", 0), (2, 1, "a", -0.001), (3, 1, "a", 100)]
    e = events(spark, rows).withColumn("now", F.lit(T0 + dt.timedelta(seconds=150)).cast("timestamp_ntz"))
    kept = G.on_time(e, event_ts=F.col("ts"), now=F.col("now"))
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def _stream(spark, tmp_path, batches, make, name):
    source = str(tmp_path / "in")
    query = None
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        df = make(spark.readStream.schema("id long, user long, text string, ts timestamp_ntz").parquet(source))
        query = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_streaming_twin_of_ttl_dedupe(spark, tmp_path):
    batches = [ROWS[:3] + ROWS[4:7], [ROWS[3], *ROWS[7:]]]
    got = _stream(spark, tmp_path, batches, lambda s: G.ttl_dedupe_stream(s, ["user", "text"], ts="ts", tie="id", ttl_seconds=120), "dedupe")
    assert sorted(r.id for r in got) == brute(ROWS, 120)


def test_streaming_twin_of_the_gate(spark, tmp_path):
    batches = [[(1, 1, "aa", 0), (2, 1, "bb", 1)], [(3, 1, "bb", 2), (4, 1, "aa", 3)]]
    got = _stream(spark, tmp_path, batches, lambda s: G.utterance_gate_stream(s, user="user", text="text", ts="ts", tie="id"), "gate")
    assert {r.id: r.reason for r in got} == {1: None, 2: None, 3: "duplicate", 4: None}


def test_streaming_rate_limit_and_sessions(spark, tmp_path):
    rows = [(i, 1, "a", i) for i in range(5)] + [(9, 2, "a", 7200)]
    got = _stream(spark, tmp_path, [rows, [(10, 3, "a", 9000)]], lambda s: G.rate_limit_stream(s, user="user", ts="ts", window="1 minute", limit=3), "rate")
    assert [(r.user, r.n, r.refused) for r in got] == [(1, 5, 2)]
