"""The outbound guard: its rules one by one, and the stream beside the batch form across restarts."""

import datetime as dt
import random

from fernglass.streaming import outbound as O

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "target long, id long, ts timestamp_ntz, kind string, event string, request string, payload string, token_until timestamp_ntz, who string, action string, until timestamp_ntz"


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def send(i, s, payload, event=None, request=None, token=None, target=1):
    return (target, i, at(s), "send", event, request, payload, at(token), None, None, None)


def control(i, s, who, action, until=None, target=1):
    return (target, i, at(s), "control", None, None, None, None, who, action, at(until))


def failed(i, s, event, target=1):
    return (target, i, at(s), "failed", event, None, None, None, None, None, None)


def outcomes(spark, rows):
    return {r.id: r.outcome for r in O.outcomes(spark.createDataFrame(rows, SCHEMA).repartition(3), target="target", ts="ts", tie="id").collect()}


def test_rules(spark):
    rows = [
        send(1, 0, "hello", "e1", "r1", token=5), send(2, 1, " hello "), send(3, 2, "other", None, "r1"), send(4, 3, " \n"), send(5, 121, "Hello", "e5"), send(6, 122, "next", "e1", token=100),
        send(7, 123, "again", "e1"), failed(8, 124, "e5"), send(9, 125, "fresh", "e5"), failed(10, 126, "e99"), control(11, 200, "user", "pause", 300), send(12, 201, "quiet"), control(13, 202, "admin", "pause"), control(14, 203, "user", "resume"),
        send(15, 400, "still quiet"), control(16, 401, "admin", "resume"), send(17, 402, "loud"), send(18, 402, "for another", target=2), send(19, 1003, "loud "), control(20, 1004, "user", "pause", 1000), send(21, 1005, "on"), send(22, None, "when?"),
    ]
    want = {1: "reply", 2: "suppressed", 3: "suppressed", 4: "blank", 5: "recent", 6: "push", 7: "duplicate", 8: "unmarked", 9: "push", 10: "unknown", 11: "noted", 12: "paused", 13: "noted", 14: "noted", 15: "paused", 16: "noted", 17: "push", 18: "push", 19: "push", 20: "noted", 21: "push", 22: "untimed"}
    assert outcomes(spark, rows) == want


def test_a_ring_of_twelve(spark):
    rows = [send(i, 130 * 0 + 10 * i, f"text {i}") for i in range(13)] + [send(50, 500, "TEXT 0"), send(51, 501, "TEXT 2")]
    got = outcomes(spark, rows)
    assert got[50] == "push" and got[51] == "recent"  # the first has left the ring


def test_stream_is_the_batch_across_restarts(spark, tmp_path):
    rnd, rows, now = random.Random(7), [], 0
    for i in range(240):
        now += rnd.choice([1, 5, 30, 90, 200])
        target, kind = rnd.randrange(3), rnd.random()
        if kind < 0.15:
            rows.append(control(i, now, rnd.choice(["admin", "user"]), rnd.choice(["pause", "resume", "resume"]), rnd.choice([None, now + 100, now + 400]), target))
        elif kind < 0.3:
            rows.append(failed(i, now, f"e{rnd.randrange(6)}", target))
        else:
            rows.append(send(i, now, rnd.choice(["a", "A ", "b", "c", "", "d e"]), rnd.choice([None, f"e{rnd.randrange(6)}"]), rnd.choice([None, f"r{rnd.randrange(6)}"]), rnd.choice([None, now + 3]), target))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(0, 240, 60):  # a query of its own for each part of the events
            spark.createDataFrame(rows[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            df = O.outcomes_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), target="target", ts="ts", tie="id")
            q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    got = {r.id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == outcomes(spark, rows) and len(set(got.values())) >= 8
