import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from weft.streaming import retention as R

START = dt.datetime(2024, 1, 1)
SCHEMA = "id string, seq long, user_id string, query string, ts timestamp"


def write(spark, folder, rows):
    pdf = pd.DataFrame(rows, columns=["id", "seq", "user_id", "query", "ts"])
    spark.createDataFrame(pdf, SCHEMA).repartition(2).write.mode("append").parquet(folder)


def rows_of_day(day):
    at = START + dt.timedelta(days=day)
    out = [(f"{day}-{i}", day * 100 + i, "ab"[i % 2], f"q{i}", at + dt.timedelta(hours=i, microseconds=7 * i)) for i in range(12)]
    # a row from two days before, which is late but not too old, and one that is far too old
    return out + [(f"{day}-late", day * 100 + 50, "a", "late", at - dt.timedelta(days=2)), (f"{day}-old", day * 100 + 60, "b", "old", at - dt.timedelta(days=40)),
                  (f"{day}-none", day * 100 + 70, None, "x", at), (f"{day}-no-time", day * 100 + 80, "a", "x", None)]


def test_state_and_sink_stay_bounded_and_a_restart_goes_on(spark, tmp_path):
    folder, sink, ckpt, keep = f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/ckpt", 3
    every, states = [], []
    for day in range(0, 12, 2):
        for d in (day, day + 1):
            write(spark, folder, rows_of_day(d))
            every += rows_of_day(d)
        # each round is a new query on the same checkpoint
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)
        q = R.run(stream, keep, sink, ckpt)
        states.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
        usable = [r for r in every if r[2] and r[4]]
        newest = max(r[4] for r in usable)
        kept = {r.id for r in R.read_retained(spark, sink, keep).collect()}
        assert kept == {r[0] for r in usable if r[4] >= newest - dt.timedelta(days=keep)}
        days = [f for f in os.listdir(sink) if f.startswith("day=")]
        assert len([d for d in days if d[4:] >= (newest - dt.timedelta(days=keep + 1)).date().isoformat()]) == len(days)
    assert max(states[2:]) <= states[1] * 1.3


def test_removals_are_handed_on(spark, tmp_path):
    write(spark, f"{tmp_path}/in", rows_of_day(0))
    write(spark, f"{tmp_path}/in", [("far", 9999, "c", "far", START + dt.timedelta(days=30))])
    before = spark.conf.get(R._STORE)
    spark.conf.set(R._STORE, R._ROCKS)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        q = (R.changes(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(R._STORE, before)
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("op").agg(F.array_sort(F.collect_set("seq")).alias("seqs")).collect()
    by = {r.op: set(r.seqs) for r in out}
    assert by["remove"] == by["add"] - {9999} and len(by["remove"]) >= 13


def test_state_is_read_and_written_per_piece(monkeypatch):
    class State:
        def __init__(self):
            self.rows, self.calls, self.timers = {}, 0, []

        def __getattr__(self, name):
            def call(*a):
                self.calls += 1
                return {"containsKey": lambda k: k in self.rows, "getValue": lambda k: self.rows[k], "removeKey": lambda k: self.rows.pop(k),
                        "updateValue": lambda k, v: self.rows.__setitem__(k, v), "registerTimer": self.timers.append, "getMapState": lambda *x: self}[name](*a)

            return call

    class Timer:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    state, p = State(), R.Expiry(["seq", "user_id", "ts"])
    p.init(state)
    at = pd.to_datetime([START + dt.timedelta(minutes=(i * 7) % 1000) for i in range(1000)])
    rows = pd.DataFrame({"seq": range(1000), "user_id": "a", "ts": at})
    assert sum(len(x) for x in p.handleInputRows(("a",), iter([rows]), None)) == 1000
    # four pieces, not a thousand instants
    assert state.calls <= 20
    half = int(at.sort_values()[499].timestamp() * 1000) + 1
    gone = []
    while due := [t for t in state.timers if t <= half]:
        state.timers = [t for t in state.timers if t > half]
        for t in due:
            timer = Timer(t)
            gone += [s for x in p.handleExpiredTimer(("a",), Timer(half), timer) for s in x["seq"]]
    assert sorted(gone) == sorted(rows["seq"][rows["ts"] <= at.sort_values()[499]])
    assert sum(len(v[0]) for v in state.rows.values()) == 500 and set(k[0] for k in state.rows) <= set(state.timers)
