"""Final sinks of the streams against the batch operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.streaming import streams

EVENTS = "review long, reviewer long, vote string"


def test_ingest_is_idempotent(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "k long, v string").coalesce(1).write.mode("append").parquet(source)
        streams.ingest_stream(spark, source, "k long, v string", sink, ["k"], str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_quorum_counts_distinct_voters(spark, tmp_path):
    rows = [(1, 1, "approve"), (1, 1, "deny"), (1, 2, "approve"), (2, 1, "absent")]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "v"))
    votes = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "v"))
    with streams.keyed_state(spark):
        told = streams.run_to_end(streams.quorum_stream(votes, 2), "update")
    last = told.groupBy("review").agg(F.max("present").alias("n"), F.max("reached").alias("r")).collect()
    assert [(r.review, r.n, r.r) for r in last] == [(1, 2, True)]


def test_heads_and_windows(spark):
    from factloom.plans import base, more

    d = "/root/testdata/sf0.001"
    log = base.head_log(spark, d)
    batch = {(r.perspective, r.heads) for r in log.select("perspective", "subject").distinct().groupBy("perspective").agg(F.count("*").alias("heads")).collect()}
    assert {(r.perspective, r.heads) for r in more.t2_heads_stream(spark, d).collect()} == batch
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    q = streams.token_windows(events).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{d}/events.parquet").count()


def test_token_windows_round_the_newest_time(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    at = datetime(2024, 3, 1)
    for name, newest in (("up", 600_000), ("down", 400_000), ("even", 500_000), ("odd", 1_500_000)):
        near = [at - timedelta(days=days, microseconds=u) for days in (1, 11) for u in range(-3_000_000, 3_000_001, 250_000)]
        rows = list(enumerate([at + timedelta(microseconds=newest), *near, None, datetime(1969, 12, 31, 23, 59, 59, 400_000)]))
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        sql = duckdb.connect()
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{name}/events.parquet/*.parquet'")
        want = sql.execute(entry.oracle_sql()["t4_token_windows"]).fetchall()
        assert sorted(tuple(r) for r in entry.queries()["t4_token_windows"](spark, f"{tmp_path}/{name}").collect()) == sorted(want)


SCHEDULES = "key long, ts timestamp, steps array<struct<state: string, at: timestamp>>"
MINUTE = lambda n: datetime(2024, 1, 1) + timedelta(minutes=n)


def test_timers_dont_grow_with_the_keys(spark, tmp_path):
    rows = [(k, MINUTE(k % 50), [("open", None), ("closed", MINUTE(k % 50 + 1 + k % 3)), ("gone", MINUTE(9_000))]) for k in range(2_000)] + [(-1, MINUTE(500), [("open", None)])]
    spark.createDataFrame(rows, SCHEDULES).write.parquet(str(tmp_path / "in"))
    told = []
    with streams.keyed_state(spark):
        stream = streams.steps_stream(spark.readStream.schema(SCHEDULES).parquet(str(tmp_path / "in")), "1 hour")
        q = stream.writeStream.foreachBatch(lambda b, n: told.extend(map(tuple, b.select("key", "state").collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(told) == sorted((k, state) for k, *_ in rows for state in ("open", "closed") if k >= 0 or state == "open")
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"] if "numRegisteredTimers" in o["customMetrics"]]
    assert 0 < max(timers) <= 257


def test_timers_over_several_batches(spark, tmp_path):
    ends = lambda *at: [("open", None), *((f"end{k}", MINUTE(a)) for k, a in enumerate(at))]
    far = (1 << 62) + 1
    batches = [
        [(1, MINUTE(0), ends(60, 120)), (None, MINUTE(1), ends(60)), (far, MINUTE(1), ends(61)), (7, MINUTE(10), ends(-30, 5_000))],
        [(1, MINUTE(1), ends(10)), (2, MINUTE(120), ends(121))],  # key 1 has its schedule; the watermark is 60 after this
        [(4, MINUTE(122), ends(60)), (6, MINUTE(130), ends(60, 120)), (1, MINUTE(121), ends(10))],
        [(3, MINUTE(30), ends(31)), (5, MINUTE(180), ends()), (8, MINUTE(90), ends(61, 120))],  # key 3 comes too late
    ]
    source = spark.readStream.schema(SCHEDULES)
    told = []
    for k, rows in enumerate(batches):  # each a run of its own, over one state
        spark.createDataFrame(rows, SCHEDULES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with streams.keyed_state(spark):
            stream = streams.steps_stream(source.parquet(str(tmp_path / "in")), "1 hour", 2)
            q = stream.writeStream.foreachBatch(lambda b, n, k=k: told.extend((k, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    opened = [(0, 1, 0), (0, None, 1), (0, far, 1), (0, 7, 10), (1, 2, 120), (2, 4, 122), (2, 6, 130), (3, 5, 180), (3, 8, 90)]
    over = [(1, 7, "end0", -30), (1, 1, "end0", 60), (1, None, "end0", 60), (2, far, "end0", 61), (2, 4, "end0", 60), (2, 6, "end0", 60), (3, 8, "end0", 61), (3, 1, "end1", 120), (3, 6, "end1", 120), (3, 8, "end1", 120)]
    assert sorted(told, key=str) == sorted([(k, key, "open", MINUTE(at)) for k, key, at in opened] + [(k, key, state, MINUTE(at)) for k, key, state, at in over], key=str)


def test_timers_agree_with_sql_to_the_millisecond(spark, tmp_path, monkeypatch):
    import duckdb
    from pyspark.sql.streaming import DataStreamWriter

    import __spark_entry__ as entry

    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    micros = lambda u: timedelta(microseconds=u)
    for newest in (datetime(2024, 2, 1, 12, 0, 0, 250_000), datetime(2024, 2, 1, 12, 0, 0, 250_700)):
        d, limit = f"{tmp_path}/{newest.microsecond}", newest - timedelta(hours=1)
        # multiples of 3 close after k % 9 days; tokens are active after k % 7 and over k % 5 + 1 days later
        near = [(k, limit - timedelta(days=days) + micros(u)) for k in range(0, 105, 3) for days in (k % 9, k % 7, k % 7 + k % 5 + 1) for u in range(-1_500, 1_501, 250)]
        rows = [(0, newest), *((k + 315 * n, t) for n, (k, t) in enumerate(near, 1)), *((315 * n + 1, newest - timedelta(hours=n)) for n in range(1, 400))]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(f"{d}/events.parquet")
        sql = duckdb.connect()
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
        want = {q: sorted(sql.execute(entry.oracle_sql()[q]).fetchall()) for q in ("r7_review_timers", "t4_token_timers")}
        assert {r[2] for r in want["r7_review_timers"]} == {True, False}
        assert sorted((r.review, r.closes.replace(tzinfo=None), r.closed) for r in entry.queries()["r7_review_timers"](spark, d).collect()) == want["r7_review_timers"]
        assert sorted(map(tuple, entry.queries()["t4_token_timers"](spark, d).collect())) == want["t4_token_timers"]
    timers = [o["customMetrics"]["numRegisteredTimers"] for q in started for p in q.recentProgress for o in p["stateOperators"] if "numRegisteredTimers" in o["customMetrics"]]
    assert 0 < max(timers) <= 256
