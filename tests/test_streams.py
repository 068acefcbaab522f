"""Streams from files that come in any order of event time."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import counters, validate
from cairnflow.sources import ingest
from cairnflow.sources.snapshots import Snapshots, newest
from cairnflow.streaming import streams


def event(n, day):
    return json.dumps({
        "event_id": f"e{n}", "event_type": "user_login", "entity_id": "u", "entity_type": "user", "occurred_at": f"2024-01-{day:02d}T00:00:00",
        "payload": {"device": "d"}, "source": "s",
    })


def stored(spark, sink):
    rows = spark.read.parquet(f"{sink}/log").where("feature_name = 'login_device'").collect()
    return sorted(r.event_id for r in rows)


def test_old_events_in_later_batches_are_stored_once(spark, tmp_path):
    lines, sink, checkpoint = (str(tmp_path / x) for x in ("lines", "sink", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(lines)

    # Newest first; e2 comes three times, once with another time.
    arrive(event(1, 30), event(2, 30))
    arrive(event(3, 10), event(2, 30), "no event")
    arrive(event(4, 1), event(5, 29), event(2, 2))
    streams.ingest(ingest.file_events(spark, lines, per_trigger=1), sink, checkpoint)
    assert stored(spark, sink) == ["e1", "e2", "e3", "e4", "e5"]
    arrive(event(6, 1), event(4, 1))
    streams.ingest(ingest.file_events(spark, lines, per_trigger=1), sink, checkpoint)
    assert stored(spark, sink) == ["e1", "e2", "e3", "e4", "e5", "e6"]
    letters = spark.read.parquet(f"{sink}/dead_letters").collect()
    assert [r.original for r in letters] == ["no event"]


DAY = 86_400_000_000


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """600 events over 28 days in 30 files in no order of time, ten of them a micro-batch; and the events themselves."""
    r = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [(i, f"u{r.randrange(20)}", r.choice("ab"), float(r.randrange(100)), start + timedelta(seconds=r.randrange(28 * 86_400)), f"m{r.randrange(9)}") for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, entity_id string, event_type string, value double, timestamp timestamp, merchant_id string")
    events = events.withColumn("us", F.unix_micros("timestamp")).cache()
    folder = str(tmp_path_factory.mktemp("shuffled") / "in")
    events.repartition(30, F.xxhash64("event_id")).write.parquet(folder)
    return events, lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(folder)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_tumbling_counts_have_every_late_event(spark, shuffled, tmp_path):
    events, stream = shuffled
    deltas = streams.tumbling_counts(str(tmp_path))
    got = deltas.run(stream())
    want = events.groupBy(F.date_trunc("day", "timestamp").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert rows_of(got, "start", "event_type", "n", "total") == rows_of(want, "start", "event_type", "n", "total")
    counted = {(r.batch, r.label): r.n for r in deltas.counted(spark).collect()}
    assert sum(n for (_, label), n in counted.items() if label == "all") == 600
    late = sum(n for (_, label), n in counted.items() if label == "late")
    assert late > 200 and late == got.agg(F.sum("late")).first()[0]


def test_sliding_counts_and_sessions_have_every_late_event(spark, shuffled, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "MOST_DELTAS", 4)  # additions are added up on the way
    events, stream = shuffled
    got = streams.sliding_counts(str(tmp_path / "a")).run(stream())
    assert got.agg(F.sum("n")).first()[0] == 24 * 600
    want = events.groupBy("entity_id", F.window("timestamp", "24 hours", "1 hour").alias("w")).count()
    assert rows_of(got, "entity_id", "start", "n") == rows_of(want, "entity_id", "w.start", "count")
    got = streams.sessions(str(tmp_path / "b"), "6 hours").run(stream())
    want = events.groupBy("entity_id", F.session_window("timestamp", "6 hours").alias("w")).count()
    assert rows_of(got, "entity_id", "start", "end", "n") == rows_of(want, "entity_id", "w.start", "w.end", "count")


def test_latest_values_and_first_meetings(spark, shuffled, tmp_path):
    events, stream = shuffled
    got = streams.latest_values(stream(), str(tmp_path / "a"))
    want = newest(events.select("entity_id", "event_type", "value", "us", "event_id"), ["entity_id", "event_type"], [F.col("us"), F.col("event_id")])
    assert rows_of(got, "entity_id", "event_type", "event_id") == rows_of(want, "entity_id", "event_type", "event_id")
    got = streams.new_merchants(stream().withColumnRenamed("event_id", "transaction_id"), str(tmp_path / "b"))
    first = {r.i for r in events.groupBy("entity_id", "merchant_id").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("i")).collect()}
    flags = {r.transaction_id: r.is_new_merchant for r in got.collect()}
    assert len(flags) == got.count() == 600 and {i for i, f in flags.items() if f} == first


def test_groups_expire_and_state_does_not_grow(spark, tmp_path):
    """Every group is written a few times and then no more; files come by time."""
    ttl, start = 2 * DAY, datetime(2024, 1, 1)
    writes = [(f"u{i}", "g", start + timedelta(hours=6 * i + 30 * k)) for i in range(80) for k in range(2)] + [("u0", "g", start + timedelta(days=9))]
    writes.sort(key=lambda w: w[2])
    for at in range(0, len(writes), 20):
        df = spark.createDataFrame(writes[at : at + 20], "entity_id string, feature_group string, timestamp timestamp").withColumn("us", F.unix_micros("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    recorder = counters.Recorder()
    spark.streams.addListener(recorder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gone = streams.stored(streams.expiries(stream, ttl), str(tmp_path / "out"), "expired")
    got = sorted((r.entity_id, r.last_us, r.expired_us) for r in gone.collect())
    times = {}
    for entity, _, t in writes:
        times.setdefault(entity, []).append(int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    mark = max(t for ts in times.values() for t in ts) - 3_600_000_000
    want = [(e, a, a + ttl) for e, ts in times.items() for a, b in zip(ts, [*ts[1:], None]) if (b is None and a + ttl < mark) or (b is not None and b - a > ttl)]
    assert got == sorted(want) and len(got) > 60
    spark.streams.removeListener(recorder)
    state = [n for _, _, counter, _, n in recorder.found if counter == "state_rows"]
    assert state and max(state) < 40


def test_groups_share_states(spark, tmp_path):
    """More groups than states, null entities too, some written again: each expires as it would on its own."""
    ttl, start = 2 * DAY, datetime(2024, 1, 1)
    writes = [(None if i == 7 else f"u{i}", g, start + timedelta(hours=i + 30 * k * (i % 3))) for i in range(100) for g in "ab" for k in range(2)]
    writes = sorted({*writes, ("u0", "a", start + timedelta(days=9))}, key=lambda w: w[2])
    for at in range(0, len(writes), 100):
        df = spark.createDataFrame(writes[at : at + 100], "entity_id string, feature_group string, timestamp timestamp").withColumn("us", F.unix_micros("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    recorder = counters.Recorder()
    spark.streams.addListener(recorder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((str(r.entity_id), r.feature_group, r.last_us) for r in streams.stored(streams.expiries(stream, ttl, buckets=4), str(tmp_path / "out"), "expired").collect())
    spark.streams.removeListener(recorder)
    times = {}
    for entity, group, t in writes:
        times.setdefault((str(entity), group), []).append(int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    mark = max(t for ts in times.values() for t in ts) - 3_600_000_000
    want = [(*key, a) for key, ts in times.items() for a, b in zip(ts, [*ts[1:], None]) if (b is None and a + ttl < mark) or (b is not None and b - a > ttl)]
    assert got == sorted(want) and len(got) > 150
    state = [n for _, _, counter, _, n in recorder.found if counter == "state_rows"]
    assert state and max(state) <= 4


def lines_of(rows):
    return [json.dumps({"event_id": f"e{n}", "event_type": "user_profile_updated", "entity_id": "u", "entity_type": "user", "occurred_at": f"2024-01-{day:02d}T00:00:00", "payload": {"account_age_days": str(age)}, "source": "s"}) for n, day, age in rows]


def tables_of(store):
    log = sorted((r.event_id, r.feature_name, r.feature_value) for r in store.read("log", streams.VALUE).collect())
    latest = sorted((r.feature_name, r.feature_value) for r in store.read("latest", streams.LATEST).collect())
    dead = sorted((r.kind, r.failure_reason) for r in store.read("dead_letters", streams.LETTER).collect())
    counted = {}
    for r in store.read("counters", counters.COUNTERS).collect():
        counted[r.counter, r.label] = counted.get((r.counter, r.label), 0) + r.n
    return log, latest, dead, counted


def test_a_batch_that_dies_between_its_writes_changes_nothing(spark, tmp_path, monkeypatch):
    """Values that break a rule are rejected before any write, so the older valid value stays; a batch that is run again
    after it died leaves its events once in every table."""
    folder = tmp_path / "lines"
    batches = [[(1, 10, 5), (2, 20, 7)], [(3, 25, -1), (4, 5, 9), (2, 20, 7)], [(5, 21, 8), (6, 28, -3)]]
    for rows in batches:
        spark.createDataFrame([(x,) for x in lines_of(rows)], "value string").coalesce(1).write.mode("append").text(str(folder))
    rules = validate.definitions(spark)
    run = lambda: streams.ingest(ingest.file_events(spark, str(folder), per_trigger=1), str(tmp_path / "sink"), str(tmp_path / "checkpoint"), rules)
    merge, calls = Snapshots.merge, []

    def dies(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return merge(self, *args, **kwargs)

    monkeypatch.setattr(Snapshots, "merge", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    store = Snapshots(spark, str(tmp_path / "sink"))
    assert store.versions() == [1] and [r[0] for r in tables_of(store)[0]] == ["e1"] * 3 + ["e2"] * 3
    store = run()
    log, latest, dead, counted = tables_of(store)
    assert [r[0] for r in log] == [f"e{n}" for n in (1, 2, 4, 5) for _ in range(3)]
    assert latest == [("account_age_days", "8"), ("kyc_verified", "false"), ("preferred_currency", '"USD"')]
    assert dead == [("values", "account_age_days: below minimum")] * 2
    assert counted == {("events", "user_profile_updated"): 6, ("values", "log"): 12, ("dead_letters", "values"): 2}
    assert store.vacuum() > 0  # what the dead batch has left, and rewritten files
    assert tables_of(store) == (log, latest, dead, counted)
    run()
    assert tables_of(store)[0] == log


def test_sliding_windows_are_stored_by_panes(spark, shuffled, tmp_path):
    """A row for each entity and pane at most, not one for each of its windows; lengths need not be whole steps."""
    events, stream = shuffled
    got = streams.sliding_counts(str(tmp_path / "a"), "90 minutes", "1 hour").run(stream())
    want = events.groupBy("entity_id", F.window("timestamp", "90 minutes", "1 hour").alias("w")).count()
    assert rows_of(got, "entity_id", "start", "n") == rows_of(want, "entity_id", "w.start", "count")
    streams.sliding_counts(str(tmp_path / "b")).run(stream())
    assert spark.read.parquet(str(tmp_path / "b" / "sliding")).count() <= 600


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_files_of_a_stream_grow_in_number_not_in_rows(spark, monkeypatch):
    """Three batches whatever the rows; a file has no more than about so many rows, and results stay."""
    from cairnflow.plans import stores

    few = {name: sorted(map(tuple, getattr(stores, name)(spark, "/root/testdata/sf0.01").collect())) for name in ("st_new_merchant", "st_dedup")}
    monkeypatch.setattr(stores, "ROWS_OF_A_FILE", 500)
    made, folder_of = [], stores.shared_folder
    monkeypatch.setattr(stores, "shared_folder", lambda *a: made.append(folder_of(*a)) or made[-1])
    stream = stores._event_stream(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in spark.read.parquet(made[0]).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 21 and max(sizes) < 700
    batches = []
    streams.run_available(stream, lambda batch, n: batches.append(batch.count()), f"{made[0]}-checkpoint")
    assert len(batches) == 3 and sum(batches) == 10_000
    for name, rows in few.items():
        assert sorted(map(tuple, getattr(stores, name)(spark, "/root/testdata/sf0.01").collect())) == rows
