"""The same transformations over streams, exact whatever the order in which events come.

Micro-batches change tables of a Snapshots folder, each by one commit that also notes the batch, so a batch that is run
again changes nothing. Windowed counts are kept as what each batch adds to a window: an event that comes late adds to an
old window like any other, is marked as late, and is never dropped. Tables of one row for a key (latest values, first
meetings) are merged file by file. Ids for de-duplication are looked up one by one in a state store on disk, so what a batch
reads does not grow with the history."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.operators import counters, validate
from cairnflow.operators.history import unpivot
from cairnflow.operators.segments import dealt
from cairnflow.sources.ingest import REQUIRED, TRANSFORMERS, parse, route
from cairnflow.sources.snapshots import Change, Snapshots, newest

MOST_DELTAS = 64
"""Files of what batches add to windows; where there are more, they are added up to one."""
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: point look-ups with filters of its own, not a map in memory."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", name: str | None = None) -> None:
    """Process what is there now, with exactly one sink call per micro-batch id, and stop."""
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _state_on_disk(stream.sparkSession):
        query = (writer.queryName(name) if name else writer).start()
        query.awaitTermination()


Write = Callable[[DataFrame, int], tuple[dict[str, Change], dict]]


def committing(store: Snapshots, query: str, write: Write) -> Callable[[DataFrame, int], None]:
    """Batches of a query to commits. write gives the changes and further marks; a batch that is in already is left alone."""

    def each(batch: DataFrame, n: int) -> None:
        if store.manifest()["marks"].get(query, -1) >= n:
            return
        changes, marks = write(batch, n)
        store.commit(changes, {query: n, **marks})

    return each


# Ingestion

VALUE = "event_id string, entity_id string, feature_group string, event_type string, occurred_at timestamp, feature_name string, feature_value string"
LETTER = "kind string, original string, failure_reason string"
LATEST = "entity_id string, feature_group string, feature_name string, feature_value string, occurred_at timestamp, event_id string"
LATEST_KEY = ["entity_id", "feature_group", "feature_name"]
IDS = ["event_id", "entity_id", "feature_group", "event_type", "occurred_at"]


def once(parsed: DataFrame) -> DataFrame:
    """Each event id once, however late it comes again, and each unreadable line once."""
    said = F.when(F.col("reason").isNull(), F.concat(F.lit("e"), "event_id")).otherwise(F.concat(F.lit("l"), F.sha2("raw", 256)))
    return parsed.withColumn("_said", said).dropDuplicates(["_said"]).drop("_said")


def ingest(lines: DataFrame, folder: str, checkpoint: str, definitions: DataFrame | None = None) -> Snapshots:
    """Lines of JSON to four tables that change together: log (a row for each feature value), latest (the newest value of
    each feature of an entity), dead_letters and counters.

    Lines that can't be read, records that can't be transformed and, with definitions, records with a value that breaks a
    rule are dead letters, whole, before anything is written of them. Each event counts once, however late it comes."""
    store = Snapshots(lines.sparkSession, folder)
    kinds = ("line", "record")

    def write(batch: DataFrame, n: int) -> tuple[dict[str, Change], dict]:
        read = counters.Counted("ingest", [
            *counters.by_value("events", F.col("event_type"), TRANSFORMERS, other="other"),
            *counters.by_value("unreadable", F.col("reason"), [f"missing or invalid {f}" for f in REQUIRED]),
        ], n)
        batch = read.over(batch).persist()
        records = route(batch).persist()
        records.count()  # reads the batch once; the writes below share it and run side by side
        plain = [c for c in records.columns if c not in (*IDS, "reason", "raw")]
        values = unpivot(records.where("reason IS NULL").drop("reason"), plain, [*IDS, "raw"])
        if definitions is not None:
            checked = validate.errors(values.withColumn("feature_version", F.lit("v1")), definitions)
            checked = checked.withColumn("broken", F.max(F.size("errors") > 0).over(Window.partitionBy("event_id"))).persist()
            broken = checked.where("broken").groupBy("event_id").agg(F.first("raw").alias("original"), F.array_join(F.array_sort(F.flatten(F.collect_list("errors"))), "; ").alias("failure_reason"))
            values, invalid = checked.where("NOT broken"), broken.select(F.lit("values").alias("kind"), "original", "failure_reason")
        else:
            checked, invalid = None, None
        letters = [
            df.where("reason IS NOT NULL").select(F.lit(kind).alias("kind"), F.col("raw").alias("original"), F.col("reason").alias("failure_reason"))
            for kind, df in zip(kinds, (batch, records), strict=True)
        ]
        dead = letters[0].unionByName(letters[1])
        dead = dead if invalid is None else dead.unionByName(invalid)
        kept = counters.Counted("ingest", [("values", "log", F.count(F.lit(1)))], n)
        left = counters.Counted("ingest", counters.by_value("dead_letters", F.col("kind"), (*kinds, "values")), n)
        log = values.select(*IDS, "feature_name", "feature_value")
        latest = log.select(*LATEST_KEY, "feature_value", "occurred_at", "event_id")
        with ThreadPoolExecutor(3) as pool:
            made = {
                "log": pool.submit(store.append, "log", kept.over(log)), "dead_letters": pool.submit(store.append, "dead_letters", left.over(dead)),
                "latest": pool.submit(store.merge, "latest", latest, LATEST_KEY, [F.col("occurred_at"), F.col("event_id")]),
            }
            changes = {name: m.result() for name, m in made.items()}
        counted = [*read.rows(), *kept.rows(), *left.rows()]
        changes["counters"] = store.append("counters", counters.table(store.spark, counted).coalesce(1))
        for df in (checked, records, batch):
            if df is not None:
                df.unpersist()
        return changes, {}

    run_available(once(parse(lines)), committing(store, "ingest", write), f"{checkpoint}/events")
    return store


def deduplicate(events: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Each event id once, whatever its time and batch; gives what is stored."""
    store = Snapshots(events.sparkSession, folder)
    run_available(events.dropDuplicates(["event_id"]), committing(store, "deduplicate", lambda batch, n: ({"events": store.append("events", batch)}, {})), checkpoint)
    return store.read("events", events.schema)


# Windows


class Deltas:
    """A table of what each batch adds, and how additions make the whole."""

    def __init__(self, folder: str, name: str, add: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame], delay: int = 86_400_000_000, shown: Callable[[DataFrame], DataFrame] = lambda whole: whole):
        """add: rows of a batch, with `late`, to additions (any number of rows of a key). whole: additions to the result;
        it has to give the same for the result of some of the additions and the others. delay: microseconds behind the
        newest event of earlier batches from which an event is late; late additions are marked, and count like others. shown:
        the whole to what is given, if that is more than is to be stored."""
        self.folder, self.name, self.add, self.whole, self.delay, self.shown = folder, name, add, whole, delay, shown

    def run(self, events: DataFrame) -> DataFrame:
        """Take up what there is; gives the result, with the number of events of each key that came late."""
        store = Snapshots(events.sparkSession, self.folder)
        schema: list[T.StructType] = []

        def write(batch: DataFrame, n: int) -> tuple[dict[str, Change], dict]:
            marks = store.manifest()["marks"]
            seen = marks.get(f"{self.name}:newest")
            late = F.lit(False) if seen is None else F.col("us") < seen - self.delay
            count = counters.Counted(self.name, [("events", "late", F.count(F.when(F.col("late"), 1))), ("events", "all", F.count(F.lit(1))), ("events", "newest", F.max("us"))], n)
            added = self.add(count.over(batch.withColumn("late", late)))
            schema.append(added.schema)
            change = store.append(self.name, added)
            files = store.files(self.name)
            if len(files) >= MOST_DELTAS:
                sum_ = store.append(self.name, self.whole(store.read(self.name, added.schema)).select(*added.columns))
                change = Change(sum_.added + change.added, set(files))
            counted = count.rows()
            top = max([seen or 0, *(c[4] for c in counted if c[3] == "newest")])
            rows = [c for c in counted if c[3] != "newest"]
            changes = {self.name: change, "counters": store.append("counters", counters.table(store.spark, rows).coalesce(1))}
            return changes, {f"{self.name}:newest": top}

        run_available(events, committing(store, self.name, write), f"{self.folder}/checkpoint-{self.name}")
        kind = schema[0] if schema else self.add(events.sparkSession.createDataFrame([], events.schema).withColumn("late", F.lit(False))).schema
        return self.shown(self.whole(store.read(self.name, kind)))

    def counted(self, spark: SparkSession) -> DataFrame:
        """Events, and late ones, of each batch."""
        return Snapshots(spark, self.folder).read("counters", counters.COUNTERS).where(F.col("job") == self.name)


def _late() -> Column:
    return F.sum(F.col("late").cast("long")).alias("late")


def _added_up(keys: list[str], **sums: str) -> Callable[[DataFrame], DataFrame]:
    return lambda deltas: deltas.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def sliding_counts(folder: str, length: str = "24 hours", step: str = "1 hour") -> Deltas:
    """Events are counted, and stored, by panes of which all windows are made; windows are made of them where an entity is."""
    pane = math.gcd(*(round(pd.Timedelta(t).total_seconds() * 1_000_000) for t in (length, step)))

    def add(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_id")  # a file is no one task's
        counts = rows.groupBy("entity_id", F.window("timestamp", f"{pane} microseconds").alias("w")).agg(F.count("*").alias("n"), _late())
        return counts.select("entity_id", F.col("w.start").alias("start"), "n", "late")

    add_up = _added_up(["entity_id", "start"], n="n", late="late")

    def whole(deltas: DataFrame) -> DataFrame:
        return add_up(dealt(deltas, "entity_id"))

    def shown(panes: DataFrame) -> DataFrame:
        windows = panes.select("entity_id", F.window("start", length, step).alias("w"), "n", "late")
        return add_up(windows.select("entity_id", F.col("w.start").alias("start"), "n", "late"))

    return Deltas(folder, "sliding", add, whole, shown=shown)


def tumbling_counts(folder: str, length: str = "1 day") -> Deltas:
    def add(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(F.window("timestamp", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), _late())
        return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total", "late")

    return Deltas(folder, "tumbling", add, _added_up(["start", "event_type"], n="n", total="total", late="late"))


def sessions(folder: str, gap: str = "30 minutes") -> Deltas:
    """Sessions of a batch are pieces; pieces of an entity that overlap are one session."""

    def add(rows: DataFrame) -> DataFrame:
        pieces = rows.groupBy("entity_id", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n"), _late())
        return pieces.select("entity_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "late")

    def whole(pieces: DataFrame) -> DataFrame:
        mine = Window.partitionBy("entity_id").orderBy("start", "end")
        reach = F.max("end").over(mine.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(F.col("start") < reach, 0).otherwise(1)
        numbered = pieces.withColumn("opens", opens).withColumn("session", F.sum("opens").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
        found = numbered.groupBy("entity_id", "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("late").alias("late"))
        return found.drop("session")

    return Deltas(folder, "sessions", add, whole)


# Tables of one row for a key


def latest_values(events: DataFrame, folder: str) -> DataFrame:
    """The newest value of each entity and type."""
    store, key, order = Snapshots(events.sparkSession, folder), ["entity_id", "event_type"], [F.col("us"), F.col("event_id")]
    rows = events.select(*key, "value", "us", "event_id")
    run_available(rows, committing(store, "latest", lambda batch, n: ({"latest": store.merge("latest", batch, key, order)}, {})), f"{folder}/checkpoint-latest")
    return store.read("latest", rows.schema)


def new_merchants(transactions: DataFrame, folder: str) -> DataFrame:
    """Each transaction with whether its entity meets the merchant for the first time: the earliest of the pair, whatever the
    batch in which it comes. A batch that brings an earlier meeting takes the flag from the one that had it."""
    store, pair = Snapshots(transactions.sparkSession, folder), ["entity_id", "merchant_id"]
    rows = transactions.select("transaction_id", "entity_id", "us", "merchant_id")
    flags = T.StructType(list(rows.schema.fields)).add("is_new_merchant", "boolean").add("batch", "long")

    def write(batch: DataFrame, n: int) -> tuple[dict[str, Change], dict]:
        batch = batch.persist()
        own = newest(batch, pair, [-F.col("us"), -F.col("transaction_id")]).persist()
        before = store.read("first", rows.schema, files=store.touched("first", own, pair))
        before = before.select(*(F.col(c).alias(f"old_{c}") for c in rows.columns))
        same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in pair]
        earlier = F.struct("us", "transaction_id") < F.struct("old_us", "old_transaction_id")
        met = own.join(before, same, "left").withColumn("first", F.col("old_us").isNull() | earlier)
        first = met.where("first").select(F.col("transaction_id").alias("first_id"))
        mine = batch.join(first, F.col("transaction_id") == F.col("first_id"), "left")
        mine = mine.select(*rows.columns, F.col("first_id").isNotNull().alias("is_new_merchant"))
        undone = met.where("first AND old_us IS NOT NULL").select(*(F.col(f"old_{c}").alias(c) for c in rows.columns), F.lit(False).alias("is_new_merchant"))
        changes = {"flags": store.append("flags", mine.unionByName(undone).withColumn("batch", F.lit(n).cast("long")))}
        changes["first"] = store.merge("first", own, pair, [-F.col("us"), -F.col("transaction_id")])
        own.unpersist()
        batch.unpersist()
        return changes, {}

    run_available(rows, committing(store, "merchants", write), f"{folder}/checkpoint-merchants")
    return newest(store.read("flags", flags), ["transaction_id"], [F.col("batch")]).drop("batch")


# State that expires


def expiries(writes: DataFrame, ttl: int, delay: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Of writes (entity_id, feature_group, timestamp, us) the times at which a group of an entity expires: ttl microseconds
    after its last write, unless it is written before. State: the last write of each group that is alive; a timer ends it
    when the watermark, `delay` behind the newest write, has passed. Writes that come behind the watermark are not seen.

    Groups are dealt by a hash into buckets, each with one state and the timer of the first of its groups to end, so that
    Python is called as often as there are buckets, not groups."""

    def expire(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        alive = {(e, g): last for e, g, last in json.loads(state.get[0])} if state.exists else {}
        gone, written = [], set()
        if not state.hasTimedOut:
            for t, *group in sorted((w for f in frames for w in zip(f["us"].tolist(), f["entity_id"], f["feature_group"], strict=True)), key=lambda w: w[0]):
                group = tuple(group)
                last = alive.get(group)
                if last is not None and t - last > ttl:
                    gone.append((*group, last))
                alive[group] = t if last is None else max(last, t)
                written.add(group)
        mark, first = state.getCurrentWatermarkMs(), None
        for group, last in list(alive.items()):
            ends = -(-(last + ttl) // 1000)
            if ends < mark or (ends == mark and group in written):
                gone.append((*group, last))
                del alive[group]
            else:
                first = ends if first is None else min(first, ends)
        if alive:
            state.update((json.dumps([[*group, last] for group, last in alive.items()]),))
            state.setTimeoutTimestamp(first)
        elif state.exists:
            state.remove()
        if gone:
            found = pd.DataFrame(gone, columns=["entity_id", "feature_group", "last_us"])
            yield found.assign(expired_us=found["last_us"] + ttl)

    bucket = F.pmod(F.xxhash64("entity_id", "feature_group"), F.lit(buckets)).alias("bucket")
    rows = writes.withWatermark("timestamp", delay).select(bucket, "entity_id", "feature_group", "timestamp", "us")
    out = "entity_id string, feature_group string, last_us bigint, expired_us bigint"
    return rows.groupBy("bucket").applyInPandasWithState(expire, out, "alive string", "append", "EventTimeTimeout")


def stored(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """What a query in append mode gives over what is there now."""
    store = Snapshots(stream.sparkSession, folder)
    run_available(stream, committing(store, name, lambda batch, n: ({name: store.append(name, batch)}, {})), f"{folder}/checkpoint-{name}")
    return store.read(name, stream.schema)
