"""Finding and mending broken conversations with as few edits as possible.

A conversation's rows are taken by turn (nulls first), rows of one turn by role and text. The first of these faults of a
row counts: blank (only white space), duplicate (role and text came before), truncated (does not end in . ! or ?).

Conversations of ordinary size meet in one task each. Longer ones, whatever their share of all rows, are cut: equal rows
are counted first, first occurrences come from an aggregate, rows are dealt out by ranges of (conversation, turn, role,
text), and every task finds for its stretch, in chunks, the cheapest edits from any state of the roles to any other. Only
these are then strung together, and the chosen ones applied where the chunks are.

Null roles and texts count as one space. A null conv_id is a conversation like any other, and so is one without any row
present: it has no faults, costs nothing and keeps nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import audit
from cairnflow.llm.common import map_batches, scratch, written

LONG_ROWS, LONG_CHARS = 20_000, 32 << 20
"""Beyond either a conversation is cut; below it fits in one task with ease."""
CHUNK_ROWS = 4_096
ROWS_OUT = "array<struct<turn:bigint,role:string,text:string,edit:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SPACE = r"[\x20\x09-\x0D]"
_WHITE = " \t\n\x0b\x0c\r"
_TURNS = frozenset({"su", "ua", "au"})


def normal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role and text only; a null role or text is one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with planted faults, by crc32 of "conv_id:turn" (a null is one space) modulo 20: 0 drops a row, 1
    empties its text, 2 takes its . ! and ? away, 3 repeats it, 4 makes it the user's. Gives conv, turn, role, text and
    present, false for rows that are dropped, so that no conversation vanishes."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = normal(df, conv, turn, role, text).withColumn("fault", fault)
    damaged = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), damaged.alias("text"),
        (F.col("fault") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_n"),
    )
    return rows.drop("_n")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Conversations with their faults and their cheapest repair. rows: as damage() and normal() give them.

    A row for each part of a conversation: conv, part (from 0), parts, and rows, the repaired rows of the part (turn, role,
    text, edit). Part 0 also has what concerns the whole: gaps, blank, duplicate, truncated, illegal, cost and audit, the
    edits' initials; ordinary conversations are one part."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    rows = rows.select("conv", "turn", "role", "text", "present")
    spark = rows.sparkSession
    sizes = rows.where("present").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = written(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv").alias("long_conv")), scratch(spark, "long_conversations"))
    if long.isEmpty():
        return _ordinary(rows)
    same = F.col("conv").eqNullSafe(F.col("long_conv"))
    return _ordinary(rows.join(long, same, "left_anti")).unionByName(_cut(rows.join(long, same, "left_semi"), chunk_rows))


def digests(parts: DataFrame) -> DataFrame:
    """conv, and the SHA-256 of the repaired rows as role:text, joined by newlines. The rows of a conversation in several
    parts pass one after the other through one hash, as SHA-256 has it."""
    line = lambda r: F.concat(r["role"], F.lit(":"), r["text"])
    whole = F.sha2(F.array_join(F.transform("rows", line), "\n"), 256)
    single = parts.where("parts = 1").select("conv", whole.alias("repaired_sha256"))
    several = parts.where("parts > 1").select("conv", "part", "rows").repartition("conv").sortWithinPartitions("conv", "part")
    kind = parts.schema["conv"].dataType.simpleString()
    return single.unionByName(map_batches(several, _hash_parts, f"conv {kind}, repaired_sha256 string", rows=4))


# Ordinary conversations: one task for each.


def _ordinary(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    whole = f"conv {kind}, part bigint, parts bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, rows {ROWS_OUT}"
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return map_batches(rows.repartition("conv").sortWithinPartitions(*order), _repair_batches, whole)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _fault(text: str, duplicate: bool) -> str:
    last = text.rstrip(_WHITE)[-1:]
    return "blank" if not last else "duplicate" if duplicate else "" if last in ".!?" else "truncated"


class _Stretch:
    """Consecutive rows of a conversation, with their faults."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.faults: list[str] = []
        self.size = 0

    def add(self, row: dict, duplicate: bool) -> None:
        self.rows.append({k: row[k] for k in ("turn", "role", "text")})
        self.faults.append(_fault(row["text"], duplicate))
        self.size += len(row["text"])

    def steps(self) -> Iterator[audit.Row]:
        for row, fault in zip(self.rows, self.faults, strict=True):
            yield row["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"

    def totals(self) -> dict:
        """What adds up over stretches, and what is needed at their seams."""
        initials = [r["role"][:1] for r in self.rows]
        turns = [r["turn"] for r in self.rows if r["turn"] is not None]
        return {
            **{f: self.faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in _TURNS for a, b in zip(initials, initials[1:], strict=False)),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        }


def _gaps(totals: dict) -> int:
    return 0 if totals["low"] is None else totals["high"] - totals["low"] + 1 - totals["turns"]


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Output()
    conv, stretch, seen = None, None, set()

    def close() -> dict:
        cost, edits = audit.repaired(stretch.steps())
        totals = stretch.totals()
        counts = {c: totals[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv": conv, "part": 0, "parts": 1, "gaps": _gaps(totals), **counts, "cost": cost, "audit": edits, "rows": audit.applied(edits, stretch.rows)}

    for batch in batches:
        for row in batch.to_pylist():
            if stretch is None or row["conv"] != conv:
                if stretch is not None:
                    yield from out.add(close(), stretch.size)
                conv, stretch, seen = row["conv"], _Stretch(), set()
            if row["present"]:
                said = (row["role"], row["text"])
                stretch.add(row, said in seen)
                seen.add(said)
        out.kind = batch.schema.field("conv").type
    if stretch is not None:
        yield from out.add(close(), stretch.size)
    yield from out.rest()


class _Output:
    """Result rows in batches of bounded size."""

    ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
    MOST_ROWS, MOST_CHARS = 1_000, 8 << 20

    def __init__(self) -> None:
        self.kind: pa.DataType = pa.int64()
        self.rows: list[dict] = []
        self.size = 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= self.MOST_ROWS or self.size >= self.MOST_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            whole = [("conv", self.kind), ("part", pa.int64()), ("parts", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("rows", self.ROWS)]
            yield pa.RecordBatch.from_pylist(self.rows, pa.schema(whole))
        self.rows, self.size = [], 0


# Long conversations: chunks, in whichever task they are.

_ENDS = "array<struct<cost:bigint,audit:string>>"
_SEAM = {"blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "first": "string", "last": "string", "low": "bigint", "high": "bigint", "turns": "bigint"}


def _cut(rows: DataFrame, chunk_rows: int) -> DataFrame:
    spark = rows.sparkSession
    folder = scratch(spark, "conversation_chunks")
    kind = rows.schema["conv"].dataType.simpleString()
    turn = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("at"))
    counted = rows.where("present").groupBy("conv", "role", "text", "turn").agg(F.count("*").alias("n")).withColumn("said", F.sha2("text", 256))
    counted = written(counted, f"{folder}/rows")
    first = counted.groupBy("conv", "role", "said").agg(F.min(turn).alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "first")
    flagged = counted.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    flagged = flagged.select("conv", "turn", "role", "text", "n", (turn != F.col("first")).alias("duplicate"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = written(flagged, f"{folder}/flagged").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id().cast("long"))
    seam = ", ".join(f"{name} {of}" for name, of in _SEAM.items())
    plain = "array<struct<turn:bigint,role:string,text:string>>"
    chunks = map_batches(ranged, _chunker(chunk_rows), f"conv {kind}, part bigint, rows {plain}, ends array<{_ENDS}>, seam struct<{seam}>")
    chunks = written(chunks, f"{folder}/chunks")
    strung = chunks.select("conv", "part", "ends", "seam").repartition("conv").sortWithinPartitions("conv", "part")
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    chosen = map_batches(strung, _string_together, f"conv {kind}, at bigint, number bigint, parts bigint, state int, edits string, {counts}, audit string", rows=64)
    chosen = written(chosen, f"{folder}/chosen").withColumnRenamed("conv", "c")
    both = chunks.select("conv", "part", "rows").join(chosen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("at")))
    both = both.select("conv", F.col("number").alias("part"), "parts", *COUNTS, "audit", "rows", "state", "edits")
    whole = f"conv {kind}, part bigint, parts bigint, {counts}, audit string, rows {ROWS_OUT}"
    return map_batches(both, _apply_chunks, whole, rows=4)


def _chunker(chunk_rows: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, stretch = 0, None, _Stretch()

        def close(kind: pa.DataType) -> pa.RecordBatch:
            runs = [audit.Repair(state, opening=False) for state in range(4)]
            for step in stretch.steps():
                for run in runs:
                    run.row(*step)
            ends = [[None if e is None else {"cost": e[0], "audit": e[1]} for e in run.ends()] for run in runs]
            row = {"conv": conv, "part": task << 32 | number, "rows": stretch.rows, "ends": ends, "seam": stretch.totals()}
            plain = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
            end = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
            seam = pa.struct([(k, pa.string() if of == "string" else pa.int64()) for k, of in _SEAM.items()])
            return pa.RecordBatch.from_pylist([row], pa.schema([("conv", kind), ("part", pa.int64()), ("rows", plain), ("ends", end), ("seam", seam)]))

        kind, task = None, 0
        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if stretch.rows and row["conv"] != conv:
                    yield close(kind)
                    number, stretch = number + 1, _Stretch()
                conv, task = row["conv"], row["task"]
                for i in repeat(0, row["n"]) if row["duplicate"] else range(row["n"]):
                    if len(stretch.rows) >= chunk_rows or stretch.size >= LONG_CHARS // 4:
                        yield close(kind)
                        number, stretch = number + 1, _Stretch()
                    stretch.add(row, row["duplicate"] or i > 0)
        if stretch.rows:
            yield close(kind)

    return chunks


def _string_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of a conversation in order: which of each one's ways is on the cheapest path, as a row for each chunk."""
    kind = pa.int64()
    conv, chain = None, None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if chain is None or row["conv"] != conv:
                if chain is not None:
                    yield chain.close(conv, kind)
                conv, chain = row["conv"], _Chain()
            chain.add(row)
    if chain is not None:
        yield chain.close(conv, kind)


class _Chain:
    def __init__(self) -> None:
        opening = audit.Repair()
        self.best: list[tuple[int, str] | None] = opening.ends()
        """Rows inserted before the first one are ways into its chunk."""
        self.opened = [None if e is None else e[1] for e in self.best]
        self.totals: dict | None = None
        self.parts: list[tuple[int, list, list[list[str | None]]]] = []

    def add(self, row: dict) -> None:
        best: list[tuple[int, str] | None] = [None] * 4
        came: list[int | None] = [None] * 4
        for s, here in enumerate(self.best):
            for t, end in enumerate(row["ends"][s]):
                if here is None or end is None:
                    continue
                way = (here[0] + end["cost"], here[1] + end["audit"])
                if best[t] is None or way < best[t]:
                    best[t], came[t] = way, s
        edits = [[None if e is None else e["audit"] for e in ways] for ways in row["ends"]]
        self.parts.append((row["part"], came, edits))
        self.best = best
        seam = row["seam"]
        if self.totals is None:
            self.totals = dict(seam)
            return
        t = self.totals
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            t[name] += seam[name]
        t["illegal"] += t["last"] + seam["first"] not in _TURNS
        t["turns"] -= seam["low"] is not None and t["high"] == seam["low"]
        t["low"] = seam["low"] if t["low"] is None else t["low"]
        t["high"] = t["high"] if seam["high"] is None else seam["high"]
        t["last"] = seam["last"]

    def close(self, conv: object, kind: pa.DataType) -> pa.RecordBatch:
        end = audit.best_end(self.best)
        cost, edits = self.best[end]
        rows, state = [], end
        for at, came, ways in reversed(self.parts):
            before = came[state]
            rows.append({"conv": conv, "at": at, "parts": len(self.parts), "state": before, "edits": ways[before][state]})
            state = before
        rows.reverse()
        rows[0]["edits"] = (self.opened[rows[0]["state"]] or "") + rows[0]["edits"]
        rows[0]["state"] = audit.START
        counts = {c: self.totals[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        rows[0] |= counts | {"gaps": _gaps(self.totals), "cost": cost, "audit": edits}
        for number, row in enumerate(rows):
            row["number"] = number
        fields = [("conv", kind), ("at", pa.int64()), ("number", pa.int64()), ("parts", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]
        return pa.RecordBatch.from_pylist(rows, pa.schema([*fields, *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())]))


def _apply_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Output()
    for batch in batches:
        out.kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            edits, state = row.pop("edits"), row.pop("state")
            yield from out.add(row | {"rows": audit.applied(edits, row["rows"], state)}, sum(len(r["text"]) for r in row["rows"]))
    yield from out.rest()


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, conv, digest, empty = pa.int64(), None, None, True
    for batch in batches:
        kind, done = batch.schema.field("conv").type, []
        for row in batch.to_pylist():
            if digest is None or row["conv"] != conv:
                if digest is not None:
                    done.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest, empty = row["conv"], hashlib.sha256(), True
            for r in row["rows"]:
                digest.update(("" if empty else "\n").encode() + f"{r['role']}:{r['text']}".encode())
                empty = False
        yield pa.RecordBatch.from_pylist(done, pa.schema([("conv", kind), ("repaired_sha256", pa.string())]))
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], pa.schema([("conv", kind), ("repaired_sha256", pa.string())]))
