"""Vectors of any finite size link; packages are bounded whatever their records are."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from cairnflow.llm import collisions, decontaminate, warc
from cairnflow.llm.bpe import encoder
from cairnflow.llm.common import map_batches
from cairnflow.llm.queries import WORD_BPE


def test_vectors_of_any_finite_size_link(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 0.0], 1), (3, [1e-200, 1e-201], 1), (4, [1e-200, 1e-201], 1), (5, [0.0, 0.0], 1), (6, [float("inf"), 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in collisions.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[1][0] >= 1
    assert got[4][1] == got[3][1] and got[3][0] >= 1
    assert got[5] == (0, 5) and got[6] == (0, 6)


def test_packages_of_revisits_are_bounded(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "'http://e.example/' || id AS url", "'' AS html").repartition(2)
    manifest = warc.write_packages(pages, package_bytes=100_000)
    sizes = [r.bytes for r in manifest.collect()]
    assert len(sizes) > 5 and max(sizes) < 200_000
    back = warc.read_packages(manifest, payload=False).collect()
    assert len(back) == 3000 and sorted(r.page_id for r in back if r.record_type == "response") == [0]


def test_pages_of_repeated_payloads_whatever_way_they_come(spark):
    """Hot digests, digests of a few pages and pages of their own, with a filter and without one."""
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 4}" if i % 3 == 1 else f"own {i}") for i in range(4000)] + [(None, "hot"), (None, "own null"), (77, "own 77")]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string").repartition(6)
    first, nulls = {}, {h for i, h in rows if i is None}
    for i, h in rows:
        first[h] = min(first.get(h, 1 << 60), 1 << 60 if i is None else i)
    assert sum(n > 1 for n in __import__("collections").Counter(h for _, h in rows).values()) > 300
    want = sorted((i, "revisit" if i > first[h] and h not in nulls else "response", first[h] if i > first[h] and h not in nulls else None) for i, h in rows if i is not None)
    for limit in (1 << 20, 0):
        back = warc.read_packages(warc.write_packages(pages, filter_bytes=limit, package_bytes=50_000), payload=False).collect()
        assert sorted((r.page_id, r.record_type, r.refers_to) for r in back if r.page_id is not None) == want
        assert sum(r.page_id is None for r in back) == 2


@pytest.mark.parametrize("filter_bytes", [1 << 20, 0])
def test_benchmarks_in_any_blocks(spark, filter_bytes, monkeypatch):
    """Equal items, one long item and items of few words, in one block and in many: the same hits."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    items = [(str(i), prose(r.choice([1, 3, 9, 10, 14, 30]))) for i in range(40)] + [("same", prose(25))] * 30 + [("long", prose(900)), (None, prose(12)), ("none", None), ("blank", " ,")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    said = [t for _, t in items if t and len(t.split()) > 8]
    docs = [(i, f"x{i} y " + (r.choice(said)[: r.randrange(20, 200)] if i % 3 else "") + f" z{i} " + prose(5)) for i in range(90)]
    docs += [(200, None), (201, ""), (202, items[70][1][400:2500])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int")
    result = lambda **of: sorted((f.doc_id, f.n_words, [tuple(s) for s in f.word_spans], f.items) for f in decontaminate.find_leaks(df, bench, **of).collect())
    whole, left = result(), sorted(map(tuple, decontaminate.remove_leaks(df, bench).collect()))
    assert sum(bool(w[2]) for w in whole) > 20
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 50)
    pieces = decontaminate._pieces(bench, "item_id", "text", 10)
    parts = decontaminate._dealt(pieces, 600)
    sizes = [pieces.where(p).groupBy().sum("chars").first()[0] or 0 for p in parts]
    assert len(parts) > 5 and max(sizes) < 2400
    assert result(block_chars=600, filter_bytes=filter_bytes) == whole
    assert sorted(map(tuple, decontaminate.remove_leaks(df, bench, block_chars=600, filter_bytes=filter_bytes).collect())) == left


def test_workers_give_memory_back(spark):
    """Small arrays, and one above them that stays: malloc keeps what was freed below it for the worker's later tasks."""

    def heavy(batches):
        held = [np.ones(8000) for _ in range(5000)]  # 320 MB
        sys.stays = np.ones(8000)
        for b in batches:
            yield b.slice(0, len(held))

    def resident(batches):
        for b in batches:
            with open("/proc/self/statm") as f:
                pages = int(f.read().split()[1])
            yield pa.RecordBatch.from_arrays([pa.array([pages * 4096 / 1e6] * b.num_rows)], ["mb"])

    map_batches(spark.range(0, 2, 1, 2), heavy, "id bigint").collect()
    assert max(r.mb for r in map_batches(spark.range(0, 32, 1, 16), resident, "mb double").collect()) < 280


def test_workers_keep_tokenizers_for_one_stage(spark):
    def load(batches):
        encoder(WORD_BPE)
        yield from batches

    def kept(batches):
        n = encoder.cache_info().currsize
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int32())], ["n"])

    map_batches(spark.range(0, 4, 1, 4), load, "id bigint").collect()
    assert {r.n for r in map_batches(spark.range(0, 32, 1, 16), kept, "n int").collect()} == {0}
