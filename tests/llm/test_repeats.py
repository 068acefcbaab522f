"""Repeated passages against plain Python, and the suffix arrays below."""

import random

import numpy as np
import pytest

from cairnflow.llm import filters, repeats, suffix_array

SCHEMA = "doc_id long, text string, doc string, tie int, body string, key int"


def plain(rows, length):
    """Spans and bytes left of each (doc_id, text), once."""
    docs = sorted({(i, "" if t is None else t) for i, t in rows}, key=lambda x: (x[0] is None, x[0] or 0, repeats_tie(x[1])))
    seen, out = set(), {}
    for doc, text in docs:
        body = text.encode()
        gone = np.zeros(len(body) + 1, bool)
        for at in range(len(body) - length + 1):
            window = body[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        out[doc, len(body), bytes(b for b, g in zip(body, gone) if not g)] = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return out


def repeats_tie(text):
    import hashlib

    return hashlib.sha256(text.encode()).digest()[:16]


def found(spark, rows, length, **limits):
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(5)
    got = repeats.remove_repeats(df, length=length, **limits).collect()
    assert len(got) == len(rows)
    return {(r.doc_id, r.n_bytes, bytes(r.kept)): [tuple(s) for s in r.spans] for r in got}


def sample(seed, docs):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeü漢", k=r.randrange(1, 9))) for _ in range(200)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    passages = [prose(20) for _ in range(6)]
    rows = []
    for i in range(docs):
        rows.append((r.randrange(-5, 3 * docs), prose(r.randrange(30)) + r.choice([*passages, ""]) + prose(r.randrange(30)) + r.choice([*passages, "", ""])))
    rows += [(i + 1000, t) for i, t in r.choices(rows, k=docs // 3)]
    rows += [(5000, "a" * 700), (5001, "b" + "a" * 300), (5002, "ab" * 300), (5003, "one line of text\n" * 60), (5004, None), (5005, ""), (5006, "short")]
    rows += [(None, rows[0][1]), (None, "a" * 90 + "c"), (5007, "same"), (5007, "same"), (5008, prose(40)), (5008, passages[0] + prose(9)), (5009, "nul\0" * 40)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot_bytes": 2_000}, {"hot_bytes": 300}, {"filter_bytes": 0}, {"filter_bytes": 0, "hot_bytes": 300}])
@pytest.mark.parametrize("length", [100, 24])
def test_equals_plain_python(spark, length, limits):
    rows = sample(length, 60)
    assert found(spark, rows, length, **limits) == plain(rows, length)


def test_one_passage_in_a_third_of_all_documents(spark):
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=400))
    rows = [(i, "".join(r.choices("ijklmnop ", k=60)) + passage * (i % 3 == 0) + "".join(r.choices("qrstuvw ", k=60))) for i in range(600)]
    assert found(spark, rows, 100, hot_bytes=5_000) == plain(rows, 100)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TEXT_BYTES", 500)
    rows = sample(9, 10) + [(7000, "".join(random.Random(3).choices("abc", k=3000)) * 2)]
    texts = [t for _, t in rows if t]
    for text in texts:
        windows = sum(len(piece) - 99 for _, piece in repeats._pieces(text.encode(), 100))
        assert windows == max(0, len(text.encode()) - 99)
    assert found(spark, rows, 100) == plain(rows, 100)


def test_no_rows(spark):
    assert found(spark, [], 100) == {}


@pytest.mark.parametrize("letters", [b"ab", b"a", b"abc\0", bytes(range(256))])
def test_suffix_arrays_equal_sets_of_windows(letters):
    r = random.Random(len(letters))
    for _ in range(300):
        length = r.choice([1, 2, 3, 5, 9])
        bodies = [bytes(r.choices(letters, k=r.randrange(length, length + 20))) for _ in range(r.randrange(1, 8))]
        seen, want = set(), []
        for i, b in enumerate(bodies):
            for at in range(len(b) - length + 1):
                want += [(i, at)] * (b[at : at + length] in seen)
                seen.add(b[at : at + length])
        assert list(zip(*(x.tolist() for x in suffix_array.repeated(bodies, length)))) == want


def test_order_and_common_prefixes():
    r = random.Random(2)
    bodies = [bytes(r.choices(b"abc", k=60)) for _ in range(5)]
    text, starts = suffix_array.joined(bodies, 8)
    wanted = np.zeros(len(text) - 8, bool)
    for a in starts:
        wanted[a : a + 53] = True
    order = suffix_array.suffix_order(text, wanted, 8)
    windows = [text[i : i + 8].tobytes() for i in order]
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and windows == sorted(windows)
    shared = [0] + [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(windows, windows[1:])]
    assert suffix_array.common_prefixes(text, order, 8).tolist() == shared


def test_windows_with_one_least_part_share_their_core():
    """Equal windows are filed under one key, coarse and fine."""
    r = random.Random(1)
    shared = bytes(r.choices(b"abcdef", k=150))
    keys = []
    for _ in range(2):
        text = bytes(r.choices(b"ghij", k=70)) + shared + bytes(r.choices(b"klm", k=80))
        prints = repeats.Prints(text)
        at, coarse = repeats.anchors(prints, 100)
        keys.append((coarse[70:121], repeats.finer(prints, at, coarse, 100)[70:121], prints.of(100)[70:121]))
    for a, b in zip(*keys):
        assert (a == b).all()


def test_filters_forget_nothing(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 30_000)
    df = spark.createDataFrame([(int(k),) for k in keys[:20_000]], "key long")
    has = filters.key_filter(df, 20_000).has(keys.view(np.uint64))
    assert has[:20_000].all() and has[20_000:].mean() < 0.05
    assert not filters.key_filter(df.limit(0), 0).has(keys.view(np.uint64)).any()
