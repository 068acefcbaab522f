"""The corpus operators against brute force, and their results for odd rows.

Odd rows: nulls in every column, empty and very long texts, ties, repeated rows, empty tables, and further columns
whose names clash with those that operators use inside.
"""

import base64
import hashlib
import json
import os
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import collisions, decontaminate, extract, quality, secrets, simhash, token_files, tokenize, toxicity, warc
from cairnflow.llm.boosting import Isotonic
from cairnflow.llm.bpe import Decoder, Encoder
from cairnflow.llm.collisions import Plan
from cairnflow.llm.components import components
from cairnflow.llm.convnet import ConvNet, echoes
from cairnflow.llm.dac import Reader, dump
from cairnflow.llm.fmindex import FMIndex, suffix_order
from cairnflow.llm.zip_directory import ZipDirectory

from cairnflow.llm.queries import BYTE_BPE, WORD_BPE

CLASH = "key long, text_ string, cell string, digest string, host string, row long, spans long, ids long, label_ string"
LONG = "the quick brown fox " * 20_000


def docs(spark, *texts, start=0):
    """Documents with clashing further columns; ids from start; (id, text) pairs keep their id."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    schema = f"doc_id long, text string, {CLASH}"
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", 1, 1, 1, "x") for r in rows], schema)


def by_id(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


# 1 decontamination


def brute_leaks(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, item in items:
            iw = words(item)
            k = min(window, len(iw))
            for p in {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else ():
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) == p:
                        hit |= set(range(i, i + k))
                        found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d,", "e"], n))
    items = [(i, make(int(rng.integers(1, 14)))) for i in range(12)] + [(98, None), (99, ""), (7, "repeated id zz"), (100, "..")]
    texts = [make(int(n)) for n in rng.integers(0, 90, 40)] + [None, "", "zz", f"{items[3][1]} {items[3][1]}", "REPEATED, id... ZZ", LONG]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, items string")
    found = by_id(decontaminate.find_leaks(docs(spark, *texts), bench), "n_words", "word_spans", "items")
    for i, want in enumerate(brute_leaks(texts, items)):
        n, spans, ids = found[i]
        assert (n, sum(s["end"] - s["start"] for s in spans), ids) == want
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))


def test_decontamination_in_blocks_and_small_shards(spark, monkeypatch):
    items = [(i, f"one two three four five six seven eight nine ten w{i} w{i + 1}") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"x {items[i][1]} y" for i in range(30)] * 2
    whole = by_id(decontaminate.find_leaks(docs(spark, *texts), bench), "word_spans", "items")
    cut = by_id(decontaminate.remove_leaks(docs(spark, *texts), bench), "text")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 800)
    assert by_id(decontaminate.find_leaks(docs(spark, *texts), bench), "word_spans", "items") == whole
    assert by_id(decontaminate.remove_leaks(docs(spark, *texts), bench), "text") == cut


def test_removal_cuts_the_spans_only(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    d = docs(spark, f"Before. {passage.upper()}, after", "clean text", None)
    out = decontaminate.remove_leaks(d, bench)
    assert out.columns == d.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["Before. , after", "clean text", None]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert by_id(decontaminate.find_leaks(docs(spark, "a b"), none), "n_words", "items") == {0: (2, [])}
    assert decontaminate.find_leaks(docs(spark).limit(0), none).count() == 0


def test_fm_index_equals_search():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(0, 4, int(rng.integers(1, 80)))
        s[0] = 0
        zeros = np.cumsum(s == 0)
        seq = [(0, z) if v == 0 else (1, v) for v, z in zip(s, zeros, strict=True)]
        assert list(suffix_order(s)) == sorted(range(len(s)), key=lambda i: seq[i:])
        index, p = FMIndex(s, 4), rng.integers(1, 4, 3)
        low, high = index.search(p[None], np.array([3]))
        want = [i for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(low[0], high[0]))) == want


# 2 BPE


needs_files = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no tokenizer files")
TRICKY = ["", " ", "Hello WORLD's 12½ ²", "<|endoftext|> a<|startoftext|>", "ΑΣ ς İ \x1c\x85 ​", "é é ñ 漢字 😀", "thaeinorgs" * 2000, "!" * 500, "Ᲊ Ɤ"]


@needs_files
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    texts = [*TRICKY, LONG, None]
    encoded = tokenize.encode(docs(spark, *texts), WORD_BPE)
    decoded = [tokenize.decode(f, WORD_BPE) for f in (encoded, tokenize.encode(docs(spark, *texts), WORD_BPE, as_text=True))]
    for form in (*decoded, tokenize.round_trip(docs(spark, *texts), WORD_BPE)):
        got = by_id(form, "n_tokens", "decoded")
        for i, t in enumerate(texts):
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert got[i] == (len(ids), library.decode(ids, skip_special_tokens=False))
    assert tokenize.encode(docs(spark).limit(0), WORD_BPE).count() == 0


@needs_files
def test_bpe_streams_in_pieces():
    e = Encoder(WORD_BPE)
    rng = np.random.default_rng(1)
    word = "".join(rng.choice(list("thaeinorgs"), 12_000))
    data = word.encode()
    whole = e.merges.merge_long([*(e.merges.inner[x] for x in data[:-1]), e.merges.final[data[-1]]])
    cuts = sorted(rng.integers(0, len(data), 9).tolist())
    assert list(e.merges.stream([data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)])) == whole
    assert 0 < e.merges.lookahead < 5_000
    assert Decoder(e.merges, surface=False).decode(e.encode("hello brave world")) == "hello brave world"


@needs_files
@pytest.mark.parametrize("size", [16, 64, 300])
def test_bpe_of_slices_equals_the_library(monkeypatch, size):
    """Runs longer than a slice stay open, wherever the text is cut."""
    import random

    from tokenizers import Tokenizer

    from cairnflow.llm import bpe

    monkeypatch.setattr(bpe, "SLICE", size)
    e, library, rng = Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE), random.Random(size)
    parts = ["aaaa" * 40, "word", "don't", "'re", " ", "\n", "123456", "!" * 50, "----", "é", "日本語", "<|endoftext|>", "<|", "'", "''s", "x" * 1900, "Σß…", "=/=" * 30]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert [i for ids in e.stream(pieces) for i in ids] == library.encode(text, add_special_tokens=False).ids


@needs_files
def test_bpe_of_a_stream_takes_constant_memory():
    """50 MB of words, then 300 KB without a blank, in pieces; nothing of the text is kept."""
    import psutil

    e, me, most, n = Encoder(WORD_BPE), psutil.Process(), 0, 0
    e.encode("warm up")
    before = me.memory_info().rss
    texts = (*(("the quick brown fox jumps over the lazy dog. " * 1000) for _ in range(1150)), *["thaeinorgs" * 1000] * 30)
    for ids in e.stream(iter(texts)):
        n += len(ids)
        most = max(most, me.memory_info().rss)
    assert n > 11_000_000 and most - before < 40 << 20


# 3 and 7 classifiers


def labelled_docs(spark, n=320):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aeiourstln"), 5))
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [word() for _ in range(30)]
        if bad:
            w[3] = w[9] = "vilewort" + str(rng.choice(["s", "en", ""]))
            w.insert(4, "you")
        texts.append(" ".join(w).upper() + "!!" if bad else " ".join(w))
        labels.append((i, int(not bad), int(bad)))
    return docs(spark, *texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, module, label):
    d, labels = labelled_docs(spark)
    scored = module.score(d, module.fit(d, labels)).withColumn("held", module.fold() == module.HELD_OUT)
    rows = scored.where("held").join(labels, "doc_id").collect()
    assert len(rows) > 40
    assert np.mean([(r.score >= module.THRESHOLD) == bool(r[label]) for r in rows]) > 0.9
    fit_only = labels.where(module.fold() != module.HELD_OUT)
    same = module.score(d, module.fit(d, fit_only))
    assert by_id(same, "score") == by_id(scored, "score")  # held-out labels change nothing


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, module, label):
    d, labels = labelled_docs(spark, 60)
    odd = docs(spark, None, "", " \n", LONG, "x", (7, "same text"), (7, "same text"), (None, "no id"), start=900)
    model = module.fit(d.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)))
    scores = [r.score for r in module.score(odd, model).collect()]
    assert len(scores) == 8 and all(0 <= s <= 1 for s in scores) and scores[5] == scores[6]
    assert module.score(odd.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where(F.col(label) == 1)):
        assert all(0 <= r.score <= 1 for r in module.score(odd, module.fit(d, some)).collect())


def test_clean_documents_stay(spark):
    d, labels = labelled_docs(spark)
    kept = toxicity.keep_clean(d, toxicity.fit(d, labels))
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in range(320) if i % 4 and i in ids]) >= 235
    assert len([i for i in range(0, 320, 4) if i in ids]) <= 4


def test_isotonic_never_falls():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=200).round(1)
    y = (rng.random(200) < 1 / (1 + np.exp(-raw))).astype(float)
    f = Isotonic().fit(raw, y)
    assert (np.diff(f(np.linspace(-4, 4, 300))) >= 0).all()


def test_convnet_gradients_and_slices():
    net = ConvNet(filters=4, dims=3, hidden=3)
    rng = np.random.default_rng(0)
    data = [rng.integers(97, 110, n).astype(np.uint8) for n in (700, 9, 1)]
    y = np.array([1, 0, 1], np.float32)
    grads = net._gradients(data, [echoes(d) for d in data], y)

    def loss():
        s = net.scores([d.tobytes() for d in data])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = net.w[k][at], 1e-2
        net.w[k][at] = old + h
        up = loss()
        net.w[k][at] = old - h
        assert g[at] == pytest.approx((up - loss()) / (2 * h), rel=0.05, abs=1e-4)
        net.w[k][at] = old
    long = rng.integers(97, 123, 200_000).astype(np.uint8)
    import cairnflow.llm.convnet as module

    whole = net.scores([long.tobytes()])
    old = module.SLICE
    try:
        module.SLICE = 128 * 50
        assert net.scores([long.tobytes()]) == pytest.approx(whole, rel=1e-5)
    finally:
        module.SLICE = old


# 4 HTML


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>{body}<footer>Foot</footer></body></html>"


HTML = [
    (page("<!-- c --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One.<br><p>Two\n  words&nbsp;here</p></article>"), "A & B\n\nOne.\n\nTwo words here"),
    (page("<header>Site</header><aside>Side</aside><main><p>Text</p><form>Name</form><div class='comments'><article>Nice</article></div></main><div id='cookie-notice'>OK</div>"), "Text"),
    (page("<article><p>Cut off"), "Cut off"),
    (page("<main><article><header><h1>T</h1></header><p>Text <a href='/l'>link</a> on</p><p class='notice'>Paid</p><p>End</p></article><section>More</section></main>"), "T\n\nText link on\n\nEnd"),
    (page("<article></article>"), ""),
    ("<p>Only <i>this</i></p><script>no</script>", "Only this"),
    ("a < b &lt; c", "a < b < c"),
    (None, ""),
    ("", ""),
    ("<article>" + "<p>x</p>" * 5000 + "</article>", "\n\n".join(["x"] * 5000)),
]


def test_main_text(spark):
    rows = [(i, "http://h.example/%d" % i, h, "t", "h") for i, (h, _) in enumerate(HTML)] + [(50, None, HTML[0][0], "t", "h")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string, host string")
    got = extract.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (HTML[r.page_id][1] if r.page_id < 50 else HTML[0][1])
    assert extract.extract(pages.limit(0)).count() == 0


def test_template_of_a_host_without_marks(spark):
    """Nothing but the pages themselves tells the menu and the notice from the text."""
    make = lambda i: f"<html><body><div class='x1'><a href='/'>Home</a> <a href='/b'>Blog</a></div><div class='x2'>All rights kept by us</div><div class='x3'><p>Story number {i} is told here at some length.</p></div></body></html>"
    rows = [(i, "http://one.example/%d" % i, make(i)) for i in range(8)]
    for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Story number {r.page_id} is told here at some length."


# 5 SimHash


def brute_components(prints, least):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= least:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(prints))]


def test_fingerprints_equal_brute_force(spark):
    import xxhash

    texts = ["One two  THREE\tfour\x0bfive", "a b", "solo", "a b c a b c a b c", "É è ß", "", None, " \n", LONG]
    got = by_id(simhash.fingerprints(docs(spark, *texts)), "fingerprint")
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        assert got[i][0] & (2**64 - 1) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h) > 0)


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    prints = []
    for base in rng.integers(0, 2**63, 25):
        for _ in range(int(rng.integers(1, 30))):
            v = int(base)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                v ^= 1 << int(b)
            prints.append(v)
    want = brute_components(prints, 3)
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 64)  # applies to this process; workers use the usual size
    distinct = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in sorted(set(prints))], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.link_fingerprints(distinct)).collect()}
    signed = [v - 2**64 if v >= 2**63 else v for v in prints]
    groups = lambda names: {frozenset(i for i, n in enumerate(names) if n == m) for m in set(names)}
    assert groups([roots.get(v, v) for v in signed]) == groups(want)


def test_near_duplicates_of_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    d = docs(spark, base, base, base + " w", None, "", (None, base), (3, None), "else where now", start=0)
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (None, 0), (3, 3), (7, 7)], key=str)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(1, 61)} | {101: 100}


# 6 WARC


def test_warc_round_trip(spark):
    texts = ["<p>x</p>", "", None, "<p>x</p>", "é", "<p>x</p>", LONG]
    rows = [(i, f"http://e.example/ü?q=a b\r\n{i}" if i else None, t, "d") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_packages(pages, package_bytes=100)
    got = {r.page_id: r for r in warc.read_packages(manifest).collect()}
    first = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[b]) if b in first else ("response", None))
        assert (None if r.payload is None else bytes(r.payload)) == (None if b in first else b)
        first.setdefault(b, i)
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.comment = b"PK about"
        for name in ("a", "ü", "packed"):
            z.writestr(zipfile.ZipInfo(name), bytes(range(250)), zipfile.ZIP_DEFLATED if name == "packed" else zipfile.ZIP_STORED)
    data = path.read_bytes()
    d = ZipDirectory(lambda o, n: data[o : o + n], len(data))
    assert list(d.members) == ["a", "ü", "packed"]
    assert d.range(d.members["ü"], 10, 20) == bytes(range(10, 30))
    for bad in (lambda: d.range(d.members["packed"], 0, 1), lambda: d.range(d.members["a"], 240, 20), lambda: ZipDirectory(lambda o, n: b"x" * n, 50)):
        with pytest.raises(ValueError):
            bad()


# 8 embeddings


def brute_links(rows, least=0.98):
    out = {}
    good = {}
    for i, v, label in rows:
        ok = label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        if ok:
            good[i] = (np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), label)
    links = {i: {j for j, (y, m) in good.items() if j != i and m == l and len(x) == len(y) and x @ y >= least} for i, (x, l) in good.items()}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("cell", [16, 2048])
def test_embedding_links_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(collisions, "CELL", cell)  # small cells: several tables, and cells cut in parts
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        base = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 25))):
            v = base + rng.normal(size=24) * 0.13
            rows.append((len(rows), [float(x) for x in np.float32(v)], k % 3))
    rows += [(len(rows) + i, rows[2][1], 0) for i in range(4)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [None] * 24, 1), (n + 4, [float("nan")] * 24, 1), (n + 5, rows[0][1], None), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies long, cell string")
    got = by_id(collisions.near_duplicates(table), "n_links", "component_id", "kept", key="vec_id")
    assert got == brute_links(rows)
    assert collisions.near_duplicates(table.limit(0)).count() == 0


def test_plan_keeps_its_recall():
    for largest in (100, 10_000, 10_000_000):
        p = Plan.of(largest)
        same = (1 - np.arccos(0.98) / np.pi) ** p.bits
        assert (1 - same) ** p.tables <= collisions.MISSED or p.bits == 0
        assert p.count > p.projections // 2


# 9 token files


def test_directly_addressable_codes():
    v = np.random.default_rng(0).choice([0, 1, 255, 256, 60_000, 70_000, 2**31], size=3000).astype(np.uint32)
    data = dump(v, [1, None], np.array([0, 10, 3000]))
    r = Reader(lambda o, n: data[o : o + n], len(data))
    assert [r.token(i) for i in range(0, 3000, 11)] == v[::11].tolist()
    assert all((r.tokens(a, a + b) == v[a : a + b]).all() for a in (0, 1, 511, 512, 2000) for b in (0, 1, 7, 513, 999))
    assert r.documents()[0] == [1, None]
    with pytest.raises(IndexError):
        r.token(3000)
    with pytest.raises(ValueError):
        Reader(lambda o, n: data[:-1][o : o + n], len(data) - 1)


@pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no tokenizer files")
def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    texts = [*TRICKY, None, "a\n\n  b \t", LONG, "same", "same"]
    d = docs(spark, *reversed(texts)).withColumn("doc_id", F.lit(len(texts) - 1) - F.col("doc_id"))
    manifest = token_files.write_tokens(d, BYTE_BPE, file_tokens=50)
    got = by_id(token_files.read_tokens(manifest), "start", "n_tokens", "ids")
    at = 0
    for i, t in enumerate(texts):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, n, ids = got[i]
        assert (start, n, zlib.crc32(ids)) == (at, len(want), zlib.crc32(want.tobytes()))
        at += n
    row = manifest.orderBy("first").first()
    assert token_files.open_tokens(row.file, row.bytes).token(0) == 2  # the first text is empty
    assert token_files.read_tokens(token_files.write_tokens(d.limit(0), BYTE_BPE)).count() == 0


# 10 secrets


def test_secret_scan(spark):
    texts = [
        "Token = \"abcdefghijkl\" passwd:short", "x AKIAABCDEFGHIJKLMN1 y AKIASHORT", "é deadbeefdeadbeef 0123456789abcde", "api_key=é", None, "",
        "key Zx81mQpL03vTyWn7cKe5RbUa end", "id 123e4567-e89b-12d3-a456-426614174000 and EXAMPLE0123456789abcdefGHIJ", "ſecret=aaaaaaaaaaaa", "password=token=abcdefghijkl", LONG,
    ]
    got = {r.doc_id: r.s for r in secrets.scan(docs(spark, *texts)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got[0] == "assign:0:21" and got[1] == "access:2:21" and got[2] == "hex:2:18"
    assert got[3] == got[4] == got[5] == got[8] == got[10] == ""
    assert got[6] == "entropy:4:28"
    assert "entropy" not in got[7]
    assert got[9] == "assign:0:27"
    assert secrets.scan(docs(spark).limit(0)).count() == 0


def test_incremental_entropy_equals_direct():
    rng = np.random.default_rng(9)
    for alphabet in ("ab", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123"):
        s, w, least = "".join(rng.choice(list(alphabet), 90)), 20, 3.0
        covered = set()
        for i in range(len(s) - w + 1):
            p = np.unique(list(s[i : i + w]), return_counts=True)[1] / w
            if -(p * np.log2(p)).sum() >= least - 1e-9:
                covered |= set(range(i, i + w))
        assert {k for a, b in secrets.dense_windows(s, w, least) for k in range(a, b)} == covered


def test_redaction(spark):
    d = docs(spark, 'a token = "24be64439e3e49cf46b2d7c90f3602a3" b', "clean", None, "")
    out = secrets.redact(d)
    assert out.columns == d.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ['a [REDACTED]" b', "clean", None, ""]


def test_index_lines_are_json():
    p = warc.Package()
    p.add(1, "http://e.example", b"x", None, False)
    assert json.loads(p.index[0])["offset"] == 0
