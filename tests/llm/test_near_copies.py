"""Near copies of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pytest

from cairnflow.llm import near_copies


def edited(words, rng, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return words


def groups(texts, least=near_copies.SIMILARITY):
    """Of each text the first one that is linked to it."""
    sets, group = [set(near_copies.shingles(t).tolist()) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if (len(x & sets[j]) / len(x | sets[j]) if x | sets[j] else 1.0) >= least:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = ["", None, " \t", "two words", "two words", "Two  Words", "other words"]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 300))]
        out += [" ".join(edited(base, rng, k * len(base) // 200)) for k in (0, 1, 2, 3, 4, 5, 6, 8, 12)]
    chain = [f"c{k}" for k in range(200)]
    out += [" ".join(chain[4 * k : 4 * k + 100]) for k in range(20)]
    return out


def test_similar_texts_are_one_component(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()}
    want = groups(texts)
    assert got == dict(enumerate(want))
    assert 30 < len(set(want)) < len(want) - 100


def test_pipeline_stage_drops_edited_copies(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted(set(groups(texts)))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.near_duplicates(docs).collect() == []


def test_one_row_of_each_group_stays_whatever_the_keys(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a, 1), (5, a, 1), (5, a, 2), (1, b, 1), (2, b, 1), (2, c, 1), (None, d, 1), (None, d, 1), (None, b, 1), (None, c + " end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted((r[:2] for r in got), key=repr) == sorted([(5, a), (1, b), (2, c), (None, d)], key=repr)


def test_last_round_has_each_candidate_pair_once(spark):
    plan = near_copies.Plan.of(5000)
    assert plan.bits and plan.tables > 1
    rng = np.random.default_rng(3)
    words = np.concatenate([np.repeat(rng.integers(-(2**63), 2**63 - 1, (1, near_copies.PARTS)), 25, 0) for _ in range(3)])
    for row in words:
        for at in rng.integers(0, 64 * near_copies.PARTS, 90):
            row[at // 64] ^= np.int64(np.uint64(1 << int(at % 64)).view(np.int64))
    roots = [i % 40 for i in range(len(words))]
    rows = [(i, 50, *map(int, w), roots[i]) for i, w in enumerate(words)]
    names = ", ".join(f"{w} bigint" for w in near_copies._WORDS)
    marked = spark.createDataFrame(rows, f"id bigint, size bigint, {names}, root bigint")
    got = [tuple(r) for r in near_copies._apart(near_copies._placed(marked, plan), plan, nearest=False).collect()]
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    want = set()
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            differ = bits[i] ^ bits[j]
            near = differ[: 64 * near_copies.LOOKED_AT].sum() <= plan.radius and differ.sum() <= plan.whole
            if roots[i] != roots[j] and near and any(not differ[m].any() for m in plan.masks()):
                want.add((i, j))
    assert len(want) > 100
    assert len(got) == len(set(got)) and set(got) == want


def colliding(rng):
    """Two ASCII texts of 64 characters with one 64-bit XXH64 of Spark's seed: the second stripe makes up for the first."""
    p1, p2, mask = 11400714785074694791, 14029467366897019727, (1 << 64) - 1
    step = lambda acc, x: ((acc + x * p2 & mask) << 31 | (acc + x * p2 & mask) >> 33) & mask
    letters = b"abcdefghijklmnopqrstuvwxyz"
    lanes = [(42 + p1 + p2) & mask, (42 + p2) & mask, 42, (42 - p1) & mask]
    one, two = [b"", b""], [b"", b""]
    for lane in lanes:
        while True:
            a, b, c = (bytes(rng.choices(letters, k=8)) for _ in range(3))
            after = [step(lane, int.from_bytes(x, "little")) * p1 & mask for x in (a, b)]
            d = (int.from_bytes(c, "little") + (after[0] - after[1]) * pow(p2, -1, 1 << 64)) & mask
            d = d.to_bytes(8, "little")
            if a != b and all(33 <= x < 127 for x in d):
                break
        one, two = [one[0] + a, one[1] + c], [two[0] + b, two[1] + d]
    return b"".join(one).decode(), b"".join(two).decode()


def test_texts_with_one_hash_are_two_texts(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    a, b = colliding(random.Random(4))
    docs = spark.createDataFrame([(1, a), (2, b), (3, "a third text of a few more words")], "doc_id long, text string")
    assert docs.select(F.xxhash64("text").alias("h")).distinct().count() == 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 2, 3]


def test_further_columns_may_be_maps(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one text", {"a": 1}), (1, "one text", {"b": 2}), (2, "one text", None)], "doc_id long, text string, m map<string,int>")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]


def close_copies(n, rng):
    words = np.repeat(rng.integers(-(2**63), 2**63 - 1, (1, near_copies.LOOKED_AT)), n, 0)
    for row in words[1:]:
        for at in rng.choice(64 * near_copies.LOOKED_AT, 15, replace=False):
            row[at // 64] ^= np.int64(np.uint64(1 << int(at % 64)).view(np.int64))
    return words.view(np.uint64)


def test_a_large_group_costs_a_few_comparisons_a_row():
    import time

    rng = np.random.default_rng(6)
    took = {}
    for n in (4_000, 16_000):
        words = close_copies(n, rng)
        key, own = np.zeros(n, np.int64), np.arange(n)
        start = time.process_time()
        x, y = near_copies._nearest(key, words, own, 47, lambda a, b: a != b)
        took[n] = time.process_time() - start
        assert len(x) == n - 1 and set(y.tolist()) == {0} and set(x.tolist()) == set(range(1, n))
    assert took[16_000] < 5


def test_nearest_of_large_and_small_groups():
    """Two large groups, a small one and single rows under two keys: each row of a group meets its own group only."""
    rng = np.random.default_rng(7)
    groups = [close_copies(n, rng) for n in (900, 700, 40, 1, 1)]
    words = np.concatenate([*groups, *groups])
    of = np.concatenate([np.full(len(g), k) for k, g in enumerate(groups)] * 2)
    key = np.repeat([3, 5], len(words) // 2)
    order = np.lexsort((words[:, 0], key))
    words, of, key = words[order], of[order], key[order]
    own = np.arange(len(key))
    x, y = near_copies._nearest(key, words, own, 47, lambda a, b: a != b)
    assert (of[x] == of[y]).all() and (key[x] == key[y]).all()
    met = set(x.tolist()) | set(y.tolist())
    assert met <= set(own[of < 3].tolist()) and len(met) > 0.97 * (of < 3).sum()  # the last round finds the others
    root = np.where(of == 0, -1, own)  # one group is united: it asks nothing
    asks = own[of != 0]
    x, y = near_copies._nearest(key, words, asks, 47, lambda a, b: root[a] != root[b])
    assert (of[x] == of[y]).all() and set(x.tolist()) <= set(asks.tolist())


def test_pairs_that_a_third_text_rules_out_are_not_similar():
    """Never a pair that is similar enough; most of the copies that were edited apart."""
    rng = np.random.default_rng(9)
    core = np.unique(rng.integers(0, 1 << 62, 150, dtype=np.uint64))
    sets = []
    for _ in range(120):
        kept = rng.random(len(core)) > rng.uniform(0, 0.3)
        shared = rng.choice(np.arange(1 << 40, (1 << 40) + 60, dtype=np.uint64), rng.integers(0, 9), replace=False)
        sets.append(np.unique(np.concatenate([core[kept], rng.integers(0, 1 << 62, rng.integers(0, 25), dtype=np.uint64), shared])))
    found = [near_copies._compared(x, core, 0.8) for x in sets]
    g = {"size": np.array([len(x) for x in sets]), "anchor": np.r_[np.zeros(110, np.int64), np.ones(10, np.int64)], "more": np.array([f[1] for f in found]), "less": np.array([f[2] for f in found])}
    g |= {f"m{k}": np.array([np.frombuffer(f[3], np.int64)[k] for f in found]) for k in range(near_copies.MARKS)}
    x, y = np.triu_indices(120, 1)
    out = near_copies._too_far(g, x, y, 0.8)
    similar = np.array([near_copies.similarity(sets[i], sets[j]) >= 0.8 for i, j in zip(x, y)])
    assert similar.sum() > 50 and not (out & similar).any() and not out[(g["anchor"][x] != g["anchor"][y])].any()
    assert out.sum() > 0.6 * (~similar & (g["anchor"][x] == g["anchor"][y])).sum()


def test_anchors_are_the_texts_that_most_were_compared_with(spark):
    sets = {i: np.array(s, np.uint64) for i, s in enumerate([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 6], [1, 2, 7, 8], [1, 2, 7, 9]])}
    pairs = [(0, 1), (0, 2), (0, 3), (3, 4)]
    rows = [(a, b, *near_copies._compared(sets[a], sets[b], 0.5)) for a, b in pairs]
    tried = spark.createDataFrame(rows, "a bigint, b bigint, same boolean, only_a bigint, only_b bigint, marks_a binary, marks_b binary")
    got = {r.id: r for r in near_copies._anchors(tried).collect()}
    assert {i: r.anchor for i, r in got.items()} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 3}
    assert (got[2].more, got[2].less, got[3].more) == (1, 1, 2)
    marks = near_copies._marks(np.array([6], np.uint64)).view(np.int64).tolist()
    assert [got[2][f"m{k}"] for k in range(near_copies.MARKS)] == marks


@pytest.mark.parametrize("filter_bytes", [1 << 20, 0])
def test_rows_that_go_are_found_with_and_without_a_filter(spark, filter_bytes):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 70}", {"k": i}) for i in range(200)] + [(None, "text 3", None), (7, "text 7", {}), (500, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").repartition(4)
    said = docs.groupBy(F.col("doc_id").alias("_id"), near_copies.text_digest().alias("_digest")).agg(F.count("*").alias("n"))
    said = said.withColumn("stays", F.coalesce(F.col("_id") < 70, F.lit(False)) | (F.col("_id") == 500)).where("NOT coalesce(stays, false) OR n > 1")
    said = said.withColumn("stays", F.coalesce("stays", F.lit(False)))
    got = near_copies.decided(docs, said, filter_bytes=filter_bytes)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(i, f"text {i}") for i in range(70)] and got.count() == 71


def test_short_texts_at_the_least_similarity_are_linked(spark):
    """Four shingles of five: fingerprints of so few differ in more bits than those of long texts."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(8)]
        texts += [" ".join(words), " ".join([*words, "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_prefixes_lose_no_pair(spark):
    """Sets of all sizes, with frequent members and without, some in known components: the pairs of brute force."""
    rng = np.random.default_rng(13)
    common, sets = rng.integers(1, 1 << 62, 30, dtype=np.uint64), [np.zeros(0, np.uint64)] * 2
    for n in (1, 2, 4, 5, 9, 10, 25, 60) * 6:
        base = np.concatenate([rng.integers(1, 1 << 62, n, dtype=np.uint64), rng.choice(common, min(n, int(rng.integers(0, 30))), replace=False)])
        for _ in range(4):
            kept = base[rng.random(len(base)) > rng.uniform(0, 0.2)]
            sets.append(np.unique(np.concatenate([kept, rng.integers(1, 1 << 62, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)])))
    roots = [i // 3 * 3 if i % 5 == 0 else i for i in range(len(sets))]
    similar = lambda i, j: near_copies.similarity(sets[i], sets[j]) >= 0.8
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if roots[i] != roots[j] and similar(i, j)}
    for frequent in ((np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.sort(common), np.arange(30) // 7)):
        rows = [(i, roots[i], len(x), bytearray(near_copies._prefix(x, frequent, 0.8).tobytes())) for i, x in enumerate(sets)]
        made = spark.createDataFrame(rows, "id bigint, root bigint, size bigint, prefix binary")
        got = [tuple(r) for r in near_copies._meeting(made, 0.8).collect()]
        assert len(want) > 100 and want <= set(got) and len(got) == len(set(got)) < len(sets) ** 2 / 20
        assert all(roots[i] != roots[j] for i, j in got)


def test_long_texts_with_a_common_passage_make_no_pairs(spark, monkeypatch, tmp_path):
    """They share shingles that no sample shows, and are not similar; edited copies are, in known components and outside."""
    from pyspark.sql import functions as F

    rng, made, meeting = random.Random(17), [], near_copies._meeting
    monkeypatch.setattr(near_copies, "OFTEN", 1000)
    monkeypatch.setattr(near_copies, "_meeting", lambda rows, least: made.append(meeting(rows, least)) or made[-1])
    passage, bodies = [f"p{k}" for k in range(40)], []
    for i in range(60):
        words = [f"w{rng.randrange(10**7)}" for _ in range(300)]
        words = words[:100] + passage + words[100:]
        bodies += [words, edited(words, rng, 5)] if i % 10 == 0 else [words]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bodies)], "id long, text string")
    texts = docs.select(near_copies.text_digest().alias("digest"), "text")
    marked = docs.select(near_copies.text_digest().alias("digest"), "id")
    pairs = [(i, i + 1) for i, w in enumerate(bodies[1:]) if len(set(w) & set(bodies[i])) > 200]
    got = near_copies._by_prefixes(texts, marked, None, docs.count(), 0.8, f"file://{tmp_path}/a")
    assert sorted(tuple(r) for r in got.collect()) == pairs and len(pairs) == 6
    known = docs.where(F.col("id") == 0).select(F.lit(pairs[0][0]).cast("long").alias("a"), F.lit(pairs[0][1]).cast("long").alias("b"), F.lit(True).alias("same"))
    got = near_copies._by_prefixes(texts, marked, known, docs.count(), 0.8, f"file://{tmp_path}/b")
    assert sorted(tuple(r) for r in got.collect()) == pairs[1:]
    assert [m.count() for m in made] == [6, 5]  # of 2,145
