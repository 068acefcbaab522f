"""The pipeline against a plain version of its stages, and the queries against their SQL."""

import hashlib
import os
import re

import pytest

from cairnflow.llm import decontaminate, near_copies, queries, secrets, toxicity
from cairnflow.llm.bpe import decoder, encoder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_equals_plain_version(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    scores = model.scores([t for _, t in rows], toxicity.Featurizer(model.lexicon))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    kept: list[tuple[int, str]] = []
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= near_copies.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = [r for i, r in enumerate(rows) if group[i] == i]
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text)
        k = min(10, len(w))
        phrases |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if w}
    scanner, enc, dec = secrets.Scanner(), encoder(queries.WORD_BPE), decoder(queries.WORD_BPE)
    want = set()
    for i, t in kept:
        at = [(m.start(), m.end()) for m in decontaminate.WORD.finditer(t)]
        w = decontaminate.words_of(t)
        hit = set()
        for k in {len(p) for p in phrases}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in phrases:
                    hit |= set(range(a, a + k))
        cut = [(at[a][0], at[b][1]) for a, b in runs(sorted(hit))]
        for a, b in reversed(cut):
            t = t[:a] + t[b:]
        spans = decontaminate.merged([(a, b) for a, _, b in scanner.scan(t)])
        joined = "".join("[REDACTED]" if k % 2 else x for k, x in enumerate(pieces(t, scanner)))
        assert bool(spans) == ("[REDACTED]" in joined and joined != t)
        ids = enc.encode(joined)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((i, len(ids), digest(" ".join(map(str, ids))), digest(dec.decode(ids))))
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0 < len(got) < docs.count()


def runs(places):
    out = []
    for p in places:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


def pieces(text, scanner):
    """Text outside and inside of secrets, in turns; a secret that begins inside another one belongs to it."""
    out, at = [""], 0
    for a, _, b in scanner.scan(text):
        if a >= at:
            out[-1] += text[at:a]
            out += ["", ""]
        at = max(at, b)
    out[-1] += text[at:]
    return out


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
