"""The corpus queries, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import collisions, conversations, decontaminate, extract, quality, repeats, secrets, simhash, token_files, tokenize, toxicity, warc, whitening
from cairnflow.llm.common import scratch, table, written

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
starts AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
phrases AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM starts),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM phrases)),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM places),
hits AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM grams g JOIN phrases p ON g.k = p.k AND g.p = p.p),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits),
covered AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
pairs AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM pairs GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.round_trip(table(spark, sf_dir, "documents"), WORD_BPE).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.fold() == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.read_packages(manifest, payload=False).drop("url")


_FIVE_BITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))
ORACLES["op6_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
five AS (SELECT *, [('0x' || substr(h, 5 * i + 1, 5))::INTEGER FOR i IN range(0, 8)] AS parts FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string([{_FIVE_BITS} FOR v IN parts], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM five
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (quality.fold() == quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op8_embeddings"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, label,
           label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0 AS sound
    FROM embeddings),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.sound AND b.sound AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
    SELECT vec_id AS x, vec_id AS y FROM v
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.x = vec_id LEFT JOIN counted ON counted.x = vec_id
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.transform(vectors, whitening.fit(vectors))


@query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_repeats"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM d),
hashed AS (SELECT doc_id, i, md5(b[i + 1:i + 100]) AS m FROM windows),
again AS (SELECT doc_id, i FROM hashed QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM again),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
ends AS (SELECT doc_id, max(z) AS a, count(*) AS n_spans, sum(z - a) AS n_removed FROM spans GROUP BY doc_id),
pieces AS (SELECT doc_id, a, z FROM gaps UNION ALL SELECT d.doc_id, coalesce(e.a, 0), octet_length(b) FROM d LEFT JOIN ends e USING (doc_id)),
kept AS (SELECT doc_id, string_agg(hex(b[p.a + 1:p.z]), '' ORDER BY p.a, p.z) AS digits FROM pieces p JOIN d USING (doc_id) WHERE p.z > p.a GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(unhex(digits), ''::BLOB)) AS kept_sha256
FROM d LEFT JOIN ends USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = written(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))), scratch(spark, "repaired"))
    whole = parts.where("part = 0").select("conv", *conversations.COUNTS, "audit")
    hashed = conversations.digests(parts).withColumnRenamed("conv", "c")
    both = whole.join(hashed, F.col("conv").eqNullSafe(F.col("c")))
    return both.select(F.col("conv").alias("conv_id"), *conversations.COUNTS, "audit", "repaired_sha256")


def _step(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """SQL: a state after one more edit; line: what the edit adds to the repaired text."""
    text = f"{state}.r" if line is None else f"{state}.r || chr(10) || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {text}}} END"


_KEPT, _CLIP = "role || ':' || text", "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)"
_GOES, _BEGIN = "fault IN ('blank', 'duplicate')", "substr(role, 1, 1)"
_MADE = "'user:' || text", "'assistant:' || text"
_WHITE = r"[\x20\x09-\x0D]"
ORACLES["op13_conversations"] = f"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT *, flatten([[ord(substr(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, len(k) + 1)]) AS steps FROM named),
drawn AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(steps, lambda x: x::BIGINT),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS f FROM bits),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (SELECT *, lag({_BEGIN}) OVER (PARTITION BY conv_id ORDER BY i) || {_BEGIN} AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?]{_WHITE}*\\z') THEN 'truncated' END AS fault FROM placed),
walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s1,
           {{'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM conversations
    UNION ALL
    SELECT conv_id, i, s0, s1, least(u2, {_step("a1", "3", "I", "'user:'")}), a1 FROM (
        SELECT *, least(a, {_step("u2", "3", "I", "'assistant:'")}) AS a1 FROM (
            SELECT *, least(u, {_step("s0", "3", "I", "'user:'")}, {_step("s1", "3", "I", "'user:'")}, {_step("a", "3", "I", "'user:'")}) AS u2 FROM (
                SELECT w.conv_id, j.i, {_step("w.s0", "4", "D")} AS s0,
                       least({_step("w.s1", "4", "D")}, CASE WHEN NOT coalesce({_GOES}, false) AND {_BEGIN} = 's' THEN {_step("w.s0", _CLIP, "K", _KEPT)} END) AS s1,
                       least({_step("w.s2", "4", "D")},
                             {", ".join(f"CASE WHEN NOT coalesce({_GOES}, false) THEN {_step(s, '3 + ' + _CLIP, 'R', _MADE[0])} END, CASE WHEN NOT coalesce({_GOES}, false) AND {_BEGIN} = 'u' THEN {_step(s, _CLIP, 'K', _KEPT)} END" for s in ("w.s0", "w.s1", "w.s3"))}) AS u,
                       least({_step("w.s3", "4", "D")}, CASE WHEN NOT coalesce({_GOES}, false) THEN {_step("w.s2", "3 + " + _CLIP, "R", _MADE[1])} END,
                             CASE WHEN NOT coalesce({_GOES}, false) AND {_BEGIN} = 'a' THEN {_step("w.s2", _CLIP, "K", _KEPT)} END) AS a
                FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)))),
ends AS (SELECT conv_id, CASE WHEN s0 <= s3 THEN s0 ELSE s3 END AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
