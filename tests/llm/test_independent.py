"""Second, plain versions of what has no SQL: the base scan of secrets, toxicity features, the convolutional forward pass;
and long inputs, which must take linear time."""

import math
import random
import re
import string
import time

import numpy as np
import pytest

from cairnflow.llm import secrets, toxicity
from cairnflow.llm.convnet import BLOCK, CHUNK, HOP, STRIDE, WIDTH, ConvNet, echoes
from cairnflow.llm.toxicity import Featurizer, Lexicon

KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = frozenset(string.ascii_letters + string.digits + "+/_.=-")


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def base_by_hand(text):
    """The contract's three kinds, read character by character."""
    found, low = [], fold(text)
    at = 0
    while at < len(text):
        for word in KEYWORDS:
            if low.startswith(word, at):
                i = at + len(word)
                i += i < len(text) and text[i] in "\"'"
                while i < len(text) and text[i] == " ":
                    i += 1
                if i < len(text) and text[i] in ":=":
                    i += 1
                    while i < len(text) and text[i] == " ":
                        i += 1
                    i += i < len(text) and text[i] in "\"'"
                    j = i
                    while j < len(text) and text[j] in VALUE:
                        j += 1
                    if j > i:
                        if j - i >= 12:
                            found.append((at, 0, j))
                        at = j - 1
                        break
        at += 1
    for kind, start, letters, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 18), (2, "", "0123456789abcdef", 16)):
        at = 0
        while at < len(text):
            j = at + len(start)
            if not text.startswith(start, at):
                at += 1
                continue
            while j < len(text) and text[j] in letters:
                j += 1
            if j > at + len(start):
                if j - at >= least:
                    found.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(found)


def test_base_scan_equals_plain_version():
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIA", "ABCDEFGHIJKLMN12", "deadbeef", "0123456789abcdef",
             "x" * 12, "y.z/_-=", "é", "\n", "ſecret", "a", "F0", "passwd"]
    scanner = secrets.Scanner()
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert scanner.base(text) == base_by_hand(text), text


def test_random_keys_are_found_and_names_are_not():
    rng, scanner = random.Random(4), secrets.Scanner()
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for letters, n, least in ((string.ascii_letters + string.digits, 24, 0.98), (string.ascii_letters + string.digits + "+/", 40, 0.98)):
        found = sum(any(k == 3 for _, k, _ in scanner.scan(f"see {key(letters, n)} there")) for _ in range(2000))
        assert found / 2000 >= least
    one, two = key(string.ascii_letters, 10) + "3fK9x" + key(string.ascii_letters, 9), "Zx81mQpL03vTyWn7cKe5RbUa"
    assert len([x for x in scanner.scan(f"{two}/example/{two[::-1]} {one}") if x[1] == 3]) >= 2
    plain = ["/usr/lib/python3/dist-packages/Mixed12Case/module_name", "internationalization", "getElementsByClassNameFromTree", "some-page-about-very-long-words-2024",
             "123e4567-e89b-12d3-a456-426614174000", "2024-01-20T00:00:00Z/2024-01-21T00:00:00Z", "https://example.org/en/articles/how-to-write-clean-text", "=" * 60, "_" * 30 + "x"]
    assert [x for t in plain for x in scanner.scan(t)] == []


NAMES = (
    "get set user account by id and region handler create update delete request response manager service factory builder controller abstract default internal "
    "transform plugin module common babel react native android python dist packages site lib local config network socket stream buffer parser token syntax tree "
    "node graph matrix vector layer model train test score metric logger format filter worker thread queue stack heap cache memory file folder path archive "
    "compress encode decode encrypt sign verify public key session cookie header footer html script style image video shader mesh camera render export import"
).split()


def harmless(kind, rng):
    """A generated name of a kind, longer than a window."""
    some = lambda n: rng.choices(NAMES, k=n)
    short = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(1, 7)))
    if kind == "camel":
        first, *rest = some(rng.randrange(4, 8))
        return first + "".join(w.capitalize() for w in rest) + rng.choice(["", "V2", "2", "Impl"])
    if kind == "path":
        parts = (rng.choice(["-", "_", ""]).join(some(rng.randrange(1, 4))) + rng.choice(["", "3", "2011", "-es2015", "_v12"]) for _ in range(rng.randrange(3, 7)))
        return rng.choice(["/usr/lib/", "./src/", "node_modules/@babel/", ""]) + "/".join(parts) + rng.choice([".py", ""])
    if kind == "url":
        parts = (rng.choice([short(), str(rng.randrange(10**6)), "-".join(some(4)), some(1)[0]]) for _ in range(rng.randrange(3, 8)))
        return f"https://{some(1)[0]}.example.com/" + "/".join(parts)
    return "-".join(some(rng.randrange(4, 9))) + rng.choice(["", "-2023-11-05", "-20240117"]) if kind == "slug" else "_".join(some(rng.randrange(3, 7))).upper()


@pytest.mark.parametrize("kind", ["camel", "path", "url", "slug", "constant"])
def test_names_are_no_secrets(kind):
    rng, scanner = random.Random(kind), secrets.Scanner()
    found = sum(bool(scanner.scan(f"see {harmless(kind, rng)} here")) for _ in range(10_000))
    assert found < 50  # under half a percent


@pytest.mark.parametrize("letters, n", [
    (string.ascii_letters + string.digits, 24), (string.ascii_lowercase + string.digits, 24), (string.ascii_letters, 24), (string.ascii_lowercase, 32),
    (string.ascii_letters + string.digits + "+/", 40), (string.ascii_letters + string.digits + "-_", 43), (string.ascii_uppercase + string.digits, 32),
])
def test_keys_of_all_kinds_are_found(letters, n):
    rng, scanner = random.Random(n + len(letters)), secrets.Scanner()
    found = sum(any(k == 3 for _, k, _ in scanner.scan("x = '" + "".join(rng.choices(letters, k=n)) + "';")) for _ in range(2000))
    assert found / 2000 >= 0.94


def test_running_counts_of_odd_pairs_equal_direct_ones():
    rng = random.Random(12)
    for _ in range(300):
        s = "".join(rng.choices(string.ascii_letters + string.digits + "/-_", k=rng.randrange(1, 60)))
        can, odd = secrets.odd_pairs(s)
        assert len(can) == len(odd) == len(s)
        for i in range(len(s) - 1):
            a, b = s[i : i + 2]
            word = 1
            while word <= i and s[i - word].isalpha() and not (s[i - word].islower() and s[i - word + 1].isupper()):
                word += 1
            if a.isalpha() and b.isalpha():
                want = (word < 4,) * 2 if a.islower() and b.isupper() else (True, not secrets.word_pair((a + b).lower()))
            else:
                want = ({a.isalpha(), b.isalpha()} == {True, False} and {a.isdigit(), b.isdigit()} == {True, False},) * 2
            assert (can[i + 1] - can[i], odd[i + 1] - odd[i]) == want


def test_features_equal_plain_version():
    """Counted by another way: regular expressions and nested loops over the tokens."""
    lexicon = Lexicon({"vileword": 7}, {"nast": 3})
    featurizer = Featurizer(lexicon)
    rng = random.Random(5)
    words = ["you", "plain", "vileword", "VILEWORD!!", "nastiness", "v1lew0rd", "n-a-s-t", "YOUR", "sooo", "what?", "(nasty)", "a", "—", "tú", "", "x1"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))
        tokens = text.split()
        got = dict(zip(toxicity.FEATURES, featurizer.features(text), strict=True))
        core = [re.sub(r"^\W+|\W+$", "", t) for t in tokens]
        plain = ["".join(c for c in t.lower().translate(toxicity.DISGUISE) if c.isalpha()) for t in tokens]
        word = [c.lower() == "vileword" for c in core]
        stem = [c.lower().startswith("nast") for c in core]
        odd = [bool(re.search(r"[^\W\d_]", c)) and (bool(re.search(r"[^\w'’-]|[\d_]", c)) or bool(re.fullmatch(r"(?:[^\W\d_][.\-*_]){2,}[^\W\d_]", c))) for c in core]
        hidden = [o and not w and not s and (p == "vileword" or p.startswith("nast")) for o, w, s, p in zip(odd, word, stem, plain, strict=True)]
        hit = [w or s or h for w, s, h in zip(word, stem, hidden, strict=True)]
        you = [c.lower() in toxicity.SECOND_PERSON for c in core]
        n, at = max(1, len(tokens)), [i for i, h in enumerate(hit) if h]
        gaps = [min(abs(i - j) for j, y in enumerate(you) if y) for i in at] if any(you) else []
        want = {
            "log_words": math.log1p(len(tokens)), "word_hits": sum(word), "stem_hits": sum(stem), "disguised_hits": sum(hidden), "hit_density": sum(hit) / n,
            "you_density": sum(you) / n, "hits_near_you": sum(g <= toxicity.NEAR for g in gaps) / len(gaps) if gaps else 0.0, "nearest_you": min(gaps + [100]),
            "caps_words": sum(len(c) > 1 and c.isupper() for c in core) / n, "disguised_words": sum(odd) / n,
            "most_in_stretch": max((sum(hit[i : i + toxicity.STRETCH]) for i in range(len(hit))), default=0),
            "stretched_words": sum(bool(re.search(r"(.)\1\1", c.lower())) for c in core) / n, "exclamations": text.count("!") / max(1, len(text)),
            "capital_letters": sum(c.isupper() for c in text) / max(1, len(text)),
        }
        for k, v in want.items():
            assert got[k] == pytest.approx(v), (k, text)


def test_forward_pass_equals_plain_version():
    """The network by loops over frames, chunks and filters."""
    net, rng = ConvNet(filters=5, dims=3, hidden=4), np.random.default_rng(1)
    for size in (0, 1, 13, 400, 1500):
        data = rng.integers(97, 123, size).astype(np.uint8)
        echo, frames = echoes(data), max(1, -(-size // STRIDE))
        h = np.zeros((frames, 5))
        for f in range(frames):
            x = [v for i in range(f * STRIDE, f * STRIDE + WIDTH) for v in ([*net.w["embed"][data[i]], echo[i]] if i < size else [0.0] * 4)]
            h[f] = np.maximum(np.array(x) @ net.w["conv"] + net.w["conv_b"], 0)
        blocks, chunks, start = -(-frames // BLOCK), [], 0
        while True:
            chunks.append(h[start * BLOCK : (start + CHUNK) * BLOCK].max(0))
            start += HOP
            if start >= blocks - CHUNK + HOP:
                break
        pooled = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])
        raw = np.maximum(pooled @ net.w["dense"] + net.w["dense_b"], 0) @ net.w["out"] + net.w["out_b"]
        assert net.scores([data.tobytes()])[0] == pytest.approx(1 / (1 + math.exp(-raw[0])), rel=1e-4)


@pytest.mark.parametrize("text", ["a" + "-" * 1_000_000 + "a", "-" * 1_000_000, "a." * 500_000, "you " * 250_000], ids=["ruler", "dashes", "dots", "words"])
def test_toxicity_of_long_tokens_takes_linear_time(text):
    began = time.process_time()
    Featurizer(Lexicon({"vile": 3}, {})).features(text)
    assert time.process_time() - began < 10


@pytest.mark.parametrize(
    "text",
    ["deadbeefdeadbeef " * 50_000 + "Zx81mQpL03vTyWn7cKe5RbUa " * 20_000, "example" * 100_000, "Zx81mQpL03vTyWn7cKe5RbUa" * 20_000, "password " * 100_000, "token=" * 100_000],
    ids=["many", "allowed", "long", "words", "assigned"],
)
def test_secrets_of_long_texts_take_linear_time(text):
    began = time.process_time()
    secrets.Scanner().scan(text)
    assert time.process_time() - began < 20


def test_repeated_documents_do_not_widen_the_fit(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(200)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", "doc_id", "text", lambda k: toxicity.fold(k) >= 0, 1000).collect()
    assert sorted(r.key for r in rows) == list(range(10))
