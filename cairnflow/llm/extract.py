"""Main text of web pages by equivalence classes of template tokens.

Template tokens are start tags, told apart by the structural elements around them. The occurrence vector of a token
holds its number of occurrences in every page of a host. Tokens with equal vectors form an equivalence class; a vector
is compared by its fingerprint, sums over pages of a hash of page and number, so that it is an ordinary aggregate:
a host of any number of pages is spread over tasks and nothing is collected for it. Classes that occur in half of the
host's pages are nested to its template, each into slots of those before it. The slots are what the template leaves open.

What a slot holds decides what it is. Its prose is its text that is not in links, times the variation of that text from
page to page: menus and notices have little. From the root the template follows the element that holds nearly all of
the prose, and where it leads no further is the main element. Inside it, slots of links and of unchanging text are left
out. Where several elements hold prose that varies from page to page, as an article and the comments on it do, an element
that is an article by its own word wins, whatever its share; elements that call themselves something else (an advert,
comments, a form) don't count, nor do lists that come after it: equal siblings whose inner tokens are in their own
equivalence class, so that each item has a name, a date and a text, say. Both are left out inside the main element too,
if there is other prose in it.

A slot's figures are pooled with those of the same slot in all hosts at the weight of PRIOR pages, so that a host of
one page is judged like any other, and the more pages a host has the more they count; no number of pages is a switch.
What is in no template lies in the slot around it (see narrowed). A page on which its host's template finds no text is judged by
itself, in the same way.

Defined results: null and empty html give an empty text, and so do pages of links only; null urls and urls without a
host share one group; repeated rows give repeated results; an empty table gives an empty table; further columns are
not read.
"""

from __future__ import annotations

import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import map_batches, scratch, written
from cairnflow.llm.html_tokens import ARTICLE, ASIDE, HIDDEN, Page

SUPPORT = 0.5
"""Share of a host's pages in which the tokens of its template occur."""
PRIOR = 2.0
"""Pages that the figures of all hosts count as."""
HELD = 0.8
"""Share of the prose that the element on the way to the main element holds."""
LEAST = 0.05
"""Share of the prose from which an element can be the article, whatever is around it."""
LINK_SHARE = 0.5
STEADY = 0.5
"""Variation, relative to the host's most varied slot, below which a slot's text is the template's."""
BROADCAST_BYTES = 8 << 20
"""Templates over this size in all are joined by host instead of being broadcast."""


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


_COUNTS = ("token", "parent", "kind", "slot", "n", "place", "chars", "linked", "text", "like")
_SIGN = 1 << 63


def _signed(token: int) -> int:
    return token - (1 << 64) if token >= _SIGN else token


def page_tokens(page: Page) -> list[tuple]:
    """Rows of _COUNTS: the structural elements, which are slots, and the other start tags in them. Characters are all
    that an element holds; text is the CRC of what it holds directly, or else further in."""
    es = page.elements
    chars, linked, inner = [e.chars for e in es], [e.linked for e in es], [e.text for e in es]
    for i in range(len(es) - 1, 0, -1):
        if es[i].kind != HIDDEN:
            chars[es[i].parent] += chars[i]
            linked[es[i].parent] += linked[i]
            inner[es[i].parent] ^= inner[i]
    rows = [
        (_signed(e.token), _signed(es[e.parent].token), e.kind, True, e.n, e.place, chars[i], linked[i], e.text or inner[i], _signed(e.like))
        for i, e in enumerate(es)
    ]
    rows += [(_signed(t), _signed(es[p].token), 0, False, n, at, 0, 0, 0, 0) for t, (n, p, at) in page.others.items()]
    return rows


def tokens(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """A row for each page and token."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            hosts, ids, rows = [], [], []
            for h, p, text in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                found = page_tokens(Page(text or ""))
                hosts += [h] * len(found)
                ids += [p] * len(found)
                rows += found
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), *columns], ["host", "page", *_COUNTS])

    narrow = pages.select(host(F.col(url)).alias("host"), F.xxhash64(key, url).alias("page"), F.col(html).cast("string").alias("html"))
    return map_batches(
        narrow, run,
        "host string, page bigint, token bigint, parent bigint, kind int, slot boolean, n bigint, place bigint, chars bigint, linked bigint, text bigint, like bigint",
    )


def host_tokens(found: DataFrame) -> DataFrame:
    """What is known of each token of a host, with the fingerprint of its occurrence vector in two halves."""
    v = F.xxhash64("page", "n")
    return found.groupBy("host", "token").agg(
        F.sum(v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("low"),
        F.sum(F.shiftrightunsigned(v, 32)).alias("high"),
        F.count("*").alias("pages"),
        F.avg("place").alias("place"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.approx_count_distinct("text", 0.1).alias("texts"),
        F.min("parent").alias("parent"),
        F.min("kind").alias("kind"),
        F.max("slot").alias("slot"),
        F.min("like").alias("like"),
    )


def frequent_tokens(own: DataFrame) -> DataFrame:
    """host, tokens: those of at least SUPPORT of a host's pages, with the figures of all hosts beside their own.

    They are at most 1 / SUPPORT times a page's tokens, so a host's are bounded by its pages' size, not their number."""
    every = own.groupBy("token").agg(
        F.sum("pages").alias("all_pages"), F.sum("chars").alias("all_chars"), F.sum("linked").alias("all_linked"), F.sum("texts").alias("all_texts")
    )
    size = own.where("token = 0").select("host", F.col("pages").alias("of"))  # every page has one root
    frequent = own.join(size, "host").where(F.col("pages") >= F.ceil(SUPPORT * F.col("of"))).join(every, "token")
    row = F.struct(
        "token", "parent", "kind", "slot", "like", "low", "high", "pages", "place", "chars", "linked", "texts",
        "all_pages", "all_chars", "all_linked", "all_texts",
    )
    return frequent.groupBy("host").agg(F.collect_list(F.to_json(row)).alias("tokens"))


def nested(rows: list[dict]) -> dict[int, dict]:
    """The template: classes of tokens with equal vectors, nested one into another.

    The class of the root comes first. Another class is valid if each of its tokens lies in a slot of the template so
    far, or of a token of its own class; the rest is noise and left out."""
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in sorted(rows, key=lambda t: (t["place"], t["token"])):
        classes[t["low"], t["high"]].append(t)
    template: dict[int, dict] = {}
    for c in sorted(classes.values(), key=lambda c: (c[0]["place"], -len(c))):
        own = {t["token"] for t in c}
        if not template or all(t["parent"] in template or t["parent"] in own for t in c):
            template |= {t["token"]: t for t in c}
    return template


def judged(rows: list[dict]) -> dict[int, bool]:
    """Slot to whether its text is main text."""
    template = nested(rows)
    slots = {k: t for k, t in template.items() if t["slot"]}
    if not slots:
        return {}
    children: dict[int, list[int]] = defaultdict(list)
    for k, t in slots.items():
        if k:
            children[t["parent"]].append(k)
    order, at = [0] if 0 in slots else [], 0
    while at < len(order):
        order += children[order[at]]
        at += 1
    chars, linked, vary = {}, {}, {}
    for k in order:
        t = slots[k]
        of = max(1, t["all_pages"])
        chars[k] = t["chars"] + PRIOR * t["all_chars"] / of
        linked[k] = t["linked"] + PRIOR * t["all_linked"] / of
    for k in order:  # what the slots further in don't hold
        inner = [c for c in children[k] if slots[c]["kind"] != HIDDEN]
        chars[k] = max(0.0, chars[k] - sum(chars[c] for c in inner))
        linked[k] = max(0.0, linked[k] - sum(linked[c] for c in inner))
    for k in order:
        t = slots[k]
        of = max(1, t["all_pages"])
        all_vary = min(1.0, t["all_texts"] / of)
        vary[k] = (min(t["texts"], t["pages"]) - 1 + PRIOR * all_vary) / (t["pages"] - 1 + PRIOR)
    most = max((vary[k] for k in order if chars[k] > linked[k] and slots[k]["kind"] != HIDDEN), default=1.0) or 1.0
    mass = {k: 0.0 if slots[k]["kind"] == HIDDEN else max(0.0, chars[k] - linked[k]) * vary[k] / most for k in order}
    for k in reversed(order[1:]):
        if slots[k]["kind"] != HIDDEN:
            mass[slots[k]["parent"]] += mass[k]
    lists = _lists(template, slots, children)
    listed = {k: sum(mass[c] for c in children[k] if c in lists) for k in order}
    aside = lambda k: slots[k]["kind"] == ASIDE
    varied = lambda k: vary[k] >= STEADY * most or any(varied(c) for c in children[k])
    chain = [0]
    while children[chain[-1]]:
        here = chain[-1]
        some = [k for k in children[here] if mass[k] > 0 and mass[k] >= LEAST * mass[here]]
        # What calls itself something else, and lists that follow, don't stand in the way of prose that varies as they do.
        own = [k for k in some if not aside(k) and varied(k) and slots[k]["kind"] != HIDDEN]
        prose = [k for k in own if slots[k]["kind"] == ARTICLE]
        prose = prose or [k for k in own if not _list_like(k, listed, mass)]
        best = max(prose or own or children[here], key=lambda k: (mass[k], -slots[k]["place"]))
        rivals = mass[here]
        if best in own:
            rivals -= sum(mass[k] for k in children[here] if aside(k))
            rivals -= sum(mass[k] for k in own if _list_like(k, listed, mass) and slots[k]["place"] > slots[best]["place"])
        if mass[best] <= 0 or (slots[best]["kind"] != ARTICLE or best not in own) and mass[best] < HELD * rivals:
            break
        chain.append(best)
    main = next((k for k in chain if slots[k]["kind"] == ARTICLE), chain[-1])
    inside = {main}
    for k in order:
        if k not in inside and k and slots[k]["parent"] in inside:
            inside.add(k)
    outermost = [k for k in inside - {main} if slots[k]["parent"] == main or not aside(slots[k]["parent"])]
    beside = sum(mass[k] for k in outermost if aside(k) or k in lists and slots[k]["parent"] != main)
    enough = mass[main] - beside >= LEAST * mass[main]
    out: dict[int, bool] = {}
    for k in order:
        if k == main:
            out[k] = True
        elif not k or not out[slots[k]["parent"]]:
            out[k] = False
        else:
            minor = mass[k] < mass[main] / 2 or enough
            links = chars[k] > 0 and linked[k] > LINK_SHARE * chars[k]
            steady = chars[k] > 0 and vary[k] < STEADY * most
            gone = slots[k]["kind"] == HIDDEN or links or (mass[k] < mass[main] / 2 and steady) or (minor and aside(k))
            out[k] = not (gone or (enough and _list_like(k, listed, mass) and k != main and _follows(k, main, children, mass, slots, lists)))
    return out


def _lists(template: dict[int, dict], slots: dict[int, dict], children: dict[int, list[int]]) -> set[int]:
    """Slots that are items of a list, as readers' comments are: equal siblings, each with two other tokens in it, or more,
    that occur as often as the item in every page, by their equivalence class."""
    held: dict[int, int] = defaultdict(int)
    for t in template.values():
        up = template.get(t["parent"])
        if up is not None and up is not t and (t["low"], t["high"]) == (up["low"], up["high"]):
            held[t["parent"]] += 1
    out: set[int] = set()
    for inner in children.values():
        alike: dict[int, list[int]] = defaultdict(list)
        for k in inner:
            if slots[k]["kind"] != HIDDEN and held[k] >= 2:
                alike[slots[k]["like"]].append(k)
        for items in alike.values():
            if len(items) >= 2:
                out |= set(items)
    return out


def _list_like(k: int, listed: dict[int, float], mass: dict[int, float]) -> bool:
    return listed[k] > HELD * mass[k] > 0


def _follows(k: int, main: int, children: dict[int, list[int]], mass: dict[int, float], slots: dict[int, dict], lists: set[int]) -> bool:
    """Whether a list comes after prose of the main element."""
    before = mass[main] - sum(mass[c] for c in children[main])
    return before > LEAST * mass[main] or any(c not in lists and mass[c] >= LEAST * mass[main] and slots[c]["place"] < slots[k]["place"] and c != k for c in children[main])


def templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, template (JSON: slot to whether it is main text)."""
    own = written(host_tokens(tokens(pages, key, url, html)), scratch(pages.sparkSession, "tokens"))

    def run(batches):
        for b in batches:
            made = [json.dumps(judged([json.loads(t) for t in ts])) for ts in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(made, pa.string())], ["host", "template"])

    return map_batches(frequent_tokens(own), run, "host string, template string")


def by_itself(page: Page) -> dict[int, bool]:
    """The template of one page. One page shows no variation, so elements that call themselves something else are believed."""
    rows = []
    for token, parent, kind, slot, n, place, chars, linked, _, like in page_tokens(page):
        rows.append(
            {"token": token, "parent": parent, "kind": HIDDEN if kind == ASIDE else kind, "slot": slot, "like": like, "low": n, "high": 0, "pages": 1, "place": place, "chars": chars,
             "linked": linked, "texts": 1, "all_pages": 1, "all_chars": 0, "all_linked": 0, "all_texts": 1}
        )
    return judged(rows)


def narrowed(page: Page, keep: list[bool], template: dict[int, bool]) -> list[bool]:
    """Where the template leads to an element without text of its own and the page goes on with elements that are in no
    template, as when a host's pages share their frame only, the way to the main element goes on in the same manner."""
    es = page.elements
    mass = [max(0, e.chars - e.linked) if k else 0 for e, k in zip(es, keep, strict=True)]
    own = list(mass)
    inner: dict[int, list[int]] = defaultdict(list)
    for i in range(len(es) - 1, 0, -1):
        if keep[i] and keep[es[i].parent]:
            mass[es[i].parent] += mass[i]
            inner[es[i].parent].append(i)
    tops = [i for i, e in enumerate(es) if keep[i] and (not i or not keep[e.parent])]
    if not tops:
        return keep
    at = max(tops, key=lambda i: mass[i])
    chain = []
    while inner[at] and not own[at]:
        best = max(inner[at], key=lambda i: (mass[i], -i))
        known = _signed(es[best].token) in template  # the template has had its say: only if nothing else is lost
        if mass[best] <= 0 or mass[best] < (1.0 if known else LEAST if es[best].kind == ARTICLE else HELD) * mass[at]:
            break
        chain.append(at := best)
    if all(_signed(es[i].token) in template for i in chain):
        return keep
    main = next((i for i in chain if es[i].kind == ARTICLE), chain[-1])
    out: list[bool] = []
    for i, e in enumerate(es):
        out.append(i == main or (i > main and keep[i] and out[e.parent]))
    return out


def slot_text(page: Page, template: dict[int, bool]) -> str:
    """The text in the template's main slots, block by block."""
    keep: list[bool] = []
    for e in page.elements:
        known = template.get(_signed(e.token))
        keep.append(known if known is not None else bool(keep) and keep[e.parent] and e.kind not in (ASIDE, HIDDEN))
    keep = narrowed(page, keep, template)
    blocks, block = [], []
    for element, text in page.pieces:
        if element < 0:
            if block:
                blocks.append("".join(block))
                block = []
        elif keep[element]:
            block.append(text)
    blocks.append("".join(block))
    return "\n\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def main_text(html: str | None, template: dict[int, bool] | None = None) -> str:
    if not html:
        return ""
    page = Page(html)
    return (slot_text(page, template) if template else "") or slot_text(page, by_itself(page))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text."""
    spark = pages.sparkSession
    made = written(templates(pages, key, url, html), scratch(spark, "templates"))
    size = made.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host(F.col(url)).alias("host")
    )
    joined = rows.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, "host", "left").drop("host")

    def run(batches):
        cache: dict[str, dict] = {}
        for b in batches:
            out = []
            for h, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True):
                if t and t not in cache:
                    cache = cache if len(cache) < 1000 else {}
                    cache[t] = {int(k): v for k, v in json.loads(t).items()}
                out.append(main_text(h, cache[t] if t else None))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(out, pa.string())], ["key", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return map_batches(joined, run, f"key {kind}, url string, text string").withColumnRenamed("key", key)
