"""Main text of web pages: structure first, then what repeats on the host for what structure leaves open.

A page is cut into blocks at block-level tags. Blocks in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments (by tag, role, or class and id) are furniture. If other blocks lie in an <article>, or
else in <main>, those are the text and are kept whole, whatever repeats in them. A page without either is open: of its
blocks that are not furniture, substrings that repeat across pages of the host are removed and unique runs are kept.

Repeated 8-token shingles stand in for a sorted suffix array of the host. It would concatenate the streams of its pages (furniture and open blocks; blocks are divided by a
mark). Only common prefixes of DEPTH tokens or more count, and these are made of shared shingles of DEPTH tokens, so
the hashed shingles are counted by host instead, and no host, however large, is gathered. Such a prefix
repeats if it begins on MIN_PAGES distinct pages, however many the host has; exact copies of a page count once.
Every token of a repeated prefix is covered. A block shorter than DEPTH is one prefix of its own.

The repeated prefixes go to the workers while there are at most BROADCAST of them; more are joined by a shuffle.

Defined results: null or empty html gives the empty text; a null url is a host of its own; repeated rows give repeated
results. Truncated markup is read as far as it goes. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnum as T
from tidelog.llm.scratch import Scratch, spark_of

DEPTH, MIN_PAGES, BROADCAST = 8, 3, 2_000_000
MARK = "¶"
SLICE = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noscript svg math object select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article aside body div fieldset footer form header html main nav section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# words of class and id names that mark furniture
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent
gdpr notice notices newsletter subscribe subscription signup popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs
pagination pager toolbar masthead topbar footer share sharing social related recommended recommendations comment comments commentlist respond replies
disqus login search skip header""".split())  # fmt: skip
NOT_ITSELF = frozenset("with has no without".split())  # "with-sidebar" is not a sidebar

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _named_furniture(names: str) -> bool:
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not NOT_ITSELF.intersection(words) and NAMES.intersection(words):
            return True
    return False


def _furniture(tag: str, raw: str, inside: bool) -> bool:
    """Whether an element and all in it is furniture; `inside` an article, a header may hold headings."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not raw or tag in ("html", "body", "main"):
        return False
    at = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(raw)}
    if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")):
        return True
    return at.get("role", "").lower() in ROLES or _named_furniture(f"{at.get('class', '')} {at.get('id', '')}")


def blocks_of(page: str) -> list[tuple[str, bool, bool, bool, float]]:
    """Blocks in page order: (text, furniture, in article, in main, share of characters that are links)."""
    out, parts, linked, stack, links, at, end = [], [], 0, [], 0, 0, len(page)

    def state() -> tuple[bool, bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False, False)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) * (links > 0)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            clean = " ".join(entities.unescape(raw).split())
            if clean:
                skip, article, main, head = state()
                in_heading = any(s[0] in HEADINGS for s in stack[-3:])
                out.append((clean, skip or (head and not in_heading), article, main, min(1.0, linked / len(raw))))
            parts, linked = [], 0

    def pop(tag: str, stops: frozenset) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in stops and tag not in CONTAINERS:
                return

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = (found[3] or found[6] or "").lower()
        if found[1]:
            text(found[1])
        if not tag:
            continue
        ending, raw = bool(found[2] or found[5]), found[4] or found[7] or ""
        if tag in RAW and not ending:
            if not raw.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br" or tag in VOID:
            if tag == "hr":
                close()
            else:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if ending else 1
            if not ending and raw and _furniture(tag, raw, False):
                close()
                skip, article, main, head = state()
                stack.append((tag, True, article, main, head))
            elif ending and stack and any(s[0] == tag for s in stack[-4:]):
                close()
                pop(tag, CONTAINERS)
            continue
        close()
        links = 0
        if ending:
            pop(tag, CONTAINERS)
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag in HEADINGS:
            pop(tag, CONTAINERS | {"ul", "ol", "dl", "table"} - {tag})
        skip, article, main, head = state()
        inside = article or main
        stack.append((tag, skip or _furniture(tag, raw, inside), article or tag == "article", main or tag == "main" or 'role="main"' in raw, head or (inside and tag == "header")))
    close()
    return out


def _host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _digest(page: str | None) -> int:
    """Tells pages apart: exact copies of one count once in its host."""
    return int.from_bytes(hashlib.blake2b((page or "").encode(), digest_size=8).digest(), "little", signed=True)


def _read(page: str | None):
    """(text or None if open, blocks left open, the stream: blocks that are not the text)."""
    blocks = blocks_of(page or "")
    own = [b for b in blocks if not b[1]]
    main = [b for b in own if b[2]] or [b for b in own if b[3]]
    if main or not own:
        keep = {id(b) for b in main}
        return "\n\n".join(b[0] for b in main), [], [b[0] for b in blocks if id(b) not in keep]
    left = [b[0] for b in own if b[4] < 0.8 or len(own) == 1]
    return None, left, [b[0] for b in blocks]


def _prefixes(streams: list[list[str]], hosts: list[str]) -> list[np.ndarray]:
    """Of each page the names, with the host in them, of the prefixes of its suffixes: first by place in the stream, then of the short blocks."""
    joined = pa.array([f" {MARK} ".join(["", *s, ""]) if s else "" for s in streams], pa.string())
    names, docs = T.words(*T.utf8(joined), lower=False)
    n = len(streams)
    flat = [b for s in streams for b in s]
    owner = np.repeat(np.arange(n), [len(s) for s in streams])
    short_names, short_docs = T.words(*T.utf8(pa.array(flat, pa.string())), lower=False)
    few = np.bincount(short_docs, minlength=len(flat)) < DEPTH if flat else np.zeros(0, bool)
    sel = few[short_docs] if flat else np.zeros(0, bool)
    whole, where = T.shingles(short_names[sel], short_docs[sel], len(flat), DEPTH)
    salt, _ = T.words(*T.utf8(pa.array([f"h{h}" for h in hosts], pa.string())), lower=False)
    deep, deep_docs = T.shingles(names, docs, n, DEPTH)
    order = np.argsort(deep_docs, kind="stable")
    deep, deep_docs = deep[order], deep_docs[order]
    cut = np.searchsorted(deep_docs, np.arange(n + 1))
    order = np.argsort(where, kind="stable")
    whole, whose = whole[order], owner[where[order]]
    cut2 = np.searchsorted(whose, np.arange(n + 1))
    return [T.mix(np.concatenate([deep[cut[i] : cut[i + 1]], whole[cut2[i] : cut2[i + 1]]]) ^ salt[i]) for i in range(n)]


def _batches(batch):
    """Python rows (page_id, url, html) of about SLICE bytes."""
    rows, held = [], 0
    for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        rows.append((row[0], row[1], row[2].as_py()))
        held += len(rows[-1][2] or "")
        if held > SLICE:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _evidence(batches):
    for batch in batches:
        for rows in _batches(batch):
            hosts, streams = [_host(r[1]) for r in rows], [_read(r[2])[2] for r in rows]
            marks = [np.unique(p).view(np.int64) for p in _prefixes(streams, hosts)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([_digest(r[2]) for r in rows], pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["host", "page", "prefixes"])


def _unique_runs(blocks: list[str], stream: list[str], names: np.ndarray, repeated: np.ndarray) -> tuple[list[str], int]:
    """The blocks without covered tokens, and how many tokens of the stream are covered."""
    tokens, owner = [MARK], [-1]
    for k, b in enumerate(stream):
        words = [w.decode() for w in b.encode().split()]
        tokens += [*words, MARK]
        owner += [k] * len(words) + [-1]
    hit = np.zeros(len(names), bool)
    if len(repeated):
        spot = np.minimum(np.searchsorted(repeated, names), len(repeated) - 1)
        hit = repeated[spot] == names
    covered = np.zeros(len(tokens) + DEPTH, bool)
    places = max(0, len(tokens) - DEPTH + 1) if len(tokens) >= DEPTH else 1
    for i in np.flatnonzero(hit[:places]):
        covered[i : i + DEPTH] = True
    owner = np.array(owner)
    short = [k for k, b in enumerate(stream) if 0 < len(b.encode().split()) < DEPTH]
    for k, bad in zip(short, hit[places:], strict=False):
        if bad:
            covered[: len(owner)][owner == k] = True
    covered = covered[: len(owner)]
    out, k = [], 0
    for b in blocks:  # in order, among those of the stream
        while stream[k] != b:
            k += 1
        left = [tokens[i] for i in np.flatnonzero((owner == k) & ~covered)]
        if left:
            out.append(" ".join(left))
        k += 1
    return out, int((covered & (owner >= 0)).sum())


def _texts(repeated: np.ndarray | None):
    """`repeated` sorted, or None if the fourth column lists those of the row's stream."""

    def run(batches):
        for batch in batches:
            more = batch.column(3).to_pylist() if repeated is None else None
            done = 0
            for rows in _batches(batch):
                read = [_read(r[2]) for r in rows]
                names = _prefixes([x[2] for x in read], [_host(r[1]) for r in rows])
                texts, counts = [], []
                for i, (text, blocks, stream) in enumerate(read):
                    known = repeated if repeated is not None else np.sort(np.array(more[done + i] or [], np.int64).view(T.U))
                    runs, n = _unique_runs(blocks, stream, names[i], known)
                    texts.append("\n\n".join(runs) if text is None else text)
                    counts.append(n)
                done += len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                ], ["page_id", "url", "text", "n_chars", "n_repeated"])

    return run


def main_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) of every row of `pages` (page_id, url, html).

    n_repeated counts words outside the text that lie in strings repeated across the host's pages.
    """
    scratch = Scratch(spark_of(pages), "main-text")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    streams = rows.mapInArrow(_evidence, "host string, page long, prefixes array<long>")
    once = streams.groupBy("host", "page").agg(F.first("prefixes").alias("prefixes"))
    once = scratch.keep(once, "streams")
    counts = once.select("host", F.explode("prefixes").alias("prefix")).groupBy("host", "prefix").agg(F.count("*").alias("n"))
    repeated = scratch.keep(counts.where(F.col("n") >= MIN_PAGES).select("host", "prefix"), "repeated")
    kind = "page_id long, url string, text string, n_chars long, n_repeated long"
    if repeated.limit(broadcast + 1).count() <= broadcast:
        known = np.sort(repeated.select("prefix").toArrow().column(0).to_numpy().view(T.U)) if repeated.head(1) else np.zeros(0, T.U)
        return rows.mapInArrow(_texts(known), kind)
    # each page with the repeated of its own prefixes
    own = once.select("host", "page", F.explode("prefixes").alias("prefix")).join(repeated, ["host", "prefix"])
    own = own.groupBy("host", "page").agg(F.collect_set("prefix").alias("prefixes"))
    paired = rows.mapInArrow(_paired, "page_id long, url string, html string, host string, page long")
    return paired.join(own, ["host", "page"], "left").select("page_id", "url", "html", "prefixes").mapInArrow(_texts(None), kind)


def _paired(batches):
    for batch in batches:
        for rows in _batches(batch):
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([_host(r[1]) for r in rows], pa.string()), pa.array([_digest(r[2]) for r in rows], pa.int64())], ["page_id", "url", "html", "host", "page"])
