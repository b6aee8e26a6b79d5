"""Main text of web pages: markup says what a block is, a suffix array over each host what is boilerplate.

1. A page is cut into blocks of text; scripts and styles are no text. Blocks inside <article> or <main>
   are main. Blocks in forms, hidden elements and containers that are named as menus, headers, footers,
   sidebars, notices, adverts or comments are marked. All others are open.
2. The token streams of the open and marked blocks of a host's pages are concatenated, each page ended
   by a sign of its own, and suffixes are sorted by prefix doubling up to ``least`` tokens. A run of
   that many tokens that stands on ``share_pages`` distinct pages of the whole host or more is
   boilerplate. A host may hold a third of all pages, so each task sorts the suffixes of the pages it
   has, and hands on one row a distinct run with its number of pages; the sums decide.
3. Tokens inside boilerplate runs go (``n_removed`` counts them), and so do marked blocks, which are
   often unique to a page. Main blocks stay whole: an article keeps its text even where other pages
   repeat it. What is left of open blocks stays on pages without main blocks only.

Pages of a host with equal html count as one page, so copies of a page don't remove its text. Nulls:
null html is empty and gives empty text; pages without a url share one host; null ids are allowed.
Repeated rows each give a row. Pages of any length are read whole. Columns other than ``page_id``,
``url`` and ``html`` play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, lookup, stage
from ._words import hashed
from .passages import shingles

#: Pages of a host that one task finishes, about; and tokens whose suffixes are sorted together, about.
SHARD_PAGES, TOKENS = 512, 1_000_000

# Element names by what becomes of their content.
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|button"
_DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "figure-menu"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "ins", "del", "wbr", "label", "img"}
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|newsletter|subscri\w*|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-?bar|footer|site-?header|header|masthead|comments?|comment-list|disqus|replies|reply|related|recommend\w*|share|sharing|social|widget|pagination|pager|toc|skip-link|login|signup|search)(?:$|[\s_-])",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


def _drops(tag: str, attrs: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES or name in ("class", "id") and _HINT.search(value):
            return True
    return False


OPEN, MAIN, MARKED = 0, 1, 2


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the visible blocks in page order, with white space made plain."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    aside: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    dropped = main = heading = 0

    def close() -> None:
        for parts, kind in ((held, MAIN if main else OPEN), (aside, MARKED)):
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    out.append((kind, text))

    def show(text: str) -> None:
        (held if not dropped or (heading and main and all(t in ("header",) or not d for t, d, _ in stack)) else aside).append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            show(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() not in ("button", "select", "svg", "math"):
                close()
            continue
        if tag == "br":
            show(" ")
        elif tag not in _INLINE:
            close()
        if tag in _VOID:
            continue
        if m[2]:
            fence = tag in ("article", "main", "body", "html")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for t, d, a in stack[i:]:
                        dropped -= d
                        main -= a
                        heading -= t[0] == "h" and t[1:].isdigit()
                    del stack[i:]
                    break
                if not fence and stack[i][0] in ("article", "main"):
                    break
        elif not (m[4] or "").endswith("/") or tag in ("div", "p", "article", "main", "section", "nav"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # an earlier one ends here
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag and not stack[i][1]:
                        del stack[i]
                        break
                    if stack[i][0] not in _INLINE:
                        break
            entry = (tag, _drops(tag, m[4] or ""), tag in ("article", "main"))
            stack.append(entry)
            dropped += entry[1]
            main += entry[2]
            heading += tag[0] == "h" and tag[1:].isdigit()
    if at < len(page):
        show(page[at:] if "<" not in page[at:] else page[at:].split("<", 1)[0] if re.match(r"<[a-zA-Z/!]", page[at:][page[at:].index("<") :]) else page[at:])
    close()
    return out


def runs(pages: list[np.ndarray], weights: np.ndarray, hosts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, weight) of the first stand of each distinct run of ``least`` tokens, with the summed weights of its pages.

    Suffixes of the concatenation are ranked by their first 1, 2, 4 ... tokens until the ranks tell
    ``least`` tokens apart; suffixes of equal rank are neighbours in the suffix array. Tokens of
    different hosts are different tokens.
    """
    sizes = np.array([len(p) for p in pages], np.int64)
    none = np.zeros(0, np.int64)
    if not len(pages) or sizes.max() < least:
        return none, none, np.zeros(0)
    of = np.repeat(np.arange(len(pages)), sizes)
    _, code = np.unique(np.concatenate(pages) + hosts[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True)
    top = int(code.max()) + 1
    text = np.empty(int((sizes + 1).sum()), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body], text[ends] = code, top + np.arange(len(pages))
    page = np.repeat(np.arange(len(pages)), sizes + 1)
    rank, depth = text, 1
    while depth < least:
        step = min(depth, least - depth)
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * (int(after.max()) + 2) + after + 1, return_inverse=True)
        depth += step
    order = np.lexsort((page, rank))
    order = order[ends[page[order]] - order >= least]  # a shorter suffix holds its page's own sign, so it never repeats
    if not len(order):
        return none, none, np.zeros(0)
    r, p = rank[order], page[order]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    fresh = first | np.concatenate([[True], p[1:] != p[:-1]])
    total = np.bincount(np.cumsum(first) - 1, np.where(fresh, weights[p], 0.0))
    at = order[first]
    return page[at], at - (ends - sizes)[page[at]], total


def covered(keys: np.ndarray, known: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run whose key is among the sorted ``known``; ``keys`` are those of all runs of the page."""
    edge = np.zeros(n + 1, np.int64)
    if len(known) and len(keys):
        start = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys)
        edge[start] += 1
        edge[start + least] -= 1
    return np.cumsum(edge)[:n] > 0


def stream(of: list[tuple[int, str]]) -> np.ndarray:
    """Token hashes of the blocks that are not main, in page order."""
    return hashed(np.frombuffer(" ".join(t for k, t in of if k != MAIN).encode("utf-8", "surrogatepass"), np.uint8))[0]


def main_text(of: list[tuple[int, str]], gone: np.ndarray) -> tuple[str, int]:
    """Text of a page and the number of boilerplate tokens removed; ``gone`` is over ``stream``."""
    if any(k == MAIN for k, _ in of):
        return " ".join(t for k, t in of if k == MAIN), int(gone.sum())
    kept, at = [], 0
    for k, t in of:
        words = t.split(" ")
        if k == OPEN:
            kept += [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
        at += len(words)
    return " ".join(kept), int(gone.sum())


def extract(pages: DataFrame, least: int = 8, share_pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars, n_removed of every page."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    base = pages.select("page_id", "url", F.xxhash64(host).alias("host"), "html")
    # Pages with equal html share the weight of one.
    copies = base.groupBy("host", F.xxhash64("html").alias("same")).agg(F.count("*").alias("copies")).where("copies > 1")
    copies = stage(copies.select(F.col("host").alias("_h"), "same", "copies"), "copies")
    weighed = lookup(base, copies, (F.col("host") == F.col("_h")) & (F.xxhash64("html") == F.col("same")))
    weighed = weighed.select("host", "html", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            page, place, total = runs(held, np.array(weights), np.array(hosts, np.int64), least)
            keys = [shingles(s, least) for s in held]
            key = np.array([keys[p][x] for p, x in zip(page.tolist(), place.tolist(), strict=True)], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.array(hosts, np.int64)[page]), pa.array(key.view(np.int64)), pa.array(total)], ["host", "key", "pages"])

        held, hosts, weights, size = [], [], [], 0
        for b in batches:
            for h, page, w in zip(*(b.column(c).to_pylist() for c in ("host", "html", "weight")), strict=True):
                held.append(stream(blocks(page or "")))
                hosts.append(h)
                weights.append(w)
                size += len(held[-1])
                if size > TOKENS:
                    yield flush()
                    held, hosts, weights, size = [], [], [], 0
        if held:
            yield flush()

    counted = weighed.mapInArrow(frugal(count), "host long, key long, pages double").groupBy("host", "key").agg(F.sum("pages").alias("pages"))
    known = stage(counted.where(F.col("pages") >= share_pages - 1e-6).select("host", "key"), "boilerplate")

    per_host = base.groupBy("host").agg(F.count("*").alias("n"))
    hot = per_host.where(F.col("n") > SHARD_PAGES).select(F.col("host").alias("_h"), F.ceil(F.col("n") / SHARD_PAGES).cast("int").alias("shards"))
    hot = stage(hot, "hosts")
    shards = F.coalesce("shards", F.lit(1))
    rows = lookup(base, hot, F.col("host") == F.col("_h")).select("host", F.pmod(F.xxhash64("page_id", "url", "html"), shards).cast("int").alias("shard"), F.lit(None).cast("long").alias("key"), "page_id", "url", "html")
    every = lookup(known, hot, F.col("host") == F.col("_h")).select("host", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "key")
    none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")]
    dealt = rows.union(every.select("host", "shard", "key", *none)).repartition("host", "shard").sortWithinPartitions("host", "shard", F.col("key").asc_nulls_last())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, last = None, [], np.zeros(0, np.uint64)
        for b in batches:
            out, keep = [], []
            for r, (h, s, key, page) in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "shard", "key", "html")), strict=True)):
                if (h, s) != at:
                    at, found, last = (h, s), [], np.zeros(0, np.uint64)
                if key is not None:
                    found.append(key)
                    continue
                if found:  # the runs of a shard stand before its pages
                    last, found = np.sort(np.array(found, np.int64).view(np.uint64)), []
                of = blocks(page or "")
                tokens = stream(of)
                out.append(main_text(of, covered(shingles(tokens, least), last, len(tokens), least)))
                keep.append(r)
            take = pa.array(keep, pa.int64())
            text = pa.array([t for t, _ in out], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id").take(take), b.column("url").take(take), text, pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], ["page_id", "url", "text", "n_chars", "n_removed"])

    return dealt.mapInArrow(frugal(finish), f"page_id {id_type}, url string, text string, n_chars long, n_removed long")
