"""HTML extraction: host suffix arrays over what markup leaves open.

A page is cut into text blocks, each with what its elements say about it: in
an article (``article``, else ``main``) or not, and whether it is furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments).

* Elements and roles that mean furniture decide, and so do classes and ids that
  name a part of a page and nothing else (``ad-slot``, ``reader-comments``).
  A class or id that only has such a word in it (``share-enabled``) is a hint.
  The outermost article is never furniture by its class or id.
* The article is the narrowest of ``article`` and ``main`` that holds at least
  half of the page's text outside furniture, so a teaser card never stands for
  the body next to it.  Without one, all blocks outside furniture are candidates.
* A form that holds an article or most of the page's text is no furniture.
* On all candidates the host decides.  The token streams of its pages are
  concatenated and a suffix array over them finds the substrings of at least
  ``min_tokens`` tokens found on at least half of the distinct pages
  (``PAGE_SHARE``) and on three or more: what two pages share may as well be one
  article in two versions.  Blocks that such substrings cover as a whole go, in
  an article too.  For blocks with a hint, two pages and a tenth of all
  (``HINT_SHARE``) are enough.  On pages without an article, covered runs of
  twice ``min_tokens`` tokens or more go as well; all other text stays.

A page is parsed once, and its blocks move once, to meet its host.  A host with
more than ``chunk_bytes`` of html is dealt by page into chunks of that size, so a
host with a third of all pages is no single task.  What its chunks decide by are
the counts and shares of the whole host, got in three reads of what was dealt:

1. A chunk tells by its suffix array the substrings on at least half of
   ``HINT_SHARE`` of its pages, and how many pages others may be on.  Those that can't
   come to ``HINT_SHARE`` of the host's pages are left out: what stays has half of
   that in told pages, so its number goes with the length of a page, not with the host.
2. Each chunk counts its pages with what stayed, and the counts are added up.
3. Texts are made with the counts and the number of pages of the host.

Defined cases: null html is an empty page with empty text; a null or unusable
url is the empty host; pages with equal streams count as one page; character
references are decoded, all white space in a block becomes one space; markup
left open ends with the page; rows repeated give repeated rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.shipping import ship

from . import tokens as tk
from .common import WORD, quoted, stash
from .url_filter import url_host

U = np.uint64
#: Substrings of at least so many tokens are boilerplate if repeated.
MIN_TOKENS = 6
#: ... on this share of the host's distinct pages, and on MIN_PAGES.
PAGE_SHARE, MIN_PAGES = 0.5, 3
#: The same for blocks with a hint.
HINT_SHARE, HINT_PAGES = 0.1, 2
#: Html of a chunk of a host, about.
CHUNK_BYTES = 512 << 10
#: Hosts of more than one chunk up to this number are broadcast, 100 bytes each.
BROADCAST_HOSTS = 100_000
#: What a block is: candidate, candidate with a hint, outside the article, furniture.
OPEN, HINTED, OUTSIDE, DULL = range(4)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE = frozenset("nav footer aside form script style noscript template head button select option dialog menu svg canvas object audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search comment comments "
    "commentlist disqus respond reply replies discussion opinions feedback reactions share sharing social related recommended recommendations widget widgets pagination pager copyright skip".split()
)
HEADERS = frozenset(("header",))
#: Furniture words that articles are also about: alone they are no furniture as an id in an article.
TOPICS = frozenset(
    "advertising sponsor sponsors promotion banner navigation menu footer cookie cookies consent gdpr notice notices overlay subscribe subscription login search comment reply replies "
    "discussion opinions feedback reactions share sharing social related recommended recommendations widget widgets copyright skip".split()
)
#: Words that make a part of a page of a topic: related-posts, search-form.
PARTS = frozenset("area articles bar block box button buttons container content form header icons inner items links list panel post posts section slot stories thread top unit wrap wrapper".split())
#: Words that only tell one part from another: main-nav, reader-comments.
KINDS = frozenset("bottom global inline left main mobile page primary reader readers right secondary site sticky the user users visitor visitors".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEUTRAL = frozenset("with has no without non not".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++)|(?P<lone><)",
    re.S,
)
ATTR = re.compile(r"(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hinted(value: str) -> bool:
    """A class or id with a furniture word first or last: ad-slot, share-enabled, postComments."""
    for name in value.split():
        w = [x.lower() for x in WORDS.findall(name)]
        if w and not NEUTRAL.intersection(w) and (w[0] in NAMES or w[-1] in NAMES):
            return True
    return False


def _part_name(name: str, alone: bool) -> bool:
    """A name of a part of a page and of nothing that the text is about: comments,
    related-posts, ad-1, but not related-work.  ``alone``: a topic alone will do, as a class does."""
    w = [x.lower() for x in WORDS.findall(name) if not x.isdigit()]
    named = [x for x in w if x in NAMES]
    return bool(named) and all(x in NAMES or x in PARTS or x in KINDS for x in w) and (alone or len(w) > 1 or named[0] not in TOPICS)


def furniture(tag: str, attrs: str, in_article: bool) -> int:
    """DULL, HINTED or OPEN, by element, role, class and id."""
    if tag in FURNITURE and tag != "form" or tag == "header" and not in_article:
        return DULL
    if not attrs or tag in ("html", "body", "main"):
        return OPEN
    out = OPEN
    for k, v in ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id"):
            if tag == "article" and not in_article:
                continue
            # ids of headings are made of their titles, those of parts of an article of its topics
            if tag in HEADINGS and k == "id":
                continue
            alone = k == "class" and tag != "section" and tag not in HEADINGS or k == "id" and not in_article
            names = v.split() if k == "class" else [v]
            if any(_part_name(x, alone) for x in names) or not in_article and any(x.lower() in HEADERS for x in names):
                return DULL
            if _hinted(v):
                out = HINTED
        elif k == "role":
            if v.lower() in ROLES and not (tag == "form" and v.lower() == "form"):
                return DULL
        elif k == "aria-hidden" and v.lower() == "true" or k == "hidden" and tag != "article" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
            return DULL
    return out


def page_blocks(page: str) -> list[tuple[int, int, str]]:
    """Text blocks in page order: (2 in an article, 1 in main, 0 neither; OPEN, HINTED or DULL; text)."""
    out: list[tuple[int, int, str, tuple[int, ...]]] = []
    # open elements: tag, article level, furniture and forms around it, and the
    # text of the block that an inline piece of furniture stands in
    stack: list[tuple[str, int, int, tuple[int, ...], list[str] | None]] = []
    count: dict[str, int] = {}
    level, dull = 0, OPEN
    # forms around the place, and the article level in which each form stands
    forms: tuple[int, ...] = ()
    form_level: list[int] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                out.append((level, dull, text, forms))

    def pop_to(tag: str) -> None:
        nonlocal level, dull, forms
        while True:
            if stack[-1][0] not in INLINE or stack[-1][4] is not None:
                flush()
            t, level, dull, forms, held = stack.pop()
            if held:
                buf.extend((*held, " "))
            count[t] -= 1
            if t == tag:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            buf.append(htmllib.unescape(text) if "&" in text else text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["lone"]:
                buf.append("<")
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag not in INLINE and not (tag == "button" and count.get(tag)):
                flush()
            if count.get(tag):
                if tag in INLINE and stack[-1][0] != tag:
                    # an inline end tag never closes what is not inline
                    i = len(stack) - 1
                    while stack[i][0] != tag and stack[i][0] in INLINE:
                        i -= 1
                    if stack[i][0] != tag:
                        continue
                pop_to(tag)
            continue
        attrs = m["attrs"] or ""
        if tag == "br":
            buf.append(" ")
            continue
        if tag not in INLINE and tag != "button":
            flush()
            if tag in CLOSES_P and count.get("p"):
                i = len(stack) - 1
                while stack[i][0] in INLINE:
                    i -= 1
                if stack[i][0] == "p":
                    pop_to("p")
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attrs.endswith("/") and tag not in CLOSES_P:
            continue
        new = max(dull, furniture(tag, attrs, level > 0))
        held = None
        if new != dull and tag in INLINE:
            if new == DULL:
                held = buf[:]
                buf.clear()
            else:
                new = dull  # a hint is about blocks
        elif tag == "button":
            # furniture, but no border between blocks
            held = buf[:]
            buf.clear()
        stack.append((tag, level, dull, forms, held))
        count[tag] = count.get(tag, 0) + 1
        dull = new
        if tag == "form" and dull != DULL:
            forms = (*forms, len(form_level))
            form_level.append(level)
        if dull != DULL:
            if tag == "article":
                level = 2
            elif level == 0 and (tag == "main" or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs)):
                level = 1
    flush()
    while stack:
        pop_to(stack[-1][0])
    flush()
    # a form is furniture unless it holds an article or most of the text
    size, article = [0] * len(form_level), [False] * len(form_level)
    for lv, off, text, inside in out:
        if off != DULL:
            for f in inside:
                size[f] += len(text)
                article[f] |= lv > form_level[f]
    total = sum(len(text) for _, off, text, _ in out if off != DULL)
    dull_forms = {f for f in range(len(size)) if not article[f] and 2 * size[f] <= total}
    return [(lv, DULL if not dull_forms.isdisjoint(inside) else off, text) for lv, off, text, inside in out]


def page_candidates(page: str) -> tuple[int, list[tuple[int, str]]]:
    """(2 with an article, 1 with a main element, 0 with neither; all blocks as
    (OPEN, HINTED, OUTSIDE the article or DULL, text))."""
    blocks = page_blocks(page)
    size = [0, 0, 0]
    for lv, dull, t in blocks:
        if dull != DULL:
            size[lv] += len(t)
    best = next((lv for lv in (2, 1) if 0 < sum(size) <= 2 * sum(size[lv:])), 0)
    return best, [(DULL if dull == DULL else OUTSIDE if lv < best else dull, t) for lv, dull, t in blocks]


def split_page(page: str) -> tuple[str | None, list[tuple[bool, str]]]:
    """What markup says alone: (the article's text, or None without an article;
    blocks outside it as (furniture, text))."""
    best, blocks = page_candidates(page)
    if best:
        return "\n\n".join(t for k, t in blocks if k < OUTSIDE), [(k == DULL, t) for k, t in blocks if k >= OUTSIDE]
    return None, [(k == DULL, t) for k, t in blocks]


BLOCKS = "array<struct<kind:int,text:string>>"
STREAMS = f"page_id long, url string, host string, chunks long, chunk int, page long, rule int, blocks {BLOCKS}"
#: Substrings of a host (``hash``; null: all pages) with the pages of a chunk that they are on; ``hidden``: pages that what is not told may be on.
COUNTS = "host string, chunks long, hash long, n long, hidden long"
TEXTS = "page_id long, url string, text string, rule string, dropped_markup long, dropped_repeats long"
RULES = ("host", "main", "article")


def _hash(texts: list[str]) -> np.ndarray:
    col = pa.array(texts, pa.string())
    raw, off = tk.buffers(col)
    return tk.span_hashes(raw, off[:-1], off[1:], lower=False).view(np.int64)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, chunks, html) to STREAMS; what is furniture anyway is left behind."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            split = [page_candidates(x or "") for x in b.column(4).to_pylist()]
            page = _hash(["\x00".join(t for _, t in s) for _, s in split])
            chunks = np.maximum(b.column(3).to_numpy(zero_copy_only=False), 1)
            chunk = ((page.view(U) >> U(8)) % chunks.astype(U)).astype(np.int32)
            blocks = [[{"kind": k, "text": t if k < DULL else ""} for k, t in s] for _, s in split]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j) for j in range(3)), pa.array(chunks), pa.array(chunk), pa.array(page), pa.array([r for r, _ in split], pa.int32()), pa.array(blocks, kind)],
                ["page_id", "url", "host", "chunks", "chunk", "page", "rule", "blocks"],
            )


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` sorted by their first ``depth`` tokens at least
    (prefix doubling), and the rank classes: equal where those are equal."""
    n, step = len(ids), 1
    order = np.argsort(ids)
    key = ids[order]
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1])) if n else 0
        if step >= depth or not n:
            return order, rank
        # (rank of the first tokens, rank of the next) as one number, never over depth
        shift = min(step, depth - step)
        after = np.zeros(n, np.int64)
        after[: n - shift] = rank[shift:] + 1 if n > shift else 0
        both = rank * (n + 1) + after
        order = np.argsort(both)
        key = both[order]
        step += shift


def _chunk(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Concatenated token hashes of pages of blocks, a mark after each page, the
    page of each token, and (page, block, first token, end) of each block."""
    raw, off = tk.buffers(pa.array([t for blocks in pages for t in blocks], pa.string()))
    starts, ends, first = tk.word_spans(raw, off)
    h = tk.span_hashes(raw, starts, ends, lower=False) if len(starts) else np.zeros(0, U)
    ids, owner, where, k, at = [], [], [], 0, 0
    for p, blocks in enumerate(pages):
        a = first[k]
        for i in range(len(blocks)):
            where.append((p, i, at + first[k] - a, at + first[k + 1] - a))
            k += 1
        ids += [h[a : first[k]], np.array([(0xFFFFFFFF00000000 + p) & 0xFFFFFFFFFFFFFFFF], U)]  # no substring goes over it
        owner.append(np.full(first[k] - a + 1, p))
        at += int(first[k] - a) + 1
    return np.concatenate(ids) if ids else np.zeros(0, U), np.concatenate(owner) if owner else np.zeros(0, np.int64), where


def _inside(owner: np.ndarray, k: int) -> np.ndarray:
    """Places from which k tokens are of one page, without its mark."""
    n = len(owner)
    out = np.zeros(n, bool)
    m = max(0, n - k)
    out[:m] = owner[:m] == owner[k : k + m]
    return out


def _shared(ids: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, which substring of k tokens begins at each, pages of each substring)."""
    order, rank = suffix_array(ids, k)
    order = order[_inside(owner, k)[order]]
    if not len(order):
        return order, order, order
    r = rank[order]
    group = np.cumsum(np.append(0, r[1:] != r[:-1]))
    pair = np.unique(group * (owner[-1] + 1) + owner[order])  # distinct (substring, page)
    return order, group, np.bincount(pair // (owner[-1] + 1))


def _spread(begin: np.ndarray, k: int) -> np.ndarray:
    """For each token the largest number of the substrings of k tokens over it, from those that begin at each."""
    out = begin.copy()
    for j in range(1, min(k, len(begin))):
        np.maximum(out[j:], begin[:-j], out=out[j:])
    return out


def repeated(ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """For each token the largest number of pages that share a substring of k tokens over it."""
    order, group, pages = _shared(ids, owner, k)
    begin = np.zeros(len(ids), np.int64)
    begin[order] = pages[group]
    return _spread(begin, k)


def _substrings(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each place on: the same in all chunks."""
    n = len(ids)
    out = np.zeros(n, U)
    m = max(0, n - k + 1)
    for j in range(k):
        out[:m] = out[:m] * U(0x9E3779B97F4A7C15) + ids[j : j + m]
    return (out ^ (out >> U(29))).view(np.int64)


def _found(ids: np.ndarray, owner: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, number in ``known``, which is sorted) of the substrings that are known."""
    at = np.flatnonzero(_inside(owner, k))
    h = _substrings(ids, k)[at]
    which = np.searchsorted(known, h)
    on = which < len(known)
    on[on] = known[which[on]] == h[on]
    return at[on], which[on]


def _pages(table: pa.Table) -> tuple[list[dict], dict[int, int]]:
    """The rows of a chunk, and the first row of each distinct page."""
    rows = table.select(["page", "rule", "blocks"]).to_pylist()
    first: dict[int, int] = {}  # equal streams once
    for i, r in enumerate(rows):
        first.setdefault(r["page"], i)
    return rows, first


def _block_texts(rows: list[dict], first: dict[int, int]) -> list[list[str]]:
    return [[b["text"] for b in rows[i]["blocks"]] for i in first.values()]


def _counts(table: pa.Table, hashes: np.ndarray, n: np.ndarray, pages: int, hidden: int) -> pa.Table:
    """Rows of COUNTS; the first has the pages of the chunk."""
    m = len(hashes) + 1
    h = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(hashes, pa.int64())])
    return pa.table({"host": pa.array([table["host"][0].as_py()] * m, pa.string()), "chunks": pa.array([table["chunks"][0].as_py()] * m, pa.int64()), "hash": h, "n": pa.array([pages, *n.tolist()], pa.int64()), "hidden": pa.array([hidden] * m, pa.int64())})


def _none(table: pa.Table) -> pa.Table:
    return _counts(table, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0).slice(0, 0)


def _local(table: pa.Table, k: int) -> pa.Table:
    """Substrings on at least half of HINT_SHARE of a chunk's pages."""
    if table["chunks"][0].as_py() < 2:
        return _none(table)
    rows, first = _pages(table)
    ids, owner, _ = _chunk(_block_texts(rows, first))
    order, group, pages = _shared(ids, owner, k)
    least = max(1, int(np.ceil(HINT_SHARE / 2 * len(first))))
    told = np.flatnonzero(pages >= least)
    _, begin = np.unique(group, return_index=True)  # a place of each
    return _counts(table, _substrings(ids, k)[order[begin[told]]], pages[told], len(first), least - 1)


def _counted(table: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """On how many pages of a chunk each substring is that was asked for."""
    if not table.num_rows or not asked.num_rows:
        return _none(table) if table.num_rows else pa.schema([("host", pa.string()), ("chunks", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("hidden", pa.int64())]).empty_table()
    rows, first = _pages(table)
    known = np.array(asked["hashes"][0].as_py(), np.int64)
    if not len(known):
        return _counts(table, known, known, len(first), 0)
    ids, owner, _ = _chunk(_block_texts(rows, first))
    at, which = _found(ids, owner, k, known)
    pair = np.unique(which * (len(first) + 1) + owner[at])
    n = np.bincount(pair // (len(first) + 1), minlength=len(known))
    return _counts(table, known[n > 0], n[n > 0], len(first), 0)


def _texts(table: pa.Table, told: pa.Table, k: int) -> pa.Table:
    """All pages of a chunk of a host to their texts; ``told``: the counts of a host in more than one chunk."""
    rows, first = _pages(table)
    place = {p: j for j, p in enumerate(first)}
    pages = _block_texts(rows, first)
    ids, owner, where = _chunk(pages)
    if told.num_rows:
        n_pages = told["pages"][0].as_py()
        counts = sorted((c["hash"], c["n"]) for c in told["counts"][0].as_py())
        at, which = _found(ids, owner, k, np.array([h for h, _ in counts], np.int64))
        begin = np.zeros(len(ids), np.int64)
        begin[at] = np.array([n for _, n in counts], np.int64)[which]
        on = _spread(begin, k)
    else:
        n_pages, on = len(pages), repeated(ids, owner, k)
    most = on >= max(MIN_PAGES, PAGE_SHARE * n_pages)
    some = on >= max(HINT_PAGES, HINT_SHARE * n_pages)
    texts, gone = [], []
    by_page = [[] for _ in pages]
    for p, i, a, z in where:
        by_page[p].append((a, z))
    for p, i in enumerate(first.values()):
        kept, n = [], 0
        blocks = [(b, a, z, z > a and bool((most if b["kind"] == OPEN else some)[a:z].all())) for b, (a, z) in zip(rows[i]["blocks"], by_page[p], strict=True) if b["kind"] < OUTSIDE]
        # an article that is repeated for the most part is one in many versions
        version = rows[i]["rule"] > 0 and 2 * sum(z - a for b, a, z, x in blocks if x and b["kind"] == OPEN) > sum(z - a for _, a, z, _ in blocks)
        for b, a, z, covered in blocks:
            left = b["text"]
            if covered and not (version and b["kind"] == OPEN):
                left = ""
            elif not rows[i]["rule"]:
                left = _without_runs(left, most[a:z], 2 * k)
            n += not left
            if left:
                kept.append(left)
        texts.append("\n\n".join(kept))
        gone.append(n)
    j = [place[r["page"]] for r in rows]
    return pa.table(
        {
            "page_id": table["page_id"],
            "url": table["url"],
            "text": pa.array([texts[x] for x in j], pa.string()),
            "rule": pa.array([RULES[r["rule"]] for r in rows], pa.string()),
            "dropped_markup": pa.array([sum(b["kind"] >= OUTSIDE for b in r["blocks"]) for r in rows], pa.int64()),
            "dropped_repeats": pa.array([gone[x] for x in j], pa.int64()),
        }
    )


def _without_runs(text: str, on: np.ndarray, least: int) -> str:
    """A block without its runs of at least ``least`` tokens that are ``on``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    gone = {i for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if z - a >= least for i in range(a, z)}
    return " ".join(w for i, w in enumerate(re.findall(WORD, text)) if i not in gone) if gone else text


def _each_chunk(hosts: DataFrame) -> DataFrame:
    """A row of each host to each of its chunks."""
    return hosts.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk")).drop("chunks")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = MIN_TOKENS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, rule (what
    held the text: article, main or, without either, host), dropped_markup and
    dropped_repeats (blocks that went by markup, and by what the host repeats)."""
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(url_host(quoted(url_col).cast("string")), F.lit(""))
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), host.alias("host"), quoted(html_col).cast("string").alias("html"))
    large = rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / F.lit(chunk_bytes)).cast("long").alias("chunks")).where("chunks > 1")
    large = stash(large.withColumnRenamed("host", "l_host"), "page-hosts")
    few = large.count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(large) if few else large, F.col("host") == F.col("l_host"), "left").select("page_id", "url", "host", F.coalesce("chunks", F.lit(1)).cast("long").alias("chunks"), "html")
    # dealt once, and read by all that follows
    chunk = dealt.mapInArrow(_streams, STREAMS).repartition("host", "chunk").groupBy("host", "chunk")
    local = chunk.applyInArrow(lambda t: _local(t, min_tokens), COUNTS)
    local = local.groupBy("host", "hash").agg(F.max("chunks").alias("chunks"), F.sum("n").alias("n"), F.sum("hidden").alias("hidden"))
    of_host = lambda c: F.max(F.when(F.col("hash").isNull(), F.col(c))).over(Window.partitionBy("host"))
    local = local.select("host", "chunks", "hash", "n", "hidden", of_host("n").alias("pages"), of_host("hidden").alias("all_hidden"))
    can = F.col("n") + F.col("all_hidden") - F.col("hidden") >= F.greatest(F.lit(float(HINT_PAGES)), F.lit(HINT_SHARE) * F.col("pages"))
    asked = local.where(F.col("hash").isNull() | can).groupBy("host").agg(F.max("chunks").alias("chunks"), F.sort_array(F.collect_list("hash")).alias("hashes"))
    n = chunk.cogroup(_each_chunk(asked).groupBy("host", "chunk")).applyInArrow(lambda t, a: _counted(t, a, min_tokens), COUNTS)
    n = n.groupBy("host", "hash").agg(F.max("chunks").alias("chunks"), F.sum("n").alias("n"))
    told = n.groupBy("host").agg(F.max("chunks").alias("chunks"), F.max(F.when(F.col("hash").isNull(), F.col("n"))).alias("pages"), F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("hash", "n"))).alias("counts"))
    texts = chunk.cogroup(_each_chunk(told).groupBy("host", "chunk")).applyInArrow(lambda t, c: _texts(t, c, min_tokens), TEXTS)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "rule", "dropped_markup", "dropped_repeats")
