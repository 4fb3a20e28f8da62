"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def near_groups(rows, threshold=75):
    """[(id, text)] to the smallest id of each row's group, by index."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def lm(rows, smoothing, modulus=7, remainder=2):
    """Scores by the recursive formula, from counts of all n-grams in dictionaries."""
    toks = [["\0", *words(t), "\n"] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % modulus == remainder for i, _ in rows]
    train = [t for t, h in zip(toks, held, strict=True) if not h]
    c = Counter(w for t in train for w in t[1:])
    n, v = sum(c.values()), len(c)
    order = len(smoothing) + 1
    count = Counter(tuple(t[i - k + 1 : i + 1]) for t in train for k in range(2, order + 1) for i in range(max(1, k - 1), len(t)))
    seen = Counter()  # of contexts
    for g, m in count.items():
        seen[g[:-1]] += m

    def p(context, w):
        if not context:
            return (c[w] + 1) / (n + v + 1)
        s, low = seen[context], p(context[1:], w)
        if not s:
            return low
        a, b = smoothing[len(context) - 1]
        return (count[(*context, w)] + a * s**b * low) / (s + a * s**b)

    out = []
    for t, h in zip(toks, held, strict=True):
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        out.append((h, len(t) - 1, sum(c[w] > 0 for w in t[1:]), n, sum(math.log10(p((), w)) for w in t[1:]), score))
    return out


class Article(HTMLParser):
    """Blocks of the article of the test pages, by the standard library's parser."""

    OUT = {"nav", "footer", "aside", "form", "script", "style", "head", "title"}
    BLOCK = {"p", "h1", "h2", "h3", "div", "article", "ul", "li", "section", "table", "body", "html"} | OUT

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article, self.out, self.now, self.blocks = 0, [], "", []

    def cut(self):
        t = " ".join(self.now.split())
        if t:
            self.blocks.append(t)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.cut()
        if tag == "br":
            self.now += " "
        if tag == "article":
            self.article += 1
        if tag in self.OUT or tag == "div" and set((dict(attrs).get("class") or "").split()) & {"ad", "comments", "cookie"}:
            self.out.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
        if self.out and self.out[-1] == tag:
            self.out.pop()
        if tag == "article":
            self.article -= 1

    def handle_data(self, data):
        if self.article and not self.out:
            self.now += data


def articles(rows, k=6):
    """[(id, host, html)] to {id: text}: blocks of articles without those that most pages of the host repeat."""
    blocks = {}
    for i, _, page in rows:
        a = Article()
        a.feed(page or "")
        a.close()
        a.cut()
        blocks[i] = a.blocks
    hosts = {}
    for i, host, _ in rows:
        hosts.setdefault(host, []).append(i)
    out = {}
    for ids in hosts.values():
        distinct = {tuple(blocks[i]) for i in ids}
        grams = Counter()
        for page in distinct:
            w = [x for b in page for x in b.split(" ")]
            grams.update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
        often = {g for g, n in grams.items() if n >= max(3, len(distinct) / 2)}
        for i in ids:
            w = [x for b in blocks[i] for x in b.split(" ")]
            hit = {j + d for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in often for d in range(k)}
            size = [len(b.split(" ")) for b in blocks[i]]
            at = [sum(size[:j]) for j in range(len(size))]
            gone = [hit.issuperset(range(x, x + n)) for x, n in zip(at, size, strict=True)]
            if 2 * sum(n for n, g in zip(size, gone, strict=True) if g) > sum(size):
                gone = [False] * len(size)  # one article in several versions
            kept = [b for b, g in zip(blocks[i], gone, strict=True) if not g]
            out[i] = "\n\n".join(kept)
    return out


def language(model, features, text):
    """(label or None, score, sure) of a text by a plain forward-backward over its words.

    ``features(word)``: the feature ids of a word.
    """
    ws = WORD.findall(text or "")
    if model is None or not ws:
        return None, 0.0, 0.0
    k = len(model.labels)
    emit = []
    for w in ws:
        f = features(w)
        emit.append([sum(float(model.weights[x][c]) for x in f) / math.sqrt(len(f)) for c in range(k)])
    add = lambda x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    alpha = [[model.start[c] + emit[0][c] for c in range(k)]]
    for e in emit[1:]:
        alpha.append([add([alpha[-1][a] + model.trans[a][c] for a in range(k)]) + e[c] for c in range(k)])
    beta = [[0.0] * k]
    for e in reversed(emit[1:]):
        beta.append([add([model.trans[c][b] + e[b] + beta[-1][b] for b in range(k)]) for c in range(k)])
    beta.reverse()
    z = add(alpha[-1])
    post = [[math.exp(a + b - z) for a, b in zip(x, y, strict=True)] for x, y in zip(alpha, beta, strict=True)]
    post = [p for p, w in zip(post, ws, strict=True) if any(c.isascii() and c.isalpha() or not c.isascii() for c in w)]
    if not post:
        return None, 0.0, 0.0
    mean = [sum(p[c] for p in post) / len(post) for c in range(k)]
    return model.labels[mean.index(max(mean))], max(mean), sum(map(max, post)) / len(post)


def contaminated(text, items, window=13, least=10):
    """{item id: most equal tokens in a window} of items that overlap with the text, over all alignments."""
    split = lambda t: [w for w in re.split("[ \t-\r]+", (t or "").lower()) if w]
    w = split(text)
    at = {}
    for j, x in enumerate(w):
        at.setdefault(x, []).append(j)
    out = {}
    for item, t in items:
        x = split(t)
        wide, need = min(window, len(x)), least if len(x) >= window else len(x)
        hits = {}
        for i, v in enumerate(x):
            for j in at.get(v, ()):
                hits.setdefault(j - i, set()).add(i)
        for d, same in hits.items():
            lo, hi = max(0, -d), min(len(x), len(w) - d)
            if hi - lo >= wide and len(same) >= need:
                best = max(sum(k in same for k in range(a, a + wide)) for a in range(lo, hi - wide + 1))
                if best >= need:
                    out[item] = max(best, out.get(item, 0))
    return out


def mix(rows, targets, seed=20240229):
    """[(id, source, words)] with distinct ids to {id: words taken}: epochs, then rows by key up to the budget."""
    out = {}
    for source in {s for _, s, _ in rows}:
        mine = sorted(((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), i, n) for i, s, n in rows if s == source))
        size, budget = sum(n for *_, n in mine), math.floor(targets[source])
        epochs = budget // size if size else 0
        left = budget - epochs * size
        for _, i, n in mine:
            out[i] = n * epochs + min(n, left)
            left -= min(n, left)
    return out
