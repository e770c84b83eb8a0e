"""Plain versions of the operators for small inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def substring(rows, window=50):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def _groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b) and find(a) != find(b):
                parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def _least_ids(ids, groups):
    least = {}
    for i, g in zip(ids, groups, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in groups]


def fingerprint(text, k=4):
    w = (text or "").encode().translate(LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, radius=4):
    ids, fps = [r[0] for r in rows], [fingerprint(r[1]) for r in rows]
    groups = _groups(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius)
    return sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, _least_ids(ids, groups), strict=True)), key=str)


def similar(rows, k=5, least=0.8):
    """{doc_id: component_id} by Jaccard similarity of shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    same = lambda a, b: sets[a] == sets[b] if not sets[a] | sets[b] else len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    groups = _groups(len(rows), same)
    return dict(zip((r[0] for r in rows), _least_ids([r[0] for r in rows], groups), strict=True))


def nearest(rows, every=100, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            got = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)
            out[q] = [i for _, i in got[:k]]
    return out


def maximal_chats(rows):
    """Conversations that are no proper prefix of another; equal ones by their least id."""
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn, role, text))
    talks = {c: [(r, x) for _, r, x in sorted(t, key=lambda y: tuple((z is not None, z) for z in y))] for c, t in talks.items()}
    out = {}
    for c, t in talks.items():
        longer = any(len(o) > len(t) and o[: len(t)] == t for o in talks.values())
        equal = [d for d, o in talks.items() if o == t]
        if not longer and c == min(equal, key=lambda d: (d is None, d)):
            out[c] = len(equal)
    return out


def _hash(word):
    """The shared word hash of one word, in plain integers."""
    from docloom.llm.common import _BYTES, BASE

    most = (1 << 64) - 1
    x = sum(int(_BYTES[b]) * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) & most
    return _mix(x)


def _mix(x):
    most = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
    x = (x ^ x >> 27) * 0x94D049BB133111EB & most
    return x ^ x >> 31


def chain(models, text):
    """Probabilities of a classifier chain for one text, word by word."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), (text or "").encode().translate(LOWER)))
    count = Counter()
    for w, n in Counter(words).items():
        for key in (_hash(w), *(_mix(_hash(w[:k]) + k & (1 << 64) - 1) for k in (4, 6))):
            count[key % (1 << 18)] += n
    out = []
    for m in models.models:
        z = m.bias + sum(e * p for e, p in zip(m.earlier, out, strict=True)) + sum(float(m.weight[s]) * min(n * 40 / max(len(words), 12), 1.0) for s, n in count.items())
        out.append(1 / (1 + math.exp(-z)))
    return out


def transport_stream(payload):
    """A payload as a transport stream packet by packet, and the feature of what it holds."""

    def crc(data):
        c = 0xFFFFFFFF
        for byte in data:
            for k in range(7, -1, -1):
                top = c >> 31 ^ byte >> k & 1
                c = c << 1 & 0xFFFFFFFF
                if top:
                    c ^= 0x04C11DB7
        return c.to_bytes(4, "big")

    def table(pid, body):
        body = body + crc(body)
        return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + body).ljust(188, b"\xff")

    out = [table(0, bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xF0, 0])), table(0x1000, bytes([2, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE1, 0, 0xF0, 0, 6, 0xE1, 0, 0xF0, 0]))]
    counter, units = 0, [payload[a : a + 36864] for a in range(0, len(payload), 36864)]
    for k, unit in enumerate(units):
        t = 126000 + 3600 * k
        stamp = bytes([0x20 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
        rest = b"\0\0\1\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + unit
        first = True
        while rest:
            field = b"\x50" + ((t - 3600) << 15 | 0x7E00).to_bytes(6, "big") if first else b""
            room = 184 - (len(field) + 1 if first else 0)
            if len(rest) < room:  # stuffing in the adaptation field
                fill = 184 - len(rest) - 1
                field = (field or (b"\0" if fill else b"")).ljust(fill, b"\xff")
                room = len(rest)
                adapted = True
            else:
                adapted = first
            head = bytes([0x47, 0x41 if first else 0x01, 0, (0x30 if adapted else 0x10) | counter])
            out.append(head + (bytes([len(field)]) + field if adapted else b"") + rest[:room])
            rest, counter, first = rest[room:], counter + 1 & 15, False
    n = len(units)
    return b"".join(out), f"programs=1;streams=1;packets={len(out)};units={n};pts=126000-{126000 + 3600 * (n - 1)};access={n};counter_errors=0"


def article_text(page):
    """Blocks of the article element of a page, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.raw, self.blocks, self.part = 0, 0, [], []

        def flush(self):
            text = " ".join("".join(self.part).split())
            self.blocks += [text] if text else []
            self.part = []

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style")
            self.depth += tag == "article"
            if tag in ("p", "h1", "h2", "h3", "ul", "li", "article", "div"):
                self.flush()
            elif tag == "br":
                self.part.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "h3", "ul", "li", "article", "div"):
                self.flush()
            self.depth -= tag == "article"
            self.raw -= tag in ("script", "style")

        def handle_data(self, data):
            if self.depth and not self.raw:
                self.part.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return "\n\n".join(reader.blocks)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: words} by weights in the order of code points, null last, with caps whose excess is shared out again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = [s for s in order if s not in capped]
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        want = {s: most * sizes[s] if s in capped else weight[s] * left / sum(weight[x] for x in rest) for s in order}
        over = [s for s in rest if want[s] > most * sizes[s]]
        if not over:
            return want
        capped.update(over)
