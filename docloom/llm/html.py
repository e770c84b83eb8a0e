"""HTML main text by union-free wrapper inference (operator 9).

A page is a token stream of tags and text.  Streams of one host are aligned one
after another into a wrapper, a union-free regular expression over elements:
where element sequences differ, the elements that only one side has become
optional, runs of like elements become a repeated group, and text becomes a
slot with its statistics.  Tasks fold their own pages first (one wrapper per
host and task), and wrappers are merged in two steps, one at a time from a
sorted stream, so a host with a third of all pages is no more than one wrapper
per task and never a group in memory.  A wrapper holds every group of its
host's pages, however rare (elements below ``DEPTH`` count as text of those
above); a task passes on a wrapper of many groups and begins anew, and very wide
elements are aligned by signature in place of order.  Alignment depends
on its order, that of tasks and of wrappers, so other partitions may give another
wrapper of pages that differ much.

The wrapper names the element of a host that holds its running text: text that
varies between pages counts in full, text that is the same on all pages or in a
left-out element a quarter, links against it, article and main elements double.
A page is then read once.  What is inside the named element is kept, or, on a
page without it, what is inside its article (or main) element, or else the
page.  Inside it, groups that are the same on all pages of the host or mostly
links are left out, and so is a container that is wholly named like a menu, notice,
advert, form or comments, unless it is, holds or is most of the article.

Every step is linear in the length of a page and has no recursion over it.

Defined cases: a null html is an empty page; an empty page, or one with nothing
but left-out parts, has the text ''; pages without a host share one wrapper;
unclosed and stray tags are tolerated at any depth; where a quote in a tag is
never closed, that tag and those behind it end at their first >; a tag without
> is text; repeated rows give repeated results; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A comment, a tag whose attributes hold no < or > (in a quote or not), text, or a < that opens none of these.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z][^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*>|[^<]+|<", re.S)
RAW = frozenset("script style noscript template textarea svg iframe".split())
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)(.*?)/?>\Z", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul option".split())
SPACES = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav footer aside form button select menu dialog noscript object audio video canvas map label input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer foot copyright ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies respond disqus "
    "search form toolbar pagination pager widget widgets masthead".split()
)
#: Words that may stand beside them in a name; a name with any other word says something else.
BESIDE = frozenset(
    "area article bar block body bottom box btn button buttons col column container content div entry fixed form foot group holder icon icons id inner inline item items js left link links list main module outer page "
    "panel post posts right row section site slot small sticky stories text title top unit ui wrap wrapper zone".split()
)
#: Elements that such a name leaves out.
CONTAINERS = frozenset("div section aside ul ol dl nav header footer form table center details figure span a iframe".split())
#: Of those, the words of what readers wrote: never most of an article.
TALK = frozenset("comment comments commentlist reply replies respond disqus".split())
CLOSED_BY = {"p": BLOCKS - {"option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Tag:
    """What a start tag says: its name, its signature, and whether its element is left out or holds an article."""

    __slots__ = ("name", "sign", "out", "hard", "talk", "header", "main")

    def __init__(self, name: str, attributes: str):
        got: dict[str, str] = {}
        if attributes and name != "a":
            for k, v in ATTRIBUTE.findall(attributes):
                got.setdefault(k.lower(), v.strip("\"'"))
        words: set[str] = set()
        for token in (got.get("class", "") + " " + got.get("id", "")).split():
            parts = {w.lower() for w in NAME.findall(token) if not w.isdigit()}
            if parts & WORDS and parts <= WORDS | BESIDE:
                words |= parts
        role = got.get("role", "").lower()
        self.name = name
        self.sign = name + ("." + ".".join(sorted(got["class"].split())) if got.get("class", "").strip() else "")
        self.main = 2 if name == "article" or got.get("itemprop", "").lower() == "articlebody" else 1 if name == "main" or role == "main" else 0
        self.hard = name in LEFT_OUT or role in ROLES
        self.out = self.hard or (name in CONTAINERS and bool(words))
        self.talk = bool(words & TALK)
        self.header = name == "header" or (name in CONTAINERS and bool(re.search(r"(?:^|[\s_-])header(?:$|[\s_-])", got.get("class", "") + " " + got.get("id", ""), re.I)))


def _end_of_tag(html: str, at: int) -> int:
    """Where the tag that starts at ``at`` ends, quotes observed; -1 if a quote or the tag never does."""
    at += 1
    while True:
        m = re.compile("[>\"']").search(html, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.end()
        at = html.find(m[0], m.end()) + 1
        if not at:
            return -1


def tokens(html: str, held: dict[str, tuple[int, Tag | None]] = {}) -> Iterator[tuple[int, object]]:  # noqa: B006
    """(0, text), (1, Tag) for a start, (-1, name) for an end; comments, scripts and the like are gone.

    Each character is looked at a bounded number of times: what was searched
    for once and is not in the rest of the page is not searched for again.
    """
    at, n = 0, len(html)
    quotes, last = True, html.rfind(">")
    while at < n:
        m = TOKEN.match(html, at)
        raw = m[0]
        if raw == "<":
            kind = html[at + 1 : at + 2]
            is_tag = kind.isalpha() and kind.isascii() or (kind == "/" and html[at + 2 : at + 3].isalpha()) or kind in ("!", "?") and kind
            if not is_tag or at > last:
                at += 1
                yield 0, raw
                continue
            end = _end_of_tag(html, at) if quotes and kind not in ("!", "?") else html.index(">", at) + 1
            if end < 0:
                quotes = False
                end = html.index(">", at) + 1
            raw = html[at:end]
            if kind in ("!", "?"):
                at = end
                continue
        at += len(raw)
        if raw[0] != "<":
            yield 0, raw
            continue
        got = held.get(raw)
        if got is None:
            t = TAG.match(raw)
            got = (0, None) if t is None else (-1, t[2].lower()) if t[1] else (1, Tag(t[2].lower(), t[3]))
            if len(raw) < 120:
                if len(held) > 20_000:
                    held.clear()
                held[raw] = got
        if got[0] == 1 and got[1].name in RAW:
            if not (got[1].name == "svg" and raw.endswith("/>")):
                close = re.compile(f"</{got[1].name}\\s*>", re.I).search(html, at)
                at = close.end() if close else n
        elif got[0]:
            yield got


# -- wrappers: [signature, pages, text, link text, optional, repeated, children, print, article] ---------


#: Levels of a wrapper; groups beside each other that are aligned in order, beyond which they are aligned by signature;
#: groups of the wrapper of a host that a task holds before it passes it on to be merged.
DEPTH, WIDTH, MOST_GROUPS = 60, 64, 4_000


class Open:
    """The open elements of a page, with the number of each name."""

    def __init__(self):
        self.names, self.count = [""], Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def pop(self) -> str:
        name = self.names.pop()
        self.count[name] -= 1
        return name

    def closed_by(self, name: str) -> int:
        """Leave the elements that the start of ``name`` ends; how many."""
        n = 0
        while len(self.names) > 1 and name in CLOSED_BY.get(self.names[-1], ()):
            self.pop()
            n += 1
        return n

    def end(self, name: str) -> int:
        """Leave the innermost open ``name`` and what is inside it; how many (0: it isn't open)."""
        n = 0
        if self.count[name]:
            n = 1
            while self.pop() != name:
                n += 1
        return n


def skeleton(html: str) -> list:
    """The element tree of a page as a wrapper of one page; inline markup counts as text."""
    root = ["", 1, 0, 0, False, False, [], 0, 0]
    stack, open_, links = [root], Open(), 0
    for kind, x in tokens(html):
        if kind == 0:
            n = len(x.strip())
            top = stack[min(len(stack), DEPTH) - 1]
            top[2] += n
            if n:
                top[7] = zlib.crc32(x.strip().encode("utf-8", "replace"), top[7])
            if links:
                top[3] += n
        elif kind == 1:
            if x.name == "a":
                links += 1
            elif x.name in BLOCKS or x.out:
                n = open_.closed_by(x.name)
                del stack[len(stack) - n :]
                node = [("!" if x.out else "") + x.sign, 1, 0, 0, False, False, [], 0, x.main]
                if len(stack) < DEPTH:
                    stack[-1][6].append(node)
                if x.name not in VOID:
                    stack.append(node)
                    open_.push(x.name)
        elif x == "a":
            links = max(0, links - 1)
        else:
            n = open_.end(x)
            del stack[len(stack) - n :]
    return fold(root)


def fold(node: list) -> list:
    """Runs of like children become one repeated group, from the leaves up (a skeleton has at most DEPTH levels)."""
    kids: list[list] = []
    for k in map(fold, node[6]):
        if kids and kids[-1][0] == k[0]:
            kids[-1] = align(kids[-1], k, same_page=True)
            kids[-1][5] = True
        else:
            kids.append(k)
    node[6] = narrow(kids)
    return node


def narrow(kids: list[list]) -> list[list]:
    """Beyond WIDTH groups beside each other, like ones anywhere become one; different ones all stay."""
    return _apart(kids) if len(kids) > WIDTH else kids


def _apart(kids: list[list]) -> list[list]:
    """One group of each signature."""
    by: dict[str, list] = {}
    for k in kids:
        if k[0] in by:
            by[k[0]] = align(by[k[0]], k, same_page=True)
            by[k[0]][5] = True
        else:
            by[k[0]] = k
    return list(by.values())


def prune(wrapper: list) -> list:
    """The wrapper with like groups beside each other made one wherever there are many; no group is lost."""
    wrapper[6] = narrow([prune(k) for k in wrapper[6]])
    return wrapper


def groups(node: list) -> int:
    return 1 + sum(map(groups, node[6]))


def _print(a: int, b: int, same_page: bool) -> int:
    """The print of a slot's text: of both of one page; of different pages if they agree, else -1 (it varies)."""
    if same_page:
        return -1 if -1 in (a, b) else zlib.crc32(b"%d" % b, a)
    return a if a == b else -1


def align(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper that covers both: like children are aligned, others become optional."""
    out = [a[0], max(a[1], b[1]) if same_page else a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] or b[4], a[5] or b[5], [], _print(a[7], b[7], same_page), max(a[8], b[8])]
    x, y = a[6], b[6]
    if [k[0] for k in x] == [k[0] for k in y]:
        out[6] = [align(p, q, same_page) for p, q in zip(x, y, strict=True)]
        return out
    if max(len(x), len(y)) > WIDTH:  # many groups: by signature, in linear time
        mine, theirs = ({k[0]: k for k in _apart(z)} for z in (x, y))
        out[6] = [align(k, theirs[s], same_page) if s in theirs else [*k[:4], True, *k[5:]] for s, k in mine.items()]
        out[6] += [[*k[:4], True, *k[5:]] for s, k in theirs.items() if s not in mine]
        return out
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            k, i, j = align(x[i], y[j], same_page), i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            k, i = [*x[i][:4], True, *x[i][5:]], i + 1
        else:
            k, j = [*y[j][:4], True, *y[j][5:]], j + 1
        if out[6] and out[6][-1][0] == k[0]:  # alignment has brought like groups together
            out[6][-1] = align(out[6][-1], k, True)
            out[6][-1][5] = True
        else:
            out[6].append(k)
    out[6] = narrow(out[6])
    return out


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    inside = ("#" if node[2] else "") + "".join(map(expression, node[6]))
    body = f"<{node[0]}>{inside}</>" if node[0] else inside
    mark = "*" if node[4] and node[5] else "?" if node[4] else "+" if node[5] else ""
    return f"({body}){mark}" if mark else body


def _article(node: list) -> bool:
    return bool(node[8]) or any(map(_article, node[6]))


def _weight(node: list, pages: int = 1) -> float:
    own = max(0, node[2] - 2 * node[3]) * (1 if pages < 2 or node[7] == -1 else 0.25)
    whole = own + sum(_weight(k, pages) for k in node[6])
    return whole * (2 if node[8] else 0.25 if node[0].startswith("!") and not _article(node) else 1)


def main_path(wrapper: list, share: float = 0.6) -> list[str]:
    """Signatures from the root to the element that holds the running text: down as long as one child has most of it.

    Where that way leads through an article or main element, it ends there.
    """
    path, node, pages, ends = [], wrapper, wrapper[1], [0, 0]
    while True:
        whole = sum(_weight(k, pages) for k in node[6]) + (max(0, node[2] - 2 * node[3]) * (1 if pages < 2 or node[7] == -1 else 0.25))
        down = [k for k in node[6] if not k[5] and whole and _weight(k, pages) >= share * whole]
        if not down or not down[0][6]:
            return path[: ends[1] or ends[0]] or path
        node = down[0]
        path.append(node[0].removeprefix("!"))
        if node[8]:
            ends[node[8] - 1] = len(path)


def constant_paths(wrapper: list, main: list[str], least: int = 3) -> list[list[str]]:
    """Paths inside the main element whose groups are the same on ``least`` pages and more, or mostly links."""
    kept, left = set(), set()

    def walk(node: list, path: tuple) -> tuple[int, int, bool]:
        text, links, varies = node[2], node[3], node[7] == -1
        for k in node[6]:
            t, n, v = walk(k, (*path, k[0].removeprefix("!")))
            text, links, varies = text + t, links + n, varies or v
        same = text and not varies
        (left if node[1] >= least and (same or links > 0.8 * text) and not node[8] else kept).add(path)
        return text, links, varies

    varies = walk(wrapper, ())[2]
    n = len(main)
    # Pages that are all copies of one have nothing that varies, and so nothing to leave out.
    return [list(p) for p in sorted(left - kept) if len(p) > n and list(p[:n]) == main] if varies and wrapper[1] >= least else []


# -- reading a page ---------------------------------------------------------------------------------------


class Paths:
    """Numbers of paths of block signatures: a path is its parent's number and a signature."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}

    def of(self, up: int, sign: str) -> int:
        return self.known.setdefault((up, sign), len(self.known) + 1)

    def find(self, signs) -> int:
        """-1 if the page has no such path."""
        at = 0
        for s in signs:
            at = self.known.get((at, s), -1)
        return at


def _parse(html: str) -> tuple[list[Tag | None], list[int], list[int], list[tuple[int, str | None]], Paths]:
    """Elements (tag, parent, number of its path of block signatures) and the text of each in order; None ends a block."""
    tags: list[Tag | None] = [None]
    parents, paths, items, known = [0], [0], [], Paths()
    stack, open_ = [0], Open()
    for kind, x in tokens(html):
        if kind == 0:
            items.append((stack[-1], x))
        elif kind == 1:
            name = x.name
            if name in BLOCKS:
                items.append((stack[-1], None))
                n = open_.closed_by(name)
                del stack[len(stack) - n :]
            elif name in SPACES:
                items.append((stack[-1], " "))
            if name in VOID:
                continue
            up = stack[-1]
            tags.append(x)
            parents.append(up)
            paths.append(known.of(paths[up], x.sign) if name in BLOCKS or x.out else paths[up])
            stack.append(len(tags) - 1)
            open_.push(name)
        else:
            if x in BLOCKS:
                items.append((stack[-1], None))
            n = open_.end(x)
            del stack[len(stack) - n :]
    return tags, parents, paths, items, known


MOSTLY = 0.6


def main_text(html: str, path: list[str] | None = None, drop: list[list[str]] | None = None) -> str:
    """The blocks of a page's article, two line ends between them."""
    tags, parents, paths, items, known = _parse(html)
    n = len(tags)
    size = [0] * n
    for e, t in items:
        if t:
            size[e] += len(t.strip())
    for e in range(n - 1, 0, -1):
        size[parents[e]] += size[e]
    # Whether an element or one above it is left out by name; a menu or page header that holds an article was never closed.
    soft, hard = [False] * n, [False] * n
    for e in range(1, n):
        up = parents[e]
        counts = tags[e].out and tags[e].name not in ("nav", "header")
        soft[e], hard[e] = soft[up] or counts, hard[up] or (counts and tags[e].hard)

    def chosen(found: list[bool]) -> list[int]:
        """The outermost candidates outside left-out elements, and those inside that have more text than all of these."""
        within = [False] * n
        clear, doubt, worse = [], [], []
        for e in range(1, n):
            within[e] = within[parents[e]] or found[parents[e]]
            if found[e] and not within[e]:
                (worse if hard[e] or tags[e].hard else doubt if soft[e] or tags[e].out else clear).append(e)
        whole = sum(size[e] for e in clear)
        return clear + [e for e in doubt if size[e] > whole] + [e for e in worse if size[e] > max(whole, size[0] / 2)]

    mains: list[int] = []
    wanted = known.find(path) if path else -1
    ways = [lambda e: paths[e] == wanted and paths[parents[e]] != wanted] if wanted > 0 else []
    for way in (*ways, lambda e: tags[e].main == 2, lambda e: tags[e].main == 1):
        mains = chosen([e > 0 and way(e) for e in range(n)])
        if mains and (size[0] == 0 or any(size[e] for e in mains)):
            break
    mains_set = set(mains)
    held = [e in mains_set for e in range(n)]
    for e in range(n - 1, 0, -1):
        held[parents[e]] = held[parents[e]] or held[e]
    left = {known.find(p) for p in drop or ()} - {-1}
    inside, out, most = [not mains] + [False] * (n - 1), [False] * n, [size[0]] * n
    for e in range(1, n):
        up, t = parents[e], tags[e]
        inside[e] = inside[up] or e in mains_set
        most[e] = size[e] if e in mains_set else most[up]
        header = t.header and not (mains and inside[up])
        is_most = inside[e] and not t.talk and (not t.hard or t.name in ("form", "fieldset")) and size[e] > MOSTLY * most[e] and t.out
        out[e] = out[up] or (not held[e] and not is_most and (t.out or header or (bool(mains) and paths[e] in left)))
    blocks: list[str] = []
    part: list[str] = []
    for e, t in (*items, (0, None)):
        if t is None:
            text = " ".join(unescape("".join(part)).split())
            if text:
                blocks.append(text)
            part.clear()
        elif inside[e] and not out[e]:
            part.append(t)
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """Lower-case host of a url, '' if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


HOSTS_HELD, SALTS = 2_000, 32


def _row(held: dict[tuple, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    for b in batches:
        for h, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            page, key = skeleton(html.as_py() or ""), (h,)
            held[key] = align(held[key], page) if key in held else page
            if held[key][1] % 64 == 0 and groups(held[key]) > MOST_GROUPS:
                yield _row({key: held.pop(key)})
            if len(held) > HOSTS_HELD:
                yield _row(held)
                held.clear()
    if held:
        yield _row(held)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All wrappers of a host (and share), which follow each other, aligned one after another."""
    key, got = None, None
    for b in batches:
        for *new, w in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if new != key:
                if got is not None:
                    yield _row({tuple(key): got})
                key, got = new, json.loads(w)
            else:
                got = align(got, json.loads(w))
    if got is not None:
        yield _row({tuple(key): got})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one wrapper for each host."""
    schema = "host string, wrapper string"
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_fold_pages, schema)
    # First by host and a share of the tasks, then by host.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).select("host", "salt", "wrapper")
    some = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_merge_batches, schema)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge_batches, schema)


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [json.loads(w.as_py()) for w in b.column(1)]
        paths = [main_path(w) for w in held]
        drops = [constant_paths(w, p) for w, p in zip(held, paths, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.list_(pa.string())), pa.array(drops, pa.list_(pa.list_(pa.string())))], ["host", "path", "drop"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py() or "", p, d) for h, p, d in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    scratch = Scratch(pages.sparkSession)
    paths = scratch.keep(wrappers(pages).mapInArrow(_path_batches, "host string, path array<string>, drop array<array<string>>"), "paths")
    # A left join on a small written table: Spark broadcasts it below its threshold and else splits a hot host.
    held = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host")).join(paths, "host", "left")
    return held.select("page_id", "url", "html", "path", "drop").mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
