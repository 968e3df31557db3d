"""Main text of web pages by wrapper induction.

Every page is read as a tree of block elements with its texts as leaves.  A
host's wrapper is learned from all of its pages (pages of equal trees count
once), and every page is extracted by its host's wrapper alone:

* Template nodes are the elements, by path from the root, that TEMPLATE_SHARE
  of the host's pages have.  (Simple tree matching pairs nodes only under
  paired parents of equal labels, so nodes that it pairs have equal paths.)
  Each is a place of content or not: not, where tag, role, class or id mark a
  menu, header, footer, sidebar, notice, advert, form, comments and the like,
  or where most of its own text on the host's pages is links.
* Constant leaves are the texts that keep their place on TEMPLATE_SHARE of the
  pages (on MARKED_PAGES at least inside a marked article, so that a few
  versions of one article aren't a template; else on two).  Candidates
  are leaves (path and text) found on so many pages; for each, the page that
  holds most of them is a reference, and the references are aligned with each
  page by simple tree matching: the matching of most nodes, children in order,
  found by dynamic programming.  A leaf counts where it is matched.
* What is left are the slots.  A leaf is content if it isn't constant and the
  nearest template node around it is a place of content; elements between them
  may be marked as above.  A host without template nodes yields no text.  Where
  a page marks its article (``article`` or ``main``), the slots inside are the
  content; an article that is constant in whole stays whole.

The trees are pruned to candidates before they are aligned.  Equal beginnings and ends of child lists
are paired at once, and long lists are aligned in a band that is widened until
no way outside can be better, so like lists cost their length.  Nothing
recurses: depth isn't bounded.  The tokenizer passes over a page once.

A host's references are bounded by its pages' size; a host with more than 1/64
of all pages (at most 64 of them) is spread over 64 parts for the alignment.
The wrappers are joined to the pages by host, one plan for any size.

Cases: a null or empty html gives the empty text; a null URL, or one without
``://``, belongs to host ''; a host of one page has that page's elements as its
template and no constant leaves; pages with equal ids are extracted one by one;
broken markup (unclosed or stray tags) is read as browsers do for paragraphs
and list items, a ``<`` that no tag follows is text; further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import table, write_table

TEMPLATE_SHARE = 0.5
#: Pages on which a leaf inside a marked article must be constant.
MARKED_PAGES = 3
#: Hosts with more than one in so many pages are spread over as many parts.
PARTS = 64
#: A table of an alignment has at most so many cells, or is a band of so many (4 bytes a cell).
TABLE_CELLS = 1_000_000
BAND_CELLS = 16_000_000
#: A matcher holds so many subtrees and pairs.
MATCHER_SIZE = 200_000

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style title textarea noscript iframe xmp".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the set ends an open element of the key, up to the nearest element of another kind.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
        "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: Elements whose content isn't shown as text of the page, or isn't the article's.
DROPPED = frozenset("head nav footer aside form button select option svg canvas object template dialog menu audio video map math fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar aside widget related recommended share sharing social breadcrumb "
    "breadcrumbs pagination pager menu nav navbar navigation footer contentinfo complementary search comment comments disqus respond reply replies "
    "skip toolbar masthead dialog".split()
)
HEADER_MARKS = frozenset("header banner masthead".split())

#: What an element is by its own tag, and by all the tags around it.
PLAIN, GONE, HEADER, ARTICLE, ARTICLE_HEADER = range(5)


def _kind(tag: str, attrs: str) -> tuple[int, str]:
    """The kind of an element and its class, for the label."""
    if tag in DROPPED:
        return GONE, ""
    kind = HEADER if tag == "header" else ARTICLE if tag in ("article", "main") else PLAIN
    name = ""
    if attrs and not attrs.isspace():
        words: set[str] = set()
        for m in ATTRIBUTE.finditer(attrs):
            key = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                words.update(re.split(r"[^a-z0-9]+", value))
                name = value if key == "class" else name
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return GONE, name
        if tag not in ("html", "body", "article", "main"):
            if words & HEADER_MARKS:
                kind = HEADER
            elif words & MARKS:
                kind = GONE
    return kind, name


def _within(around: int, kind: int, tag: str) -> int:
    """What an element is, from what its parent is and its own kind."""
    if around == GONE or kind in (GONE, ARTICLE):
        return GONE if around == GONE else kind
    inside = around in (ARTICLE, ARTICLE_HEADER)
    if kind == HEADER:
        return ARTICLE_HEADER if inside else HEADER
    return ARTICLE if inside and tag in HEADINGS else around


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, attributes or text): kind is ``text``, ``open`` or ``close``; comments, raw text and the like are left out."""
    at, n, last_end = 0, len(page), page.rfind(">")
    last = {q: page.rfind(q) for q in "\"'"}
    quoted = True  # until a tag has no end outside of quotes: from there on quotes are plain characters

    def tag_end(at: int) -> int:
        nonlocal quoted
        k = at
        while quoted and (m := STOP.search(page, k)):
            k = m.start()
            if m[0] == ">":
                return k
            k = page.find(m[0], k + 1) + 1 if last[m[0]] > k else k + 1
        quoted = False
        return page.find(">", at)

    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last_end:
            break
        if start > at:
            yield "text", "", page[at:start]
        nxt = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, start + 2 if nxt == "/" else start + 1)
        if not name:
            if nxt and nxt in "!?/":
                at = page.find(">", start) + 1
            else:
                yield "text", "", "<"
                at = start + 1
            continue
        end = tag_end(name.end())
        tag, attrs = name[0].lower(), page[name.end() : end]
        at = end + 1
        if nxt == "/":
            yield "close", tag, ""
        elif tag in RAW:
            found = RAW_END[tag].search(page, at)
            at = found.end() if found else n
        else:
            yield "open", tag, attrs
    if at < n:
        yield "text", "", page[at:]


class Item(NamedTuple):
    """An element (text is None; code: its path) or a leaf (code: path and text, odd inside a marked article), in page order."""

    depth: int
    code: int
    kind: int
    text: str | None
    linked: int


def parse(page: str | None) -> list[Item]:
    """The tree in page order, white space of texts made single."""
    paths: dict[tuple, int] = {}
    out = [Item(0, 0, PLAIN, None, 0)]
    stack: list[tuple[str, int, int]] = [("#root", 0, PLAIN)]  # tag, path, kind
    opened: dict[str, int] = {}  # open elements by tag
    inline: list[tuple[str, int]] = []  # open inline elements that hide their text, with the depth of their block
    run: list[str] = []
    link, linked = False, 0

    def flush() -> None:
        nonlocal link, linked
        text = " ".join("".join(run).split()) if run else ""
        if text:
            _, path, kind = stack[-1]
            code = xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "replace")) - 2**63
            out.append(Item(len(stack), code & ~1 | (kind == ARTICLE), kind, text, min(linked, len(text))))
        run.clear()
        link, linked = False, 0

    def cut(at: int) -> None:
        for tag, _, _ in stack[at:]:
            opened[tag] -= 1
        del stack[at:]
        while inline and inline[-1][1] > len(stack):
            inline.pop()

    for what, tag, more in tokens(page or ""):
        if what == "text":
            if not inline:
                text = entities.unescape(more) if "&" in more else more
                run.append(text)
                linked += len(text) if link else 0
        elif what == "close":
            if tag in BLOCKS or tag in DROPPED:
                if opened.get(tag):
                    flush()
                    cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                elif tag == "p":
                    flush()
            else:
                link = link and tag != "a"
                if inline and inline[-1][0] == tag:
                    inline.pop()
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS or tag in DROPPED:
            flush()
            ended, k = len(stack), len(stack) - 1
            while k > 0 and stack[k][0] in ENDS:
                if tag in ENDS[stack[k][0]]:
                    ended = k
                k -= 1
            cut(ended)
            if tag in VOID:
                continue
            own, name = _kind(tag, more)
            _, path, around = stack[-1]
            kind = _within(around, own, tag)
            label = (path, tag, name, kind)
            if label not in paths:
                paths[label] = xxhash.xxh3_64_intdigest(f"{path}\0{tag}\0{name}\0{kind}".encode("utf-8", "replace")) - 2**63
            out.append(Item(len(stack), paths[label], kind, None, 0))
            if not more.endswith("/") or tag not in ("svg", "canvas"):
                stack.append((tag, paths[label], kind))
                opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            link = True
        elif tag not in VOID and more and not more.endswith("/") and _kind(tag, more)[0] == GONE:
            inline.append((tag, len(stack)))
    flush()
    return out


def paths_of(items: list[Item]) -> dict[int, list[int]]:
    """Of each element path: its kind, and the characters and linked characters of the leaves right below."""
    out: dict[int, list[int]] = {}
    stack: list[int] = []
    for i in items:
        if i.text is None:
            del stack[i.depth :]
            stack.append(i.code)
            out.setdefault(i.code, [i.kind, 0, 0])
        else:
            own = out[stack[i.depth - 1]]
            own[1] += len(i.text)
            own[2] += i.linked
    return out


def pruned(items: list[tuple[int, int, bool]], keys: set[int]):
    """The tree of the leaves in ``keys`` and the elements around them: a leaf is its code, an element (path, children).

    ``items`` are (depth, code, is a leaf) in page order.  None without such leaves.
    """
    stack: list[tuple[int, list]] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            code, children = stack.pop()
            if children:
                stack[-1][1].append((code, children))

    top: list = []
    stack.append((0, top))  # holds the root
    for depth, code, leaf in items:
        close(depth + 1)
        if not leaf:
            stack.append((code, []))
        elif code in keys:
            stack[-1][1].append(code)
    close(1)
    return top[0] if top else None


class Matcher:
    """Simple tree matching: nodes match if their labels (a leaf's code, an element's path) are equal, so do their parents, and in order.

    Equal subtrees have one number; each pair of different ones is matched once.
    """

    def __init__(self):
        self.numbers: dict = {}
        self.labels: list = []  # by number; an element's label is (path,)
        self.children: list[tuple] = []
        self.whole: list[int] = []  # by number: the nodes of the subtree
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def _numbered(self, label, children: tuple) -> int:
        found = self.numbers.setdefault((label, children), len(self.labels))
        if found == len(self.labels):
            self.labels.append(label)
            self.children.append(children)
            self.whole.append(1 + sum(self.whole[c] for c in children))
        return found

    def number(self, tree) -> int:
        if isinstance(tree, int):
            return self._numbered(tree, ())
        out: list = []
        stack = [(tree, iter(tree[1]), out)]
        while stack:
            (label, _), rest, own = stack[-1]
            for c in rest:
                if not isinstance(c, int):
                    stack.append((c, iter(c[1]), []))
                    break
                own.append(self._numbered(c, ()))
            else:
                stack.pop()
                found = self._numbered((label,), tuple(own))
                if not stack:
                    return found
                stack[-1][2].append(found)
        raise AssertionError

    def score(self, a: int, b: int) -> int:
        """The nodes matched of two subtrees; those of their children must be known."""
        if a == b:
            return self.whole[a]
        if self.labels[a] != self.labels[b]:
            return 0
        return 1 if self._plain(a, b) else self.known[a, b][0]

    def _plain(self, a: int, b: int) -> bool:
        """Whether both are different elements around one leaf each: then only they match."""
        x, y = self.children[a], self.children[b]
        return len(x) == len(y) == 1 and not self.children[x[0]] and not self.children[y[0]]

    def solve(self, a: int, b: int) -> int:
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if x == y or (x, y) in self.known or self.labels[x] != self.labels[y] or self._plain(x, y):
                stack.pop()
                continue
            first, xs, ys, last = self._ends(self.children[x], self.children[y])
            by_label: dict = {}
            for d in set(ys):
                by_label.setdefault(self.labels[d], []).append(d)
            wanted = [(c, d) for c in set(xs) for d in by_label.get(self.labels[c], ()) if c != d and (c, d) not in self.known and not self._plain(c, d)]
            if wanted:
                stack += wanted
                continue
            pairs = first + self.aligned(xs, ys) + last
            self.known[x, y] = 1 + sum(self.score(*p) for p in pairs), pairs
            stack.pop()
        return self.score(a, b)

    @staticmethod
    def _ends(xs: tuple, ys: tuple) -> tuple[list, tuple, tuple, list]:
        """Equal first and last children, which are always a best pair, and what is between."""
        head = next((k for k, (x, y) in enumerate(zip(xs, ys)) if x != y), min(len(xs), len(ys)))  # noqa: B905
        first, xs, ys = [(x, x) for x in xs[:head]], xs[head:], ys[head:]
        tail = next((k for k, (x, y) in enumerate(zip(xs[::-1], ys[::-1])) if x != y), min(len(xs), len(ys)))  # noqa: B905
        last = [(x, x) for x in xs[len(xs) - tail :]]
        return first, xs[: len(xs) - tail], ys[: len(ys) - tail], last

    def aligned(self, xs: tuple, ys: tuple) -> list[tuple[int, int]]:
        """The pairs of equal labels, in order, that match most nodes."""
        common = {self.labels[x] for x in xs} & {self.labels[y] for y in ys}
        xs, ys = (tuple(c for c in own if self.labels[c] in common) for own in (xs, ys))
        first, xs, ys, last = self._ends(xs, ys)
        if not xs or not ys:
            return first + last
        n, m = len(xs), len(ys)
        if n * m <= TABLE_CELLS or min(n, m) == 1:
            return first + self._banded(xs, ys, n + m)[1] + last
        width = abs(n - m) + 64
        while width < n + m and n * min(m, 2 * width) <= BAND_CELLS:
            found, pairs = self._banded(xs, ys, width)
            # a way that leaves the band passes over more than ``width`` children of one side
            outside = max(sum(w) - (width + 1) * min(w) for w in ([self.whole[c] for c in own] for own in (xs, ys)))
            if found >= outside:
                return first + pairs + last
            width *= 4
        half = n // 2  # halves, which need one row of the table each
        both = self._last_row(xs[:half], ys) + self._last_row(xs[half:][::-1], ys[::-1])[::-1]
        at = int(both.argmax())
        return first + self.aligned(xs[:half], ys[:at]) + self.aligned(xs[half:], ys[at:]) + last

    def _gains(self, ys: tuple):
        places: dict[int, list[int]] = {}
        for k, y in enumerate(ys):
            places.setdefault(y, []).append(k)
        by_label: dict = {}
        for y, own in places.items():
            by_label.setdefault(self.labels[y], []).append((y, np.array(own)))
        held: dict[int, np.ndarray] = {}

        def of(x: int) -> np.ndarray:
            if x not in held:
                if len(held) * len(ys) > BAND_CELLS:
                    held.clear()
                held[x] = np.zeros(len(ys), np.int32)
                for y, own in by_label.get(self.labels[x], ()):
                    held[x][own] = self.score(x, y)
            return held[x]

        return of

    def _banded(self, xs: tuple, ys: tuple, width: int) -> tuple[int, list[tuple[int, int]]]:
        """The best score and its pairs, on ways where the places in both lists differ by at most ``width``."""
        gains, m = self._gains(ys), len(ys)
        low, row = 0, np.zeros(min(m, width) + 1, np.int32)  # row[k]: best with ys[: low + k]
        rows = [(low, row)]
        for i, x in enumerate(xs, 1):
            a, b = max(0, i - width), min(m, i + width)
            before = np.full(b - a + 2, row[-1], np.int32)  # places a - 1 .. b of the row before; beyond its end the value stays
            s, e = max(a - 1, low), low + len(row)
            before[s - a + 1 : e - a + 1] = row[s - low :]
            before[: s - a + 1] = 0
            new = before[1:].copy()
            taken = before[:-1].copy()
            taken[max(0, 1 - a) :] += gains(x)[max(a, 1) - 1 : b]
            if a == 0:
                taken[0] = 0
            np.maximum(new, taken, out=new)
            np.maximum.accumulate(new, out=new)
            low, row = a, new
            rows.append((low, row))
        pairs, i, j = [], len(xs), m
        while i and j:
            (a, row), (b, before) = rows[i], rows[i - 1]
            if j - a >= len(row):  # beyond the band the value stays
                j = a + len(row) - 1
                continue
            value = row[j - a]
            if value == (before[min(j - b, len(before) - 1)] if j >= b else 0):
                i -= 1
            elif j > a and value == row[j - a - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        return int(rows[-1][1][-1]), [p for p in pairs[::-1] if self.score(*p)]

    def _last_row(self, xs: tuple, ys: tuple) -> np.ndarray:
        gains, row = self._gains(ys), np.zeros(len(ys) + 1, np.int32)
        for x in xs:
            new = np.zeros(len(ys) + 1, np.int32)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains(x)), out=new[1:])
            row = new
        return row

    def leaves(self, a: int, b: int) -> Iterator[int]:
        """The codes of the leaves matched."""
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            if self.labels[x] != self.labels[y]:
                continue
            if not self.children[x] and not isinstance(self.labels[x], tuple):
                yield self.labels[x]
            elif x == y:
                stack += [(c, c) for c in self.children[x]]
            elif not self._plain(x, y):
                stack += self.known[x, y][1]


def match(a, b, matcher: Matcher | None = None) -> tuple[int, list[int]]:
    """Simple tree matching of two trees (see ``pruned``): the number of nodes matched, and the codes of the leaves matched."""
    matcher = matcher or Matcher()
    x, y = matcher.number(a), matcher.number(b)
    return matcher.solve(x, y), list(matcher.leaves(x, y))


class Wrapper(NamedTuple):
    """Of one host: the template nodes that hold content, the other ones, and the constant leaves."""

    content: frozenset
    other: frozenset
    constant: frozenset


def blocks_of(items: list[Item], wrapper: Wrapper) -> list[str]:
    """The texts of the article in page order."""
    marked: list[str] = []  # all texts of the marked article
    varying: list[str] = []  # those of them in slots
    slots: list[str] = []
    places: list[bool | None] = []  # of the open elements: whether the nearest template node holds content
    for i in items:
        if i.text is None:
            del places[i.depth :]
            around = places[-1] if places else None
            places.append(True if i.code in wrapper.content else False if i.code in wrapper.other else around)
            continue
        place = places[i.depth - 1]
        if place is None or i.kind not in (PLAIN, ARTICLE):
            continue
        slot = i.code not in wrapper.constant
        if i.kind == ARTICLE:
            marked.append(i.text)
            if slot:
                varying.append(i.text)
        elif slot and place:
            slots.append(i.text)
    return varying or marked or slots


#: The host of ``url``, A-Z lower-cased; the one rule for wrappers and pages.
HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def induce(pages: DataFrame) -> DataFrame:
    """The wrappers: a row (host, content, other, constant) of arrays for each host with any text, from all pages (url, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                read = [parse(h.as_py()) for h in part.column("html")]
                kept = [(h, items) for h, items in zip(part.column("host").to_pylist(), read, strict=True) if any(i.text is not None for i in items)]
                paths = [paths_of(items) for _, items in kept]
                # a tree's items: twice the depth, 1 more for leaves; the leaves of what is gone can't be content and are left out
                trees = [[i for i in items if i.text is None or i.kind in (PLAIN, ARTICLE)] for _, items in kept]
                yield pa.RecordBatch.from_pydict({
                    "host": pa.array([h for h, _ in kept], pa.string()),
                    "depths": pa.array([[2 * i.depth + (i.text is not None) for i in t] for t in trees], pa.list_(pa.int32())),
                    "codes": pa.array([[i.code for i in t] for t in trees], pa.list_(pa.int64())),
                    "paths": pa.array([[{"code": c, "kind": k, "n_chars": n, "linked": m} for c, (k, n, m) in own.items()] for own in paths],
                                      pa.list_(pa.struct([("code", pa.int64()), ("kind", pa.int32()), ("n_chars", pa.int64()), ("linked", pa.int64())]))),
                })

    schema = "host string, depths array<int>, codes array<long>, paths array<struct<code:long,kind:int,n_chars:long,linked:long>>"
    trees = pages.select(F.expr(HOST).alias("host"), "html").mapInArrow(read, schema)
    # copies of a page are one page; a page without leaves says nothing of the template
    distinct = trees.groupBy("host", F.xxhash64("depths", "codes").alias("id")).agg(F.first("depths").alias("depths"), F.first("codes").alias("codes"), F.max("paths").alias("paths"))
    distinct = write_table(distinct.withColumn("leaves", F.expr("array_distinct(filter(codes, (c, k) -> depths[k] % 2 = 1))")), "pages")
    n_pages = write_table(distinct.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")

    # template nodes; there are at most 1 / TEMPLATE_SHARE times those of a page
    seen = distinct.select("host", F.explode("paths").alias("p")).groupBy("host", "p.code", "p.kind").agg(F.count("*").alias("n"), F.sum("p.n_chars").alias("n_chars"), F.sum("p.linked").alias("linked"))
    place = F.expr(f"kind = {ARTICLE} OR kind = {PLAIN} AND 2 * linked <= n_chars")
    nodes = seen.join(n_pages, "host").where(f"n >= {TEMPLATE_SHARE} * n_pages").groupBy("host").agg(
        F.collect_set(F.when(place, F.col("code"))).alias("content"), F.collect_set(F.when(~place, F.col("code"))).alias("other"))

    # leaves that may be constant, as many at most, and for each the page that has the most of them
    often = f"n >= {TEMPLATE_SHARE} * n_pages AND n >= IF(key & 1 = 1, {MARKED_PAGES}, 2)"
    counted = distinct.select("host", F.explode("leaves").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    frequent = counted.join(n_pages, "host").where(often).groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("frequent"))
    frequent = write_table(frequent, "frequent")
    shared = distinct.join(frequent, "host").select("host", "id", F.array_intersect("leaves", "frequent").alias("own"))
    fullest = shared.select("host", "id", F.size("own").alias("n"), F.explode("own").alias("key")).groupBy("host", "key").agg(F.max(F.struct("n", "id")).alias("page"))
    chosen = fullest.select("host", "page.id").distinct()
    references = distinct.join(chosen, ["host", "id"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("depths", "codes"))).alias("references")).join(frequent, "host")

    # hosts with more than 1 / PARTS of the pages are fewer than PARTS
    total = n_pages.agg(F.sum("n_pages").alias("_all"))
    hot = F.broadcast(n_pages.join(F.broadcast(total), F.expr(f"n_pages > _all / {PARTS}D")).select("host", F.lit(PARTS).alias("_parts")))
    dealt = distinct.join(hot, "host", "left").withColumn("part", F.expr("pmod(id, coalesce(_parts, 1))"))
    spread = references.join(hot, "host", "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(_parts, 1) - 1L)")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(depths: list[int], codes: list[int], keys: set[int]):
            return pruned([(d >> 1, c, bool(d & 1)) for d, c in zip(depths, codes, strict=True)], keys)

        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            known: dict[str, tuple[set, list]] = {}
            matcher = Matcher()
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k, host in enumerate(columns["host"].to_pylist()):
                if host not in known:
                    keys = set(columns["frequent"][k].as_py())
                    known[host] = keys, [tree(r["depths"], r["codes"], keys) for r in columns["references"][k].as_py()]
                keys, own = known[host]
                page = tree(columns["depths"][k].as_py(), columns["codes"][k].as_py(), keys)
                if page is None:
                    continue
                for key in {x for r in own for x in match(r, page, matcher)[1]}:
                    counts[host, key] = counts.get((host, key), 0) + 1
                if len(matcher.labels) + len(matcher.known) > MATCHER_SIZE:
                    matcher = Matcher()
            hosts, keys = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "key": pa.array(keys, pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    same = dealt.join(spread, ["host", "part"]).select("host", "depths", "codes", "references", "frequent").mapInArrow(align, "host string, key long, n long")
    kept = same.groupBy("host", "key").agg(F.sum("n").alias("n")).join(n_pages, "host").where(often)
    constant = kept.groupBy("host").agg(F.collect_list("key").alias("constant"))
    return write_table(nodes.join(constant, "host", "left"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = [], {}
            sets = [batch.column(c) for c in Wrapper._fields]
            for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
                if host not in known:
                    known[host] = Wrapper(*[frozenset(s[k].as_py() or ()) for s in sets])
                texts.append("\n\n".join(blocks_of(parse(page.as_py()), known[host])))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    named = pages.select("page_id", "url", "html", F.expr(HOST).alias("host")).join(wrappers, "host", "left")
    return named.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, induce(pages))
