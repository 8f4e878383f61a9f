"""Main text of web pages: markup regions plus repeated runs found by host suffix arrays.

1. Each page is cut into blocks of text with the region they stand in. Menus, page headers,
   footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by
   their elements, roles and class or id names (whole names of a closed form). ``article`` and
   ``main`` are not judged by their names; one inside a wrapper left out counts if the page has no
   other, unless the wrapper is for comments, adverts, shares or related texts.
2. If a page marks its article (``article``, else ``main``), the text is the blocks in it. Runs
   repeated there are content - several pages may carry one article or quote one passage - so they
   are not cut: taken alone the method would drop them, which is wrong.
3. On every page a run of ``RUN`` tokens that occurs in at least ``MIN_PAGES`` distinct pages of the
   whole host, however large, is repeated, and every token that such a run covers is covered. Pages
   that mark their article and pages that don't are counted apart. Pages without such marks keep the
   blocks not covered for ``MAX_COVERED`` or more; if nothing would be left, all blocks stay. On pages
   with marks the marks have the last word; ``n_repeated`` gives the covered tokens of the text, so
   whoever wants repeated texts out can see them.

Pages are read once and dealt once, by host and bucket (a hash of the page, so equal pages meet);
what a task has of a bucket travels as one compressed value, equal pages in it once. Bucket sizes
come from a first pass over url and size of html alone. All later steps read that one exchange:

* A bucket's distinct pages are concatenated and their suffixes sorted by their first ``RUN`` tokens
  (a suffix array by prefix doubling, stopped at that length, which is all that telling runs of
  ``RUN`` tokens apart needs): the bucket's distinct runs with their numbers of pages. A host with one
  bucket is done with that.
* Else the numbers are summed over the host's buckets under small hashes first, a number below
  ``GROUP_CHARS`` times the buckets (about eight values a token), which sorted and compressed take
  little more than a byte a run. A run that stays under the limit here does so in truth.
* The others are summed once more under 64-bit hashes; those that reach the limit go back to the
  buckets that hold them, where the pages are cut one by one.

So buckets and tasks decide only how much is combined before the sums, never what is boilerplate.
Sums are dealt by host and part of the hashes, as many parts as the host needs; a row there is what
one bucket has in one part. Sizes are kept for ``CELLS`` hash cells of hosts: that table has a bounded
number of rows and is broadcast. A task holds one bucket at a time (about ``GROUP_CHARS`` bytes of
html, or one longer page), before dealing up to ``HELD_CHARS`` characters. Page ids and urls of equal
pages stay lists until the last step, which makes them rows.

Defined results: a null or empty html gives the empty text; a null url counts as the host "".
Repeated rows give repeated result rows, and equal pages count as one page for repeats. The reader's
time grows with the page, however long and however many elements it leaves open. An empty table
gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import map_batches

GROUP_PAGES = 4096
GROUP_CHARS = 4_000_000
HELD_CHARS = 32_000_000
PART = 4 * GROUP_CHARS              # small hashes in a part
CELLS = 1 << 18
RUN = 8
MIN_PAGES = 3
MAX_COVERED = 0.8

# Element and class names by their part on a page.
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "title", "select",
        "object", "canvas", "math"}
_OUT = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "label"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd",
          "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
          "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend",
          "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
          "td", "tfoot", "th", "thead", "tr", "ul"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
          "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CLASSES = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer",
            "masthead", "sidebar", "ad", "ads", "advert", "adverts", "advertisement", "sponsor",
            "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
            "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
            "subscription", "signup", "login", "comment", "comments", "disqus", "respond",
            "replies", "share", "sharing", "social", "related", "recommended", "widget", "pager",
            "pagination"}
# A class or id marks its element out only as a whole name: one of the words above, after one of
# _BEFORE and before words or _AFTER at most ("site-footer", "share-box", "nav__list", but not
# "has-sidebar", "comments-open", "tag-ads" or "elementor-widget-theme-post-content").
_BEFORE = ("site", "page", "main", "top", "bottom", "primary", "secondary", "global", "mobile",
           "post", "entry", "article", "reader", "user")
_AFTER = ("area", "bar", "block", "box", "buttons?", "container", "content", "count", "form",
          "icons?", "inner", "items?", "left", "links?", "list", "outer", "panel", "posts?",
          "right", "section", "slot", "title", "toggle", "unit", "wrap", "wrapper", r"\d+")
_WORD = "|".join(sorted(_CLASSES))
_NAME = re.compile(rf"(?:(?:{'|'.join(_BEFORE)})[-_])?({_WORD})"
                   rf"(?:[-_]{{1,2}}(?:{_WORD}|{'|'.join(_AFTER)}))*(?:--[a-z0-9-]+)?")
# Words of elements that hold other people's or other pages' texts, also if those are articles.
_OTHERS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo",
           "comment", "comments", "disqus", "respond", "replies", "related", "recommended",
           "share", "sharing", "social"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.IGNORECASE) for t in _RAW}


@dataclass
class Block:
    """A stretch of text between block borders; ``held``: in a marked-out wrapper of an article."""

    text: str
    article: bool
    main: bool
    held: bool = False


@dataclass
class _Open:
    name: str
    out: bool
    final: bool = False          # no article in it is the page's


@dataclass
class _Reader:
    """Open elements as a stack, with what is asked of it kept beside it, so that every tag costs
    the same however many elements are open."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)   # of each name, rising
    borders: list[int] = field(default_factory=list)             # places of block elements
    n_out: int = 0

    def is_open(self, name: str) -> bool:
        return bool(self.places.get(name))

    def push(self, element: _Open) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places.setdefault(element.name, []).append(at)
        if element.name in _BLOCK:
            self.borders.append(at)
        self.n_out += element.out

    def pop(self) -> None:
        element = self.stack.pop()
        self.places[element.name].pop()
        self.n_out -= element.out
        self.drop_nameless()

    def drop_nameless(self) -> None:
        while self.stack and not self.stack[-1].name:
            self.stack.pop()
        while self.borders and (self.borders[-1] >= len(self.stack)
                                or not self.stack[self.borders[-1]].name):
            self.borders.pop()

    def forget_heads(self) -> None:
        """Heads end where the body begins; one below other open elements stays as a nameless
        place until those are closed."""
        for at in self.places.pop("head", ()):
            self.n_out -= self.stack[at].out
            self.stack[at] = _Open("", False)
        self.drop_nameless()

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                self.blocks.append(Block(text, self.is_open("article"), self.is_open("main"),
                                         self.n_out > 0))

    def open(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self.end_block()
            if any(x.name == "p" for x in self.stack[-4:]) and name not in ("html", "body"):
                self.close("p")
        if name in ("article", "main"):      # menus and page headers left open end here
            while self.stack and self.stack[-1].out and self.stack[-1].name in ("nav", "header",
                                                                                 "head"):
                self.pop()
        if name == "body" and self.is_open("head"):
            self.forget_heads()
        if name in _VOID:
            self.parts.append(" ")
            return
        last = self.stack[-1] if self.stack else _Open("", False)
        out = name in _OUT or (name == "header" and not self.is_open("article"))
        final = out and name not in ("form", "dialog")
        if attributes and not out and name not in ("html", "body", "main", "article"):
            out, final = _marked_out(attributes)
        if name in ("article", "main") and last.out and not last.final:
            out, last = False, _Open("", False)      # what marks a wrapper doesn't mark these
        self.push(_Open(name, out or last.out, final or last.final))

    def close(self, name: str) -> None:
        if name in _BLOCK:
            self.end_block()
        at = self.places[name][-1] if self.is_open(name) else -1
        if name not in _BLOCK and self.borders and self.borders[-1] > at:
            return                           # an inline end tag does not end blocks
        if at >= 0:
            while len(self.stack) > at:
                self.pop()
        elif name == "br":
            self.parts.append(" ")

    def text(self, text: str) -> None:
        if not (self.stack and self.stack[-1].out):
            self.parts.append(text)


def _marked_out(attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether an article in it is left out too."""
    out = False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            return True, True
        out |= name == "role" and value in _ROLES
        if name in ("class", "id"):
            for match in map(_NAME.fullmatch, value.split()):
                if match and match[1] in _OTHERS:
                    return True, True
                out |= match is not None
    return out, False


def marked_blocks(blocks: list[Block]) -> list[Block] | None:
    """The blocks of the article, if a page marks it; one in a marked-out wrapper comes last."""
    for held in (False, True):
        own = [b for b in blocks if b.held == held]
        marked = [b for b in own if b.article] or [b for b in own if b.main]
        if marked:
            return marked
    return None if blocks else []


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page outside the regions that are left out, in page order."""
    reader, at = _Reader(), 0
    match = _TAG.search(page)
    while match:
        if match.start() > at:
            reader.text(page[at:match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if name:
            if match[1] or match[4]:
                reader.close(name)
            elif name in _RAW:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            else:
                reader.open(name, match[3] or match[6] or "")
        match = _TAG.search(page, at)
    reader.text(page[at:])
    reader.end_block()
    return reader.blocks


def counted_runs(tokens: np.ndarray, page: np.ndarray,
                 run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array cut at ``run`` tokens: the places where a run of one page begins, each
    run's number, and the number of distinct pages of each run.

    ``tokens``: ids of the concatenated streams; ``page``: the page of each, ascending. Ranks of
    suffixes by their first 1, 2, 4, ... tokens come from sorting pairs of ranks.
    """
    if len(tokens) < run:
        return (np.zeros(0, np.int64),) * 3
    rank, length = tokens.astype(np.int64), 1
    while length < run:
        step = min(length, run - length)          # the last step may overlap
        pair = rank[:len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        length += step
    same_page = page[:len(rank)] == page[run - 1:run - 1 + len(rank)]
    at = np.flatnonzero(same_page)
    order = at[np.lexsort((page[at], rank[at]))]
    if len(order) == 0:
        return (np.zeros(0, np.int64),) * 3
    r, p = rank[order], page[order]
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
    return order, r, np.bincount(r, weights=first).astype(np.int64)


def _covered(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, run: int = RUN,
                    min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that occurs in ``min_pages`` distinct pages."""
    order, r, pages = counted_runs(tokens, page, run)
    return _covered(order[pages[r] >= min_pages], len(tokens), run)


def run_hashes(tokens: np.ndarray, words: list[str]) -> np.ndarray:
    """A 64-bit hash of the ``RUN`` tokens from each place on; ``words`` has the word of each id."""
    n = max(len(tokens) - RUN + 1, 0)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[tokens]
    out = np.full(n, RUN, np.uint64)
    for i in range(RUN if n else 0):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def unique_blocks(blocks: list[str], covered: np.ndarray) -> list[str]:
    """The blocks not covered for ``MAX_COVERED`` or more; all, if none is left."""
    return [b for b, _ in _unique(_block_cover(blocks, covered))]


def _block_cover(blocks: list[str], covered: np.ndarray) -> list[tuple[str, int]]:
    """The blocks, each with its number of covered tokens."""
    total, at, out = np.concatenate(([0], np.cumsum(covered))).tolist(), 0, []
    for b in blocks:
        n = b.count(" ") + 1
        out.append((b, total[at + n] - total[at]))
        at += n
    return out


def _unique(cover: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return [(b, n) for b, n in cover if n < MAX_COVERED * (b.count(" ") + 1)] or cover


def main_texts(pages: list[str]) -> list[str]:
    """The main text of every page of one group of a host."""
    blocks = [page_blocks(p) for p in pages]
    chosen: list[list[Block] | None] = []
    for own in blocks:
        chosen.append(marked_blocks(own))
    found = [None if c is None else [b.text for b in c] for c in chosen]
    if any(c is None for c in found):
        texts = [tuple(b.text for b in own) for own in blocks]
        distinct = list(dict.fromkeys(texts))
        words = [" ".join(own).split(" ") if own else [] for own in distinct]
        tokens, page = _streams(words)
        covered = repeated_tokens(tokens, page)
        cut, at = {}, 0
        for own, w in zip(distinct, words):
            cut[own] = unique_blocks(list(own), covered[at:at + len(w)])
            at += len(w)
        found = [cut[own] if c is None else c for c, own in zip(found, texts)]
    return ["\n".join(c) for c in found]


def _streams(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated token numbers of pages of words, and the page of each token."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for p in pages for w in p), np.int64)
    return ids, np.repeat(np.arange(len(pages)), [len(p) for p in pages])


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of each host and bucket, as one compressed Arrow stream of distinct pages: blocks,
    ``own`` (places of the marked article's blocks, null if the page marks none), and the ids and
    urls of the equal pages. Marked pages get a host key of their own."""
    def packed():
        pages = []
        for own in held.values():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([text for _, text in own], pa.large_string()),
                 pa.array([places for places, _ in own], pa.list_(pa.int32())),
                 pa.array([ids for ids, _ in own.values()], pa.list_(pa.int64())),
                 pa.array([urls for _, urls in own.values()], pa.list_(pa.string()))],
                names=["text", "own", "page_id", "url"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema,
                                   options=pa.ipc.IpcWriteOptions(compression=_codec())) as out:
                out.write_batch(batch)
            pages.append(sink.getvalue().to_pybytes())
        keys = [pa.array(k, pa.int64()) for k in zip(*held)]
        return pa.RecordBatch.from_arrays(keys + [pa.array(pages, pa.binary())],
                                          names=["host", "bucket", "buckets", "pages"])

    held, size = {}, 0
    for batch in batches:
        for host, buckets, page_id, url, page in zip(*(batch.column(c).to_pylist() for c in (
                "host", "buckets", "page_id", "url", "html"))):
            blocks = page_blocks(page or "")
            marked, own = marked_blocks(blocks), None
            if marked is not None:
                chosen = set(map(id, marked))
                own = tuple(i for i, b in enumerate(blocks) if id(b) in chosen)
            text = "\n".join(b.text for b in blocks)              # no block has a line break
            bucket = xxhash.xxh3_64_intdigest(f"{own}\n{text}") % buckets
            group = held.setdefault((host if own is None else ~host, bucket, buckets), {})
            ids, urls = group.setdefault((own, text), ([], []))
            ids.append(page_id)
            urls.append(url)
            size += len(text) + 100
            if size > HELD_CHARS:
                yield packed()
                held, size = {}, 0
    if held:
        yield packed()


@dataclass
class _Group:
    """The distinct pages of a host and bucket, with their tokens in one stream."""

    buckets: int
    pages: dict[tuple, tuple[list, list]]       # (own, text) -> ids, urls
    tokens: np.ndarray
    page: np.ndarray
    words: list[str]

    @classmethod
    def read(cls, table: pa.Table) -> _Group:
        pages: dict[tuple, tuple[list, list]] = {}
        for value in table.column("pages"):
            got = pa.ipc.open_stream(value.as_buffer()).read_all()
            for text, own, ids, urls in zip(*(got.column(c).to_pylist() for c in got.column_names)):
                own = None if own is None else tuple(own)
                held = pages.setdefault((own, text), ([], []))
                held[0].extend(ids)
                held[1].extend(urls)
        texts = pa.array([text for _, text in pages], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        return cls(table.column("buckets")[0].as_py(), pages,
                   coded.indices.to_numpy().astype(np.int64),
                   np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())),
                   coded.dictionary.to_pylist())

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The places where a run of one page begins, and the hashes of all places."""
        h = run_hashes(self.tokens, self.words)
        return np.flatnonzero(self.page[:len(h)] == self.page[RUN - 1:]), h

    def small(self, h: np.ndarray) -> np.ndarray:
        return h % np.uint64(self.buckets * GROUP_CHARS)


_SHARE = "host long, part long, bucket long, size int, keys binary, n binary"
_FOUND = "host long, bucket long, size int, keys binary"


def _pack(keys: np.ndarray) -> bytes:
    """Rising 64-bit numbers as compressed differences, their lowest bytes first."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _codec().compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpack(rows: pa.Table) -> list[np.ndarray]:
    out = []
    for size, keys in zip(rows.column("size").to_pylist(), rows.column("keys").to_pylist()):
        steps = np.frombuffer(_codec().decompress(keys, 8 * size, asbytes=True), np.uint8)
        out.append(np.cumsum(np.ascontiguousarray(steps.reshape(8, size).T).view("<u8").ravel()))
    return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind])
                     for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _shares(key: tuple, keys: np.ndarray, small: np.ndarray, n: np.ndarray) -> pa.Table:
    """A bucket's rising ``keys`` with their numbers of pages, dealt into parts by small hashes."""
    part, rows = (small // np.uint64(PART)).astype(np.int64), []
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    for at, own in zip(parts.tolist(), np.split(order, first[1:])):
        few = np.minimum(n[own], MIN_PAGES).astype(np.uint8).tobytes()
        rows.append((key[0].as_py(), at, key[1].as_py(), len(own), _pack(keys[own]),
                     _codec().compress(few, asbytes=True)))
    return _table(rows, _SHARE)


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """The small hashes of a bucket's runs, with their numbers of pages."""
    if table.column("buckets")[0].as_py() == 1:          # nothing to sum
        return _table([], _SHARE)
    group = _Group.read(table)
    order, r, n = counted_runs(group.tokens, group.page)
    numbers, first = np.unique(r, return_index=True)
    small, at = np.unique(group.small(group.hashes()[1][order[first]]), return_inverse=True)
    return _shares(key, small, small, np.bincount(at, n[numbers], len(small)))


def _total(key: tuple, table: pa.Table) -> pa.Table:
    """The keys of a part that reach ``MIN_PAGES`` over the buckets, for each bucket its own."""
    keys = _unpack(table)
    n = [np.frombuffer(_codec().decompress(few, size, asbytes=True), np.uint8) for size, few in zip(
        table.column("size").to_pylist(), table.column("n").to_pylist())]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    repeated = (np.bincount(at, np.concatenate(n)) >= MIN_PAGES)[at]
    rows, begin = [], 0
    for bucket, own in zip(table.column("bucket").to_pylist(), keys):
        found = own[repeated[begin:begin + len(own)]]
        begin += len(own)
        if len(found):
            rows.append((key[0].as_py(), bucket, len(found), _pack(found)))
    return _table(rows, _FOUND)


def _confirm(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
    """The 64-bit hashes of a bucket's runs with one of the small hashes found."""
    if not found.num_rows:
        return _table([], _SHARE)
    group = _Group.read(table)
    at, h = group.hashes()
    at = at[np.isin(group.small(h[at]), np.concatenate(_unpack(found)))]
    at = at[np.lexsort((group.page[at], h[at]))]
    h, page = h[at], group.page[at]
    other = np.concatenate(([True], h[1:] != h[:-1]))
    first = other | np.concatenate(([True], page[1:] != page[:-1]))
    keys = h[other]
    return _shares(key, keys, group.small(keys),
                   np.bincount(np.cumsum(other) - 1, first, len(keys)))


def _cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
    """The texts of a bucket's distinct pages."""
    group = _Group.read(table)
    if group.buckets == 1:
        covered = repeated_tokens(group.tokens, group.page)
    else:
        at, h = group.hashes()
        known = np.concatenate([np.zeros(0, np.uint64), *_unpack(found)])
        covered = _covered(at[np.isin(h[at], known)], len(group.tokens), RUN)
    begin = np.searchsorted(group.page, np.arange(1, len(group.pages)))
    texts, repeated = [], []
    for (own, text), part in zip(group.pages, np.split(covered, begin)):
        cover = _block_cover(text.split("\n") if text else [], part)
        kept = _unique(cover) if own is None else [cover[i] for i in own]
        texts.append("\n".join(b for b, _ in kept))
        repeated.append(sum(n for _, n in kept))
    ids, urls = zip(*group.pages.values())
    return pa.table([pa.array(ids, pa.list_(pa.int64())), pa.array(urls, pa.list_(pa.string())),
                     pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                     pa.array(repeated, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_repeated"])


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_repeated (tokens of the text
    in runs that the host repeats)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    source = (pages.select(F.col("page_id").cast("long"), "url", "html",
                           F.xxhash64(host).alias("host"))
              .withColumn("cell", F.pmod("host", F.lit(CELLS))))
    sizes = (source.groupBy("cell")                                     # at most CELLS rows
             .agg(F.greatest(F.ceil(F.count(F.lit(1)) / group_pages),
                             F.ceil(F.sum(F.octet_length("html")) / GROUP_CHARS)).alias("buckets")))
    groups = map_batches(
        source.join(F.broadcast(sizes), "cell").select("host", "buckets", "page_id", "url", "html"),
        _parse, "host long, bucket long, buckets long, pages binary").groupBy("host", "bucket")
    small = (groups.applyInArrow(_count, _SHARE)
             .groupBy("host", "part").applyInArrow(_total, _FOUND))
    repeated = (groups.cogroup(small.groupBy("host", "bucket")).applyInArrow(_confirm, _SHARE)
                .groupBy("host", "part").applyInArrow(_total, _FOUND))
    cut = groups.cogroup(repeated.groupBy("host", "bucket")).applyInArrow(
        _cut, "page_id array<long>, url array<string>, text string, n_chars long, n_repeated long")
    return cut.select(F.inline(F.arrays_zip("page_id", "url")), "text", "n_chars", "n_repeated")
