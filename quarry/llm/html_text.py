"""Main text of web pages by nearest-URL page differencing.

A page becomes text lines, one for each block, in page order. Pages of a host are ordered by URL path, and each is paired
with the neighbour whose path shares the longer prefix with its own; the two pages' lines are aligned by
longest common subsequence, and lines in it are shared: template, not text. Lines inside elements that
say what they are (nav, footer, aside, form, classes such as `ad` or `comments`) go in any case, since such lines often differ from page to
page; lines inside an element that says it is the article stay even if shared, since an article may
repeat another's line. Differencing decides on all others.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import small, written

#: Pages of a block in the order of URLs; each block also gets its outer neighbours.
BLOCK = 512
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noframes".split())
CHROME = frozenset("nav header footer aside form button select menu svg canvas object audio video dialog head".split())
SPACED = frozenset("br td th".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark an element as not being text.
MARKS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header footer sidebar aside cookie cookies consent notice notices popup modal overlay comment comments disqus share sharing social related recommended newsletter subscribe signup login toolbar pagination pager widget masthead contentinfo complementary search".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
UNDECIDED, TEXT, OUT = 0, 1, 2


def marked(attrs: str) -> bool:
    """Whether the attributes mark an element as hidden, or by a word of MARKS in class, id or role."""
    for name, value in ATTR.findall(attrs):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
        if any(w in MARKS for w in re.split(r"[^a-z]+", value)):
            return True
    return False


def lines(html: str | None) -> list[tuple[str, int]]:
    """(text, UNDECIDED, TEXT or OUT) of each block with text."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    out_of: list[str] = []  # open elements inside an element that is not text, that one first
    inside = at = 0
    html = html or ""

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, OUT if out_of else TEXT if inside else UNDECIDED))

    while (m := TAG.search(html, at)) is not None:
        parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        close, tag, attrs = bool(m[1]), m[2].lower(), m[3]
        if tag in BLOCKS or tag in CHROME:
            flush()
        elif tag in SPACED:
            parts.append(" ")
        if tag in RAW and not close:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif out_of:
            if not close and tag == out_of[0] and not attrs.endswith("/"):
                out_of.append(tag)
            elif close and tag == out_of[0]:
                flush()
                out_of.pop()
        elif not close and tag not in VOID and not attrs.endswith("/") and ((tag in CHROME and not (tag == "header" and inside)) or (tag not in ("html", "body", *CONTENT) and "=" in attrs and marked(attrs)) or (tag not in ("html", "body") and "hidden" in attrs and marked(attrs))):
            flush()
            out_of.append(tag)
        elif tag in CONTENT:
            inside = inside + 1 if not close else max(0, inside - 1)
    parts.append(html[at:])
    flush()
    return out


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; the path without scheme, fragment, index suffix or closing slash, with the query."""
    try:
        u = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return (u.netloc.lower(), re.sub(r"\.html?$", "", u.path).rstrip("/") + (f"?{u.query}" if u.query else ""))


def shared(a: list[int], b: list[int]) -> set[int]:
    """The hashes that a longest common subsequence of a and b holds (bit-parallel table, then traced back)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    kept = set(a[:lo]) | (set(a[-hi:]) if hi else set())
    common = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x, y = ([v for v in s[lo : len(s) - hi] if v in common] for s in (a, b))
    if not x or not y:
        return kept
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | (1 << j)
    full, row, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
    for v in x:  # a zero bit of a row: the subsequence grows at that column
        u = row & where[v]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    length = lambda i, j: (j - (rows[i - 1] & ((1 << j) - 1)).bit_count()) if i else 0
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            kept.add(x[i - 1])
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return kept


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _version(hashes: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array(hashes, np.int64).tobytes()) - (1 << 63)


def _outline(batches):
    for batch in batches:
        where = [address(u) for u in batch.column(0).to_pylist()]
        found = [[_hash(t) for t, _ in lines(h)] for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in where], pa.string()), "path": pa.array([p for _, p in where], pa.string()), "version": pa.array([_version(x) for x in found], pa.int64()), "lines": pa.array(found, pa.list_(pa.int64()))})


def _numbered(batches):
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), *batch.columns], ["part", "row", "host", "path", "version", "lines"])
        row += n


def _paired(batches):
    """Rows sorted by (block, place): the block's own pages with the lines they share with their neighbour."""

    def out(rows):
        # the nearest row on either side that has another address
        before = [-1] * len(rows)
        after = [len(rows)] * len(rows)
        for i in range(1, len(rows)):
            before[i] = before[i - 1] if rows[i][1:3] == rows[i - 1][1:3] else i - 1
        for i in range(len(rows) - 2, -1, -1):
            after[i] = after[i + 1] if rows[i][1:3] == rows[i + 1][1:3] else i + 1
        found = []
        for i, (own, host, path, version, mine) in enumerate(rows):
            near = [rows[j] for j in (before[i], after[i]) if 0 <= j < len(rows) and rows[j][1] == host]
            if own and near and host:
                same = shared(mine, max(near, key=lambda r: _prefix(r[2], path))[4])
                if same:
                    found.append((host, path, version, sorted(same)))
        columns = [list(x) for x in zip(*found)] or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["host", "path", "version", "shared"])

    block, held = None, []
    for batch in batches:
        for b, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block and held:
                yield out(held)
                held = []
            block = b
            held.append(row)
    if held:
        yield out(held)


def shared_lines(pages: DataFrame) -> DataFrame:
    """host, path, version, shared: hashes of the lines that a page has in common with its nearest neighbour.

    Rows of one address (query included) are one page here if their lines are equal, and else versions of it, which are no
    neighbours of each other. Pages without lines are nobody's neighbour. Versions of an address that fill a block find none."""
    outline = pages.select("url", "html").mapInArrow(_outline, "host string, path string, version long, lines array<bigint>").where(F.size("lines") > 0)
    outline = outline.groupBy("host", "path", "version").agg(F.min("lines").alias("lines"))
    ordered = outline.repartitionByRange("host", "path", "version").sortWithinPartitions("host", "path", "version").mapInArrow(_numbered, "part int, row long, host string, path string, version long, lines array<bigint>")
    ordered = written(ordered, "outlines")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("_n"))  # one row for each partition
    base = sizes.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_base"))
    placed = ordered.join(small(base, 0, 1), "part").withColumn("place", F.col("_base") + F.col("row"))
    block = F.floor(F.col("place") / BLOCK)
    edge = F.when(F.col("place") % BLOCK == 0, F.array(block, block - 1)).when(F.col("place") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.select(F.explode(edge).alias("block"), "place", block.alias("_own"), "host", "path", "version", "lines")
    dealt = dealt.select("block", "place", (F.col("block") == F.col("_own")).alias("own"), "host", "path", "version", "lines")
    return dealt.repartition("block").sortWithinPartitions("block", "place").mapInArrow(_paired, "host string, path string, version long, shared array<bigint>")


def _finished(batches):
    """Text of pages, given their lines and the shared ones."""
    for batch in batches:
        text = []
        for html, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = set(gone or ())
            text.append("\n".join(t for t, kind in lines(html) if kind == TEXT or (kind == UNDECIDED and _hash(t) not in gone)))
        yield _texts(batch, text)


def _texts(batch, text) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _split(open_: bool):
    """The pages on which the neighbour has no say (no undecided line), as finished rows; or the other pages."""

    def run(batches):
        for batch in batches:
            found = [lines(h) for h in batch.column(2).to_pylist()]
            undecided = pa.array([any(k == UNDECIDED for _, k in x) for x in found], pa.bool_())
            if open_:
                where = [address(u) for u in batch.column(1).to_pylist()]
                whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()), pa.array([_version([_hash(t) for t, _ in x]) for x in found], pa.int64())], ["page_id", "url", "html", "host", "path", "version"])
                yield whole.filter(undecided)
            else:
                yield _texts(batch, ["\n".join(t for t, k in x if k == TEXT) for x in found]).filter(pa.array([not u for u in undecided.to_pylist()], pa.bool_()))

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null html is empty and gives an empty text; a page whose URL is null or has no host has no
    neighbour, and so keeps its undecided lines; null and repeated ids pass through; versions of one URL each
    have a neighbour of another URL; an empty table gives an empty table; other columns are ignored. All pages are outlined and paired; only pages with undecided lines
    meet the shared lines in a join.
    """
    pages = pages.select("page_id", "url", "html")
    gone = written(shared_lines(pages), "shared")
    gone = gone.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("version").alias("_v"), "shared")
    done = pages.mapInArrow(_split(False), "page_id long, url string, text string, n_chars long")
    asked = pages.mapInArrow(_split(True), "page_id long, url string, html string, host string, path string, version long")
    asked = asked.join(gone, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")) & (F.col("version") == F.col("_v")), "left").select("page_id", "url", "html", "shared")
    return done.union(asked.mapInArrow(_finished, "page_id long, url string, text string, n_chars long"))


__all__ = ["lines", "main_text", "shared", "shared_lines"]
