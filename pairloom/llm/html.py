"""Main text of pages: structure, and differences between pages whose URLs are nearest."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch, string_column, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
#: Elements that begin and end blocks of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title".split())
#: Elements whose content is not text of the page, up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end without an end tag where one of these begins.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements and roles that hold no main text; a header does only inside an article or main element.
SKIP = frozenset("nav footer aside form head menu dialog button".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that say so wherever they stand in it.
SURE = frozenset("advert advertisement advertising adverts breadcrumb breadcrumbs cookie cookies disqus footer gdpr masthead nav navbar navigation newsletter pagination popup sidebar sponsored toolbar topbar".split())
#: Words that say so unless a word of its own meaning stands beside them, as in share-price or form-of-government.
LIKELY = frozenset("ad ads banner comment comments consent form login menu modal notice notices pager promo promoted promotion related replies respond responses share sharing signup social sponsor subscribe subscription widget".split())
NEUTRAL = frozenset("area article articles bar block body bottom box button buttons center class col column container content feed first footer group head header icon icons id inner item items js last left link links list main module outer page panel post posts right row section site slot text title top unit user wrap wrapper zone".split())
MAIN = frozenset(("article", "main"))
#: Pages that share this share of their lines or more may be copies, which says nothing about boilerplate;
#: they are none if both have so many characters in lines unlike any line of the other one.
COPIES, FRESH = 0.9, 40
#: Bytes of lines to be cut that are handed to every task at most; beyond, they are joined.
SHARED_BYTES = 16 << 20
#: Bits in which the sketches of two versions of a line differ at most.
ALIKE = 20


def _names_boilerplate(value: str) -> bool:
    """Whether one of the names in a class or id is that of a menu, notice, advert or the like."""
    for name in value.split():
        words = {w for w in _WORDS.findall(name) if not w.isdigit()}
        if words & SURE or (words & LIKELY and words <= LIKELY | NEUTRAL):
            return True
    return False


def _skips(tag: str, attrs: str, main: bool) -> bool:
    if tag in SKIP or (tag == "header" and not main):
        return True
    if not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "role" and value.strip() in SKIP_ROLES):
            return True
        if name in ("class", "id") and tag not in MAIN and tag != "body" and _names_boilerplate(value):
            return True
    return False


def page_blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, kept by structure, inside the main element) of each block of a page, in order."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, skipped, main
    skip = main = 0

    def end() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, not skip, bool(main)))

    def leave_head() -> None:
        """What stands in no head ends it, as its end tag may be left out."""
        nonlocal skip
        if stack and stack[-1][0] == "head":
            end()
            skip -= stack.pop()[1]

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            if not page[at : m.start()].isspace():
                leave_head()
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                held.append(entities.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in MAIN:
                end()
            if any(name == tag for name, _, _ in stack):
                while True:
                    name, s, n = stack.pop()
                    skip -= s
                    main -= n
                    if name == tag:
                        break
            continue
        if tag not in HEAD:
            leave_head()
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if tag in BLOCKS:
                end()
            at = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            end()
        elif tag == "br":
            held.append(" ")
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and (tag in BLOCKS):
            # An unclosed element of this kind ends where the next one begins.
            if stack and any(name == tag for name, _, _ in stack):
                k = max(i for i, (name, _, _) in enumerate(stack) if name == tag)
                if not any(name in BLOCKS for name, _, _ in stack[k + 1 :]):
                    for _, s, n in stack[k:]:
                        skip -= s
                        main -= n
                    del stack[k:]
        if tag in BLOCKS or tag in SKIP or m[3].strip():
            s, n = _skips(tag, m[3], bool(main)), tag in MAIN
            if s and tag not in BLOCKS:
                end()
            stack.append((tag, s, n))
            skip += s
            main += n
    if page[at:].strip():
        leave_head()
    held.append(page[at:])
    end()
    return out


def main_lines(page: str) -> tuple[list[str], bool]:
    """The blocks that structure keeps, and whether an article or main element holds them; only these if there is one."""
    found = page_blocks(page)
    inside = [t for t, kept, main in found if kept and main]
    return (inside, True) if inside else ([t for t, kept, _ in found if kept], False)


#: Rows of bits that the alignment keeps at a time, and between rows that it can begin again from.
_ROWS = 256


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of a on a longest common subsequence of a and b, by rows of bits in Python's long integers.

    Bit j of row i is 0 where the subsequence of a[: i + 1] and b[: j + 1] is longer than that without
    b[j]. Every _ROWS-th row is kept, and those between are computed again on the way back.
    """
    inside = set(b)
    left = [(k, x) for k, x in enumerate(a) if x in inside]
    inside = set(a)
    right = [x for x in b if x in inside]
    head = 0
    while head < min(len(left), len(right)) and left[head][1] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail][1] == right[-1 - tail]:
        tail += 1
    out = [k for k, _ in left[:head] + left[len(left) - tail :]]
    mid, other = left[head : len(left) - tail], right[head : len(right) - tail]
    places: dict[int, int] = {}
    for k, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(other)) - 1

    def step(row: int, x: int) -> int:
        u = row & places.get(x, 0)
        return ((row + u) | (row - u)) & full

    marks, row = [], full
    for i, (_, x) in enumerate(mid):
        if i % _ROWS == 0:
            marks.append(row)  # the row before i
        row = step(row, x)
    width, j = len(other) // 8 + 1, len(other)
    for block in range(len(marks) - 1, -1, -1):
        row, rows = marks[block], [marks[block].to_bytes(width, "little")]
        for _, x in mid[block * _ROWS : (block + 1) * _ROWS]:
            row = step(row, x)
            rows.append(row.to_bytes(width, "little"))
        for i in range(len(rows) - 1, 0, -1):
            while j and rows[i][j - 1 >> 3] >> (j - 1 & 7) & 1:
                j -= 1
            if not j:
                break
            if rows[i - 1][j - 1 >> 3] >> (j - 1 & 7) & 1:
                out.append(mid[block * _ROWS + i - 1][0])
                j -= 1
    return sorted(out)


def sketch(line: str) -> int:
    """64 bits, most of them equal for lines that share most of their words."""
    words = line.lower().split()
    bits = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    return int((np.uint64(1) << np.flatnonzero(2 * bits.sum(0) > len(words)).astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _unlike(lines: list[tuple[int, int]], others: list[tuple[int, int]]) -> int:
    """Characters of the lines (size, sketch) that resemble none of the others."""
    return sum(abs(n) for n, x in lines if all(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() > ALIKE for _, y in others))


def boilerplate(page: dict, near: list[dict]) -> list[int]:
    """Indices of the lines that a page shares with neighbours which are no copies of it; pages have hashes, sizes, sketches.

    Inside a main element, where sizes are negative, a neighbour that shares most of the content may be
    a revision of the same text; what it shares goes only where another such neighbour has it, too.
    """
    own, sizes = page["hashes"], page["sizes"]
    cut: set[int] = set()
    doubtful: list[set[int]] = []
    main = any(n < 0 for n in sizes)
    for p in near:
        other, others = p["hashes"], p["sizes"]
        both = set(shared_lines(own, other))
        common = {own[k] for k in both}
        if main and len(both) == len(own):
            continue
        if len(both) >= COPIES * max(len(own), len(other)):
            left = [(n, x) for k, (n, x) in enumerate(zip(sizes, page["sketches"], strict=True)) if k not in both]
            right = [(n, x) for h, n, x in zip(other, others, p["sketches"], strict=True) if h not in common]
            if _unlike(left, right) < FRESH or _unlike(right, left) < FRESH:
                continue
        least = min(sum(map(abs, sizes)), sum(map(abs, others)))
        if main and 2 * len(both) > min(len(own), len(other)) and 2 * sum(abs(sizes[k]) for k in both) > least:
            doubtful.append(both)
        else:
            cut |= both
    if len(doubtful) > 1:
        cut |= set.intersection(*doubtful)
    return sorted(cut)


def _place_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return (parts.netloc.rpartition("@")[2].partition(":")[0] or "").lower(), parts.path + ("?" + parts.query if parts.query else "")


_PAGE = ("host", "hashes", "sizes", "sketches")
_FIELDS = "host string, hashes array<long>, sizes array<int>, sketches array<long>"
_KINDS = {"host": pa.string(), "hashes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "sketches": pa.list_(pa.int64())}


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, path) and the outline of each page that a task meets first: hashes, sizes and sketches of its lines, no text."""
    seen: set[bytes] = set()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("key", "path", *_PAGE)}
        for key, url, page in zip(*(batch.column(k) for k in ("key", "url", "html")), strict=True):
            if (key := key.as_py()) in seen:
                continue
            seen.add(key)
            host, path = _place_of(url.as_py())
            lines, main = main_lines(page.as_py())
            if lines:
                row = (key, path, host, [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in lines], [-len(t) if main else len(t) for t in lines], [sketch(t) for t in lines])
                for held, x in zip(out.values(), row, strict=True):
                    held.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(v, {"key": pa.binary(), "path": pa.string(), **_KINDS}[k]) for k, v in out.items()], names=list(out))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "part", "at"])
        at += n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, list[bytes]]]:
    """(part, page, keys) of each run of pages of a part with equal lines; the rows come sorted by part and place."""
    part, page, keys = None, None, []
    for batch in batches:
        # A long batch of long pages is not unpacked at once.
        for lo in range(0, batch.num_rows, 256):
            for r in batch.slice(lo, 256).to_pylist():
                now = {k: r[k] for k in _PAGE}
                if page is not None and (part, page) == (r["part"], now):
                    if r["key"] != keys[-1]:
                        keys.append(r["key"])
                    continue
                if page is not None:
                    yield part, page, keys
                part, page, keys = r["part"], now, [r["key"]]
    if page is not None:
        yield part, page, keys


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, the pages of its first two and last two runs, in order; (part, place, page)."""

    def written(part: int, pages: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([p[k] for p in pages], _KINDS[k]) for k in _PAGE]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(pages), pa.int32()), pa.array(range(len(pages)), pa.int32()), *columns], names=["part", "place", *_PAGE])

    last, held = None, []
    for part, page, _ in _runs(batches):
        if part != last and held:
            yield written(last, held)
            held = []
        last = part
        held = [*held, page] if len(held) < 4 else [*held[:2], held[3], page]
    if held:
        yield written(last, held)


def _diff(shared):
    """(key, cut) of pages that lose lines to the runs before and after; a run at the edge of its part finds one in other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        parts = sorted(edges)

        def across(part: int, page: dict, step: int) -> dict | None:
            for other in parts[parts.index(part) + 1 :] if step > 0 else parts[: parts.index(part)][::-1]:
                for p in edges[other][::step]:
                    if p != page:
                        return p
            return None

        def answered(part: int, before: dict | None, page: dict, after: dict | None, keys: list[bytes]) -> Iterator[pa.RecordBatch]:
            near = [p for p in (before or across(part, page, -1), after or across(part, page, 1)) if p and p["host"] == page["host"]]
            if cut := boilerplate(page, near):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([cut] * len(keys), pa.list_(pa.int32()))], names=["key", "cut"])

        before = held = None
        for part, page, keys in _runs(batches):
            if held:
                same = held[0] == part
                yield from answered(held[0], before, held[1], page if same else None, held[2])
                before = held[1] if same else None
            held = part, page, keys
        if held:
            yield from answered(held[0], before, held[1], None, held[2])

    return run


def shared_with_nearest(outlines: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, cut): the lines that pages share with the nearest differing ones in order of path within a host; pages that share none have no row.

    outlines: (key, path, host, hashes, sizes, sketches). Ranges of (host, path, key) are sorted, so that
    a host of any size is spread over tasks. Pages with equal lines that follow each other are one run,
    and runs meet; four pages of each range are handed to the others by a small table.
    """
    spark = outlines.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = outlines.repartitionByRange(ranges, "host", "path", "key").sortWithinPartitions("host", "path", "key").select("key", *_PAGE)
    placed = scratch.save(sorted_.mapInArrow(_place, f"key binary, {_FIELDS}, part int, at long"), "placed")
    scratch.drop("outlines")
    in_order = placed.repartition(ranges, "part").sortWithinPartitions("part", "at")
    edges: dict[int, list[dict]] = {}
    for r in in_order.mapInArrow(_edges, f"part int, place int, {_FIELDS}").orderBy("part", "place").collect():
        edges.setdefault(r["part"], []).append({k: r[k] for k in _PAGE})
    cuts = scratch.save(in_order.mapInArrow(_diff(spark.sparkContext.broadcast(edges)), "key binary, cut array<int>"), "cuts")
    scratch.drop("placed")
    return cuts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text", "n_chars", "n_shared"]
    for batch in batches:
        texts, shared = [], []
        for page, cut in zip(batch.column("html"), batch.column("cut").to_pylist(), strict=True):
            gone = set(cut or ())
            shared.append(len(gone))
            texts.append("\n".join(t for i, t in enumerate(main_lines(page.as_py())[0]) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(shared, pa.int64())], names=names)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): the main text, a line a block.

    Blocks in menus, headers outside of the article, footers, sidebars, notices, adverts, forms and
    comments go by element, role, class or id, and what is outside of an article or main element if
    there is one. Of the rest, those go that the page shares with its neighbours by URL path within
    the host, aligned by longest common subsequence, unless the two pages are copies. Neighbours are
    the nearest pages with other lines. n_shared counts the lines that went this way. Null or empty
    html gives an empty text; null urls form a host of their own; repeated rows get the same answer;
    other columns are ignored; an empty table gives no rows.

    Pages are parsed twice: once for outlines, 20 bytes a line, which are compared, and once for the
    text. The lines to be cut, of the pages that have any, meet the pages by a digest of URL and html;
    html moves only where they are too many to be handed to every task.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    pages = string_column(pages.select("page_id", "url", "html"), "html")
    keyed = pages.withColumn("key", F.unhex(F.md5(F.concat(F.md5(F.coalesce("url", F.lit(""))), F.md5("html")))))
    outlines = scratch.save(keyed.select("key", "url", "html").mapInArrow(_outline, f"key binary, path string, {_FIELDS}"), "outlines")
    cuts = shared_with_nearest(outlines, scratch)
    size = cuts.agg(F.sum(F.lit(48) + 4 * F.size("cut"))).first()[0] or 0
    both = keyed.join(F.broadcast(cuts) if size <= SHARED_BYTES else cuts.hint("merge"), "key", "left")
    return both.select("page_id", "url", "html", "cut").mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_shared long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
