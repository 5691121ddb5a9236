"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by (host, URL path, page_id), and each is compared with the page of its host whose path is nearest, of the NEAR
pages on either side in that order. A page with the same lines is a copy, which shows no template, and is passed over. The text lines of
both are aligned by their longest common subsequence, and shared lines are deleted as template.

Passages repeat across articles, and deleting what two articles share would lose text that belongs to them. So differencing also
finds where the article stands: in the smallest element that holds half of the text that is not shared, and there from the first line
that is not shared to the last. What stands between them is kept, shared or not. That a page declares an element (article, main,
role=main) is evidence: a tenth of the text that is not shared is then enough, and all its lines count as the article. Parts that tags or class names mark as menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments are no article wherever they stand, and are left out before the comparison's
result is weighed. A page that is alone on its host, or among copies, is judged by those marks only.

A host with a third of all pages spans many tasks: ranges of the order are dealt to tasks by bounds that a pass over the URLs alone
gives (one for each task). Each task streams its pages with NEAR neighbours on either side. Pages whose neighbours stand in another
task's range are stored with their neighbours, a few for each task, and compared in a second pass by host; so the result doesn't
depend on how pages are dealt.

Reading a page takes time in proportion to its length, whatever its markup. Broken markup is read as far as it goes: an element that
never ends is ended by the next block, and no text is lost to it. Nulls: a null page is empty text; a null URL sorts first as an
empty host and path. Repeated rows each give a row. An empty table gives an empty result; other columns are neither read nor kept.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, materialise, release

#: Kinds of line: open to differencing, or in a part that tags mark as no article.
OPEN, CHROME = "o", "c"
#: Pages on either side that a page may be compared with; share of the unshared text that an element, or a declared one, must hold.
NEAR, HALF, DECLARED = 2, 0.5, 0.1
#: Characters after which a tag whose quotes haven't ended it is broken.
LONGEST = 1 << 16

# Names of HTML elements, and words that pages use in class, id and role.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "noscript", "template"}
_SMALL = {"button", "select", "svg", "math", "object"}  # no article either; the next block ends them
_HOLDERS = {"article", "main", "header", "div", "section", "ul", "ol", "dl", "table", "figure", "body", "blockquote", "td", *_CHROME}
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "th", "dt", "dd", "hr", "pre", "address", "figcaption", "fieldset", "hgroup", "details", "summary", "tbody", "thead", "tfoot", "caption", "center", "html", "option", *_HOLDERS}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_WORDS = set("ad ads advert adverts advertisement sponsor sponsored banner cookie cookies consent notice alert popup modal sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share social related recommended newsletter subscribe signup login search comment comments disqus replies promo complementary contentinfo".split())
_DENIED = {"no", "non", "not", "without", "with", "has", "is", "open", "closed"}  # no-sidebar, has-comments
_TITLED = {"entry", "post", "article", "content", "story"}  # entry-header holds the article's title
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

Line = tuple[str, str, str]  # kind, the numbers of the elements that it stands in (those declared as article with *), text


class Tags:
    """The tags of a page, in time linear in its length: (start, end, name, closing, attributes); name is empty for what is skipped."""

    def __init__(self, page: str):
        self.page, self.low = page, page.lower()
        if len(self.low) != len(page):  # a few characters change their number
            self.low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
        self.gone: set[str] = set()  # what isn't found any more from here on
        self.odd = 0  # where the quotes of a tag led nowhere: up to there, quotes are plain characters

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.low.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of(self, at: int) -> int:
        """The place after the > that ends the tag at a place: the first outside quotes, else the first; -1 if there is none."""
        first = self.find(">", at)
        if first < 0:
            return -1
        if at < self.odd:
            return first + 1
        k = at
        while True:
            stop = self.find(">", k)
            quote = min((q for q in (self.find('"', k), self.find("'", k)) if q >= 0), default=-1)
            if stop < 0 or k - at > LONGEST:
                self.odd = k
                return first + 1
            if quote < 0 or quote > stop:
                return stop + 1
            close = self.find(self.page[quote], quote + 1)
            if close < 0:
                return first + 1
            k = close + 1

    def __iter__(self):
        page, at = self.page, 0
        while True:
            at = page.find("<", at)
            if at < 0 or at + 1 >= len(page):
                return
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = end + 3 if end >= 0 else self.find(">", at) + 1
                if end <= 0:
                    return
                yield at, end, "", False, ""
                at = end
                continue
            name = _NAME.match(page, at + 1)
            if not name and page[at + 1] not in "!?/":
                at += 1
                continue
            end = self.end_of(at)
            if end < 0:
                yield at, len(page), "", False, ""  # a tag that the page ends in
                return
            tag, closing = (name[1].lower() if name else ""), page[at + 1] == "/"
            if tag in _RAW and not closing and page[end - 2] != "/":
                close = self.find(f"</{tag}", end)
                if close >= 0:
                    stop = self.find(">", close)
                    end = stop + 1 if stop >= 0 else len(page)
                else:
                    end = self.next_block(end)
                tag = ""
            yield at, end, tag, closing, page[name.end() : end - 1] if name else ""
            at = end

    def next_block(self, at: int) -> int:
        """Where a raw element ends that is never closed: at the next tag of a block. Only what follows the last such element is read twice."""
        while (at := self.page.find("<", at)) >= 0:
            name = _NAME.match(self.low, at + 1)
            if name and name[1] in _BLOCKS:
                return at
            at += 1
        return len(self.page)


def marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role say that an element is no article, and whether its role is main."""
    chrome = main = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        main |= name.lower() == "role" and value == "main"
        for word in value.replace("_", "-").split():
            parts = set(word.split("-"))
            found = parts & _WORDS
            if found and not parts & _DENIED and not (found == {"header"} and parts & _TITLED):
                chrome = True
    return chrome, main


def lines_of(page: str) -> list[Line]:
    """The visible text lines of a page, in page order."""
    out: list[Line] = []
    stack: list[tuple[str, str, str, bool]] = [("", OPEN, "", False)]  # open elements: name, kind, path, within a declared article
    text: list[str] = []
    count = 0

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((stack[-1][1], stack[-1][2], line))

    at = 0
    for start, end, tag, closing, attributes in Tags(page):
        if start > at:
            text.append(unescape(page[at:start]))
        at = end
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag in _INLINE or tag == "br":
            continue
        if tag not in _BLOCKS and tag not in _SMALL:
            if stack[-1][0] not in _SMALL:
                flush()
            continue
        flush()
        while tag in _BLOCKS and tag != "option" and stack[-1][0] in _SMALL:
            stack.pop()
        if tag not in _HOLDERS and tag not in _SMALL:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if attributes.endswith("/"):
            continue
        _, kind, path, declared = stack[-1]
        chrome, main = marked(attributes) if attributes.strip() and tag != "body" else (False, False)
        article = tag in ("article", "main") or main
        if tag in _CHROME or tag in _SMALL or chrome or (tag == "header" and not declared):
            kind = CHROME
        count += 1
        mark = "*" if article and kind == OPEN else ""
        stack.append((tag, kind, f"{path}.{count}{mark}" if tag not in _SMALL else path, declared or article))
    if at < len(page):
        text.append(unescape(page[at:]))
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence of a and b: rows of the table of lengths as bits, then back along them."""
    n, m = len(a), len(b)
    head = next((k for k in range(min(n, m)) if a[k] != b[k]), min(n, m))
    tail = next((k for k in range(min(n, m) - head) if a[n - 1 - k] != b[m - 1 - k]), min(n, m) - head)
    found = {*range(head), *range(n - tail, n)}
    a, b = a[head : n - tail], b[head : m - tail]
    if not a or not b:
        return found
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]  # a bit is unset where the length rises
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        low = (1 << j) - 1
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif (rows[i - 1] & low).bit_count() == (rows[i] & low).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(head + i)
    return found


def article_of(page: list[Line], shared: set[int]) -> set[int]:
    """Which lines stand in the article, going by the open lines that aren't shared: all lines of the declared elements that hold enough
    of them; without such an element, of the smallest that holds half of them, from the first of them to the last."""
    weight: dict[str, int] = {}
    inside: dict[str, list[int]] = {}
    own = [k for k, (kind, _, _) in enumerate(page) if kind == OPEN and k not in shared]
    total = sum(len(page[k][2]) for k in own)
    for k, (kind, path, text) in enumerate(page):
        parts = path.split(".") if kind == OPEN else []
        for depth in range(2, len(parts) + 1):
            holder = ".".join(parts[:depth])
            inside.setdefault(holder, []).append(k)
            if k not in shared:
                weight[holder] = weight.get(holder, 0) + len(text)
    declared = [h for h, n in weight.items() if h.endswith("*") and n >= DECLARED * total]
    if declared:
        return {k for h in declared for k in inside[h]}
    half = [h for h, n in weight.items() if n >= HALF * total]
    if not half:
        return set()
    smallest = max(half, key=lambda h: (h.count("."), weight[h]))
    mine = [k for k in inside[smallest] if k not in shared]
    return {k for k in inside[smallest] if mine[0] <= k <= mine[-1]}


def main_text(page: list[Line], near: list[Line] | None) -> str:
    """The article of a page's lines, given those of the page that it is compared with."""
    shared = common_lines([t for _, _, t in page], [t for _, _, t in near]) if near else set()
    if not any(kind == OPEN and k not in shared for k, (kind, _, _) in enumerate(page)):
        shared = set()
    article = article_of(page, shared) if shared else set()
    return "\n".join(t for k, (kind, _, t) in enumerate(page) if kind == OPEN and (k not in shared or k in article))


def nearness(a: str, b: str) -> int:
    """Characters that two paths have in common at the front."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def open_lines(page: list[Line]) -> list[str]:
    return [t for kind, _, t in page if kind == OPEN]


def compared_with(row: tuple, before: list[tuple], after: list[tuple]) -> list[Line] | None:
    """The lines of the nearest page that is no copy, of those before (nearest first) and after a row, on its host."""
    mine, best, lines = open_lines(row[4]), -1, None
    for step in range(NEAR):
        for side in (before, after):
            if step < len(side) and side[step][2] == row[2] and (near := nearness(side[step][3], row[3])) > best and open_lines(side[step][4]) != mine:
                best, lines = near, side[step][4]
    return lines


def _pack(page: list[Line]) -> bytes:
    return zlib.compress("\n".join(f"{kind}{path}\t{text}" for kind, path, text in page).encode("utf-8", "replace"), 6)


def _unpack(data: bytes) -> list[Line]:
    rows = (line.partition("\t") for line in zlib.decompress(data).decode().split("\n"))
    return [(head[0], head[1:], text) for head, _, text in rows if text]


ROWS = "page_id long, url string, host string, path string, lines binary"
_KINDS = {"page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "path": pa.string(), "lines": pa.binary(), "text": pa.string(), "todo": pa.bool_()}


def _batches(rows, names: list[str]):
    """Row tuples as record batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], _KINDS[n]) for k, n in enumerate(names)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], _KINDS[n]) for k, n in enumerate(names)], names=names)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _windows(rows, reach: int):
    """(NEAR rows before, row, up to reach rows after, how many are before) of each row of a stream; nearest first."""
    held: list[tuple] = []  # up to NEAR rows before the next one, it, and those after it
    before = n = 0  # rows of held before the next one; rows given out

    def given():
        return held[max(0, before - NEAR) : before][::-1], held[before], held[before + 1 :], n

    def step():
        nonlocal before, n
        n += 1
        if before < NEAR:
            before += 1
        else:
            held.pop(0)

    for row in rows:
        held.append(row)
        if len(held) - before > reach:
            yield given()
            step()
    while before < len(held):
        yield given()
        step()


def _first_pass(batches):
    """Sorted pages of ranges (part first) -> what they give, or, near the edges of a range, the pages to be compared later."""
    stream = _rows(batches)
    row = next(stream, None)

    def own(part):
        nonlocal row
        while row is not None and row[0] == part:
            yield (*row[1:5], _unpack(row[5]))
            row = next(stream, None)

    def made():
        while row is not None:
            for before, page, after, n in _windows(own(row[0]), 2 * NEAR):
                todo = n < NEAR or len(after) < NEAR
                if not todo:
                    yield *page[:4], None, main_text(page[4], compared_with(page, before, after)), False
                if n < 2 * NEAR or len(after) < 2 * NEAR:
                    yield *page[:4], _pack(page[4]), None, todo

    yield from _batches(made(), ["page_id", "url", "host", "path", "lines", "text", "todo"])
    release()


def _second_pass(batches):
    def made():
        for before, row, after, _ in _windows(((*r[:4], _unpack(r[4]), r[5]) for r in _rows(batches)), NEAR):
            if row[5]:
                yield row[0], row[1], main_text(row[4], compared_with(row, before, after))

    yield from _batches(made(), ["page_id", "url", "text"])
    release()


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text), n_chars (its code points)."""
    url = F.coalesce("url", F.lit(""))
    located = bounded(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    # bounds of ranges out of the URLs alone: one row for each task
    order = ["host", "path", "page_id"]
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = located.select(*order).repartitionByRange(ranges, *order).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("host", "path", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"))).alias("low"))
    bounds = sorted(tuple(r["low"]) for r in light.collect())

    def parse(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            keys = zip(*((x.encode() for x in cols[k]) for k in (2, 3)), (-(1 << 63) if i is None else i for i in cols[0]), strict=True)
            part = [max(bisect_right(edges, key) - 1, 0) for key in keys]
            packed = [_pack(lines_of(page)) for page in cols[4]]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns[:4], pa.array(packed, pa.binary())], names=["part", "page_id", "url", "host", "path", "lines"])
        release()

    edges = [(h.encode(), p.encode(), i) for h, p, i in bounds]
    parsed = located.mapInArrow(parse, "part int, " + ROWS)
    dealt = parsed.repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", *order)
    passed = materialise(dealt.mapInArrow(_first_pass, ROWS + ", text string, todo boolean"), "pages")
    # a few pages of each range; the order's ties are equal in all that is sorted by, but for their url and lines
    late = passed.filter("lines is not null").select(*(c.split()[0] for c in ROWS.split(", ")), "todo")
    late = late.repartition("host").sortWithinPartitions(*order).mapInArrow(_second_pass, "page_id long, url string, text string")
    out = passed.filter("lines is null").select("page_id", "url", "text").unionByName(late)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The same as SQL for pages that declare an article, and whose articles hold headings, paragraphs and inline markup only.
ARTICLES_SQL = r"""
WITH a AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<br>', ' ', 'g') AS art FROM pages),
l AS (SELECT page_id, url, [regexp_replace(x, '<[^>]*>', '', 'g') for x in regexp_split_to_array(art, '</?(?:p|h[1-6])>')] AS lines FROM a),
u AS (SELECT page_id, url, [trim(regexp_replace(replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g')) for x in lines] AS lines FROM l),
t AS (SELECT page_id, url, array_to_string([x for x in lines if x <> ''], chr(10)) AS text FROM u)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
