"""Main text of HTML pages by differencing each page against the page with the nearest URL.

1. A page is cut into blocks at block-level tags.  Each block has its text (character
   references decoded, white space runs as one blank) and its place: inside an article, inside
   an element that is never main text (menus, headers, footers, asides, forms, scripts,
   notices, adverts, comments, by tag, role or class name), or neither.
2. Pages of one host are ordered by URL path.  Neighbours with the same blocks are one page here; a
   page is paired with that neighbour of other content that shares the longer path prefix.
   Neighbours come from ranges of the order, and the edges of the ranges from a table with a
   few rows a range, so a host of any size is spread over many tasks.
3. The block hashes of the pair are aligned by longest common subsequence.  Shared blocks are
   template lines and go.  Only inside an article do the tags decide on some of them: body
   paragraphs stay, and so do blocks next to a body paragraph that is shared too, as those
   are a passage both articles have; where all of an article is shared, all of it stays.
4. Of the blocks that differ, those in elements that are never main text go, as menus may
   change from page to page.  Pages with an article keep the article's blocks, others all
   that is left.
"""

from __future__ import annotations

import hashlib
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

# Names of HTML elements, by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "nav footer header aside form script style noscript template button select option textarea input label iframe object "
    "svg canvas menu dialog head title figure figcaption video audio".split()
)
#: their content is not markup
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: in an article, elements whose text is the body even where the neighbour has it too
BODY = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre caption td th dt dd".split())
#: an open p ends before these
ENDS_P = BLOCKS - {"br", "html", "body", "head"}
#: words in class, id or role that mark something other than main text
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|cookie\w*|consent|notice|nav\w*|menu\w*|sidebar\w*|footer|header|masthead|breadcrumb\w*|"
    r"comments?|disqus|replies|share|social|subscribe|newsletter|promo\w*|sponsor\w*|related|popup|modal|login|search|pagination|widget\w*|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|post-?(?:body|content)|entry-?content|main-?content|articlebody)(?:$|[\s_-])", re.I)

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: an end tag does not reach out of these, nor out of an article
WALLS = frozenset(("nav", "footer", "aside", "table", "td"))


class _Page:
    """Blocks of one page: [(text, inside an article, never main text, body paragraph)].

    What is open is counted by kind, and the places of open elements are kept by name, so a tag
    costs the same however deep it stands.
    """

    def __init__(self):
        self.blocks, self.held = [], []
        self.open: list[tuple[str, bool, bool]] = []  # element, starts an article, starts what is never main
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.articles = self.nevers = self.bodies = 0

    def text(self, piece: str):
        if piece:
            self.held.append(piece)

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def cut(self):
        if self.held:
            line = _SPACE.sub(" ", html.unescape("".join(self.held))).strip()
            self.held = []
            if line:
                # what stands in a list item belongs to the list, also when it is a paragraph
                body = self.bodies > 0 and not self.has("li")
                self.blocks.append((line, self.articles > 0, self.nevers > 0, body))

    def push(self, name: str, article: bool, never: bool):
        self.places.setdefault(name, []).append(len(self.open))
        if article or name in WALLS:
            self.walls.append(len(self.open))
        self.articles += article
        self.nevers += never
        self.bodies += name in BODY
        self.open.append((name, article, never))

    def pop(self):
        name, article, never = self.open.pop()
        self.places[name].pop()
        if self.walls and self.walls[-1] == len(self.open):
            self.walls.pop()
        self.articles -= article
        self.nevers -= never
        self.bodies -= name in BODY

    def start(self, name: str, attributes: str):
        if name in BLOCKS:
            self.cut()
        if name in ENDS_P and self.has("p"):
            self.end("p")
        if name == "li" and self.has("li") and self.open[-1][0] not in ("ul", "ol"):
            self.end("li")
        if name in VOID or attributes.rstrip().endswith("/") and name not in ("p", "div", "article"):
            return
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
        main = name in ("article", "main") or bool(names and MAIN.search(names))
        never = name in NEVER and not (name in ("header", "figure", "figcaption") and self.articles) or bool(
            names and not main and name not in ("html", "body") and MARKS.search(names)
        )
        self.push(name, main and not never, never)

    def end(self, name: str):
        if name in BLOCKS:
            self.cut()
        if not self.has(name) or self.walls and self.places[name][-1] < self.walls[-1]:
            return
        for _ in range(len(self.open) - self.places[name][-1]):
            self.pop()


def tags_of(page: str):
    """Yield (text before, name, is an end tag, attributes), last with an empty name, reading from left to right once.

    A ``<`` that starts no tag is text.  Quotes in a tag hide ``>``; once a tag's quotes do not
    close, they hide nothing in the rest of the page.
    """
    at, last, quotes, text = 0, page.rfind(">"), True, []
    while (begin := page.find("<", at)) >= 0:
        comment = page.startswith("!--", begin + 1)
        if begin > last and not comment:
            break
        text.append(page[at:begin])
        at = begin + 1
        if comment:
            end = page.find("-->", at + 3)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("!", "?"), at):
            at = page.find(">", at) + 1
            continue
        m = _NAME.match(page, at)
        if m is None:
            text.append("<")
            continue
        end = m.end()
        while quotes and (stop := _STOP.search(page, end)) is not None and stop[0] != ">":
            end = page.find(stop[0], stop.end()) + 1
            if not end:
                quotes = False
        if quotes and stop is None:
            quotes = False
        end = stop.start() if quotes else page.find(">", m.end())
        name = m[1].lower()
        yield "".join(text), name, page[at] == "/", page[m.end() : end]
        text, at = [], end + 1
        if name in RAW and page[begin + 1] != "/":
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.start() if close else len(page)
    text.append(page[at:])
    yield "".join(text), "", False, ""


def blocks_of(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, in an article, never main text, body paragraph) of each block, in page order."""
    out = _Page()
    for text, name, ends, attributes in tags_of(page):
        out.text(text)
        if ends:
            out.end(name)
        elif name:
            out.start(name, attributes)
    out.cut()
    return out.blocks


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Common ends are taken first, then lines are matched by rows of a table of the middle
    parts, kept as one integer a row (bit-parallel), so long pages cost little.  Of the rows
    some are kept, a root's worth, and those between are computed again on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict = {}
    for k, line in enumerate(mid_b):
        places.setdefault(line, []).append(k)
    wanted = set(mid_a)
    lines = {line: _bits(own) for line, own in places.items() if line in wanted}
    full = (1 << len(mid_b)) - 1

    def following(row, line):
        hit = row & lines.get(line, 0)
        return ((row + hit) | (row - hit)) & full

    span = max(1, math.isqrt(len(mid_a)))
    kept, row = [], full
    for i, line in enumerate(mid_a):
        if i % span == 0:
            kept.append(row)
        row = following(row, line)
    # walk back: a zero bit k of a row says that b[:k+1] gains one common line there
    out, j, after = [], len(mid_b), row
    for block in reversed(range(len(kept))):
        first = block * span
        rows = [kept[block]]
        for line in mid_a[first : first + span - 1]:
            rows.append(following(rows[-1], line))
        i = min(first + span, len(mid_a))
        while i > first and j:
            before = rows[i - 1 - first]
            if after >> (j - 1) & 1:
                j -= 1
            elif not before >> (j - 1) & 1:
                i, after = i - 1, before
            else:
                out.append(head + i - 1)
                i, j, after = i - 1, j - 1, before
    return [*range(head), *reversed(out), *range(len(a) - tail, len(a))]


def _bits(places: list[int]) -> int:
    """The number with these bits set."""
    data = bytearray(places[-1] // 8 + 1)
    for k in places:
        data[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(data, "little")


LINES = "page_id long, host string, path string, n binary, content long, lines array<long>"


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _line_rows(batches):
    for batch in batches:
        hosts, paths, lines = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
            hosts.append(m[1].lower() if m else "")
            paths.append(m[2] if m else (url or ""))
            lines.append([_number(text) for text, *_ in blocks_of(page or "")])
        content = [_number(" ".join(map(str, own))) for own in lines]
        columns = [batch.column(0), pa.array(hosts), pa.array(paths), batch.column(3), pa.array(content, pa.int64()), pa.array(lines, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in LINES.split(", ")])


def _prefix(a, b):
    """Length of the common prefix of two paths, in whole characters."""
    size = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(1), size)
    same = F.when(size > 0, F.size(F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))).otherwise(0)
    return F.coalesce(same, F.lit(-1))


def nearest_pages(lines: DataFrame) -> DataFrame:
    """(n, other): each page with the neighbour of other content in its host that shares the longer path prefix.

    The order is cut into ranges.  Inside a range, rows that follow one another with the same
    content make a run, and the neighbours of a run are the rows beside it.  At the edges of a
    range they come from a table of the ends of the first two and last two runs of every range.
    """
    order = ["host", "path", "page_id", "n"]
    light = lines.select(*order, "content").repartitionByRange(*order)
    light = stored(light.withColumn("range", F.spark_partition_id()), "order")
    key, page = F.struct(*order), F.struct("host", "content")
    inside = Window.partitionBy("range").orderBy(*order)
    backwards = Window.partitionBy("range").orderBy(*[F.col(c).desc() for c in order])
    rows = light.withColumn("prev", F.lag(key).over(inside)).withColumn("next", F.lag(key).over(backwards))
    rows = rows.withColumn("starts", ~F.lag(page).over(inside).eqNullSafe(page)).withColumn("ends", ~F.lag(page).over(backwards).eqNullSafe(page))
    # the row before this row's run, and the one behind it; null at the edges of the range
    before, after = (F.last(F.when(F.col(c), F.col(k)), ignorenulls=True) for c, k in (("starts", "prev"), ("ends", "next")))
    rows = rows.withColumn("before", before.over(inside)).withColumn("after", after.over(backwards))
    rows = rows.withColumn("run", F.sum(F.col("starts").cast("int")).over(inside)).withColumn("run_back", F.sum(F.col("ends").cast("int")).over(backwards))
    # at most eight rows a range, in one task: what stands before and after each range
    every = Window.orderBy("range", *order)
    edges = rows.filter("(starts and run <= 2) or (ends and run_back <= 2)").select("range", *order, key.alias("key"), page.alias("page"), "run", "run_back", "starts", "ends")
    edges = edges.withColumn("new", (~F.lag("page").over(every).eqNullSafe(F.col("page"))).cast("int")).withColumn("group", F.sum("new").over(every))
    groups = edges.groupBy("group").agg(F.min(F.struct("range", "key")).alias("f"), F.max(F.struct("range", "key")).alias("l"))
    by_group = Window.orderBy("group")
    groups = groups.select("group", F.lag("l.key").over(by_group).alias("left"), F.lead("f.key").over(by_group).alias("right"))
    edges = edges.join(groups, "group")
    outer = edges.groupBy(F.col("range").alias("r")).agg(
        F.max(F.when(F.col("starts") & (F.col("run") == 1), F.col("left"))).alias("left"), F.max(F.when(F.col("ends") & (F.col("run_back") == 1), F.col("right"))).alias("right")
    )
    rows = rows.filter("host <> ''").join(outer, F.col("range") == F.col("r"))
    rows = rows.withColumn("before", F.coalesce("before", "left")).withColumn("after", F.coalesce("after", "right"))
    near = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), _prefix(F.col("path"), F.col(f"{side}.path"))).otherwise(-1)
    rows = rows.withColumn("b", near("before")).withColumn("a", near("after"))
    other = F.when((F.col("b") >= F.col("a")) & (F.col("b") >= 0), F.col("before.n")).when(F.col("a") >= 0, F.col("after.n"))
    return rows.select("n", other.alias("other")).filter("other is not null")


def _shared(batches):
    for batch in batches:
        pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        out = [common_lines(own, other) for own, other in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["n", "shared"])


def template_lines(lines: DataFrame) -> DataFrame:
    """(n, shared): the blocks of a page that its nearest page of other content shares; only pages with any."""
    pairs = nearest_pages(lines)
    own = lines.select("n", F.col("lines").alias("own"))
    other = lines.select(F.col("n").alias("other"), F.col("lines").alias("theirs"))
    both = pairs.join(own, "n").join(other, "other").select("n", "own", "theirs")
    return both.mapInArrow(_shared, "n binary, shared array<int>").filter(F.size("shared") > 0)


def article_template(blocks: list[tuple[str, bool, bool, bool]], shared: frozenset[int]) -> set[int]:
    """Places of the shared blocks of an article that are template lines.

    A block goes when it is no body paragraph and the nearest body paragraphs on both sides are
    the page's own.  Where every block is shared the articles are copies and nothing goes.
    """
    places = [k for k, (_, a, never, _) in enumerate(blocks) if a and not never]
    if shared.issuperset(places):
        return set()
    out, held, copied = set(), [], False
    for k in places:
        if not blocks[k][3]:
            if k in shared:
                held.append(k)
            continue
        if not copied and k not in shared:
            out.update(held)
        held, copied = [], k in shared
    if not copied:
        out.update(held)
    return out


def main_blocks(blocks: list[tuple[str, bool, bool, bool]], shared: frozenset[int]) -> tuple[list[str], int, int]:
    """The main text's blocks, how many of the others differencing deleted, and how many the tags did."""
    template = article_template(blocks, shared)
    differ = [k for k, (_, a, never, _) in enumerate(blocks) if k not in shared or a and not never and k not in template]
    kept = [k for k in differ if not blocks[k][2]]
    if any(blocks[k][1] for k in kept):
        kept = [k for k in kept if blocks[k][1]]
    return [blocks[k][0] for k in kept], len(blocks) - len(differ), len(differ) - len(kept)


PARTS = "page_id long, url string, n binary, kinds binary, texts array<string>"


def candidates(blocks: list[tuple[str, bool, bool, bool]]) -> list[int]:
    """Places of the blocks whose text may be main text, whatever another page shares with this one.

    Where an article has blocks some of them are always kept, and then nothing beside them is.
    """
    places = [k for k, (_, _, never, _) in enumerate(blocks) if not never]
    return [k for k in places if blocks[k][1]] or places


def _part_rows(batches):
    for batch in batches:
        kinds, texts = [], []
        for page in batch.column(2).to_pylist():
            blocks = blocks_of(page or "")
            kinds.append(bytes(a | never << 1 | body << 2 for _, a, never, body in blocks))
            texts.append([blocks[k][0] for k in candidates(blocks)])
        columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(kinds, pa.binary()), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PARTS.split(", ")])


def _blocks_from(kinds: bytes, texts: list[str]) -> list[tuple[str, bool, bool, bool]]:
    """The blocks that ``_part_rows`` took apart, without the text of those that are no candidates."""
    bare = [("", bool(b & 1), bool(b & 2), bool(b & 4)) for b in kinds]
    for k, text in zip(candidates(bare), texts, strict=True):
        bare[k] = (text, *bare[k][1:])
    return bare


TEXTS = "page_id long, url string, text string, n_chars long, n_shared long, n_marked long"


def _texts(batches):
    for batch in batches:
        parts = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
        found = [main_blocks(_blocks_from(kinds, texts), frozenset(gone or ())) for kinds, texts, gone in parts]
        texts = ["\n".join(kept) for kept, _, _ in found]
        counts = [[len(t) for t in texts], [n for _, n, _ in found], [n for _, _, n in found]]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in TEXTS.split(", ")])


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_marked), one row per row of ``pages``.

    ``n_shared`` blocks went because the paired page has them too, ``n_marked`` others by their tags.
    A null page is an empty one and has an empty text.  Pages without a host are not paired, nor
    pages of hosts that have one content only.  Pages that repeat an id or URL are pages of
    their own; other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # 128 bits, the id among them: rows that agree in everything are one page here, and get one answer
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(salt), "url", "html", "page_id")), 16, "0") for salt in (1, 2)]
    rows = rows.withColumn("n", F.unhex(F.concat(*hashes)))
    lines = stored(rows.mapInArrow(_line_rows, LINES).dropDuplicates(["n"]), "lines")
    shared = template_lines(lines)
    # the page itself stays where it is read: only texts that may be kept meet the shared blocks
    parts = rows.mapInArrow(_part_rows, PARTS)
    joined = parts.join(shared, "n", "left").select("page_id", "url", "kinds", "texts", "shared")
    return joined.mapInArrow(_texts, TEXTS)
