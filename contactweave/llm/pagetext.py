"""Main text of web pages, by markup and nearest-URL differencing.

A page is cut into lines, one per block of running text, and markup sorts them: lines
of an article or main element, lines of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, and others.  Differencing looks at all lines of
all pages: pages of a host are ordered by URL path, and a page's lines are aligned with
those of the pages before and after it by longest common subsequence.

On a page without an article, the lines that it shares with the nearer of the two (the
longer common path) are deleted.  Articles quote each other, so in an article a shared
line is deleted only as furniture: it stands in the run of lines with which this article
and those of both neighbours begin or end alike, neither neighbour has half of the
article's lines, and at least half of the host's pages hold the line.  Pages with the same lines in a host are one page here, so copies are
not each other's neighbours; a page all of whose lines would go keeps them.

Only line hashes are shuffled and aligned.  Pages are parsed again to write the text,
with the few decisions that change anything joined back.

Defined results: null or empty html gives an empty text; null URLs have an empty
host; pages alone in their host keep all lines; rows that repeat are read as they
stand; an empty table gives an empty result.  Of a header inside an article the headings
are main text, as they are the article's own.  Forms are left out, but where nothing else
is left and there is no article, as on pages that a form wraps whole, the text of unmarked
forms is taken, less labels, legends and controls.  Reading takes time linear in the page,
however deep elements are nested.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactweave.llm.base import bounded_batches, small, written
from contactweave.llm.urlfilter import host_and_path

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
APART = frozenset("aside button dialog footer form head header menu nav select".split())
#: Elements that name the controls of a form.
LABELS = frozenset("label legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no markup, and never main text.
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea title".split())
#: Those of them that may hold others of their kind.
NESTED = frozenset("svg template".split())
VOID = frozenset("hr".split())
#: Inline elements that are never left out: those without content, and emphasis and links.
KEPT = frozenset("a area b base col embed em i img input link meta param source strong track wbr".split())
#: Names that mark, as a class or id of their own, what is no main text.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond"
    " share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: What may stand beside a mark in a longer name (share-buttons, ad-slot-2, left-sidebar); any
#: other word (has-sidebar, share-price) makes it a name of something else.
ADVERTS = frozenset("ad ads advert advertisement adverts advertising promo sponsor sponsored".split())
PARTS = frozenset("area bar block bottom box button buttons form icons inner left link links list outer popup right section slot top unit".split())
HOLDERS = PARTS | frozenset("container holder wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = frozenset("comment comments disqus respond".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?\s*([a-z]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)""", re.I)
_SPLIT = re.compile(r"[-_:.]+(?:\d+(?:x\d+)?(?=[-_:.]|$))?")


def marks_of(name: str) -> set[str]:
    """The marks of one class or id: its words, if they are all marks and parts."""
    if name in MARKS:
        return {name}
    words = {w for w in _SPLIT.split(name) if w}
    found = words & MARKS
    return found if found and words <= MARKS | (HOLDERS if found & ADVERTS else PARTS) else set()


def marked(attributes: str) -> frozenset[str]:
    """The marks in an element's attributes; empty if it may hold main text."""
    if not attributes or attributes.isspace():
        return frozenset()
    found = {x for m in _NAMES.finditer(attributes) for w in m[1].strip("\"'").lower().split() for x in marks_of(w)}
    role = _ROLE.search(attributes)
    if role and role[1].lower() in ROLES:
        found |= {role[1].lower()}
    if _HIDDEN.search(attributes):
        found |= {"hidden"}
    return frozenset(found)


def inline(name: str) -> bool:
    return name not in BLOCKS and name not in APART


def raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of a ``RAW`` element begins whose content starts at ``at``: the
    last one there is if they don't match, -1 if there is none."""
    depth, last = 1, -1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])([^>]*+)", re.I).finditer(page, at):
        if m[1]:
            depth, last = depth - 1, m.start()
            if not depth:
                break
        elif name in NESTED and not m[2].rstrip().endswith("/"):
            depth += 1
    return last


class Stack:
    """Open elements: blocks, marked inline ones and those of the same name in them.
    ``since`` has the depths at which parts of the page began that end with an element."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.blocks: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.since: dict[str, int] = {}

    def holds(self, name: str) -> bool:
        return bool(self.places.get(name))

    def inner(self) -> int:
        """Where the inline elements begin that are open in the innermost block."""
        return self.blocks[-1] + 1 if self.blocks else 0

    def holds_inner(self, name: str) -> bool:
        return self.holds(name) and self.places[name][-1] >= self.inner()

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if not inline(name):
            self.blocks.append(len(self.names))
        self.names.append(name)

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.names) > depth:
            self.places[self.names.pop()].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        for part in [k for k, v in self.since.items() if v >= depth]:
            del self.since[part]


OPEN_ZONE, APART_ZONE, MAIN_ZONE, FORM_ZONE = 0, 1, 2, 3


def text_zone(zones: Iterable[int], has_article: bool) -> int:
    """The zone whose lines are a page's main text."""
    if has_article:
        return MAIN_ZONE
    return FORM_ZONE if OPEN_ZONE not in (held := set(zones)) and FORM_ZONE in held else OPEN_ZONE


def zoned(page: str | None) -> tuple[list[tuple[int, str]], bool]:
    """((zone, line) in page order, whether there is an article): zone is ``APART_ZONE``
    for lines that markup leaves out, ``FORM_ZONE`` for those of forms, ``MAIN_ZONE`` for
    the others of an article or main element, and ``OPEN_ZONE`` for the rest."""
    lines: list[tuple[int, str]] = []
    if not page:
        return lines, False
    text: list[str] = []
    left_out: list[str] = []
    open_ = Stack()
    since, skip_is_comment, has_article = open_.since, False, False

    def zone() -> int:
        if "form" in since:
            return FORM_ZONE
        if "header" in since and "heading" not in since:
            return APART_ZONE
        return MAIN_ZONE if "article" in since else OPEN_ZONE

    def flush() -> None:
        for held, of in ((text, zone()), (left_out, APART_ZONE)):
            if held:
                line = " ".join(entities.unescape("".join(held)).split())
                held.clear()
                if line:
                    lines.append((of, line))

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            (left_out if "skip" in since else text).append(page[at:stop])
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                at = raw_end(page, name, at)
                if at < 0:
                    break
            continue
        if name == "br":
            (left_out if "skip" in since else text).append(" ")
            continue
        label = name in LABELS and "form" in since
        if inline(name):
            # An end tag reaches its element only where no block is open in between.
            if closing and not open_.holds_inner(name):
                continue
            if not closing and not open_.holds(name) and ("skip" in since or name in KEPT or not (label or marked(attributes))):
                continue
        else:
            flush()
        if closing:
            if open_.holds(name):
                open_.cut(open_.places[name][-1])
            continue
        if name in VOID:
            continue
        if name == "p" and (n := open_.inner()) and open_.names[n - 1] == "p":
            open_.cut(n - 1)
        marks = marked(attributes)
        whole = name in ("article", "main", "body", "html")
        if name in ("article", "main") and not marks & COMMENTS and not ("skip" in since and skip_is_comment):
            # An article ends what was left open before it.
            for part in ("skip", "form", "header", "heading"):
                since.pop(part, None)
        if "skip" not in since:
            depth = len(open_.names)
            if marks and not (whole and not marks & COMMENTS):
                since["skip"], skip_is_comment = depth, bool(marks & COMMENTS)
            elif name == "form":
                since.setdefault("form", depth)
            elif name == "header" and "article" in since:
                since.setdefault("header", depth)
            elif name in APART or label:
                since["skip"], skip_is_comment = depth, False
            elif name in HEADINGS and "header" in since:
                since.setdefault("heading", depth)
            elif name in ("article", "main"):
                has_article = True
                since.setdefault("article", depth)
        open_.push(name)
    flush()
    return lines, has_article


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """(lines, settled): the lines of the article or main elements and True, or
    all lines that markup lets pass and False."""
    lines, has_article = zoned(page)
    zone = text_zone((z for z, _ in lines), has_article)
    return [x for z, x in lines if z == zone], has_article or not page


def line_key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Cells, of lines by lines, that an alignment holds at a time.
CELLS = 1 << 28


def growth(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Rows of the alignment of ``a`` with ``b`` (all of them, or the last): row i has
    a zero bit where the length of the common subsequence of a[:i] grows along ``b``
    (Crochemore and others, 2001)."""
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows, v = [full], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def lengths(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and every b[:j]."""
    bits = growth(a, b, False)[0]
    return [0, *accumulate((bits >> j & 1) ^ 1 for j in range(len(b)))] if len(b) < 64 else [0, *accumulate(1 if c == "0" else 0 for c in reversed(f"{bits:0{len(b)}b}"))]


def common(a: list[int], b: list[int]) -> list[bool]:
    """For each element of ``a``, whether a longest common subsequence of ``a`` and
    ``b`` has it.  Alignments of over ``CELLS`` cells are halved (Hirschberg, 1975),
    so memory grows with a + b."""
    n, m = len(a), len(b)
    start, stop = 0, 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while stop < min(n, m) - start and a[n - 1 - stop] == b[m - 1 - stop]:
        stop += 1
    if start + stop:
        return [True] * start + common_between(a[start : n - stop], b[start : m - stop]) + [True] * stop
    return common_between(a, b)


def common_between(a: list[int], b: list[int]) -> list[bool]:
    n, m = len(a), len(b)
    if not n or not m:
        return [False] * n
    if n > 1 and n * m > CELLS:
        half = n // 2
        ahead, back = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])
        cut = max(range(m + 1), key=lambda j: ahead[j] + back[m - j])
        return common(a[:half], b[:cut]) + common(a[half:], b[cut:])
    rows = growth(a, b, True)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    shared, i, j = [False] * n, n, m
    while i and j:
        here = length(i, j)
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            shared[i - 1] = True
            i, j = i - 1, j - 1
    return shared


def near_length(a: str, b: str | None) -> int:
    """Length of the common beginning of two paths; -1 where there is no other."""
    if b is None:
        return -1
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def deleted(keys: list[int], zones: list[int], path: str, neighbours: list[tuple[str | None, list[int] | None, list[int] | None]]) -> list[int]:
    """Places of the lines that differencing takes from a page's main text.
    ``neighbours`` are the paths, lines and zones of the pages before and after."""
    has_article = MAIN_ZONE in zones
    zone = text_zone(zones, has_article)
    main = [i for i, z in enumerate(zones) if z == zone]
    others = [n for n in neighbours if n[1] is not None]
    if not main or not others:
        return []
    if not has_article:
        nearest = max(others, key=lambda o: near_length(path, o[0]))
        shared = common(keys, nearest[1])
        gone = [i for i in main if shared[i]]
        return gone if len(gone) < len(main) else []
    if len(others) < 2:
        return []
    own = [keys[i] for i in main]
    articles = [[k for k, z in zip(o[1], o[2]) if z == MAIN_ZONE] for o in others]
    alike = lambda step: [i for i, _ in takewhile(lambda x: x[1].count(x[1][0]) == 3, zip(main[::step], zip(own[::step], *(a[::step] for a in articles))))]
    gone = {*alike(1), *alike(-1)}
    if not gone or any(2 * sum(common(own, a)) >= len(own) for a in articles):
        return []
    return sorted(gone)


PRINTED = "host string, h1 bigint, h2 bigint, path string, page_id {}, keys array<bigint>, zones array<int>"


def printed(pages: DataFrame) -> DataFrame:
    """(host, h1, h2, path, page_id, keys, zones) per page of (host, h1, h2, path,
    page_id, html): its lines' hashes and zones."""
    bounded_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [zoned(h)[0] for h in b.column(5).to_pylist()]
            keys = pa.array([[line_key(x) for _, x in g] for g in got], pa.list_(pa.int64()))
            zones = pa.array([[z for z, _ in g] for g in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], keys, zones], ["host", "h1", "h2", "path", "page_id", "keys", "zones"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("host", "h1", "h2", "path", "page_id", "html").mapInArrow(work, PRINTED.format(kind))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) in the order of (host, path, page_id), with seq
    and prev_seq, the number of the row before.  Order comes from range
    partitions, so a hot host takes as many tasks as its rows need; only one number
    per partition goes through the window."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("host", "path", "page_id", "h1", "h2")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ordered.withColumn("seq", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("seq", 33)
    lasts = placed.groupBy(part.alias("part")).agg(F.max("seq").alias("last"), F.min("seq").alias("first"))
    before = lasts.select(F.col("first").alias("f"), F.lag("last").over(W.orderBy("part")).alias("before"))
    out = placed.join(F.broadcast(before), F.col("seq") == F.col("f"), "left")
    return out.withColumn("prev_seq", F.when(F.col("f").isNull(), F.col("seq") - 1).otherwise(F.col("before"))).drop("f", "before")


def decisions(prints: DataFrame) -> DataFrame:
    """(host, h1, h2, gone) of the pages whose text differencing changes: ``gone`` are
    the places of lines."""
    pages = prints.groupBy("host", F.xxhash64("keys", "zones").alias("lines")).agg(F.min(F.struct("path", "page_id", "h1", "h2", "keys", "zones")).alias("p"))
    pages = pages.select("host", "p.path", "p.page_id", "p.h1", "p.h2", "p.keys", "p.zones", "lines")
    order = written(numbered(pages), "numbered")
    side = lambda s, seq: order.select(F.col(seq).alias(f"{s}seq"), F.col("host").alias(f"{s}host"), F.col("path").alias(f"{s}path"), F.col("keys").alias(f"{s}keys"), F.col("zones").alias(f"{s}zones"))
    met = order.join(side("b", "seq"), (F.col("prev_seq") == F.col("bseq")) & (F.col("host") == F.col("bhost")), "left")
    met = met.join(side("a", "prev_seq"), (F.col("seq") == F.col("aseq")) & (F.col("host") == F.col("ahost")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [deleted(keys, zones, path, [(bp, bk, bz), (ap, ak, az)]) for path, keys, zones, bp, bk, bz, ap, ak, az in zip(*(c.to_pylist() for c in b.columns[2:]))]
            held = pa.array([bool(x) for x in found])
            said = [[keys[i] for i in x] for x, keys in zip(found, b.column("keys").to_pylist())]
            article = pa.array([MAIN_ZONE in z for z in b.column("zones").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], article, pa.array(found, pa.list_(pa.int32())), pa.array(said, pa.list_(pa.int64()))], ["host", "lines", "article", "gone", "said"]).filter(held)

    found = met.select("host", "lines", "path", "keys", "zones", "bpath", "bkeys", "bzones", "apath", "akeys", "azones").mapInArrow(work, "host string, lines bigint, article boolean, gone array<int>, said array<bigint>")
    found = written(found, "decisions")
    in_article = written(furniture(order, found.where("article")), "furniture")
    of = found.where("not article").select("host", "lines", "gone").unionByName(in_article)
    of = of.select(F.col("host").alias("dhost"), F.col("lines").alias("dlines"), "gone")
    each = prints.select("host", "h1", "h2", F.xxhash64("keys", "zones").alias("lines"))
    met = each.join(small(of), (F.col("host") == F.col("dhost")) & (F.col("lines") == F.col("dlines")))
    return met.select("host", "h1", "h2", "gone").dropDuplicates(["host", "h1", "h2"])


def furniture(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, lines, gone) of decisions, with the lines that at least half of the host's
    pages hold."""
    each = found.select("host", "lines", F.explode(F.arrays_zip("gone", "said")).alias("x")).select("host", "lines", "x.gone", "x.said")
    asked = small(written(each.select(F.col("host").alias("ahost"), F.col("said").alias("asaid")).distinct(), "asked"))
    held = pages.select("host", F.explode(F.array_distinct("keys")).alias("key")).join(asked, (F.col("host") == F.col("ahost")) & (F.col("key") == F.col("asaid")))
    n = held.groupBy(F.col("host").alias("fhost"), "key").agg(F.count(F.lit(1)).alias("n"))
    total = pages.join(asked.select("ahost").distinct(), F.col("host") == F.col("ahost"), "left_semi").groupBy(F.col("host").alias("thost")).agg(F.count(F.lit(1)).alias("total"))
    common_ = n.join(total, F.col("fhost") == F.col("thost")).where(2 * F.col("n") >= F.col("total")).select("fhost", "key")
    met = each.join(common_, (F.col("host") == F.col("fhost")) & (F.col("said") == F.col("key")))
    return met.groupBy("host", "lines").agg(F.collect_list("gone").alias("gone"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    host, path = host_and_path(F.col(url_col))
    html = F.col(html_col)
    hashes = [F.xxhash64(F.lit(s), html).alias(f"h{s}") for s in (1, 2)]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), host.alias("host"), path.alias("path"), *hashes)
    prints = written(printed(rows), "lines")
    gone = written(decisions(prints), "gone")
    gone = small(gone.select(F.col("host").alias("ghost"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "gone"))
    met = rows.join(gone, (F.col("host") == F.col("ghost")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, taken in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                lines, has_article = zoned(page)
                zone, taken = text_zone((z for z, _ in lines), has_article), set(taken or ())
                texts.append("\n".join(x for i, (z, x) in enumerate(lines) if z == zone and i not in taken))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return met.select("page_id", "url", "html", "gone").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars bigint")
