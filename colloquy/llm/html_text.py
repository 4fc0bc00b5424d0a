"""Main text of web pages: differencing against the page with the nearest URL, with the markup as a check.

A page becomes lines, a block of text each, of four kinds: in an ``article`` or ``main`` element; in an
element whose name, role or class says that it is no content; within an article but under a class that only
hints at that; or plain.  Pages of a host that are equal but for lines of no content count as one, under the
first of their paths.  These are put in the order of their URL paths, and each is paired with that of its
two neighbours which shares the longer beginning of the path, or with the other if differencing with that one
deletes nothing, or all of a page without an article.  The lines of both outside their articles, and
the doubtful ones within, are aligned by longest common subsequence.  A line that both have belongs to the site and
goes, from every copy of the page.

The markup checks this from both sides.  An article's own lines stay, since pages may well share
passages of their articles; where there is an article, lines outside are none of it.  And of the lines that differencing
leaves, those that the markup calls no content go as well: adverts, menus and readers' comments may differ
from page to page.

The order comes from a range partitioning of rows without their html, so a host with a third of all
pages is spread over many tasks, and neighbours meet by their position in it.  Copies become one row before that,
within each task first.  The html itself stays where it is, unless the list of lines to delete is long
(its length, in lines, is checked).

Nulls: null and empty html have an empty text; a null url has an empty host and path.  A very long page is one
row like any other; its lines are aligned by bit rows.  Ties: of two neighbours that share equally much of the path the
earlier one is taken.  Repeated rows are rows each, with equal texts.  An empty table gives no rows.
"""

from __future__ import annotations

import html
import os.path
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.common import NO_ID, arrow_map, cut_lineage, free_names, shuffle_partitions, slices, table, written
from colloquy.llm.url_filter import host_of, path_of

PLAIN, MAIN, NOISE, DOUBT = 0, 1, 2, 3

# Elements and words that mark what is no content, and the elements that end a block.
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title object canvas".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent gdpr notice notices "
    "alert comment comments reply replies disqus nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip search form".split()
)
#: Beside a word of the above, these leave a class name as it is: ``comment-list``, ``site-footer``, ``sidebar-2``.
FRAME_WORDS = frozenset(
    "site page main top bottom left right upper lower inner outer bar box list item items block section area slot container wrapper wrap panel unit row column "
    "button buttons link links text body content user reader readers posts links primary secondary global sticky fixed thread".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind ends open ones of the second.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_NOISE = frozenset("html body article main".split())

#: A quote opens a value only after an equals sign.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s*=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
MAIN_MARK = re.compile(r"""\b(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}

#: Lines in a list of deletions that is broadcast: some 20 MB.
SHORT_LIST = 2_000_000


def named_noise(value: str) -> int:
    """What a class or an id says: 2 if one of its names is no content's, 1 if a name has such a word among others."""
    found = 0
    for name in value.strip("\"'").split():
        words = {w.lower() for w in WORD.findall(name)}
        if words.isdisjoint(NOISE_WORDS):
            continue
        if all(w in NOISE_WORDS or w in FRAME_WORDS or w.isdigit() for w in words):
            return 2
        found = 1
    return found


def says_noise(tag: str, attributes: str) -> int:
    """2 if an element is no content, 1 if that is in doubt."""
    if tag in NEVER_NOISE:
        return 0
    if tag in NOISE_TAGS:
        return 2
    found = 0
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id"):
                found = max(found, named_noise(value))
            elif name == "role":
                found = 2 if value.strip("\"'").lower() in NOISE_ROLES else found
            elif name == "hidden" or (name == "aria-hidden" and "true" in value.lower()):
                found = 2
    return found


def says_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(MAIN_MARK.search(attributes))


def page_lines(text: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with its kind; white space is one space."""
    lines: list[tuple[str, int]] = []
    block: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # (tag, noise, main)
    noise = doubt = inside = 0  # open elements of noise, of doubtful noise, and of article or main
    at, end = 0, len(text)

    def close_block() -> None:
        if block:
            line = " ".join(html.unescape("".join(block)).split())
            block.clear()
            if line:
                lines.append((line, NOISE if noise else PLAIN if not inside else DOUBT if doubt else MAIN))

    def push(tag: str, is_noise: int, is_main: bool) -> None:
        nonlocal noise, doubt, inside
        stack.append((tag, is_noise, is_main))
        noise += is_noise == 2
        doubt += is_noise == 1
        inside += is_main

    def pop() -> None:
        nonlocal noise, doubt, inside
        _, was_noise, was_main = stack.pop()
        noise -= was_noise == 2
        doubt -= was_noise == 1
        inside -= was_main

    while at < end:
        found = TAG.search(text, at)
        if found is None:
            block.append(text[at:])
            break
        block.append(text[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE_TAGS:
                close_block()
            i = len(stack) - 1
            while i >= 0 and stack[i][0] != tag and (tag not in INLINE_TAGS or stack[i][0] in INLINE_TAGS):
                i -= 1  # an inline element ends within its own block only
            if i >= 0 and stack[i][0] == tag:
                if any(x[1] for x in stack[i:]):
                    close_block()
                while len(stack) > i:
                    pop()
            continue
        if tag == "br":
            block.append(" ")
            continue
        if tag in VOID_TAGS:
            if tag not in INLINE_TAGS:
                close_block()
            continue
        is_noise = says_noise(tag, attributes)
        if tag not in INLINE_TAGS or is_noise:
            close_block()
            ends = ENDED_BY.get(tag, ())
            while tag not in INLINE_TAGS and stack and (stack[-1][0] == "p" or stack[-1][0] in ends or (stack[-1][0] in INLINE_TAGS and not stack[-1][1])):
                pop()
        if attributes.endswith("/") and tag in RAW_TAGS:
            continue
        if tag in RAW_TAGS:
            stop = RAW_END[tag].search(text, at)
            at = end if stop is None else stop.start()
            push(tag, is_noise, False)
            continue
        push(tag, is_noise, says_main(tag, attributes))
    close_block()
    return lines


def line_codes(lines: list[tuple[str, int]]) -> list[int]:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x, _ in lines), np.uint64, len(lines)).view(np.int64).tolist()


def main_text(lines: list[tuple[str, int]], gone: set[int]) -> tuple[str, int]:
    """A page's text without the lines whose codes are in ``gone``, and how many lines go for that reason."""
    wanted = (MAIN, DOUBT) if any(k in (MAIN, DOUBT) for _, k in lines) else (PLAIN,)
    shared = [k != MAIN and c in gone for c, (_, k) in zip(line_codes(lines), lines, strict=True)] if gone else [False] * len(lines)
    return " ".join(x for (x, k), s in zip(lines, shared, strict=True) if k in wanted and not s), sum(shared)


def site_lines(codes: list[int], kinds: bytes, others: list[tuple[list[int], bytes]]) -> list[int]:
    """Codes of the page's lines that the first of the ``others`` has too with which anything, but not all, would go."""
    own = [c for c, k in zip(codes, kinds, strict=True) if k != MAIN]
    for other, other_kinds in others:
        drop = {own[i] for i in common_subsequence(own, [c for c, k in zip(other, other_kinds, strict=True) if k != MAIN])}
        if drop and (MAIN in kinds or any(k in (PLAIN, DOUBT) and c not in drop for c, k in zip(codes, kinds, strict=True))):
            return sorted(drop)
    return []


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``, by bit-parallel rows."""
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    if not places:
        return []
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, now = [full], full
    for i in places:
        hit = now & masks[a[i]]
        now = ((now + hit) | (now - hit)) & full
        rows.append(now)
    out = []
    i, j = len(places), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i -= 1
            j -= 1
            out.append(places[i])
    return out[::-1]


def line_rows(pages: DataFrame) -> DataFrame:
    """page, code, host, path, and the codes and kinds of the page's lines, with ``same``, which pages of equal
    lines but those of no content share; ``pages``: page, code, host, path, html."""

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 500):
            rows = batch.slice(part.start, part.stop - part.start)
            codes, kinds, same = [], [], []
            for text in rows.column(4).to_pylist():
                lines = page_lines(text or "")
                codes.append(line_codes(lines))
                kinds.append(bytes(k for _, k in lines))
                own = [x for x in zip(codes[-1], kinds[-1], strict=True) if x[1] != NOISE]
                same.append(xxhash.xxh3_128_digest(np.array([c for c, _ in own], np.int64).tobytes() + bytes(k for _, k in own)))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(4)), pa.array(codes, pa.list_(pa.int64())), pa.array(kinds, pa.binary()), pa.array(same, pa.binary())],
                names=["page", "code", "host", "path", "codes", "kinds", "same"],
            )

    return arrow_map(pages, scan, "page long, code long, host string, path string, codes array<long>, kinds binary, same binary")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the order of host, path and content, from 0."""
    spark = rows.sparkSession
    keys = ["host", "path", "same"]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = cut_lineage(counts.select("part", F.coalesce(before, F.lit(0)).alias("start")))
    place = F.col("start") + F.col("at") - F.shiftleft(F.col("part"), 33)
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(*rows.columns, place.alias("place"))


def shared_lines(rows: DataFrame) -> DataFrame:
    """host, same and the codes of lines to delete, for contents that have any."""
    first = F.min_by(F.struct("path", "codes", "kinds"), F.struct("path", "page", "code"))
    contents = rows.where(F.size("codes") > 0).groupBy("host", "same").agg(first.alias("x")).select("host", "same", "x.*")
    order = written(numbered(contents), "page-order")
    side = lambda name, step: order.select(
        (F.col("place") + step).alias("place"), *(F.col(c).alias(f"{name}_{c}") for c in ("host", "path", "codes", "kinds"))
    )
    paired = order.join(side("before", 1), "place", "left").join(side("after", -1), "place", "left")
    paired = paired.select("same", "host", "path", "codes", "kinds", *(f"{n}_{c}" for n in ("before", "after") for c in ("host", "path", "codes", "kinds")))

    def scan(batch: pa.RecordBatch):
        hosts, sames, drops = [], [], []
        for row in batch.to_pylist():
            near = [
                (-len(os.path.commonprefix([row["path"], row[f"{name}_path"]])), row[f"{name}_codes"], row[f"{name}_kinds"])
                for name in ("before", "after")
                if row[f"{name}_codes"] is not None and row[f"{name}_host"] == row["host"]
            ]
            near.sort(key=lambda x: x[0])
            drop = site_lines(row["codes"], row["kinds"], [x[1:] for x in near])
            if drop:
                hosts.append(row["host"])
                sames.append(row["same"])
                drops.append(drop)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(sames, pa.binary()), pa.array(drops, pa.list_(pa.int64()))], names=["host", "same", "drop"])

    return arrow_map(paired, scan, "host string, same binary, drop array<long>")


def short(rows: DataFrame) -> DataFrame:
    lines = rows.agg(F.sum(F.size("drop") + 4)).first()[0] or 0
    return F.broadcast(rows) if lines <= SHORT_LIST else rows


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` and ``n_shared`` (lines that differencing deletes) added.

    Null and empty html have an empty text.  Pages without a host are neighbours of each other; a page whose
    host has only its copies deletes nothing by differencing, nor does one without an article that would lose
    all of its lines; equal pages of a host have equal texts.  Columns of ``pages`` with the added names are replaced.
    """
    pages = pages.drop("main_text", "n_shared")
    page, code, drop = free_names(pages, "page", "code", "drop")
    text_code = F.xxhash64(F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit("")))
    keyed = pages.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(page), text_code.alias(code))
    rows = written(line_rows(keyed.select(page, code, host_of(F.col(url_col)), path_of(F.col(url_col)), html_col)), "page-lines")
    shared = short(written(shared_lines(rows), "page-shared"))
    drops = written(rows.join(shared, ["host", "same"]).select("page", "code", "drop").dropDuplicates(["page", "code"]), "page-drops")
    drops = short(drops).toDF(page, code, drop)
    told = keyed.join(drops, [page, code], "left").select(*keyed.columns, drop)
    html_at, drop_at, names = told.schema.names.index(html_col), len(keyed.columns), pages.columns

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 500):
            own = batch.slice(part.start, part.stop - part.start)
            found = [main_text(page_lines(text or ""), set(gone or ())) for text, gone in zip(own.column(html_at).to_pylist(), own.column(drop_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*own.columns[: len(names)], pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[*names, "main_text", "n_shared"]
            )

    return arrow_map(told, scan, StructType([*pages.schema.fields, *StructType.fromDDL("main_text string, n_shared long").fields]))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "n_shared")
