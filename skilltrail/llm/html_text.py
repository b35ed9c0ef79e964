"""Main text of web pages: structure first, then differences to the page of the nearest URL.

A page becomes lines, one per block. What stands in menus, headers, footers, sidebars, forms,
adverts, notices or comments by element, role or class is no candidate. Pages are paired inside
each host with the page of nearest URL path, the two lists of lines are aligned by longest common
subsequence, and shared lines, the furniture of the site, are deleted. Lines of an article element
are protected, as pages may share them. Without a partner to tell furniture by, a page with an
article has the article's lines as text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltrail.llm.url_filter import host_of, path_of
from skilltrail.session import cut

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I | re.S)
_PART = re.compile(r"[a-z0-9]+")

#: Elements whose content is text to skip up to their end tag, whatever it looks like.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that never hold main text.
OUTSIDE = {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "select", "button",
    "dialog", "menu", "object", "canvas", "audio", "video", "map", "datalist", "fieldset", "label",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Words of a class or id that mark an element as no part of the text.
FURNITURE = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager",
    "pagination", "popup", "promo", "promotion", "replies", "reply", "respond", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
REMARKS = {"comment", "comments", "disqus", "replies", "reply"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
HOLDERS = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that the next of their kind ends, also without an end tag.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "option": {"option"}}


def _is_outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return name not in HOLDERS
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            words = set(_PART.findall(value))
            if words & (REMARKS if name in HOLDERS else FURNITURE):
                return True
            if "header" in words and not in_article and name in ("div", "section"):
                return True
    return False


def page_lines(html: str | None) -> tuple[list[str], list[bool], list[str]]:
    """The lines of a page by its structure alone, and all candidates, with those inside article elements marked."""
    html = html or ""
    inside: list[str] = []
    every: list[str] = []
    marks: list[bool] = []
    piece: list[str] = []
    depth = 0  # open article or main elements
    skipping, nested = "", 0  # element that is no part of the text, and those of its name inside
    at = 0

    def close() -> None:
        if piece:
            line = " ".join("".join(piece).split())
            piece.clear()
            if line:
                every.append(line)
                marks.append(depth > 0)
                if depth:
                    inside.append(line)

    size = len(html)
    while at < size:
        begin = html.find("<", at)
        begin = size if begin < 0 else begin
        if begin > at and not skipping:
            piece.append(unescape(html[at:begin]))
        if begin == size:
            break
        tag = _TAG.match(html, begin)
        if tag is None:  # a bare <
            if not skipping:
                piece.append("<")
            at = begin + 1
            continue
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        ending, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in RAW and not ending:
            end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            if name in BLOCKS and not skipping:
                close()
            continue
        if skipping:
            if name == skipping:
                nested += -1 if ending else name not in VOID and name not in ENDED_BY
                if nested < 0 or not ending and name in ENDED_BY:
                    skipping = ""
            if skipping and not ending and name in ENDED_BY.get(skipping, ()):
                skipping = ""
            if skipping or ending:
                continue
        if name in BLOCKS:
            close()
        if ending:
            if name in ("article", "main"):
                depth = max(0, depth - 1)
        elif name not in VOID and not attributes.endswith("/") and _is_outside(name, attributes, depth > 0):
            close()
            skipping, nested = name, 0
        elif name in ("article", "main"):
            depth += 1
    close()
    return inside or every, marks, every


def shared_lines(one: list[int], other: list[int]) -> list[int]:
    """Places in `one` of a longest common subsequence with `other`."""
    head = 0
    while head < min(len(one), len(other)) and one[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(one), len(other)) - head and one[-1 - tail] == other[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(other) - tail - 1, head - 1, -1):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []  # least end in `other` of a common subsequence of each length
    links: list[tuple] = []
    for i in range(head, len(one) - tail):
        for j in places.get(one[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(one) - tail, len(one))]


def _parsed(pages: DataFrame) -> DataFrame:
    """All columns of `pages`, and its candidate lines, which are inside an article, host, path and prints."""
    at = pages.columns.index("html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                found = [page_lines(html) for html in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *some.columns,
                        pa.array([marks for _, marks, _ in found], pa.list_(pa.bool_())),
                        pa.array([every for _, _, every in found], pa.list_(pa.string())),
                    ],
                    names=[*some.schema.names, "_inside", "_every"],
                )

    schema = pages.select("*", F.array(F.lit(False)).alias("_inside"), F.array(F.lit("")).alias("_every")).schema
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.mapInArrow(parse, schema).withColumns(
        {
            "_host": host,
            "_path": path,
            "_k1": F.xxhash64(host, path, "_every", "_inside"),
            "_k2": F.xxhash64(F.lit(7), "_inside", "_every", path, host),
        }
    )


def _shared(parsed: DataFrame) -> DataFrame:
    """Marks of the lines shared with the page of nearest path, for distinct pages whose text they change.

    Neighbours with the same lines are one entry, whose partner is the last page of the entry
    before it or the first page of the one behind it; all its pages lose the same lines.
    """
    keys = ["_host", "_path", "_k1", "_k2"]
    hashes = F.transform("_every", lambda x: F.xxhash64(x)).alias("_hashes")
    listed = (
        parsed.where("_host != ''")
        .select(*keys, "_inside", hashes)
        .dropDuplicates(["_k1", "_k2"])
        .repartitionByRange(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    listed = cut(listed)

    def run(inside: Window) -> Column:
        """Number of the entry: one more where host or lines change."""
        lines = F.struct("_host", "_hashes")
        return F.lag(F.lit(1)).over(inside).isNull() | ~F.lag(lines).over(inside).eqNullSafe(lines)

    inside = Window.partitionBy("_part").orderBy(*keys)
    numbered = cut(listed.withColumn("_new", run(inside).cast("int")).withColumn("_run", F.sum("_new").over(inside)))
    order = F.struct(*keys)
    entries = numbered.groupBy("_part", "_run").agg(
        F.first("_host").alias("_host"),
        F.first("_hashes").alias("_hashes"),
        F.min(order).alias("_low"),
        F.max(order).alias("_high"),
    )
    first = F.struct("_host", F.col("_low._path").alias("_path"), "_hashes")
    last = F.struct("_host", F.col("_high._path").alias("_path"), "_hashes")
    runs = Window.partitionBy("_part").orderBy("_run")
    entries = cut(
        entries.withColumns(
            {
                "_first": first,
                "_last": last,
                "_prev": F.lag(last).over(runs),
                "_next": F.lead(first).over(runs),
                "_left": F.max("_run").over(Window.partitionBy("_part")) - F.col("_run"),
            }
        )
    )
    # An entry at an end of a part may go on in the parts beside it: two entries of each end tell.
    along = Window.orderBy("_part", "_run")
    edges = (
        entries.where("_run <= 2 or _left <= 1")
        .withColumn("_new", run(along).cast("int"))
        .withColumn("_whole", F.sum("_new").over(along))
    )
    place = F.struct("_part", "_run")
    wholes = edges.groupBy("_whole").agg(
        F.min_by("_first", place).alias("_first"), F.max_by("_last", place).alias("_last")
    )
    behind = wholes.select((F.col("_whole") - 1).alias("_whole"), F.col("_first").alias("_behind"))
    before = wholes.select((F.col("_whole") + 1).alias("_whole"), F.col("_last").alias("_before"))
    edges = (
        edges.where("_run = 1 or _left = 0")
        .select("_part", "_run", "_whole")
        .join(before, "_whole", "left")
        .join(behind, "_whole", "left")
        .drop("_whole")
    )
    rows = (
        entries.join(edges, ["_part", "_run"], "left").select(
            "_part",
            "_run",
            F.struct("_host", F.col("_low._path").alias("_from"), F.col("_high._path").alias("_to"), "_hashes").alias("own"),
            F.coalesce("_prev", "_before").alias("prev"),
            F.coalesce("_next", "_behind").alias("next"),
        )
    )

    def common(a: str, b: str) -> int:
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return n

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, before, behind in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                near = [(x, own[end]) for x, end in ((before, "_from"), (behind, "_to")) if x and x["_host"] == own["_host"]]
                partner, _ = max(near, key=lambda x: common(x[0]["_path"], x[1]), default=(None, None))
                marks = [False] * len(own["_hashes"]) if partner else None
                for place in shared_lines(own["_hashes"], partner["_hashes"]) if partner else ():
                    marks[place] = True
                found.append(marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.bool_()))],
                names=["_part", "_run", "_gone"],
            )

    gone = rows.mapInArrow(align, "_part int, _run long, _gone array<boolean>")
    marks = F.zip_with("_inside", "_gone", lambda kept, shared: ~kept & (shared != F.array_contains("_inside", True)))
    # With an article, lines outside that are not shared change the text; without, lines that are.
    # Mostly few pages: written, so that the texts need not be dealt out to meet them.
    return cut(
        numbered.join(gone.where("_gone is not null"), ["_part", "_run"])
        .where(F.exists(marks, lambda x: x))
        .select("_k1", "_k2", "_gone")
    )


def main_text(pages: DataFrame) -> DataFrame:
    """Every row of `pages` (url, html and any others) with text and n_chars.

    Character references are decoded, white space in a block is one space, blocks are joined
    in page order by one space; nothing else is dropped. A null or empty page, and one without
    text, has the empty text. A page whose URL has no host, or that has no partner with other
    lines in its host, keeps its articles' lines or, without any, all its candidate lines. Equal rows give equal rows. Columns named
    text and n_chars are replaced; an empty table stays empty.
    """
    pages = pages.drop("text", "n_chars")
    parsed = _parsed(pages)
    found = parsed.join(_shared(_parsed(pages.select("url", "html"))), ["_k1", "_k2"], "left")
    inside = lambda i: F.get("_inside", i)
    # Marks are looked up by place, so that a page costs as much as it has lines.
    differing = F.filter("_every", lambda x, i: inside(i) | ~F.get("_gone", i))
    by_structure = F.when(
        F.array_contains("_inside", True), F.filter("_every", lambda x, i: inside(i))
    ).otherwise(F.col("_every"))
    lines = F.when(F.col("_gone").isNull(), by_structure).otherwise(differing)
    text = found.select(*pages.columns, F.array_join(lines, " ").alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")
