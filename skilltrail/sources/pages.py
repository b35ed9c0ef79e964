"""Saved web pages as listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_location, squeeze_lines, unescape, url_key, visible_text


def page_text(pages: DataFrame) -> DataFrame:
    """Pages with their visible text in place of the markup."""
    return pages.select(
        *[c for c in pages.columns if c != "html"], visible_text(F.col("html")).alias("text")
    )


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _inner_text(markup: Column) -> Column:
    return squeeze_lines(unescape(F.regexp_replace(markup, "(?s)<[^>]*>", "")))


def _element(html: Column, name: str) -> Column:
    """Content of the element with that id, up to its own end tag; null without one."""
    opening = rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*\sid\s*=\s*(?:"{name}"|'{name}'|{name}(?=[\s>]))[^>]*>"""
    tag = F.regexp_extract(html, opening, 1)
    rest = F.regexp_extract(html, opening + "(.*)$", 2)
    # Elements of the same kind inside it are counted, so that their ends do not end it.
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)")))
    start = F.struct(F.lit(1).alias("open"), F.lit("").alias("content"))

    def step(state, piece):
        tagged = F.lower(piece)
        change = (
            F.when(tagged.startswith(F.concat(F.lit("</"), F.lower(tag))), -1)
            .when(tagged.startswith(F.concat(F.lit("<"), F.lower(tag))), 1)
            .otherwise(0)
        )
        still = state["open"] + change
        inside = F.when(still > 0, F.concat(state["content"], piece)).otherwise(state["content"])
        return F.when(state["open"] <= 0, state).otherwise(
            F.struct(still.alias("open"), inside.alias("content"))
        )

    content = F.aggregate(pieces, start, step, lambda state: state["content"])
    return F.when(html.rlike(opening), content)


def listing_fields(
    pages: DataFrame, key: list[str], block: str = "h2", column: str = "resultsCol"
) -> DataFrame:
    """Rows `(*key, pos, title, href, unique_url, location)` of a saved results page.

    A result runs from one `block` tag to the next, so a result without a location
    has none instead of its neighbour's. Where the page names a results column, only
    what stands inside that element is read.
    """
    results = F.coalesce(_element(F.col("html"), column), F.col("html"))
    blocks = F.split(results, rf"(?i)<{block}\b")
    # The first piece lies before the first result.
    found = pages.select(
        *key, F.posexplode_outer(F.slice(blocks, 2, F.size(blocks))).alias("pos", "piece")
    ).where(F.col("piece").isNotNull())
    link = F.regexp_extract("piece", r"(?is)<a\b[^>]*>", 0)
    text = F.regexp_extract("piece", r"(?is)<a\b[^>]*>(.*?)</a\s*>", 1)
    location = F.regexp_extract(
        "piece",
        r"""(?is)<span\b[^>]*class\s*=\s*["'][^"']*\blocation\b[^"']*["'][^>]*>(.*?)</span""",
        1,
    )
    fields = found.select(*key, "pos", link.alias("link"), text.alias("text"), location.alias("at"))
    title = _attribute(F.col("link"), "title")
    href = unescape(_attribute(F.col("link"), "href"))
    return fields.where(F.col("link") != "").select(
        *key,
        "pos",
        F.when(title != "", unescape(title)).otherwise(_inner_text(F.col("text"))).alias("title"),
        href.alias("href"),
        url_key(href).alias("unique_url"),
        clean_location(_inner_text(F.col("at"))).alias("location"),
    )
