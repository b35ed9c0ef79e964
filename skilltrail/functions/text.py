"""Text as column expressions: normal forms, display forms, keys and page text."""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings folded together before matching, applied in this order.
SPELLING_FOLDS = [("re-", "re"), ("co-", "co"), ("non-", "non"), ("&", "and"), (",", "")]

# Resume section headings that are not skills there.
RESUME_HEADINGS = ["education", "publications", "philosophy"]

# File types accepted as resumes.
RESUME_EXTENSIONS = ["pdf"]

# Character references of the HTML standard; `html5` names the characters of the named ones. Those
# that may lack their semicolon are listed without it, too, and have six letters at most.
REFERENCE = re.compile("(&#(?:[0-9]+|[xX][0-9a-fA-F]+);?|&[A-Za-z][A-Za-z0-9]*;?)")
LONGEST_OPEN_NAME = max(len(name) for name in html5 if not name.endswith(";"))

# Numbers that the standard reads in the Windows code page instead.
CODE_PAGE = {
    n: bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)
}

# Line breaks and blanks, as Java and RE2 character classes both read them.
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
BLANKS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"

ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
WORD_CLASS = r"\p{L}\p{N}_"


def _fold(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column) -> Column:
    """Drop blanks of any kind at both ends."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def normalise(text: Column) -> Column:
    """Form in which texts and skills are matched."""
    return F.replace(_fold(F.lower(text), SPELLING_FOLDS), F.lit("-"), F.lit(" "))


def format_skill(skill: Column) -> Column:
    """Lookup key of a skill as a user typed it."""
    return strip(normalise(skill))


def format_career(career: Column) -> Column:
    """Lookup key of a career title: lowercase, plus signs for spaces."""
    return F.lower(F.replace(career, F.lit(" "), F.lit("+")))


def career_display(career: Column) -> Column:
    """Key back to a title: every run of letters starts with a capital."""
    runs = F.regexp_extract_all(
        F.replace(career, F.lit("+"), F.lit(" ")), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1
    )
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_title(line: Column) -> Column:
    """One line of a title list without zero-width characters and outer blanks."""
    return strip(F.translate(line, ZERO_WIDTH, ""))


def title_career(line: Column) -> Column:
    """Career key of one line of a title list."""
    return F.translate(format_career(clean_title(line)), ",", "")


def clean_location(location: Column) -> Column:
    """City and state: no digits, nothing from the first bracket on."""
    letters = F.translate(location, "0123456789", "")
    return F.regexp_replace(F.substring_index(letters, "(", 1), f"[{BLANKS}]+$", "")


def url_key(url: Column) -> Column:
    """Part of a URL after scheme and host."""
    return F.regexp_replace(url, "^https?://[^/]+", "")


def listing_link(base: str, key: Column) -> Column:
    """Absolute link of a listing key."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(key, "^/+", ""))


def file_extension(path: Column) -> Column:
    """What follows the last dot, lowercase; empty when there is no dot."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)\z", 1))


def has_allowed_extension(path: Column, allowed=tuple(RESUME_EXTENSIONS)) -> Column:
    """Whether the file may be taken as a resume."""
    return file_extension(path).isin(*allowed)


def lower_all(words: Column) -> Column:
    """Lowercase every element of an array."""
    return F.transform(words, F.lower)


def word_tokens(text: Column) -> Column:
    """Lowercase runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD_CLASS}]+)"), 1)


def _numeric_reference(digits: str) -> str:
    """`65` or `x41` to its character; no such character gives the replacement character."""
    base = 16 if digits[0] in "xX" else 10
    digits = digits.lstrip("xX0")
    # More digits than the last code point has are beyond it.
    number = int(digits, base) if 0 < len(digits) <= 7 else 0
    if number == 0 or number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
        return "\ufffd"
    return CODE_PAGE.get(number, chr(number))


def _named_reference(name: str) -> str:
    """`eacute;`, or the longest open name it begins with; anything else stays."""
    for length in (len(name), *range(min(LONGEST_OPEN_NAME, len(name)), 1, -1)):
        if name[:length] in html5:
            return html5[name[:length]] + name[length:]
    return f"&{name}"


@lru_cache(maxsize=1 << 16)
def _resolved(reference: str) -> str:
    if reference[1] == "#":
        return _numeric_reference(reference[2:].rstrip(";"))
    return _named_reference(reference[1:])


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    """Texts cut at their references, which a task works out once each."""

    def unescaped(text: str | None) -> str | None:
        if text is None or "&" not in text:
            return text
        parts = REFERENCE.split(text)
        parts[1::2] = map(_resolved, parts[1::2])
        return "".join(parts)

    return pd.Series([unescaped(text) for text in texts], dtype=object)


def unescape(text: Column) -> Column:
    """Resolve every character reference of the HTML standard, once, from left to right.

    A numeric reference or an old name may lack its semicolon; unknown names stay as they are.
    """
    return _unescaped(text)


def squeeze_lines(text: Column) -> Column:
    """Trim every line, drop the empty ones, join the rest by one space."""
    return strip(
        F.regexp_replace(text, f"[{BLANKS}]*[{LINE_BREAKS}][{BLANKS}{LINE_BREAKS}]*", " ")
    )


def visible_text(html: Column) -> Column:
    """Text a reader sees: no head, title, scripts, styles, comments or tags."""
    body = F.regexp_replace(
        html, r"(?is)<!--.*?-->|<(style|script|head|title)\b[^>]*>.*?</\1\s*>", ""
    )
    return squeeze_lines(unescape(F.regexp_replace(body, "(?s)</?[a-zA-Z!?][^>]*>", "")))
