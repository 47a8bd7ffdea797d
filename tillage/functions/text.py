"""Text rules: hosts, links, severity, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that grade a report's title, worst grade first.
SEVERITY = (("high", ("famine", "ipc 5", "catastrophe", "starvation")), ("med", ("crisis", "emergency", "ipc 4", "acute")))
#: Entities that landing pages use in links.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unescape_html(x: Column | str) -> Column:
    out = _col(x)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def first_link(html: Column | str, pattern: str) -> Column:
    """The first match of a pattern in a page, unescaped; null if there is none."""
    return unescape_html(F.nullif(F.regexp_extract(_col(html), pattern, 0), F.lit("")))


def url_host(url: Column | str) -> Column:
    """The third part of a url between slashes (port and user kept); null without ://."""
    url = _col(url)
    return F.when(url.contains("://"), F.split_part(url, F.lit("/"), F.lit(3)))


def severity(title: Column | str, grades=SEVERITY, least: str = "low") -> Column:
    """The first grade of which a word stands in the lower-cased title; least if none, also for null."""
    low = F.lower(F.coalesce(_col(title), F.lit("")))
    out = F.lit(least)
    for grade, words in reversed(grades):
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, grade).otherwise(out)
    return out


def matches(needle: str, *columns: Column | str) -> Column:
    """Whether the needle stands in the columns' joined text, in either case; an empty needle matches all."""
    return F.lower(F.concat_ws(" ", *(_col(c).cast("string") for c in columns))).contains(needle.lower().strip())


def header_key(x: Column | str) -> Column:
    """A header without case, blanks, underscores and (cpc), by which headings are compared."""
    return F.regexp_replace(F.lower(_col(x)), r"[ _]|\(cpc\)", "")


def trimmed_parts(x: Column | str, separator: str) -> Column:
    """Split at a plain separator, each part trimmed."""
    return F.transform(F.split(_col(x), "\\Q" + separator + "\\E"), lambda p: F.trim(p))


def in_language(x: Column | str, language: str = "UNICODE") -> Column:
    """A text that compares as people sort it: letters first, then accents, then small before capital; UNICODE or a language such as de or sv, with _CI or _AI to ignore case or accents."""
    return F.collate(_col(x), language)
