"""Link discovery over pages and month-to-URL lookup."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions.cleaning import strip

# How trip-record links are recognised and typed.
LINK_FOLDER = "trip-data"
LINK_SUFFIX = ".parquet"
MONTH_IN_LINK = r"_(\d{4}-\d{2})\.parquet(?:\?|$)"
RECORD_TYPES = {
    "fhvhv_tripdata_": "hvfhv",
    "fhv_tripdata_": "fhv",
    "yellow_tripdata_": "yellow",
    "green_tripdata_": "green",
}
#: Named characters of HTML as Python knows them.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

#: Where a link stands; the last one by these wins.
PLACE = ("page_id", "position")

NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR_WITH_LINK = r"(?i)<a\s(?=[^>]*\bhref\s*=)"
HREF = r"""(?i)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    point = F.when(valid, code).when(code.isNotNull(), F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def resolved(text: Column) -> Column:
    """Character references replaced, in one pass: ``&amp;lt;`` becomes ``&lt;``.

    Named ones are looked up, numbers (decimal, or hexadecimal behind an x) decoded by
    code point; references without a semicolon or of an unknown name stay.
    """
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def piece(part: Column, k: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        number = F.regexp_extract(part, r"^#([0-9]{1,9});", 1)
        hexed = F.regexp_extract(part, r"^#[xX]([0-9A-Fa-f]{1,7});", 1)
        code = F.when(number != "", number.try_cast("bigint")).when(
            hexed != "", F.conv(hexed, 16, 10).try_cast("bigint"))
        plain = F.coalesce(_character(code), names[name])
        rest = F.substr(part, F.locate(";", part) + 1)
        return F.when(k == 0, part).otherwise(
            F.coalesce(F.concat(plain, rest), F.concat(F.lit("&"), part)))

    pieces = F.transform(F.split(text, "&"), piece)
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def page_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Anchors of each page in order: (keep, position, href, label).

    A page is cut at every anchor that carries a link; the piece up to the closing
    tag holds its attributes and label. An anchor that is not closed before the
    next one is dropped. Pieces of a label that tags separate are joined by a space.
    """
    markup = F.regexp_replace(html, NOT_MARKUP, "")
    pieces = F.slice(F.split(markup, ANCHOR_WITH_LINK), 2, 2**31 - 1)
    cut = pages.select(*keep, F.posexplode(pieces).alias("position", "piece"))
    inside = F.regexp_extract("piece", r"(?is)^([^>]*)>(.*?)</a\s*>", 2)
    attributes = F.regexp_extract("piece", r"(?s)^([^>]*)>", 1)
    quoted = [F.regexp_extract(attributes, HREF, i) for i in (1, 2, 3)]
    href = resolved(F.concat(*quoted))
    label = resolved(strip(F.regexp_replace(inside, r"(?:<[^>]*>)+", " ")))
    closed = F.col("piece").rlike(r"(?is)^[^>]*>.*?</a\s*>")
    return cut.filter(closed).select(
        *keep, "position", href.alias("href"), label.alias("label")
    ).filter("href <> ''")


def trip_record_links(
    links: DataFrame,
    folder: str = LINK_FOLDER,
    suffix: str = LINK_SUFFIX,
    types: Mapping[str, str] = RECORD_TYPES,
) -> DataFrame:
    """Typed month links: (month, year, record_type, label, url)."""
    url = F.col("href")
    file_name = F.lower(F.substring_index(url, "/", -1))
    kind = F.lit(None).cast("string")
    for prefix, name in reversed(list(types.items())):
        kind = F.when(file_name.startswith(prefix), name).otherwise(kind)
    month = F.nullif(F.regexp_extract(F.lower(url), MONTH_IN_LINK, 1), F.lit(""))
    return (
        links.filter(url.contains(folder) & F.lower(url).endswith(suffix))
        .select(
            month.alias("month"),
            F.substring(month, 1, 4).alias("year"),
            kind.alias("record_type"),
            "label",
            url.alias("url"),
            *[c for c in PLACE if c in links.columns],
        )
        .dropna(subset=["month", "record_type"])
    )


def month_urls(
    months: DataFrame, links: DataFrame, record_type: str, template: str
) -> DataFrame:
    """URL per month: the last link found for it, else ``template`` (``%s`` = month).

    The last is the one furthest down by page and position; links without a place are
    ordered by URL.
    """
    place = F.struct(*[c for c in (*PLACE, "url") if c in links.columns])
    found = (
        links.filter(F.col("record_type") == record_type)
        .groupBy("month")
        .agg(F.max_by("url", place).alias("found"))
    )
    default = F.format_string(template, F.col("month"))
    return months.join(found, "month", "left").select(
        "month", F.coalesce("found", default).alias("url")
    )
