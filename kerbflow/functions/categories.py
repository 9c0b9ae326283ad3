"""Event categories and direction labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbflow.functions.cleaning import strip

# Display order of event categories and their accepted aliases.
CATEGORY_ORDER = (
    "Federal holiday",
    "Sports",
    "Concerts & music festivals",
    "Parades & civic festivals",
    "Convention / expo",
    "Civic / city event",
    "Other event",
)
CATEGORY_ALIASES = {
    "Sporting event": "Sports",
    "Sports event": "Sports",
    "Concert/festival": "Concerts & music festivals",
    "Concert": "Concerts & music festivals",
    "Festival/parade": "Parades & civic festivals",
    "Parade": "Parades & civic festivals",
    "Entertainment event": "Civic / city event",
    "NYC event": "Civic / city event",
    "Custom event": "Other event",
}
# Name keywords, first match wins.
CATEGORY_KEYWORDS = (
    ("open|marathon|half", "Sports"),
    ("festival|parade|pride", "Parades & civic festivals"),
    ("concert|ball", "Concerts & music festivals"),
)
OTHER_EVENT = "Other event"
CITY_EVENT = "Civic / city event"

# Display order of areas.
AREA_ORDER = (
    "Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island", "EWR", "Unknown",
)


def event_category(c: Column, aliases: Mapping[str, str] = CATEGORY_ALIASES) -> Column:
    """Trimmed category with aliases resolved; missing or blank is 'Other event'."""
    text = strip(c)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(
        F.try_element_at(table, text), F.nullif(text, F.lit("")), F.lit(OTHER_EVENT)
    )


def category_from_name(name: Column) -> Column:
    """Guess a category from keywords in an event's name."""
    text = F.lower(name)
    rules = F.lit(None).cast("string")
    for pattern, category in reversed(CATEGORY_KEYWORDS):
        rules = F.when(text.rlike(pattern), F.lit(category)).otherwise(rules)
    return F.coalesce(rules, F.lit(CITY_EVENT))


def rank_in(c: Column, order: Sequence[str]) -> Column:
    """1-based position in a fixed order; null when not listed (sort nulls last)."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0))


def direction(delta: Column) -> Column:
    return (
        F.when(delta > 0, "Positive").when(delta < 0, "Negative").otherwise("Flat")
    )
