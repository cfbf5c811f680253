"""Dates, sizes and captions as column expressions (and the few that drivers need as plain functions)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths a scale bar may have, in metres.
NICE = (10, 20, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000, 20000, 50000)
LONGEST = 100000
DECREASE, INCREASE = "#ff3b30", "#00c8ff"


def lookback_days(images: int) -> int:
    """Days to look back for so many passes, 12 days apart at worst."""
    return max(90, 30 + 12 * images)


def day_label(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def span_label(first: Column, last: Column) -> Column:
    """1 Apr – 19 May 2021; one date alone; both years where they differ."""
    head = F.when(F.year(first) == F.year(last), F.date_format(first, "d MMM")).otherwise(day_label(first))
    return F.when(first == last, day_label(first)).otherwise(F.concat(head, F.lit(" – "), day_label(last)))


def day_list(days: Column) -> Column:
    """22 Jun, 28 Jun, 4 Jul 2026 of an array of dates."""
    ordered = F.array_sort(days)
    return F.concat(F.array_join(F.transform(ordered, lambda d: F.date_format(d, "d MMM")), ", "), F.date_format(F.element_at(ordered, -1), " yyyy"))


def km2_label(x: Column) -> Column:
    return F.concat(F.when(x >= 100, F.format_number(x, 0)).when(x >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x)), F.lit(" km²"))


def size_label(mb: Column) -> Column:
    return F.when(mb >= 1000, F.format_string("%.1f GB", mb / 1000)).otherwise(F.concat(F.format_number(mb, 0), F.lit(" MB")))


def nice_length(metres: Column) -> Column:
    fit = F.filter(F.array(*map(F.lit, NICE)), lambda v: v >= metres)
    return F.coalesce(F.array_min(fit), F.lit(LONGEST))


def length_label(metres: Column) -> Column:
    return F.when(metres >= 1000, F.format_string("%d km", F.floor(metres / 1000))).otherwise(F.format_string("%d m", metres.cast("long")))


def rgb(colour: Column) -> Column:
    """[r, g, b] of #rrggbb."""
    return F.array(*[F.conv(F.substring(colour, i, 2), 16, 10).cast("int") for i in (2, 4, 6)])


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def plural(n: Column, noun: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {noun}"), F.when(n != 1, "s").otherwise(""))


def day_text(day: dt.date) -> str:
    return f"{day.day} {day:%b %Y}"
