"""Names and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_dir(page_number: Column) -> Column:
    return F.format_string("page-%04d", page_number.cast("int"))


def page_stem(render_id: Column, page: Column) -> Column:
    return F.concat(render_id, F.format_string("-p%03d", page.cast("int")))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def page_number_of(name: Column) -> Column:
    """Numeric page suffix of a rendered file name."""
    return F.nullif(F.regexp_extract(name, r"-page(\d+)\.png$", 1), F.lit("")).try_cast("int")


def is_confined(path: Column) -> Column:
    """Relative and without a parent step."""
    return ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")


def is_http_url(url: Column) -> Column:
    """Absolute HTTP(S) URL with a host part; never raises on odd input."""
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#]+"), F.lit(False))
