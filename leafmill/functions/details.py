"""Details of log entries as values that no later change reaches, and in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(ts: Column) -> Column:
    """A time in UTC as the browser writes it, to the millisecond."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def snapshot(**details: Column) -> Column:
    """A VARIANT object of the details: structs, maps and arrays nest, null details stay as nulls, a detail that stands in
    several places stands in each. The order in which the details are given makes no difference."""
    return F.to_variant_object(F.struct(*[details[k].alias(k) for k in sorted(details)]))


def parsed(json: Column) -> Column:
    """The VARIANT of a JSON text; of a text that is none the text itself, so that no detail is lost."""
    found = F.try_parse_json(json)
    return F.when(json.isNotNull() & found.isNull(), F.parse_json(F.to_json(F.array(json)))).otherwise(found)


def detail(value: Column, path: str, kind: str) -> Column:
    """The value at a path, null where there is none or where it is of another kind."""
    return F.try_variant_get(value, path, kind)


def canonical(value: Column) -> Column:
    """The JSON text of a snapshot: keys in order, no white space."""
    return F.to_json(value)


def error_message(message: Column, error: Column) -> Column:
    """An error's message, or the error as a text where it has none."""
    return F.coalesce(F.nullif(message, F.lit("")), error.cast("string"), F.lit(""))
