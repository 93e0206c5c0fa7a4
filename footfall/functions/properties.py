"""Event properties: merging and redaction of nested JSON, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.urls import REDACTED, is_sensitive

MAX_DEPTH, MAX_KEYS = 4, 100
_MAP, _ARRAY = "map<string,variant>", "array<variant>"


def _redacted() -> Column:
    return F.parse_json(F.lit(f'"{REDACTED}"'))


def _clean_object(entries: Column, depth: int) -> Column:
    """A map of JSON values with sensitive names redacted at this and the deeper levels."""
    first = F.map_from_entries(F.slice(F.map_entries(entries), 1, MAX_KEYS))
    return F.transform_values(
        first, lambda k, v: F.when(is_sensitive(k), _redacted()).otherwise(_clean(v, depth + 1)))


def _clean(value: Column, depth: int) -> Column:
    if depth > MAX_DEPTH:
        return F.parse_json(F.lit("null"))
    entries, items = value.try_cast(_MAP), value.try_cast(_ARRAY)
    return (
        F.when(entries.isNotNull(), F.to_variant_object(_clean_object(entries, depth)))
        .when(items.isNotNull(), F.to_variant_object(
            F.transform(F.slice(items, 1, MAX_KEYS), lambda v: _clean(v, depth + 1))))
        .otherwise(value)
    )


def sanitise_properties(text: Column) -> Column:
    """JSON text with the values of sensitive names redacted, at most 100 entries per level and
    nothing below the fourth. Text that is not a JSON object becomes `{}`."""
    return F.coalesce(F.to_json(_clean_object(F.from_json(text, _MAP), 0)), F.lit("{}"))


def merge_objects(first: Column, second: Column) -> Column:
    """Entries of both JSON objects as text; the second wins on equal names."""
    a, b = (F.coalesce(F.from_json(c, _MAP), F.create_map().cast(_MAP)) for c in (first, second))

    def merged(both: Column) -> Column:
        updated = F.transform_values(both["a"], lambda k, v: F.coalesce(F.try_element_at(both["b"], k), v))
        return F.map_concat(updated, F.map_filter(both["b"], lambda k, _: ~F.map_contains_key(both["a"], k)))

    # One element, so that each text is parsed once and not again for every name.
    return F.to_json(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), merged)[0])
