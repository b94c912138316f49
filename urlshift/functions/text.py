"""Functions on plain text, sizes and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_empty(value: Column | str) -> Column:
    """NULL and the empty text both count as "no value"."""
    value = _col(value)
    return value.isNull() | (value == "")


def clean_string(value: Column | str) -> Column:
    """Line ends removed anywhere, whitespace trimmed at both ends."""
    return F.regexp_replace(F.translate(_col(value), "\r\n", ""), r"\A\s+|\s+\z", "")


def lower(value: Column | str) -> Column:
    return F.lower(_col(value))


def upper(value: Column | str) -> Column:
    return F.upper(_col(value))


def title(value: Column | str) -> Column:
    value = _col(value)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 1 << 30)))


def is_true(value: Column | str) -> Column:
    return F.coalesce(F.lower(_col(value)).isin(*fixed.TRUE_WORDS), F.lit(False))


def mapping_status(old: Column | str, new: Column | str) -> Column:
    old, new = _col(old), _col(new)
    return (
        F.when(is_empty(new), F.lit(fixed.STATUS_NO_MAPPING))
        .when(old == new, F.lit(fixed.STATUS_UNCHANGED))
        .otherwise(new)
    )


def normalize_entry(value: Column | str) -> Column:
    """Comparable form of an ignore-list entry; NULL where nothing is left of it."""
    trimmed = F.regexp_replace(_col(value), r"\A\s+|\s+\z", "")
    rooted = F.regexp_replace(F.regexp_replace(trimmed, r"\A\./", ""), r"\A(?!/)", "/")
    return F.when(trimmed != "", F.nullif(F.nullif(F.regexp_replace(rooted, r"/\z", ""), F.lit("/")), F.lit("")))


def human_size(size: Column | str) -> Column:
    """Size in the largest tier it exceeds, two decimals, ties to even; KB is the floor."""
    size = _col(size)
    smallest, smallest_bytes = fixed.SIZE_TIERS[-1]

    def shown(unit: str, unit_bytes: int) -> Column:
        return F.format_string(f"%.2f {unit}", F.bround(size.cast("double") / F.lit(float(unit_bytes)), 2))

    text = shown(smallest, smallest_bytes)
    for unit, unit_bytes in reversed(fixed.SIZE_TIERS[:-1]):
        text = F.when(size > unit_bytes, shown(unit, unit_bytes)).otherwise(text)
    return F.when(size.isNotNull(), text)


def mmss(seconds: Column | str) -> Column:
    seconds = _col(seconds).cast("bigint")
    minutes = F.floor(seconds / 60).cast("bigint")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", minutes, seconds - minutes * 60))


def site_table(blog_id: Column | str, base_name: Column | str, prefix: str = fixed.DEFAULT_PREFIX) -> Column:
    """Physical table name: the main site (id 1) has no number in it."""
    blog_id, base_name = _col(blog_id), _col(base_name)
    return F.concat(site_prefix(blog_id, prefix), base_name)


def site_prefix(blog_id: Column | str, prefix: str = fixed.DEFAULT_PREFIX) -> Column:
    blog_id = _col(blog_id)
    return F.when(blog_id == 1, F.lit(prefix)).otherwise(F.concat(F.lit(prefix), blog_id.cast("string"), F.lit("_")))


def count_occurrences(text: Column | str, needle: Column | str) -> Column:
    """How often the literal needle occurs without overlap, from the bytes its removal saves.

    A plain string is the needle itself, not a column name.
    """
    text = _col(text)
    needle = F.lit(needle) if isinstance(needle, str) else needle
    saved = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return F.when(needle == "", F.lit(0)).otherwise(F.floor(saved / F.octet_length(needle))).cast("bigint")


def map_get(mapping: Column | str, key: Column | str) -> Column:
    """Value of a key, the empty text where the key is missing."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(_col(mapping), key), F.lit(""))


def map_keys(mapping: Column | str) -> Column:
    return F.array_sort(F.map_keys(_col(mapping)))


def lines_to_array(value: Column | str) -> Column:
    """Lines of a text without the empty one after a closing line end."""
    return F.split(F.regexp_replace(_col(value), r"\n\z", ""), "\n")
