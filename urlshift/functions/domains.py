"""Functions on domains, paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_scheme(value: Column | str) -> Column:
    """Drop one leading ``http://`` and then one leading ``https://``."""
    return F.regexp_replace(_col(value), r"\A(?:http://)?(?:https://)?", "")


def _drop_one_trailing_slash(value: Column) -> Column:
    return F.regexp_replace(value, r"/\z", "")


def strip_scheme_and_slash(value: Column | str) -> Column:
    return _drop_one_trailing_slash(strip_scheme(value))


def sanitize_domain(value: Column | str) -> Column:
    """Outer whitespace, scheme and all trailing slashes removed; port, path and ``www.`` stay."""
    trimmed = F.regexp_replace(_col(value), r"\A\s+|\s+\z", "")
    return F.regexp_replace(strip_scheme(trimmed), r"/+\z", "")


def sanitize_domain_strict(value: Column | str) -> Column:
    """``https://`` address of a cleaned domain, NULL where the domain is not acceptable."""
    clean = sanitize_domain(value)
    address = F.concat(F.lit("https://"), clean)
    well_formed = (
        address.rlike(fixed.STRICT_LOCALHOST)
        | address.rlike(fixed.STRICT_DOTTED_QUAD)
        | address.rlike(fixed.STRICT_HOST)
    )
    acceptable = (
        (clean != "")
        & (F.length(clean) <= fixed.STRICT_MAX_LENGTH)
        & ~clean.rlike(fixed.STRICT_REFUSED_CHARACTERS)
        & ~clean.rlike(fixed.STRICT_CONTROL_CHARACTERS)
        & ~clean.contains("://")
        & well_formed
    )
    return F.when(acceptable, address)


def host_of(value: Column | str) -> Column:
    """Text before the first slash, after the scheme and one trailing slash are gone."""
    return F.substring_index(strip_scheme_and_slash(value), "/", 1)


def url_host(value: Column | str) -> Column:
    """Host of a full URL; text without a scheme comes back unchanged."""
    return F.regexp_replace(_col(value), r"(?s)\Ahttps?://([^/]+).*\z", "$1")


def path_of(value: Column | str) -> Column:
    """Text after the first slash between single slashes, ``/`` where there is none."""
    bare = strip_scheme(value)
    tail = F.regexp_extract(bare, r"(?s)\A[^/]*/(.*)\z", 1)
    wrapped = F.concat(F.lit("/"), tail, F.when(tail.endswith("/"), F.lit("")).otherwise(F.lit("/")))
    return F.when(bare.isNull(), F.lit(None)).when((tail == "") | (wrapped == "//"), F.lit("/")).otherwise(wrapped)


def protocol_of(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value.startswith("http://"), F.lit("http://")).otherwise(F.lit("https://"))


def force_https(value: Column | str) -> Column:
    """``https://`` put in front, or in place of ``http://``; a secure address is kept."""
    value = _col(value)
    return F.when(value.startswith("https://"), value).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(value, r"\Ahttp://", ""))
    )


def first_label(value: Column | str) -> Column:
    return F.substring_index(_col(value), ".", 1)


def second_path_field(value: Column | str) -> Column:
    """Second ``/``-separated field; text without a slash comes back whole."""
    value = _col(value)
    return F.when(value.contains("/"), F.split_part(value, F.lit("/"), F.lit(2))).otherwise(value)


def www_variants(value: Column | str) -> Column:
    """Struct of the form without ``www.``, the form with it, and whether the input had it."""
    value = _col(value)
    has_www = value.startswith("www.")
    return F.struct(
        F.when(has_www, F.substring(value, 5, 1 << 30)).otherwise(value).alias("non_www"),
        F.when(has_www, value).otherwise(F.concat(F.lit("www."), value)).alias("www"),
        has_www.alias("has_www"),
    )


def trim_slashes(value: Column | str) -> Column:
    """At most one slash removed at either end."""
    return F.regexp_replace(_col(value), r"\A/|/\z", "")


def clean_new_domain(value: Column | str) -> Column:
    return _drop_one_trailing_slash(F.regexp_replace(_col(value), r"\Ahttps?://", ""))


def is_local_host(value: Column | str) -> Column:
    return _col(value).rlike(fixed.LOCAL_HOSTS)


def display_from(domain: Column | str, path: Column | str) -> Column:
    """Domain with the site path behind it, unless the path is the root or already there."""
    domain, path = _col(domain), F.coalesce(_col(path), F.lit("/"))
    clean = _drop_one_trailing_slash(path)
    return F.when((path == "/") | (clean == "") | domain.endswith(clean), domain).otherwise(F.concat(domain, clean))
