"""Site mappings: checks, lookups, joins with the site list, suggestions and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import (
    clean_new_domain,
    display_from,
    first_label,
    host_of,
    is_empty,
    mapping_status,
    strip_scheme,
    trim_slashes,
)
from urlshift.operators.numbering import number_rows


def drop_noop_mappings(mappings: DataFrame) -> DataFrame:
    """Only mappings that change something."""
    return mappings.where(~is_empty("new_domain") & (F.col("old_domain") != F.col("new_domain")))


def valid_site_rows(sites: DataFrame) -> DataFrame:
    """Rows with a numeric id and a domain."""
    return sites.where(F.col("blog_id").cast("string").rlike(r"\A[0-9]+\z") & ~is_empty("domain"))


def first_path_per_site(sites: DataFrame) -> DataFrame:
    """One path per site; of several rows the first listed one, else the smallest path."""
    order = "line_no" if "line_no" in sites.columns else "path"
    return sites.groupBy("blog_id").agg(F.min_by("path", order).alias("path"))


def attach_paths(mappings: DataFrame, sites: DataFrame) -> DataFrame:
    """Each mapping with the path its site has in the site list, the root where it is not listed."""
    return (
        mappings.join(first_path_per_site(sites), "blog_id", "left")
        .withColumn("path", F.coalesce("path", F.lit("/")))
    )


def _mapped_ids(mappings: DataFrame) -> DataFrame:
    return mappings.where(~is_empty("new_domain")).select("blog_id")


def missing_mappings(sites: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sites without a usable mapping."""
    return sites.join(_mapped_ids(mappings), "blog_id", "left_anti")


def mapped_sites(sites: DataFrame, mappings: DataFrame) -> DataFrame:
    return sites.join(_mapped_ids(mappings), "blog_id", "left_semi")


def mapping_counts(sites: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: how many sites there are, how many are mapped, how many are missing."""
    flags = sites.select("blog_id").join(
        _mapped_ids(mappings).distinct().withColumn("mapped", F.lit(True)), "blog_id", "left"
    )
    return flags.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.count_if(F.col("mapped")).alias("mapped_sites"),
        F.count_if(F.col("mapped").isNull()).alias("missing_sites"),
    )


def first_mapping_per_site(mappings: DataFrame, keys: tuple[str, ...] = ("blog_id",)) -> DataFrame:
    """The first line of every site; a two-sided aggregation, so many lines of one site meet no single sort."""
    others = [c for c in mappings.columns if c not in keys]
    first = F.min_by(F.struct(*others), "line_no").alias("first")
    return mappings.groupBy(*keys).agg(first).select(*keys, "first.*")


def duplicate_mappings(mappings: DataFrame) -> DataFrame:
    """Sites with more than one line, with the number of lines."""
    return (
        mappings.groupBy("blog_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("used_line"))
        .where(F.col("lines") > 1)
    )


def is_network_by_mappings(mappings: DataFrame) -> DataFrame:
    """One row: more than one mapping means a network."""
    return mappings.agg(
        F.count(F.lit(1)).alias("mappings"), (F.count(F.lit(1)) > 1).alias("is_network")
    )


def mapped_domain(
    sites: DataFrame, mappings: DataFrame, fallback: str | None = None, side: str = "old_domain"
) -> DataFrame:
    """``(blog_id, domain)`` from the first mapping of each site, else the fallback, else NULL."""
    first = first_mapping_per_site(mappings.where(~is_empty(side))).select("blog_id", F.col(side).alias("domain"))
    return (
        sites.select("blog_id").join(first, "blog_id", "left")
        .select("blog_id", F.coalesce("domain", F.lit(fallback)).alias("domain"))
    )


def suggest_mappings(
    missing: DataFrame, base: str | None = None, configured_base: str | None = None, main_mapping: str | None = None
) -> DataFrame:
    """Default mapping of every site that has none.

    The base is the given one, else the main site's confirmed mapping, else the configured
    new domain, else a last resort. A confirmed main mapping changes only the sites after
    the main one, which come later in id order.
    """
    configured = configured_base or fixed.LAST_RESORT_DOMAIN
    main_base = base or configured
    other_base = base or main_mapping or configured
    path = F.coalesce("path", F.lit("/"))
    has_path = (path != "") & (path != "/")
    bare = strip_scheme(F.lit(other_base))
    tail = F.when(has_path, trim_slashes(path)).otherwise(first_label("domain"))
    suggested = F.when(F.col("blog_id") == 1, F.lit(main_base)).otherwise(F.concat(bare, F.lit("/"), tail))
    old = F.when(has_path, F.concat("domain", F.regexp_replace(path, r"/\z", ""))).otherwise(F.col("domain"))
    return missing.select("blog_id", old.alias("old_domain"), clean_new_domain(suggested).alias("new_domain"))


def upsert_mapping(mappings: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("blog_id",)) -> DataFrame:
    """Changes replace every line of their site, keep the place of its first one, or come last."""
    columns = mappings.columns
    incoming = changes.drop("line_no")
    kept = mappings.join(incoming.select(*keys), list(keys), "left_anti")
    places = mappings.join(incoming.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(
        F.min("line_no").alias("line_no")
    )
    last = mappings.agg(F.coalesce(F.max("line_no"), F.lit(0)).cast("bigint").alias("last")).scalar()
    placed = incoming.join(places, list(keys), "left").withColumn(
        "line_no", F.coalesce(F.col("line_no").cast("bigint"), last + F.col("blog_id"))
    )
    return kept.withColumn("line_no", F.col("line_no").cast("bigint")).select(*columns).unionByName(
        placed.select(*columns)
    )


def mapping_summary(mappings: DataFrame, sites: DataFrame, main_id: int) -> DataFrame:
    """The mapping table as shown to a user: id, main flag, old address, status."""
    return attach_paths(mappings, sites).select(
        "blog_id",
        (F.col("blog_id") == main_id).alias("is_main"),
        display_from("old_domain", "path").alias("display_from"),
        mapping_status("old_domain", "new_domain").alias("status"),
    )


def in_processing_order(mappings: DataFrame, main_id: int) -> DataFrame:
    """Subsites by line, the main site last."""
    return mappings.orderBy(F.col("blog_id") == main_id, "line_no")


def by_blog_id(df: DataFrame, column: str = "blog_id") -> DataFrame:
    """Numeric order of ids that may be stored as text; texts that are no such number come first."""
    return df.orderBy(F.col(column).try_cast("bigint"))


def site_progress(sites: DataFrame) -> DataFrame:
    """Every site with its place and the number of sites ("site i of n")."""
    total = sites.agg(F.count(F.lit(1)).alias("total")).scalar()
    return number_rows(sites, "blog_id", out="place").withColumn("total", total)


def host_match(sites: DataFrame, network_host: Column) -> DataFrame:
    """Sites whose URL host equals the network host."""
    return sites.where(host_of("url") == network_host)
