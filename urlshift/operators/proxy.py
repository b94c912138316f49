"""Media proxy options: which site fetches missing media from which old address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import clean_new_domain, is_empty, sanitize_domain_strict
from urlshift.operators.mappings import first_mapping_per_site
from urlshift.sources.project_files import strip_comments, with_sections


def proxy_mappings(lines: DataFrame) -> DataFrame:
    """``(project, blog_id, old_domain, line_no)`` from mapping lines; every colon splits, so a port is cut off."""
    part = F.split(F.regexp_replace("line", r"\A\s+|\s+\z", ""), ":")
    return (
        strip_comments(with_sections(lines))
        .where(F.col("section") == fixed.MAPPING_SECTION)
        .select("project", "line_no", part.alias("part"))
        .where((F.size("part") >= 3) & (F.col("part")[0] != "") & (F.col("part")[1] != ""))
        .select(
            "project",
            F.col("part")[0].try_cast("bigint").alias("blog_id"),
            F.col("part")[1].alias("old_domain"),
            "line_no",
        )
    )


def proxy_settings(sites: DataFrame, mappings: DataFrame, mode: str = fixed.PROXY_MODE) -> DataFrame:
    """Every listed site ``(blog_id, url)`` with its proxy address and whether it can be configured."""
    first = first_mapping_per_site(
        mappings.where(~is_empty("old_domain")).select("blog_id", "old_domain", "line_no")
    ).select("blog_id", "old_domain")
    joined = sites.select("blog_id", F.col("url").alias("site_url")).join(first, "blog_id", "left")
    return _with_status(joined, mode)


def _with_status(rows: DataFrame, mode: str) -> DataFrame:
    address = sanitize_domain_strict("old_domain")
    return rows.select(
        "blog_id",
        F.regexp_replace("site_url", r"/\z", "").alias("site_url"),
        address.alias("sfp_url"),
        F.when(address.isNotNull(), F.lit(mode)).alias("sfp_mode"),
        F.when(F.col("old_domain").isNull(), F.lit("no mapping"))
        .when(address.isNull(), F.lit("invalid domain"))
        .otherwise(F.lit("configured"))
        .alias("status"),
    )


def proxy_settings_from_mappings(
    mappings: DataFrame, new_base: str, mode: str = fixed.PROXY_MODE
) -> DataFrame:
    """Without a site list: every mapped site, addressed by the new base domain."""
    site_url = F.concat(F.lit("https://"), clean_new_domain(F.lit(new_base)))
    rows = mappings.where(F.col("blog_id").isNotNull() & ~is_empty("old_domain"))
    return _with_status(rows.select("blog_id", site_url.alias("site_url"), "old_domain"), mode)


def proxy_bulk(sites: DataFrame, domain: str, is_network: bool = True, mode: str = fixed.PROXY_MODE) -> DataFrame:
    """The same source for all sites of a network."""
    if not is_network:
        raise ValueError("one source for all sites is for networks only")
    return _with_status(
        sites.select("blog_id", F.col("url").alias("site_url"), F.lit(domain).alias("old_domain")), mode
    )


def proxy_counts(settings: DataFrame) -> DataFrame:
    """One row: configured sites out of all sites."""
    return settings.agg(
        F.count_if(F.col("status") == "configured").alias("configured"), F.count(F.lit(1)).alias("total")
    )


def proxy_option_rows(settings: DataFrame) -> DataFrame:
    """``(blog_id, option_name, option_value)`` to store for the configured sites."""
    pairs = F.array(
        F.struct(F.lit(fixed.PROXY_URL_OPTION).alias("option_name"), F.col("sfp_url").alias("option_value")),
        F.struct(F.lit(fixed.PROXY_MODE_OPTION).alias("option_name"), F.col("sfp_mode").alias("option_value")),
    )
    return (
        settings.where(F.col("status") == "configured")
        .select("blog_id", F.explode(pairs).alias("o"))
        .select("blog_id", "o.*")
    )


def upsert_options(options: DataFrame, changes: DataFrame) -> DataFrame:
    """Options with the changed values set or added, keyed by site and name."""
    keys = ["blog_id", "option_name"]
    others = [c for c in options.columns if c not in (*keys, "option_value")]
    # Of several changes of one option the last line counts, then the greatest value.
    line = F.col("line_no") if "line_no" in changes.columns else F.lit(0)
    latest = changes.groupBy(*keys).agg(F.max_by("option_value", F.struct(line, "option_value")).alias("option_value"))
    kept = options.join(latest.select(*keys), keys, "left_anti").select(*options.columns)
    if others:
        # Other columns of a replaced row stay with it.
        old = options.join(latest.select(*keys), keys, "left_semi").drop("option_value")
        latest = latest.join(old, keys, "left")
    return kept.unionByName(latest.select(*options.columns))


def proxy_status(options: DataFrame) -> DataFrame:
    """Current proxy options per site."""
    shown = {
        name: F.coalesce(
            F.max(F.when(F.col("option_name") == name, F.nullif("option_value", F.lit("")))), F.lit(fixed.PROXY_UNSET)
        )
        for name in (fixed.PROXY_URL_OPTION, fixed.PROXY_MODE_OPTION)
    }
    return options.groupBy("blog_id").agg(*(column.alias(name) for name, column in shown.items()))


def purge_transients(options: DataFrame, patterns: list[str]) -> DataFrame:
    """Options without the cached rows whose name matches one of the patterns."""
    if not patterns:
        return options
    cached = F.col("option_name").rlike("|".join(f"(?:{p})" for p in patterns))
    return options.where(~F.coalesce(cached, F.lit(False)))
