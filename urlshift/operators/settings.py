"""Project settings: defaults, checks, updates, and the comparison with what the database says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import is_empty, sanitize_domain, url_host


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Non-empty changed values replace or extend the settings; domain values are cleaned first."""
    value = F.when(F.col("key").isin(*fixed.DOMAIN_SETTINGS), sanitize_domain("value")).otherwise(F.col("value"))
    incoming = changes.select("project", "key", value.alias("new_value"))
    return settings.join(incoming, ["project", "key"], "full_outer").select(
        "project", "key", F.coalesce(F.nullif("new_value", F.lit("")), "value", "new_value").alias("value")
    )


def settings_with_defaults(settings: DataFrame) -> DataFrame:
    """One row per project with a column per known setting, gaps filled with the defaults."""
    keys = list(fixed.SETTING_DEFAULTS)
    wide = settings.groupBy("project").agg(
        *(F.max(F.when(F.col("key") == key, F.nullif("value", F.lit("")))).alias(key) for key in keys)
    )
    return wide.select(
        "project", *(F.coalesce(key, F.lit(default)).alias(key) for key, default in fixed.SETTING_DEFAULTS.items())
    )


def setting_or_default(settings: DataFrame, key: str, default: str = "") -> DataFrame:
    """One setting per project, the default where it is missing or empty."""
    found = F.max(F.when(F.col("key") == key, F.nullif("value", F.lit(""))))
    return settings.groupBy("project").agg(F.coalesce(found, F.lit(default)).alias("value"))


def validate_settings(sections: DataFrame, settings: DataFrame) -> DataFrame:
    """``(project, errors)``: all missing sections and settings of every project that has a file."""
    present = sections.groupBy("project").agg(
        *(
            F.bool_or(F.col("section") == name).alias(f"has_{name}")
            for name in (fixed.GENERAL_SECTION, fixed.MAPPING_SECTION)
        )
    )
    filled = settings.where(~is_empty("value")).groupBy("project").agg(
        *(F.bool_or(F.col("key") == key).alias(f"has_{key}") for key in fixed.REQUIRED_SETTINGS)
    )
    no = lambda name: ~F.coalesce(f"has_{name}", F.lit(False))
    messages = [(name, fixed.MISSING_SECTION % name) for name in (fixed.GENERAL_SECTION, fixed.MAPPING_SECTION)]
    messages += [(key, fixed.MISSING_SETTING % key) for key in fixed.REQUIRED_SETTINGS]
    errors = F.array_compact(F.array(*(F.when(no(name), F.lit(text)) for name, text in messages)))
    return present.join(filled, "project", "left").select("project", errors.alias("errors"))


ON_MISMATCH = ("update", "keep", "fail")


def domain_mismatch(configured: DataFrame, found: DataFrame, on_mismatch: str = "fail") -> DataFrame:
    """Configured old domain against the one found in the options, per project.

    ``domain`` is what the run goes on with: the found one after ``update`` or where nothing is
    configured, the configured one after ``keep``, NULL where the run must stop.
    """
    if on_mismatch not in ON_MISMATCH:
        raise ValueError(f"on_mismatch must be one of {ON_MISMATCH}")
    ours = configured.select("project", sanitize_domain("old_domain").alias("configured"))
    theirs = found.select("project", sanitize_domain(url_host("siteurl")).alias("found"))
    both = ours.join(theirs, "project", "full_outer")
    checked = ~is_empty("configured") & ~is_empty("found")
    differs = checked & (F.col("configured") != F.col("found"))
    choice = {"update": F.col("found"), "keep": F.col("configured"), "fail": F.lit(None).cast("string")}[on_mismatch]
    agreed = F.coalesce(F.nullif("found", F.lit("")), F.nullif("configured", F.lit("")))
    return both.select(
        "project",
        "configured",
        "found",
        F.coalesce(differs, F.lit(False)).alias("mismatch"),
        F.when(differs, choice).otherwise(agreed).alias("domain"),
    )
