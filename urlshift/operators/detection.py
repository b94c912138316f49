"""What kind of install each project is, from facts gathered about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import is_empty


def multisite_indicators(listing: DataFrame) -> DataFrame:
    """``(project, indicators)`` from a path listing ``(project, path[, content])``, labels space-joined.

    Paths are relative to the project. A directory counts as soon as anything lies in it or it is
    listed itself; the plugin directory counts only if something lies in it.
    """
    path = F.regexp_replace("path", r"\A/|/\z", "")
    content = F.col("content") if "content" in listing.columns else F.lit(None).cast("string")
    label = F.lit(None).cast("string")
    for name, place in fixed.NETWORK_PATHS:
        inside = path.startswith(place + "/")
        if name == "htaccess-rules":
            hit = (path == place) & content.rlike(fixed.NETWORK_REWRITE_RULE)
        elif name == "mu-plugins":
            hit = inside
        else:
            hit = inside | (path == place)
        label = F.when(hit, F.lit(name)).otherwise(label)
    return listing.groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_set(label)), " ").alias("indicators")
    )


def multisite_type(facts: DataFrame) -> DataFrame:
    """``(project, multisite_type)``: the configured constant outranks the probe."""
    return facts.select("project", _network_type().alias("multisite_type"))


def _network_type():
    constant, probe = F.lower("subdomain_constant"), F.col("subdomain_probe")
    return F.coalesce(
        F.when(constant == "true", F.lit("subdomain")),
        F.when(constant == "false", F.lit("subdirectory")),
        F.when(probe.isin("true", "subdomain"), F.lit("subdomain")),
        F.when(probe.isin("false", "subdirectory"), F.lit("subdirectory")),
        F.lit("unknown"),
    )


def classify_installs(facts: DataFrame) -> DataFrame:
    """Detection record of every project.

    ``facts`` has one row per project: ``probe`` (yes, no, or anything else for unknown), ``blog_count_probe``,
    ``site_list_count``, ``multisite_constant``, ``subdomain_constant``, ``subdomain_probe``, ``indicators``.
    """
    number = lambda name: F.when(F.col(name).rlike(r"\A[0-9]+\z"), F.col(name).try_cast("bigint"))
    yes = F.col("probe") == "yes"
    no = F.col("probe") == "no"
    configured = F.lower("multisite_constant") == "true"
    marked = ~is_empty("indicators")
    listed = F.coalesce(number("site_list_count"), F.lit(1))
    method = (
        F.when(yes | no, F.lit("wp-cli"))
        .when(configured, F.lit("wp-config"))
        .when(marked, F.lit("filesystem"))
        .otherwise(F.lit("fallback"))
    )
    network = F.coalesce(yes, F.lit(False)) | F.coalesce(method.isin("wp-config", "filesystem"), F.lit(False))
    counted = F.coalesce(number("blog_count_probe"), F.when(configured, listed), F.lit(1))
    blogs = F.when(yes, counted).when(method == "wp-config", listed).otherwise(F.lit(0))
    return facts.select(
        "project",
        F.when(network, F.lit("multisite")).otherwise(F.lit("single")).alias("installation_type"),
        F.when(network, _network_type()).when(no, F.lit(fixed.NOT_APPLICABLE)).otherwise(F.lit("")).alias("multisite_type"),
        F.when(network, F.lit(fixed.NETWORK_FLAG))
        .when(no, F.lit(fixed.NOT_APPLICABLE))
        .otherwise(F.lit(""))
        .alias("network_flag"),
        blogs.cast("bigint").alias("blog_count"),
        F.when(F.coalesce(yes | no, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("site_count"),
        method.alias("method"),
    )


def validate_detection(records: DataFrame) -> DataFrame:
    """The records with ``valid``, the broken rules as ``reason`` and a ``warning`` for an unexpected flag."""
    network = F.col("installation_type") == "multisite"
    numeric = lambda name: F.coalesce(F.col(name).cast("string").rlike(r"\A[0-9]+\z"), F.lit(False))
    within = lambda name, words: F.coalesce(F.col(name).isin(*words), F.lit(False))
    rules = [
        (~within("installation_type", fixed.INSTALL_TYPES), "invalid installation type"),
        (network & ~within("multisite_type", fixed.NETWORK_TYPES), "invalid multisite type"),
        (~numeric("blog_count"), "invalid blog count"),
        (~numeric("site_count"), "invalid site count"),
        (~within("method", fixed.DETECTION_METHODS), "invalid detection method"),
    ]
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(text)) for rule, text in rules)))
    flag = network & (F.coalesce("network_flag", F.lit("")) != fixed.NETWORK_FLAG)
    return records.withColumns(
        {
            "valid": F.size(broken) == 0,
            "reason": F.array_join(broken, "; "),
            "warning": F.when(flag, F.lit("unexpected network flag")).otherwise(F.lit("")),
        }
    )
