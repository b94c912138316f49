"""Network catalogue: new addresses of the sites, main-site detection and its address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import clean_string, host_of, is_empty, path_of, strip_scheme
from urlshift.operators.mappings import drop_noop_mappings


def network_base(mappings: DataFrame, main_id: int) -> DataFrame:
    """One row: host of the main site's new domain from its first mapping, NULL where there is none."""
    main = mappings.where(F.col("blog_id") == main_id).agg(F.min_by("new_domain", "line_no").alias("new_domain"))
    return main.select(F.nullif(host_of("new_domain"), F.lit("")).alias("base"))


def plan_blog_updates(mappings: DataFrame, main_id: int, multisite_type: str) -> DataFrame:
    """``(blog_id, domain, path, is_main, old_domain, new_domain, line_no)`` of every catalogue row to set.

    Without a base domain there is no plan. The main site is set even if it does not change.
    """
    base = network_base(mappings, main_id).scalar()
    is_main = F.col("blog_id") == main_id
    first_main = mappings.where(is_main).groupBy("blog_id").agg(F.min("line_no").alias("line_no"))
    main = mappings.where(is_main & ~is_empty("new_domain")).join(first_main, ["blog_id", "line_no"], "left_semi")
    rows = drop_noop_mappings(mappings.where(~is_main)).unionByName(main).withColumn("base", base)
    domain = F.col("base") if multisite_type == "subdirectory" else host_of("new_domain")
    path = F.when(is_main, F.lit("/")).otherwise(path_of("new_domain"))
    return rows.where(F.col("base").isNotNull()).select(
        "blog_id",
        domain.alias("domain"),
        path.alias("path"),
        is_main.alias("is_main"),
        "old_domain",
        "new_domain",
        F.col("line_no").cast("bigint").alias("line_no"),
    )


def update_blogs(blogs: DataFrame, plan: DataFrame) -> DataFrame:
    """Catalogue with the planned domain and path; other rows and columns as they were.

    Updates run in line order, so of several for one site the last one stays.
    """
    final = plan.groupBy("blog_id").agg(
        F.max_by(F.struct("domain", "path"), "line_no").alias("__new")
    )
    joined = blogs.join(final, "blog_id", "left")
    return joined.withColumns(
        {
            "domain": F.coalesce("__new.domain", "domain"),
            "path": F.coalesce("__new.path", "path"),
        }
    ).select(*blogs.columns)


def update_network(site: DataFrame, base: str | Column) -> DataFrame:
    """Network row 1 gets the new base domain."""
    base = F.lit(base) if isinstance(base, str) else base
    return site.withColumn("domain", F.when(F.col("id") == 1, base).otherwise(F.col("domain")))


def update_outcome(results: DataFrame) -> DataFrame:
    """One row ``(executed, failed, details, ok)`` from ``(label, ok)``; failures are listed by label."""
    return results.agg(
        F.count_if("ok").alias("executed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("label")))).alias("details"),
    ).withColumn("ok", F.col("failed") == 0)


def update_results(blogs: DataFrame, plan: DataFrame) -> DataFrame:
    """``(label, blog_id, ok)`` of every planned catalogue row: it fails where the catalogue has no such site."""
    known = blogs.select("blog_id").distinct().withColumn("known", F.lit(True))
    label = F.concat(F.lit("Site ID "), F.col("blog_id").cast("string"))
    return plan.join(known, "blog_id", "left").select(label.alias("label"), "blog_id", F.coalesce("known", F.lit(False)).alias("ok"))


def failed_updates(results: DataFrame) -> DataFrame:
    """The failures of ``update_results`` or of any ``(label, ok)`` as rows."""
    return results.where(~F.col("ok"))


def update_counts(results: DataFrame) -> DataFrame:
    """One row ``(executed, failed, ok)``; the failures themselves are the rows of ``failed_updates``."""
    return results.agg(
        F.count_if("ok").alias("executed"), F.count_if(~F.col("ok")).alias("failed")
    ).withColumn("ok", F.col("failed") == 0)


# -- main site -------------------------------------------------------------------------


def listed_main_site(sites: DataFrame) -> DataFrame:
    """One row: the first listed site with the root path, else the smallest id."""
    root = clean_string("path") == "/"
    order = F.struct(~root, F.when(root, F.col("line_no")).otherwise(F.col("blog_id")))
    return sites.agg(F.min_by("blog_id", order).alias("blog_id"))


def main_site(
    sites: DataFrame,
    blogs: DataFrame | None = None,
    networks: DataFrame | None = None,
    network_url: str | None = None,
    answers: tuple[int | None, int | None] = (None, None),
    is_network: bool = True,
) -> DataFrame:
    """One row ``(blog_id, method)``: the first method that gives a site.

    ``sites`` is the site list ``(blog_id, path, line_no[, url])``. ``networks`` counts only where it
    names its main site; ``answers`` are ids the application reports about itself.
    """
    if not is_network:
        return sites.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("blog_id"), F.lit("single").alias("method"))

    # One pass over the list, and one small look-up in each of the other tables.
    root = clean_string("path") == "/"
    listed = [F.min_by("blog_id", F.when(root, F.col("line_no"))).alias("root"), F.min("blog_id").alias("lowest")]
    if network_url and "url" in sites.columns:
        same_host = F.substring_index(strip_scheme("url"), "/", 1) == host_of(F.lit(network_url))
        listed.append(F.min_by("blog_id", F.when(same_host, F.col("line_no"))).alias("host"))
    else:
        listed.append(F.lit(None).cast("bigint").alias("host"))
    unknown = F.lit(None).cast("bigint")
    named = unknown
    if networks is not None and "blog_id" in networks.columns:
        named = networks.where(F.col("id") == 1).agg(F.min("blog_id").alias("id")).scalar()
    catalogued = unknown
    if blogs is not None:
        catalogued = blogs.where(F.col("path") == "/").agg(F.min("blog_id").alias("id")).scalar()
    answers = [F.lit(a).cast("bigint") for a in answers]
    offered = {0: named, 1: catalogued, 2: F.col("root"), 3: F.col("host"), 4: answers[0], 5: answers[1], 7: F.col("lowest"), 8: F.lit(1)}
    usable = {place: F.nullif(blog_id.cast("bigint"), F.lit(0)) for place, blog_id in offered.items()}
    chosen = F.coalesce(
        *(
            F.when(blog_id.isNotNull(), F.struct(blog_id.alias("blog_id"), F.lit(fixed.MAIN_SITE_METHODS[place]).alias("method")))
            for place, blog_id in usable.items()
        )
    )
    return sites.agg(*listed).select(chosen.alias("chosen")).select("chosen.*")


def main_site_url(
    main_id: int,
    options: DataFrame,
    sites: DataFrame,
    blogs: DataFrame,
    fallback: str,
    current_siteurl: str | None = None,
) -> DataFrame:
    """One row ``url``: stored option, options of the main site, first listed URL, catalogue row, fallback."""
    protocol = "http://" if fallback.startswith("http://") else "https://"
    stored = options.where((F.col("blog_id") == main_id) & (F.col("option_name") == "siteurl")).agg(
        F.min("option_value").alias("v")
    ).scalar()
    listed = (
        sites.agg(F.min_by("url", "line_no").alias("v")).scalar() if "url" in sites.columns else F.lit(None)
    )
    path = F.regexp_replace("path", r"/\z", "")
    built = blogs.where((F.col("blog_id") == main_id) & ~is_empty("domain")).agg(
        F.min(F.concat(F.lit(protocol), F.col("domain"), path)).alias("v")
    ).scalar()
    some = [F.nullif(c.cast("string"), F.lit("")) for c in (F.lit(current_siteurl), stored, listed, built)]
    one = sites.sparkSession.range(1)
    return one.select(F.coalesce(*some, F.lit(fallback)).alias("url"))


def number_of_sites(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Reported site counts as numbers; anything that is not a plain number counts as one site."""
    value = F.col(column)
    return answers.withColumn(
        "blog_count", F.coalesce(F.when(value.rlike(r"\A[0-9]+\z"), value.try_cast("bigint")), F.lit(1))
    )
