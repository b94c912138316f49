"""The ordered replacement plan and its warnings.

A plan is a table ``(seq, blog_id, pass, search, replace)``. It has two or four rows
per mapped site, so it is as small as the list of sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.functions import is_empty, trim_slashes, www_variants
from urlshift.operators.mappings import attach_paths
from urlshift.operators.numbering import number_rows

COMPAT = "compat"
JSON = "json"

_MAIN_LAST = 1 << 40


def search_replace_pair(
    old: Column, new: Column, old_path: Column | None = None, new_path: Column | None = None
) -> tuple[Column, Column]:
    """Search and replacement text of one site, before the leading slashes are put in front.

    A closing slash on the new domain is put on the search text too. A site path that is
    not the root becomes part of the search text.
    """
    slash = F.when(new.endswith("/"), F.lit("/")).otherwise(F.lit(""))
    bare_new = F.regexp_replace(new, r"/\z", "")
    plain_search = F.concat(F.regexp_replace(old, r"/\z", ""), slash)
    if old_path is None:
        return plain_search, new
    with_path = ~is_empty(old_path) & (old_path != "/")
    path_search = F.concat(old, F.lit("/"), trim_slashes(old_path), slash)
    tail = F.lit("") if new_path is None else trim_slashes(F.coalesce(new_path, F.lit("")))
    path_replace = F.concat(bare_new, F.when(tail != "", F.concat(F.lit("/"), tail)).otherwise(F.lit("")), slash)
    return (
        F.when(with_path, path_search).otherwise(plain_search),
        F.when(with_path, path_replace).otherwise(new),
    )


def _passes(search: Column, replace: Column, escape_mode: str) -> Column:
    """The two or four literal replacements of one site as an array, in their order."""
    if escape_mode == COMPAT:
        mark, body = r"\\//", (lambda text: text)
    elif escape_mode == JSON:
        mark, body = r"\/\/", (lambda text: F.replace(text, F.lit("/"), F.lit(r"\/")))
    else:
        raise ValueError(f"unknown escape mode {escape_mode!r}")
    forms = www_variants(search)
    bare, www, has_www = forms["non_www"], forms["www"], forms["has_www"]

    def step(number: int, lead: str, old: Column, new: Column) -> Column:
        return F.struct(
            F.lit(number).alias("pass"),
            F.concat(F.lit(lead), old).alias("search"),
            F.concat(F.lit(lead), new).alias("replace"),
        )

    only_www = lambda column: F.when(has_www, column)
    return F.array_compact(
        F.array(
            step(1, "//", bare, replace),
            only_www(step(2, "//", www, replace)),
            step(3, mark, body(bare), body(replace)),
            only_www(step(4, mark, body(www), body(replace))),
        )
    )


def _to_plan(pairs: DataFrame, escape_mode: str) -> DataFrame:
    steps = pairs.select(
        "blog_id", "place", F.explode(_passes(F.col("search"), F.col("replace"), escape_mode)).alias("step")
    ).select("blog_id", "place", "step.*")
    numbered = number_rows(steps, F.col("place") * 4 + F.col("pass") - 1, ties=[F.col("search")], out="seq")
    return numbered.select("seq", "blog_id", "pass", "search", "replace")


def single_site_plan(spark: SparkSession, old: str, new: str, escape_mode: str = COMPAT) -> DataFrame:
    """Plan of a database that holds one site (id 1); its path is never part of the search."""
    if not old or not new:
        raise ValueError("old and new domain must not be empty")
    row = spark.createDataFrame([(1, 0, old, new)], "blog_id bigint, place bigint, old string, new string")
    search, replace = search_replace_pair(F.col("old"), F.col("new"))
    return _to_plan(row.select("blog_id", "place", search.alias("search"), replace.alias("replace")), escape_mode)


def replacement_plan(
    mappings: DataFrame, sites: DataFrame, main_id: int, escape_mode: str = COMPAT
) -> DataFrame:
    """Plan of a network: subsites in the order of their lines, the main site last.

    Mappings with an empty side or without a change are left out. Of several lines for the
    main site the last one counts.
    """
    is_main = F.col("blog_id") == main_id
    usable = mappings.where(~is_empty("old_domain") & ~is_empty("new_domain") & F.col("blog_id").isNotNull())
    last_main = usable.where(is_main).agg(F.max("line_no").cast("bigint").alias("line_no")).scalar()
    rows = attach_paths(
        usable.where((F.col("old_domain") != F.col("new_domain")) & (~is_main | (F.col("line_no") == last_main))), sites
    )
    # A subsite's old domain that already holds a path is cut before the site path is put on.
    cut = ~is_main & F.col("old_domain").contains("/") & (F.col("path") != "/")
    old = F.when(cut, F.substring_index("old_domain", "/", 1)).otherwise(F.col("old_domain"))
    search, replace = search_replace_pair(old, F.col("new_domain"), F.col("path"))
    place = F.col("line_no").cast("bigint") + F.when(is_main, F.lit(_MAIN_LAST)).otherwise(F.lit(0))
    return _to_plan(
        rows.select("blog_id", place.alias("place"), search.alias("search"), replace.alias("replace")), escape_mode
    )


def plan_warnings(plan: DataFrame) -> DataFrame:
    """Plan rows whose replacement holds their own search text: a second run would extend it again."""
    return plan.where(F.col("replace").contains(F.col("search"))).select(
        "seq", "blog_id", "pass", "search", "replace", F.lit("not idempotent").alias("warning")
    )


def pattern_clashes(plan: DataFrame) -> DataFrame:
    """Pairs where an earlier search text is a proper prefix of a later one, so it damages the later one.

    Every search text is expanded into its own prefixes and met by equality: the work is the
    total length of the plan, not its square.
    """
    shortest = plan.agg(F.min(F.length("search")).alias("shortest")).scalar()
    later = (
        plan.withColumn("shortest", shortest)
        .where(F.length("search") > F.col("shortest"))
        .select(
            F.col("seq").alias("later_seq"),
            F.col("search").alias("later_search"),
            F.explode(F.sequence(F.col("shortest"), F.length("search") - 1)).alias("size"),
        )
        .withColumn("search", F.substring(F.col("later_search"), F.lit(1), F.col("size")))
    )
    earlier = plan.select(F.col("seq").alias("earlier_seq"), "search")
    return (
        later.join(earlier, "search")
        .where(F.col("earlier_seq") < F.col("later_seq"))
        .select("earlier_seq", "later_seq", F.col("search").alias("earlier_search"), "later_search")
    )


def clash_lines(plan: DataFrame) -> DataFrame:
    """One row for each plan line that an earlier, shorter search damages, however often searches repeat.

    ``(later_seq, later_search, n_searches, earlier_seq, earlier_search)``: how many distinct searches are proper
    prefixes of the line's search and stand before it, and the first of them. Only distinct searches meet, level by
    level: a search is cut at the lengths that other searches have, and each cut looks for its equal. A search has
    at most as many prefixes as it has characters, which bounds the list that goes back to its lines. Null searches
    and searches of one line alone give no row; of equal first places the shorter search is named.
    """
    distinct = plan.where(F.col("search").isNotNull()).groupBy("search").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    levels = distinct.agg(F.collect_set(F.length("search")).alias("levels")).scalar()
    cuts = distinct.withColumn("levels", levels).select(
        F.col("search").alias("later_search"),
        "last_seq",
        F.explode(F.filter("levels", lambda size: size < F.length("search"))).alias("size"),
    ).withColumn("search", F.substring(F.col("later_search"), F.lit(1), F.col("size")))
    prefixes = (
        cuts.join(distinct.select("search", "first_seq"), "search")
        .where(F.col("first_seq") < F.col("last_seq"))
        .groupBy("later_search")
        .agg(F.collect_list(F.struct("first_seq", "size")).alias("prefixes"))
    )
    lines = plan.select(F.col("seq").alias("later_seq"), F.col("search").alias("later_search")).join(prefixes, "later_search")
    before = F.filter("prefixes", lambda p: p["first_seq"] < F.col("later_seq"))
    first = F.array_min(F.col("before"))
    return lines.withColumn("before", before).where(F.size("before") > 0).select(
        "later_seq",
        "later_search",
        F.size("before").cast("bigint").alias("n_searches"),
        first["first_seq"].alias("earlier_seq"),
        F.substring(F.col("later_search"), F.lit(1), first["size"]).alias("earlier_search"),
    )
