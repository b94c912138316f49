"""User entry points: the whole migration, and each of its parts on its own."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import is_true, sanitize_domain
from urlshift.operators import detection, mappings as maps, network, proxy, revisions, settings as conf
from urlshift.operators.links import site_links
from urlshift.operators.replace import site_run_status, small_plan
from urlshift.operators.scope import compile_scope, dry_run_scope, rewrite_with_results, site_results
from urlshift.plans.patterns import COMPAT, pattern_clashes, plan_warnings, replacement_plan, single_site_plan
from urlshift.session import keep
from urlshift.sinks.statements import emit_delete_sql, emit_delete_sql_unlisted, emit_update_sql
from urlshift.sinks.tables import write_run, write_tables
from urlshift.sources.dump import import_dump
from urlshift.sources.listings import read_option
from urlshift.sources.project_files import (
    config_constants,
    read_lines,
    section_names,
    settings as parse_settings,
    site_mappings,
)


@dataclass(frozen=True)
class Job:
    """What to migrate and how. Answers a user would be asked for are parameters here."""

    old_domain: str
    new_domain: str
    prefix: str = fixed.DEFAULT_PREFIX
    all_tables: bool = True
    dry_run: bool = False
    clear_revisions: bool = True
    setup_stage_proxy: bool = True
    on_mismatch: str = "keep"
    escape_mode: str = COMPAT
    fill_missing_mappings: bool = True
    transient_patterns: tuple[str, ...] = ()
    on_reject: str = "fail"  # or "report": what to do with tuples of the dump that fit no table


@dataclass
class Outcome:
    """Tables after the run, the mappings to store, and every report as a table."""

    tables: dict[str, DataFrame]
    mappings: DataFrame
    plan: DataFrame
    is_network: bool
    main_id: int
    reports: dict[str, DataFrame] = field(default_factory=dict)
    written: dict[str, str] = field(default_factory=dict)


def _agreed_domain(job: Job, tables: dict[str, DataFrame], spark: SparkSession) -> str:
    """Old domain after the comparison with the stored site address."""
    if "options" not in tables:
        return job.old_domain
    found = read_option(tables["options"], blog_id=1).select(
        F.lit("run").alias("project"), F.col("option_value").alias("siteurl")
    )
    ours = spark.createDataFrame([("run", job.old_domain)], "project string, old_domain string")
    row = conf.domain_mismatch(ours, found, job.on_mismatch).first()
    if row.mismatch and row.domain is None:
        raise ValueError(f"configured domain {row.configured!r} does not match {row.found!r} in the database")
    return row.domain if row.mismatch else job.old_domain


def _listed(blogs: DataFrame) -> DataFrame:
    """Site list of a catalogue, in id order."""
    return maps.valid_site_rows(blogs).select(
        "blog_id",
        "domain",
        F.coalesce("path", F.lit("/")).alias("path"),
        F.col("blog_id").cast("bigint").alias("line_no"),
        F.concat(F.lit("https://"), F.col("domain"), F.coalesce("path", F.lit("/"))).alias("url"),
    )


def migrate(
    spark: SparkSession,
    job: Job,
    dump: str | list[str] | None = None,
    tables: dict[str, DataFrame] | None = None,
    mappings: DataFrame | None = None,
    facts: DataFrame | None = None,
    out: str | None = None,
    run_id: str | None = None,
) -> Outcome:
    """The whole run on a dump or on tables by base name (each with a ``blog_id``).

    ``mappings`` are ``(blog_id, old_domain, new_domain, line_no)``; ``facts`` is one row for ``classify_installs``.
    With ``out`` the tables are stored there, unless it is a dry run; with ``run_id`` as a run that can be continued and
    has a manifest. Without ``all_tables`` only the tables of sites are
    searched, in a network each with the steps of its own site. A dump whose tuples do not all fit their tables ends
    the run, unless ``on_reject`` is ``report``.
    """
    if not job.old_domain or not job.new_domain:
        raise ValueError("old and new domain must not be empty")
    if job.on_reject not in ("fail", "report"):
        raise ValueError(f"unknown on_reject {job.on_reject!r}")
    reports: dict[str, DataFrame] = {}
    if tables is None:
        if dump is None:
            raise ValueError("either a dump or tables are needed")
        imported = import_dump(spark, dump, prefix=job.prefix)
        tables = imported.tables
        reports["rejected"] = imported.rejected
        if imported.counts and job.on_reject == "fail":
            told = ", ".join(f"{n} of {base or 'undefined tables'}" for base, n in sorted(imported.counts.items()))
            raise ValueError(f"tuples that fit no table: {told}")
    tables = dict(tables)
    old_domain = _agreed_domain(job, tables, spark)
    clean = spark.range(1).select(sanitize_domain(F.lit(old_domain)), sanitize_domain(F.lit(job.new_domain))).first()
    old_domain, new_domain = clean[0], clean[1]
    if mappings is None:
        mappings = spark.createDataFrame([], "blog_id bigint, old_domain string, new_domain string, line_no bigint")

    blogs = tables.get("blogs")
    if facts is not None:
        reports["detection"] = detection.validate_detection(detection.classify_installs(facts))
        record = reports["detection"].select("installation_type", "multisite_type").first()
        is_network, network_type = record.installation_type == "multisite", record.multisite_type
    else:
        is_network, network_type = blogs is not None, "unknown"
    is_network = is_network and blogs is not None

    # Revisions go first: what is deleted is not searched.
    if "posts" in tables:
        before = tables["posts"]
        if job.clear_revisions and not job.dry_run:
            if "postmeta" in tables:
                tables["postmeta"] = revisions.delete_revision_meta(before, tables["postmeta"])
            tables["posts"] = revisions.without_revisions(before)
        elif is_network:
            reports["delete_statements"] = emit_delete_sql(blogs, job.prefix)
        else:
            reports["delete_statements"] = emit_delete_sql_unlisted(spark, False, job.prefix)
        reports["revisions"] = revisions.revision_report(before, tables["posts"])

    main_id = 1
    if is_network:
        sites = keep(_listed(blogs), "sites")
        main_id = network.main_site(sites, sites, tables.get("site")).first().blog_id
        if job.fill_missing_mappings:
            missing = maps.missing_mappings(sites, mappings)
            mappings = maps.upsert_mapping(
                mappings, maps.suggest_mappings(missing, base=new_domain).withColumn("line_no", F.col("blog_id"))
            )
        # Everything below reads these two small tables many times.
        mappings = used = keep(mappings, "mappings")
        reports["summary"] = maps.mapping_summary(used, sites, main_id)
        plan = keep(replacement_plan(used, sites, main_id, job.escape_mode), "plan")
        updates = network.plan_blog_updates(used, main_id, network_type)
        base = network.network_base(used, main_id)
        reports["update_statements"] = emit_update_sql(updates, base, main_id, job.prefix)
        results = network.update_results(blogs, updates)
        reports["update_counts"] = network.update_counts(results)
        reports["update_failures"] = network.failed_updates(results)
        if not job.dry_run:
            tables["blogs"] = network.update_blogs(blogs, updates)
            if "site" in tables:
                tables["site"] = network.update_network(
                    tables["site"], F.coalesce(base.scalar(), F.col("domain"))
                )
        after = _listed(tables["blogs"])
    else:
        plan = single_site_plan(spark, old_domain, new_domain, job.escape_mode)
        one = spark.createDataFrame(
            [(1, old_domain, new_domain, 1)], "blog_id bigint, old_domain string, new_domain string, line_no bigint"
        )
        mappings = maps.upsert_mapping(mappings, one)
        after = one.select("blog_id", F.lit(f"https://{new_domain}").alias("url"))
    reports["warnings"] = plan_warnings(plan)
    reports["clashes"] = pattern_clashes(plan)

    # An ordinary plan comes to the driver once for all tables; a larger one stays a table.
    steps = small_plan(plan)
    steps = plan if steps is None else steps
    scopes = compile_scope(tables, job.all_tables, is_network)
    if job.dry_run:
        reports["replacements"] = dry_run_scope(tables, scopes, plan, steps)
    else:
        counted = []
        for name, scope in scopes.items():
            tables[name], found = rewrite_with_results(name, tables[name], scope, plan, steps, None if is_network else 1)
            counted += [found] if found is not None else []
        reports["site_results"] = site_results(plan, counted)
        reports["site_status"] = site_run_status(reports["site_results"])
        if counted:
            reports["table_results"] = reduce(DataFrame.unionByName, counted)
        if "options" in tables:
            options = proxy.purge_transients(tables["options"], list(job.transient_patterns))
            if job.setup_stage_proxy:
                reports["proxy"] = proxy.proxy_settings(after, mappings)
                options = proxy.upsert_options(options, proxy.proxy_option_rows(reports["proxy"]))
            tables["options"] = options
    reports["links"] = site_links(after, main_id, is_network)
    written = {}
    if out and run_id and not job.dry_run:
        written = write_run(tables, out, run_id)
    elif out:
        written = write_tables(tables, out, job.dry_run)
    return Outcome(tables, mappings, plan, is_network, main_id, reports, written)


def job_from_config(lines: DataFrame, project: str, **changes) -> tuple[Job, DataFrame]:
    """The job and the site mappings that a project's settings describe, with defaults for what they leave out.

    ``changes`` override settings. A project whose settings do not pass the check is refused.
    """
    own = lines.where(F.col("project") == project)
    problems = config_validate(own).first()
    if problems is None or problems.errors:
        raise ValueError(f"project {project!r}: " + ("no settings" if problems is None else "; ".join(problems.errors)))
    row = conf.settings_with_defaults(parse_settings(own)).select(
        sanitize_domain("old_domain").alias("old_domain"), sanitize_domain("new_domain").alias("new_domain"),
        *(is_true(F.col(c)).alias(c) for c in ("all_tables", "dry_run", "clear_revisions", "setup_stage_proxy")),
    ).first()
    return Job(**{**row.asDict(), **changes}), site_mappings(own).select("blog_id", "old_domain", "new_domain", "line_no")


def migrate_from_config(
    spark: SparkSession,
    lines: DataFrame,
    project: str,
    dump: str | list[str] | None = None,
    tables: dict[str, DataFrame] | None = None,
    facts: DataFrame | None = None,
    out: str | None = None,
    **changes,
) -> Outcome:
    """``migrate`` as the settings of a project say."""
    job, mappings = job_from_config(lines, project, **changes)
    return migrate(spark, job, dump, tables, mappings, facts, out)


def revision_sql(spark: SparkSession, sites: DataFrame | None, is_network: bool, prefix: str = fixed.DEFAULT_PREFIX):
    """Delete statements: per listed site, or of the main site where no list is known."""
    if sites is not None:
        return emit_delete_sql(sites, prefix, comments=True)
    return emit_delete_sql_unlisted(spark, is_network, prefix)


def proxy_setup(lines: DataFrame, project: str, sites: DataFrame | None, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proxy settings of one project and its options with them; without a site list from the mappings alone."""
    known = proxy.proxy_mappings(lines).where(F.col("project") == project)
    if sites is not None:
        chosen = proxy.proxy_settings(sites, known)
    else:
        general = parse_settings(lines).where((F.col("project") == project) & (F.col("key") == "new_domain")).first()
        chosen = proxy.proxy_settings_from_mappings(
            known, general.value if general else fixed.LAST_RESORT_DOMAIN
        )
    return chosen, proxy.upsert_options(options, proxy.proxy_option_rows(chosen))


def detect(lines: DataFrame, listing: DataFrame, probes: DataFrame) -> DataFrame:
    """Checked detection record of every project from its configuration lines, path listing and probes.

    ``probes`` is ``(project, probe, blog_count_probe, site_list_count, subdomain_probe)``.
    """
    constants = config_constants(lines).groupBy("project").agg(
        F.max(F.when(F.col("name") == "MULTISITE", F.col("value"))).alias("multisite_constant"),
        F.max(F.when(F.col("name") == "SUBDOMAIN_INSTALL", F.col("value"))).alias("subdomain_constant"),
    )
    facts = (
        probes.join(constants, "project", "left")
        .join(detection.multisite_indicators(listing), "project", "left")
    )
    return detection.validate_detection(detection.classify_installs(facts))


def show_links(sites: DataFrame, main_id: int | None = None, is_network: bool = True) -> DataFrame:
    """Links of all listed sites; the main site is detected unless it is given."""
    if main_id is None:
        main_id = network.main_site(sites, is_network=is_network).first().blog_id
    return site_links(sites, main_id, is_network)


def config_show(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settings with defaults, and the site mappings, of every project."""
    return conf.settings_with_defaults(parse_settings(lines)), site_mappings(lines)


def config_validate(lines: DataFrame) -> DataFrame:
    return conf.validate_settings(section_names(lines), parse_settings(lines))


def project_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of project files, the input of the entry points above."""
    return read_lines(spark, paths)
