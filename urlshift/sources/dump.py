"""SQL dumps as tables.

A dump is read in statements (see ``statements``), in as many tasks as its files have splits. Tuples and values are cut
by regular expressions inside the JVM. All repetitions in them are possessive, which keeps them linear and free of
recursion on statements of many megabytes.

Every tuple is tagged with the reason why it does not fit its table, if any. ``import_dump`` writes all of them once and
counts the unfit ones of each table in that write.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlshift import fixed_values as fixed
from urlshift.session import keep, scratch_path
from urlshift.sources.statements import sql_statements

_QUOTED = r"""'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+\""""
_TUPLE = rf"""\((?:[^'"()]++|{_QUOTED})*+\)"""
_VALUE = rf"""(?:[^,'"]++|{_QUOTED})++"""
_COMMENTS = r"""\A(?:\s++|--[^\n]*+(?:\n|\z)|#[^\n]*+(?:\n|\z)|/\*(?:[^*]|\*(?!/))*+\*/;?)*+"""
_NAME = r"""(?:[A-Za-z0-9_$]+\.)?(?:`[^`]+`|"[^"]+"|[A-Za-z0-9_$]+)"""
_INSERT = rf"""(?is)\A(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+({_NAME})\s*(\([^)]*\))?\s*VALUES\s*"""
_CREATE = rf"""(?is)\ACREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*\("""
_COLUMN = r"""(?m)^\s*[`"]([^`"]+)[`"]\s+([A-Za-z]+)"""

# What a text type name of the dump becomes; every other type stays text.
_WHOLE = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint")
_REAL = ("float", "double", "real")


def dump_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(stmt)``: statements without the comments in front of them and their ``;``. A missing file is an error."""
    stmt = F.regexp_replace(F.regexp_replace("stmt", _COMMENTS, ""), r";\s*\z", "")
    return sql_statements(spark, paths).select(stmt.alias("stmt")).where(F.col("stmt") != "")


def _bare_name(name: Column) -> Column:
    return F.translate(F.regexp_replace(name, r"(?s)\A[A-Za-z0-9_$]+\.", ""), '`"', "")


def _unescaped(text: Column) -> Column:
    """Content of a quoted value: doubled quotes and backslash escapes undone.

    Pairs of backslashes are cut out first, left to right; what is left between them holds single
    escapes only, which cannot overlap.
    """
    def replaced(p: Column, *escapes: tuple[str, str]) -> Column:
        for written, meant in escapes:
            p = F.replace(p, F.lit(written), F.lit(meant))
        return p

    def common(p: Column) -> Column:
        return replaced(p, ("''", "'"), (r"\n", "\n"), (r"\'", "'"), (r"\"", '"'))

    def rare(p: Column) -> Column:
        known = replaced(p, (r"\r", "\r"), (r"\t", "\t"), (r"\0", "\0"), (r"\b", "\b"), (r"\Z", "\x1a"))
        return F.when(p.contains("\\"), F.regexp_replace(known, r"(?s)\\([^%_])", "$1")).otherwise(p)

    pieces = F.transform(F.transform(F.split(text, r"\\\\"), common), rare)
    return F.when(text.contains("\\"), F.array_join(pieces, "\\")).otherwise(F.replace(text, F.lit("''"), F.lit("'")))


def _plain_value(value: Column) -> Column:
    """A value of a tuple as text, NULL for NULL. The forms every dump tool writes are tried first."""
    v = F.regexp_replace(F.regexp_replace(value, r"\A\s+|\s+\z", ""), r"(?s)\A_[A-Za-z0-9]+\s*(?=['\"])", "")

    def inner(text: Column) -> Column:
        return F.substring(text, F.lit(2), F.length(text) - 2)

    return (
        F.when(value.startswith("'") & value.endswith("'"), _unescaped(inner(value)))
        .when(value == "NULL", F.lit(None).cast("string"))
        .when(value.rlike(r"\A[-+.0-9]+\z"), value)
        .when(F.upper(v) == "NULL", F.lit(None).cast("string"))
        .when(v.startswith("'"), _unescaped(inner(v)))
        .when(v.startswith('"'), _unescaped(F.replace(inner(v), F.lit('""'), F.lit('"'))))
        .when(v.rlike(r"\A0x(?:[0-9A-Fa-f]{2})+\z"), F.decode(F.unhex(F.substring(v, 3, 1 << 30)), "UTF-8"))
        .otherwise(v)
    )


def _cut_tuple(text: Column) -> Column:
    """The values of one tuple as texts."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.transform(F.regexp_extract_all(inner, F.lit(rf"(?s)({_VALUE})"), 1), _plain_value)


def dump_rows(statements: DataFrame) -> DataFrame:
    """``(table_name, columns, whole, values)``: one row per inserted tuple, its values as texts.

    ``whole`` is false for a statement whose text is more than its tuples (a cut or foreign statement).
    """
    inserts = statements.where(F.col("stmt").rlike(_INSERT))
    head = F.regexp_extract("stmt", _INSERT, 0)
    names = F.regexp_extract("stmt", _INSERT, 2)
    tail = F.substring(F.col("stmt"), F.length(head) + 1, F.length("stmt"))
    cut = inserts.select(
        _bare_name(F.regexp_extract("stmt", _INSERT, 1)).alias("table_name"),
        F.when(names != "", F.split(F.regexp_replace(F.translate(names, '`"()', ""), r"\s", ""), ",")).alias("columns"),
        tail.alias("tail"),
    ).select(
        "table_name",
        "columns",
        F.col("tail").rlike(rf"(?s)\A(?:{_TUPLE}[\s,]*+)*+;?\s*\z").alias("whole"),
        F.transform(F.regexp_extract_all("tail", F.lit(rf"(?s)({_TUPLE})"), 1), _cut_tuple).alias("tuples"),
    )
    # The explode comes last and alone: next to an expression on the statement it would copy the
    # statement into every one of its rows. Values are read before it, so that no later filter or
    # column reads them again.
    return cut.select("table_name", "columns", "whole", F.explode_outer("tuples").alias("values"))


def _definitions(statements: DataFrame) -> DataFrame:
    """``(table_name, names, types)`` of the table definitions, one per physical table."""
    created = statements.where(F.col("stmt").rlike(_CREATE)).select(
        _bare_name(F.regexp_extract("stmt", _CREATE, 1)).alias("table_name"),
        F.regexp_extract_all("stmt", F.lit(_COLUMN), 1).alias("names"),
        F.regexp_extract_all("stmt", F.lit(_COLUMN), 2).alias("types"),
    )
    return created.groupBy("table_name").agg(F.min(F.struct("names", "types")).alias("d")).select("table_name", "d.*")


def _layouts(definitions: DataFrame, prefix: str) -> DataFrame:
    """``(table_name, blog_id, base_name, names, types)``: which site and base table each defined table stands for.

    A number behind the prefix is a site only if that site has a table of posts or options, or the main site has the
    same table. A table without the prefix belongs to no site (NULL) and keeps its full name, after ``other:`` where a
    base table has that name.
    """
    name = F.col("table_name")
    rest = F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name)))
    number = F.regexp_extract(rest, r"\A([0-9]+)_.", 1).try_cast("bigint")
    own = F.regexp_replace(rest, r"\A[0-9]+_", "")
    named = definitions.withColumns({"rest": rest, "number": number, "own": own})
    sites = named.where(F.col("number").isNotNull() & F.col("own").isin(*fixed.SITE_TABLES)).select(F.col("number").alias("site")).distinct()
    main = named.where(F.col("number").isNull() & F.col("rest").isNotNull()).select(F.col("rest").alias("of_main")).distinct()
    known = named.join(sites, F.col("number") == F.col("site"), "left").join(main, F.col("own") == F.col("of_main"), "left")
    numbered = F.col("number").isNotNull() & (F.col("site").isNotNull() | F.col("of_main").isNotNull())
    placed = known.select(
        "table_name",
        F.when(F.col("rest").isNotNull(), F.when(numbered, F.col("number")).otherwise(F.lit(1).cast("bigint"))).alias("blog_id"),
        F.when(numbered, F.col("own")).otherwise(F.col("rest")).alias("base_name"),
        "names",
        "types",
    )
    bases = placed.where("blog_id IS NOT NULL").select(F.col("base_name").alias("taken")).distinct()
    other = F.when(F.col("taken").isNotNull(), F.concat(F.lit("other:"), "table_name")).otherwise(F.col("table_name"))
    return placed.join(bases, F.col("table_name") == F.col("taken"), "left").select(
        "table_name", "blog_id", F.coalesce("base_name", other).alias("base_name"), "names", "types"
    )


def _schemas_of(layouts: DataFrame) -> dict[str, T.StructType]:
    kind = F.lower("c.types")
    rank = F.when(kind.isin(*_WHOLE), 0).when(kind.isin(*_REAL), 1).otherwise(2)
    rows = (
        layouts.select("base_name", F.posexplode(F.arrays_zip("names", "types")).alias("place", "c"))
        .groupBy("base_name", F.col("c.names").alias("name"))
        .agg(F.min("place").alias("place"), F.max_by("c.types", rank).alias("type"))
        .collect()
    )
    schemas: dict[str, T.StructType] = {}
    for row in sorted(rows, key=lambda r: (r.base_name, r.place, r.name)):
        schemas.setdefault(row.base_name, T.StructType()).add(row.name, _spark_type(row.type))
    return schemas


def dump_schemas(statements: DataFrame, prefix: str = fixed.DEFAULT_PREFIX) -> dict[str, T.StructType]:
    """Column names and types by base table, from the table definitions of the dump.

    A base table has the columns of all its sites, in the order of their places; where sites differ in a type, the
    wider one counts. The answer is as small as one site's set of tables.
    """
    return _schemas_of(_layouts(_definitions(statements), prefix))


def _spark_type(kind: str) -> T.DataType:
    kind = kind.lower()
    return T.LongType() if kind in _WHOLE else T.DoubleType() if kind in _REAL else T.StringType()


def _as_schema(schema: T.StructType | str) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def _cells(schema: T.StructType) -> list[tuple[T.StructField, Column]]:
    """The text cell of every schema column: by name where the statement lists columns, else by place."""
    cells = []
    for place, field in enumerate(schema.fields):
        by_name = F.array_position("columns", field.name).cast("int")
        at = F.when(F.col("columns").isNotNull(), by_name - 1).otherwise(F.lit(place))
        cells.append((field, F.get(F.col("values"), at)))
    return cells


def _constant(value: object, kind: str) -> Column:
    """A constant of nested type, folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _reason(known: dict[str, T.StructType]) -> Column:
    """Why a tuple does not fit its table, NULL where it does: one expression for all tables."""
    if not known:
        return F.lit("table without a definition")
    named = {base: {f.name: f.dataType.simpleString() for f in schema.fields} for base, schema in known.items()}
    types = {f.dataType.simpleString(): f.dataType for schema in known.values() for f in schema.fields}
    by_name = F.element_at(_constant(named, "map<string, map<string, string>>"), F.col("base_name"))
    in_order = {base: list(columns.values()) for base, columns in named.items()}
    by_place = F.element_at(_constant(in_order, "map<string, array<string>>"), F.col("base_name"))
    listed = F.transform("columns", lambda name: F.element_at(by_name, name))
    kinds = F.when(F.col("columns").isNotNull(), listed).otherwise(by_place)

    def lost(value: Column, kind: Column) -> Column:
        tests = [(kind == n) & value.try_cast(t).isNull() for n, t in types.items() if not isinstance(t, T.StringType)]
        unfit = F.lit(False)
        for test in tests:
            unfit = unfit | test
        return F.coalesce(value.isNotNull() & unfit, F.lit(False))

    return (
        F.when(by_name.isNull(), F.lit("table without a definition"))
        .when(~F.col("whole"), F.lit("statement is cut or not plain"))
        .when(F.col("values").isNull(), F.lit("statement without values"))
        .when(F.size("values") != F.size(kinds), F.lit("wrong number of values"))
        .when(F.exists(F.zip_with("values", kinds, lost), lambda x: x), F.lit("value does not fit its type"))
    )


def _given_layout(rows: DataFrame, known: dict[str, T.StructType], prefix: str) -> DataFrame:
    """Site and base table by the names alone; a number is a site where the rest is a known table and the whole is not."""
    name, bases = F.col("table_name"), list(known)
    rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
    own = F.regexp_replace(rest, r"\A[0-9]+_", "")
    numbered = rest.rlike(r"\A[0-9]+_.") & own.isin(bases) & ~rest.isin(bases)
    site = F.when(numbered, F.regexp_extract(rest, r"\A([0-9]+)_", 1).try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    return rows.withColumns(
        {
            "blog_id": F.when(name.startswith(prefix), site),
            "base_name": F.when(name.startswith(prefix), F.when(numbered, own).otherwise(rest)).otherwise(name),
        }
    )


def _tagged(
    spark: SparkSession, paths: str | list[str], schemas: dict[str, T.StructType | str] | None, prefix: str
) -> tuple[DataFrame, dict[str, T.StructType]]:
    """``(table_name, columns, whole, values, blog_id, base_name, reason)`` of all tuples, and the known tables."""
    statements = dump_statements(spark, paths)
    if schemas:
        known = {k: _as_schema(s) for k, s in schemas.items()}
        rows = _given_layout(dump_rows(statements), known, prefix)
    else:
        # Written, so that Spark knows how small it is before the join; tuples of one table are not dealt by its name then.
        layouts = keep(_layouts(_definitions(statements), prefix), "layouts")
        known = _schemas_of(layouts)
        defined = layouts.select("table_name", "names", F.col("blog_id").alias("site"), F.col("base_name").alias("base"))
        # A table of a dump that defines it elsewhere (one file a site) goes by its name.
        rows = _given_layout(dump_rows(statements).join(defined, "table_name", "left"), known, prefix)
        own = F.col("base").isNotNull()
        rows = rows.select(
            "table_name", F.coalesce("columns", "names").alias("columns"), "whole", "values",
            F.when(own, F.col("site")).otherwise(F.col("blog_id")).alias("blog_id"),
            F.when(own, F.col("base")).otherwise(F.col("base_name")).alias("base_name"),
        )
    return rows.withColumn("reason", _reason(known)), known


def _typed(rows: DataFrame, base: str, schema: T.StructType) -> DataFrame:
    own_site = "blog_id" in schema.fieldNames()
    columns = [cell.try_cast(field.dataType).alias(field.name) for field, cell in _cells(schema)]
    site = [] if own_site else [F.col("blog_id").alias("blog_id")]
    return rows.where((F.col("base_name") == base) & F.col("reason").isNull()).select(*site, *columns)


@dataclass
class Import:
    """The tables of a dump, the tuples that fit none, and how many of these each table has (none: not listed)."""

    tables: dict[str, DataFrame]
    rejected: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def import_dump(
    spark: SparkSession,
    paths: str | list[str],
    schemas: dict[str, T.StructType | str] | None = None,
    prefix: str = fixed.DEFAULT_PREFIX,
) -> Import:
    """Parse the text once into the shared folder, laid out by table, and count what does not fit in the same write."""
    rows, known = _tagged(spark, paths, schemas, prefix)
    seen = Observation()
    unfit = F.col("reason").isNotNull()
    bases = dict(enumerate(known))
    counted = [F.count_if(unfit & (F.col("base_name") == base)).alias(f"n{i}") for i, base in bases.items()]
    none = F.count_if(F.col("reason") == "table without a definition").alias("none")
    path = scratch_path(spark, "dump")
    rows.observe(seen, none, *counted).write.mode("errorifexists").partitionBy("base_name").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    told = seen.get
    counts = {base: told[f"n{i}"] for i, base in bases.items() if told[f"n{i}"]}
    if told["none"]:
        counts[""] = told["none"]  # tables without a definition
    rejected = rows.where(unfit).select("table_name", "reason", "values")
    return Import({base: _typed(rows, base, schema) for base, schema in known.items()}, rejected, counts)


def read_sql_dump(
    spark: SparkSession,
    paths: str | list[str],
    schemas: dict[str, T.StructType | str] | None = None,
    prefix: str = fixed.DEFAULT_PREFIX,
    staged: bool = False,
) -> dict[str, DataFrame]:
    """One table per base name, with the rows of all sites and their ``blog_id`` (NULL for tables without the prefix).

    Schemas come from the dump's own table definitions unless given; the columns of different sites are then matched by
    name, and a column that a site does not have is NULL there. ``staged`` parses the text once into the shared folder;
    without it each table is its own scan of the text, which is cheaper only where few tables are used. Tuples that fit
    no table are left out; ``import_dump`` tells how many.
    """
    if staged:
        return import_dump(spark, paths, schemas, prefix).tables
    rows, known = _tagged(spark, paths, schemas, prefix)
    return {base: _typed(rows, base, schema) for base, schema in known.items()}


def rejected_rows(
    spark: SparkSession,
    paths: str | list[str],
    schemas: dict[str, T.StructType | str] | None = None,
    prefix: str = fixed.DEFAULT_PREFIX,
) -> DataFrame:
    """``(table_name, reason, values)`` of every tuple ``read_sql_dump`` leaves out."""
    rows, _ = _tagged(spark, paths, schemas, prefix)
    return rows.where(F.col("reason").isNotNull()).select("table_name", "reason", "values")
