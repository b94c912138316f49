"""Statements cut by quote state, wherever the files are split."""

import random

import pytest

from urlshift.sources import statements
from urlshift.sources.dump import import_dump, read_sql_dump, rejected_rows
from urlshift.sources.statements import CODE, SINGLE, scan, sql_statements


def plain_statements(text):
    """One character after another."""
    out, begin, at, state = [], 0, 0, "code"
    while at < len(text):
        c, two = text[at], text[at : at + 2]
        if state == "code":
            if c in "'\"`":
                state = c
            elif c == "#" or (two == "--" and (text[at + 2 : at + 3] or "\n").isspace()):
                at = (text.find("\n", at) + len(text)) % len(text) if "\n" in text[at:] else len(text)
            elif two == "/*":
                at = text.find("*/", at + 2)
                at = len(text) if at < 0 else at + 1
            elif c == ";":
                out.append(text[begin : at + 1])
                begin = at + 1
        elif c == "\\" and state != "`":
            at += 1
        elif c == state:
            state = "code"
        at += 1
    rest = text[begin:]
    return [s.strip() for s in [*out, rest] if s.strip()]


def some_text(some):
    parts = ["'", "''", '"', "`", "\\'", "\\\\", "\\\n", ";", ";\n", "\r\n", "\n", "-- x; '\n", "--y", "#z;\"\n", "/* ;' */", "/", "*", "-", "a", "é", " ", "(1,2)"]
    return "".join(some.choice(parts) for _ in range(some.randint(0, 60)))


def test_scan_against_one_character_after_another():
    some = random.Random(2)
    for _ in range(20_000):
        text = some_text(some) + "\n"
        state, out, held = CODE, [], ""
        for line in text.splitlines(keepends=True) if False else [x + "\n" for x in text[:-1].split("\n")]:
            state, ends = scan(state, line)
            for a, b in zip([0, *ends], [*ends, None], strict=True):
                held += line[a:b]
                if b is not None:
                    out.append(held.strip())
                    held = ""
        assert [s for s in [*out, held.strip()] if s] == plain_statements(text), text


def test_long_lines_take_linear_time():
    for part in ("'", "''", "\\", "-", "--", "/", "/*", "`", '"', "a;", "'a',"):
        for state in statements.STATES:
            scan(state, part * 400_000 + "\n")


@pytest.mark.parametrize("size", [37, 150, 1000])
def test_splits_anywhere(spark, tmp_path, size):
    some = random.Random(size)
    wanted = []
    for i in range(3):
        text = "".join(some_text(some) + some.choice(["\n", ";\n"]) for _ in range(30)) + some.choice(["", ";", "\n"])
        (tmp_path / f"{i}.sql").write_bytes(text.encode())
        wanted += plain_statements(text + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [r.stmt.strip() for r in sql_statements(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(s for s in got if s) == sorted(wanted)


def test_splits_of_one_file():
    lead = [1, 0, 2, 3, 4]
    led = [("f", 0, lead, [True] * 5), ("f", 10, lead, [False] * 5), ("f", 20, lead, [False, True, False, False, False]), ("g", 0, lead, [False] * 5)]
    splits = statements.splits_of(reversed(led))
    assert [(splits[k, b].state, splits[k, b].chain) for k, b, *_ in led] == [(CODE, 0), (SINGLE, 0), (CODE, 0), (CODE, 0)]
    assert [splits[k, b].last for k, b, *_ in led] == [False, False, True, True]


TABLE = "CREATE TABLE `%s` (\n  `ID` bigint(20),\n  `t` longtext\n);\n"


def test_raw_ends_and_carriage_returns(spark, tmp_path):
    text = "a;\nb;\r\n-- c;\n/* d"
    body = TABLE % "wp_posts" + f"INSERT INTO `wp_posts` VALUES (1,'{text}'),\n(2,'it''s;\n');\nINSERT INTO `wp_posts` VALUES (3,'x');"
    for name, content in (("a.sql", body), ("b.sql", body.replace(";\n", ";\r\n"))):
        (tmp_path / name).write_bytes(content.encode())
        rows = {r.ID: r.t for r in read_sql_dump(spark, str(tmp_path / name))["posts"].collect()}
        assert rows == {i: t.replace(";\n", ";\r\n") if name == "b.sql" else t for i, t in {1: text, 2: "it's;\n", 3: "x"}.items()}


def test_tables_of_nobody(spark, tmp_path):
    names = ["wp_posts", "wp_2_posts", "wp_404_log", "wp_2_log", "posts", "log_9", "wp_2_x_y"]
    path = tmp_path / "a.sql"
    path.write_text("".join(TABLE % n + f"INSERT INTO `{n}` VALUES ({i},'{n}');\n" for i, n in enumerate(names)))
    for staged in (False, True):
        tables = read_sql_dump(spark, str(path), staged=staged)
        got = {(base, r.blog_id, r.t) for base, df in tables.items() for r in df.collect()}
        assert got == {
            ("posts", 1, "wp_posts"), ("posts", 2, "wp_2_posts"), ("404_log", 1, "wp_404_log"), ("log", 2, "wp_2_log"),
            ("other:posts", None, "posts"), ("log_9", None, "log_9"), ("x_y", 2, "wp_2_x_y")}


def test_unfit_tuples_are_counted_in_the_write(spark, tmp_path):
    path = tmp_path / "a.sql"
    path.write_text(TABLE % "wp_posts" + TABLE % "wp_options" + "INSERT INTO `wp_posts` VALUES (1,'a'),('x','b'),(2,'c','d');\n"
                    "INSERT INTO `wp_options` VALUES (1,'a');\nINSERT INTO `else` VALUES (1),(2);\nINSERT INTO `wp_posts` VALUES (3,'cut\n")
    done = import_dump(spark, str(path))
    assert done.counts == {"posts": 3, "": 2}
    assert done.tables["posts"].count() == 1 and done.tables["options"].count() == 1
    told = sorted((r.table_name, r.reason) for r in done.rejected.collect())
    assert told == sorted((r.table_name, r.reason) for r in rejected_rows(spark, str(path)).collect())
    assert [x for x, _ in told] == ["else", "else", "wp_posts", "wp_posts", "wp_posts"]
