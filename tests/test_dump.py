import random

import pytest
from pyspark.errors import AnalysisException

from urlshift.sources.dump import dump_schemas, dump_statements, read_sql_dump, rejected_rows

HEAD = r"""-- MySQL dump 10.13
--
/*!40101 SET NAMES utf8 */;
DROP TABLE IF EXISTS `wp_posts`;
CREATE TABLE `wp_posts` (
  `ID` bigint(20) unsigned NOT NULL AUTO_INCREMENT,
  `post_content` longtext NOT NULL,
  `rank` double DEFAULT NULL,
  PRIMARY KEY (`ID`),
  KEY `x` (`rank`)
) ENGINE=InnoDB;
"""


def dump(tmp_path, text, name="a.sql"):
    path = tmp_path / name
    path.write_text(HEAD + text, encoding="utf-8")
    return str(path)


def quoted(text):
    """Any of the ways a dump may write the same text."""
    out = []
    for char in text:
        out.append({"'": "\\'", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", '"': '\\"'}.get(char, char))
    return "'" + "".join(out) + "'"


def test_values(spark, tmp_path):
    path = dump(tmp_path, r"""INSERT INTO `wp_posts` VALUES (1,'it\'s (ok); a,b\\n\nx''y',NULL),(-2,'a;b) , (c',1.5e3);
-- a comment; with an end
INSERT INTO `wp_2_posts` (`rank`, `ID`, `post_content`) VALUES
(0.5, 7, _binary 'bin'),
( NULL , 8 , 0x4142 );
INSERT INTO wp_3_posts VALUES (9,"say ""hi"" \% \x",0);
""")
    rows = {(r.blog_id, r.ID, r.post_content, r["rank"]) for r in read_sql_dump(spark, path)["posts"].collect()}
    assert rows == {
        (1, 1, "it's (ok); a,b\\n\nx'y", None), (1, -2, "a;b) , (c", 1500.0),
        (2, 7, "bin", 0.5), (2, 8, "AB", None), (3, 9, 'say "hi" \\% x', 0.0),
    }
    assert rejected_rows(spark, path).count() == 0


def test_random_texts_come_back(spark, tmp_path):
    rng = random.Random(3)
    alphabet = ["'", "''", "\\", "\\\\", "\n", "\r", ";", ";\n", "(", ")", ",", '"', "a", "é", "\t", "\0", "NULL", "--", "/*", "`"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    tuples = [f"({i},{quoted(t)},NULL)" for i, t in enumerate(texts)]
    body = "".join(f"INSERT INTO `wp_posts` VALUES {','.join(tuples[i:i + 7])};\n" for i in range(0, 400, 7))
    for staged in (False, True):
        got = read_sql_dump(spark, dump(tmp_path, body, f"{staged}.sql"), staged=staged)["posts"].orderBy("ID").collect()
        assert [r.post_content for r in got] == texts


def test_long_statement_needs_no_recursion(spark, tmp_path):
    long = "x\\'" * 400_000
    path = dump(tmp_path, f"INSERT INTO `wp_posts` VALUES (1,'{long}',1)" + ",(2,'y',2)" * 20_000 + ";\n")
    posts = read_sql_dump(spark, path)["posts"]
    assert posts.count() == 20_001 and posts.where("ID = 1").first().post_content == "x'" * 400_000


def test_small_splits_lose_nothing(spark, tmp_path):
    body = "".join(f"INSERT INTO `wp_{2 + i % 3}_posts` VALUES ({i},'t{i}; x',{i});\n" for i in range(2000))
    path = dump(tmp_path, body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        posts = read_sql_dump(spark, path)["posts"]
        assert posts.rdd.getNumPartitions() > 20
        assert posts.count() == 2000 and posts.select("ID").distinct().count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rejected_rows_tell_why(spark, tmp_path):
    path = dump(tmp_path, """INSERT INTO `wp_posts` VALUES (1,'few');
INSERT INTO `wp_posts` VALUES ('many','x',1);
INSERT INTO `other` VALUES (1);
INSERT INTO `wp_posts` VALUES (2,'cut (3,4,5) here
""")
    reasons = {(r.table_name, r.reason) for r in rejected_rows(spark, path).collect()}
    assert reasons == {
        ("wp_posts", "wrong number of values"), ("wp_posts", "value does not fit its type"),
        ("other", "table without a definition"), ("wp_posts", "statement is cut or not plain"),
    }
    assert read_sql_dump(spark, path)["posts"].count() == 0


def test_empty_and_missing_dump(spark, tmp_path):
    empty = tmp_path / "empty.sql"
    empty.write_text("")
    assert read_sql_dump(spark, str(empty)) == {}
    with pytest.raises(AnalysisException):
        read_sql_dump(spark, str(tmp_path / "none.sql"))


def test_schemas(spark, tmp_path):
    schemas = dump_schemas(dump_statements(spark, dump(tmp_path, "")))
    assert {k: v.simpleString() for k, v in schemas.items()} == {
        "posts": "struct<ID:bigint,post_content:string,rank:double>"}


def test_sites_with_other_columns(spark, tmp_path):
    text = """CREATE TABLE `wp_ext` (
  `id` bigint(20) NOT NULL,
  `a` varchar(9),
  `b` varchar(9)
);
CREATE TABLE `wp_2_ext` (
  `id` bigint(20) NOT NULL,
  `b` varchar(9),
  `a` varchar(9)
);
CREATE TABLE `wp_3_ext` (
  `id` bigint(20) NOT NULL,
  `a` varchar(9),
  `b` varchar(9),
  `c` int(11)
);
INSERT INTO `wp_ext` VALUES (1,'a1','b1');
INSERT INTO `wp_2_ext` VALUES (2,'b2','a2');
INSERT INTO `wp_3_ext` VALUES (3,'a3','b3',7);
"""
    path = tmp_path / "dump.sql"
    path.write_text(text)
    for staged in (False, True):
        table = read_sql_dump(spark, str(path), staged=staged)["ext"]
        assert sorted(tuple(r) for r in table.select("blog_id", "id", "a", "b", "c").collect()) == [
            (1, 1, "a1", "b1", None), (2, 2, "a2", "b2", None), (3, 3, "a3", "b3", 7)]
    assert rejected_rows(spark, str(path)).collect() == []
