"""The pipeline on a small corpus with planted rows, each stage against what it must do."""

import random

import corpus_pipeline as pipeline

SOME = random.Random(9)
WORDS = ["".join(SOME.choice("abcdefghijé") for _ in range(SOME.randint(2, 8))) for _ in range(700)]


def prose(n):
    return " ".join(SOME.choice(WORDS) for _ in range(n))


def test_stages(spark, tmp_path):
    item, passage = prose(40), prose(120)
    rows = {i: prose(SOME.randint(20, 150)) for i in range(120)}
    for i in range(0, 60, 2):
        rows[i] += " vilescum horridtrash " + prose(5)
    near = prose(100)
    rows |= {200: near, 201: near, 202: near + " tail", 203: "".join(c.upper() if c.isascii() else c for c in near)}
    rows |= {210: f"{prose(30)} {passage} {prose(30)}", 211: f"{prose(25)} {passage} {prose(25)}"}
    rows |= {220: f"{prose(50)} {item} {prose(20)}", 230: "", 231: None, 232: " "}
    table = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()] + [(None, prose(90), "en", None, 12)]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    labels = [(i, 1, int(i < 60 and i % 2 == 0)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    texts = [dict(rows)]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        texts.append({r.doc_id: r.text for r in docs.collect()})
    _, clean, single, cut, safe = texts
    toxic = {i for i in range(0, 60, 2)}
    assert not toxic & set(clean) and set(rows) - toxic <= set(clean)
    assert {200} == {200, 201, 202, 203} & set(single)
    assert set(clean) - set(single) == {201, 202, 203} & set(clean) and {230, 231, 232, None} <= set(single)
    assert set(cut) == set(single)
    assert passage[10:-10] not in cut[210] and passage[10:-10] not in cut[211]
    assert {i for i in single if cut[i] != single[i]} == {210, 211}
    assert set(cut) - set(safe) == {220}
    coded = pipeline.to_tokens(spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, r.decoded) for r in coded} == {(i, t or "") for i, t in safe.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in coded)


def test_empty_table(spark, tmp_path):
    schemas = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
               "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
