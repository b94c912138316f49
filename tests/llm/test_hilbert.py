"""Sharding against a brute-force curve and brute-force runs."""

import zlib
from collections import Counter

import pytest

from urlshift.llm import hilbert

SCHEMA = "doc_id bigint, text string, lang string, source string, __x0 string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "own") for row in rows], SCHEMA)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (2, 1), (1, 4)])
def test_curve_visits_each_cell_once_in_unit_steps(spark, dims, bits):
    side = 1 << bits
    cells = [[]]
    for _ in range(dims):
        cells = [[*c, x] for c in cells for x in range(side)]
    frame = spark.createDataFrame([tuple(c) for c in cells], ", ".join(f"c{i} bigint" for i in range(dims)))
    rows = hilbert.with_curve_index(frame, [frame[f"c{i}"] for i in range(dims)], "curve", bits).collect()
    by_index = {r.curve: [r[f"c{i}"] for i in range(dims)] for r in rows}
    assert sorted(by_index) == list(range(side**dims))
    for k in range(1, side**dims):
        assert sum(abs(a - b) for a, b in zip(by_index[k], by_index[k - 1], strict=True)) == 1


def test_runs(spark):
    texts = [None, "", "same", "same", "same", "ß" * 5000, "a", "b", "c", "d", "e"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(texts)] + [(None, "same", None, None)] * 2
    got = hilbert.hilbert_shards(table(spark, rows), shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    counts = Counter(r.shard for r in got)
    assert set(counts) == {0, 1, 2, 3} and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_fewer_rows_than_shards_and_none(spark):
    got = hilbert.hilbert_shards(table(spark, [(1, "x", "en", "s")]), shards=40).collect()
    assert [(r.shard, r.slot) for r in got] == [(0, 0)]
    assert hilbert.hilbert_shards(table(spark, []), shards=40).collect() == []


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i % 5, f"t{i % 3}", "en", "s") for i in range(30)]
    hilbert.write_shards(table(spark, rows), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((a, b) for a, b, _, _ in rows)
    assert {r.shard for r in back.collect()} == {0, 1, 2}
