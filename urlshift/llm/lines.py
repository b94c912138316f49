"""Substring dedup by line and sentence: the earliest occurrence of each unit of the corpus stays, all later ones go.

Texts are cut at line feeds, and lines behind each ``.``, ``!`` or ``?`` that white space follows; the white space goes
with the sentence before it. Every line is a unit; so is, in lines of several sentences, every sentence of at least
``sentence`` normalised bytes, so that passages inside long lines are found and short phrases are left alone. A unit is
normalised (letters A-Z in lower case, runs of white space to one space, trimmed) and digested; per digest the smallest
rank (id, hash of the text, place) is found, pre-aggregated in each task, so that a line that stands in every document
costs a row a batch. Winners are then gathered by document, never by unit. A line and a sentence that read alike are the
same unit. Equal lines hold equal sentences, so a sentence's earliest occurrence never goes with a lost line. Offsets
are in characters of the input text.

Cases: a null or empty text has nothing to remove and stays as it is; lines with less than ``least`` normalised bytes
(blank ones) always stay; null ids rank first; rows with the same id are ranked by the hash of their texts, and equal
rows count as one document; an empty table gives an empty one; other columns are left out. A line that loses all its
sentences but not itself stays as an empty line.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import batches, by_value

LEAST = 1
SENTENCE = 100
SENTENCE_END = re.compile(r"([.!?][ \t\r\f\v]+)")
TEXT_BYTES = 16 << 20


def normalised(line: str) -> bytes:
    return b" ".join(line.encode().lower().split())


def sentences(line: str) -> list[str]:
    """The line cut behind its sentence ends; a line holds no line feed, so that one can mark the cuts."""
    return SENTENCE_END.sub("\\1\n", line).split("\n")


def units(text: str | None, least: int, sentence: int):
    """(line, its unit, sentences, their units) for each line; the unit of what always stays is None."""
    for line in (text or "").split("\n"):
        plain, parts = normalised(line), sentences(line)
        plains = [normalised(p) for p in parts]
        several = sum(map(bool, plains)) > 1
        pieces = [p if several and p and len(p) >= sentence else None for p in plains]
        yield line, plain if len(plain) >= least else None, parts, pieces


def text_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) >> 1


def unit_ranks(docs: DataFrame, least: int = LEAST, sentence: int = SENTENCE) -> DataFrame:
    """(unit, doc_id, text_hash, place): the smallest rank of each unit's digest within a batch of texts.

    Places count a line and then its sentences, through the whole text.
    """

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            ids, best = batch.column(0), {}

            texts = batch.column(1).to_pylist()
            hashes = [text_hash(t) for t in texts]
            known = ids.to_pylist()
            order = sorted(range(len(texts)), key=lambda i: (known[i] is not None, known[i] or 0, hashes[i]))
            for i in order:
                place = 0
                for _, plain, _, pieces in units(texts[i], least, sentence):
                    for unit in (plain, *pieces):
                        if unit is not None:
                            best.setdefault(xxhash.xxh3_128_digest(unit), (i, place))
                        place += 1
            rows = [i for i, _ in best.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(best), pa.binary()), ids.take(pa.array(rows, pa.int64())),
                    pa.array([hashes[i] for i in rows], pa.int64()), pa.array([p for _, p in best.values()], pa.int32()),
                ],
                ["unit", "doc_id", "text_hash", "place"],
            )

    texts = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return texts.mapInArrow(run, "unit binary, doc_id bigint, text_hash bigint, place int")


def cut(text: str | None, kept: list[int] | None, least: int, sentence: int):
    """The text without the units that lost, its number of lines, the spans of lost and kept pieces, characters lost."""
    if not text:
        return text, 0, [], [], 0
    stay, at, place, n, left, lost, held = set(kept or ()), 0, 0, 0, [], [], []
    for line, plain, parts, pieces in units(text, least, sentence):
        n += 1
        if plain is not None and place not in stay:
            lost.append({"start": at, "end": at + len(line)})
        else:
            left.append("")
            low = at
            for i, (part, unit) in enumerate(zip(parts, pieces, strict=True), place + 1):
                gone = unit is not None and i not in stay
                (lost if gone else held).append({"start": low, "end": low + len(part)})
                left[-1] += "" if gone else part
                low += len(part)
        at += len(line) + 1
        place += 1 + len(pieces)
    return "\n".join(left), n, lost, merged(held), sum(s["end"] - s["start"] for s in lost)


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, those that touch as one."""
    out: list[dict] = []
    for span in spans:
        if out and out[-1]["end"] == span["start"]:
            out[-1]["end"] = span["end"]
        else:
            out.append(dict(span))
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST, sentence: int = SENTENCE) -> DataFrame:
    """Per row: doc_id, text (what stays), n_lines, n_removed (characters), removed and kept (spans: start, end)."""
    winners = (
        unit_ranks(docs, least, sentence)
        .groupBy("unit")
        .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash", "place")).alias("first"))
        .groupBy(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("text_hash"))
        .agg(F.collect_list("first.place").alias("places"))
    )

    def hashed(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            hashes = pa.array([text_hash(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], ["doc_id", "text", "own_hash"])

    texts = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    texts = texts.mapInArrow(hashed, "doc_id bigint, text string, own_hash bigint")
    same = texts["doc_id"].eqNullSafe(winners["id"]) & (texts["own_hash"] == winners["text_hash"])

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            done = [cut(t, p, least, sentence) for t, p in pairs]
            text, n, lost, held, size = map(list, zip(*done, strict=True))
            columns = [pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(size, pa.int64())]
            columns += [pa.array(lost, SPANS), pa.array(held, SPANS)]
            names = ["doc_id", "text", "n_lines", "n_removed", "removed", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    spans = "array<struct<start: int, end: int>>"
    return texts.join(winners, same, "left").select("doc_id", "text", "places").mapInArrow(
        run, f"doc_id bigint, text string, n_lines int, n_removed bigint, removed {spans}, kept {spans}"
    )


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

SQL = """WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text <> ''),
cut AS (
  SELECT doc_id, i, line, string_split(regexp_replace(line, '([.!?][ \\t\\r\\f\\v]+)', '\\1' || chr(10), 'g'), chr(10)) AS parts
  FROM lines),
pieces AS (
  SELECT doc_id, i, 0 AS j, line AS piece, true AS counts FROM cut
  UNION ALL
  SELECT doc_id, i, unnest(generate_series(1, len(parts))), unnest(parts),
    len(list_filter(parts, lambda x: regexp_matches(x, '[^ \\t\\r\\f\\v]'))) > 1 FROM cut),
plain AS (
  SELECT *, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\t\\v\\f\\r ]+', ' ', 'g')) AS unit FROM pieces),
marked AS (
  SELECT doc_id, i, j, piece, counts AND unit <> '' AND (j = 0 OR strlen(unit) >= 100) AS is_unit, unit FROM plain),
ranked AS (
  SELECT *, is_unit AND row_number() OVER (PARTITION BY is_unit, unit ORDER BY doc_id, i, j) > 1 AS lost FROM marked),
placed AS (
  SELECT *, max(lost AND j = 0) OVER (PARTITION BY doc_id, i) AS line_lost,
    coalesce(sum(length(piece)) FILTER (j > 0) OVER (PARTITION BY doc_id ORDER BY i, j
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + i - 1 AS start
  FROM ranked),
rows_cut AS (
  SELECT doc_id, i, line_lost, string_agg(piece, '' ORDER BY j) FILTER (j > 0 AND NOT lost) AS stays FROM placed GROUP BY 1, 2, 3),
texts AS (
  SELECT doc_id, count(*) AS n_lines, string_agg(coalesce(stays, ''), chr(10) ORDER BY i) FILTER (NOT line_lost) AS text
  FROM rows_cut GROUP BY doc_id),
gone AS (
  SELECT doc_id, sum(length(piece)) AS n_removed,
    string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(piece) AS BIGINT), ',' ORDER BY i, j) AS removed
  FROM placed WHERE lost AND (j = 0 OR NOT line_lost) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(removed, '') AS removed, sha256(coalesce(texts.text, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN gone USING (doc_id)"""


by_value(__name__)
