"""Personal data found by shape, and terms that give it away found by information theory.

Addresses, numbers and cards are found by patterns; their values are the protected entities. A term reveals an entity
as far as seeing it tells that the entity is there: the pointwise mutual information of both over the corpus, divided by
the information of the entity itself (1: the term is only ever found with it). Terms near an entity (``WINDOW`` words)
are candidates. Those that reveal at least ``DISCLOSES`` of some entity are sanitised wherever they stand: a
capitalised one is generalised to a placeholder, any other is removed.

Counts are documents, over the whole corpus. Copies are no evidence: texts are grouped by the least hash of their word
triples, which near copies mostly share, and the inverse Simpson number of these sources must reach ``SOURCES``.

Spans follow from the text alone, so rows find those of their text by its 64-bit hash. Null texts are empty; empty texts have no
spans; repeated rows and ids count and come back each; of an empty table nothing comes back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import by_value, keep

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 8  # words on each side of an entity
DISCLOSES = 0.95
SOURCES = 2.5
JOINT = 3  # documents with both at least
FLUSH = 300_000  # words counted by a task before the counts are handed on
BITS = 27  # of the bitmap of revealing terms, 16 MB whatever the corpus

# The patterns of the contract, with no way back where the next character already decides.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{4,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each ``@`` with all that may stand before it, and at least one dot behind."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            done = match.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; places in code points."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [(1, *m.span()) for m in IP.finditer(text) if _small_parts(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return spans


def entity(kind: int, text: str) -> str:
    """An entity is a kind and a value: letters in lower case, numbers by their digits."""
    return f"{kind}:{text.lower() if kind < 2 else _digits(text)}"


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def source(text: str) -> int:
    """The least hash of the text's word triples: the same for most near copies."""
    words = text.split()
    return min((hashed(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of the words that touch no span."""
    taken = sorted((a, b) for _, a, b in spans)
    out, at, reach = [], 0, -1
    for m in WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if m.start() >= reach:
            out.append(m.span())
    return out


def companions(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """(entity, term) hashes of the terms near each entity of a text."""
    words = free_words(text, spans)
    starts = np.array([a for a, _ in words], np.int64)
    found = set()
    for kind, a, b in spans:
        at = int(np.searchsorted(starts, a))
        own = hashed(entity(kind, text[a:b]))
        found.update((own, hashed(text[x:y].lower())) for x, y in words[max(0, at - WINDOW) : at + WINDOW])
    return found


SCAN = "what tinyint, id {}, text_key bigint, numbers array<bigint>, base string, entity bigint, term bigint, source bigint, n bigint"
DOCUMENT, PAIR, COUNT = 0, 1, 2
SCANNED = ["what", "id", "text_key", "numbers", "base", "entity", "term", "source", "n"]


def _rows(what: int, size: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    types = [pa.int8(), id_type, pa.int64(), pa.list_(pa.int64()), pa.string(), *[pa.int64()] * 4]
    arrays = [pa.array([what] * size, pa.int8())]
    for name, kind in zip(SCANNED[1:], types[1:], strict=True):
        values = columns.get(name)
        arrays.append(pa.nulls(size, kind) if values is None else values if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, SCANNED)


def written(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _counts(counts: Counter, id_type: pa.DataType) -> pa.RecordBatch:
    return _rows(COUNT, len(counts), id_type, term=list(counts), n=list(counts.values()))


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One pass over the texts: a row for each document, its pairs of entity and term, and counts of words and entities.

    ``what`` tells these apart. Counts are partial sums of a task.
    """
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known: dict[str, int] = {}
        id_type = None
        for batch in stream:
            id_type = batch.schema.field(0).type
            numbers, base, pairs = [], [], []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = base_spans(text)
                of = Counter(k for k, _, _ in spans)
                numbers.append([of[k] for k in range(len(KINDS))])
                base.append(written(spans))
                seen = {w.lower() for w in set(WORD.findall(text))}
                for w in seen:
                    if w not in known:
                        known[w] = hashed(w)
                counts.update(map(known.__getitem__, seen))
                if spans:
                    counts.update({hashed(entity(k, text[a:b])) for k, a, b in spans})
                    near = source(text)
                    pairs += [(key, *pair, near) for pair in companions(text, spans)]
                if len(known) > FLUSH or len(counts) > FLUSH:
                    yield _counts(counts, id_type)
                    counts, known = Counter(), {}
            yield _rows(DOCUMENT, batch.num_rows, id_type, id=batch.column(0), text_key=batch.column(1), numbers=numbers, base=base)
            if pairs:
                key, own, term, near = map(list, zip(*pairs, strict=True))
                yield _rows(PAIR, len(pairs), id_type, text_key=key, entity=own, term=term, source=near, n=[1] * len(pairs))
        if counts:
            yield _counts(counts, id_type)

    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, SCAN.format(docs.schema[id_column].dataType.simpleString()))


def revealing_terms(scan: DataFrame) -> DataFrame:
    """(term, disclosure): hashes of the terms that reveal enough of some entity, from the written result of ``scanned``."""
    pairs = scan.where(F.col("what") == PAIR)
    texts = pairs.groupBy("entity", "term", "source", "text_key").agg(F.sum("n").alias("n"))
    sources = texts.groupBy("entity", "term", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    texts_squared = F.sum(F.col("texts") * F.col("texts"))
    joint = sources.groupBy("entity", "term").agg(
        F.sum("n").alias("joint"), (F.sum("texts") * F.sum("texts") / texts_squared).alias("sources")
    )
    joint = keep(joint.where((F.col("joint") >= JOINT) & (F.col("sources") >= SOURCES)), "joint")
    asked = joint.select("term").union(joint.select("entity")).distinct()
    # Only the counts that are asked for are added up.
    counts = scan.where(F.col("what") == COUNT).select("term", "n").join(asked, "term", "left_semi")
    counts = keep(counts.groupBy("term").agg(F.sum("n").alias("n")), "counts")
    total = scan.where(F.col("what") == DOCUMENT).agg(F.count(F.lit(1)).alias("total")).scalar()
    of_term = counts.select("term", F.col("n").alias("n_term"))
    of_entity = counts.select(F.col("term").alias("entity"), F.col("n").alias("n_entity"))
    known = joint.join(of_term, "term").join(of_entity, "entity").withColumn("total", total)
    mutual = F.log2(F.col("joint") * F.col("total") / (F.col("n_term") * F.col("n_entity")))
    own = F.log2(F.col("total") / F.col("n_entity"))
    # An entity that stands everywhere tells nothing and cannot be revealed.
    share = F.when(own > 0, mutual / own)
    return known.groupBy("term").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= DISCLOSES)


def _bitmap(terms: DataFrame) -> list[bytes | None]:
    """Bits of the terms' hashes in pieces of 32,768 (4 KB each); as large for any number of terms."""
    bit = F.pmod("term", F.lit(1 << BITS))
    pieces = terms.groupBy(F.shiftright(bit, 15).alias("piece")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")
    )
    out: list[bytes | None] = [None] * (1 << (BITS - 15))
    for row in pieces.collect():  # at most 4,096 rows
        out[row.piece] = bytes(row.bits)
    return out


def term_spans(docs: DataFrame, terms: DataFrame, text_column: str = "text") -> DataFrame:
    """(text_key, terms): places (start, end, hash) of the revealing terms of each text that holds some, by start.

    A bitmap of fixed size picks the words that may be such terms; a join on the hash decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        known: dict[str, int | None] = {}

        def maybe(word: str) -> int | None:
            number = hashed(word.lower())
            bit = number % (1 << BITS)
            piece = pieces[bit >> 15]
            return number if piece and piece[(bit & 32767) >> 3] >> (bit & 7) & 1 else None

        for batch in stream:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(text))
                if len(known) > FLUSH:
                    known.clear()
                known.update((w, maybe(w)) for w in words if w not in known)
                if any(known[w] is not None for w in words):
                    places = free_words(text, base_spans(text))
                    rows += [(key, known[text[a:b]], a, b) for a, b in places if known.get(text[a:b]) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["text_key", "term", "start", "end"])

    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    hits = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(
        run, "text_key bigint, term bigint, start bigint, end bigint"
    )
    sure = hits.dropDuplicates(["text_key", "start"]).join(terms.select("term"), "term", "left_semi")
    return sure.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "term"))).alias("terms"))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of each document: (id, text_key, n_email, n_ip, n_card, n_phone, base, terms).

    ``base`` lists kind:start:end of the patterns' spans, ``terms`` the places of revealing terms (start, end, hash).
    """
    scan = keep(scanned(docs, id_column, text_column), "scan")
    found = term_spans(docs, keep(revealing_terms(scan), "terms"), text_column)
    rows = scan.where(F.col("what") == DOCUMENT).select(
        F.col("id").alias(id_column), "text_key", *(F.col("numbers")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)), "base"
    )
    return rows.join(found, "text_key", "left").select(*rows.columns, "terms")


def all_spans(base: str = "base", terms: str = "terms") -> Column:
    """All spans as one text: those of the patterns, then the terms."""
    texts = F.transform(terms, lambda s: F.concat_ws(":", F.lit(TERM), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.filter(F.concat(F.array(base), F.coalesce(texts, F.array().cast("array<string>"))), lambda s: s != ""), ",")


def cleaned(text: str, spans: str) -> str:
    """A text with its entities named by their kind, capitalised terms generalised and other terms removed."""
    out, at = [], 0
    cuts = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b, kind in cuts:
        if a < at:  # of overlapping spans the rest of the later one goes with the earlier
            at = max(at, b)
            continue
        out.append(text[at:a])
        if kind != TERM:
            out.append(f"[{kind}]")
        elif text[a].isupper():
            out.append("[name]")
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The table with its text sanitised; all other columns stay."""
    found = personal_data(docs, id_column, text_column).select("text_key", all_spans().alias("__spans")).where("__spans != ''")
    found = found.dropDuplicates(["text_key"]).withColumnRenamed("text_key", "__text_key")
    joined = docs.withColumn("__text_key", F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit("")))).join(found, "__text_key", "left")

    def rewrite(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None else cleaned(t, s))

    done = F.pandas_udf(rewrite, "string")(F.col(text_column).cast("string"), F.col("__spans"))
    changed = F.when(F.col("__spans").isNotNull(), done).otherwise(F.col(text_column))
    return joined.withColumn(text_column, changed).select(*docs.columns)


by_value(__name__)
