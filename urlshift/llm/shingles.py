"""Jaccard join on word n-grams by T-occurrence search.

A document's set are the hashes of its distinct n-grams of words. Documents with equal sets are one class. Two sets with
Jaccard similarity of at least ``least`` share one of the first ``n - ceil(least * n) + 1`` elements in any common order
(the prefix), so only classes that share a prefix element are compared. The order is by hash, with elements that many
documents of a batch hold put last, so that common passages bring few classes together.

Linking goes in rounds over the lists of classes that share a prefix element. In a round the smallest class of each list
is its pivot (in the next round another one in each list), and every other class asks, of the pivots it may be linked with, the one with
which it shares most elements. What is linked becomes one component; a list whose classes all lie in one component is done.
After ``PIVOT_ROUNDS`` rounds those pairs of classes are asked that still lie in different components and whose sizes,
and places of a shared prefix element, allow a link: all that linked sets share begins with the first element they share
in the order, so that one of them stands early enough in both sets. Of two sets the one whose prefix ends first in the order
shares no element of its prefix that is in no open list: the other one's prefix would hold that element, too. So texts with
long passages of their own meet few others. A group of m near copies costs about m questions a round, not m * m, and no
link between different components is lost.

Each class has a sketch: its elements are dealt by hash to ``PARITIES`` cells, of which each keeps whether it got an odd
number. A cell can only differ between two sets if an element that one of them lacks fell into it, so that the number of
cells that differ is at most the number of such elements. Pairs with more of them than a link allows are not linked and
not asked; the sketch never decides that two sets are linked. Texts are read for the classes of the other pairs alone.

Questions of one class are answered together by DivideSkip: the elements of the asking set that occur in most of the
asked sets form long lists, the others short ones. Short lists are merged by counting; only sets that reach the required
overlap less the number of long lists are probed for each long list by binary search; those that reach the required
overlap are linked.

Cases: letters A-Z are lower-cased, words are cut at 0x20 and 0x09-0x0D; fewer words than n make one n-gram; documents
without words (or with null text) have an empty set and link with nothing; a null id is never the smallest of a
component that has an id; repeated rows are in one component; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlshift.llm.common import WordHashes, batches, by_value, bytes_of, keep, mixed, offsets_of
from urlshift.llm.components import smallest_reachable

PIVOT_ROUNDS = 2
TEXT_BYTES = 8 << 20
PART_BYTES = 1 << 20  # of texts or prefixes worked on together where rows do not meet
COMMON = 4  # documents of a batch that hold an element: then it may come late in the order
LATE = 1 << 16  # elements that come late; which ones only changes the speed
SLOTS = 1 << 20  # bits of the filter on texts
BEFORE = ["before_a", "before_b"]
ASKED = 256  # classes that ask one pivot together
PARITIES = 512  # cells of a sketch, a power of two; about half of them differ between sets that have little in common


class Shingler:
    """Sets of texts as sorted arrays of 64-bit hashes."""

    def __init__(self, n: int):
        self.n = n
        self.hashed = WordHashes()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        # All windows of the batch at once; those that reach into the next text are left out.
        words, starts = self.hashed([text.lower() for text in texts])  # ASCII letters only
        grams = gram_hashes(words, self.n) if len(words) >= self.n else words[:0]
        sets = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            found = np.sort(grams[a : b - self.n + 1]) if b - a >= self.n else gram_hashes(words[a:b], b - a)
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
        return sets


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words: their hashes times odd numbers, added and mixed."""
    total = np.full(max(0, len(words) - size + 1) if size else 0, size, np.uint64)
    factor = 1
    for i in range(size):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        total += words[i : i + len(total)] * np.uint64(factor)
    return mixed(total)


def prefix_size(n: int, least: int) -> int:
    """Elements of which similar sets share one; ``least`` in hundredths."""
    return n - -(-least * n // 100) + 1


def sketches(elements: np.ndarray, sizes: list[int]) -> pa.StructArray:
    """Per set (of so many elements each, one behind the other) the parities of its cells, 64 to a number."""
    cell = (elements >> np.uint64(65 - PARITIES.bit_length())).astype(np.int64)
    cell += np.repeat(np.arange(len(sizes)) * PARITIES, sizes)
    odd = np.bincount(cell, minlength=len(sizes) * PARITIES) & 1
    numbers = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), len(CELLS))
    return pa.StructArray.from_arrays([pa.array(x) for x in numbers.T], CELLS)


CELLS = [f"s{i}" for i in range(PARITIES // 64)]
SKETCH = "struct<" + ", ".join(f"{c}: bigint" for c in CELLS) + ">"


def may_link(least: int) -> str:
    """Can sets of n and pivot_n elements with these sketches be linked? As SQL."""
    differ = " + ".join(f"bit_count(sketch.{c} ^ pivot_sketch.{c})" for c in CELLS)
    return f"{differ} <= n + pivot_n - 2 * ({needed_overlap(least)})"


def needed_overlap(least: int) -> str:
    """How many elements linked sets of n and pivot_n have in common at least. As SQL."""
    return f"({least} * (n + pivot_n) + {99 + least}) div {100 + least}"


def first_shared(least: int) -> str:
    """Can linked sets first share this element, at these places of theirs? As SQL.

    Sets with an equal one of ``BEFORE``, the smallest of the open elements before it (as numbers, and hashed one to one),
    share that one already and meet in its list.
    ``reach`` is the most a set can share from this place on with sets whose prefix ends later in the order.
    """
    most = "CASE WHEN last < pivot_last THEN least(reach, pivot_n - pivot_place) "
    most += "WHEN last > pivot_last THEN least(n - place, pivot_reach) ELSE least(n - place, pivot_n - pivot_place) END"
    return " AND ".join([f"{most} >= {needed_overlap(least)}", *(f"NOT coalesce({c} = pivot_{c}, false)" for c in BEFORE)])


def common_elements(docs: DataFrame, n: int) -> np.ndarray:
    """At most ``LATE`` elements that most documents hold, sorted. Counts cover all texts."""

    def run(stream):
        shingle = Shingler(n)
        for batch in batches(stream, TEXT_BYTES, 0):
            found, counts = np.unique(np.concatenate(shingle(bytes_of(batch.column(0)))), return_counts=True)
            often = counts >= COMMON
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[often].astype(np.uint64).view(np.int64)), pa.array(counts[often])], ["element", "n"]
            )

    counted = docs.select(docs["text"].cast("string")).mapInArrow(run, "element bigint, n bigint")
    top = counted.groupBy("element").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "element").limit(LATE)
    return np.sort(top.select("element").toArrow().column(0).to_numpy().view(np.uint64))


def document_sets(docs: DataFrame, n: int, least: int) -> DataFrame:
    """(doc_id, text_hash, n, class, prefix, last, sketch): size, identity, first elements and sketch of each document's set.

    ``last`` says where in the order the prefix ends; the lowest bit of the element is lost.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_elements(docs, n))

    def run(stream):
        shingle, late = Shingler(n), common.value
        for batch in batches(stream, PART_BYTES, 2):
            names, firsts, lasts, sizes = [], [], [], []
            sets = shingle(bytes_of(batch.column(2)))
            every = np.concatenate(sets) if sets else late[:0]
            at = np.searchsorted(late, every)
            isin = late[np.minimum(at, len(late) - 1)] == every if len(late) else np.zeros(len(every), bool)
            start = 0
            for elements in sets:
                is_late = isin[start : start + len(elements)]
                start += len(elements)
                names.append(int.from_bytes(xxhash.xxh3_64_digest(elements.tobytes()), "big", signed=True))
                ordered = np.concatenate((elements[~is_late], elements[is_late]))
                sizes.append(len(elements))
                first = ordered[: prefix_size(len(elements), least)]
                firsts.append(first.tobytes() if len(elements) else None)
                early = len(first) <= len(elements) - np.count_nonzero(is_late)
                lasts.append((int(first[-1]) >> 1) - (early << 63) if len(elements) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(firsts, pa.binary())]
            columns += [pa.array(lasts, pa.int64()), sketches(every, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].cast("string"))
    schema = f"doc_id {kind}, text_hash bigint, n bigint, class bigint, prefix binary, last bigint, sketch {SKETCH}"
    return rows.mapInArrow(run, schema)


NAMES = ["doc_id", "text_hash", "n", "class", "prefix", "last", "sketch"]


def shared_lists(sets: DataFrame) -> DataFrame:
    """(element, class, n, place) of prefix elements that two classes at least have; place: how many come before it."""
    classes = sets.where("prefix IS NOT NULL").groupBy("class").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"))

    def run(stream):
        for batch in batches(stream, PART_BYTES, 1):
            elements = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(e) for e in elements])
            of = pa.array(np.repeat(np.arange(len(elements)), sizes))
            place = np.arange(sizes.sum()) - np.repeat(offsets_of(sizes)[:-1], sizes)
            columns = [pa.array(np.concatenate(elements)), batch.column(0).take(of), batch.column(2).take(of)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place)], ["element", "class", "n", "place"])

    lists = classes.select("class", "prefix", "n").mapInArrow(run, "element bigint, class bigint, n bigint, place bigint")
    several = lists.groupBy("element").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    return keep(lists.join(several.select("element"), "element"), "lists")


def texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text): a text for each class, from a table (class, text_hash).

    A bitmap of fixed size goes to all tasks first, so that few other texts are shuffled to the exact join. That join is
    not a semi join, which Spark would move before the bitmap.
    """
    slot = F.pmod(F.xxhash64("text_hash", F.lit(7)), F.lit(SLOTS))
    cells = (
        classes.withColumn("slot", slot)
        .select(F.expr("slot div 64").alias("cell"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
    )
    rows = docs.select(F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("slot", slot).withColumn("cell", F.expr("slot div 64"))
    # SLOTS / 64 rows at most
    rows = rows.join(F.broadcast(cells), "cell").where("(shiftrightunsigned(bits, CAST(slot % 64 AS INT)) & 1) = 1")
    rows = rows.select("text_hash", "text").join(classes.select("class", "text_hash"), "text_hash")
    return rows.dropDuplicates(["text_hash", "class"]).select("class", "text")


def reaching(asked: np.ndarray, sets: list[np.ndarray], least: int) -> np.ndarray:
    """Which sets are linked with the asked one, by DivideSkip over the lists of the asked set's elements."""
    sizes = np.array([len(s) for s in sets], np.int64)
    needed = -(-least * (sizes + len(asked)) // (100 + least))
    at = [np.searchsorted(asked, s) for s in sets]
    at = [i[asked[np.minimum(i, len(asked) - 1)] == s] for i, s in zip(at, sets, strict=True)]
    of = np.repeat(np.arange(len(sets)), [len(i) for i in at])
    place = np.concatenate(at)
    lengths = np.bincount(place, minlength=len(asked))
    ends = offsets_of(lengths)
    lists = of[np.argsort(place, kind="stable")]  # members of each list in ascending order
    # Long lists: the longest ones, fewer than the smallest overlap that is needed, held by half of the sets or more.
    longest = np.argsort(-lengths, kind="stable")[: max(0, int(needed.min()) - 1)]
    longest = longest[lengths[longest] * 2 >= len(sets)]
    is_long = np.zeros(len(asked), bool)
    is_long[longest] = True
    counts = np.bincount(of[~is_long[place]], minlength=len(sets))
    hopeful = np.flatnonzero(counts >= needed - len(longest))
    for which in longest.tolist():
        members = lists[ends[which] : ends[which + 1]]
        i = np.minimum(np.searchsorted(members, hopeful), len(members) - 1)
        counts[hopeful] += members[i] == hopeful
    return hopeful[counts[hopeful] >= needed[hopeful]]


def answers(questions: DataFrame, docs: DataFrame, classes: DataFrame, n: int, least: int) -> DataFrame:
    """(class, pivot) of the questions whose sets are linked. A pivot's questions are dealt out over several tasks.

    ``classes`` has the hash of a text of each class.
    """
    groups = questions.groupBy("pivot").agg(F.count(F.lit(1)).alias("many"))
    dealt = questions.join(groups, "pivot").select(
        "class", "pivot", F.expr(f"pmod(xxhash64(class, 3), ceil(many / {ASKED}))").alias("part")
    )
    dealt = keep(dealt, "questions")
    pivots = dealt.select("pivot", "part").distinct().select(F.col("pivot").alias("class"), "pivot", "part")
    both = dealt.select("class", "pivot", "part").union(pivots)
    asked = keep(classes.select("class", "text_hash").join(both.select("class").distinct(), "class"), "asked")
    # Several pivots that get few questions are answered together.
    several = max(1, -(-dealt.count() // ASKED))
    rows = both.join(texts_of(docs, asked), "class").withColumn("deal", F.expr(f"pmod(xxhash64(pivot, part), {several})"))

    def run(table: pa.Table) -> pa.Table:
        ids, pivot, part = (table.column(c).to_numpy() for c in ("class", "pivot", "part"))
        shingle, sets = Shingler(n), []
        for batch in batches(table.select(["text"]).combine_chunks().to_batches(), PART_BYTES, 0):
            sets += shingle(bytes_of(batch.column(0)))
        linked = [np.zeros(0, np.int64)]
        order = np.lexsort((part, pivot))
        new = (np.diff(pivot[order]) != 0) | (np.diff(part[order]) != 0)
        for rows in np.split(order, np.flatnonzero(new) + 1):
            others = rows[ids[rows] != pivot[rows]]
            if len(others):
                own = int(rows[ids[rows] == pivot[rows]][0])
                linked.append(others[reaching(sets[own], [sets[i] for i in others], least)])
        linked = np.concatenate(linked)
        return pa.table({"class": ids[linked], "pivot": pivot[linked]})

    return rows.groupBy("deal").applyInArrow(run, "class bigint, pivot bigint")


def jaccard_components(docs: DataFrame, n: int = 5, least: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    ``least`` is the similarity in hundredths: 100 * intersection >= least * union.
    """
    sets = keep(document_sets(docs, n, least), "sets")
    lists = shared_lists(sets)
    in_lists = lists.select("class").distinct()
    first = F.min_by(F.struct("text_hash", "last", "sketch"), "text_hash").alias("one")
    classes = sets.join(in_lists, "class", "left_semi").groupBy("class").agg(first).select("class", "one.*")
    classes = keep(classes, "classes")
    sketch = classes.select("class", "sketch")
    pivot_sketch = classes.select(F.col("class").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
    open_lists, links = lists.withColumn("part_of", F.col("class")), None
    components = None
    for number in range(PIVOT_ROUNDS + 1):
        if number < PIVOT_ROUNDS:
            order = F.xxhash64("class", "element") if number % 2 else F.col("class")
            pick = F.min_by(F.struct("class", "part_of", "n"), F.struct(order, "class"))
            asked = open_lists.join(open_lists.groupBy("element").agg(pick.alias("p")), "element")
            pairs = asked.select("class", "part_of", "n", F.col("p.class").alias("pivot"),
                                 F.col("p.part_of").alias("pivot_part"), F.col("p.n").alias("pivot_n"))
        else:
            # Sketches go with the lists, so that a list doesn't become all pairs of its classes.
            after = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("place")))  # open elements from here on
            reach = after + F.expr(f"({least} * n + 99) div 100 - 1")  # and all behind the prefix
            before = {c: F.min(h).over(Window.partitionBy("class").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
                      for c, h in zip(BEFORE, (F.col("element"), F.xxhash64("element")), strict=True)}
            sketched = open_lists.withColumns({"reach": reach, **before}).join(classes.select("class", "last", "sketch"), "class")
            others = sketched.select("element", F.col("class").alias("pivot"), F.col("part_of").alias("pivot_part"),
                                     *(F.col(c).alias(f"pivot_{c}") for c in ("n", "place", "reach", "last", "sketch", *BEFORE)))
            pairs = sketched.join(others, "element").where(f"class < pivot AND {first_shared(least)} AND {may_link(least)}")
        allowed = f"part_of <> pivot_part AND 100 * least(n, pivot_n) >= {least} * greatest(n, pivot_n)"
        pairs = pairs.where(allowed)
        if number < PIVOT_ROUNDS:  # each class asks, of the pivots it may be linked with, the one with which it shares most
            pairs = pairs.groupBy("class", "pivot").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"),
                                                        F.first("pivot_n").alias("pivot_n"))
            pairs = pairs.join(sketch, "class").join(pivot_sketch, "pivot").where(may_link(least))
            best = F.max_by("pivot", F.struct("shared", F.expr("-pivot"))).alias("pivot")
            pairs = pairs.groupBy("class").agg(best)
        found = answers(pairs.select("class", "pivot").distinct(), docs, classes, n, least)
        links = keep(found if links is None else found.union(links), "links")
        components = keep(smallest_reachable(links), "components")
        if number == PIVOT_ROUNDS:
            break
        open_lists = (
            lists.join(components.withColumnRenamed("id", "class"), "class", "left")
            .select("element", "class", "n", "place", F.coalesce("component", "class").alias("part_of"))
        )
        several = open_lists.groupBy("element").agg(F.min("part_of").alias("a"), F.max("part_of").alias("b")).where("a < b")
        open_lists = keep(open_lists.join(several.select("element"), "element"), "lists")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "class", "text_hash")
    # A document without words is in no class; all rows of a class are linked with each other.
    part = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class"))
    rows = rows.join(components.withColumnRenamed("id", "class"), "class", "left").withColumn("part", part)
    smallest = rows.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "part", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


by_value(__name__)
