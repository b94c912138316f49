"""Line dedup against a dictionary."""

import random
import re
import string

import pytest

from urlshift.llm import lines


def plain(text):
    return " ".join(re.split(r"[ \t\r\f\v]+", text.strip(" \t\r\f\v").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def occurrences(text, sentence):
    """(line, start, end, unit) of all units; the line itself comes first."""
    at = 0
    for number, line in enumerate((text or "").split("\n")):
        found = [m.span() for m in re.finditer(r".*?(?:[.!?][ \t\r\f\v]+|$)", line)]
        if plain(line):
            yield number, at, at + len(line), plain(line), True
        if sum(plain(line[a:b]) != "" for a, b in found) > 1:
            for a, b in found:
                if len(plain(line[a:b]).encode()) >= sentence and plain(line[a:b]):
                    yield number, at + a, at + b, plain(line[a:b]), False
        at += len(line) + 1


def brute(rows, sentence):
    first = {}
    for row in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, lines.text_hash(r[1]))):
        for number, start, _, unit, is_line in occurrences(row[1], sentence):
            first.setdefault(unit, (row, start, is_line))
    out = []
    for row in rows:
        lost = [(n, a, b, is_line) for n, a, b, unit, is_line in occurrences(row[1], sentence) if first[unit] != (row, a, is_line)]
        whole = {n for n, _, _, is_line in lost if is_line}
        lost = [(a, b, is_line) for n, a, b, is_line in lost if is_line or n not in whole]
        left, at = [], 0
        for number, line in enumerate((row[1] or "").split("\n")):
            if number not in whole:
                left.append("".join(c for i, c in enumerate(line, at) if not any(a <= i < b for a, b, _ in lost)))
            at += len(line) + 1
        out.append((row[0], "\n".join(left) if row[1] else row[1], [(a, b) for a, b, _ in lost]))
    return out


@pytest.mark.parametrize("sentence", [4, 100])
def test_units(spark, monkeypatch, sentence):
    monkeypatch.setattr(lines, "TEXT_BYTES", 100)
    some = random.Random(3)
    parts = ["one.", "Two!", "two! ", "ünï é?", "", " ", "three  four. ", "Three four.\t", "x" * 400, "v1.2 no end", ". "]

    def line():
        return " ".join(some.choice(parts) for _ in range(some.choice([1, 1, 2, 3])))

    rows = [(i, "\n".join(line() for _ in range(some.randint(1, 9)))) for i in range(60)]
    rows += [(4, "one\nnew"), (4, "one\nnew"), (None, "one\nnull id"), (70, None), (71, ""), (72, "\n\n"), (73, "last\n" * 50)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, unit string, place int")
    found = lines.dedup_lines(docs, sentence=sentence).collect()
    got = [(r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in found]
    assert sorted(got, key=repr) == sorted(brute(rows, sentence), key=repr)
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in found)


def test_passage_inside_long_lines(spark):
    passage = "The passage goes on for a long while, over more than a hundred bytes, and is told again in other places. "
    rows = [(1, f"Some start. {passage}Some end. Short."), (2, f"Another start? {passage}Another end. Short."), (3, passage.strip())]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Another start? Another end. Short.", 3: ""}


def test_white_space_and_spans(spark):
    docs = spark.createDataFrame([(2, "A \t b\nkeep é\nz"), (1, "a b"), (3, "KEEP  é\r\n")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[2].text == "keep é\nz" and got[3].text == "" and got[1].text == "a b"
    assert [tuple(s) for s in got[2].removed] == [(0, 5)] and [tuple(s) for s in got[2].kept] == [(6, 12), (13, 14)]


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
