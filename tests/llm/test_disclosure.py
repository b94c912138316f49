"""Patterns against plain regular expressions, terms against counting."""

import math
import random
import re
from collections import defaultdict

import pytest

from urlshift.llm import disclosure

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if fits(k, m.group())]


def test_patterns():
    some = random.Random(5)
    parts = ["a", "b.", "@", "@x.y", "1", "25", "256", ".", "+", "+1", " ", "-", "(", ")", "4539578763621486", "4539 5787-6362 1486", "é", "..", "1.2.3.4",
             "0001.02.3.4", "%", "_", "\n", "+1 (017) 555-7713", "x.34@mail7.example.com"]
    for _ in range(20_000):
        text = "".join(some.choice(parts) for _ in range(some.randint(0, 14)))
        assert disclosure.base_spans(text) == plain_spans(text), text


def test_patterns_take_linear_time():
    for part in ("a", "1", "1.", "+", "+1", "1 ", "@", "a@", "@a.", "-"):
        disclosure.base_spans(part * 300_000)


def corpus():
    some = random.Random(11)
    filler = ["".join(some.choice("bcdfgklmnprst") + some.choice("aeiou") for _ in range(4)) for _ in range(60)]
    words = lambda n: " ".join(some.choice(filler) for _ in range(n))
    rows = []
    for i in range(400):
        rows.append((i, words(60)))
    for i in range(400, 408):  # a name that stands with one address, and once without
        rows.append((i, f"{words(40)} ask Zanzibara or zanzibara at zoe@mail.example.org today {words(40)}"))
    rows.append((408, f"{words(20)} Zanzibara {words(20)}"))
    near = words(200)
    for i in range(409, 429):  # near copies: their rare word is no evidence
        rows.append((i, f"{near} quixotical +1 (377) 555-0271 {near} tail{i}"))
    rows += [(i, "Copyword copy@mail.example.org " + near) for i in range(429, 439)]
    rows += [(None, None), (500, ""), (500, ""), (501, "1.2.3.4")]
    return rows


def plain_terms(rows):
    """Shares of disclosure of all candidates."""
    rows = [t or "" for _, t in rows]
    joint, source_of, with_term, with_entity = defaultdict(list), {}, defaultdict(int), defaultdict(int)
    for text in rows:
        spans = plain_spans(text)
        masked = list(text)
        for _, a, b in spans:
            masked[a:b] = "0" * (b - a)
        masked = "".join(masked)
        for w in {w.lower() for w in re.findall(r"[^\W\d_]{4,}", text)}:
            with_term[w] += 1
        pairs = set()
        for k, a, b in spans:
            e = disclosure.entity(k, text[a:b])
            before = re.findall(r"[^\W\d_]{4,}", masked[:a])[-8:]
            behind = re.findall(r"[^\W\d_]{4,}", masked[b:])[:8]
            pairs |= {(e, w.lower()) for w in before + behind}
        for e in {disclosure.entity(k, text[a:b]) for k, a, b in spans}:
            with_entity[e] += 1
        for p in pairs:
            joint[p].append((disclosure.source(text), text))
    shares = defaultdict(float)
    for (e, w), texts in joint.items():
        sizes = defaultdict(set)
        for source, text in texts:
            sizes[source].add(text)
        sizes = [len(s) for s in sizes.values()]
        own = math.log2(len(rows) / with_entity[e])
        if len(texts) >= 3 and sum(sizes) ** 2 / sum(s * s for s in sizes) >= 2.5 and own:
            shares[w] = max(shares[w], math.log2(len(texts) * len(rows) / with_term[w] / with_entity[e]) / own)
    return {w for w, s in shares.items() if s >= disclosure.DISCLOSES}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in corpus()], "doc_id bigint, text string, base string, term int").repartition(5)


def test_terms_against_counting(docs):
    rows = corpus()
    terms = plain_terms(rows)
    assert "zanzibara" in terms and "quixotical" not in terms and "copyword" not in terms
    wanted = []
    for i, text in rows:
        text = text or ""
        base = plain_spans(text)
        found = [m.span() for m in re.finditer(r"[^\W\d_]{4,}", text) if m.group().lower() in terms]
        found = [(a, b) for a, b in found if not any(a < y and x < b for _, x, y in base)]
        spans = [f"{disclosure.KINDS[k]}:{a}:{b}" for k, a, b in base] + [f"term:{a}:{b}" for a, b in found]
        wanted.append((i, *(sum(k == n for n, _, _ in base) for k in range(4)), disclosure.written(base), ",".join(spans)))
    table = disclosure.personal_data(docs)
    got = table.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", disclosure.all_spans()).collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(wanted, key=order)


def test_sanitised_texts(docs):
    done = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    assert len(done) == len({i for i, _ in corpus()}) and done[1].base == "x"
    assert "ask [name] or  at [email]  " in done[400].text
    assert " [name] " in done[408].text and done[501].text == "[ip]" and done[None].text is None
    assert done[5].text == dict(corpus())[5]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert disclosure.personal_data(empty).collect() == []
