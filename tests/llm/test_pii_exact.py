"""Personal data: stretches against whole texts, and the rules against the patterns as they stand."""

import random
import re
from datetime import date

import pytest

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        double = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and double % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m[0]))


@pytest.mark.parametrize("letters, length", [("ab1.@-+ %", 30), ("0125.. -", 40), ("0123456789 -", 60), ("+12345()-. ", 50), ("0Ⅷ٣.+1-é@a ", 40)])
def test_rules_are_the_patterns(letters, length):
    r = random.Random(letters)
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, length)))
        assert pii.base_spans(t) == brute(t), t


def test_stretches_give_the_labels_of_whole_texts():
    field, r = pii.trained(), random.Random(3)
    assert field.quiet
    odd = ["at", "dot", "AT", "(at)", "[dot]", "3.5", "joe", "mail", "+1", "(234)", "567-8901", "1.2.3.4", "[8.8.8.8]", "x@y.zz", "4111", "com", str(date(2020, 1, 1)), "at,", "beat", "h" * 81]
    labelled = 0
    for _ in range(600):
        share, n = r.choice([0.02, 0.1, 0.4]), r.randint(0, 60)
        text = " ".join(r.choice(odd) if r.random() < share else r.choice(["word", "alpha", "Beta,", "é"]) for _ in range(n))
        words = [m.span() for m in pii.WORD.finditer(text)]
        want = field.viterbi([field.scores([text[a:b] for a, b in words])])[0].tolist() if words else []
        got = [0] * len(words)
        for lo, hi in field.stretches(len(words), [i for i, (a, b) in enumerate(words) if pii.describe(text[a:b])[0] != "plain"]):
            got[lo:hi] = field.viterbi([field.scores([text[a:b] for a, b in words], lo, hi)], [hi < len(words)])[0].tolist()
        assert got == want
        labelled += any(want)
    assert labelled > 100


def test_addresses_spelled_out_are_found_in_any_case_and_length():
    field = pii.trained()
    for text in ("write to joe AT mail DOT com and so on", "reach joe at " + "h" * 81 + " dot com now please"):
        assert [k for _, k, _ in pii.decode(field, [text])[0]] == [0]


def test_odd_tables(spark):
    rows = [(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc"), (2, None), (3, ""), (4, "x " * 30_000 + "a@b.cc" + " y" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "'x' AS n_email", "2 AS base_sha256")
    found = pii.find(docs).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert [r.spans for r in found if r.doc_id == 4] == ["email:60000:60006"]
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).count() == 0
    assert {r.text for r in pii.mask(docs).collect() if r.doc_id == 1} == {"[EMAIL]"}
