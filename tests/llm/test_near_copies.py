"""Groups of near copies: the join against brute force, and how many pairs it looks at."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import hashing, jaccard_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(seed, n, words=150, edits=(0, 14), pool=None):
    """Copies of one text with words replaced, cut off or added, on both sides of 80 %; a common line in some; chains of edits."""
    r = random.Random(seed)
    word = lambda: r.choice(pool) if pool else "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(words)]
    line = [word() for _ in range(12)]
    out, last = [" ".join(base)], base
    for i in range(n):
        w = list(last if i % 9 == 8 else base)
        for _ in range(r.randint(*edits)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
        if i % 7 == 0:
            w = w[: r.randint(len(w) // 2, len(w))]
        if i % 5 == 0:
            w = line + w
        last = w
        out.append(" ".join(w))
    return out


def brute(rows, t):
    sets = []
    for x in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in range(len(rows))}


def found(spark, rows, t=80):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, t).collect()}


@pytest.mark.parametrize("seed, t, edits, pool", [(1, 80, (0, 14), None), (2, 80, (0, 9), ["x", "yy", "zzz"] * 9 + [f"q{i}" for i in range(40)]), (3, 60, (5, 40), None)])
def test_groups_of_near_copies(spark, seed, t, edits, pool):
    rows = near_copies(seed, 200, edits=edits, pool=pool) + near_copies(seed + 50, 60, 60, (0, 8), pool)
    assert found(spark, rows, t) == brute(rows, t)


def test_candidates_grow_with_the_group(spark, monkeypatch):
    """The pairs that are compared stay below four for each of the near copies of one text; no link is lost."""
    seen = {}
    plain = jaccard_join.Join.reaching

    def counted(self, pairs, whole):
        if not whole:
            seen["pairs"] += pairs.count()
        return plain(self, pairs, whole)

    monkeypatch.setattr(jaccard_join.Join, "reaching", counted)
    for n in (200, 600):
        seen["pairs"] = 0
        rows = near_copies(4, n)
        assert found(spark, rows) == brute(rows, 80)
        assert seen["pairs"] <= 4 * n


def test_order_is_by_counts_of_all_documents(spark, monkeypatch):
    """Every shingle that some documents share is known with the number of all documents that have it, however many there are."""
    seen = {}
    plain = jaccard_join.boundary
    monkeypatch.setattr(jaccard_join, "boundary", lambda n, *rest: seen.update(sizes=n) or plain(n, *rest))
    monkeypatch.setattr(jaccard_join.Join, "postings", lambda self: seen.update(join=self) or (_ for _ in ()).throw(StopAsyncIteration))
    r = random.Random(6)
    rows = [" ".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(9000)] + ["a seldom one of six words"] * 4
    with pytest.raises(StopAsyncIteration):
        jaccard_join.link(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))
    sets = []
    for x in rows:
        w = x.split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    df, sizes = collections.Counter(x for s in sets for x in s), collections.Counter(map(len, sets))
    every = sorted(df)
    h = np.concatenate([jaccard_join.shingles(buffer, at, 5)[1] for _, _, buffer, at in hashing.blocks(pa.array(every))])
    assert jaccard_join.weights(h, *seen["join"].frequent).tolist() == [df[x] if df[x] > 2 else 0 for x in every]
    assert {k: int(v) for k, v in enumerate(seen["sizes"]) if v} == sizes
    assert seen["join"].hot == len(rows) // 200


def test_word_hashes_tell_patterns_apart():
    """Words of a sequence that doubles by its complement: hashes that are polynomials modulo 2**64 can't tell them apart."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for length in (64, 256, 1024, 2048):
        data = np.frombuffer(f"{a[:length]} {b[:length]} {a[:length]}".encode(), np.uint8)
        for key in (hashing.FIRST, hashing.SECOND):
            x, y, z = hashing.word_hashes(data, *hashing.words(data), key)
            assert x == z != y


def test_hashes_of_words_and_runs():
    r = random.Random(5)
    text = [("".join(r.choice("abé漢") for _ in range(r.choice([1, 7, 8, 9, 16, 300])))) for _ in range(300)]
    data = np.frombuffer(" ".join(text).encode(), np.uint8)
    h = hashing.word_hashes(data, *hashing.words(data))
    assert len(set(h.tolist())) == len(set(text)) and all((h[i] == h[j]) == (text[i] == text[j]) for i in range(300) for j in range(i))
    few = hashing.word_hashes(data[:0], *hashing.words(data[:0]))
    assert len(few) == 0 and len(hashing.rolling(few, 3)) == 0
    narrow = h[np.array([r.randrange(3) for _ in range(400)])]
    for width in (1, 2, 5, 6, 35):
        runs = {}
        for i, x in enumerate(hashing.rolling(narrow, width).tolist()):
            assert runs.setdefault(x, tuple(narrow[i : i + width])) == tuple(narrow[i : i + width])
        assert len(set(runs.values())) == len(runs)
