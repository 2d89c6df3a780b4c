"""Odd tables for operators that test_operators.py gives none, and the registered queries as they are on a small table."""

import hashlib
import os
import random
import re
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, langid, queries, quality

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, ids that are null or repeat, empty texts, a long one, and columns with clashing names."""
    rows = [(1, "a b"), (1, "a b"), (1, "ab "), (2, "a  b"), (None, "ab"), (None, "other"), (3, None), (None, ""), (4, " \n"), (5, LONG), (6, LONG + " ")]
    names = ("norm", "recipe", "length", "group_size", "first", "score", "rank", "label", "n", "share", "long", "key", "ids", "_row")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in names}).repartition(3)


def test_exact_dedup_of_odd_rows(odd):
    found = Counter((r.doc_id is not None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect())
    want = [  # "a  b" is the longest of five; of empty texts that of white space is; null ids come first
        (False, 0, 2, 5, False),
        (False, 0, 4, 3, False),
        (False, 0, None, 1, True),
        (True, 1, 2, 5, False),
        (True, 1, 2, 5, False),
        (True, 1, 2, 5, False),
        (True, 2, 2, 5, True),
        (True, 3, 4, 3, False),
        (True, 4, 4, 3, True),
        (True, 5, 6, 2, False),
        (True, 6, 6, 2, True),
    ]
    assert found == Counter(want)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0 and exact_dedup.keep_first(odd.limit(0)).count() == 0


def test_byte_bpe_of_odd_rows(odd):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = Counter((r.doc_id, r.decoded_sha256) for r in bpe.round_trip(odd, path, pattern).collect())
    assert found == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.select("doc_id", "text").collect())
    assert bpe.round_trip(odd.limit(0), path, pattern).count() == 0


def test_language_id_of_odd_rows(spark, odd):
    found = langid.identify(odd.withColumn("lang", F.when(F.col("text").startswith("word"), "xx").when(F.col("text") == "a b", "yy"))).collect()
    assert len(found) == 11 and {r.lang_pred for r in found} <= {"xx", "yy", "und"}
    assert sum(r.lang_pred == "und" for r in found) >= 3  # null and empty texts
    # Languages that code a text alike: the first by name.
    same = langid.fit({k: ["one two three"] for k in ("b", "a")})
    rows = langid.predict(spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three")], "doc_id long, text string"), same).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("a", 0.5)] * 3
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, q) for i, q in [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (5, 0), (99, 1)]], "doc_id long, quality int")
    runs = [sorted((str(r.doc_id), r.score, r.predicted) for r in quality.assess(odd.repartition(n), labels).collect()) for n in (1, 4)]
    assert [x[::2] for x in runs[0]] == [x[::2] for x in runs[1]] and len(runs[0]) == 11 and all(p == (s >= 0.3) for _, s, p in runs[0])
    # the same model; sums within a score depend on the rows scored together, by rounding
    assert [x[1] for x in runs[0]] == pytest.approx([x[1] for x in runs[1]], rel=1e-9)
    assert {r.score for r in quality.assess(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.assess(odd.limit(0), labels).count() == 0
    score = quality.assess(odd, labels).select("score").first()[0]  # a score that is the threshold counts as 1
    assert all(r.predicted == (r.score >= score) for r in quality.score(odd, quality.learn(odd, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").withColumnRenamed("quality", "label")), threshold=score).collect())


@pytest.fixture(scope="module")
def corpus():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")["text"].map(lambda t: t or "").to_dict()


def rows(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, DATA).collect()}


def test_registered_exact_dedup(spark, corpus):
    groups = {}
    for i, t in sorted(corpus.items(), key=lambda x: (-len(x[1]), x[0])):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    want = {i: (g[0], len(g), i == g[0], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g}
    assert {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in rows(spark, "op1_exact_dedup").items()} == want


def test_registered_substring_dedup(spark, corpus):
    words = {i: WORDS.findall(t) for i, t in corpus.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in rows(spark, "op7_substring_dedup").items()} == want


def test_registered_jaccard_join(spark, corpus):
    sets = {}
    for i, t in corpus.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    top = lambda i: i if comp[i] == i else top(comp[i])
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows(spark, "op9_jaccard_join").items()} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_registered_packing_and_sharding(spark, corpus):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, whole = {}, {}
    for r in queries.QUERIES["op5_packing"](spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    some = random.Random(1).sample(sorted(corpus), 40)
    sizes = {i: sum(p.length for p in pieces[i]) for i in corpus}
    assert all(sizes[i] == len(known.encode(corpus[i], add_special_tokens=False).ids) + 1 for i in some)
    for parts in whole.values():
        edge = 0
        for at, n in sorted(parts):
            assert at == edge
            edge += n
        assert edge <= 2048
    shards = rows(spark, "op8_sharding")
    assert {i: r["size"] for i, r in shards.items()} == {i: len(t.encode()) + 8 for i, t in corpus.items()}
    count = Counter(r.shard for r in shards.values())
    assert set(count) <= set(range(24)) and max(count.values()) - min(count.get(s, 0) for s in range(24)) <= 1
    for s in count:
        assert sorted(r.slot for r in shards.values() if r.shard == s) == list(range(count[s]))
