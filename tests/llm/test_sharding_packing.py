"""Hot keys and moved rows of the shards; special strings and exact combinations of the packing."""

import random
from collections import Counter

import numpy as np
import public_tokenizers

from tidemark.llm import langid, packing, sharding


def test_a_further_shard_moves_few_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    before, after = ({r.doc_id: r.shard for r in sharding.shard(docs, n).select("doc_id", "shard").collect()} for n in (8, 9))
    moved = sum(before[i] != after[i] for i in before)
    assert moved <= 4000 * 0.35  # an even share is 0.11; a remainder of the id would move 0.89
    assert all(n in (444, 445) for n in Counter(after.values()).values())


def test_rows_of_one_id_are_ranked_in_parts(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id END AS doc_id", "concat('t', id % 1000) AS text", "1 AS cell", "2 AS part", "3 AS rank", "4 AS ahead")
    rows = sharding.shard(docs, 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 3000 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    hot = spark.range(3000).selectExpr("xxhash64(CAST(id AS STRING)) AS h").selectExpr("pmod(h, 256) AS part").groupBy("part").count().agg({"count": "max"}).first()[0]
    assert hot < 40


def test_ids_are_those_of_the_tokenizer():
    known, r = packing.words(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    bits = ["<|endoftext|>", "<|startoftext|>", " ", "a", "B", "é", "'s", "1", "<|", "|>", "\n", "\t", "漢", "!", "é", "\x85", " "]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert known.ids(t) == np.array(known.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(known.ids("x <|endoftext|> y")) == 12


def test_exact_combinations_come_first():
    """Lengths that fill 100 in twos, threes and fours only, and nothing else."""
    assert packing.combinations({60: 5, 40: 5}, 100) == [((60, 40), 5)]
    assert packing.combinations({50: 2, 30: 2, 20: 2}, 100) == [((50, 50), 1), ((30, 20, 30, 20), 1)] or sum(n for _, n in packing.combinations({50: 2, 30: 2, 20: 2}, 100)) == 2
    assert sum(n for _, n in packing.combinations({41: 3, 29: 3, 17: 3, 13: 3}, 100)) == 3
    r = np.random.default_rng(5)
    counts = Counter(np.minimum(512, r.lognormal(4, 1, 20000).astype(int) + 1).tolist())
    used = Counter()
    plan = packing.combinations(dict(counts), 512)
    for parts, times in plan:
        assert times > 0 and sum(parts) <= 512
        for p in parts:
            used[p] += times
    bound = -(-sum(k * n for k, n in counts.items()) // 512)
    assert used == counts and sum(n for _, n in plan) <= bound + 2


def test_one_id_in_many_rows_and_languages_of_long_texts_only(spark):
    rows = [(3, f"hallo welt {i}", "de") for i in range(300)] + [(3, "hallo welt 0", "de")] * 300 + [(6 + i, "bonjour " * 40, "fr") for i in range(20)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sample(labelled, 10, 100)
    assert len(found["de"]) == 10 and 1 <= len(found["fr"]) <= langid.LONG_ONES
