"""The training-data operators against brute force, round trips and held-out rows, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, exact_dedup, jaccard_join, langid, packing, pii, quality, sharding, substring_dedup
from tidemark.llm.common import materialize

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts, lang=None):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def texts(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty ones and a long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    base = [" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(n)]
    for i in range(0, n, 5):
        w = base[i].split()
        base[(i + 1) % n] = base[i]
        if len(w) > 10:
            base[(i + 2) % n] = " ".join(w[:-1] + [word()]).upper()
        base[(i + 3) % n] = " ".join(w[:20] + passage[r.randint(0, 10) :] + w[20:])
    return [*base, None, "", " \n\t", "a", " ".join(["la"] * 200), " ".join(passage * 40), " ".join(word() for _ in range(8000))]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, texts()).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, ids that are null or repeat, and columns with clashing names."""
    t = " ".join(f"w{i}" for i in range(90))
    rows = [(1, t), (1, t), (1, t + " x"), (2, t), (None, t), (3, None), (None, None), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "key", "size", "n", "length", "score", "piece", "keep_id")})


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_dedup(spark, docs):
    found, groups = by_id(exact_dedup.exact_dedup(docs, least=4, most=20)), defaultdict(list)
    for i, t in enumerate(texts()):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(members)[1], len(members), min(members)[1] == i)
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept)


def test_chunks_make_up_the_text(spark):
    r = random.Random(2)
    t = "".join(r.choice("abcdefghijklmnop!0é漢") for _ in range(5000))
    parts = spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"), 16, 256).alias("c")).first().c
    assert "".join(parts) == t and max(map(len, parts)) <= 256 and len(parts) > 20


def test_sharding(spark, docs, odd):
    n = len(texts())
    rows = sharding.shard(docs, shards=5, nodes=8, bits=8).collect()
    assert len(rows) == n and {r.doc_id for r in rows} == set(range(n))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        data = (texts()[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    # the law as a simulation, key by key
    body = F.coalesce("text", F.lit("")).cast("binary")
    part = F.pmod(F.xxhash64((F.octet_length(body).cast("long") + 8), F.crc32(body)), F.lit(sharding.PARTS)).alias("part")
    cells = {r.doc_id: (r.cell, (r.part, r.p)) for r in docs.select("doc_id", part, F.xxhash64("doc_id").alias("p"), F.shiftrightunsigned(F.xxhash64("doc_id"), 56).alias("cell")).collect()}
    spots = sharding.ring(5, 8, 8)
    home = lambda c: max([a for a, (at, _) in enumerate(spots) if at <= c], default=len(spots) - 1)
    first = spots[0][0]
    waiting = sorted(cells, key=lambda i: (home(cells[i][0]), (cells[i][0] - first) % 256, cells[i][1]))
    wanted = Counter(spots[home(cells[i][0])][1] for i in cells)
    room = [n // 5] * 5
    for s in sorted(range(5), key=lambda s: (-wanted[s], s))[: n % 5]:
        room[s] += 1
    at, hop = {}, 0
    while waiting:
        left = []
        for i in waiting:
            s = spots[(home(cells[i][0]) + hop) % len(spots)][1]
            if room[s]:
                room[s] -= 1
                at[i] = s
            else:
                left.append(i)
        waiting, hop = left, hop + 1
    assert at == {r.doc_id: r.shard for r in rows}
    assert sharding.shard(odd, 3).count() == 8 and sharding.shard(docs.limit(0)).count() == 0


def test_packing(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.pieces(docs, path, room=64), room=64, cells=4).collect()
    tokenizer, place = packing.words(path).tokenizer, defaultdict(list)
    want = set()
    for i, t in enumerate(texts()):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for parts in place.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in rows)
    assert len(place) <= 1.02 * -(-total // 64) + 2
    assert packing.pack(packing.pieces(odd, path)).count() == 8 and packing.pack(packing.pieces(docs.limit(0), path)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_combinations_use_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = {int(k): int(v) for k, v in zip(r.integers(1, 200, 40), r.integers(1, 30, 40))}
    found = packing.combinations(counts, 200)
    used = Counter()
    for parts, times in found:
        assert sum(parts) <= 200 and times > 0
        for p in parts:
            used[p] += times
    assert used == counts
    bins = []  # best fit decreasing
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= length]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= length
        else:
            bins.append(200 - length)
    assert sum(t for _, t in found) <= 1.02 * len(bins) + 1


def test_byte_bpe(spark, docs):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = ["a\t b", "  x \n y", "日本 語", "👩‍👩‍👧!", "don't I'LL", "\x00\x1c a", "aaaa" * 9, "a b", "1234567 é\r\n"]
    for r in bpe.round_trip(make(spark, odd + texts()), path, pattern).collect():
        t = (odd + texts())[r.doc_id] or ""
        ids = known.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    encoded = bpe.encode(make(spark, odd), path, pattern)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path, pattern).collect()} == dict(enumerate(odd))
    for r in encoded.collect():
        assert all(a <= b for a, b in zip(r["first"], r["last"])) and max(r["last"], default=0) == len(odd[r.doc_id])


def test_substring_dedup(spark, docs, odd):
    def brute(rows, width):
        words = [WORDS.findall(t or "") for t in rows]
        seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
        out = []
        for w in words:
            gone = [False] * len(w)
            for k in range(len(w) - width + 1):
                if seen[tuple(w[k : k + width])] > 1:
                    gone[k : k + width] = [True] * width
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        return out

    for width in (12, 35):
        found = by_id(substring_dedup.remove_repeats(docs, width, kmer=4, kept_text=True))
        want = brute(texts(), width)
        assert [(found[i].n_words, found[i].n_removed, found[i].kept_sha256) for i in range(len(want))] == want
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found.values())
    rows = odd.select("text").collect()
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(odd).collect())
    assert got == sorted(brute([r.text for r in rows], 35))
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("t, seed", [(80, 1), (80, 7), (60, 3)])
def test_jaccard_join(spark, t, seed):
    r = random.Random(seed)
    rows = texts(seed, 40)
    short = [" ".join(r.choice("xyz") for _ in range(r.randint(4, 14))) for _ in range(60)]
    for i in range(0, 60, 3):  # near copies of short texts
        short[i + 1] = short[i] + " x"
    rows += short
    sets = []
    for x in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(rows)))
    top = lambda i: i if comp[i] == i else top(comp[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    found = by_id(jaccard_join.link(make(spark, rows), t))
    assert {i: (len(sets[i]), top(i)) for i in range(len(rows))} == {i: (r.n_shingles, r.component_id) for i, r in found.items()}


def test_jaccard_join_of_odd_rows(spark, odd, docs):
    rows = jaccard_join.link(odd).collect()
    assert len(rows) == 8 and sum(r.n_shingles == 0 for r in rows) == 3
    assert jaccard_join.link(docs.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 7)], "a long, b long")
    assert {r.node: r.comp for r in jaccard_join.components(links).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 7: 2, 8: 8, 9: 8}


def test_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 16)) + 2 * r.normal(size=(9, 16))[r.integers(0, 9, 900)]
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    got = defaultdict(list)
    for row in ann.search(df, df.where("vec_id % 20 = 0"), 10, s=ann.Settings(list_size=32, block=64)).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
        assert row.rank == len(got[row.query_id])
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 9)))[:10]
        hit += len(set(want) & {i for i, _ in found})
        assert len(found) == 10 and q not in dict(found) and np.allclose([v for _, v in found], [x[i] @ x[q] for i, _ in found])
    assert hit >= 0.9 * 10 * len(got)
    few = df.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0"), 10).count() == 4 and ann.search(df.limit(0), df).count() == 0


def recall(spark, x, k, settings):
    """Share of the k best found, for every 20th vector, and the fewest that a query found."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for row in ann.search(df, df.where("vec_id % 20 = 0"), k, s=settings).collect():
        got[row.query_id].add(row.vec_id)
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:k].tolist()))
    return hit / (k * len(range(0, len(x), 20))), min(len(got[q]) for q in range(0, len(x), 20))


def test_neighbours_beyond_the_lists_looked_up(spark):
    x = np.random.default_rng(2).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found, fewest = recall(spark, x, 20, ann.Settings(list_size=8, scanned=64))
    assert found >= 0.99 and fewest == 20


@pytest.mark.parametrize("lengths", ["one long", "lognormal", "extreme"])
def test_neighbours_of_uneven_lengths(spark, lengths):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16)) + 3 * r.normal(size=(30, 16))[r.integers(0, 30, 3000)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "one long":
        x[7] *= 10_000
    else:
        x *= np.exp(r.normal(size=3000) * (1 if lengths == "lognormal" else 20))[:, None]
    found, fewest = recall(spark, x, 20, ann.Settings(list_size=16))
    assert found >= 0.98 and fewest == 20


def test_pii_rules():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab1.@-+ %") for _ in range(r.randint(0, 30)))
        assert list(pii.emails(t)) == [m.span() for m in email.finditer(t)]
    t = "a.b@c.de, 1.2.3.4 999.1.1.1; 4111 1111 1111 1111; 4111111111111112; +1 (234) 567-8901 +12"
    assert pii.joined(pii.base_spans(t)) == "email:0:8,ip:10:17,card:29:48,phone:68:85"
    assert pii.masked(t, pii.base_spans(t)).startswith("[EMAIL], [IP] 999.1.1.1; [CARD]; ")


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table(200), steps=60)


def test_pii_field(spark, field, docs):
    held = pii.labelled_table(200, seed=77)
    labels = field.viterbi([field.scores(w) for w, _ in held])
    right = [pii.LABELS[a] == b for p, (_, g) in zip(labels, held) for a, b in zip(p, g)]
    assert np.mean(right) > 0.95
    best = field.scores(held[0][0])[:4]  # Viterbi against all label sequences
    import itertools

    score = lambda y: field.step[0, y[0]] + sum(field.step[1 + a, b] for a, b in itertools.pairwise(y)) + sum(best[i, k] for i, k in enumerate(y))
    assert tuple(field.viterbi([best])[0]) == max(itertools.product(range(5), repeat=len(best)), key=score)
    t = "call +1 (269) 555-3296 4524132264652876 now"
    base, every = next(pii.all_spans(field, [t]))
    assert [s for s in base if s not in every] == [] and len(every) > len(base)
    plain = " ".join(["word"] * 50)
    assert list(pii.all_spans(field, ["", plain, plain + " 3.5 " + plain])) == [([], [])] * 3
    found = by_id(pii.find(make(spark, [t, None, ""]), field))
    assert found[0].n_added == 2 and found[1].base_sha256 == hashlib.sha256(b"").hexdigest() and found[2].spans == ""
    clean = by_id(pii.mask(make(spark, [t, None, plain]), field))
    assert "[PHONE]" in clean[0].text and clean[1].text is None and clean[2].text == plain


def test_language_id(spark):
    r = random.Random(5)
    speech = {"x": ["the", "and", "with", "thing"], "y": ["der", "und", "mit", "ding"]}
    say = lambda k: " ".join(r.choice(speech[k]) for _ in range(20))
    trees = langid.fit({k: [say(k) for _ in range(20)] for k in speech})
    assert np.allclose(np.exp2(-trees.bits.astype(float)).reshape(-1, trees.symbols, 2).sum(1), 1, atol=1e-4)
    rows = [(i, say(k), k) for i, k in enumerate("xy" * 60)] + [(120, None, "x"), (121, "12 !", None), (122, say("y"), None)]
    found = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(found[i].lang_pred == k for i, _, k in rows[:120]) and found[122].lang_pred == "y"
    assert {found[i].lang_pred for i in (120, 121)} == {"und"} and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    # code lengths by the definition, byte by byte, in several steps
    text = say("x") * 3
    codes = trees.symbol[np.frombuffer(langid.folded(text), np.uint8)]
    want = sum(trees.bits[((codes[i] * trees.symbols + codes[i + 1]) * trees.symbols + codes[i + 2]) * trees.symbols + codes[i + 3]].astype(float) for i in range(len(codes) - 3))
    assert np.allclose(langid.code_lengths(trees, ["", text, "a"])[1], want)
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(nothing).count() == 0


def test_language_id_of_many_scripts(spark):
    """Forty languages in ten scripts, in fours that differ by rare letters alone; code lengths by the definition."""
    r = random.Random(8)
    starts = [0x61, 0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x905, 0x3042, 0x4E00, 0xAC00]

    def say(script, own, n=40):
        word = lambda: "".join(chr(starts[script] + r.randint(0, 9)) for _ in range(r.randint(2, 6)))
        return " ".join(word() + (chr(starts[script] + 10 + own) if r.random() < 0.2 else "") for _ in range(n))

    names = [(s, o) for s in range(10) for o in range(4)]
    samples = {f"{s}{o}": [say(s, o) for _ in range(20)] for s, o in names}
    trees = langid.fit(samples)
    rows = [(s, o, say(s, o)) for s, o in names for _ in range(3)]
    found = langid.code_lengths(trees, [t for *_, t in rows]).argmin(1)
    assert [trees.languages[k] for k in found] == [f"{s}{o}" for s, o, _ in rows]

    data = b"".join(map(langid.folded, samples["21"]))
    counts = [defaultdict(Counter) for _ in range(4)]
    for order in range(4):
        for i in range(order, len(data)):
            counts[order][data[i - order : i]][data[i]] += 1

    def shares(context):
        if context is None:
            return [1 / 256] * 256
        n, shorter = counts[len(context)].get(context, Counter()), shares(context[1:] if context else None)
        if not n:
            return shorter
        mass, total = sum(shorter[b] for b in range(256) if b not in n), sum(n.values())
        rest = total + len(n) if len(n) < 256 else total
        return [n[b] / rest if b in n else len(n) / rest * shorter[b] / mass for b in range(256)]

    text = say(2, 1, 8) + " 7 zß " + say(3, 0, 4)
    coded = langid.folded(text)
    want = -sum(np.log2(shares(coded[i - 3 : i])[coded[i]]) for i in range(3, len(coded)))
    assert np.isclose(langid.code_lengths(trees, [text])[0][trees.languages.index("21")], want, rtol=1e-5)


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta."]) + str(r.randint(0, 9)) for _ in range(r.randint(20, 200)))
    bad = lambda: good() + " " + " ".join(["BUY!!!"] * 70)
    rows = [(i, bad() if i % 3 == 0 else good()) for i in range(300)] + [(300, None), (301, "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    found = by_id(quality.assess(spark.createDataFrame(rows, "doc_id long, text string"), labels))
    held = [i for i in range(300) if found[i].held_out]
    assert np.mean([found[i].predicted == (i % 3 != 0) for i in held]) > 0.95
    assert len(found) == 302 and all(0 <= x.score <= 1 for x in found.values()) and found[300].score == found[301].score


def test_quality_gradients():
    model, (x, first) = quality.Attention(6), quality.bags(["a b C! " * 60, "x", "", "q r s " * 90])
    r = np.random.default_rng(1)
    for k, p in model.p.items():
        model.p[k] = p + r.normal(0, 0.3, p.shape)
    y = np.array([1.0, 0, 1, 0])
    loss = lambda: -np.mean(np.where(y > 0, np.log(s := model.forward(x, first)["score"]), np.log(1 - s)))
    for k, g in model.gradients(x, first, y).items():
        at = tuple(0 for _ in g.shape)
        model.p[k][at] += 1e-6
        up = loss()
        model.p[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
        model.p[k][at] += 1e-6


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = texts(3, 40) + ["mail x.y@z.example now and then again", "12345 !!"]
    make(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        seen.append(docs.count())
        if name == "exact_dedup":
            norm = {re.sub(r"\s", "", r.text or "") for r in before.collect()}
            assert docs.count() == len(norm)
        if name == "near_duplicates":
            assert docs.count() == jaccard_join.link(before).select("component_id").distinct().count()
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0]
    assert not any("@" in (r.text or "") for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() == seen[-1]


def test_pipeline_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    say = lambda k, n=60: " ".join(f"word{k}x{i}" for i in range(n))
    stages = dict(corpus_pipeline.STAGES)
    rows = [(None, say(1)), (None, "12 !"), (None, say(2)), (5, say(3)), (5, "34 !"), (None, None)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in [*rows, *((100 + i, say(9)) for i in range(30))]], "doc_id long, text string, lang string")
    kept = [(r.doc_id, r.text) for r in stages["language_id"](spark, docs, "").collect() if r.doc_id is None or r.doc_id < 100]
    assert sorted(kept, key=str) == sorted([(None, say(1)), (None, say(2)), (5, say(3))], key=str)

    rows = [(None, say(1)), (None, say(1)), (7, say(1)), (None, say(2)), (3, say(3)), (3, say(3)), (3, say(4)), (2, say(4) + " "), (8, say(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in stages["exact_dedup"](spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, say(1)), (None, say(2)), (3, say(3)), (2, say(4) + " ")], key=str)

    rows = [(None, say(1)), (None, say(1) + " a"), (7, say(1) + " b"), (None, say(2)), (4, say(3)), (9, say(3) + " a"), (9, say(5)), (9, say(6)), (6, say(6) + " a"), (None, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, "").collect()]
    firsts = [k for k in kept if k[0] is None and (k[1] or "").startswith(say(1))]
    assert len(firsts) == 1
    assert sorted(set(kept) - set(firsts), key=str) == sorted([(None, say(2)), (4, say(3)), (9, say(5)), (6, say(6) + " a"), (None, ""), (None, " ")], key=str)
