"""Personal data: rules for four kinds, and a linear-chain conditional random field that adds what rules miss.

The rules find e-mail addresses, IPv4 addresses, card numbers and international phone numbers. The field labels
words by their shapes (an address spelled out, a phone number without its plus sign, a bracketed IP address). It
is trained from a small labelled table and decoded by Viterbi in numpy, many stretches at a time. A word without
digit, "@" and cue is plain. Among plain words the field forgets what came before after a few words, however it came
there; ``Field.settled`` says after how many, from the weights. So it is enough to decode stretches around the words
that are not plain, with so many plain ones to either side: the labels are those that the whole text would get.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# What each kind looks like, as the contract fixes it.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  #: start, kind's number, end


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(t - 9 * (t > 9) for t in twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of LOCAL+ @ DOMAIN, leftmost first, found from each "@" on so that long runs cost their length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        if found := DOMAIN.match(text, at + 1):
            start = at
            while start > done and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, found.end()
                done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return sorted(out)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# The conditional random field.

LABELS = ("O", *KINDS)
#: Words that cue an address spelled out.
CUES = {"at", "(at)", "[at]", "dot", "(dot)", "[dot]"}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Any word that is not plain holds one of these.
TRIGGER = re.compile(r"[0-9@]|(?<![^\W\d_])(?:[aA][tT]|[dD][oO][tT])(?![^\W\d_])")
#: Neighbours to either side that a word's features tell of.
SIGHT = 3


def shape(word: str) -> str:
    """Digits as 0, capitals as A, other letters as a, and runs as one, digits with their number."""
    out = re.sub(r"[0-9]+", lambda m: f"0{min(len(m[0]), 20)}", word)
    return re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\dA-Z_]+", "a", out))[:40]


def describe(word: str) -> list[str]:
    """The features of a word itself."""
    bare = word.strip(".,;:!?\"'")
    low = bare.lower()
    if low in CUES:
        return ["cue=" + low.strip("()[]"), "bracket" if bare[:1] in "([" else "bare"]
    if not re.search("[0-9@]", bare):
        return ["plain"]
    digits = sum(c in "0123456789" for c in bare)
    rough = re.sub(r"[0-9]+", "0", shape(bare))
    kinds = "".join(sorted({"a" if c.isalpha() else "0" if c.isdigit() else c for c in bare}))
    return [f"shape={shape(bare)}", f"rough={rough}", f"digits={min(digits, 20)}", f"kinds={kinds}", f"long={len(bare) > 24}"]


def features(words: list[str], first: int = 0, end: int | None = None) -> list[list[str]]:
    """Of each word from first to end: its own and those of its neighbours within SIGHT."""
    end = len(words) if end is None else end
    lo = max(0, first - SIGHT)
    own, blank = [describe(w) for w in words[lo : end + SIGHT]], ["none"]
    sides = [d for d in range(-SIGHT, SIGHT + 1) if d]
    return [
        ["bias", *own[i], *(f"{d}:{x}" for d in sides for x in (own[i + d] if 0 <= i + d < len(own) else blank)[:2])] for i in range(first - lo, end - lo)
    ]


@dataclass
class Field:
    """Weights by feature and label, and of label pairs (first row: from the start)."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, words: list[str], first: int = 0, end: int | None = None) -> np.ndarray:
        found = features(words, first, end)
        out = np.zeros((len(found), len(LABELS)))
        for i, f in enumerate(found):
            out[i] = self.emit[[k for x in f if (k := self.index.get(x)) is not None]].sum(0)
        return out

    @cached_property
    def settled(self) -> int | None:
        """The number m of plain words among plain ones after which nothing that came before matters: whatever it was, the
        best way to each label of the m-th word leads over "O" at the one before. None if there is no such number.

        What a label is ahead of "O" lies between bounds after one word, whatever came before; each word narrows them.
        """
        emit, via = self.scores(["word"] * (2 * SIGHT + 1), SIGHT, SIGHT + 1)[0], self.step[1:]
        emit = emit - emit[0]
        gain = via - via[:, :1]
        least, most = gain.min(0) + emit, gain.max(0) + emit
        low, high = least, most
        for m in range(2, 50):
            if (high[1:, None] + via[1:] < via[0] - 1e-9).all():
                return m
            low, high = (
                np.maximum(least, (low[:, None] + via).max(0) - (high[:, None] + via).max(0)[0] + emit),
                np.minimum(most, (high[:, None] + via).max(0) - (low[:, None] + via).max(0)[0] + emit),
            )
        return None

    @cached_property
    def quiet(self) -> bool:
        """Whether plain words by themselves are all "O", at the edges of a text and however few they are."""
        return self.settled is not None and not any(self.viterbi([self.scores(["word"] * n)])[0].any() for n in range(1, 2 * (SIGHT + self.settled) + 5))

    def stretches(self, n: int, odd: list[int]) -> list[tuple[int, int]]:
        """(first, end) of the words of a text of n that must be decoded, if these are not plain; all others are "O"."""
        if not self.quiet:
            return [(0, n)] if n else []
        m, out = self.settled, []
        for o in odd:
            lo, hi = o - SIGHT - m - 1, o + SIGHT + m
            if out and lo <= out[-1][1]:
                out[-1] = out[-1][0], hi
            else:
                out.append((lo, hi))
        return [(lo if lo >= SIGHT + m else 0, hi if hi <= n - SIGHT - m - 1 else n) for lo, hi in out]

    def viterbi(self, stretches: list[np.ndarray], cut: list[bool] | None = None) -> list[np.ndarray]:
        """The best labels of each stretch of word scores, all stretches of a batch at once; of those cut off, with "O" last."""
        if not stretches:
            return []
        size = np.array([len(s) for s in stretches])
        n, longest = len(stretches), int(size.max())
        emit = np.zeros((n, longest, len(LABELS)))
        for k, s in enumerate(stretches):
            emit[k, : len(s)] = s
        best, back = self.step[0] + emit[:, 0], np.zeros((n, longest, len(LABELS)), np.int8)
        for t in range(1, longest):
            via = best[:, :, None] + self.step[1:]
            here = via.max(1) + emit[:, t]
            on = (t < size)[:, None]
            back[:, t] = np.where(on, via.argmax(1), np.arange(len(LABELS)))
            best = np.where(on, here, best)
        out = np.zeros((n, longest), np.int8)
        out[:, -1] = np.where(np.zeros(n, bool) if cut is None else cut, 0, best.argmax(1))
        for t in range(longest - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return [out[k, : size[k]] for k in range(n)]


def train(table: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam; forward and backward sums over all sentences at once."""
    index: dict[str, int] = {}
    rows = [[[index.setdefault(x, len(index)) for x in f] for f in features(words)] for words, _ in table]
    n, longest, labels = len(table), max(len(r) for r in rows), len(LABELS)
    wide = max(len(f) for r in rows for f in r)
    ids = np.full((n, longest, wide), len(index))
    gold, on = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (r, (_, tags)) in enumerate(zip(rows, table, strict=True)):
        on[k, : len(r)] = True
        gold[k, : len(r)] = [LABELS.index(t) for t in tags]
        for t, f in enumerate(r):
            ids[k, t, : len(f)] = f
    emit, step = np.zeros((len(index) + 1, labels)), np.zeros((labels + 1, labels))
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, step)]
    for turn in range(1, steps + 1):
        e = emit[ids].sum(2)
        ahead = np.empty((n, longest, labels))
        behind = np.zeros((n, longest, labels))
        ahead[:, 0] = step[0] + e[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(on[:, t, None], lse(ahead[:, t - 1, :, None] + step[1:], 1) + e[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(on[:, t + 1, None], lse(step[1:] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
        z = lse(ahead[:, -1], 1)
        one = np.where(on[..., None], np.exp(ahead + behind - z[:, None, None]), 0)
        d = one - np.eye(labels)[gold] * on[..., None]
        g_emit, g_step = np.zeros_like(emit), np.zeros_like(step)
        np.add.at(g_emit, ids.ravel(), np.repeat(d.reshape(-1, labels), wide, 0))
        g_step[0] = d[:, 0].sum(0)
        for t in range(1, longest):
            two = np.exp(ahead[:, t - 1, :, None] + step[1:] + (e[:, t] + behind[:, t])[:, None, :] - z[:, None, None])
            g_step[1:] += (two * on[:, t, None, None]).sum(0)
            np.add.at(g_step, (gold[on[:, t], t - 1] + 1, gold[on[:, t], t]), -1)
        for w, g, m in ((emit, g_emit, moments[0]), (step, g_step, moments[1])):
            g = g / n + decay * w
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g**2 - m[1])
            w -= rate * m[0] / (1 - 0.9**turn) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-8)
        emit[-1] = 0
    return Field(index, emit[:-1], step)


def labelled_table(rows: int = 400, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: words and labels of sentences that hold personal data in forms that the
    rules above know and don't, and others (versions, dates, sums, keys) that are none."""
    r = np.random.default_rng(seed)
    number = lambda lo, hi: str(r.integers(lo, hi))
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    letters = lambda lo, hi: "".join(map(chr, r.integers(97, 123, r.integers(lo, hi))))
    pick = lambda *xs: xs[r.integers(len(xs))]
    plain = lambda: pick(letters(1, 9), letters(2, 12), letters(2, 8).capitalize(), letters(3, 7) + pick(".", ",", ";"))

    def mail() -> tuple[list[str], str]:
        name, host = letters(3, 9) + pick("", "." + digits(2), digits(2)), letters(4, 9) + pick("", digits(1))
        at, dot = pick(("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"))
        return pick([f"{name}@{host}.{pick('com', 'org', 'net')}"], [name, at, host, dot, pick("com", "org", "net")]), "email"

    def address() -> tuple[list[str], str]:
        ip = ".".join(number(0, 256) for _ in range(4))
        return [pick(ip, f"[{ip}]", f"({ip})", f"{ip}:{number(10, 65000)}")], "ip"

    def card() -> tuple[list[str], str]:
        x = digits(16)
        return pick([x], [x[:4], x[4:8], x[8:12], x[12:]], ["-".join((x[:4], x[4:8], x[8:12], x[12:]))]), "card"

    def phone() -> tuple[list[str], str]:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{number(1, 99)}", a, b, c]), "phone"

    def none() -> list[str]:
        return pick(
            [f"{number(0, 9)}.{number(0, 20)}"], [f"v{number(0, 9)}.{number(0, 9)}.{number(0, 9)}"], [number(1900, 2100)], [number(0, 99)], [number(0, 99) + pick(".", ",", "%")],
            [f"20{digits(2)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}:{digits(2)}"], [f"password={letters(2, 4)}{digits(6)}{letters(1, 4)}{digits(2)}"],
            ["AKIA" + letters(6, 8).upper() + digits(3) + letters(4, 6).upper()], ['"' + "".join(pick(letters(1, 3), digits(2)) for _ in range(14)) + '"'],
            [number(1000, 999999)], [f"{number(1, 99)},{digits(3)}"], ["version", number(1, 9) + "."], [letters(3, 6), "at", letters(3, 8)], ["at", "dot"], [digits(int(r.integers(20, 30)))],
            [f"{number(1, 20)}.{number(1, 20)}.{number(1, 20)}"], [letters(2, 6) + digits(2)], ["@" + letters(3, 9)],
        )

    table = []
    for _ in range(rows):
        words, tags = [], []
        for _ in range(r.integers(1, 4)):
            k = r.integers(0, 7)
            before = [plain() for _ in range(r.integers(0, 6))]
            words += before
            tags += ["O"] * len(before)
            if k < 4:
                found, kind = (mail, address, card, phone)[k]()
            elif k < 6:
                found, kind = none(), "O"
            else:
                found, kind = [], "O"
            words += found
            tags += [kind] * len(found)
        after = [plain() for _ in range(r.integers(1, 6))]
        table.append((words + after, tags + ["O"] * len(after)))
    return table


@lru_cache(1)
def trained() -> Field:
    """The field of the labelled table, trained once a process."""
    return train(labelled_table())


def decode(field: Field, texts: list[str]) -> list[list[Span]]:
    """What the field labels in each text, as if it were decoded as a whole, trimmed of punctuation."""
    owners, places, scores, cut = [], [], [], []
    for k, text in enumerate(texts):
        hits = [m.start() for m in TRIGGER.finditer(text)]
        if not hits and field.quiet:
            continue
        words = [m.span() for m in WORD.finditer(text)]
        starts = [a for a, _ in words]
        near = sorted({bisect_right(starts, at) - 1 for at in hits})
        odd = [i for i in near if describe(text[slice(*words[i])])[0] != "plain"]
        for lo, hi in field.stretches(len(words), odd):
            first = max(0, lo - SIGHT)
            owners.append(k)
            places.append(words[lo:hi])
            scores.append(field.scores([text[a:b] for a, b in words[first : hi + SIGHT]], lo - first, hi - first))
            cut.append(hi < len(words))
    out: list[list[Span]] = [[] for _ in texts]
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))  # stretches of about the same length together
    for lo in range(0, len(order), 512):
        part = order[lo : lo + 512]
        for i, labels in zip(part, field.viterbi([scores[i] for i in part], [cut[i] for i in part]), strict=True):
            k, at = owners[i], 0
            while at < len(labels):
                last = at
                while last + 1 < len(labels) and labels[last + 1] == labels[at]:
                    last += 1
                if labels[at]:
                    a, b = places[i][at][0], places[i][last][1]
                    found = texts[k][a:b]
                    a += len(found) - len(found.lstrip("\"'([<"))
                    b -= len(found) - len(found.rstrip(".,;:!?\"')]>"))
                    out[k].append((a, int(labels[at]) - 1, b))
                at = last + 1
    return [sorted(x) for x in out]


def plausible(kind: int, found: str) -> bool:
    """Whether a labelled stretch has what its kind needs: an exact check that follows the field."""
    digits = sum(c in "0123456789" for c in found)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", found)) and bool(re.search(r"\.|\bdot\b", found))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return found.count(".") == 3 and len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    if kind == 2:
        return 14 <= digits <= 19 and luhn("".join(c for c in found if c in "0123456789"))
    return 10 <= digits <= 15 and not re.search("[A-Za-z]", found)


def all_spans(field: Field, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: the field adds those that touch no span of the rules."""
    for text, more in zip(texts, decode(field, texts), strict=True):
        base = base_spans(text)
        new = [s for s in more if plausible(s[1], text[s[0] : s[2]]) and not any(s[0] < b and a < s[2] for a, _, b in base)]
        yield base, sorted(base + new)


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans (of rules and field), n_added.

    A null text counts as empty and has no spans. Places are code points, ends exclusive. Rows are looked at each on
    its own; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, added = [], [], [], []
            for base, every in all_spans(shared.value, [t or "" for t in batch.column(1).to_pylist()]):
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                added.append(len(every) - len(base))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            columns = [batch.column(0), *(pa.array(table[:, k]) for k in range(len(KINDS)))]
            columns += [pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    columns = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(*columns).mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with a word in capitals and brackets for each span; of overlapping ones the first, the longest at its place."""
    out, done = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """docs with personal data in ``text`` replaced; all columns and rows stay, null texts stay null."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    @pandas_udf("string")
    def clean(column):
        import pandas as pd

        texts = [t or "" for t in column]
        found = [masked(t, spans) for t, (_, spans) in zip(texts, all_spans(shared.value, texts), strict=True)]
        return pd.Series([None if t is None else f for t, f in zip(column, found, strict=True)], dtype=object)

    return docs.withColumn(text, clean(docs[text]))
