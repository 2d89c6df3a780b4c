"""Byte-level BPE encoding and decoding by a file of ranks, with the tokenizers library over Arrow batches.

The ranks are bytes; the library wants characters. Each byte stands for one character, and every way to put a
token together from two others becomes a merge, in rank order. A text is taken apart where a letter or sign is
followed by white space: no match of the pattern crosses such a place, so parts are encoded once per worker and
remembered, at most ``MEMORY`` of them.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts of texts that a worker remembers before it starts afresh; bounds memory only, never the result.
MEMORY = 400_000


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memo(dict):
    """A dictionary that works out what it lacks; ``trim`` empties it once it is too large."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key):
        out = self[key] = self.work(key)
        return out

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.clear()


class Codec:
    """Encodes texts to ids with character offsets, and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        self.as_char = as_char = byte_characters()
        name = {token: "".join(map(as_char.__getitem__, token)) for token in ranks}
        merges = [
            (name[a], name[b])
            for token in sorted(ranks, key=ranks.get)
            for cut in range(1, len(token))
            if (a := token[:cut]) in ranks and (b := token[cut:]) in ranks
        ]
        vocab = {name[token]: rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        byte_of = {c: b for b, c in enumerate(as_char)}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, t))
        self.decimal = list(map(str, range(len(self.bytes_of))))
        self.model = self.tokenizer.model
        self.pieces = Memo(self._piece)
        self.parts = Memo(self._part)
        self.after_space = Memo(lambda w: self._part(" " + w))
        self.simple = self.SIMPLE_PIECE if pattern == self.SIMPLE_FOR else None

    #: For texts of these characters alone, the pattern below finds the matches that SIMPLE_FOR does.
    SIMPLE = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*\Z")
    SIMPLE_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
    SIMPLE_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    #: White space other than space and line feed: a text that has it is encoded in one piece.
    ODD = re.compile(r"[^\S \n]|\u180e")
    PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

    def _piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern."""
        found = self.model.tokenize("".join(map(self.as_char.__getitem__, piece.encode())))
        return np.array([t.id for t in found], "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if self.simple and self.SIMPLE.match(part):
            return b"".join(map(self.pieces.__getitem__, self.simple.findall(part)))
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.ODD.search(text):
            found = self._part(text)
        elif "  " in text or "\n " in text or text[:1] == " ":
            found = b"".join(map(self.parts.__getitem__, self.PART.findall(text)))
        else:
            first, *rest = text.split(" ")
            found = self.parts[first] + b"".join(map(self.after_space.__getitem__, rest))
        for memo in (self.parts, self.after_space, self.pieces):
            memo.trim()
        return np.frombuffer(found, "<u4")

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids, and of each the first character and the one past its last; a character that several tokens share
        is in all of them."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(found.offsets, np.int64).reshape(-1, 2)
        return np.array(found.ids, "<u4"), at[:, 0], at[:, 1]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as the tokens come: bytes of a character that a token leaves open wait for the next; what never
        completes becomes U+FFFD."""
        wait = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := wait.decode(self.bytes_of[int(i)]):
                yield out
        if out := wait.decode(b"", True):
            yield out


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<long>, first array<int>, last array<int>: a text's tokens and their places in it.

    A null text counts as empty and has no tokens. Rows stay rows: repeated ones are encoded each. Texts of any
    length are encoded whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                ids, a, b = c.encode_with_offsets(body.as_py() or "")
                lists = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (ids, a, b)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), *lists], ["doc_id", "ids", "first", "last"])

    return _named(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<long>, first array<long>, last array<long>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            texts = [None if ids is None else "".join(c.decode_stream(ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what they decode to.

    A null text counts as empty: no tokens, and the digests of no bytes. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for body in batch.column(1):
                ids = c.encode(body.as_py() or "").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _named(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
