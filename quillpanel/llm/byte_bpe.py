"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks.

Pairs wait in buckets by merge rank; a two-level bitmap over the ranks finds the next one by
find-first-set, and a bucket holds positions of a linked list, the leftmost first. A merge leaves
stale entries behind, which are skipped when they come up, so a pre-token of n bytes takes
O(n log n) steps however long it is. New pre-tokens share one queue by the group, as no pair reaches
over the end of one. Each worker remembers a bounded number of distinct pre-tokens.

Defined cases: a null text counts as empty and has no ids; repeated rows and doc_ids are encoded row
by row; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens (and pairs) that a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARACTERS = 500_000, 8_000_000
#: Bytes of pre-tokens that are merged together, and characters of texts encoded together; a longer one is alone.
GROUP = 1 << 15
#: In the linked list: the end of a pre-token, and a position that has merged into the one before it.
STOP, GONE = -1, -2
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = REMEMBERED):
        import regex

        self.ranks, self.split, self.limit = ranks, regex.compile(pattern).findall, limit
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of the pre-tokens in known
        self.pairs: dict[int, int] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank(self, left: int, right: int) -> int:
        """The merge rank of two neighbours, -1 if they don't merge; kept for the next time."""
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        found = -1 if left < 0 or right < 0 else self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        self.pairs[left << 32 | right] = found
        return found

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The code of each pre-token (none empty), of all in one linked list with a STOP after each.

        The queue: positions wait in a bucket by rank; words[h] has a bit for each filled bucket of the
        256 ranks h * 256 and on, and summary one for each word that isn't 0. waits[i] is the rank that
        position i waits with, so an entry of another rank is stale. A bucket is worked off from the
        left; should a merge make a pair of a lesser rank, what is left of the bucket waits again.
        """
        known, rank = self.pairs.get, self.rank
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
        stops = np.cumsum([len(piece) + 1 for piece in pieces]) - 1
        start = self.first[raw]
        start[stops] = STOP
        n = len(raw)
        ranks = np.full(n, -1, dtype=np.int32)
        ranks[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        ranks[stops] = ranks[stops[stops > 0] - 1] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        edges = [0, *(np.flatnonzero(np.diff(ranks[order])) + 1).tolist(), len(order)]
        order, ids, waits = order.tolist(), start.tolist(), ranks.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        summary, words, buckets = 0, {}, {}

        def wait(r, positions):
            nonlocal summary
            buckets[r] = positions
            if word := words.get(high := r >> 8, 0):
                words[high] = word | 1 << (r & 255)
            else:
                words[high] = 1 << (r & 255)
                summary |= 1 << high

        if order:
            for s, e in zip(edges, edges[1:]):
                wait(waits[order[s]], order[s:e])
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            r = high << 8 | (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                summary &= summary - 1
            bucket = buckets.pop(r)
            bucket.sort()
            for at, i in enumerate(bucket):
                if waits[i] != r:
                    continue
                j = after[i]
                ids[i], ids[j], waits[j] = r, GONE, -1
                after[i] = k = after[j]
                before[k] = i
                right = ids[k]
                if (x := known(r << 32 | right)) is None:
                    x = rank(r, right)
                waits[i] = least = x
                if x >= 0:
                    if (into := buckets.get(x)) is not None:
                        into.append(i)
                    else:
                        wait(x, [i])
                if (h := before[i]) >= 0:
                    left = ids[h]
                    if (y := known(left << 32 | r)) is None:
                        y = rank(left, r)
                    waits[h] = y
                    if y >= 0:
                        if (into := buckets.get(y)) is not None:
                            into.append(h)
                        else:
                            wait(y, [h])
                        least = y if least < 0 else min(least, y)
                if 0 <= least < r and at + 1 < len(bucket):
                    wait(r, bucket[at + 1 :])
                    break
        done = np.array(ids, dtype=np.int32)
        kept = np.cumsum(done >= 0)[stops] * 4
        code = done[done >= 0].astype("<u4").tobytes()
        return [code[s:e] for s, e in zip([0, *kept[:-1].tolist()], kept.tolist())]

    def _learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of pre-tokens, those of about GROUP bytes at a time."""
        group: list[tuple[str, bytes]] = []
        size = 0

        def close():
            if group:
                self.known.update(zip((piece for piece, _ in group), self.merge([data for _, data in group])))
            group.clear()

        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            self.held += len(piece)
            if (whole := self.ranks.get(data)) is not None:
                self.known[piece] = array("I", [whole]).tobytes()
                continue
            if group and size + len(data) > GROUP:
                close()
                size = 0
            group.append((piece, data))
            size += len(data)
        close()

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, in order."""
        waiting: list[list[str]] = []
        size = 0

        def close():
            known = self.known
            self._learn({p for pieces in waiting for p in pieces if p not in known})
            out = [b"".join(map(known.__getitem__, pieces)) for pieces in waiting]
            waiting.clear()
            if len(known) > self.limit or self.held > REMEMBERED_CHARACTERS:
                known.clear()
                self.held = 0
            return out

        for text in texts:
            if waiting and size + len(text) > GROUP:
                yield from close()
                size = 0
            waiting.append(self.split(text))
            size += len(text)
        yield from close()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, code: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", code)))


_encoders: dict[str, BytePairs] = {}


def byte_pairs(name: str = RANKS) -> BytePairs:
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = BytePairs.from_file(tokenizer_path(name), public_tokenizers.PATTERN)
    return _encoders[name]


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(name)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for code in pairs.encode_all(text.as_py() or "" for text in batch.column("text")):
                out["n_tokens"].append(len(code) // 4)
                out["ids_sha256"].append(sha256(code).hexdigest())
                out["decoded_sha256"].append(sha256(pairs.decode(code)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64())} | out)

    return run


def _ids(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(name)
        for batch in batches:
            ids = [array("I", code).tolist() for code in pairs.encode_all(t.as_py() or "" for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(name)
        for batch in batches:
            data = [b"".join(map(pairs.bytes_of.__getitem__, x.as_py() or [])) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(data, pa.binary())], ["doc_id", "data"])

    return run


def _pair(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids) for every document."""
    return _pair(docs).mapInArrow(_ids(ranks), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, data) with the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(ranks), "doc_id long, data binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(documents(spark, sf_dir)).mapInArrow(_digests(RANKS), RESULT)
