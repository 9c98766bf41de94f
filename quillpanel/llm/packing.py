"""Packing of documents into sequences of a fixed window by best-fit decreasing.

Tokens are counted where the text is read; only one small row for each remainder is shuffled. A
document longer than the window is first cut into full windows, each a sequence of its own. The
remainders are dealt into groups of bounded size, and in each group the longest goes first into the
open window with the tightest room, found by a segment tree indexed by remaining capacity.

Defined cases: a null or empty text has the single closing id; repeated rows and repeated or null
doc_id are documents of their own; an empty table has no pieces; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, groups_for, tokenizer_path

WINDOW = 2048
VOCABULARY = "word_bpe_49k.json"
CLOSING_ID = 1
#: Remainders packed together; what a group can waste is at most about one window.
GROUP_ROWS = 2048
#: Parts of words a worker remembers before it starts anew (and 16 times as many characters).
REMEMBERED = 400_000
#: Characters of a text taken at once.
SLICE = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of texts as little-endian bytes, each distinct part of a word encoded once.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its
    words in order. A plain word falls further into runs of letters, single digits and runs of other
    signs, in lower case, as the vocabulary's own pattern has it. A slice of plain words alone falls
    into parts at once; in any other, the words that are not plain go to the tokenizer whole.
    """

    #: Words made of these alone split as PARTS says.
    PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
    PLAIN_SLICE = re.compile(r"[ \n!-&(-;=-~À-ÖØ-öø-ÿ]*")
    PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ \n0-9a-zß-öø-ÿ]+")
    LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
    BLANK = re.compile(r"[ \n]")

    def __init__(self, path: str, limit: int = REMEMBERED):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.parts: dict[str, bytes] = {}
        self.characters = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, parts: list[str]) -> list[bytes]:
        """Words of letters, many to a call: each ends where an id that closes a word stands."""
        import numpy as np

        e = self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0]
        ids = np.array(e.ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(parts):
            return self._encode(parts)
        code, starts = ids.tobytes(), [0, *ends.tolist()]
        return [code[a:b] for a, b in zip(starts, starts[1:])]

    def _learn(self, new: set[str]) -> None:
        letters = [p for p in new if self.LETTERS.fullmatch(p)]
        others = list(new.difference(letters))
        for at in range(0, len(letters), 2000):
            self.parts.update(zip(letters[at : at + 2000], self._encode_letters(letters[at : at + 2000])))
        self.parts.update(zip(others, self._encode(others)))
        self.characters += sum(map(len, new))

    def _split(self, text: str) -> list[str]:
        if self.PLAIN_SLICE.fullmatch(text):
            return self.PARTS.findall(text.lower())
        out: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            if self.PLAIN.fullmatch(word):
                out += self.PARTS.findall(word.lower())
            elif word:
                out.append(word)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self._split, texts))
        self._learn(set().union(*split).difference(self.parts))
        out = [b"".join(map(self.parts.__getitem__, parts)) for parts in split]
        if len(self.parts) > self.limit or self.characters > 16 * self.limit:
            self.parts.clear()
            self.characters = 0
        return out

    def encode_long(self, text: str, slice_characters: int = SLICE) -> bytes:
        """Ids of a text of any length, slice by slice; slices end at a blank, or at a text's end."""
        out, at = [], 0
        while at < len(text):
            blank = self.BLANK.search(text, at + slice_characters)
            cut = blank.start() if blank else len(text)
            out += self.encode([text[at:cut]])
            at = cut
        return b"".join(out)


_encoders: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[name] = WordIds(tokenizer_path(name))
    return _encoders[name]


class RoomTree:
    """Segment tree over room 0..window: the least room of an open window that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.count = [0] * (2 * self.leaves)

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for need, taken out; None if none."""
        count, node = self.count, need + self.leaves
        while not count[node]:
            while node & 1:  # a right child: nothing larger under this parent
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # stepped over the right edge
                return None
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """For each length (1 to window) its (window number, offset there)."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, opened = RoomTree(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.tightest(lengths[i])
        if found is None:
            found, opened = (window, opened), opened + 1
        room, which = found
        placed[i] = (which, window - room)
        if room > lengths[i]:
            tree.push(room - lengths[i], which)
    return placed


def _cut(vocabulary: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    closing = CLOSING_ID.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        partition, ordinal = TaskContext.get().partitionId(), 0
        encoder = word_ids(vocabulary)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            column = batch.column("text")
            for at in range(0, len(ids), 256):
                texts = [t or "" for t in column.slice(at, 256).to_pylist()]
                codes = encoder.encode([t if len(t) <= SLICE else "" for t in texts])
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at")}
                for doc, text, code in zip(ids[at : at + 256], texts, codes):
                    code = (code if len(text) <= SLICE else encoder.encode_long(text)) + closing
                    n = len(code) // 4
                    for start in range(0, n, window):
                        piece = code[4 * start : 4 * (start + window)]
                        for k, v in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n, partition << 33 | ordinal)):
                            out[k].append(v)
                        ordinal += 1
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    return run


def _pack(window: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending")])
        placed = best_fit_decreasing(group.column("length").to_pylist(), window)
        first = group.column("at").to_pylist()
        base: dict[int, int] = {}
        for (which, _), at in zip(placed, first):  # a sequence is named by its first remainder in reading order
            base.setdefault(which, at)
        columns = {k: group.column(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        columns["sequence_id"] = pa.array([base[w] for w, _ in placed], pa.int64())
        columns["offset"] = pa.array([o for _, o in placed], pa.int64())
        return pa.table(columns)

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of every document with their sequence and offset; PIECES has the columns.

    A sequence is named by the reading order of its first piece (unique, not dense).
    """
    rows = docs.count()
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _cut(vocabulary, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, at long"
    )
    # A full window needs no partner, so it takes part in the exchange alone, as a group of one kind.
    full = F.col("length") == window
    groups = groups_for(rows, group_rows)
    dealt = F.when(full, -1 - F.pmod(F.xxhash64("at"), F.lit(groups))).otherwise(F.pmod(F.xxhash64("at"), F.lit(groups)))
    return cut.groupBy(dealt.alias("dealt")).applyInArrow(_pack(window), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
