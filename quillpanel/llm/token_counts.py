"""Token counts under a unigram model, by dynamic programming shared in a trie of pre-tokens.

A text falls into pre-tokens: an optional blank with the run of other characters after it, or a single
blank or line end. Distinct pre-tokens enter a trie, and every node holds the forward score of its
prefix - the best segmentation's log-probability and its number of pieces - computed from the nodes
above it. So a prefix that many pre-tokens share is scored once, and a pre-token's count is its last
node's. Counts stay where the text is: no row is shuffled. A worker's trie and its table of known
pre-tokens are bounded by nodes and characters and start anew when full, which changes no count; what
a pre-token has beyond DEPTH characters is scored from the same forward scores without being kept, so
memory follows neither the corpus nor the length of a pre-token.

The pieces are those of a public vocabulary; a piece's probability falls with its rank r as 1 / (r + 1)
(the file's own scores are ranks, not probabilities). A character without a piece costs one piece for
each of its UTF-8 bytes. Among equally probable segmentations the one with fewer pieces counts.

Defined cases: a null or empty text has no pre-tokens and no tokens; repeated rows are counted row by
row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: Nodes of a worker's trie and characters of its known pre-tokens, and the depth to which one enters the trie.
NODES, KNOWN, DEPTH = 1_000_000, 8_000_000, 256
#: Characters of a text that are split at a time, and forward scores that are held beyond the trie.
SLICE, HELD = 1 << 20, 1 << 13
#: Last characters of a prefix by which the pieces that end there are listed.
ENDING = 4
#: What a byte of a character without a piece costs beyond the rarest piece.
BYTE_PENALTY = 10.0

PRE_TOKEN = re.compile(r" ?[^ \n]+|[ \n]")
_BLANK = re.compile(r"[ \n]")


def pieces(path: str) -> dict[str, float]:
    """Log-probability of every ordinary piece, blanks written as in the file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
            found[model.id_to_piece(i)] = -math.log(1.0 - model.get_score(i))
    total = math.log(sum(map(math.exp, found.values())))
    return {p: s - total for p, s in found.items()}


class Unigrams:
    def __init__(self, scores: dict[str, float], nodes: int = NODES, known: int = KNOWN, depth: int = DEPTH):
        self.scores, self.limit, self.room, self.depth = scores, nodes, known, depth
        self.byte = min(scores.values()) - BYTE_PENALTY
        self.longest = max(map(len, scores))
        #: By a prefix's last characters (ENDING at most): the pieces of so many characters that end there, with scores.
        self.short: dict[str, tuple[tuple[int, float], ...]] = {}
        #: By a prefix's last ENDING characters: the lengths of the longer pieces that end so.
        self.long: dict[str, tuple[int, ...]] = {}
        longer: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > ENDING:
                longer.setdefault(p[-ENDING:], set()).add(len(p))
        for end in {p[-ENDING:] for p in scores}:
            self.short[end] = tuple((n, scores[end[-n:]]) for n in range(1, len(end) + 1) if end[-n:] in scores)
            self.long[end] = tuple(sorted(longer.get(end, ())))
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.known: dict[str, tuple[int, float]] = {}
        self.held = 0

    def _step(self, word: str, i: int, best: list[float], count: list[int], gone: int) -> tuple[float, int]:
        """The forward score and count of word[:i] from those of its prefixes, of which the first ones are gone."""
        at = i - gone
        end = word[i - ENDING : i] if i > ENDING else word[:i]
        short = self.short.get(end)
        while short is None and end:  # no piece ends with these characters, so all that do are shorter
            end = end[1:]
            short = self.short.get(end)
        found, pieces_ = -math.inf, 0
        if word[i - 1] not in self.scores:
            n = len(word[i - 1].encode("utf-8", "surrogatepass"))
            found, pieces_ = best[at - 1] + n * self.byte, count[at - 1] + n
        if short is None:
            return found, pieces_
        for n, score in short:
            score += best[at - n]
            if score > found or score == found and count[at - n] + 1 < pieces_:
                found, pieces_ = score, count[at - n] + 1
        if len(end) == ENDING:
            for n in self.long[end]:
                if n > i:
                    break
                score = self.scores.get(word[i - n : i])
                if score is not None:
                    score += best[at - n]
                    if score > found or score == found and count[at - n] + 1 < pieces_:
                        found, pieces_ = score, count[at - n] + 1
        return found, pieces_

    def _score(self, word: str) -> tuple[int, float]:
        word = word.replace(" ", "▁")
        child, best, count = self.child, self.best, self.count
        node, path = 0, [0]
        kept = word[: self.depth]
        for c in kept:
            below = child.get((node, c))
            if below is None:
                break
            node = below
            path.append(node)
        if len(path) == len(word) + 1:
            return count[node], best[node]
        b, n, gone = [best[k] for k in path], [count[k] for k in path], 0  # of the prefixes of this word
        for i in range(len(path), len(word) + 1):
            score, pieces_ = self._step(word, i, b, n, gone)
            b.append(score)
            n.append(pieces_)
            if i <= len(kept):  # below a new node all nodes are new
                child[node, kept[i - 1]] = len(best)
                node = len(best)
                best.append(score)
                count.append(pieces_)
            elif len(b) > HELD + self.longest:
                del b[:HELD], n[:HELD]
                gone += HELD
        return n[-1], b[-1]

    def measure(self, text: str, size: int = SLICE) -> tuple[int, int, float]:
        """(pre-tokens, tokens, log-probability of the best segmentation)."""
        n_words, n_tokens, parts = 0, 0, []
        text = " " + text if text else ""
        at, end = 0, len(text)
        while at < end:
            cut = min(end, at + size)
            if cut < end:  # a blank or line end always starts a pre-token
                m = _BLANK.search(text, cut)
                cut = m.start() if m else end
            words, known = PRE_TOKEN.findall(text, at, cut), self.known
            for word in {w for w in words if w not in known}:
                known[word] = self._score(word)
                self.held += len(word)
            found = [known[w] for w in words]
            if len(self.best) > self.limit or self.held > self.room:
                self._clear()
            n_words += len(words)
            n_tokens += sum(n for n, _ in found)
            parts.append(math.fsum(s for _, s in found))
            at = cut
        return n_words, n_tokens, math.fsum(parts)


_models: dict[str, Unigrams] = {}


def unigrams(name: str = VOCABULARY) -> Unigrams:
    if name not in _models:
        _models[name] = Unigrams(pieces(tokenizer_path(name)))
    return _models[name]


RESULT = "doc_id long, n_pretokens long, n_tokens long, log_probability double"


def _counts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigrams(name)
        for batch in batches:
            rows = [model.measure(t.as_py() or "") for t in batch.column("text")]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in RESULT.split(", ")])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """RESULT's columns for every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts(vocabulary), RESULT)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
