"""Removal of every byte that a repeated 200-byte string covers, over all documents at once.

Suffixes are sorted one bucket at a time (suffix_sort.py). So that equal strings meet in one bucket
without every position being shuffled, a bucket holds the suffixes whose next 200 bytes have the same
least 32-byte gram: strings that are equal choose the same gram at the same place. Consecutive
suffixes of a document with one gram form a run, about one for every 85 bytes, and only the runs'
hashes are shuffled. Of runs that are equal as a whole one goes into its bucket, with the number that
it stands for; its bucket's sorted order decides which of its strings are repeated, and that verdict
goes back to all of them. So every removed byte comes from the sort.

A bucket of more than CROWD different runs is cut by its next bytes: strings that have the gram at
nearly the same place share more bytes than the gram, and a hash of all that they share names the
finer bucket. At the finest cut a bucket holds the copies of one string alone, so a bucket's memory is
bounded whatever the corpus holds.

Defined cases: a null text counts as empty; repeated rows are documents of their own and so repeat
each other; a document under 200 bytes keeps all; where a removed run cuts a character in two, the
text that is handed on drops the character's rest; columns other than the text pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, row_keys, spread_join
from .suffix_sort import Block

SPAN = 200
GRAM = 32
#: Positions handled at a time within a document; the low bits of a gram's order break ties leftmost.
PART_BITS = 22
#: Different runs that are sorted in one bucket (6 MB of text at most, some 250 MB with its suffixes' words
#: and ranks), and bytes of the buckets of one block.
CROWD, BLOCK_BYTES = 1 << 14, 1 << 20
#: Parts into which a crowded bucket's runs are cut; the finest has a part for each place of the gram.
CUTS = (8, SPAN - GRAM + 1)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = x * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every position that has as many."""
    n = len(data)
    x = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    x = _mixed(x, 0x9E3779B97F4A7C15)
    x = _mixed(x[:-8] + (x[8:] ^ (x[8:] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), 0x94D049BB133111EB)
    return _mixed(x[:-16] + (x[16:] ^ (x[16:] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93), 0xFF51AFD7ED558CCD)


def runs(data: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, last start, gram position) of every run of string starts."""
    out = []
    step = (1 << PART_BITS) - span
    for part in range(0, max(len(data) - span + 1, 0), step):
        piece = data[part : part + step + span - 1]
        h = gram_hashes(piece)
        low = np.uint64((1 << PART_BITS) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        window, reach = span - GRAM + 1, 1
        while reach * 2 <= window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = window - reach
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        at = place[first]
        out.append((h[at].view(np.int64), first + part, last + part, at + part))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


def _gram_counts(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [runs(data.as_py(), span)[0] for data in batch.column("text")]
            gram, uses = np.unique(np.concatenate(grams or [np.zeros(0, dtype=np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(uses, pa.int64())], ["gram", "uses"])

    return run


def _run_rows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        names = ["gram", "whole", "ka", "kb", "place"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for ka, kb, data in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), batch.column("text")):
                data = data.as_py()
                gram, first, last, at = runs(data, span)
                if len(gram):
                    whole = np.array([xxh3_64_intdigest(data[s : e + span]) for s, e in zip(first.tolist(), last.tolist())], dtype=np.uint64)
                    place = first << 16 | (last - first) << 8 | (at - first)
                    for column, values in zip(out, (gram, whole.view(np.int64), np.full(len(gram), ka), np.full(len(gram), kb), place)):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their texts compressed, for the exchange."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        columns = [pa.array([press(t.as_py()) for t in c], pa.binary()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data else b""


PIECE = "bucket long, gram long, whole long, rel long, n long, origin int, data binary"
_PIECE_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
_PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _pieces(span: int):
    """Pieces of the wanted runs: of each run the string starts that have the gram in one of its cut's ranges of places.

    With one cut a piece is the run and its bucket is the gram's. Else the bucket is named by all bytes
    that any two strings of such a piece would share if they were equal.
    """

    def cut_up(data: bytes, w: dict) -> Iterator[tuple]:
        from xxhash import xxh3_64_intdigest

        s, cut = w["place"] >> 16, w["cut"]
        width = -(-(span - GRAM + 1) // cut)
        e, at = s + (w["place"] >> 8 & 255), s + (w["place"] & 255)
        if cut == 1:
            yield w["gram"], w["gram"], w["whole"], 0, w["n"], at - s, data[s : e + span]
            return
        for part in range(cut):
            lo, hi = max(s, at - (part + 1) * width + 1), min(e, at - part * width)
            if lo <= hi:
                bucket = xxh3_64_intdigest(data[at - part * width : at - (part + 1) * width + 1 + span], part)
                yield bucket - (1 << 64) if bucket >> 63 else bucket, w["gram"], w["whole"], lo - s, w["n"], at - lo, data[lo : hi + span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                data = _unpacked(text.as_py())
                for w in wanted.as_py():
                    rows += cut_up(data, w)
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)

    return run


def _spans_of(positions: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings at these sorted positions cover."""
    cut = np.flatnonzero(positions[1:] > positions[:-1] + span)
    return list(zip(positions[np.concatenate([[0], cut + 1])].tolist(), (positions[np.concatenate([cut, [len(positions) - 1]])] + span).tolist()))


VERDICT = "gram long, whole long, rel long, n long, spans array<struct<lo: long, hi: long>>"
_SPAN_LIST = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _sort_buckets(span: int, block_bytes: int):
    """Pieces in order of bucket: whole buckets are gathered into a block and sorted; a row per piece with repeated strings."""

    def settled(rows: list[tuple]) -> list[tuple]:
        numbers = {b: i for i, b in enumerate(dict.fromkeys(r[0] for r in rows))}
        block = Block([r[6] for r in rows], [r[5] for r in rows], [numbers[r[0]] for r in rows])
        at, owner = block.repeated(span, np.array([r[4] for r in rows], dtype=np.int64))
        order = np.lexsort((at, owner))
        at, owner = at[order], owner[order]
        out, s = [], 0
        for e in np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]])).tolist() if len(at) else []:
            _, gram, whole, rel, n, *_ = rows[int(owner[s])]
            out.append((gram, whole, rel, n, [{"lo": lo, "hi": hi} for lo, hi in _spans_of(at[s : e + 1], span)]))
            s = e + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        bucket: list[tuple] = []
        size = 0

        def found(rows):
            out = settled(rows)
            types = [pa.int64()] * 4 + [_SPAN_LIST]
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["gram", "whole", "rel", "n", "spans"])] if out else []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _PIECE_NAMES)):
                if bucket and row[0] != bucket[0][0]:
                    block += bucket
                    bucket = []
                    if size > block_bytes:
                        yield from found(block)
                        block, size = [], 0
                bucket.append(row)
                size += len(row[6])
        if block or bucket:
            yield from found(block + bucket)

    return run


def _fetched(rows: DataFrame, kinds: DataFrame, span: int) -> DataFrame:
    """The pieces of one run of each of the kinds (gram, whole, n, one, cut)."""
    wanted = kinds.groupBy("one.ka", "one.kb").agg(F.collect_list(F.struct("gram", "whole", "n", F.col("one.place").alias("place"), "cut")).alias("wanted"))
    return _text(rows.select("ka", "kb", "text")).join(wanted, ["ka", "kb"]).select("text", "wanted").mapInArrow(_pieces(span), PIECE)


def _sorted(pieces: DataFrame, span: int, block_bytes: int) -> DataFrame:
    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(span, block_bytes), VERDICT)


def _cut_verdicts(rows: DataFrame, kinds: DataFrame, span: int, block_bytes: int) -> DataFrame:
    """Verdicts on crowded kinds by buckets of their pieces; equal pieces go into a bucket as one."""
    pieces = durable(_fetched(rows, kinds, span).withColumn("same", F.xxhash64("data")))
    one = F.min(F.struct("gram", "whole", "rel", "origin", "data")).alias("one")
    distinct = pieces.groupBy("bucket", "same").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"), one)
    # A piece is known by its bucket and hash from here on.
    alone = distinct.select("bucket", F.col("bucket").alias("gram"), F.col("same").alias("whole"), F.lit(0).cast("long").alias("rel"), "n", "one.origin", "one.data")
    found = _sorted(alone, span, block_bytes).select(F.col("gram").alias("bucket"), F.col("whole").alias("same"), "spans")
    weighed = durable(found.join(distinct.select("bucket", "same", "members"), ["bucket", "same"]))
    back = spread_join(pieces.select("bucket", "same", "gram", "whole", "rel"), weighed, ["bucket", "same"], "members", F.xxhash64("gram", "whole", "rel"))
    moved = F.transform("spans", lambda x: F.struct((x["lo"] + F.col("rel")).alias("lo"), (x["hi"] + F.col("rel")).alias("hi")))
    return back.groupBy("gram", "whole").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def repeated_spans(rows: DataFrame, span: int = SPAN, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(ka, kb, spans): for each row key of rows (ka, kb, text binary, ...) its covered spans, unmerged."""
    # Grams that occur once are most of all; they go before anything but the gram is shuffled with them.
    uses = rows.select("text").mapInArrow(_gram_counts(span), "gram long, uses long")
    shared = durable(uses.groupBy("gram").agg(F.sum("uses").alias("uses")).where("uses > 1"))
    made = rows.select("ka", "kb", "text").mapInArrow(_run_rows(span), "gram long, whole long, ka long, kb long, place long")
    salt = F.xxhash64("ka", "kb", "place")
    hits = durable(spread_join(made, shared, ["gram"], "uses", salt).select("gram", "whole", "ka", "kb", "place"))
    kinds = durable(hits.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("ka", "kb", "place")).alias("one")))
    crowded = durable(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd))

    cuts = None
    left = kinds
    if not crowded.isEmpty():
        left = kinds.join(crowded, "gram", "left_anti")
        # The first cut makes buckets that many times finer at least where the texts around the gram differ.
        finer = F.when(F.col("kinds") <= crowd * CUTS[0], CUTS[0]).otherwise(CUTS[1])
        busy = spread_join(kinds, crowded, ["gram"], "kinds", F.xxhash64("whole")).withColumn("cut", finer)
        cuts = _cut_verdicts(rows, busy, span, block_bytes)
    plain = _sorted(_fetched(rows, left.withColumn("cut", F.lit(1)), span), span, block_bytes).select("gram", "whole", "n", "spans")
    if cuts is not None:
        plain = plain.unionByName(cuts.join(kinds.select("gram", "whole", "n"), ["gram", "whole"]))
    plain = durable(plain)
    start = F.shiftright("place", 16)
    moved = F.transform("spans", lambda x: F.struct((x["lo"] + start).alias("lo"), (x["hi"] + start).alias("hi")))
    return spread_join(hits, plain, ["gram", "whole"], "n", salt).groupBy("ka", "kb").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _text(rows: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_packed, schema)


def kept(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of the data, and the number of maximal removed runs."""
    if not spans:
        return data, 0
    out, end, n = [], 0, 0
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if lo > end or not n:
            out.append(data[end:lo])
            n += 1
        end = max(end, hi)
    out.append(data[end:])
    return b"".join(out), n


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
            data = _unpacked(text.as_py())
            left, n = kept(data, spans.as_py())
            rows.append((doc, len(data), len(data) - len(left), n, sha256(left).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.string(),))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    ka, kb = row_keys([F.col("doc_id"), text])
    rows = documents(spark, sf_dir).select(ka.alias("ka"), kb.alias("kb"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = repeated_spans(rows)
    joined = _text(rows).join(spans, ["ka", "kb"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for was_null, text, spans in zip(batch.column("none").to_pylist(), batch.column("text"), batch.column("spans")):
            texts.append(None if was_null else kept(_unpacked(text.as_py()), spans.as_py())[0].decode("utf-8", "ignore"))
        rest = [n for n in batch.schema.names if n not in ("none", "text", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, pa.string())], [*rest, "text"])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repeated bytes cut from the text column; every row and column stays."""
    others = [c for c in docs.columns if c != text]
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if c != text and not t.startswith(("map", "struct", "array", "variant"))]
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    ka, kb = row_keys([*plain, body])
    names = [f"c{i}" for i in range(len(others))]
    rows = docs.select(ka.alias("ka"), kb.alias("kb"), *(F.col(f"`{c}`").alias(n) for c, n in zip(others, names)), F.col(text).isNull().alias("none"), body.alias("text"))
    joined = _text(rows).join(repeated_spans(rows), ["ka", "kb"], "left").drop("ka", "kb")
    schema = ", ".join([f"{n} {joined.schema[n].dataType.simpleString()}" for n in names] + ["text string"])
    back = dict(zip(others, names)) | {text: "text"}
    return joined.mapInArrow(_cut, schema).select(*(F.col(back[c]).alias(c) for c in docs.columns))
