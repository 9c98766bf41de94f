"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints that differ in at
most two bits agree in one whole segment, and in every other segment they share a Golay key (see
golay.py); a whole segment with one neighbour's Golay key is what they meet on. Fingerprints that
meet are verified. Only distinct fingerprints take part, so a group of copies is one row here.

A key on which more than CAP fingerprints meet is dealt anew by the third segment's Golay keys; what
is crowded even then is linked exactly through the 65 points within one bit of each fingerprint, of
which two linked ones always share one and each of which at most 65 fingerprints share.

Defined cases: a null or empty text, or one of blanks alone, has fingerprint zero and links like any
other; repeated rows are members of one component; a component is named by its least doc_id (null
only if all its doc_ids are null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import documents, durable, word_slices
from .components import components

SHINGLE, SEED, LINK_BITS = 3, 42, 2
#: (lowest bit, bits) of the segments.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: For each whole segment the neighbour that gives the Golay key, and the third one.
NEIGHBOURS = ((1, 2), (0, 2), (0, 1))
CAP = 64


#: Hashes whose bits are counted at a time: 64 bytes each.
COUNTED = 1 << 16


def bit_counts(hashes: bytes) -> np.ndarray:
    """How many of the hashes of eight bytes have each bit set, the highest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for s in range(0, len(hashes), 8 * COUNTED):
        part = np.frombuffer(hashes[s : s + 8 * COUNTED], dtype=np.uint8)
        n = len(part) // 8
        lanes = np.unpackbits(part).view(np.uint64).reshape(n, 8)  # eight counters to a lane of 64 bits
        total += np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    from xxhash import xxh64_digest

    counts, n, few = np.zeros(64, dtype=np.int64), 0, []
    for words in word_slices(data, SHINGLE - 1):
        if len(words) < SHINGLE:
            few = words
            continue
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
        counts += bit_counts(b"".join([xxh64_digest(x, SEED) for x in shingles]))
        n += len(shingles)
    if not n:
        if not few:
            return 0
        counts, n = bit_counts(xxh64_digest(b" ".join(few), SEED)), 1
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signed(fingerprint(t.as_py() or b"")) for t in batch.column("text")]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.int64())], [*rest, "fp"])


def fingerprints(docs: DataFrame, text, *columns) -> DataFrame:
    """The named columns and fp (the fingerprint as a signed long) of every row."""
    picked = docs.select(*columns, text.cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.drop("text").schema.fields)
    return picked.mapInArrow(_fingerprints, f"{schema}, fp long")


def _segment(fp: np.ndarray, which: int) -> np.ndarray:
    low, bits = SEGMENTS[which]
    return (fp >> np.int64(low)) & np.int64((1 << bits) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for whole, (near, _) in enumerate(NEIGHBOURS):
            row, key = golay.keys(_segment(fp, near))
            at = np.int64(whole) << np.int64(40) | _segment(fp, whole)[row] << np.int64(12) | key
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fp[row])], ["at", "fp"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A crowded key's members with a key of the third segment beside the first."""
    for batch in batches:
        at, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "fp"))
        for whole, (_, third) in enumerate(NEIGHBOURS):
            own = np.flatnonzero(at >> np.int64(40) == whole)
            row, key = golay.keys(_segment(fp[own], third))
            yield pa.RecordBatch.from_arrays([pa.array(at[own][row] << np.int64(12) | key), pa.array(fp[own][row])], ["at", "fp"])


def forest(members: list[int]) -> list[tuple[int, int]]:
    """Links that join whatever verified links join; a pair already joined isn't compared."""
    root = list(range(len(members)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for j in range(1, len(members)):
        for i in range(j):
            a, b = top(i), top(j)
            if a != b and (members[i] ^ members[j]).bit_count() <= LINK_BITS:
                root[b] = a
                out.append((members[i], members[j]))
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by at: (a, b, null) for links among a key's members, (fp, null, at) if crowded."""
    names = ["a", "b", "at"]
    left: list[int] = []  # members of the key that the last batch ended in, CAP + 1 at most
    left_at, crowded = None, False
    schema = pa.schema([(n, pa.int64()) for n in names])

    def close():
        return [(a, b, None) for a, b in forest([x & (1 << 64) - 1 for x in left])] if not crowded and len(left) > 1 else []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([None if x is None else signed(x & (1 << 64) - 1) for x in c], pa.int64()) for c in zip(*rows)], schema=schema)

    for batch in batches:
        at, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "fp"))
        if not len(at):
            continue
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        rows = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if left_at != (key := int(at[s])):
                rows += close()
                left, left_at, crowded = [], key, False
            if e - s == 1 and e < len(at) and not left and not crowded:  # alone
                continue
            left += fp[s:e].tolist()
            if len(left) > CAP or crowded:
                crowded = True
                rows += [(x, None, key) for x in left]
                left = []
        if rows:
            yield batch_of(rows)
    if rows := close():
        yield batch_of(rows)


def _met(keyed: DataFrame) -> DataFrame:
    return durable(keyed.repartition("at").sortWithinPartitions("at", "fp").mapInArrow(_meet, "a long, b long, at long"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all fingerprints fp that differ in two bits at most."""
    met = _met(distinct.mapInArrow(_keys, "at long, fp long"))
    found = met.where("b IS NOT NULL").select("a", "b")
    crowded = met.where("b IS NULL").select("at", F.col("a").alias("fp"))
    if crowded.isEmpty():
        return found
    met = _met(crowded.mapInArrow(_finer, "at long, fp long"))
    found = found.unionByName(met.where("b IS NOT NULL").select("a", "b"))
    crowded = met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    points = crowded.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("point"))
    stars = points.groupBy("point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return found.unionByName(stars.select(F.explode("near").alias("a"), F.array_min("near").alias("b")))


def component_of(nodes: DataFrame) -> DataFrame:
    """(fp, name) for every distinct fp of nodes (fp, name): the least name of its component."""
    nodes = nodes.select("fp", "name")
    joined = components(links(nodes.select("fp")))
    member = joined.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(joined.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    named = member.join(nodes, "fp")
    least = named.groupBy("root").agg(F.min("name").alias("least"))
    of = member.join(least, "root").select("fp", "least")
    return nodes.join(of, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("name")).otherwise(F.col("least")).alias("name"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    rows = durable(fingerprints(docs, F.col("text"), F.col("doc_id").cast("long").alias("doc_id")))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("name")))
    return rows.join(component_of(nodes), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("name").alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
