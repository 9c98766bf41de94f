"""The pipeline's near-copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash fingerprints of all sets, met by Golay keys as in simhash.py, whether
or not they share a MinHash key. At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits,
though, and keys that reach so far would be shared by most of a large corpus; so documents meet on MinHash
keys besides: BANDS keys of DEEP least hashes each. A pair of similarity s shares a key with probability
1 - (1 - s**DEEP)**BANDS, 0.9998 at 0.8. What is proposed or meets is verified on the whole sets. Only
distinct sets take part, so a group of copies is one row.

In each of STARS rounds every document that shares a key with another component is held against one
leader, the least of its keys' by an order that changes with the round; in a group of near-copies that is
mostly the same one. What is still apart after these rounds is compared in all pairs of different
components that share a key and whose sets' sizes allow the similarity, so the result is that of all
pairs that meet. For that a key's members are dealt into blocks and every two blocks meet in a task of
their own; no pair is a row, and a pair that a task has joined already isn't compared.

Defined cases: a text of one to four words is one shingle; null and blank texts have the empty set and are
copies of each other; repeated rows and ties of doc_id leave the row with the least hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, discard_but, durable, fresh, row_keys, spread_join, word_slices, written
from .components import components

SHINGLE, SEED = 5, 42
#: Least similarity of near-copies, as a fraction.
ALIKE = (4, 5)
BANDS, DEEP = 48, 8
#: Rounds in which documents are held against a leader, before all pairs are.
STARS = 1
#: Members of a key that are compared in one task, against as many.
BLOCK = 256
_CHUNK = 4096


def shingles(data: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_digest

    found, few = [], []
    for words in word_slices(data, SHINGLE - 1):
        if len(words) < SHINGLE:
            few = words
            continue
        rows = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
        found.append(np.unique(np.frombuffer(b"".join([xxh64_digest(x, SEED) for x in rows]), dtype=">u8").astype(np.uint64)))
    if not found and few:
        found.append(np.frombuffer(xxh64_digest(b" ".join(few), SEED), dtype=">u8").astype(np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


def keys(own: np.ndarray) -> np.ndarray:
    """A key of each band (signed) for a set that isn't empty."""
    from xxhash import xxh3_64_intdigest

    g = np.random.default_rng(SEED)
    by = g.integers(0, 1 << 31, (BANDS * DEEP, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = g.integers(0, 1 << 32, (BANDS * DEEP, 1), dtype=np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * DEEP, (1 << 32) - 1, dtype=np.uint32)
    for s in range(0, len(short), _CHUNK):
        np.minimum(least, (short[s : s + _CHUNK] * by + plus).min(axis=1), out=least)
    return np.array([xxh3_64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, DEEP))], dtype=np.uint64).view(np.int64)


def fingerprint(own: np.ndarray) -> int:
    """The signed SimHash fingerprint of a set's hashes."""
    counts = simhash.bit_counts(own.astype(">u8").tobytes())
    return simhash.signed(int.from_bytes(np.packbits(2 * counts > len(own)).tobytes(), "big"))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        ids, prints, sizes, found = [], [], [], []
        for t in batch.column("text"):
            own = shingles(t.as_py() or b"")
            ids.append(xxh3_128_digest(own.tobytes()))
            sizes.append(len(own))
            prints.append(fingerprint(own) if len(own) else 0)
            found.append(keys(own) if len(own) else [])
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(ids, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], [*rest, "id", "fp", "size", "at"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t.as_py() or b"").tobytes() for t in batch.column("text")], pa.binary())], ["id", "own"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("own_a"), batch.column("own_b"))
        true = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in pairs]
        yield batch.select(["a", "b"]).filter(pa.array(true, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike; sets: (id, own) of every id."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"))
    return durable(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(_verified, "a binary, b binary"))


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """(id, at, size, root) of the members of keys whose members are in several components."""
    of = components(links).toDF("id", "root")
    named = met.join(of, "id", "left").select("id", "at", "size", F.coalesce("root", "id").alias("root"))
    split = named.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("at")
    return named.join(split, "at").select("id", "at", "size", "root")


def _proposed(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (id, fp) that SimHash and Golay keys bring together: each with the least of its fingerprint, and those of linked ones."""
    prints = durable(nodes.groupBy("fp").agg(F.min("id").alias("lead")))
    same = nodes.join(prints, "fp").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    side = lambda c: prints.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}"))
    near = simhash.links(prints.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    return same.unionByName(near).distinct()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (at, lo, hi): links that join what alike members of two blocks (or of one) join."""
    task, members = None, []

    def close():
        root = {r: r for _, r, *_ in members}

        def top(r):
            while root[r] != r:
                root[r] = r = root[root[r]]
            return r

        out = []
        sets = [np.frombuffer(own, np.uint64) for *_, own in members]
        for j, (b, rb, block_b, _) in enumerate(members):
            for i, (a, ra, block_a, _) in enumerate(members[:j]):
                n, m = len(sets[i]), len(sets[j])
                if (task[1] == task[2] or block_a != block_b) and ALIKE[1] * min(n, m) >= ALIKE[0] * max(n, m) and top(ra) != top(rb) and alike(sets[i], sets[j]):
                    root[top(rb)] = top(ra)
                    out.append((a, b))
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])] if out else []

    for batch in batches:
        for at, lo, hi, *member in zip(*(batch.column(c).to_pylist() for c in ("at", "lo", "hi", "id", "root", "block", "own"))):
            if task != (at, lo, hi):
                if members:
                    yield from close()
                task, members = (at, lo, hi), []
            members.append(member)
    if members:
        yield from close()


def _rest(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of all pairs of left (id, at, root) that share a key, are in different components and alike."""
    counts = left.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    dealt = spread_join(left, counts, ["at"], "n", F.xxhash64("id")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("id", "root", "at", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    met = met.join(sets, "id").repartition("at", "lo", "hi").sortWithinPartitions("at", "lo", "hi", "id")
    return durable(met.mapInArrow(_compared, "a binary, b binary"))


def links(proposed: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links whose components are those of all pairs that are proposed or meet and are alike.

    proposed: (a, b); met: (id, at, size) of shared keys; sets: (id, own) of the ids in either.
    """
    found, left = None, met.withColumn("root", F.col("id"))
    for turn in range(STARS):
        order = F.xxhash64("id", F.lit(turn))
        lead = left.groupBy("at").agg(F.min(F.struct(order.alias("o"), "id", "root")).alias("lead"))
        best = left.join(lead, "at").where("root != lead.root").groupBy("id").agg(F.min("lead").alias("lead"))
        pairs = best.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
        new = _links((pairs if found else pairs.unionByName(proposed)).distinct(), sets)
        found = found.unionByName(new) if found else new
        left = durable(_apart(met, found))
        if left.isEmpty():
            return found
    return found.unionByName(_rest(left, sets))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of its rows with the least doc_id one, the same each run.

    Rows are told apart by two hashes over all their columns; rows alike in every column count as one.
    """
    kinds = [F.to_json(F.struct(c)) if t.startswith(("map", "struct", "array", "variant")) else F.col(f"`{c}`") for c, t in docs.dtypes]
    known = row_keys(kinds)
    text = F.col("text").cast("binary").alias("text")
    spark, before = docs.sparkSession, written()
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("d"), known[0].alias("x"), known[1].alias("y"), text).mapInArrow(_signatures, "d long, x long, y long, id binary, fp long, size int, at array<long>"))
    name = F.struct(F.col("d").isNull().alias("n"), "d", "x", "y")
    nodes = durable(rows.groupBy("id").agg(F.min(name).alias("name"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("at").alias("at")))
    discard(spark, [rows.durable_path])
    keyed = nodes.select("id", "size", F.explode("at").alias("at"))
    met = durable(spread_join(keyed, keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["at"], "n", F.xxhash64("id")).select("id", "at", "size"))
    pairs = durable(_proposed(nodes.where("size > 0").select("id", "fp")))
    either = met.select("id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    needed = nodes.join(either, "id", "left_semi").select("id", F.col("name.x").alias("x"), F.col("name.y").alias("y"))
    texts = docs.select(known[0].alias("x"), known[1].alias("y"), text).join(needed, ["x", "y"]).select("id", "text")
    sets = durable(texts.mapInArrow(_sets, "id binary, own binary").dropDuplicates(["id"]))
    of = durable(components(links(pairs, met, sets)).toDF("id", "root"))
    stay = nodes.join(of, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("name").alias("name")).select("name.x", "name.y").distinct()
    x, y = fresh(docs, "_sim_x"), fresh(docs, "_sim_y")
    stay = durable(stay.toDF(x, y))
    discard_but(spark, before, stay)
    return docs.withColumns({x: known[0], y: known[1]}).join(stay, [x, y], "left_semi").dropDuplicates([x, y]).select(*docs.columns)
