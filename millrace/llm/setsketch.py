"""Near-duplicate documents by SetSketch registers, banded, estimated and verified.

A register holds the smallest of exponential hash values of a document's
shingles on a scale of powers of ``BASE``, truncated to 16 bits:
``floor(1 - log_b(min))``.  Registers of a union are the maxima of both sides'
registers, and two sets share a register with about the probability of their
Jaccard similarity.

Equal sets become one class first.  Classes that share a band of registers are
candidates.  Each is compared with the first class of its bucket, which joins
the thousands of copies in a hot bucket at the cost of thousands of pairs.  Only
where a bucket still spans several components are the classes outside its
largest one compared with all the others; there, parity bits of the sets bound
their difference from below before a pair leaves the join.  The registers' joint
likelihood discards hopeless pairs; the rest are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.exchange import arrow_schema, release, stored
from millrace.llm.text import Texts, fingerprints, mix, pieces, shingles

REGISTERS = 64
#: Registers in a band: similarity 0.85 shares one of 16 bands with a chance of 0.99999.
BAND = 4
BASE = 1.001
#: Rate of the exponential values; it keeps sets of a few shingles off the scale's end.
RATE = 20.0
TOP = 2**16 - 2
#: Words of 64 parity bits that bound the difference of two sets.
PARITIES = 8
#: A pair is discarded if the threshold is so many nats less likely than the best similarity.
HOPELESS = 14.0

#: Parts in which texts are sent to the documents whose full sets are compared.
PARTS = 4

#: Stands for a null doc_id where arrays can hold none.
NO_ID = -(2**63)

_SEEDS = np.random.default_rng(97).integers(1, 2**63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``n`` lower-cased words, sorted.

    With fewer words the whole sequence is one shingle, without words the set is empty.
    """
    starts, ends, firsts = texts.words()
    words = fingerprints(texts.prefix_hashes(lower=True), starts, ends)
    runs, first = shingles(words, firsts, n)
    out = []
    for i in range(len(texts)):
        own = runs[first[i] : first[i + 1]]
        count = int(firsts[i + 1] - firsts[i])
        if 0 < count < n:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[firsts[i] : firsts[i + 1]]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + w
            own = mix(np.array([whole]))
        own = np.sort(own)
        out.append(own[np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]])])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets, one row of ``REGISTERS`` each."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    keys = np.concatenate(sets)
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for i, seed in enumerate(_SEEDS):
        x = (keys ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        least = np.minimum.reduceat(x, first)
        value = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1)
    return out


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sketches' registers leave ``threshold`` a possible similarity.

    The joint likelihood of the counts of larger, smaller and equal registers is
    taken over a grid of similarities that the sizes allow.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    u = size_a / (size_a + size_b)
    v = 1 - u
    ceiling = np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        same = np.maximum(1 - up - down, 1e-12)
        return above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12)) + (
            a.shape[1] - above - below
        ) * np.log(same)

    best = np.max([score(ceiling * x) for x in np.linspace(0, 1, 41)], axis=0)
    reach = np.max([score(threshold + (ceiling - threshold) * x) for x in np.linspace(0, 1, 9)], axis=0)
    return (ceiling >= threshold) & (reach >= best - HOPELESS)


def parity(members: np.ndarray) -> np.ndarray:
    """Whether each of ``64 * PARITIES`` parts of the hash space has an odd number of members.

    Two sets differ in at least as many members as parities.
    """
    counts = np.bincount((members >> np.uint64(64 - (64 * PARITIES - 1).bit_length())).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits(counts & 1).view(np.int64)


_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary, parity array<long>"


def sketches(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, set size, a 128-bit fingerprint of the set, its registers (null if empty) and parities."""
    schema = arrow_schema(_SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = Texts.of(piece.column("text"), piece.column("doc_id"))
                sets = shingle_sets(texts, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                blobs: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, registers([sets[i] for i in full]), strict=True):
                        blobs[i] = row.tobytes()
                with np.errstate(over="ignore"):
                    sum_a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                    sum_b = np.array([mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(texts.ids),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sum_a.view(np.int64)),
                        pa.array(sum_b.view(np.int64)),
                        pa.array(blobs, pa.binary()),
                        pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(run, _SKETCH)


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, members) for the documents in ``wanted``: the sorted shingles as bytes.

    The join sends texts to their ids, so it is done in parts: files of one are let go before the next.
    """
    schema = arrow_schema("doc_id long, members binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = Texts.of(piece.column("text"), piece.column("doc_id"))
                sets = [s.tobytes() for s in shingle_sets(texts, n)]
                yield pa.RecordBatch.from_arrays([pa.array(texts.ids), pa.array(sets, pa.binary())], schema=schema)

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    found: DataFrame | None = None
    for part in range(PARTS):
        of_part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == part
        made = rows.where(of_part).join(wanted.where(of_part), "doc_id").mapInArrow(run, "doc_id long, members binary")
        made = stored(made, "sets")
        release(docs.sparkSession)
        found = made if found is None else found.unionByName(made)
    return found


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets are similar enough."""
    schema = "a long, b long"
    made = arrow_schema(schema)

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for c in ("sketch_a", "sketch_b")
                )
                sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
                keep = likely(a, b, *sizes, percent / 100)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], schema=made
            )

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(name if c == "doc_id" else f"{c}_{name}") for c in frame.columns])

    sizes = classes.select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    known = pairs.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b")
    known = known.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    left = stored(known.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(hopeful, schema), "hopeful")
    release(left.sparkSession)
    wanted = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _full_sets(docs, stored(wanted, "wanted"), n)
    with_sets = left.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    return with_sets.select("a", "b", "members_a", "members_b").mapInArrow(exact, schema)


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents (doc_id, text; other columns are not read) are linked if
    ``100 * shared >= percent * united`` of their sets of ``n``-word shingles;
    component_id is the smallest doc_id reachable, kept says it is the own one.
    An empty or null text has an empty set and is linked with nothing.  Repeated
    rows with one doc_id are one document; a null doc_id has a null component and
    stays.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = stored(sketches(docs, n), "sketches")
    classes = stored(
        known.where((F.col("n_shingles") > 0) & (F.col("doc_id") != NO_ID))
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"), F.min("parity").alias("parity")),
        "classes",
    )
    width = 2 * BAND
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(REGISTERS // BAND)])
    entries = classes.select("doc_id", "n_shingles", "parity", F.explode(bands).alias("bucket"))
    shared = stored(
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("lead")).where("size > 1"),
        "buckets",
    )
    members = stored(entries.join(shared.select("bucket", "lead"), "bucket"), "members")
    release(spark)

    stars = members.where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = stored(_confirmed(stars, classes, docs, n, percent), "links")
    reached = components(links)

    # Buckets that still span several components: the classes outside the largest one meet all others.
    labelled = stored(
        members.drop("lead")
        .join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id")),
        "members",
    )
    parts = labelled.groupBy("bucket", "component").count()
    split = stored(
        parts.groupBy("bucket")
        .agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .drop("parts"),
        "buckets",
    )
    rest = stored(labelled.join(split, "bucket"), "members")
    left = rest.where("component != largest").select(
        "bucket", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "n_shingles", "parity", "component")]
    )
    right = rest.select(
        "bucket", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n_shingles", "parity", "component", "largest")]
    )
    differ = sum(
        (F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITIES)), F.lit(0)
    )
    sizes = F.col("n_shingles_a") + F.col("n_shingles_b")
    possible = (
        (F.col("component_a") != F.col("component_b"))
        # a pair of two classes outside the largest component comes once
        & ((F.col("component_b") == F.col("largest_b")) | (F.col("doc_id_a") < F.col("doc_id_b")))
        & (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
        & (differ * (100 + percent) <= (100 - percent) * sizes)
    )
    pairs = (
        left.alias("l")
        .join(right.alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & possible)
        .select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
        .distinct()
    )
    more = stored(_confirmed(pairs, classes, docs, n, percent), "links")
    if not more.isEmpty():
        reached = components(links.union(more))
    reached = stored(
        classes.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "set_a", "set_b", "n_shingles", F.coalesce("component", "doc_id").alias("component")
        ),
        "reached",
    )
    own = F.nullif("doc_id", F.lit(NO_ID))
    return known.join(reached, ["set_a", "set_b", "n_shingles"], "left").select(
        own.alias("doc_id"),
        "n_shingles",
        F.when(F.col("doc_id") != NO_ID, F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id") == NO_ID, True).otherwise(F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those that are linked to one with a smaller doc_id."""
    verdicts = near_duplicates(docs.select("doc_id", "text"), n, percent)
    gone = stored(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "duplicates")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
