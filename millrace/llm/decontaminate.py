"""Benchmark passages in documents, by SimHash of item-sized windows.

Words are runs of letters and digits, lower-cased; shingles are five words.  A
window has as many shingles as the item it is held against.  Windows that share
no shingle with an item have no similarity to it, so only those are
fingerprinted that a shared shingle aligns with an item.  Fingerprints meet
items by multi-index hashing: if two of 64 bits differ in at most ``RADIUS``
places, one of their eight bytes differs in at most one, so each item is filed
under all bytes within one bit.  Candidates within the radius are verified by
exact similarity of their shingles, weighted by how often each occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import stored

SHINGLE = 5
#: Similarity 0.8 has an expected distance below 10; 15 lies two standard deviations beyond.
RADIUS = 15
BYTES = 8
#: Up to so many item shingles (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        )
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]


def _simhash(shingles: Column) -> Column:
    """64 bits: of each, whether more shingles have it set than not."""

    def bit(b: int) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda a, x: a + F.shiftright(x, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
        return F.when(votes > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return out


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags."""

    def often(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    both = F.array_union(a, b)
    least = F.aggregate(both, F.lit(0), lambda s, x: s + F.least(often(a, x), often(b, x)))
    most = F.aggregate(both, F.lit(0), lambda s, x: s + F.greatest(often(a, x), often(b, x)))
    return least / most


def _byte(value: Column, i: int) -> Column:
    return F.shiftright(value, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start): passages of items in documents, the most similar of each pair.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    not read.  start is the passage's first word.  Texts and items of less than
    five words, null or empty, match nothing.  Equal items all match; equal
    documents give a row each; repeated rows of one doc_id give one.
    """
    filed = items.select("item_id", _shingles(F.col("text")).alias("bag"))
    filed = stored(filed.where(F.size("bag") > 0).withColumn("m", F.size("bag")), "items")
    ahead = filed.select(F.posexplode("bag").alias("offset", "shingle"), "m", "bag")
    aligned = stored(
        ahead.select("offset", "shingle", "m", F.get("bag", F.col("offset") - 1).alias("before")).distinct(), "items"
    )

    if aligned.count() <= BROADCAST_ROWS:  # many small files can hide from the planner how small it is
        aligned = F.broadcast(aligned)

    # One pass over the corpus: shared shingles and the window each aligns.
    texts = docs.select("doc_id", _shingles(F.col("text")).alias("bag"))
    # Of a run of shared shingles with one alignment the first is enough.
    hits = (
        texts.select("doc_id", "bag", F.posexplode("bag").alias("place", "shingle"))
        .join(aligned, "shingle")
        .where(F.col("before").isNull() | ~F.get("bag", F.col("place") - 1).eqNullSafe(F.col("before")))
    )
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), F.size("bag") - F.col("m")))
    windows = hits.select("doc_id", "m", start.alias("start"), F.slice("bag", start + 1, F.col("m")).alias("bag"))
    windows = stored(windows.withColumn("content", F.xxhash64("bag")).dropDuplicates(["doc_id", "m", "start", "content"]), "windows")

    # Each content is fingerprinted once, however many documents hold it.
    contents = windows.groupBy("m", "content").agg(F.min("bag").alias("bag"))
    contents = stored(contents.withColumn("print", _simhash(F.col("bag"))), "contents")
    bytes_of = F.array(*[F.struct(F.lit(i).alias("i"), _byte(F.col("print"), i).alias("byte")) for i in range(BYTES)])
    probes = contents.select("m", "content", "print", F.inline(bytes_of))
    near = F.array(
        *[
            F.struct(F.lit(i).alias("i"), _byte(F.col("item_print"), i).bitwiseXOR(F.lit(flip)).alias("byte"))
            for i in range(BYTES)
            for flip in (0, *(1 << k for k in range(8)))
        ]
    )
    index = stored(filed.withColumn("item_print", _simhash(F.col("bag"))), "items")
    index_rows = stored(index.select("item_id", "m", "item_print", F.inline(near)), "items")
    close = (
        probes.join(index_rows, ["m", "i", "byte"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("m", "content", "item_id")
        .distinct()
    )
    verified = (
        close.join(contents.select("m", "content", "bag"), ["m", "content"])
        .join(index.select("item_id", "m", F.col("bag").alias("item_bag")), ["item_id", "m"])
        .select("m", "content", "item_id", _similarity(F.col("bag"), F.col("item_bag")).alias("similarity"))
        .where(F.col("similarity") >= similarity)
        .distinct()
    )
    return (
        windows.select("doc_id", "m", "start", "content")
        .join(stored(verified, "verified"), ["m", "content"])
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("similarity").alias("similarity"),
            F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).cast("long").alias("start"),
        )
    )


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, in which no item is found."""
    found = stored(find_leaks(docs, items, similarity).select(F.col("doc_id").alias("_leaked")).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_leaked")), "left_anti")
