"""Mixing sources by temperature: weights from token shares, realised as block permutations.

The weight of a source is its share of all tokens to the power of an exponent
between 0 (all alike) and 1 (as they are).  The exponent is searched for by
repeated section, many points in one pass over the sources, until the mix meets
a target entropy or a limit of repetitions.  A source's budget is spent in whole
epochs and a last part: its blocks in a random order until the budget is used,
and the documents of the block at the edge in a random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.exchange import stored

#: Blocks of a source; the one at a budget's edge is the only one that is sorted.
BLOCKS = 4096
#: Points between two exponents in one pass, and passes.
POINTS, PASSES = 64, 5

_WORD = "[^\\x20\\x09-\\x0D]+"


def token_shares(docs: DataFrame) -> DataFrame:
    """(source, tokens, share) of each source with a token; ``docs`` has source and tokens."""
    sums = docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = F.sum("tokens").over(Window.partitionBy())
    return sums.withColumn("share", F.col("tokens") / total)


def _measure(shares: DataFrame, low: float, high: float) -> DataFrame:
    """Entropy and most repetitions of the mix at ``POINTS + 1`` exponents."""
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda i: low + (high - low) * i / POINTS)
    powers = shares.select("share", F.explode(points).alias("exponent"))
    raised = F.pow("share", "exponent")
    return powers.groupBy("exponent").agg(
        # entropy of w = p^t / z is log z - sum(p^t log p^t) / z
        (F.log(F.sum(raised)) - F.sum(raised * F.col("exponent") * F.log("share")) / F.sum(raised)).alias("entropy"),
        (F.max(raised / F.col("share")) / F.min(raised / F.col("share"))).alias("repeats"),
    )


def find_exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The smallest exponent whose entropy is at most ``entropy`` nats and whose repetitions keep to ``repeats``.

    Both fall as the exponent grows.  An entropy below that of the shares
    themselves can't be met and gives 1, as do shares without a source.
    """
    low, high = 0.0, 1.0
    meets = F.lit(True)
    if entropy is not None:
        meets = meets & (F.col("entropy") <= entropy + 1e-12)
    if repeats is not None:
        meets = meets & (F.col("repeats") <= repeats + 1e-12)
    for _ in range(PASSES):
        found = (
            _measure(shares, low, high)
            .agg(F.min(F.when(meets, F.col("exponent"))).alias("high"), F.max(F.when(~meets, F.col("exponent"))).alias("low"))
            .first()
        )
        if found["high"] is None:
            return 1.0
        if found["low"] is None or found["low"] > found["high"]:
            return found["high"]
        low, high = found["low"], found["high"]
    return high


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def mixed(
    docs: DataFrame,
    entropy: float | None = None,
    repeats: float | None = 2.0,
    budget: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """One row per document and copy: doc_id, source, n_tokens, copy, weight, epoch_key.

    ``docs`` has doc_id, text and source; other columns are not read.  ``budget``
    is the number of tokens of the mix; without one it is the least that shows
    every document at least once.  Rows in the order of (copy, epoch_key, doc_id)
    go through a source block by block.  A source's last part ends with the last
    document that fits its budget.  Tokens are words; a text without any, null or
    empty, costs nothing and comes once.  A null source is a source.  Repeated
    rows are documents of their own; an empty table gives an empty result.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("tokens"),
        F.pmod(_key(F.lit(seed), "doc_id"), F.lit(BLOCKS)).cast("int").alias("block"),
    )
    rows = stored(rows, "tokens")
    shares = stored(token_shares(rows), "shares")
    exponent = find_exponent(shares, entropy, repeats)
    raised = F.pow("share", F.lit(exponent))
    everything = Window.partitionBy()
    weights = shares.select(
        "source",
        "tokens",
        (raised / F.sum(raised).over(everything)).alias("weight"),
        (F.sum("tokens").over(everything)).alias("total"),
        (F.min(raised / F.col("share")).over(everything)).alias("least"),
        (raised / F.col("share")).alias("gain"),
    )
    quota = F.col("gain") / F.col("least") * F.col("tokens") if budget is None else F.lit(float(budget)) * F.col("weight")
    quotas = stored(
        weights.select("source", "tokens", "weight", F.round(quota).cast("long").alias("quota")).select(
            F.col("source").alias("_source"),
            "weight",
            F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("epochs"),
            (F.col("quota") % F.col("tokens")).alias("rest"),
        ),
        "quotas",
    )
    # Which blocks the last part of a source takes whole, and which one it ends in.
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    order = Window.partitionBy("_source").orderBy(F.col("turn"), F.col("block"))
    plan = stored(
        blocks.join(quotas, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_source", F.col("source"))
        .withColumn("turn", _key(F.lit(seed), F.col("epochs"), "source", "block"))
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(
            "_source",
            F.col("block").alias("_block"),
            F.coalesce("epochs", F.lit(1)).alias("epochs"),
            "weight",
            F.coalesce(F.col("upto") <= F.col("rest"), F.lit(False)).alias("whole"),
            F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")), F.col("rest") - F.col("upto") + F.col("size")).alias("left"),
        ),
        "blocks",
    )
    planned = rows.join(
        plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "inner"
    ).withColumn("turn", _key(F.lit(seed + 1), F.col("epochs"), "doc_id"))
    edge = Window.partitionBy("source").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = planned.where("left IS NULL").withColumn("last", F.col("whole").cast("int"))
    at_edge = planned.where("left IS NOT NULL").withColumn("last", (F.sum("tokens").over(edge) <= F.col("left")).cast("int"))
    once = F.when(F.col("tokens") == 0, 1).otherwise(F.col("epochs") + F.col("last"))
    copies = inside.unionByName(at_edge).withColumn("copies", once).where("copies > 0")
    return copies.select(
        "doc_id",
        "source",
        F.col("tokens").alias("n_tokens"),
        "weight",
        "block",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
    ).select("doc_id", "source", "n_tokens", "copy", "weight", _key(F.lit(seed), F.col("copy"), "source", "block").alias("epoch_key"))


