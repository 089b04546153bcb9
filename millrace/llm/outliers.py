"""Quality rules: counts of a text, and robust outliers among its transformed statistics.

Each language and source gets a minimum-covariance-determinant estimate: the
mean and covariance of the three quarters of its documents that lie nearest to
it, found by concentration steps.  A document whose Mahalanobis distance from
its group is beyond a quantile of the chi-square distribution is rejected.

All of it is DataFrame expressions.  Statistics are whole numbers (thousandths),
so sums do not depend on the order of tasks; the nearest part of a group is cut
in a histogram of distances, whose bins are bounded, so that a group with a
third of all documents is never sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.exchange import stored

#: Part of a group that its estimate is taken from.
NEAREST = 0.75
STEPS = 3
#: Groups of fewer documents use their language's estimate, or that of all documents.
LEAST_GROUP = 100
#: Chance of a clean document to lie beyond the cut, were its statistics normal.
BEYOND = 1e-5

#: Statistic and the least standard deviation (thousandths) that counts as its spread: what one
#: more letter, symbol, capital or repeated line changes in a text of 100 words.
FLOORS = {"x_length": 2, "x_symbols": 88, "x_capitals": 8, "x_repeats": 88}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = "[\\x20\\x09-\\x0D]+"
_BINS = 25.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the list holds twice or more."""

    def doubled(hashes: Column, step: int) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.size(hashes) - step),
            lambda x, i: F.xxhash64(x, F.get(hashes, i + step)),
        )

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda p, k: (F.get(pairs, k - 1)["x"] == p["x"]) | (F.get(pairs, k + 1)["x"] == p["x"]),
            )
            return F.sort_array(F.transform(twice, lambda p: p["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(8), F.coalesce(F.get(at, k + 1) - p, F.lit(8))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(ordered, places), total)

    def of(hashes: Column) -> Column:
        eight = _let(_let(doubled(hashes, 1), lambda h: doubled(h, 2)), lambda h: doubled(h, 4))
        return _let(
            eight, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0))
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 8, _let(hashed, of)).otherwise(F.lit(0)).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """The frame with the counts of its texts, ``base_failed`` and the statistics.

    A null text counts as an empty one.  Columns with the names of counts are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.select(
        *[F.col(c) for c in docs.columns if c not in {*COUNTS, *FLOORS, "base_failed"}],
        _let(
            words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
        ).alias("_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("_capitals"),
    )
    n = F.col("_words.n_words")
    repeats = F.col("_words.n_repeat_words")

    def thousandths(x: Column) -> Column:
        return F.round(1000 * x).cast("long")

    # Short texts are drawn towards a common value, as their shares say little.
    return counted.select(
        *[c for c in counted.columns if c not in ("_words", "_capitals")],
        n.alias("n_words"),
        repeats.alias("n_repeat_words"),
        ((n < 20) | (100 * repeats > 30 * n)).alias("base_failed"),
        thousandths(F.log((F.col("word_chars") + 165) / (n + 30))).alias("x_length"),
        thousandths(F.sqrt(F.col("n_symbols") / (n + 30))).alias("x_symbols"),
        thousandths(F.sqrt((F.col("_capitals") + 5) / (F.col("word_chars") + 200))).alias("x_capitals"),
        thousandths(F.sqrt((repeats + F.col("n_dup_lines")) / (n + 30))).alias("x_repeats"),
    )


def _chi(x: float, half: int) -> float:
    """Chi-square distribution of 2 * half degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _quantile(p: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi(middle, half) < p else (low, middle)
    return high


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by the columns ``m_*`` and the Cholesky rows ``c_*``."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        value = F.col(name) - F.col(f"m_{name}")
        for k in range(i):
            value = value - F.col(f"c_{i}_{k}") * solved[k]
        solved.append(value / F.col(f"c_{i}_{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _factored(moments: DataFrame, names: list[str], keep: list[str], scale: float) -> DataFrame:
    """Means and the Cholesky factor of the covariance from counts, sums and products."""
    n = F.col("n").cast("double")
    out = moments.select(*keep, "n", *[(F.col(f"s_{a}") / n).alias(f"m_{a}") for a in names], *[
        (F.col(f"p_{i}_{j}") / n - (F.col(f"s_{names[i]}") / n) * (F.col(f"s_{names[j]}") / n)).alias(f"v_{i}_{j}")
        for i in range(len(names))
        for j in range(i + 1)
    ])
    for i, name in enumerate(names):
        for j in range(i + 1):
            value = F.col(f"v_{i}_{j}") * scale
            if i == j:
                value = F.greatest(value, F.lit(float(FLOORS[name] ** 2)))
            for k in range(j):
                value = value - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
            root = F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / F.col(f"c_{j}_{j}")
            out = out.withColumn(f"c_{i}_{j}", root)
    return out.drop(*[f"v_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])


def _groups(counted: DataFrame) -> DataFrame:
    """(lang, source, grp): the group whose estimate judges these documents."""
    pairs = counted.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    small = F.col("n") < LEAST_GROUP
    of_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    part = (
        F.when(~small, F.to_json(F.struct("lang", "source")))
        .when(F.col("of_lang") >= LEAST_GROUP, F.to_json(F.struct("lang")))
        .otherwise(F.lit("rest"))
    )
    return stored(pairs.withColumn("of_lang", of_lang).select("lang", "source", part.alias("grp")), "groups")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the columns that ``groups`` has for their language and source, null or not."""
    named = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(named, same, "left").drop("_lang", "_source")


def fit(counted: DataFrame) -> DataFrame:
    """The estimate of each language and source: lang, source, means and Cholesky rows.

    ``counted`` has lang, source, base_failed and the statistics; documents that
    fail the base rules are not learnt from.  Groups below ``LEAST_GROUP``
    documents are pooled by language, and what is then still below it in one
    pool; if that is too small, its documents have no estimate.  Null
    languages and sources are groups of their own.
    """
    names = list(FLOORS)
    groups = _groups(counted)
    rows = stored(
        _with_group(counted.where(~F.col("base_failed")).select("lang", "source", *names), groups).select("grp", *names),
        "statistics",
    )
    # Statistics are small whole numbers, so exact quantiles count bounded values.
    quarters = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile(F.round(F.col(a), -1), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{a}") for a in names],
    )
    start = []
    for i, a in enumerate(names):
        spread = F.greatest((F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349, F.lit(float(FLOORS[a])))
        start += [F.col(f"q_{a}")[1].alias(f"m_{a}"), *[F.lit(0.0).alias(f"c_{i}_{j}") for j in range(i)], spread.alias(f"c_{i}_{i}")]
    estimates = stored(quarters.where(F.col("n") >= LEAST_GROUP).select("grp", *start), "estimates")
    degrees = len(names) // 2
    scale = NEAREST / _chi(_quantile(NEAREST, degrees), degrees + 1)
    for _ in range(STEPS):
        binned = rows.join(estimates, "grp").select(
            "grp", *names, F.floor(_BINS * F.log(1 + _distance(names))).cast("int").alias("bin")
        )
        # The distance below which three quarters of the group lie, from counts of its bins.
        counts = binned.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("grp").orderBy("bin")
        cut = stored(
            counts.select(
                "grp", "bin", F.sum("n").over(order).alias("below"), F.sum("n").over(Window.partitionBy("grp")).alias("all")
            )
            .where(F.col("below") >= NEAREST * F.col("all"))
            .groupBy("grp")
            .agg(F.min("bin").alias("last")),
            "cuts",
        )
        sums = [F.sum(a).alias(f"s_{a}") for a in names] + [
            F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(len(names)) for j in range(i + 1)
        ]
        moments = (
            binned.join(cut, "grp").where("bin <= last").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums)
        )
        estimates = stored(_factored(moments, names, ["grp"], scale).drop("n"), "estimates")
    return stored(groups.join(estimates, "grp").drop("grp"), "estimates")


def judged(counted: DataFrame, estimates: DataFrame) -> DataFrame:
    """Counts with ``distance`` (squared, null without an estimate) and ``kept``."""
    names = list(FLOORS)
    limit = _quantile(1 - BEYOND, len(names) // 2)
    out = _with_group(counted, estimates).withColumn("distance", _distance(names))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= limit))
    extra = [c for c in estimates.columns if c not in ("lang", "source")]
    return out.withColumn("kept", kept).drop(*extra)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, its counts, base_failed, distance and kept.

    ``docs`` has doc_id, text, lang and source; other columns are not read.  A
    null or empty text has no words and fails the base rules, as any text of less
    than 20 words or with over 30 % of its words in repeated windows does.  Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    counted = stored(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "counts")
    return judged(counted, fit(counted)).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules and their group's estimate keep.

    The counts are made a second time below the filter, which costs less than
    shuffling the texts to meet their verdicts.
    """
    counted = stored(with_counts(docs.select("text", "lang", "source")).drop("text"), "counts")
    # the document stays whole beside what is counted, so no name of its columns can clash
    whole = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"))
    return judged(with_counts(whole), fit(counted)).where("kept").select("_document.*")
