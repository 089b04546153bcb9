"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, of toxic and of ordinary labelled texts, give each word its
probability after the word before it.  Both hand what they discount to one
Kneser-Ney model of both classes: discounted pairs over the share of contexts
that a word is found in.  A class keeps of its own counts only what goes beyond
the share it would have of any expression, so a rare expression, or one that is
about as common in both, has the same probability in either and tells nothing.
The difference of the log-likelihoods per word, calibrated on labelled texts
that the models have not seen, is the score.

Every labelled row is counted, by batches of texts that exchange their distinct
pairs, words and contexts for the totals; no table is ever in one place.  A word
tells something only where it, or the pair it ends, goes beyond its class's share;
anywhere else both classes give it one probability.  A filter of fixed size says
where that may be, and of all documents only those places ask for their counts:
what it lets through in vain costs a question and adds nothing to a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import (
    BATCH_ARROW,
    BATCH_SCHEMA,
    Batch,
    answer,
    apply,
    arrow_schema,
    bucket_bits,
    pack,
    packed,
    release,
    replies,
    send,
    stored,
    total_bytes,
    unpacked,
)
from millrace.llm.text import Texts, fingerprints, mix, own_ids, pieces

#: Labelled rows to learn from, at most, for trials; None: all of them.
SAMPLE: int | None = None
DISCOUNT = 0.75
#: Of the way from a class's share of all text to the whole, what its share of an expression must exceed.
MARGIN = 0.5
#: Weights of a class's own pairs and words; the shared model has what they leave.
OWN_PAIRS, OWN_WORDS = 0.1, 0.5
#: Bins of the mean difference that the calibration counts.
BINS, SPAN = 20000, 4.0
#: Stands before the first word of a text.
START = np.uint64(1)
#: Bytes of a fingerprint that travel, beside its bucket.
WIDTH = 6
#: Keys of words and of contexts are told from each other, and from pairs, by these.
AS_WORD, AS_CONTEXT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: The bit of a reply that says a batch is the first to have a key, and where the upper count begins.
FIRST_BIT, HALF = np.uint64(63), np.uint64(32)
#: Bits of a place in the filter of telling keys, and of a slice of it.
FILTER_BITS, SLICE_BITS = 26, 6
#: Places and texts that are one batch when all documents are scored.
PLACES = 1 << 20


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word before each, keys of both together, and each text's first word."""
    starts, ends, firsts = texts.words()
    # punctuation that clings to a word is part of it, as in the reading of words everywhere here
    words = fingerprints(texts.prefix_hashes(lower=True), starts, ends)
    before = np.concatenate([words[:1], words[:-1]])
    before[firsts[:-1][firsts[:-1] < len(words)]] = START
    return words, before, mix(before * np.uint64(0x9E3779B97F4A7C15) + words), firsts


_COUNTED = "words binary, before binary, counts binary"


def _counts(rows: DataFrame) -> DataFrame:
    """Rows (text, label): the distinct pairs of words of each piece, with their counts in both classes."""
    schema = arrow_schema(_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, before, pairs, firsts = _tokens(Texts.of(piece.column("text")))
                label = np.repeat(piece.column("label").to_numpy(), np.diff(firsts))
                _, at, place = np.unique(pairs, return_index=True, return_inverse=True)
                counts = np.stack([np.bincount(place, label == k, len(at)) for k in (0, 1)]).astype(np.uint32)
                row = [words[at].tobytes(), before[at].tobytes(), counts.tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    return rows.mapInArrow(run, _COUNTED)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key asked for is among the sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _beyond(own: np.ndarray, both: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """What is left of a class's count after the discount and the share that proves nothing."""
    return np.maximum(own - DISCOUNT - (share + MARGIN * (1 - share)) * both, 0)


def _own_parts(pairs: np.ndarray, contexts: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each class's own weighted probability of a word, from counts by class: of its pair, its context, itself, all."""
    out = []
    for k in (0, 1):
        pair = _beyond(pairs[k], pairs.sum(0), contexts[k] / np.maximum(contexts.sum(0), 1)) / np.maximum(contexts[k], 1)
        one = _beyond(words[k], words.sum(0), sizes[k] / max(sizes.sum(), 1.0)) / max(sizes[k], 1.0)
        out.append(OWN_PAIRS * pair + OWN_WORDS * one)
    return np.stack(out)


def _shared_part(
    pairs: np.ndarray, contexts: np.ndarray, followers: np.ndarray, preceders: np.ndarray, kinds_of_words: int, kinds_of_pairs: int
) -> np.ndarray:
    """The weighted Kneser-Ney probability that both classes share, from counts of both together."""
    # contexts a word is found in, discounted, with one share for each known word and one for all others
    spread = max(kinds_of_pairs, 1.0)
    floor = DISCOUNT * max(kinds_of_words, 1) / (kinds_of_words + 2) / spread  # the start is a known word too
    lower = np.maximum(preceders - DISCOUNT, 0) / spread + floor
    rest = np.where(contexts > 0, DISCOUNT * followers / np.maximum(contexts, 1), 1.0)
    return (1 - OWN_PAIRS - OWN_WORDS) * (np.maximum(pairs - DISCOUNT, 0) / np.maximum(contexts, 1) + rest * lower)


@dataclass
class Model:
    """The model of few texts, in one place: counts of both classes by word and by pair."""

    words: np.ndarray  # sorted fingerprints of words, the start of a text among them
    unigrams: np.ndarray  # by class and word
    contexts: np.ndarray  # by class and word: how often it stands before another
    followers: np.ndarray  # by word: kinds of words that follow it in either class
    preceders: np.ndarray  # by word: kinds of words that stand before it in either class
    pairs: np.ndarray  # sorted fingerprints of pairs
    counts: np.ndarray  # by class and pair

    def likelihoods(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of each word in both classes, and each text's first word."""
        words, before, pairs, firsts = _tokens(texts)
        at, known = _found(self.pairs, pairs)
        seen = np.where(known, self.counts[:, at].astype(float), 0.0) if len(self.pairs) else np.zeros((2, len(pairs)))
        (word, has_word), (ctx, has_ctx) = _found(self.words, words), _found(self.words, before)
        total = np.where(has_ctx, self.contexts[:, ctx], 0.0)
        kinds = np.where(has_ctx, self.followers[ctx], 0.0)
        own_words = np.where(has_word, self.unigrams[:, word], 0.0)
        own = _own_parts(seen, total, own_words, self.unigrams.sum(1))
        preceders = np.where(has_word, self.preceders[word], 0.0)
        kinds_of_words, kinds_of_pairs = (self.preceders > 0).sum(), self.preceders.sum()
        return np.log(own + _shared_part(seen.sum(0), total.sum(0), kinds, preceders, kinds_of_words, kinds_of_pairs)), firsts

    def difference(self, texts: Texts) -> np.ndarray:
        """Mean log-likelihood of each text's words as toxic, less that as ordinary; 0 without words."""
        logs, firsts = self.likelihoods(texts)
        sums = np.concatenate([[0.0], np.cumsum(logs[1] - logs[0])])
        return (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(np.diff(firsts), 1)


def train(rows: DataFrame) -> Model:
    """The counts of rows (text, label), label 1 is toxic, that fit the driver: what exchanges count is held against it."""
    found = _counts(rows).collect()

    def gathered(name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r[name], np.uint64) for r in found]])

    words, before = gathered("words"), gathered("before")
    counts = np.concatenate([np.zeros((2, 0), np.uint32), *[np.frombuffer(r["counts"], np.uint32).reshape(2, -1) for r in found]], 1)
    del found
    pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
    order = np.argsort(pairs)
    pairs = pairs[order]
    new = np.flatnonzero(np.concatenate([pairs[:1] == pairs[:1], pairs[1:] != pairs[:-1]]))
    pairs = pairs[new]
    counts = np.stack([np.add.reduceat(c[order], new) if len(new) else c for c in counts])
    words, before = words[order[new]], before[order[new]]
    del order, new
    known = np.unique(np.concatenate([[START], words]))
    word, context = np.searchsorted(known, words), np.searchsorted(known, before)

    def by(index: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(index, weights, len(known)).astype(np.float32)

    return Model(
        known,
        np.stack([by(word, c) for c in counts]),
        np.stack([by(context, c) for c in counts]),
        by(context),
        by(word),
        pairs,
        counts.astype(np.uint16 if counts.size and counts.max() < 1 << 16 else np.uint32),
    )


def _times(marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How often each text is labelled ordinary and toxic."""
    read = np.frombuffer(marks, np.int64)
    return read & ((1 << 31) - 1), read >> 31


@dataclass
class _Places:
    """Distinct pairs of a batch with their words and contexts, and the keys that all three travel by."""

    firsts: np.ndarray
    place: np.ndarray  # of each word of the batch, its pair
    pairs: np.ndarray
    words: np.ndarray
    word_of: np.ndarray  # of each pair
    contexts: np.ndarray
    context_of: np.ndarray  # of each pair
    order: np.ndarray  # of the keys of pairs, words and contexts, one behind the other
    keys: np.ndarray  # sorted

    @classmethod
    def of(cls, texts: Texts) -> _Places:
        words, before, pairs, firsts = _tokens(texts)
        pairs, at, place = np.unique(pairs, return_index=True, return_inverse=True)
        words, word_of = np.unique(words[at], return_inverse=True)
        contexts, context_of = np.unique(before[at], return_inverse=True)
        keys = np.concatenate([pairs, mix(words ^ AS_WORD), mix(contexts ^ AS_CONTEXT)])
        order = np.argsort(keys)
        return cls(firsts, place, pairs, words, word_of, contexts, context_of, order, keys[order])


def _sizes(batches: DataFrame) -> np.ndarray:
    """Words of all labelled texts, by class."""
    kind = "ordinary long, toxic long"
    schema = arrow_schema(kind)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for batch in unpacked(table):
                n = np.diff(batch.texts.words()[2])
                sums = [[int((n * x).sum())] for x in _times(batch.extra)]
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in sums], schema=schema)

    row = batches.mapInArrow(run, kind).agg(F.sum("ordinary"), F.sum("toxic")).first()
    return np.array([row[0] or 0, row[1] or 0], float)


def _class_counts(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """A batch's keys with how often its labelled texts have each: toxic ones in the upper half."""
    places = _Places.of(batch.texts)
    out = np.zeros(len(places.keys), np.uint64)
    for counts, shift in zip(_times(batch.extra), (0, HALF), strict=True):
        each = np.repeat(counts, np.diff(places.firsts)).astype(float)
        of_pair = np.bincount(places.place, each, len(places.pairs))
        of_word = np.bincount(places.word_of, of_pair, len(places.words))
        of_context = np.bincount(places.context_of, of_pair, len(places.contexts))
        out |= np.concatenate([of_pair, of_word, of_context]).astype(np.uint64) << np.uint64(shift)
    return places.keys, out[places.order]


def _class_totals(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Totals of all batches; the first batch that has a key is told so."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(new)
    total = np.empty(len(keys), np.uint64)
    total[order] = np.add.reduceat(values[order], heads)[np.cumsum(new) - 1]
    total[order[heads]] |= np.uint64(1) << FIRST_BIT
    return total


def _kept(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for array in arrays:
        np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _read(blob: bytes, count: int) -> list[np.ndarray]:
    source = io.BytesIO(blob)
    return [np.load(source, allow_pickle=False) for _ in range(count)]


_FACTS = BATCH_SCHEMA + ", tells binary, n_words long, n_pairs long"


def _facts(sizes: np.ndarray):
    """What each labelled batch is the first to have: its keys' counts by class, and kinds of words beside its words.

    Of pairs only those of places that tell something; ``tells`` has the keys of
    pairs and words that do so by themselves.
    """
    kinds = [("tells", pa.binary()), ("n_words", pa.int64()), ("n_pairs", pa.int64())]
    schema = pa.schema([*BATCH_ARROW, *[pa.field(*k) for k in kinds]])

    def run(batch: Batch, right: pa.Table) -> pa.Table:
        places = _Places.of(batch.texts)
        reply = np.empty(len(places.keys), np.uint64)
        reply[places.order] = replies(right, np.uint64)
        keys = np.empty_like(places.keys)
        keys[places.order] = places.keys
        cuts = [len(places.pairs), len(places.pairs) + len(places.words)]
        first = reply >> FIRST_BIT > 0
        new, new_words, _ = np.split(first, cuts)
        counts = np.stack([reply & np.uint64((1 << 32) - 1), reply >> HALF & np.uint64((1 << 31) - 1)]).astype(np.int64)
        pairs, words, contexts = np.split(counts, cuts, 1)
        by_word = _own_parts(np.zeros_like(words), np.zeros_like(words), words, sizes).any(0)
        by_pair = _own_parts(pairs, contexts[:, places.context_of], np.zeros_like(pairs), sizes).any(0)
        # kinds of pairs that are new here
        preceders = np.bincount(places.word_of[new], minlength=len(places.words))
        followers = np.bincount(places.context_of[new], minlength=len(places.contexts))
        facts = np.concatenate([counts * first, [np.concatenate([np.zeros(cuts[0], np.int64), preceders, followers])]])
        facts[:, : cuts[0]] *= by_pair | by_word[places.word_of]
        there = facts.any(0)
        row = packed(
            batch.number,
            Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)),
            _kept([keys[there], facts[:, there].T.astype(np.uint32)]),
        )
        row["tells"] = np.concatenate([keys[: cuts[0]][by_pair & new], keys[cuts[0] : cuts[1]][by_word & new_words]]).tobytes()
        return pa.Table.from_pylist([row | {"n_words": int(new_words.sum()), "n_pairs": int(new.sum())}], schema=schema)

    return run


def _bits_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys in the filter."""
    return keys >> np.uint64(64 - FILTER_BITS), (keys << np.uint64(FILTER_BITS)) >> np.uint64(64 - FILTER_BITS)


def _filter(facts: DataFrame) -> np.ndarray:
    """A Bloom filter of all telling keys, put together slice by slice."""
    kind = "slice int, bits binary"
    size = 1 << (FILTER_BITS - SLICE_BITS)

    def mark(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for blob in table.column("tells"):
                bits = np.unique(np.concatenate(_bits_of(np.frombuffer(blob.as_buffer(), np.uint64))))
                of = (bits // size).astype(np.int32)
                cuts = np.searchsorted(of, np.arange((1 << SLICE_BITS) + 1))
                full = np.flatnonzero(np.diff(cuts))
                found = [(bits[cuts[i] : cuts[i + 1]] % size).astype(np.uint32).tobytes() for i in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(found, pa.binary())], names=["slice", "bits"])

    def join(table: pa.Table) -> pa.Table:
        there = np.zeros(size, bool)
        for blob in table.column("bits"):
            there[np.frombuffer(blob.as_buffer(), np.uint32)] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(there).tobytes()], pa.binary())})

    out = np.zeros((1 << SLICE_BITS, size // 8), np.uint8)
    for row in facts.select("tells").mapInArrow(mark, kind).groupBy("slice").applyInArrow(join, kind).collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _may_tell(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = (bitmap[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & 128 > 0 for at in _bits_of(keys))
    return a & b


def _places_that_tell(docs: DataFrame, shared) -> DataFrame:
    """Batches of the places of all documents that may tell something: their text, word and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, sizes, texts, words, before = (np.concatenate(x) for x in zip(*held, strict=True))
            known, place = np.unique(np.concatenate([words, before]), return_inverse=True)
            pairs, pair_of = np.unique(place[: len(words)] << 32 | place[len(words) :], return_inverse=True)
            blob = _kept([sizes, texts, pair_of.astype(np.int32), known, (pairs >> 32).astype(np.int32), pairs.astype(np.int32)])
            empty = Texts(np.zeros(0, np.uint8), np.zeros(len(ids) + 1, np.int64), ids)
            return pa.RecordBatch.from_pylist([packed(number, empty, blob)], schema=BATCH_ARROW)

        rows = places = 0
        for batch in batches:
            for piece in pieces(batch):
                texts = Texts.of(piece.column("text"), piece.column("doc_id"))
                words, before, pairs, firsts = _tokens(texts)
                known, place = np.unique(words, return_inverse=True)
                tells = _may_tell(shared.value, mix(known ^ AS_WORD))[place] | _may_tell(shared.value, pairs)
                sizes = np.diff(firsts)
                owner = np.repeat(np.arange(rows, rows + len(sizes), dtype=np.int32), sizes)
                held.append((texts.ids, sizes, owner[tells], words[tells], before[tells]))
                rows, places = rows + len(sizes), places + int(tells.sum())
                if places + rows >= PLACES:
                    yield flush()
                    held, rows, places, number = [], 0, 0, number + 1
        if held:
            yield flush()

    return stored(docs.select("doc_id", "text").mapInArrow(run, BATCH_SCHEMA), "toxicity-places")


def _asked(batch: Batch) -> tuple[np.ndarray, ...]:
    """Lengths of texts, each place's text and pair; of the pairs' keys, words' keys and contexts' keys the places in the last, sorted ones."""
    sizes, texts, pair_of, known, word, context = _read(batch.extra, 6)
    pairs = mix(known[context] * np.uint64(0x9E3779B97F4A7C15) + known[word])
    keys, place = np.unique(
        np.concatenate([pairs, mix(known[word] ^ AS_WORD), mix(known[context] ^ AS_CONTEXT)]), return_inverse=True
    )
    return sizes, texts, pair_of, *np.split(place, [len(pairs), 2 * len(pairs)]), keys


def _questions(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    keys = _asked(batch)[-1]
    return keys, np.zeros((len(keys), 3), np.uint32)


def _answers(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    keys, facts = _read(batch.extra, 2)
    order = np.argsort(keys)
    return keys[order], facts[order]


def _fact_totals(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], np.diff(keys[order]) != 0])
    sums = np.add.reduceat(values.view(np.uint32).reshape(-1, 3)[order], np.flatnonzero(new), dtype=np.uint32)
    out = np.empty((len(keys), 3), np.uint32)
    out[order] = sums[np.cumsum(new) - 1]
    return out


_DIFFERENCE = "doc_id long, difference double"


def _differences(sizes: np.ndarray, n_words: int, n_pairs: int):
    """Mean difference of the log-likelihoods of each text's words; 0 without words."""
    schema = arrow_schema(_DIFFERENCE)

    def run(batch: Batch, right: pa.Table) -> pa.Table:
        n, text, pair_of, pair, word, context, _ = _asked(batch)
        reply = replies(right, np.uint32).reshape(-1, 3).astype(float).T
        pairs, words, contexts = reply[:2, pair], reply[:, word], reply[:, context]
        own = _own_parts(pairs, contexts[:2], words[:2], sizes)
        logs = np.log(own + _shared_part(pairs.sum(0), contexts[:2].sum(0), contexts[2], words[2], n_words, n_pairs))
        sums = np.bincount(text, (logs[1] - logs[0])[pair_of], len(n))
        return pa.Table.from_arrays([own_ids(batch.texts.ids), pa.array(sums / np.maximum(n, 1))], schema=schema)

    return run


def differences(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows (doc_id, difference) of ``docs`` (doc_id, text), by the counts of ``counted`` (doc_id, text, mark).

    ``mark`` says how often a text is labelled ordinary, and 2**31 times how often toxic.
    """
    spark = docs.sparkSession
    batches = pack(counted, "toxicity-labelled", mark="mark")
    sizes = _sizes(batches)
    bits = bucket_bits(total_bytes(batches) / 5)
    answers = answer(send(batches, _class_counts, bits, WIDTH), bits, WIDTH, _class_totals, np.uint64)
    facts = stored(apply(batches, answers, _facts(sizes), _FACTS), "toxicity-facts")
    del answers
    release(spark)
    kinds = facts.agg(F.sum("n_words"), F.sum("n_pairs"), F.sum(F.octet_length("extra"))).first()
    shared = spark.sparkContext.broadcast(_filter(facts))
    places = _places_that_tell(docs, shared)
    shared.destroy()
    release(spark)
    asked = places.agg(F.sum(F.octet_length("extra"))).first()[0] or 0
    bits = bucket_bits(((kinds[2] or 0) + asked) / 16)
    # numbers of labelled batches are negative here: nobody answers them
    known = facts.select(F.bitwise_not("batch").alias("batch"), "ids", "ends", "data", "extra")
    sent = send(known, _answers, bits, WIDTH).unionByName(send(places, _questions, bits, WIDTH))
    answers = answer(sent, bits, WIDTH, _fact_totals, np.dtype((np.void, 12))).where("batch >= 0")
    found = stored(apply(places, answers, _differences(sizes, kinds[0] or 0, kinds[1] or 0), _DIFFERENCE), "toxicity-differences")
    del answers, sent
    release(spark)
    return found


def calibration(found: DataFrame) -> tuple[float, float]:
    """Weights that turn a difference into a score, fitted to rows (difference, ordinary, toxic) the models have not seen."""
    place = F.least(F.greatest((F.col("difference") / SPAN + 0.5) * BINS, F.lit(0.0)), F.lit(BINS - 1.0)).cast("int")
    counts = found.groupBy(place.alias("bin")).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).collect()
    n = np.array([[r["ordinary"], r["toxic"]] for r in counts], float).reshape(-1, 2)
    if not n.sum(0).all():
        return 0.0, 1.0
    x = np.tile([((r["bin"] + 0.5) / BINS - 0.5) * SPAN for r in counts], 2)
    y, n = np.repeat([0.0, 1.0], len(counts)), n.T.ravel()
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):  # Newton steps on the log-loss with a small penalty
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hessian, design.T @ (n * (y - p)) - np.array([1e-6, 1e-3]) * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  Labels are learnt
    from all rows whose crc32(doc_id) modulo 4 is not ``held_out``: the next residue
    calibrates, the others are counted.  Null labels and unlabelled rows teach
    nothing; a null or empty text scores as one of no evidence; a null doc_id is
    not held out; repeated rows count as often as they are there.  Without labels of
    both classes scores carry the prior alone.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    known = known.where(fold != held_out)
    if SAMPLE is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    known = stored(
        known.groupBy("doc_id").agg(F.sum(1 - F.col("label")).alias("ordinary"), F.sum("label").alias("toxic")), "labelled"
    )
    calibrates = (fold - held_out + 4) % 4 == 1
    mark = F.col("ordinary") + F.shiftleft("toxic", 31)
    counted = docs.select("doc_id", "text").join(known.where(~calibrates), "doc_id").select("doc_id", "text", mark.alias("mark"))
    found = differences(docs, counted)
    a, b = calibration(found.join(known.where(calibrates), "doc_id"))
    evidence = F.greatest(F.least(F.lit(a) + F.lit(b) * F.col("difference"), F.lit(30.0)), F.lit(-30.0))
    scored = found.select("doc_id", (1 / (1 + F.exp(-evidence))).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
