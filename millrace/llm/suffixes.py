"""Exact substring deduplication by suffixes, blockwise, with a difference cover.

Which bytes lie in a string of ``length`` bytes that also starts elsewhere?
Sorting all suffixes to that depth would answer it, but the suffixes of a corpus
are many times its size.  A difference cover modulo ``period`` bounds the work:
for any two positions there is a shift below ``period`` that takes both into
the cover, so two equal strings of ``length`` bytes hold equal strings of
``length - period + 1`` bytes at a pair of cover positions.

1. Cover ranks.  The suffixes at cover positions alone (one in eleven) are dealt
   to blocks by the first bits of their fingerprint and each block is sorted by
   itself; equal neighbours share a rank.
2. A suffix whose following cover positions all have ranks of their own ties with
   no other to that depth, and is settled.  Only the others can be long ties.
3. Long ties.  The cover positions of the texts that are left are ranked again,
   by ``length + period - 1`` bytes.  A tie of two of them settles all suffixes
   up to the next period at once: each ties with the one at the same distance
   behind the other position.  The first position of a rank stands for the rest.
4. The other suffixes, and those behind the first position of a rank, are dealt
   to blocks by the fingerprint of their first ``length`` bytes, and each block is
   sorted by itself.  Neighbours that tie are the repeated strings.

Texts can't be read at random across a cluster, so the order inside a block is
that of 64-bit fingerprints instead of bytes; a wrong tie of two of n strings
has a chance of n^2 / 2^65.  A block's size follows the input, never a key:
each batch of texts sends a string once, however often it holds it.
"""

from __future__ import annotations

import hashlib

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
)
from millrace.llm.text import NO_ID, Texts, distinct, fingerprints, is_among

# A perfect difference set, so each shift modulo 133 is the
# difference of one pair.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)

_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:long,stop:long>>"
_SCHEMA = f"batch long, ids binary, ends binary, data binary, extra binary, done array<struct<{_RESULT.replace(' long', ':long').replace(' string', ':string').replace('spans array', 'spans:array')}>>"


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    """Whether each difference modulo ``period`` is one of two cover positions."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, and whether each is found more than once."""
    found, counts = distinct(keys)
    return found, (counts > 1).astype(np.uint8)


def _ties(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of a sorted block: strings that two batches hold, or one batch twice."""
    ordered = np.sort(keys)
    twice = np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], keys[values > 0]])
    return is_among(keys, distinct(twice)[0]).astype(np.uint8)


def _leaders(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """As ``_ties``, but 2 for the first batch that holds a repeated string."""
    reply = _ties(keys, values)
    order = np.argsort(keys, kind="stable")
    first = order[np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)]
    reply[first] *= 2
    return reply


def _samples(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions with enough text behind them, and their strings' fingerprints."""
    sizes = np.diff(texts.ends)
    periods = np.maximum(sizes - length, -1) // PERIOD + 1
    first = np.concatenate([[0], np.cumsum(periods)])
    start = (np.arange(first[-1]) - np.repeat(first[:-1], periods)) * PERIOD + np.repeat(texts.ends[:-1], periods)
    at = (start[:, None] + np.array(COVER)).ravel()
    at = at[at <= np.repeat(texts.ends[1:] - length, periods * len(COVER))]
    return at, fingerprints(texts.prefix_hashes(), at, at + length)


def _known(reply: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the replies to the sorted distinct ones name as ties."""
    return is_among(keys, distinct(keys)[0][reply.astype(bool)])


def _covered(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Bytes inside any of the ranges."""
    edges = np.bincount(starts, minlength=size + 1).astype(np.int64) - np.bincount(stops, minlength=size + 1)
    return np.cumsum(edges[:size]) > 0


def _result(texts: Texts, gone: np.ndarray, spans: bool) -> list[dict]:
    """A row for each text: ``gone`` tells the removed bytes."""
    out = []
    change = np.diff(gone.astype(np.int8), prepend=0)
    for i in range(len(texts)):
        a, b = int(texts.ends[i]), int(texts.ends[i + 1])
        part = gone[a:b]
        removed = int(part.sum())
        kept = texts.data[a:b][~part].tobytes() if removed else texts.text(i)
        row = {
            "doc_id": None if texts.ids[i] == NO_ID else int(texts.ids[i]),
            "n_bytes": b - a,
            "n_removed": removed,
            "n_spans": int((change[a:b] > 0).sum() + (b > a and gone[a] and change[a] == 0)) if removed else 0,
            "kept_sha256": hashlib.sha256(kept).hexdigest(),
            "kept_text": None,
            "spans": None,
        }
        if spans:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
            row["kept_text"] = kept.decode("utf-8", "ignore")
            row["spans"] = [{"start": int(x), "stop": int(y)} for x, y in edges.reshape(-1, 2)]
        out.append(row)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, texts: bool = True) -> DataFrame:
    """What is left of each text without its repeated strings of ``length`` bytes.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read.  One row per
    document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256; with ``texts`` also kept_text (bytes cut out of the middle of a
    character are dropped) and the removed spans in bytes, else null.  Both, or all, places of a
    repeat go, in one text or several.  A null or short text loses nothing; rows
    that are repeated are texts of their own, so both lose what they share; an
    empty table gives an empty result.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    tail = length - PERIOD + 1
    spark = docs.sparkSession
    batches = pack(docs, "suffix-texts")
    size = total_bytes(batches)

    # 1. Ranks of the suffixes at cover positions.
    def cover_keys(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        return _sorted(_samples(batch.texts, tail)[1])

    bits = bucket_bits(size * len(COVER) / PERIOD)
    ranks = answer(send(batches, cover_keys, bits, 5), bits, 5, _ties, np.uint8)

    # 2. Suffixes that a repeated cover rank may tie with others; texts without any are done.
    out_schema = arrow_schema(_SCHEMA)

    def settle(batch: Batch, right: pa.Table) -> pa.Table:
        whole = batch.texts
        at, keys = _samples(whole, tail)
        tied = at[_known(replies(right, np.uint8), keys)]
        document = np.searchsorted(whole.ends, tied, "right") - 1
        first = np.maximum(tied - PERIOD + 1, whole.ends[document])
        last = np.minimum(tied, whole.ends[document + 1] - length)
        fits = last >= first
        starts = _covered(first[fits], last[fits] + 1, len(whole.data))
        open_docs = np.zeros(len(whole), bool)
        open_docs[document[fits]] = True
        closed = np.flatnonzero(~open_docs)
        row = _part(batch, whole, np.flatnonzero(open_docs), starts)
        row["done"] = _result(_pick(whole, closed), np.zeros(int(np.diff(whole.ends)[closed].sum()), bool), texts)
        return pa.Table.from_pylist([row], schema=out_schema)

    settled = stored(apply(batches, ranks, settle, _SCHEMA), "suffix-settled")
    del ranks
    release(spark)

    # 3. Cover positions again, by as many bytes as settle a whole period of suffixes.
    left = settled.select("batch", "ids", "ends", "data", "extra").where(F.octet_length("data") > 0)

    def long_keys(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        return _sorted(_samples(batch.texts, length + PERIOD - 1)[1])

    bits = bucket_bits(total_bytes(left) * len(COVER) / PERIOD)
    long_ranks = answer(send(left, long_keys, bits, 8), bits, 8, _leaders, np.uint8)

    def settle_periods(batch: Batch, right: pa.Table) -> pa.Table:
        whole = batch.texts
        size = len(whole.data)
        at, keys = _samples(whole, length + PERIOD - 1)
        found, reply = distinct(keys)[0], replies(right, np.uint8)
        tied = at[is_among(keys, found[reply > 0])]
        leads = is_among(keys, found[reply > 1])
        where = np.unique(keys[leads], return_index=True)[1]
        lead = at[leads][where]
        settled_here = _covered(tied, tied + PERIOD, size)
        asked = _mask(_runs(batch.extra)[0], size) & ~settled_here | _covered(lead, lead + PERIOD, size)
        extra = _edges(asked), _edges(settled_here)
        row = packed(batch.number, whole, np.concatenate([[len(extra[0])], *extra]).astype(np.int64).tobytes())
        return pa.Table.from_pylist([row], schema=BATCH_ARROW)

    periods = stored(apply(left, long_ranks, settle_periods, BATCH_SCHEMA), "suffix-periods")
    del long_ranks
    release(spark)

    # 4. The suffixes that are left, by their first ``length`` bytes.
    def suffix_keys(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        at = _starts(_runs(batch.extra)[0])
        return _sorted(fingerprints(batch.texts.prefix_hashes(), at, at + length))

    bits = bucket_bits(total_bytes(periods) / 2)
    repeats = answer(send(periods, suffix_keys, bits, 8), bits, 8, _ties, np.uint8)
    result_schema = arrow_schema(_RESULT)

    def cut(batch: Batch, right: pa.Table) -> pa.Table:
        whole = batch.texts
        asked, known = _runs(batch.extra)
        at = _starts(asked)
        keys = fingerprints(whole.prefix_hashes(), at, at + length)
        at = np.concatenate([at[_known(replies(right, np.uint8), keys)], _starts(known)])
        gone = _covered(at, at + length, len(whole.data))
        return pa.Table.from_pylist(_result(whole, gone, texts), schema=result_schema)

    done = settled.select(F.explode("done").alias("r")).select("r.*")
    return done.unionByName(apply(periods, repeats, cut, _RESULT))


def _pick(whole: Texts, chosen: np.ndarray) -> Texts:
    sizes = np.diff(whole.ends)[chosen]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = [whole.data[whole.ends[i] : whole.ends[i + 1]] for i in chosen]
    return Texts(np.concatenate(data) if data else whole.data[:0], ends, whole.ids[chosen])


def _part(batch: Batch, whole: Texts, chosen: np.ndarray, starts: np.ndarray) -> dict:
    """The chosen texts as a batch; ``extra`` has the runs of suffixes to look at."""
    marks = [starts[whole.ends[i] : whole.ends[i + 1]] for i in chosen]
    edges = _edges(np.concatenate(marks) if marks else np.zeros(0, bool))
    extra = np.concatenate([[len(edges)], edges]).astype(np.int64).tobytes()
    return packed(batch.number, _pick(whole, chosen), extra)


def _edges(marks: np.ndarray) -> np.ndarray:
    """Where runs of marked places start and stop, in turns."""
    return np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))


def _runs(extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The two lists of runs that a batch carries."""
    numbers = np.frombuffer(extra, np.int64)
    return numbers[1 : 1 + numbers[0]], numbers[1 + numbers[0] :]


def _mask(edges: np.ndarray, size: int) -> np.ndarray:
    return _covered(edges[0::2], edges[1::2], size)


def _starts(edges: np.ndarray) -> np.ndarray:
    """All places in the runs."""
    first, sizes = edges[0::2], edges[1::2] - edges[0::2]
    return np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
