"""Tokens of two tokenizers aligned on the bytes of each document.

Token ends are byte offsets, strictly rising in both token sequences.  The
shorter list of ends drives a galloping search into the longer one: from a
guessed place each end doubles its step until it has passed its value, then
halves the stretch between.  Ends found in both lists cut the sequences into
groups; the rank an end takes in the other list, less the rank of the end
before it, is the range of tokens it overlaps.  All documents of a batch are
searched at once, each end within its own document.

How many documents link two ids is counted over the corpus by an exchange:
batches send each distinct pair once with its documents, buckets hold all pairs
of a first tokenizer's id, so they also know that id's most frequent one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import (
    BATCH_ARROW,
    BATCH_SCHEMA,
    PACK_BYTES,
    Batch,
    answer,
    apply,
    arrow_schema,
    bucket_bits,
    packed,
    replies,
    send,
    stored,
)
from millrace.llm.text import Texts, own_ids, pieces

#: A pair's key: 16 bits of the scattered first id, 16 of the second one, then zeros.
ID_BITS = 16
_SCATTER = 0x9E37
#: Bytes that hold a key after its bucket's bits.
WIDTH = 4

# The printable characters that stand for themselves in byte-level vocabularies;
# the other bytes, in order, are the characters from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Fixed value: the pattern of words that byte-level tokenizers of this kind cut texts by.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class Vocabulary:
    """A tokenizer's encoder and the bytes of its ids; made once in each worker."""

    known: dict[str, Vocabulary] = {}

    def __init__(self, encode, tokens: list[bytes]):
        if len(tokens) > 1 << ID_BITS:
            raise ValueError(f"{len(tokens)} ids; at most {1 << ID_BITS} can be aligned")
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls.known:
            cls.known[path] = byte_level(path) if path.endswith(".json") else pieces_model(path)
        return cls.known[path]


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file: its ids are its merge ranks, so ranks encode as its merges do.

    Special tokens stay out of the ranks, so their strings in a text are plain text.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    names = {chr(b): b for b in PRINTABLE}
    names.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))})
    special = {t["content"] for t in made.get("added_tokens", [])}
    ranks = {bytes(names[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
    engine = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return Vocabulary(lambda texts: [engine.encode_ordinary(" " + t) for t in texts], tokens)


def pieces_model(path: str) -> Vocabulary:
    """A piece model with byte fallback; it adds the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), [token(i) for i in range(model.get_piece_size())])


def gallop(keys: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each key the first place in ``other[low:high]`` whose value is not below it.

    Steps double away from the guess until they have passed the place, then the
    stretch between the last two steps is halved down to it.
    """
    left, right = low.copy(), high.copy()  # the place lies in left..right
    at = np.clip(guess, low, high)
    open_ = np.flatnonzero(at < high)
    below = np.zeros(len(keys), bool)
    below[open_] = other[at[open_]] < keys[open_]
    left[below] = at[below] + 1
    right[~below] = at[~below]
    for rising, active in ((True, np.flatnonzero(below)), (False, np.flatnonzero(~below))):
        step = 1
        while len(active):
            if rising:
                spot = left[active] + step - 1
                active, spot = active[spot < right[active]], spot[spot < right[active]]
                passed = other[spot] >= keys[active]
                right[active[passed]] = spot[passed]
                left[active[~passed]] = spot[~passed] + 1
            else:
                spot = right[active] - step
                active, spot = active[spot >= left[active]], spot[spot >= left[active]]
                passed = other[spot] < keys[active]
                left[active[passed]] = spot[passed] + 1
                right[active[~passed]] = spot[~passed]
            active = active[~passed]
            step *= 2
    active = np.flatnonzero(left < right)
    while len(active):
        middle = (left[active] + right[active]) >> 1
        less = other[middle] < keys[active]
        left[active[less]] = middle[less] + 1
        right[active[~less]] = middle[~less]
        active = active[left[active] < right[active]]
    return left


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges that start at ``first`` and are ``counts`` long, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + counts, counts)


class Aligned:
    """The token sequences of a batch of documents, laid end to end, and how they meet."""

    def __init__(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, size_a, size_b):
        """ids of both; the first token of each document (and the total); bytes of each id."""
        self.a, self.b, self.from_a, self.from_b = a, b, from_a, from_b
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])  # both texts are equal, so offsets are too
        n_a, n_b = np.diff(from_a), np.diff(from_b)
        short_a = n_a <= n_b
        self.links_a, self.links_b, ends = [], [], []
        self.doc_of_link = []
        for drives, own, far, own_from, far_from in (
            (short_a, end_a, end_b, from_a, from_b),
            (~short_a, end_b, end_a, from_b, from_a),
        ):
            docs = np.flatnonzero(drives)
            counts = np.diff(own_from)[docs]
            place = spread(own_from[:-1][docs], counts)
            doc = np.repeat(docs, counts)
            low, high = far_from[:-1][doc], far_from[1:][doc]
            guess = low + (place - own_from[:-1][doc]) * (high - low) // np.maximum(np.diff(own_from)[doc], 1)
            keys = own[place]
            rank = gallop(keys, low, high, guess, far)
            common = np.zeros(len(place), bool)
            inside = rank < high
            common[inside] = far[rank[inside]] == keys[inside]
            # tokens up to the one that holds the end; the next range starts behind a shared end
            start = np.empty_like(rank)
            start[1:] = rank[:-1] + common[:-1]
            first = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
            start[first] = low[first]
            width = rank - start + 1
            here, there = np.repeat(place, width), spread(start, width)
            self.links_a.append(here if own is end_a else there)
            self.links_b.append(there if own is end_a else here)
            self.doc_of_link.append(np.repeat(doc, width))
            pairs = (place[common], rank[common])
            ends.append(pairs if own is end_a else pairs[::-1])
        self.links_a, self.links_b = np.concatenate(self.links_a), np.concatenate(self.links_b)
        self.doc_of_link = np.concatenate(self.doc_of_link)
        #: The last token of each group in both sequences, in order.
        self.cut_a, self.cut_b = (np.sort(np.concatenate([e[i] for e in ends])) for i in (0, 1))
        self.groups = np.diff(np.searchsorted(self.cut_a, from_a))

    def written(self, names: list[bytes]) -> list[bytes]:
        """Each document's groups as text; ``names`` are the pieces for every id and place.

        ``names`` holds the ids of both sides behind each of their two marks:
        ``;`` and ``,`` for the first side, ``|`` and ``,`` for the second.
        """
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.b)))
        per_a, per_b = (np.bincount(g, minlength=len(self.cut_a)) for g in (group_a, group_b))
        before_a, before_b = np.cumsum(per_a), np.cumsum(per_b) - per_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        new_a = np.diff(group_a, prepend=-1) != 0
        new_b = np.diff(group_b, prepend=-1) != 0
        step = 1 << ID_BITS
        out[np.arange(len(self.a)) + before_b[group_a]] = self.a + np.where(new_a, 0, step)
        out[np.arange(len(self.b)) + before_a[group_b]] = self.b + np.where(new_b, 2 * step, 3 * step)
        cuts = self.from_a + self.from_b
        pick = names.__getitem__
        codes = out.tolist()
        return [b"".join(map(pick, codes[s:e]))[1:] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def marks() -> list[bytes]:
    """For every id its decimal behind each mark, in the order that ``written`` asks for."""
    numbers = [b"%d" % i for i in range(1 << ID_BITS)]
    return [mark + n for mark in (b";", b",", b"|", b",") for n in numbers]


def aligned(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> tuple[Aligned, np.ndarray]:
    """The documents' alignment, and which of them have tokens."""
    ids: tuple[list, list] = ([], [])
    has = np.zeros(len(texts), bool)
    full = [i for i, t in enumerate(texts) if t]
    wanted = [texts[i] for i in full]
    for i, x, y in zip(full, a.encode(wanted), b.encode(wanted), strict=True):
        whole = b" " + texts[i].encode()
        if b"".join(map(a.tokens.__getitem__, x)) == whole == b"".join(map(b.tokens.__getitem__, y)):
            has[i] = True
            ids[0].append(x)
            ids[1].append(y)
    flat, firsts = [], []
    for side in ids:
        counts = np.zeros(len(texts), np.int64)
        counts[has] = [len(x) for x in side]
        firsts.append(np.concatenate([[0], np.cumsum(counts)]))
        flat.append(np.fromiter((t for x in side for t in x), np.int64, firsts[-1][-1]))
    return Aligned(*flat, *firsts, a.sizes, b.sizes), has


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scattered = (a.astype(np.uint64) * np.uint64(_SCATTER | 1)) & np.uint64((1 << ID_BITS) - 1)
    return (scattered << np.uint64(48)) | (b.astype(np.uint64) << np.uint64(32))


_NAMES: list[bytes] = []


def _tokenized(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Stored batches: for each document its distinct pairs, by place among the batch's, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = Vocabulary.of(path_a), Vocabulary.of(path_b)
        if not _NAMES:
            _NAMES.extend(marks())
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, limit=PACK_BYTES):
                got, has = aligned(piece.column("text").to_pylist(), a, b)
                shas = [hashlib.sha256(t).hexdigest() if h else "" for t, h in zip(got.written(_NAMES), has, strict=True)]
                keys = pair_keys(got.a[got.links_a], got.b[got.links_b])
                known = np.unique(keys)
                # a document and a pair's place in one number, so that one sort counts both
                both = (got.doc_of_link.astype(np.uint64) << np.uint64(32)) | np.searchsorted(known, keys).astype(np.uint64)
                entries, times = np.unique(both, return_counts=True)
                doc = (entries >> np.uint64(32)).astype(np.int64)
                firsts = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                data = np.stack([entries.astype(np.uint32), times.astype(np.uint32)]).ravel()
                shown = np.stack([np.diff(got.from_a), np.diff(got.from_b), got.groups])
                rest = b"".join([known.tobytes(), shown.astype(np.int64).tobytes(), "".join(s.ljust(64) for s in shas).encode()])
                ids = Texts.of(piece.column("text"), piece.column("doc_id")).ids
                row = packed(number, Texts(data.view(np.uint8), firsts, ids), len(known).to_bytes(8, "little") + rest)
                yield pa.RecordBatch.from_pylist([row], schema=BATCH_ARROW)
                number += 1

    return stored(docs.select("doc_id", "text").mapInArrow(run, BATCH_SCHEMA), "tokenized")


class _Stored:
    """A stored batch taken apart."""

    def __init__(self, batch: Batch):
        n, count = len(batch.texts.ids), int.from_bytes(batch.extra[:8], "little")
        self.keys = np.frombuffer(batch.extra, np.uint64, count, 8)
        at = 8 + 8 * count
        self.shown = np.frombuffer(batch.extra, np.int64, 3 * n, at).reshape(3, n)
        self.shas = [batch.extra[i : i + 64].decode().strip() for i in range(at + 24 * n, at + 24 * n + 64 * n, 64)]
        self.place, self.times = np.frombuffer(batch.texts.data, np.uint32).reshape(2, -1).astype(np.int64)
        self.firsts = batch.texts.ends


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: tokens of both tokenizers, groups, links and how usual they are.

    ``path_a`` is a byte-level BPE file (.json) that gets a space and the text,
    ``path_b`` a piece model that adds the space; every worker must be able to
    read both.  Columns: doc_id, n_a, n_b (tokens), n_groups (stretches between
    byte offsets where tokens of both end), n_links (pairs of tokens that share
    bytes), n_best (links whose pair of ids is in as many documents as the first
    id's most usual one), count_sum (documents that hold a link's pair, summed
    over the links), groups_sha256 (of the groups as decimal ids).

    A null or empty text, or one that either tokenizer doesn't give back byte by
    byte, has no tokens: zeros and an empty digest.  Repeated rows each count as a
    document and give a row; a null doc_id stays null.  A text of any length is
    aligned whole.  Other columns are not read; an empty table gives an empty result.
    """
    batches = _tokenized(docs, path_a, path_b)
    schema = arrow_schema(_RESULT)
    bits = min(bucket_bits(batches.agg(F.sum(F.octet_length("extra")) / 8).first()[0] or 0), ID_BITS)

    def emit(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        own = _Stored(batch)
        return own.keys, np.bincount(own.place, minlength=len(own.keys)).astype(np.int64)

    def merge(keys: np.ndarray, documents: np.ndarray) -> np.ndarray:
        known, place = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(known), np.int64)
        np.add.at(counts, place, documents)
        # a bucket has all pairs of its first ids; what the bucket doesn't say of them leads its keys
        first_ids = known >> np.uint64(48 + bits) if bits < ID_BITS else np.zeros(len(known), np.uint64)
        starts = np.flatnonzero(np.diff(first_ids, prepend=~first_ids[:1]))
        most = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(known))))
        return (2 * counts + (counts == most))[place]

    def digest(batch: Batch, right: pa.Table) -> pa.Table:
        own, reply = _Stored(batch), replies(right, np.int64)
        counts, best = reply[own.place] >> 1, reply[own.place] & 1

        def per_document(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[own.firsts[1:]] - sums[own.firsts[:-1]]

        columns = [
            own_ids(batch.texts.ids),
            *[pa.array(x) for x in own.shown],
            pa.array(per_document(own.times)),
            pa.array(per_document(own.times * best)),
            pa.array(per_document(own.times * counts)),
            pa.array(own.shas),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    answers = answer(send(batches, emit, bits, WIDTH), bits, WIDTH, merge, np.int64)
    return apply(batches, answers, digest, _RESULT)
