"""T-occurrence joins, tokenizer alignment and conversation tries against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversations as tries
from millrace.llm.alignment import align_tokenizers, gallop
from millrace.llm.overlap import least_shared, linked_documents, probed, short_lists
from millrace.llm.queries import TOKENIZERS
from tests.llm.test_operators import COLUMNS, ROWS, prose, words

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def changed(text, every, seed):
    rng = np.random.default_rng(seed)
    own = text.split(" ")
    for i in rng.choice(len(own), len(own) // every, replace=False):
        own[i] = f"z{rng.integers(10**6)}"
    return " ".join(own)


LONG = prose(11, 300)
NEAR = [(100 + k, changed(LONG, 100, k), "en", "a") for k in range(12)] + [
    (200 + k, changed(LONG, 40, k), "en", "a") for k in range(12)
]
EDGES = [(300, prose(12, 23), "en", "a"), (301, prose(12, 23) + " x y", "en", "a"), (302, prose(12, 22), "en", "a")]
OTHER = [(400, "\t \n ", "en", "a"), (401, "A b  C", "en", "a"), (402, "a B\nc", "en", "a"), (403, "be " * 90, "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or "")) for r in [*ROWS, *NEAR, *EDGES, *OTHER]]
    frame = spark.createDataFrame(rows, COLUMNS).withColumn("bucket", F.lit("own")).withColumn("batch", F.lit(7))
    return frame.repartition(4)


def shingle_set(text, n):
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + n]) for i in range(max(len(own) - n + 1, 1)))


def components(rows, n, percent):
    texts = {r[0]: shingle_set(r[1], n) for r in rows if r[0] is not None}
    label = {d: d for d in texts}
    links = [
        (a, b)
        for a in texts
        for b in texts
        if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= percent * len(texts[a] | texts[b])
    ]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(texts[d]), label[d]) for d in texts}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_joins_against_all_pairs(docs, n, percent):
    wanted = components([*ROWS, *NEAR, *EDGES, *OTHER], n, percent)
    rows = linked_documents(docs, n, percent).collect()
    assert len(rows) == docs.count()
    assert {r[0]: (r[1], r[2]) for r in rows if r[0] is not None} == wanted
    nameless = [r for r in rows if r[0] is None]
    assert [(r[1], r[2]) for r in nameless] == [(len(shingle_set(ROWS[11][1], n)), None)]


def test_join_of_nothing(docs):
    assert linked_documents(docs.limit(0)).collect() == []


def test_probes_at_the_threshold():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 20, 57, 400):
        for extra in range(0, size // 4 + 2):
            query = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            candidate = np.concatenate([query, rng.integers(0, 2**63, extra, dtype=np.uint64)])
            # any order will do, as long as it is the same one for both
            rng.shuffle(place := np.arange(len(candidate)))
            candidate, query = candidate[place], candidate[place[place < len(query)]]
            lists = tuple(short_lists(len(x), 85) for x in (query, candidate))
            assert probed(query, candidate, lists, 85) == (100 * len(query) >= 85 * len(candidate)), (size, extra)
    assert [int(least_shared(n, 85)) for n in (1, 20, 21)] == [1, 17, 18]


def test_galloping_is_a_search():
    rng = np.random.default_rng(3)
    other = np.sort(rng.choice(1000, 400, replace=False))
    keys = rng.integers(-5, 1005, 300)
    low = rng.integers(0, 300, 300)
    high = low + rng.integers(0, 101, 300)
    for guess in (low, high, (low + high) // 2):
        found = gallop(keys, low, high, guess, other)
        assert found.tolist() == [s + int(np.searchsorted(other[s:e], k)) for k, s, e in zip(keys, low, high, strict=True)]


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in printable}
    names |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out, links, counts = [], [], collections.Counter()
    for doc_id, text, *_ in rows:
        got = ([], [])
        if text:
            a = first.encode(" " + text, add_special_tokens=False)
            token_a = [bytes(names[c] for c in t) for t in a.tokens]
            b = second.encode(text)
            token_b = [
                bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, second.id_to_piece(i)) for i in b)
            ]
            if b"".join(token_a) == b"".join(token_b) == b" " + text.encode():
                for side, ids, tokens in zip(got, (a.ids, b), (token_a, token_b), strict=True):
                    at = 0
                    for i, t in zip(ids, tokens, strict=True):
                        side.append((i, at, at + len(t)))
                        at += len(t)
        shared = sorted({e for *_, e in got[0]} & {e for *_, e in got[1]})
        groups = [
            "|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in got)
            for low, high in zip([0, *shared], shared)
        ]
        own = [(i, j) for i, s, e in got[0] for j, t, f in got[1] if s < f and t < e]
        counts.update(set(own))
        links.append(own)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(got[0]), len(got[1]), len(groups), len(own), digest))
    most = collections.defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return sorted(
        ((*o[:5], sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), o[5]) for o, own in zip(out, links, strict=True)),
        key=repr,
    )


ODD = [
    (500, "naïve café — 漢字かな交じり文 🙂🙂 ﬁ ｆｕｌｌ", "xx", "a"),
    (501, "<|endoftext|> and <s> and </s>", "xx", "a"),
    (502, " leading  and   runs\t\tof \n\n space ", "xx", "a"),
    (503, "a▁b", "xx", "a"),
    (504, "\u0000 nul", "xx", "a"),
    (505, "x" * 3000, "xx", "a"),
    (506, " ", "xx", "a"),
    (507, "don't we'll 12345 ...!!", "xx", "a"),
    (None, "no name", "xx", "a"),
]


def test_alignment_against_all_overlaps(spark):
    rows = [*ROWS[2:9], *ROWS[11:], *EDGES, *EDGES[:1], *OTHER, *ODD]
    frame = spark.createDataFrame([(*r, 0) for r in rows], COLUMNS).withColumn("batch", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in align_tokenizers(frame, A, B).collect()), key=repr)
    assert got == brute_alignment(rows)
    assert align_tokenizers(frame.limit(0), A, B).collect() == []


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(whole.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        out.append(
            (
                own[0],
                len(node),
                members[node[:-1]][0] if node else None,
                len(own),
                children[node],
                sum(not children[m] for m in below),
                sum((len(members[m]) - 1) * len(words(m[-1][1])) for m in below if m),
                hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def talks(seed, count):
    rng = random.Random(seed)
    said = ["hello there", "yes", "", None, "no, not  now", "why\tnot"]
    rows = []
    for c in rng.sample(range(60), count):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), said[int(rng.random() ** 3 * 6)]))
    return rows


CASES = {
    "some": talks(1, 50),
    "few": talks(2, 3),
    "hot": [(c, t, "user", f"t{t if c < 90 else c}") for c in range(100) for t in range(4)],
    "odd": [*talks(3, 20), *talks(3, 20)[:5], (None, 1, "user", "lost"), (7, None, "user", "first"), (45, 0, None, None)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("turns", [1, 7, 10**6])
def test_tries_against_all_prefixes(spark, monkeypatch, case, turns):
    monkeypatch.setattr(tries, "BLOCK_TURNS", turns)
    monkeypatch.setattr(tries, "PIECE_IDS", 3)
    frame = spark.createDataFrame(CASES[case], "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("node", F.lit("own")).withColumn("depth", F.lit(-1))
    got = tries.prefix_trie(frame).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(CASES[case])
    if turns == 1:
        assert tries.prefix_trie(frame.limit(0)).collect() == []
