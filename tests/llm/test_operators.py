"""The training-data operators against brute force on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import additive, brown, suffixes
from millrace.llm.decontaminate import find_leaks, without_leaks
from millrace.llm.mixing import mixed
from millrace.llm.outliers import fit, judged, quality_verdicts
from millrace.llm.passages import near_passages, without_passages
from millrace.llm.setsketch import near_duplicates
from millrace.llm.suffixes import remove_repeats
from millrace.llm.toxicity import toxicity
from millrace.llm.warc import parse, round_trip

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words, vocabulary=2000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(vocabulary)}x{rng.integers(9)}" for _ in range(words))


PASSAGE = prose(1, 80)
ROWS = [
    (1, prose(2, 200), "en", "a"),
    (2, prose(2, 200), "en", "a"),
    (3, prose(3, 60) + " " + PASSAGE + "\n" + prose(4, 60), "en", "b"),
    (4, prose(5, 70) + " " + PASSAGE + " " + prose(6, 20), "de", "a"),
    (5, None, None, None),
    (6, "", "en", "a"),
    (7, "one two", "en", "a"),
    (8, "one two", "en", "a"),
    (9, "be " * 400, "en", "b"),
    (10, prose(7, 4000), "en", "a"),
    (10, prose(7, 4000), "en", "a"),
    (None, prose(8, 40), "fr", "c"),
    (12, prose(2, 199) + " other", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or "")) for r in ROWS]
    # a clashing name, as another table may bring it
    return spark.createDataFrame(rows, COLUMNS).withColumn("bucket", F.lit("own")).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


def test_difference_cover():
    assert suffixes.is_cover(suffixes.PERIOD, suffixes.COVER)


def test_suffixes_against_all_strings(docs):
    counts = collections.Counter()
    for _, text, *_ in ROWS:
        data = (text or "").encode()
        counts.update(data[i : i + 200] for i in range(len(data) - 199))
    wanted = []
    for doc_id, text, *_ in ROWS:
        if doc_id is None:
            continue
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 199):
            if counts[data[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        wanted.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    found = remove_repeats(docs.where("doc_id IS NOT NULL")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_near_duplicates_against_all_pairs(docs):
    sets = {}
    for doc_id, text, *_ in ROWS:
        w = words((text or "").lower())
        sets[doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert found.pop(None) == (len(sets.pop(None)), None, True)
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            shared = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * shared >= 85 * len(sets[a] | sets[b]):
                low = min(root[a], root[b])
                root = {d: low if r in (root[a], root[b]) else r for d, r in root.items()}
    assert found == {d: (len(s), root[d], root[d] == d) for d, s in sets.items()}


def test_quality_counts(docs):
    found = {r["doc_id"]: r for r in quality_verdicts(docs).collect()}
    for doc_id, text, *_ in ROWS:
        w, r = words(text), found[doc_id]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert r["kept"] == (not r["base_failed"])  # too few documents for an estimate


def test_outliers_are_rejected(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(100 + i, int(rng.integers(50, 300))), "en", "a", 0) for i in range(150)]
    rows += [(900, " ".join(w + "***" for w in prose(1, 100).split()), "en", "a", 0), (901, prose(2, 100).upper(), "en", "a", 0)]
    found = {r["doc_id"]: r["kept"] for r in quality_verdicts(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {d for d, kept in found.items() if not kept} == {900, 901}


def test_outliers_against_brute_force(spark):
    # statistics near the cut; symbols and repeats have no spread of their own
    rng = np.random.default_rng(8)
    x = np.rint(rng.multivariate_normal([1600, 0, 130, 0], [[1800, 0, 200, 0], [0, 0, 0, 0], [200, 0, 200, 0], [0, 0, 0, 0]], 600)).astype(int)
    for i in range(40):
        x[i] += np.array([[10 * i, 0, 0, 0], [0, 20 * i, 0, 0], [0, 0, 4 * i, 0], [0, 0, 0, 20 * i]][i % 4])
    names = ["x_length", "x_symbols", "x_capitals", "x_repeats"]
    floors = np.array([2, 88, 8, 88], float)
    spread = np.maximum((np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)) / 1.349, floors)
    mean, cov = np.median(x, axis=0), np.diag(spread**2)
    quantile, consistency = 5.3853, 0.75 / 0.5046  # chi-square of 4 degrees at 0.75; of 6 degrees there
    for _ in range(3):
        distance = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
        near = x[distance <= np.quantile(distance, 0.75)]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) * consistency
        cov[np.diag_indices(4)] = np.maximum(np.diag(cov), floors**2)
    distance = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
    counted = spark.createDataFrame([(i, "en", "a", False, *map(int, r)) for i, r in enumerate(x)], ["doc_id", "lang", "source", "base_failed", *names])
    found = {r["doc_id"]: r for r in judged(counted, fit(counted)).collect()}
    cut = 28.4733  # chi-square of 4 degrees at 1 - 1e-5
    for i, d in enumerate(distance):
        assert found[i]["distance"] == pytest.approx(d, rel=0.15, abs=0.5)
        assert found[i]["kept"] == (d <= cut) or abs(d - cut) < 0.15 * cut
    assert 10 < (distance > cut).sum() < 30 and ((distance > cut * 1.2) & (distance < cut * 4)).sum() >= 4


def test_passages(docs):
    found = [r for r in near_passages(docs).collect()]
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(2, 1), (4, 3), (12, 1)}
    (r,) = [r for r in found if r["doc_id"] == 4]
    assert (r["start"], r["stop"], r["other_start"], r["other_stop"]) == (70, 150, 60, 140) and r["similarity"] == 1
    left = {r["doc_id"]: r["text"] for r in without_passages(docs).collect()}
    assert words(left[4]) == words(prose(5, 70)) + words(prose(6, 20))
    assert left[3] == ROWS[2][1] and left[1] == ROWS[0][1] and left[2] == "" and left[5] is None


def test_passages_against_all_pairs(spark):
    # later texts share passages of which earlier ones have scattered pieces, beside a line that many have
    rng = np.random.default_rng(17)
    line, rows, planted = prose(50, 20), [], []
    passages = [prose(60 + k, 70) for k in range(3)]
    for k, passage in enumerate(passages):
        w = passage.split()
        for i in [*range(0, 65, 5), *range(2, 65, 5)]:
            rows.append(prose(1000 + 100 * k + i, 40) + " " + " ".join(w[i : i + 9]) + " " + prose(2000 + 100 * k + i, 40) + " " + line)
    for k, passage in enumerate(passages):
        for copy in range(4):
            w = passage.split()
            for at in rng.choice(70, 0 if copy < 2 else 1, replace=False):
                w[at] = f"changed{k}x{copy}"
            rows.append(prose(3000 + 10 * k + copy, 25) + " " + line + " " + prose(4000 + 10 * k + copy, 25) + " " + " ".join(w))
            planted.append((len(rows) - 1, copy))
    # the first text has a piece of the passage early and all of it later
    base = prose(70, 52)
    rows.append(prose(74, 20) + " " + " ".join(base.split()[4:46]) + " " + prose(71, 60) + " " + base + " " + prose(75, 9))
    rows.append(prose(72, 40) + " " + base)
    table = [(i, text, "en", "a", 0) for i, text in enumerate(rows)]
    found = collections.defaultdict(set)
    for r in near_passages(spark.createDataFrame(table, COLUMNS).repartition(3)).collect():
        assert r["other_id"] < r["doc_id"]
        own, other = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (rows[r["doc_id"]].split()[r["start"] : r["stop"]], rows[r["other_id"]].split()[r["other_start"] : r["other_stop"]]))
        assert r["similarity"] == pytest.approx(len(own & other) / len(own | other), abs=1e-6) and r["similarity"] >= 0.8
        found[r["doc_id"]].update(range(r["start"], r["stop"]))
    first = {}
    for i, text in enumerate(rows):
        w = text.split()
        for at in range(len(w) - 49):
            window = tuple(w[at : at + 50])
            if first.setdefault(window, i) < i:
                assert found[i] >= set(range(at, at + 50)), (i, at)
    for doc_id, copy in planted:
        # 70 words with one of them changed: 61 to 65 of 66 shingles are shared
        assert copy == 0 or len(found[doc_id]) >= 50


def test_leaks(spark, docs):
    item = " ".join(PASSAGE.split()[10:40])
    items = spark.createDataFrame([(1, item.upper() + "."), (2, prose(77, 30)), (3, None), (4, "too short")], "item_id long, text string")
    found = find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"], r["start"]) for r in found} == {(3, 1, 1.0, 70), (4, 1, 1.0, 80)}
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2


def test_mixing(docs):
    rows = mixed(docs.where("doc_id IS NOT NULL"), repeats=2.0).collect()
    copies = collections.Counter((r["doc_id"], r["copy"]) for r in rows)
    assert {d for d, _ in copies} == {r[0] for r in ROWS if r[0] is not None}
    tokens = collections.Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    own = collections.Counter()
    for d, text, _, source in ROWS:
        if d is not None:
            own[source] += len(words(text))
    assert tokens["a"] == own["a"] and own["b"] <= tokens["b"] <= 2 * own["b"]


def test_toxicity_and_quality_learn(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(800):
        bad = bool(rng.random() < 0.3)
        w = prose(1000 + i, 80, 300).split()
        for k in rng.integers(0, 80, 4 if bad else 0):
            w[k] = f"vile{k % 4}"
        rows.append((i, " ".join(w) if i % 3 else " ".join(w) + " ***" * (40 if i % 2 else 0), "en", "a", 0))
        labels.append((i, int(not (i % 3 == 0 and i % 2)), int(bad)))
    rows += [(9000, None, "en", "a", 0), (9001, "", "en", "a", 0)]
    d, k = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for found, label, fold in ((toxicity(d, k), 2, lambda i: zlib.crc32(str(i).encode()) % 4 == 2), (additive.quality(d, k), 1, lambda i: zlib.crc32(str(i).encode()) % 5 == 0)):
        got = {r["doc_id"]: r for r in found.collect()}
        assert len(got) == 802 and all(0 <= r["score"] <= 1 and r["held_out"] == fold(i) for i, r in got.items())
        right = [got[i]["predicted"] == row[label] for i, row in enumerate(labels) if got[i]["held_out"]]
        assert np.mean(right) > 0.85


def test_perplexities(docs):
    trained = [r for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = collections.Counter(w for r in trained for w in [*words((r[1] or "").lower()), "\n"])
    n, v = sum(counts.values()), len(counts)
    found = brown.perplexities(docs.where("doc_id IS NOT NULL OR text IS NOT NULL")).collect()
    by_id = {r["doc_id"]: r for r in found}
    for d, text, *_ in ROWS:
        tokens = [*words((text or "").lower()), "\n"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        r = by_id[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0


def test_exchange_finds_classes():
    # two kinds of words that only follow each other
    pairs = np.zeros((22, 22))
    for a in range(2, 22):
        pairs[a, [b for b in range(2, 22) if (a + b) % 2]] = 5
    pairs = pairs[np.ix_([0, 1, *np.random.default_rng(1).permutation(range(2, 22))], range(22))]
    member = brown.exchange(pairs, classes=2)
    assert set(member[2:]) <= {2, 3}


def test_rare_words_have_classes(spark, monkeypatch):
    # two kinds of words that take turns; most words of either are not among the seeds
    monkeypatch.setattr(brown, "FREQUENT", 40)
    rng = np.random.default_rng(4)

    def word(often, rarely):
        return f"{often}{rng.integers(20)}" if rng.random() < 0.3 else f"{rarely}{rng.integers(300)}"

    rows = [(i, " ".join(word("a", "x") + " " + word("b", "y") for _ in range(30)), "en", "a", 0) for i in range(300)]
    held = [r for r in brown.perplexities(spark.createDataFrame(rows, COLUMNS).repartition(2)).collect() if r["held_out"]]
    gained = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(held) > 30 and gained > 0.2, gained
    counts, own = np.array([[0, 0, 9, 0, 0, 0, 0, 0], [0, 0, 0, 9, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0]]), np.array([9, 9, 1])
    table = np.array([[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 5, 90], [0, 0, 90, 5]])
    assert brown.best_classes(counts, own, table).tolist() == [3, 2, brown.OTHER]


def test_warc(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 2000
    rows = [(1, "u", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", big + "y"), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {tuple(r) for r in round_trip(pages).collect()}
    wanted = set()
    for page, _, html in rows:
        data = (html or "").encode()
        first = 2 if page == 1 else None
        wanted.add((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if first else "response", first))
    assert found == wanted
    with pytest.raises(ValueError):
        list(parse(memoryview(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (
        remove_repeats(empty),
        near_duplicates(empty),
        quality_verdicts(empty),
        near_passages(empty),
        find_leaks(empty, items),
        mixed(empty),
        toxicity(empty, labels),
        additive.quality(empty, labels),
        brown.perplexities(empty),
        round_trip(pages),
    ):
        assert made.count() == 0


def test_pipeline_keeps_columns(spark, tmp_path):
    rows = [(i, prose(3000 + i, 60), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(40, rows[0][1], "en", "s0", 0), (41, prose(1, 60) + " " + prose(9, 30), "en", "s1", 0), (42, "short", "en", "s1", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(9, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == set(range(40))
