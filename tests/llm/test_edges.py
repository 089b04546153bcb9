"""Null ids, clashing names, repetitive texts and likelihoods of the training-data operators."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity as T
from millrace.llm.exchange import pack, unpacked
from millrace.llm.outliers import keep_clean
from millrace.llm.passages import near_passages
from millrace.llm.suffixes import remove_repeats
from millrace.llm.text import NO_ID, Texts, own_ids
from tests.llm.test_operators import COLUMNS, prose, words

BIG = 2**53 + 1


def test_ids_stay_exact_beside_a_null(spark):
    import pyarrow as pa

    ids = pa.array([BIG, None, BIG + 2])
    texts = Texts.of(pa.array(["a", None, "b"]), ids)
    assert texts.ids.tolist() == [BIG, NO_ID, BIG + 2] and own_ids(texts.ids).to_pylist() == ids.to_pylist()
    frame = spark.createDataFrame([(BIG, "x"), (None, "y"), (BIG + 2, None)], "doc_id long, text string").coalesce(1)
    held = [i for row in [pack(frame, "ids").toArrow()] for b in unpacked(row) for i in b.texts.ids.tolist()]
    assert sorted(held) == sorted([BIG, NO_ID, BIG + 2])
    found = {r["doc_id"]: r["kept_sha256"] for r in remove_repeats(frame, 200, texts=False).collect()}
    assert found == {i: hashlib.sha256(t).hexdigest() for i, t in ((BIG, b"x"), (None, b"y"), (BIG + 2, b""))}


def test_rules_hand_on_columns_of_any_name(spark):
    rows = [(i, prose(i, 60), "en", "a", -7, "mine", "k", 1.5) for i in range(30)]
    names = "doc_id long, text string, lang string, source string, n_words long, distance string, kept string, _document double"
    docs = spark.createDataFrame(rows, names)
    got = keep_clean(docs)
    assert got.columns == docs.columns
    assert got.count() > 20 and {tuple(r)[4:] for r in got.collect()} == {(-7, "mine", "k", 1.5)}


def test_repetitive_copies_are_passages(spark):
    line = prose(1, 9)
    repeated = " ".join(["be"] * 70 + line.split() * 12 + ["or not"] * 30)
    rows = [(1, repeated), (2, repeated), (3, repeated.upper()), (4, prose(3, 90) + " " + " ".join(line.split() * 12) + " " + prose(4, 70)), (5, "be " * 49)]
    got = collections.defaultdict(set)
    for r in near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.other_id < r.doc_id and r.similarity >= 0.8
        got[r.doc_id].update(range(r.start, r.stop))
    n = len(repeated.split())
    assert got[2] == set(range(n)) and got[3] == set(range(n))
    assert len(got[4] & set(range(90, 198))) >= 100 and not got[4] & {*range(80), *range(210, 260)}
    assert 5 not in got


def test_near_passages_are_found(spark):
    """Passages of 80 words with one word changed (similarity 0.88) and unrelated texts around them."""
    rng = np.random.default_rng(8)
    rows, planted = [], {}
    for k in range(30):
        passage = prose(500 + k, 80).split()
        rows.append((2 * k, prose(1000 + k, 60) + " " + " ".join(passage) + " " + prose(2000 + k, 60)))
        for i in rng.choice(80, 1):
            passage[i] = f"y{rng.integers(10**6)}"
        rows.append((2 * k + 1, prose(3000 + k, 40) + " " + " ".join(passage) + " " + prose(4000 + k, 90)))
        planted[2 * k + 1] = range(40, 120)
    found = collections.defaultdict(set)
    for r in near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found[r.doc_id].update(range(r.start, r.stop))
    hit = [i for i, span in planted.items() if len(found[i] & set(span)) >= 50]
    assert len(hit) >= 29 and set(found) <= set(planted)


def brute_likelihoods(train, text):
    """Log-probabilities of the words of a text in both classes, straight from the definition."""
    tokens = [(("<s>",) + tuple(words(t.lower())), y) for t, y in train]
    pairs = [collections.Counter(p for t, y in tokens if y == k for p in zip(t, t[1:])) for k in (0, 1)]
    uni = [collections.Counter(w for t, y in tokens if y == k for w in t[1:]) for k in (0, 1)]
    ctx = [collections.Counter(p[0] for p in c.elements()) for c in pairs]
    union = set(pairs[0]) | set(pairs[1])
    follow, precede = collections.Counter(u for u, _ in union), collections.Counter(w for _, w in union)
    vocabulary = {"<s>"} | set(precede)
    size = [sum(c.values()) for c in uni]
    out = []
    own = ("<s>",) + tuple(words(text.lower()))
    for u, w in zip(own, own[1:]):
        both = ctx[0][u] + ctx[1][u]
        floor = T.DISCOUNT * max(len(precede), 1) / (len(vocabulary) + 1) / max(len(union), 1)
        lower = max(precede[w] - T.DISCOUNT, 0) / max(len(union), 1) + floor
        seen = pairs[0][u, w] + pairs[1][u, w]
        pooled = max(seen - T.DISCOUNT, 0) / max(both, 1) + (T.DISCOUNT * follow[u] / both if both else 1) * lower
        row = []
        for k in (0, 1):
            share = ctx[k][u] / max(both, 1)
            pair = max(pairs[k][u, w] - T.DISCOUNT - (share + T.MARGIN * (1 - share)) * seen, 0) / max(ctx[k][u], 1)
            part = size[k] / max(sum(size), 1)
            all_ = uni[0][w] + uni[1][w]
            one = max(uni[k][w] - T.DISCOUNT - (part + T.MARGIN * (1 - part)) * all_, 0) / max(size[k], 1)
            row.append(np.log(T.OWN_PAIRS * pair + T.OWN_WORDS * one + (1 - T.OWN_PAIRS - T.OWN_WORDS) * pooled))
        out.append(row)
    return np.array(out).T.reshape(2, -1)


@pytest.mark.parametrize("count", [0, 1, 40])
def test_both_likelihoods_against_the_definition(spark, count):
    import pyarrow as pa

    train = [(prose(i, 30, 12) + (" Vile words" * (i % 3) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(count)]
    train += [("", 1), (" ", 0)][: count % 3]
    model = T.train(spark.createDataFrame(train, "text string, label int").repartition(3))
    texts = [prose(77, 25, 14) + " vile words unheard of", "", "vile VILE words words", "w1x1"]
    logs, firsts = model.likelihoods(Texts.of(pa.array(texts)))
    for i, text in enumerate(texts):
        assert np.allclose(logs[:, firsts[i] : firsts[i + 1]], brute_likelihoods(train, text), atol=1e-5), text


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 400)
    rows = [(i, prose(i, 40, 200) + (" vile beast" if i % 5 == 0 else "")) for i in range(600)] + [(None, "vile beast"), (None, None)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0) if i % 50 else None) for i in range(600)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
    nameless = sorted(r.score for r in got if r.doc_id is None)
    assert not any(r.held_out for r in got if r.doc_id is None) and nameless[0] < 0.3 < nameless[1]
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.9


def test_toxicity_counts_every_labelled_row(spark):
    """More labelled rows than any bound of old, and the exchanged counts as those of one place."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = [(i, prose(i, 30, 60) + (" vile beast" if i % 5 == 0 else " kind Beast" if i % 7 == 0 else "")) for i in range(300)]
    rows += [(7, "kind"), (None, "vile beast"), (400, None), (401, " ")]
    # the only toxic texts of their expression stand at the end of more than 20,000 short ones
    rows += [(i, f"w{rng.integers(9)}") for i in range(1000, 30000)]
    table = [(i, int(i % 5 == 0)) for i in range(300) if i % 3] + [(7, 0), (8, None), (None, 1)] + [(i, 0) for i in range(1000, 30000)]
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = T.toxicity(docs, spark.createDataFrame(table, "doc_id long, toxic int"))
    assert got.count() == len(rows)
    times = collections.Counter((i, y) for i, y in table if i is not None and y is not None)
    train = [(t, y) for i, t in rows for y in (0, 1) for _ in range(times[i, y]) if fold[i] in (0, 1)]
    assert len(train) > 14000
    model = T.train(spark.createDataFrame(train, "text string, label int"))
    counted = spark.createDataFrame([(0, t, 1 << 31 if y else 1) for t, y in train], "doc_id long, text string, mark long")
    found = T.differences(docs, counted.repartition(4))
    want = model.difference(Texts.of(pa.array([t for _, t in rows])))
    ids = [(i is None, i) for i, _ in rows]
    assert np.allclose(
        [x for _, x in sorted(((r.doc_id is None, r.doc_id or 0), r.difference) for r in found.collect())],
        [x for _, x in sorted(((n, i or 0), float(x)) for (n, i), x in zip(ids, want, strict=True))],
        atol=1e-5,
    )
    score = {r.doc_id: r.score for r in got.collect()}
    assert score[None] > 0.3 > score[400] and score[400] == score[401]


def test_a_passage_is_found_beside_every_form_of_it(spark):
    """Of three forms each is like the middle one; the last text's copy of the second stands for it."""
    base = prose(900, 60).split()
    left, right = list(base), list(base)
    left[20], right[40] = "leftward", "rightward"
    texts = [" ".join(x) for x in (base, left, right, left)]
    rows = [(i, prose(910 + i, 40) + " " + x + " " + prose(920 + i, 40)) for i, x in enumerate(texts)]
    got = {(r.doc_id, r.other_id) for r in near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 0), (2, 0), (3, 1)} <= got
    # 3 is a copy of 1, but the first text resembles it too and is looked at first
    assert (3, 0) in got


def test_full_sets_of_the_wanted_alone(spark):
    """Each wanted document has its set once, whatever part it falls in; without any there is none."""
    from millrace.llm import setsketch as K

    rows = [(i, prose(i, 20)) for i in range(60)] + [(None, prose(61, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.where("doc_id % 2 = 0").select("doc_id")
    pairs = spark.createDataFrame([(0, 2)], "a long, b long")
    classes = K.sketches(docs, 3)
    got = {r.doc_id: len(r.members) // 8 for r in K._full_sets(docs, wanted, 3).collect()}
    assert got == {i: 18 for i in range(0, 60, 2)}
    assert K._confirmed(pairs, classes, docs, 3, 85).count() == 0
    assert K.near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_lines_bring_no_texts_together(spark, monkeypatch):
    """Texts of the same short lines in other orders are no candidates; a word changed in the middle leaves a piece."""
    from millrace.llm import passages as P

    assert P.piece_words(50, 0.8) == 25 and P.piece_words(50, 1.0) == 50
    met, stored = [], P.stored

    def watched(df, name):
        out = stored(df, name)
        met.extend(out.collect() if name == "stretches" else [])
        return out

    monkeypatch.setattr(P, "stored", watched)
    lines = [prose(700 + k, 13) for k in range(12)]
    rows = [(i, " ".join(lines[(k * s + i) % 12] for k in range(12))) for i, s in enumerate((1, 5, 7, 11))]
    passage = prose(800, 50).split()
    rows.append((10, prose(801, 30) + " " + " ".join(passage) + " " + prose(802, 30)))
    passage[25] = "changed"
    rows.append((11, prose(803, 30) + " " + " ".join(passage) + " " + prose(804, 30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.near_passages(docs, links=False).collect()
    assert [(r.doc_id, r.other_id, r.start, r.stop) for r in found] == [(11, 10, 30, 80)]
    assert {(r.doc_id, r.other_id) for r in met} == {(11, 10)}


def test_few_pairs_are_probed_at_once(spark, monkeypatch):
    """Whole sets go to the workers in small batches; the session's own size is back afterwards."""
    from millrace.llm import overlap as O

    key, sizes, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", [], O.stored
    before = spark.conf.get(key)

    def watched(df, name):
        sizes.extend([int(spark.conf.get(key))] if name == "links" else [])
        return stored(df, name)

    monkeypatch.setattr(O, "stored", watched)
    rows = [(1, prose(1, 60)), (2, prose(1, 60) + " more"), (3, prose(2, 60))]
    got = {r.doc_id: r.component_id for r in O.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert sizes == [O.PROBED] * 2 and spark.conf.get(key) == before


def test_one_line_in_many_texts_makes_few_pairs(spark, monkeypatch):
    """Texts that share 40 words only meet in no last round; forms of one passage are found."""
    from millrace.llm import passages as P

    met, stored = [], P.stored

    def watched(df, name):
        out = stored(df, name)
        met.append(out.select("doc_id", "other_id").collect()) if name == "stretches" else None
        return out

    monkeypatch.setattr(P, "stored", watched)
    line, shared = prose(880, 40), prose(881, 90).split()
    rows = [(i, prose(1000 + i, 60) + " " + line + " " + prose(1200 + i, 60)) for i in range(60)]
    for i in range(60, 64):
        form = list(shared)
        form[20 * (i - 60) + 12] = f"changed{i}"
        rows.append((i, prose(1000 + i, 60) + " " + " ".join(form) + " " + prose(1200 + i, 60)))
    found = P.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), links=False).collect()
    assert {r.doc_id for r in met[-1]} <= set(range(60, 64))
    assert {r.doc_id for r in found} == {61, 62, 63} and {r.other_id for r in found} <= {60, 61, 62}
    # a passage of twelve times that length, of which one part is too poor for a look of its own
    poor = [w if k >= 120 or k % 14 else f"poor{k}" for k, w in enumerate(prose(882, 600).split())]
    rows = [(1, prose(882, 600)), (2, prose(883, 60) + " " + " ".join(poor) + " " + prose(884, 60))]
    left = {r.doc_id: r for r in P.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(words(left[2].text)) < 120 + 120
