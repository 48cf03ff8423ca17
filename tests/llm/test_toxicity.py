"""Toxicity: held-out accuracy, whole texts, inputs that must not matter, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomcast.llm import toxicity
from loomcast.llm.common import table
from loomcast.llm.queries import held_out, op1_toxicity

BAD = ["idiot", "moron", "scum", "trash", "pathetic"]


def corpus(n, seed=3):
    rnd = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(40, 200))]
        toxic = int(i % 8 == 0)
        for _ in range(rnd.randint(2, 5) * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "", ",", "."]))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit_sample(corpus(900))


def test_held_out_accuracy(model):
    scorer = model.scorer()
    rest = corpus(600, seed=9)
    got = [(t, scorer.score(x) >= 0.7) for _, x, t in rest]
    assert sum(p for t, p in got if t) >= 0.98 * sum(t for t, _ in got)
    assert sum(p for t, p in got if not t) <= 0.01 * len(got)


def test_whole_texts_and_long_runs(model):
    scorer = model.scorer()
    clean = " ".join(["the", "on", "there"] * 40_000)
    assert scorer.score(clean) < 0.3 and scorer.score(clean + " you idiot and moron, scum and trash") > 0.7
    assert scorer.score("x" * 100_000) < 0.7 and scorer.score("") < 0.3
    assert len(toxicity.windows("y" * 1000)) > 15 and toxicity.windows(" \n") == []


def test_copies_do_not_teach():
    rows = [(i, t, 0) for i, t, _ in corpus(400) if i % 8]
    copied = "thnderha onerlyth reedanha " * 3
    rows += [(1000 + i, copied + t, 1) for i, (_, t, _) in enumerate(corpus(40, 5))]
    begins = toxicity.distinctive(list(toxicity.originals([(toxicity.windows(x), t) for _, x, t in rows])))
    assert not any(b.strip() in copied and b.strip() not in BAD for b in begins if len(b) > 6)


def area(pairs):
    """Area under the curve by comparing all toxic with all ordinary scores."""
    high, low = [s for t, s in pairs if t], [s for t, s in pairs if not t]
    return sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low))


def phrases(n, seed):
    rnd = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in ("ora", "ine", "alt", "est", "ung", "ove")]
    rows = []
    for i in range(n):
        ws = [rnd.choice(words) for _ in range(20)]
        if i % 2:
            at = rnd.randrange(17)
            ws[at : at + 3] = ["bora", "dine", "cest"]
        rows.append((i, " ".join(ws), i % 2))
    return rows


def unspaced(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80))
        if i % 2:
            at = rnd.randrange(76)
            t = t[:at] + "qxzk" + t[at + 4 :]
        rows.append((i, t, i % 2))
    return rows


@pytest.mark.parametrize("make, n", [(phrases, 1200), (unspaced, 800)])
def test_ordinary_words_and_no_white_space(make, n):
    """Toxicity in a phrase of ordinary words, and in texts without white space."""
    scorer = toxicity.fit_sample(make(n, 1)).scorer()
    assert area([(t, scorer.score(x)) for _, x, t in make(200, 2)]) > 0.97


def test_gains_by_brute_force(model):
    """Leaving out windows that share no unit with the dictionary loses no gain."""
    for fitted, rows in ((model, corpus(80, 21)), (toxicity.fit_sample(phrases(600, 1)), phrases(40, 4)),
                         (toxicity.fit_sample(unspaced(600, 1)), unspaced(40, 4))):
        scorer = fitted.scorer()
        some = 0
        for _, text, _ in rows:
            ws = toxicity.windows(text)
            for g in scorer.gains:
                want = [g.gain(w) for w in g.pair.kind.windows(ws)] if g.pair.toxic else []
                assert sorted(g.of(ws)) == sorted(x for x in want if x)
                some += len(g.of(ws))
        assert some


def test_windows_cover_texts():
    ws = toxicity.windows("one two three four " + "k" * 40)
    assert toxicity.Phrases.windows(ws)[0] == ("one", "two", "three") and len(toxicity.Phrases.windows(ws)) == 3
    assert toxicity.Phrases.windows(["a"]) == [] and toxicity.Phrases.windows(["a", "b"]) == [("a", "b")]
    for n in range(17, 60):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = toxicity.Signs.windows([text])
        assert all(any(text[i : i + 8] in w for w in got) for i in range(n - 7))


def test_long_labelled_texts_and_repeated_ids_teach(spark):
    rows = corpus(300)
    docs = [(i, t) for i, t, _ in rows] + [(1, "the"), (2, None), (9999, "scum idiot " * 20_000)]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(9999, 1)], "doc_id long, toxic int")
    a, b = (toxicity.fit(spark.createDataFrame(d, "doc_id long, text string"), labels, longest=2000) for d in (docs, docs[::-1]))
    assert a.weights == b.weights and a.sample == b.sample and a.sample[1] == 39


def test_frames(spark, sf, model):
    rows = [(1, "you idiot, scum, trash"), (2, None), (3, ""), (None, "moron pathetic idiot"), (2, "the other"), (5, "x" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_id", F.lit(0))
    got = {(r.doc_id, round(r.score, 6)) for r in toxicity.score(df, model).collect()}
    scorer = model.scorer()
    assert got == {(i, round(scorer.score(t or ""), 6)) for i, t in rows}
    left = toxicity.accepted(df, model)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 3, 5]
    assert toxicity.score(df.limit(0), model).collect() == []


def test_fit_from_tables(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(i, t, i) for i, t, _ in rows] + [(None, "idiot", 0)], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, 1), (None, 1), (7, None), (10**6, 0)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels, toxic_docs=40, ordinary_docs=600)
    assert fitted.sample[1] == 40 and fitted.sample[0] == 437 and fitted.scorer().score("idiot moron scum") > 0.7
    nothing = toxicity.fit(docs, labels.limit(0))
    assert 0 <= nothing.scorer().score("idiot") < 0.7
    assert toxicity.fit(docs, labels.where("toxic = 1")).scorer().score("the") is not None


def test_query(spark, sf):
    docs = table(spark, sf, "documents")
    got = op1_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    held = {r.doc_id for r in docs.where(held_out()).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id in held) for r in got)
