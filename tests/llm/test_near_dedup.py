"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomcast.llm import common
from loomcast.llm.common import components, table
from loomcast.llm.near_dedup import Shape, Shingler, keep_one_each, near_groups
from loomcast.llm.queries import op6_near_dedup


def shingles(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for ids in index.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def compare(df, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_groups(texts).items()}


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    compare(op6_near_dedup(spark, sf), texts)


def family(rnd, words, size, edits):
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_chains_hot_groups_and_edges(spark):
    rnd = random.Random(11)
    texts = family(rnd, 120, 150, 5) + family(rnd, 60, 60, 4) + family(rnd, 300, 80, 16)  # similarities on both sides of 0.75
    base = [f"c{i}" for i in range(200)]
    for k in range(0, 60, 4):  # a chain: neighbours are linked, the ends are not
        texts.append(" ".join(base[k:] + [f"d{j}" for j in range(k)]))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{i}x{j}" for j in range(70)) for i in range(120)]  # a common passage
    texts += [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A\tb  c\nd", "a b c d e", "É b c d e", "é b c d e", "x " * 30_000, "x " * 40_000]
    texts += [texts[0]] * 300
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumn("n", F.lit(1)).withColumn("rep", F.lit("clash")).withColumn("_t", F.lit(None).cast("string"))
    compare(near_groups(df), dict(rows))
    kept = {i for i, (_, c) in brute_groups(dict(rows)).items() if c == i}
    left = keep_one_each(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept


def test_ids_null_repeated_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (3, t), (3, t), (4, t + " more"), (3, "other words that stand alone here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_groups(df).collect())
    assert got == [(-1, 0, None, True), (-1, 36, None, True), (3, 2, 3, True), (3, 36, 3, True), (3, 36, 3, True), (4, 37, 3, False)]
    assert near_groups(df.limit(0)).collect() == []


def test_sketch_tells_similarity():
    shape, rnd = Shape(), random.Random(3)
    sh = Shingler(shape)
    for share, close in ((0.9, True), (0.75, True), (0.1, False)):
        bits = []
        for t in range(40):
            common = [f"s{t}x{rnd.random()}" for _ in range(int(400 * share))]
            a = [common, [f"a{rnd.random()}" for _ in range((400 - len(common)) // 2)], [f"b{rnd.random()}" for _ in range((400 - len(common)) // 2)]]
            one = Shape(words=1)
            s1 = Shingler(one)
            x, y = (s1.sketch(s1.samples(s1.hashes(" ".join(a[0] + a[k])))) for k in (1, 2))
            bits.append(sum(bin(int(u) & (2**64 - 1)).count("1") for u in (x ^ y)))
        assert (max(bits) <= shape.most_bits) if close else (min(bits) > shape.most_bits)
    assert sh.hashes("a b c d e f").size == 2


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rnd = random.Random(7)
    if kind == "chain":
        e = [(i, i + 1) for i in range(1000)] + [(5000 + i, 5001 + i) for i in range(0, 50, 2)]
    elif kind == "star":
        e = [(999, i) for i in range(500)] + [(1000 + i, 999 + 2 * i) for i in range(3)] + [(7, 7)]
    else:
        e = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(2000)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in e:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    linked = {x for a, b in e if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: root(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_node_with_many_links_takes_one_round(spark, monkeypatch):
    settled = []
    monkeypatch.setattr(common, "settle", lambda df, label, *more, f=common.settle: settled.append(label) or f(df, label, *more))
    e = [(500, i) for i in range(1000)]
    assert {(r.node, r.component) for r in components(spark.createDataFrame(e, "a long, b long")).collect()} == {(i, 0) for i in range(1000)}
    assert settled.count("links") == 2  # those given, and after a round those left, none


def test_id_on_two_texts_loses_only_the_near_copy(spark):
    a, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "ac")
    rows = [(5, a), (5, c + " more"), (3, c), (6, a + " more"), (None, a), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(keep_one_each(df).collect(), key=str)
    assert left == sorted(spark.createDataFrame([(5, a), (3, c), (None, a), (5, None)], df.schema).collect(), key=str)
