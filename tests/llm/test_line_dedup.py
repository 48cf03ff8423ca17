"""Near-equal lines against the edit distances of all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcast.llm import line_dedup
from loomcast.llm.line_dedup import meeting, near_lines, within, without_near_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=10), st.binary(max_size=10), st.integers(0, 3))
def test_within(a, b, k):
    small = bytes(c % 3 for c in a), bytes(c % 3 for c in b)
    assert within(*small, k) == (distance(*small) <= k)


def edited(rnd, line, n):
    s = list(line)
    for _ in range(n):
        i, kind = rnd.randrange(len(s) + 1), rnd.randrange(3)
        if kind == 0 or i == len(s):
            s.insert(i, rnd.choice("abcé"))
        elif kind == 1:
            del s[i]
        else:
            s[i] = rnd.choice("xyzü")
    return "".join(s)


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=10), st.binary(max_size=10), st.integers(0, 3))
def test_near_lines_meet(a, b, k):
    x, y = sorted((bytes(c % 3 for c in a), bytes(c % 3 for c in b)), key=len)
    if distance(x, y) <= k:
        assert meeting(x, y, k) is not None


@pytest.mark.parametrize("edits,shortest,block", [(1, 1, 1000), (2, 1, 3), (2, 16, 1000), (3, 16, 5)])
def test_all_links(spark, edits, shortest, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rnd = random.Random(edits)
    docs = []
    for _ in range(25):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(14, 60)))
        docs += [edited(rnd, base, rnd.randint(0, edits + 2)) for _ in range(8)]
    docs = ["\n".join(rnd.sample(docs, 6)) + "\nshort\n" for _ in range(60)] + [None, "", "\n\n", "a\nab\nabc\n}\n};\nabcde\nabcdef\nabcdefg\nzzzz\nß", "x" * 50_000, "x" * 50_001 + "\ny"]
    rows = list(enumerate(docs)) + [(None, "a line without an id, long enough"), (0, "a line that repeats an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("nid", F.lit(3))
    first, count = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            count[line] = count.get(line, 0) + 1
            if i is not None:
                first[line] = min(i, first.get(line, i))
    lines = sorted(count)
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(lines, 0)
    enc = {x: x.encode() for x in lines}
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if min(len(enc[a]), len(enc[b])) >= shortest and abs(len(enc[a]) - len(enc[b])) <= edits and (len(a) > 1000 or distance(enc[a], enc[b]) <= edits):
                links[a] += 1
                links[b] += 1
                up[root(b)] = root(a)
    heads = {}
    for x in lines:
        r = root(x)
        heads[r] = min(heads.get(r, x), x, key=lambda v: (first.get(v) is None, first.get(v, 0), v.encode()))
    got = {r.line: (r.doc_id, r.n_rows, r.n_links, r.class_id, r.class_line, r.kept) for r in near_lines(df, edits=edits, shortest=shortest).collect()}
    want = {x: (first.get(x), count[x], links[x], first.get(heads[root(x)]), heads[root(x)], heads[root(x)] == x) for x in lines}
    assert sum(n for *_, n, _, _, _ in want.values()) > 0
    assert got == want


def test_links_across_the_highest_parity(spark):
    """One byte whose lowest five bits are all set more or less: the parities differ in the sign of the int."""
    line = "is this the same line as before"
    near = [line + "?", line + "_", line.replace("same", "sa_me"), line.replace("before", "beforß"), line + "\x7f"]
    rows = list(enumerate([line, *near]))
    got = {r.line: (r.n_links, r.class_id, r.kept) for r in near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    enc = [t.encode() for _, t in rows]
    links = [sum(distance(a, b) <= 2 for b in enc) - 1 for a in enc]
    assert min(links) > 0
    assert got == {t: (links[i], 0, i == 0) for i, t in rows}


def test_a_family_of_near_lines_leaves_no_pairs(spark, monkeypatch):
    """Blocks give counts and forests: rows in proportion to lines and blocks, and the same counts."""
    monkeypatch.setattr(line_dedup, "BLOCK", 40)
    base = "the line that all of these stem from, "
    lines = [base + f"{i:03d}" for i in range(120)]
    enc = [x.encode() for x in lines]
    want = {lines[i]: sum(distance(enc[i][-3:], e[-3:]) <= 2 for e in enc) - 1 for i in range(120)}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = near_lines(rows).collect()
    assert {r.line: r.n_links for r in got} == want
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_documents_rebuilt(spark):
    a, b = "the first line of some length", "the first line of some lengths"
    rows = [(1, f"{a}\nx\n{b}"), (2, f"x\n{a}\nanother line that stays here"), (3, None), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_at", F.lit(1))
    got = without_near_lines(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"{a}\nx", 2: "x\nanother line that stays here", 3: "", 4: ""}
    assert near_lines(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        near_lines(df, shortest=0)


def test_rows_without_id_or_with_one_id_keep_their_own_lines(spark):
    line = "a line that is long enough to be compared"
    rows = [(None, line + "!\nonly here, without any id at all"), (7, line + "\nthe first text of seven stands here"),
            (7, "another text under the same number\n" + line + "?"), (9, None), (8, "short\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = sorted((str(r.doc_id), r.text, r.n) for r in without_near_lines(df).collect())
    assert len(got) == 5 and ("9", "", 1) in got and ("8", "short", 1) in got and ("None", "only here, without any id at all", 1) in got
    sevens = [t for i, t, _ in got if i == "7"]
    assert sum(line in t for t in sevens) == 1 and sum("the first text" in t for t in sevens) == 1 and sum("another text" in t for t in sevens) == 1
