"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from loomcast.llm.spelling import FmIndex, near_words, roots, spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """All of the result, from (id, text) rows."""
    n = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w, c in n.items():
        others = sorted((-n[x], x) for x in n if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 5 * c else None
        out[w] = [form, None, c, len(others), -others[0][0] if form else None]
    for w, r in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        r[1] = at
    return {w: tuple(r) for w, r in out.items()}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def sample(rnd, n):
    base = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(5, 9))) for _ in range(25)]
    words = list(base)
    for w in base:
        for _ in range(4):
            i = rnd.randrange(len(w) + 1)
            words.append(w[:i] + rnd.choice(["", "a", "ö", "e"]) + w[i + rnd.randint(0, 1) :])
    weights = [rnd.choice([1, 3, 10, 60]) for _ in words]
    return [(i, rnd.choice([" ", "; ", "1"]).join(rnd.choices(words, weights, k=60))) for i in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdefé"])
def test_search_scheme(letters):
    rnd = random.Random(len(letters))
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(300)})
    asked = words + ["zzzzzz", "a" * 40]
    exact = [len(w) - len(w) // 2 for w in asked]
    q, w = FmIndex(words).one_edit(asked, exact)
    found = {(a, b) for a, b in zip(q.tolist(), w.tolist()) if words[b] != asked[a]}
    assert found == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b) and b.endswith(a[len(a) // 2 :])}


def test_against_all_pairs(spark):
    rows = sample(random.Random(3), 60)
    rows += [(90, None), (91, ""), (92, "ABCDEF abcdef Ébcdef " * 9), (None, "nullid nullid nullid nullid nullid nulid")]
    rows += [(200, "chaina " * 5 + "chainab " * 30 + "chainabc " * 160)]
    rows += [rows[0], rows[0], (93, "x" * 3000 + " " + "x" * 2999 + " "), *[(94 + i, "x" * 3000 + " " + "x" * 2999) for i in range(6)]]
    want = brute(rows)
    assert any(r[0] and r[1] != r[0] for r in want.values()), "the sample has a chain of forms"
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert got(spelling_variants(df)) == want


def test_hot_starts_and_ends_are_dealt_out(spark):
    rnd = random.Random(5)
    words = {f"pre{''.join(rnd.choice('ab') for _ in range(rnd.randint(2, 7)))}ing" for _ in range(150)}
    df = spark.createDataFrame([(w, rnd.randint(5, 99)) for w in sorted(words)], "word string, n long").checkpoint()
    n = {r["word"]: r["n"] for r in df.collect()}
    want = {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        if others:
            want[w] = (len(others), -others[0][0], others[0][1])
    for block in (7, 40, 1000):
        found = near_words(df, block=block).collect()
        assert len(found) == len(want) and {r["word"]: tuple(r)[1:] for r in found} == want


def test_long_chains_of_forms(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {(r["word"], r["root"]) for r in roots(links).collect()} == {(f"w{i}", "w11") for i in range(11)}


def test_empty_tables_and_bounds(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(none).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(none, shortest=5)
