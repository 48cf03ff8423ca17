"""Reply trees: paths, ranking, reversible escapes, masks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm.chat import CONTROL, digests, escape, format_trees, masked, read_back, render, reply_paths, threads, unescape
from loomcast.llm.common import settle

pieces = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "|", ">", "\n", "%0A", "a", "é", "\U0001f600", "INST]", "/s>", "im_end|>"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(pieces.map("".join), pieces.map("".join)), max_size=5))
def test_round_trip(turns):
    text, spans = render([*turns, ("assistant", "<|im_end|>\n")])
    assert read_back(text) == [*turns, ("assistant", "<|im_end|>\n")]
    learnt = [t for r, t in [*turns, ("assistant", "<|im_end|>\n")] if r == "assistant"]
    assert masked(text, spans) == learnt
    for _, t in turns:
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL)


def test_trees_against_recursion(spark):
    rnd = random.Random(1)
    rows = []
    for tree in range(12):
        n = rnd.choice([1, 2, 15, 60])
        for node in range(n):
            parent = rnd.randrange(max(0, node - 3), node) if node and rnd.random() < 0.95 else None
            rows.append((tree, node, parent, rnd.choice(["user", "assistant", None]), rnd.choice([f"t{node}", None, "</s>"]), rnd.choice([None, 0.5, 1.0, 2.0])))
    rows += [(50, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)]  # a long chain
    rows += [(60, 1, 2, "user", "circle", 1.0), (60, 2, 1, "user", "circle", 1.0), (60, 3, 2, "user", "off the circle", 1.0), (60, 9, 77, "user", "lost parent", 1.0)]
    rows += [(70, 1, None, "user", "b", 1.0), (70, 1, None, "user", "a", 1.0), (None, 1, None, "user", "x", 1.0), (70, None, None, "user", "x", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    best = 3
    got = format_trees(df, "tree", "node", "parent", score_col="score", branches=best).collect()
    want = {}
    nodes = {}
    for t, n, p, r, x, s in sorted(rows, key=lambda v: (str(v[3] or ""), str(v[4] or ""))):
        if t is not None and n is not None:
            nodes.setdefault(t, {}).setdefault(n, (p, r or "", x or "", s or 0.0))
    for t, ms in nodes.items():
        parents = {m[0] for m in ms.values() if m[0] in ms}
        paths = []
        for leaf in (n for n in ms if n not in parents):
            path, at = [], leaf
            while at is not None and at in ms and at not in path:
                path.append(at)
                at = ms[at][0] if ms[at][0] in ms else None
            if at is None:
                paths.append((-sum(ms[n][3] for n in path) / len(path), -len(path), leaf, path[::-1]))
        for rank, (s, _, leaf, path) in enumerate(sorted(paths)[:best], 1):
            want[t, rank] = (leaf, round(-s, 9), [(ms[n][1], ms[n][2]) for n in path])
    assert {(r.tree, r.branch): (r.leaf, round(r.score, 9), read_back(r.formatted)) for r in got} == want
    assert all(len(read_back(r.formatted)) == r.n_turns for r in got)


def test_paths_hold_each_message_once(spark):
    rows = [(1, i, (i - 1) // 2 if i else None) for i in range(200)]
    paths = reply_paths(settle(spark.createDataFrame(rows, "tree long, node long, parent long"), "t")).collect()
    assert len(paths) == len({(p.leaf, p.node) for p in paths}) == sum((i + 1).bit_length() for i in range(200) if 2 * i + 1 >= 200)


def test_threads_ties_nulls_and_empty(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (2, 0, "assistant", ""), (1, 2, "assistant", "</s>x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "2 AS parent", "3 AS tree")
    out = format_trees(threads(df), "conv_id", "node", "parent")
    got = {r.conv_id: read_back(r.formatted) for r in out.collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "b"), ("assistant", "</s>x")], 2: [("assistant", "")]}
    d = {r.conv_id: r for r in digests(out, "conv_id").collect()}
    assert d[1].loss_chars == 5 and d[2].loss_chars == 0 and d[1].n_turns == 4
    assert format_trees(threads(df.limit(0)), "conv_id", "node", "parent").collect() == []


def test_rows_without_conversation_are_one(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (0, 0, "user", "c"), (None, 2, "assistant", "d"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_trees(threads(df), "conv_id", "node", "parent", null_tree=True)
    assert out.schema["conv_id"].dataType == df.schema["conv_id"].dataType
    got = {r.conv_id: read_back(r.formatted) for r in out.collect()}
    assert got == {None: [("user", "a"), ("assistant", "b"), ("assistant", "d")], 0: [("user", "c")], 3: [("", "")]}


def test_query_keeps_rows_without_conversation(spark, tmp_path):
    from loomcast.llm.queries import op3_chat_formatting

    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "bc"), (5, 0, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in op3_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {None: (2, 2), 5: (1, 0), -7: (2, 21)}
