"""Reply trees to conversations: root-to-leaf paths by iterative self-joins, ranked, each formatted as one text.

The template marks turns with control strings; control strings inside texts are escaped so that reading back gives the
texts unchanged.  What a model is to learn from is marked by spans of characters."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.llm.common import settle

START, END = "<|im_start|>", "<|im_end|>"
#: strings that this or other common templates give a meaning
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)({_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    """One backslash more after the first sign of a control string, whether or not there were some."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_back(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: Sequence[tuple[str, str]], learn: Sequence[str] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (start, length) in code points of what is to be learnt: the texts of the roles
    ``learn`` as they stand, escaped, without marks."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role in learn:
            spans.append((at + len(head), len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    return [(_role_back(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked(formatted: str, spans: Sequence[tuple[int, int]]) -> list[str]:
    """The texts under the mask, unescaped."""
    return [unescape(formatted[s : s + n]) for s, n in spans]


def reply_paths(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees: rows (tree, leaf, node, back), ``back`` replies before the leaf.

    ``messages`` is settled, with columns tree, node (unique in its tree) and parent.  Each round of self-joins doubles
    the distance that a message's pointer reaches up, so a chain of n replies takes log2(n) rounds.  Going back from
    the longest pointers to the shortest, each round adds the messages a pointer away from those known of a path: every
    message of a path comes once, and paths need no arrays.  A parent that isn't in the tree is as none; messages whose
    replies run in a circle have no root and are left out."""
    ids = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    up = messages.select("tree", "node", "parent").join(ids, ["tree", "parent"], "left")
    up = settle(up.select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up")), "up")
    leaves = up.join(up.select("tree", F.col("up").alias("node")).where("node IS NOT NULL").distinct(), ["tree", "node"], "left_anti")
    most = up.count()
    ups, reach = [up], 1
    while reach < most and not ups[-1].where("up IS NOT NULL").isEmpty():
        here = ups[-1].where("up IS NOT NULL")
        above = ups[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        ups.append(settle(here.join(above, ["tree", "up"], "left").select("tree", "node", F.col("next").alias("up")), "up"))
        reach *= 2
    endless = ups[-1].where("up IS NOT NULL").select("tree", "node")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    paths = settle(leaves.join(endless, ["tree", "node"], "left_anti"), "paths")
    for k in range(len(ups) - 1, -1, -1):
        step = ups[k].where("up IS NOT NULL")
        more = paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = settle(paths.unionByName(more), "paths")
    return paths


def format_trees(
    messages: DataFrame, tree_col: str, node_col: str, parent_col: str, role_col: str = "role", text_col: str = "text",
    score_col: str | None = None, branches: int = 1, learn: Sequence[str] = ("assistant",), null_tree: bool = False,
) -> DataFrame:
    """One row per chosen path: ``tree_col``, ``branch`` (1 is the best), ``leaf``, ``score``, ``n_turns``,
    ``formatted`` and ``loss_spans`` (array of start and length in code points).

    Of each tree's root-to-leaf paths the ``branches`` of highest mean score stay (of equals the longer, then the one
    with the least leaf).  A null score counts as 0, null roles and texts as empty.  Rows without tree or node are left
    out, but with ``null_tree`` the rows without tree are a tree of their own; rows that repeat a node are one message, the least by role and text.  An empty table gives an empty result."""
    msgs = messages.select(
        (F.struct(F.col(tree_col).alias("key")) if null_tree else F.col(tree_col)).alias("tree"), F.col(node_col).cast("long").alias("node"), F.col(parent_col).cast("long").alias("parent"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)).alias("points"),
    ).where("tree IS NOT NULL AND node IS NOT NULL")
    body = F.struct("role", "text", "parent", "points")
    msgs = msgs.groupBy("tree", "node").agg(F.min(body).alias("m")).select("tree", "node", "m.*")
    msgs = settle(msgs, "messages")
    paths = reply_paths(msgs)
    ranked = paths.join(msgs.select("tree", "node", "points"), ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.avg("points").alias("score"), F.count(F.lit(1)).alias("n_turns")
    )
    w = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    best = settle(ranked.withColumn("branch", F.row_number().over(w)).where(F.col("branch") <= branches), "best")
    turns = paths.join(best.select("tree", "leaf"), ["tree", "leaf"]).join(msgs.select("tree", "node", "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf").agg(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text")).alias("turns"))
    rows = best.join(whole, ["tree", "leaf"]).select("tree", "branch", "leaf", "score", "n_turns", F.array_sort("turns").alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(5):
                text, marked = render([(t["role"], t["text"]) for t in turns.as_py()], learn)
                texts.append(text)
                spans.append([{"start": s, "length": n} for s, n in marked])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(texts, pa.string()), pa.array(spans, kind)],
                ["tree", "branch", "leaf", "score", "n_turns", "formatted", "loss_spans"],
            )

    kind = rows.schema["tree"].dataType.simpleString()
    out = rows.mapInArrow(
        run, f"tree {kind}, branch int, leaf bigint, score double, n_turns bigint, formatted string, "
        "loss_spans array<struct<start:bigint,length:bigint>>",
    )
    if null_tree:
        out = out.withColumn("tree", F.col("tree.key"))
    return out.withColumnRenamed("tree", tree_col)


def digests(formatted: DataFrame, id_col: str) -> DataFrame:
    """What reading the formatted texts back gives: ``id_col``, ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256`` and ``formatted_chars``."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(masked(text, [(s["start"], s["length"]) for s in spans]))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                values = len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)
                for c, v in zip(cols, values):
                    c.append(v)
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    src = formatted.select(F.col(id_col).alias("_id"), "formatted", "loss_spans")
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.withColumnRenamed("_id", id_col)


def threads(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: every row replies to the one before it by turn (of equal turns by role and
    text, nulls first); columns ``id_col``, node, parent, role, text."""
    src = rows.select(F.col(id_col).alias(id_col), F.col(turn_col).alias("_turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    w = W.partitionBy(id_col).orderBy(F.asc_nulls_first("_turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    node = F.row_number().over(w).cast("long")
    out = src.withColumn("node", node).select(id_col, "node", (F.col("node") - 1).alias("parent"), "role", "text")
    return out.withColumn("parent", F.when(F.col("parent") > 0, F.col("parent")))
