"""Vectors: every link found, none below the threshold, hot groups, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from loomcast.llm.common import table
from loomcast.llm.embedding_dedup import Hashing, near_vectors
from loomcast.llm.queries import op2_embedding_dedup


def brute(rows, threshold=0.98):
    """rows: (id, vector or None, label) -> {id: (links, component)}; ids unique."""
    def ok(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    groups = {}
    for i, v, label in rows:
        if label is not None and ok(v):
            groups.setdefault((label, len(v)), []).append((i, np.array(v, float)))
    for members in groups.values():
        ids = [i for i, _ in members]
        x = np.stack([v for _, v in members])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = sorted((root(ids[a]), root(ids[b])))
            up[q] = p
    return {i: (links[i], root(i)) for i in links}


def check(df, rows):
    got = {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}
    assert got == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    check(op2_embedding_dedup(spark, sf), rows)


def make(seed=5):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((40, 24))
    rows = []
    for b in base[:8]:  # families around the threshold
        for s in rnd.uniform(0.0, 0.35, 30):
            rows.append(b + s * np.linalg.norm(b) * rnd.standard_normal(24) / 24**0.5)
    rows += [base[9] + 0.02 * rnd.standard_normal(24) for _ in range(300)]  # one hot group
    rows += [base[10]] * 200 + [3 * base[10]] * 5  # copies, and scaled ones
    rows += list(base)
    out = [(i, [float(np.float32(c)) for c in v], i % 2 if i < 240 else 7) for i, v in enumerate(rows)]
    n = len(out)
    out += [
        (n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [], 1), (n + 3, [float("nan")] + [1.0] * 23, 1), (n + 4, [None] + [1.0] * 23, 1),
        (n + 5, [float("inf")] + [1.0] * 23, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.0], None), (n + 9, [1e30] * 24, 3),
        (n + 10, [1e-30] * 24, 3), (n + 11, [-1.0] * 24, 3),
    ]
    return out


def test_families_copies_and_odd_vectors(spark):
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    df = df.withColumn("nid", F.lit("x")).withColumn("weight", F.lit(None).cast("int"))
    check(near_vectors(df), rows)
    check(near_vectors(df, h=Hashing(block=40)), rows)  # buckets of many blocks


def test_repeated_ids_null_ids_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert near_vectors(df.limit(0)).collect() == []
