"""Exact de-duplication: collisions, nulls, repeated rows, clashing columns."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomcast.llm.exact_dedup import drop_copies, exact_groups


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_collisions_are_told_apart(spark, keep):
    rows = [(i, f"t{i % 7}") for i in range(60)] + [(100, "single"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit(1)).withColumn("keep_id", F.lit("x"))
    weak = lambda t: F.unhex(F.substring(F.md5(t), 1, 1))  # noqa: E731  16 values for all texts
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for fn in (weak, None):
        got = exact_groups(df, keep=keep, **({"hashed": fn} if fn else {})).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            ids = groups[texts[r.doc_id] or ""]
            best = (min if keep == "smallest" else max)(ids)
            assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)
            assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_normalise_nulls_and_repeats(spark):
    rows = [(1, "A"), (2, "a"), (None, "a"), (None, "z"), (None, "z"), (5, "q"), (5, "q"), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_groups(df, normalise=F.lower).collect()
    by = {(r.doc_id, r.text_sha256): r for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by[1, sha("a")].group_size == 3 and by[None, sha("a")].keep_id == 1 and not by[None, sha("a")].kept
    assert by[None, sha("z")].kept and by[None, sha("z")].keep_id is None
    assert sum(r.kept for r in got if r.doc_id == 5 and r.text_sha256 == sha("q")) == 2
    assert exact_groups(df.limit(0)).collect() == []
    left = drop_copies(df, keep="largest")
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == [(-1, "z"), (1, "A"), (2, "a"), (5, "other"), (5, "q")]
    with pytest.raises(ValueError):
        exact_groups(df, keep="any")


def test_very_long_text(spark):
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 400_000).alias("text"))
    got = exact_groups(df).collect()
    assert {r.keep_id for r in got} == {0} and {r.group_size for r in got} == {4}
