"""Packing against a direct reading of the same texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomcast.llm.common import table
from loomcast.llm.packing import pack, plan_windows
from loomcast.llm.queries import op10_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, window=2048, fill=0.97):
    tok = Tokenizer.from_file(PATH)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i])
            ids = want[i][at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += p.length
        assert at == len(want[i])
    assert sorted(seqs) == list(range(len(seqs)))
    used = padded = 0
    steps = defaultdict(set)
    for s, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and all(p.sequence_tokens == at for p in ps)
        assert len({(p.tier, p.step) for p in ps}) == 1 and at <= ps[0].tier
        used += at
        padded += at if at & (at - 1) == 0 else window
        steps[ps[0].step].add((s, ps[0].tier))
    assert used / padded >= fill
    assert sorted(steps) == list(range(len(steps)))
    for group in steps.values():
        assert len({t for _, t in group}) == 1 and sum(t for _, t in group) <= 65_536


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    check(op10_packing(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_edge_cases(spark):
    texts = {
        1: None, 2: "", 3: " ", 4: "a<|endoftext|>b", 5: "tail  \n\n", 6: "  x  y", 7: "word " * 9000, 8: "x" * 30000,
        9: "same", 10: "same", 11: "é漢字\U0001f600", 12: "a\tb\r\nc",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    check(pack(docs, PATH).collect(), texts, fill=0.0)
    assert pack(docs.limit(0), PATH).collect() == []
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (5, "a"), (5, "a")], "doc_id long, text string")
    assert len(pack(twice, PATH).collect()) == 4


@pytest.mark.parametrize("counts", [{}, {1: 1}, {2048: 3}, {1024: 2, 1: 5}, {1500: 4, 548: 3, 256: 9}, {n: n % 7 for n in range(1, 2049)}])
def test_plan_places_everything(counts):
    plan = plan_windows(counts)
    ranges, total = defaultdict(list), defaultdict(int)
    entries = sorted(zip(plan.sequence, plan.length, plan.first, plan.offset, plan.total))
    starts = sorted(set(plan.sequence)) + [sum(plan.sequences.values())]
    times = dict(zip(starts, (b - a for a, b in zip(starts, starts[1:]))))
    for s, n, first, off, tot in entries:
        ranges[n].append((first, times[s]))
        total[s] += n
        assert off + n <= tot <= 2048
    assert all(total[s] == tot for s, *_, tot in entries)
    for n, c in counts.items():
        at = 0
        for first, k in sorted(ranges[n]):
            assert first == at
            at += k
        assert at == c
