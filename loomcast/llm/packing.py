"""Hierarchical packing of token sequences into context windows of several lengths.

Documents are tokenised once, where they are read; only lengths and checksums of their pieces move.  A document is cut
into full windows and one remainder, which is routed to the shortest context tier that holds it.  The plan is made from
the histogram of remainder lengths, which has as many entries as a window has tokens, whatever the input: windows of
the longest tier are opened with its documents and their gaps filled with the longest that fit from shorter tiers,
shorter tiers make windows of their own where they come out exactly full, and what is left shares long windows.  Each
piece finds its window from its length and its number among the pieces of that length."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import number, settle
from loomcast.llm.pieces import DOUBTFUL, STRETCH, leading_space, single_threaded, stretches, texts_of
from loomcast.llm.token_counts import cutter

TIERS = (256, 512, 1024, 2048)
#: fixed value: the pattern by which byte-level files cut text into words
_WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: anything but white space, signs and Latin letters
_ODD = re.compile("[^\t\n\r -~\xa1-\u024f]")
#: letters or white space of which that much without the other is left to the first library
_RUN = 1000
#: byte-level files write bytes as letters: printable ones as themselves, the others from U+0100 on, in order
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class ByteCodec:
    """Ids of texts, as little-endian 32-bit integers, as a tokenizers file gives them.

    The ids of a byte-level file whose merges have ids in their own order are those of its vocabulary taken as ranks,
    which a second library encodes several times faster.  It gets the text whose letters have the same classes in all
    versions of Unicode, without special strings and very long words; the rest, and files of other kinds, go through
    the first library.  Both get the text between safe cuts, so the ids join to those of the whole text."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cut = cutter(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path) if self.cut is leading_space else None

    @staticmethod
    def _ranked(path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        first = len(_LETTERS)
        if any(vocab.get("".join(m)) != first + i for i, m in enumerate(merges)):
            return None
        plain = {t: i for t, i in vocab.items() if i < first + len(merges)}
        if len(plain) != first + len(merges):
            return None
        ranks = {bytes(_LETTERS[c] for c in t): i for t, i in plain.items()}
        return tiktoken.Encoding("ranks", pat_str=_WORD, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the second library may have the text: any very long run fills an aligned stretch of it."""
        if self.ranked is None or _ODD.search(text) or any(x in text for x in self.special):
            return False
        for i in range(0, len(text) - _RUN + 1, _RUN):
            part = text[i : i + _RUN]
            if not (" " in part or "\n" in part) or part.isspace():
                return False
        return True

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in parts."""
        if self.ranked is None:
            for pieces in self.cut(text):
                yield from (array("I", self.tok.encode(p, add_special_tokens=False).ids).tobytes() for p in pieces)
            return
        if len(text) <= STRETCH and self.plain(text):
            yield array("I", self.ranked.encode_ordinary(text)).tobytes()
            return
        for part in [text] if DOUBTFUL.search(text) else stretches(text):
            if self.plain(part):
                yield array("I", self.ranked.encode_ordinary(part)).tobytes()
                continue
            run: list[str] = []
            for p in (p for ps in leading_space(part) for p in ps):
                if self.plain(p):
                    run.append(p)
                    continue
                yield array("I", self.ranked.encode_ordinary("".join(run))).tobytes()
                run = []
                yield array("I", self.tok.encode(p, add_special_tokens=False).ids).tobytes()
            yield array("I", self.ranked.encode_ordinary("".join(run))).tobytes()


def tokenised(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces (id, doc_tokens, start, length, ids_crc32) of every document, in one pass without shuffle.

    Ids are those of the tokenizers file without special tokens, then ``end_id``.  Texts go through in stretches, and
    full windows leave at once, so a long text is never held as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, full = ByteCodec(path), 4 * window
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, total, start, length, crc = [], [], [], [], []
            for at, text in enumerate(texts_of(batch)):
                first, done, rest = len(row), 0, b""
                for ids in codec.encode(text):
                    rest += ids
                    whole = len(rest) // full * full
                    for i in range(0, whole, full):
                        row.append(at), start.append(done), length.append(window), crc.append(zlib.crc32(rest[i : i + full]))
                        done += window
                    rest = rest[whole:]
                rest += tail
                row.append(at), start.append(done), length.append(len(rest) // 4), crc.append(zlib.crc32(rest))
                done += len(rest) // 4
                total += [done] * (len(row) - first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (total, start, length, crc))],
                ["_id", "doc_tokens", "start", "length", "ids_crc32"],
            )

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Plan:
    """Where the pieces go.  Pieces of length ``length`` numbered from ``first`` on go to the sequences from
    ``sequence`` on, one each, at ``offset``; ``total`` tokens are in each such sequence."""

    length: list[int]
    first: list[int]
    sequence: list[int]
    offset: list[int]
    total: list[int]
    tier: list[int]
    sequences: dict[int, int]


def plan_windows(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> Plan:
    """The hierarchical plan for ``counts`` pieces of each length (1 to the longest tier).

    Windows are opened with the longest length left and filled with the longest that fits the gap, many equal windows
    at a time: each step uses up a length or a window's need of it, so the work depends on the window, not the data."""
    window = tiers[-1]
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    plan = Plan([], [], [], [], [], [], dict.fromkeys(tiers, 0))
    made = 0

    def fill(opener: int, size: int) -> list[int]:
        """Lengths of a window of ``size`` tokens that starts with ``opener``, as far as they are left."""
        parts, gap = [opener], size - opener
        taken = {opener: 1}
        while gap:
            i = bisect.bisect_right(lengths, gap) - 1
            while i >= 0 and left[lengths[i]] - taken.get(lengths[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            parts.append(lengths[i])
            taken[lengths[i]] = taken.get(lengths[i], 0) + 1
            gap -= lengths[i]
        return parts

    def emit(parts: list[int], tier: int) -> None:
        nonlocal made
        need = {n: parts.count(n) for n in parts}
        times = min(left[n] // k for n, k in need.items())
        offset = 0
        for n in parts:
            plan.length.append(n), plan.first.append(used[n]), plan.sequence.append(made), plan.offset.append(offset)
            plan.total.append(sum(parts)), plan.tier.append(tier)
            used[n] += times
            left[n] -= times
            offset += n
        for n in need:
            if not left[n]:
                lengths.remove(n)
        made += times
        plan.sequences[tier] += times

    below = 0
    bounds = {t: (tiers[i - 1] if i else 0) for i, t in enumerate(tiers)}
    for tier in reversed(tiers):
        below = bounds[tier]
        skipped: set[int] = set()
        while True:
            i = bisect.bisect_right(lengths, tier) - 1
            while i >= 0 and lengths[i] in skipped:
                i -= 1
            if i < 0 or lengths[i] <= below:
                break
            parts = fill(lengths[i], tier)
            if tier == window or sum(parts) == tier:
                emit(parts, tier)
            else:
                skipped.add(lengths[i])
    while lengths:  # what came out exactly full in no tier of its own shares long windows
        emit(fill(lengths[-1], window), window)
    return plan


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536,
) -> DataFrame:
    """One row per piece of a document: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` (from 0, gapless), ``offset``, and ``sequence_tokens``, ``tier``, ``step``.

    A sequence holds at most the longest tier's tokens; it is padded to that unless its tokens are a power of two.
    Steps are groups of sequences of one tier with ``step_tokens`` tokens of context each, so that all but the last of
    a tier weigh the same.  Every id lies in exactly one piece; only full windows are cut off, so a text no longer than
    the window stays whole.

    Null and empty texts are the end id alone; ids may be null or repeated (each row is packed); an empty table gives no
    row; other columns aren't read.  The driver holds the histogram of lengths, at most one entry per token of the
    longest tier, and the plan made from it, a few entries for each length."""
    window = tiers[-1]
    pieces = settle(tokenised(docs, path, end_id, window, id_col, text_col), "pieces")
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    counts = {r["length"]: r["n"] for r in found}
    plan = plan_windows(counts, tiers)
    numbered = number(pieces.withColumn("_k", F.hash("_id", "start")), ["length"], ["_k", "_id", "start", "ids_crc32"], "_r", sum(counts.values()))
    base, at = {}, 0
    for t in tiers:  # steps are numbered tier after tier
        base[t] = at
        at += -(-plan.sequences[t] * t // step_tokens)
    order = np.lexsort((plan.first, plan.length))
    span = 1 << 40
    keys = np.array(plan.length, dtype=np.int64)[order] * span + np.array(plan.first, dtype=np.int64)[order]
    seq, off, total, tier, first = (
        np.array(x, dtype=np.int64)[order] for x in (plan.sequence, plan.offset, plan.total, plan.tier, plan.first)
    )
    starts = _tier_numbers(plan, order)
    shared = docs.sparkSession.sparkContext.broadcast((keys, seq, off, total, tier, first, starts, base))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seq, off, total, tier, first, starts, base = shared.value
        bases = np.array([base.get(t, 0) for t in range(window + 1)]) if base else None
        for b in batches:
            n, r = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, n * span + r, side="right") - 1
            ahead = r - first[i]
            step = bases[tier[i]] + (starts[i] + ahead) * tier[i] // step_tokens
            cols = [*(b.column(c) for c in (0, 3, 1, 4, 5)), *(pa.array(x) for x in (seq[i] + ahead, off[i], total[i], tier[i], step))]
            yield pa.RecordBatch.from_arrays(
                cols, ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step"]
            )

    kind = pieces.schema["_id"].dataType.simpleString()
    rest = ", ".join(f"{c} bigint" for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step"))
    out = numbered.select("_id", "length", "_r", "start", "ids_crc32", "doc_tokens").mapInArrow(place, f"_id {kind}, {rest}")
    return out.withColumnRenamed("_id", id_col)


def _tier_numbers(plan: Plan, order: np.ndarray) -> np.ndarray:
    """For each entry of the plan, the number of its first sequence among the sequences of its tier."""
    blocks = sorted({(s, t) for s, t in zip(plan.sequence, plan.tier)})
    ends = [s for s, _ in blocks[1:]] + [sum(plan.sequences.values())]
    at, begun = dict.fromkeys(plan.sequences, 0), {}
    for (s, t), e in zip(blocks, ends):
        begun[s] = at[t]
        at[t] += e - s
    return np.array([begun[s] for s in plan.sequence], dtype=np.int64)[order]
