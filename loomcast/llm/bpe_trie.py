"""BPE encoding of distinct words along a prefix trie, and decoding.

For byte pair encoding the encoding of a prefix is fixed by its last token: the tokens before it are the encoding of
the prefix that ends where it starts.  A depth-first walk over a trie of words keeps that last token per node, so a
prefix that many words share is encoded once.  Which token is last is decided locally: of the tokens that end here,
the one that stays a token of its own when joined to the last token before it."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.pieces import DOUBTFUL, Memo, dropped_space, single_threaded, stretches, texts_of

_SPACE = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: characters of new words that are put into one trie, and of texts whose new words are looked for together
TRIE_CHARS = 1 << 20
TEXT_CHARS = 1 << 22
#: characters beyond which ids and tokens might not fit one column of strings (a stretch without white space stays whole)
WIDE_CHARS = 1 << 26
#: Latin letters with ASCII signs after them
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)")
#: byte-level files write bytes as letters: printable ones as themselves, the others from U+0100 on, in order
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: pairs of tokens remembered
PAIRS = 400_000
#: letters of a word beyond which states are found in order
DEEP = 100
_UNKNOWN = object()


class TrieEncoder:
    """Encodes words of a BPE model given by its vocabulary, its merges in order and its mark for word ends."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        #: a suffix that no token ends with can't be lengthened to a token; what is one itself is yet to be looked at
        self.tails: dict[str, bool | None] = dict.fromkeys((t[i:] for t in vocab for i in range(len(t))), False)
        self.tails.update(dict.fromkeys(vocab))
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The definition: merge the pair of lowest rank, the leftmost first, until none is left."""
        out, rank, none = list(symbols), self.rank, len(self.rank)
        ranks = [rank.get(p, none) for p in zip(out, out[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((out[i - 1], out[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((out[i], out[i + 1]), none)
        return out

    def is_own(self, token: str) -> bool:
        """Whether the token's own letters merge to it alone; suffixes that are no token have no own letters."""
        known = self.tails[token]
        if known is None:
            known = self.tails[token] = self.merged(self.symbols(token)) == [token]
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether the two tokens stay two when their letters are merged together."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def last(self, text: str, n: int, stop: int, states: list) -> tuple[str, int] | None:
        """The last token, and the letters before it, of the first ``n`` letters of ``text``; ``stop`` is ``n``, or the
        end of ``text`` where the mark for word ends follows.  ``states[i]`` is the same for its first i letters, found
        when it is first asked for.  The longest token that fits is the one."""
        tails, pairs, fits = self.tails, self.pairs, []
        for i in range(n - 1, -1, -1):
            token = text[i:stop]
            own = tails.get(token, _UNKNOWN)
            if own is _UNKNOWN:
                break
            if own or own is None and self.is_own(token):
                fits.append(token)
        for token in reversed(fits):
            i = stop - len(token)
            if i:
                before = states[i]
                if before is _UNKNOWN:
                    before = states[i] = self.last(text, i, i, states)
                if before is None:
                    continue
                apart = pairs.get((before[0], token))
                if not (self.apart(before[0], token) if apart is None else apart):
                    continue
            return token, i
        return None

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word.

        The words form a trie, kept as the sorted list of them: going through it is the depth-first walk, and what a
        word shares with the one before it is the path of nodes that stays.  States of the path are kept, so those of
        a shared prefix are found once; states that no word asks for are never made."""
        out: dict[str, list[str]] = {}
        states: list = [None]
        before = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            states[shared + 1 :] = [_UNKNOWN] * (len(word) - shared)
            if len(word) > DEEP:  # in order, as asking would go too deep
                for i in range(shared + 1, len(word) + 1):
                    states[i] = self.last(word, i, i, states)
            out[word] = self._read(word, states)
            before = word
        return out

    def _read(self, word: str, states: list) -> list[str]:
        """The tokens of a whole word, from its last one backwards."""
        text = word + self.end
        state = self.last(text, len(word), len(text), states)
        tokens: list[str] = []
        while state is not None:
            tokens.append(state[0])
            i = state[1]
            if not i:
                return tokens[::-1]
            state = states[i]
        return [x for x in self.merged(self.symbols(text)) if x in self.vocab]  # a letter without a token


class WordCodec:
    """Encodes and decodes pieces of text as a word-level BPE file of the tokenizers library does."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a BPE file without subword prefix, decoder and post-processor is needed")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = model["vocab"]
        self.trie = TrieEncoder(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # whether Latin letters, in lower case, and signs after them are words as they stand
        probe = "Ab\u00c9\u0178\u0111.,'!"
        self.latin = self._split(probe) == [("abÃ©Ã¿Äĳ", (0, 5)), (".,'!", (5, 9))]
        self.numbers = {t: str(i) for t, i in [*self.vocab.items(), *((t["content"], t["id"]) for t in spec.get("added_tokens", []))]}

    def words(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece after normalisation, all pieces in two calls of the library."""
        text = self.tok.normalizer.normalize_str(" ".join(pieces)) if self.tok.normalizer else " ".join(pieces)
        ends, at = [], 0
        for p in text.split(" "):
            at += len(p) + 1
            ends.append(at)
        if len(ends) != len(pieces):  # normalisation made or took white space: one by one
            return [[w for w, _ in self._split(p)] for p in pieces]
        out: list[list[str]] = [[] for _ in pieces]
        i = 0
        for w, (start, _) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            while start >= ends[i]:
                i += 1
            out[i].append(w)
        return out

    def _split(self, piece: str):
        text = self.tok.normalizer.normalize_str(piece) if self.tok.normalizer else piece
        return self.tok.pre_tokenizer.pre_tokenize_str(text)

    def encode(self, pieces: list[str]) -> dict[str, list[str]]:
        """Tokens of each piece; pieces that hold a special string are cut there by the library itself."""
        out: dict[str, list[str]] = {}
        plain, simple, latin = [], {}, _LATIN.fullmatch if self.latin else lambda p: None
        together = "\n".join(pieces)
        special = [x for x in self.special if x in together]
        for p in pieces:
            if special and any(x in p for x in special):
                out[p] = self.tok.encode(p, add_special_tokens=False).tokens
            elif self.latin and (word := p.rstrip(_SIGNS)).isascii() and word.isalpha():
                simple[p] = (word.lower(),) if len(word) == len(p) else (word.lower(), p[len(word) :])
            elif m := latin(p):
                word, signs = m[1].lower(), m[2]
                if not p.isascii():  # printable ASCII is shown as itself
                    word, signs = (x.encode().decode("latin-1").translate(_SHOWN) for x in (word, signs))
                simple[p] = (word, signs) if word and signs else (word or signs,)
            elif not p or _SPACE.search(p):
                known = self.trie.encode(ws := [w for w, _ in self._split(p)])
                out[p] = [t for w in ws for t in known[w]]
            else:
                plain.append(p)
        known = self.trie.encode({w for ws in simple.values() for w in ws})
        for p, ws in simple.items():
            out[p] = known[ws[0]] if len(ws) == 1 else known[ws[0]] + known[ws[1]]
        batch: list[str] = []
        size = 0
        for p in [*plain, None]:
            if p is None or size > TRIE_CHARS:
                if batch:
                    split = self.words(batch)
                    known = self.trie.encode({w for ws in split for w in ws})
                    out.update((x, [t for w in ws for t in known[w]]) for x, ws in zip(batch, split))
                batch, size = [], 0
            if p is not None:
                batch.append(p)
                size += len(p)
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        return [self.vocab[t] if t in self.vocab else self.tok.token_to_id(t) for t in tokens]

    def known(self, pieces: list[str]) -> dict[str, tuple[int, str, str]]:
        """Count, joined ids and joined tokens of each piece."""
        numbers = self.numbers
        number = numbers.__getitem__
        return {
            p: (1, numbers[ts[0]], ts[0]) if len(ts) == 1 else (len(ts), " ".join(map(number, ts)), " ".join(ts))
            for p, ts in self.encode(pieces).items()
        }


@lru_cache(maxsize=2)
def worker_state(path: str) -> tuple[WordCodec, Memo]:
    """One codec and memo for each worker process and file: tasks that a worker runs later find them filled."""
    return WordCodec(path), Memo(300_000)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without Python's search for cycles: words and tokens make none, and it would go through all of them again and
    again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _grouped(batch: pa.RecordBatch) -> Iterator[list[tuple[int, str, bool]]]:
    """The texts of a batch as (row, stretch, whether it is the row's last), in groups of about ``TEXT_CHARS``."""
    group: list[tuple[int, str, bool]] = []
    size = 0
    for row, text in enumerate(texts_of(batch)):
        parts = stretches(text)
        part = next(parts)
        while part is not None:
            after = next(parts, None)
            group.append((row, part, after is None))
            size += len(part)
            if size > TEXT_CHARS:
                yield group
                group, size = [], 0
            part = after
    if group:
        yield group


def _pieces(part: str) -> list[str]:
    return [p for ps in dropped_space(part) for p in ps]


class _Row:
    """Running count and digests of one text; ids and tokens are joined by one space."""

    def __init__(self):
        self.n, self.ids, self.decoded, self.first = 0, hashlib.sha256(), hashlib.sha256(), True

    def add(self, n: int, ids: str, tokens: str) -> None:
        if not n:
            return
        space = "" if self.first else " "
        self.n += n
        self.ids.update((space + ids).encode())
        self.decoded.update((space + tokens).encode())
        self.first = False


def _joined(parts: list[str], codec: WordCodec, memo: Memo) -> list[tuple[int, str, str]]:
    """Count, joined ids and joined tokens of each stretch of text.

    Python sees the distinct pieces of all of them only; cutting, numbering and joining are done on whole columns."""
    if sum(map(len, parts)) > WIDE_CHARS:
        cut = [_pieces(part) for part in parts]
        memo.young.update(codec.known(memo.missing(chain.from_iterable(cut))))
        found = [[k for k in map(memo.young.__getitem__, ps) if k[0]] for ps in cut]
        return [(sum(k[0] for k in ks), " ".join(k[1] for k in ks), " ".join(k[2] for k in ks)) for ks in found]
    # in a stretch without doubtful white space, Arrow's white space and Python's are the same
    odd = {i: pa.array(_pieces(part), pa.string()) for i, part in enumerate(parts) if DOUBTFUL.search(part)}
    plain = pc.ascii_split_whitespace(pa.array(["" if i in odd else part for i, part in enumerate(parts)], pa.string()))
    lengths = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = [plain.flatten()]
    if odd:
        lengths[list(odd)] += [len(x) for x in odd.values()]
        starts = plain.offsets.to_numpy()
        cut, at = [], 0
        for i, pieces in odd.items():  # after the one empty piece of the text that stands there in its place
            cut += [_values(plain, starts, at, i + 1), pieces]
            at = i + 1
        cut.append(_values(plain, starts, at, len(parts)))
    coded = pa.chunked_array(cut, pa.string()).combine_chunks().dictionary_encode()
    pieces = coded.dictionary.to_pylist()
    memo.young.update(codec.known(memo.missing(pieces)))
    n, ids, tokens = zip(*map(memo.young.__getitem__, pieces)) if pieces else ((), (), ())
    row, counts = coded.indices.to_numpy(), np.array(n, np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    total = np.concatenate(([0], np.cumsum(counts[row])))[ends]
    some = counts[row] > 0  # pieces without a token leave no space
    at = pa.array(row[some])
    ends = pa.array(np.concatenate(([0], np.cumsum(some)))[ends].astype(np.int32))
    both = [pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(x, pa.string()).take(at)), " ").to_pylist() for x in (ids, tokens)]
    return list(zip(np.diff(total).tolist(), *both))


def _values(lists: pa.ListArray, starts: np.ndarray, first: int, end: int) -> pa.Array:
    """The values of the lists from ``first`` to before ``end``."""
    return lists.values.slice(starts[first], starts[end] - starts[first])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256`` (the decoded
    text) of every whole text; the file has no decoder, so decoding joins tokens by a space.

    One pass without shuffle: distinct new words of a few MB of text go into a trie, and pieces of text are remembered
    within bounds.  Texts go through in stretches and their digests are running ones, so no text's ids are held whole.
    Null texts count as empty; ids may be null or repeated, one row comes out for each row; other columns aren't read."""

    def batch_of(batch: pa.RecordBatch, codec: WordCodec, memo: Memo) -> pa.RecordBatch:
        rows, row = [], _Row()
        for group in _grouped(batch):
            for (_, _, last), known in zip(group, _joined([part for _, part, _ in group], codec, memo)):
                row.add(*known)
                if last:
                    rows.append((row.n, row.ids.hexdigest(), row.decoded.hexdigest()))
                    row = _Row()
            memo.trim()
        n, ids, decoded = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = worker_state(path)
        for batch in batches:
            with _no_cycles():
                done = batch_of(batch, codec, memo)
            yield done

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves (``ids`` array) and the decoded text (``decoded``) beside the id; one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = WordCodec(path), Memo()
        for batch in batches:
            ids, decoded, tokens = [], [], []
            for group in _grouped(batch):
                cut = [_pieces(part) for _, part, _ in group]
                memo.young.update(codec.encode(memo.missing(p for ps in cut for p in ps)))
                for (_, _, last), pieces in zip(group, cut):
                    tokens += [t for p in pieces for t in memo.young[p]]
                    if last:
                        ids.append(codec.ids(tokens))
                        decoded.append(" ".join(tokens))
                        tokens = []
                memo.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["_id", "ids", "decoded"]
            )

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
