"""Token counts and trie encoding against the tokenizers library itself."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomcast.llm import bpe_trie
from loomcast.llm.bpe_trie import TrieEncoder, WordCodec, encode_decode, encoded
from loomcast.llm.common import table
from loomcast.llm.pieces import Memo, stretches
from loomcast.llm.queries import op8_token_counts, op9_bpe_trie
from loomcast.llm.token_counts import count_tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "\x0bhello　 x", "a\xa0b  c ", "'s 'LL they've", "İſΑΣ", "ﬁẛ̣", " ́x", "<|endoftext|>", "a<|startoftext|>b",
    "x" * 5000, "tail \n\n", "\x1c\x1f\x85", "漢字\U0001f600", "1234 5a6", "word " * 3000,
]


def odd_texts():
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\xa0", " ", "'s", "ing", "hello", "é", "Σ", "<|endoftext|>", "....", "9", "aaaa", "\x0b", "​"]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(400)]


def texts(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}


def want(path, text):
    tok = Tokenizer.from_file(path)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_counts_whole_table(spark, sf):
    docs, tok = texts(spark, sf), Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in op8_token_counts(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 2048)


@pytest.mark.parametrize("path", [WORD, BYTE, public_tokenizers.path("piece_bpe_32k.model")])
def test_counts_of_odd_texts(spark, path):
    rows = list(enumerate(odd_texts())) + [(None, None), (1, "again")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t or ""))
    else:
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, count(t)) for i, t in rows)


def test_trie_whole_table(spark, sf):
    docs, tok = texts(spark, sf), Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in op9_bpe_trie(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


def test_trie_odd_texts(spark):
    rows = list(enumerate(odd_texts())) + [(-5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in encoded(df, WORD).collect()}
    digests = {r.doc_id: r for r in encode_decode(df, WORD).collect()}
    for i, t in rows:
        ids, text = want(WORD, t)
        assert got[i].ids == ids and got[i].decoded == text
        assert digests[i].ids_sha256 == sha(" ".join(map(str, ids))) and digests[i].decoded_sha256 == sha(text)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, WORD).collect() == [] and count_tokens(empty, WORD).collect() == []


def test_trie_equals_the_definition():
    rnd = random.Random(2)
    letters = "abc"
    vocab = {**{c: i for i, c in enumerate(letters)}, **{c + "$": 10 + i for i, c in enumerate(letters)}}
    merges = []
    for _ in range(25):
        a, b = rnd.choice([t for t in vocab if not t.endswith("$")]), rnd.choice(list(vocab))
        if a + b not in vocab:
            vocab[a + b] = len(vocab) + 100
            merges.append((a, b))
    enc = TrieEncoder(vocab, merges, "$")
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(500)}
    got = enc.encode(words)
    assert all(got[w] == enc.merged([*w[:-1], w[-1] + "$"]) for w in words)


def test_merged_equals_the_definition():
    rnd = random.Random(3)
    pairs = [(a, b) for a in ("a", "b", "aa", "ab", "ba") for b in ("a", "b", "aa", "bb")]
    rnd.shuffle(pairs)
    enc = TrieEncoder({}, pairs, "")
    for _ in range(500):
        out = [rnd.choice("ab") for _ in range(rnd.randint(0, 12))]
        got = enc.merged(out)
        while found := [(enc.rank[p], i) for i, p in enumerate(zip(out, out[1:])) if p in enc.rank]:
            i = min(found)[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        assert got == out


@pytest.mark.parametrize("wide", [0, 1 << 26])
def test_python_sees_each_piece_of_many_texts_once(monkeypatch, wide):
    rnd = random.Random(4)
    signs = ["a", "The", "\u00c9", "9", "!", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u200b", "\u65e5", "\ufeff", "<|endoftext|>", "\x00", "\x1c"]
    parts = ["", " ", "\x0b", "a", " a \n", *("".join(rnd.choices(signs, k=rnd.randint(0, 30))) for _ in range(300)), "the " * 5000]
    seen = []

    class Seen(Memo):
        def missing(self, pieces):
            seen.extend(pieces := list(pieces))
            return super().missing(pieces)

    monkeypatch.setattr(bpe_trie, "WIDE_CHARS", wide)
    got = bpe_trie._joined(parts, WordCodec(WORD), Seen())
    assert bpe_trie._joined([], WordCodec(WORD), Memo()) == []
    for t, known in zip(parts, got, strict=True):
        ids, text = want(WORD, t)
        assert known == (len(ids), " ".join(map(str, ids)), text)
    assert not wide or len(seen) == len(set(seen))


def test_stretches_join_back():
    text = "some words  and\nlines " * 500
    parts = list(stretches(text, 100))
    assert "".join(parts) == text and len(parts) > 50 and all(b[0] in " \n" and a[-1].strip() for a, b in zip(parts, parts[1:]))
    assert list(stretches("x" * 1000, 10)) == ["x" * 1000]
