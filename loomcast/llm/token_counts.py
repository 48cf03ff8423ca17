"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.pieces import Memo, by_bytes, dropped_space, leading_space, single_threaded, texts_of

#: bytes that are encoded in one call of the library
BATCH_BYTES = 1 << 19


def open_tokenizer(path: str):
    """(encode a batch of texts to lengths, how to cut texts) for a ``.json`` or ``.model`` file.

    Texts are cut at white space where the file's pattern says that no token spans it: byte-level patterns keep white
    space with the next word, patterns that match only what isn't white space drop it.  For any other file texts stay
    whole."""
    single_threaded()
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda xs: [len(i) for i in sp.encode(xs, num_threads=1)]), (lambda t: iter([[t]]))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return (lambda xs: [len(e.ids) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]), cutter(path)


def cutter(path: str):
    """The way to cut texts for a tokenizers file, told from the file's own pattern."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in spec.get("added_tokens", []))
    if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return leading_space
    parts = pre.get("pretokenizers", [])
    if plain and parts and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed":
        if r"\s" not in parts[0]["pattern"].get("Regex", r"\s").replace(r"[^\s", ""):
            return dropped_space
    return lambda t: iter([[t]])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text, in one pass without shuffle.

    Texts are split at safe boundaries and only pieces that a worker doesn't know yet are encoded, in batches of about
    ``BATCH_BYTES``; what it remembers is bounded.  Long texts are split in stretches first.  Null texts count as
    empty (0 tokens); ids may be null or repeated, one row comes out for each row; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cut = open_tokenizer(path)
        memo = Memo()
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in texts_of(batch):
                total = 0
                for pieces in cut(text):
                    new = memo.missing(pieces)
                    for some in by_bytes(new, BATCH_BYTES):
                        memo.young.update(zip(some, lengths(some)))
                    total += sum(map(memo.young.__getitem__, pieces))
                    memo.trim()
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
