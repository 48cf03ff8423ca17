"""Token files: round trips against the tokenizers library, frames read alone, damage found."""

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from loomcast.llm.queries import op13_token_files
from loomcast.llm.token_files import FileReader, FileWriter, read_documents, read_tokens, write_tokens
from loomcast.session import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


TOK = Tokenizer.from_file(PATH)
TOK.no_truncation(), TOK.no_padding()


def ids_of(text):
    return np.array(TOK.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()


def expected(rows):
    """(id, start, n_tokens, crc) in ascending order; rows of one id in any order are compared by the caller."""
    out, at = [], 0
    for i, t in rows:
        ids = ids_of(t)
        out.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_query_against_the_library(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op13_token_files(spark, sf).collect())
    assert got == expected(rows)


def test_odd_rows_in_many_files(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(60)] + [(70, None), (71, ""), (72, "<|endoftext|> x"), (-3, "früh 　 \x00")]
    rows += [(80, "long words and more " * 60_000), (81, "x" * 5000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, _id int")
    folder = scratch(spark, "odd")
    files = write_tokens(df, PATH, folder, frame_ids=1000, file_rows=9).collect()
    assert len(files) > 4 and [r["start"] for r in files] == list(np.cumsum([0] + [r["tokens"] for r in files[:-1]]))
    assert sorted(tuple(r) for r in read_tokens(spark, folder).collect()) == expected(sorted(rows, key=lambda r: r[0]))
    wanted = spark.createDataFrame([(5,), (80,), (71,), (5,), (None,), (12345,)], "doc_id long")
    got = {r["doc_id"]: bytes(r["ids"]) for r in read_documents(spark, folder, wanted).collect()}
    text = dict(rows)
    assert got == {i: ids_of(text[i]) for i in (5, 71, 80)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "no id"), (None, "no id either"), *[(4, "same")] * 50, *[(4, f"other {i}") for i in range(50)], (9, "end")]
    folder = scratch(spark, "repeated")
    files = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, folder, file_rows=10).collect()
    assert len(files) > 5, "rows of one id are dealt over files"
    got = sorted((tuple(r) for r in read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, *[4] * 100, 9]
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(ids_of(t)) for _, t in rows)
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    again = read_documents(spark, folder, spark.createDataFrame([(4,)], "doc_id long"))
    assert again.count() == 100


def test_empty_table(spark):
    folder = scratch(spark, "none")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert write_tokens(none, PATH, folder).collect() == []
    assert read_tokens(spark, folder).collect() == []
    assert read_documents(spark, folder, none).collect() == []


def written(docs, frame_ids=100):
    out = io.BytesIO()
    w = FileWriter(out, frame_ids)
    for i, ids in docs:
        w.begin(i)
        for at in range(0, len(ids), 52):
            w.add(ids[at : at + 52])
    w.close()
    return out.getvalue()


def test_frames_stand_alone():
    rnd = np.random.default_rng(1)
    docs = [(int(i), rnd.integers(0, 50_000, n).astype("<u4").tobytes()) for i, n in enumerate((3, 250, 0, 1, 99, 1000))]
    data = written(docs)
    whole = b"".join(x for _, x in docs)
    reader = FileReader(Source(data))
    assert b"".join(reader.frame(i) for i in reversed(range(reader.frames))) == b"".join(
        whole[400 * i : 400 * i + 400] for i in reversed(range(reader.frames)))
    ids, nulls, counts = reader.index()
    assert ids.tolist() == list(range(6)) and not nulls.any() and counts.tolist() == [3, 250, 0, 1, 99, 1000]
    # an ordinary reader of zstandard streams goes over all frames, and skips the table
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert stream.startswith(whole) and stream[len(whole) : len(whole) + 8] == b"LCTOKIX1"


def test_damage_is_found():
    docs = [(1, bytes(range(200)) * 10), (2, bytes(range(200)) * 3)]
    data = written(docs)
    reader = FileReader(Source(data))
    (n,) = struct.unpack("<I", data[-9:-5])
    at = len(data) - 9 - 12 * n  # the checksum of the first frame, in the table
    bad = bytearray(data)
    bad[at + 8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        FileReader(Source(bytes(bad))).frame(0)
    assert FileReader(Source(bytes(bad))).frame(1) == reader.frame(1)
    for cut in (data[:-1], data[1:], data[: len(data) // 2], b""):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            FileReader(Source(cut)).index()
