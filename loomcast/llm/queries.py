"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import chat, toxicity, whitening
from loomcast.llm.bpe_trie import encode_decode
from loomcast.llm.common import table
from loomcast.llm.embedding_dedup import near_vectors
from loomcast.llm.exact_dedup import exact_groups
from loomcast.llm.line_dedup import near_lines
from loomcast.llm.near_dedup import near_groups
from loomcast.llm.packing import pack
from loomcast.llm.registry import QUERIES, SQL, query  # noqa: F401
from loomcast.llm.sharding import shard_documents
from loomcast.llm.spelling import spelling_variants
from loomcast.llm.token_counts import count_tokens
from loomcast.llm.token_files import read_tokens, write_tokens
from loomcast.session import scratch


@query("op7_exact_dedup", """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
  ON coalesce(d.text, '') = g.t
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_bpe_trie")
def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_near_dedup", """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS sh
    FROM (SELECT doc_id, ws, unnest(generate_series(1, CASE WHEN len(ws) < 5 THEN least(len(ws), 1) ELSE len(ws) - 4 END)) AS i FROM w))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 75 * (x.n + y.n - i)
), r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS c FROM r GROUP BY 1) c USING (doc_id)
""")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("_lid"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op2_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (SELECT vec_id, vec_id AS to_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) n USING (vec_id)
JOIN (SELECT vec_id, min(to_id) AS c FROM r GROUP BY 1) c USING (vec_id)
""")
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))



@query("op3_chat_formatting", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) x(conv_id, turn, role, text)
), e AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)')) AS marks FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    tree = chat.threads(rows.unionByName(more))
    return chat.digests(chat.format_trees(tree, "conv_id", "node", "parent", null_tree=True), "conv_id")


@query("op5_line_dedup", """
WITH RECURSIVE l AS (
  SELECT line, min(doc_id) AS doc_id, count(*) AS n_rows FROM
    (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY 1
), s AS (SELECT line, strlen(line) AS n FROM l WHERE strlen(line) >= 1
), p AS (
  SELECT a.line AS a, b.line AS b FROM s a JOIN s b ON b.n IN (a.n - 2, a.n - 1, a.n, a.n + 1, a.n + 2) AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 2
), r AS (SELECT DISTINCT a AS line, a AS to_line FROM p UNION SELECT r.line, p.b FROM r JOIN p ON r.to_line = p.a
), c AS (SELECT r.line, min(ROW(l.doc_id, l.line)) AS f FROM r JOIN l ON l.line = r.to_line GROUP BY 1
), k AS (SELECT a AS line, count(*) AS n_links FROM p GROUP BY 1
)
SELECT l.doc_id, md5(l.line) AS line_md5, l.n_rows, coalesce(k.n_links, 0) AS n_links, coalesce(c.f[1], l.doc_id) AS class_id,
  md5(coalesce(c.f[2], l.line)) AS class_md5, coalesce(c.f[2], l.line) = l.line AS kept
FROM l LEFT JOIN c USING (line) LEFT JOIN k USING (line)
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.md5("line").alias("line_md5"), "n_rows", "n_links", "class_id", F.md5("class_line").alias("class_md5"), "kept"
    )


@query("op11_spelling_variants", r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT))) AS tab
), r AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2
), x AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM r
), h AS (
  SELECT run, c, xor(list_reduce(list_transform(range(1, length(b), 2), lambda i: CAST('0x' || b[i : i + 1] AS BIGINT)),
    lambda a, v: xor(tab[1 + (xor(a, v) & 255)], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM x, t
), v AS (
  SELECT w AS word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS w, c FROM h)
  WHERE length(w) >= 6 GROUP BY 1 HAVING sum(c) >= 5
), d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word
), q AS (
  SELECT a, b, m.n AS bn, row_number() OVER (PARTITION BY a ORDER BY m.n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near
  FROM p JOIN v m ON m.word = p.b
), f AS (
  SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.bn >= 5 * v.n THEN q.b END AS form, CASE WHEN q.bn >= 5 * v.n THEN q.bn END AS form_n
  FROM v LEFT JOIN q ON q.a = v.word AND q.k = 1
), s AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token_files")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    out = whitening.whiten(vectors, whitening.fit(vectors))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
