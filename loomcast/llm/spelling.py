"""Groups of spelling variants: words one edit apart, found by search schemes over FM-indexes of the vocabulary.

A word and its neighbour at one edit share the word's first half from their start or its second half to their end.  So a
half is matched exactly, and the match is extended across the other half with one error, as intervals of suffix ranks over
the delimited words: to the left in an index of the words, to the right in an index of the words written backwards.

The vocabulary grows with the corpus, so it is dealt out: a half has at least three code points, hence a word meets all
its neighbours of one side among the words with the same three first (or last) ones.  Groups of such words share an index
in a task of bounded size; a larger group is dealt by word length, then in blocks of indexed words against blocks of
searched ones.  What leaves a task is one row per searched word, never a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import narrow_join, settle

#: words that one index holds, about
BLOCK = 20_000
#: code points of the shared start or end by which words are dealt out: half of the shortest word
GRAM = 3
#: words searched at a time inside a task
BATCH = 2_000


class FmIndex:
    """Suffix ranks over ``words``, each between delimiters, with backward steps for many intervals at once.

    Symbols: 0 ends the text, 1 delimits, the others are the code points used, in order."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\x01" + "\x01".join(words) + "\x01\x00").encode("utf-32-le"), dtype="<u4")
        self.letters, codes = np.unique(text, return_inverse=True)
        n = self.n = len(codes)
        rank, width = codes.astype(np.int64), 1
        while True:  # suffixes by their first `width` symbols, doubled until all differ
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if rank[order[-1]] == n - 1:
                break
            width *= 2
        self.bwt = codes[order - 1]
        #: (symbol, rank) pairs in order: the place of (c, i) among them is where a step by c leads the bound i
        self.steps = np.sort(self.bwt * (n + 1) + np.arange(n))
        starts = np.flatnonzero(codes == 1)[:-1]
        self.word_at = np.full(n, -1, dtype=np.int64)
        self.word_at[rank[starts]] = np.arange(len(words))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol to the left."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)

    def before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different letters in front of each interval, as pairs (interval, letter)."""
        sigma, size = len(self.letters), hi - lo
        small = np.flatnonzero(size <= 2 * sigma)
        which = np.repeat(small, size[small])
        ahead = np.arange(len(which)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        found = np.unique(which * sigma + self.bwt[lo[which] + ahead])
        wide = np.flatnonzero(size > 2 * sigma)
        pairs = np.concatenate([found, (wide[:, None] * sigma + np.arange(sigma)).ravel()])
        which, symbol = pairs // sigma, pairs % sigma
        letter = symbol >= 2
        return which[letter], symbol[letter]

    def one_edit(self, words: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``words``, indexed word): the last ``exact[i]`` letters of word i are matched exactly,
        the ones before with one letter inserted, deleted or replaced."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        exact_n = np.array(exact, dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        at = np.searchsorted(self.letters, flat)
        at[at == len(self.letters)] = 0
        code = np.where(self.letters[at] == flat, at, -1)  # -1: a letter that the index doesn't hold
        last = np.cumsum(lengths) - 1
        none = np.zeros(0, dtype=np.int64)

        def forward(q, symbol, lo, hi):
            lo, hi = self.step(symbol, lo, hi)
            ok = (symbol >= 0) & (hi > lo)
            return q[ok], lo[ok], hi[ok]

        q = np.arange(len(words), dtype=np.int64)  # without an error so far
        lo, hi = self.step(np.ones(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64), np.full(len(q), self.n))
        eq, elo, ehi = none, none, none  # with one
        hits_q, hits_w = [none], [none]
        done = 0
        while len(q) or len(eq):
            open_ = exact_n[q] <= done
            which, symbol = self.before(lo[open_], hi[open_])
            oq, olo, ohi = q[open_], lo[open_], hi[open_]
            xq, xlo, xhi = oq[which], *self.step(symbol, olo[which], ohi[which])
            ended = lengths[xq] == done
            eq, elo, ehi = (np.concatenate(x) for x in ((eq, xq), (elo, xlo), (ehi, xhi)))  # a letter inserted
            over = lengths[eq] == done
            if over.any():
                fq, flo, fhi = forward(eq[over], np.ones(int(over.sum()), dtype=np.int64), elo[over], ehi[over])
                size = fhi - flo
                hits_q.append(np.repeat(fq, size))
                inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                hits_w.append(self.word_at[np.repeat(flo, size) + inside])
                eq, elo, ehi = eq[~over], elo[~over], ehi[~over]
            eq, elo, ehi = forward(eq, code[last[eq] - done], elo, ehi)
            other = ~ended
            other[other] = symbol[other] != code[last[xq[other]] - done]
            more = lengths[oq] > done
            eq = np.concatenate([eq, xq[other], oq[more]])  # a letter replaced, a letter left out
            elo, ehi = np.concatenate([elo, xlo[other], olo[more]]), np.concatenate([ehi, xhi[other], ohi[more]])
            go = lengths[q] > done
            q, lo, hi = q[go], lo[go], hi[go]
            q, lo, hi = forward(q, code[last[q] - done], lo, hi)
            done += 1
        pairs = np.unique(np.concatenate(hits_q) * self.n + np.concatenate(hits_w))
        return pairs // self.n, pairs % self.n


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6) -> DataFrame:
    """``word`` and ``n`` for the runs of Latin letters of whole texts, a few of them damaged on purpose.

    A run is lower-cased in A-Z.  Where 199 divides h, the crc32 of ``<id>:<run>``, the code point h % length goes.
    Runs that end shorter than ``shortest`` aren't counted.  Null texts hold none; a null id counts as empty text."""
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"([A-Za-zÀ-ÿ]{{{shortest},}})"), 1)).alias("_run"),
    )
    h = F.crc32(F.concat("_id", F.lit(":"), "_run"))
    hole = F.expr("CAST(_h % length(_run) AS INT)")
    cut = F.concat(F.substring("_run", F.lit(1), hole), F.substring("_run", hole + 2, F.length("_run")))
    words = runs.withColumn("_h", h).select(F.when(F.col("_h") % 199 == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _gram(side: int) -> Column:
    return F.substring("word", 1, GRAM) if side == 0 else F.substring("word", -GRAM, GRAM)


def _dealt(words: DataFrame, total: int, block: int) -> DataFrame:
    """Rows (block, side, indexed, searched, word, n): blocks whose words an index holds or that are searched in it."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _gram(s).alias("gram")) for s in (0, 1)])).alias("_s")
    rows = words.select("word", "n", sides).select("word", "n", "_s.side", "_s.gram", F.length("word").alias("len"))
    counts = settle(rows.groupBy("side", "gram", "len").agg(F.count(F.lit(1)).alias("c")), "grams")
    hot = counts.groupBy("side", "gram").agg(F.sum("c").alias("all")).where(F.col("all") > block)
    cells = settle(
        counts.join(hot, ["side", "gram"]).select("side", "gram", "len", F.ceil(F.col("c") / block).cast("int").alias("parts")), "hot_grams"
    )
    known = settle(cells.select("side", "gram").distinct().withColumn("hot", F.lit(True)), "hot_names")
    rows = narrow_join(rows, known, ["side", "gram"], "left")
    buckets = max(1, -(-2 * total // block))
    plain = rows.where("hot IS NULL").select(
        F.concat_ws(":", F.lit("p"), "side", F.expr(f"pmod(xxhash64(gram), {buckets})")).alias("block"),
        "side", F.lit(True).alias("indexed"), F.lit(True).alias("searched"), "word", "n",
    )
    # of a hot group, the words of one length are indexed together; words of that length or one off are searched there
    own = rows.where("hot").withColumn("_h", F.xxhash64("word"))
    shift = own.withColumn("d", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).withColumn("mine", F.col("len"))
    cell = narrow_join(shift.withColumn("len", F.col("mine") + F.col("d")), cells, ["side", "gram", "len"])
    part = F.expr("pmod(_h, parts)")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    name = F.concat_ws(":", F.lit("h"), "side", "gram", "len", "_i", "_j")
    search = cell.withColumn("_j", part).withColumn("_i", F.explode(every)).withColumn("block", name)
    index = cell.where("d = 0").withColumn("_i", part).withColumn("_j", F.explode(every)).withColumn("block", name)
    out = ["block", "side", "indexed", "searched", "word", "n"]
    return (
        plain.unionByName(search.withColumns({"indexed": F.lit(False), "searched": F.lit(True)}).select(*out))
        .unionByName(index.withColumns({"indexed": F.lit(True), "searched": F.lit(False)}).select(*out))
    )


def _search(table: pa.Table) -> pa.Table:
    """The searched words of one block against its index: how many near words, and the best of them."""
    side = table.column("side")[0].as_py()
    turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
    known = table.filter(table.column("indexed")).select(["word", "n"])
    asked = table.filter(table.column("searched")).column("word").to_pylist()
    words, counts = known.column("word").to_pylist(), known.column("n").to_numpy()
    out: tuple[list, ...] = ([], [], [], [])
    if words and asked:
        index = FmIndex([turn(w) for w in words])
        order = np.empty(len(words), dtype=np.int64)
        order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        for at in range(0, len(asked), BATCH):
            batch = asked[at : at + BATCH]
            half = [len(w) // 2 for w in batch]
            exact = half if side == 0 else [len(w) - k for w, k in zip(batch, half)]
            q, w = index.one_edit([turn(x) for x in batch], exact)
            # what replacing or inserting the same letter found is the word itself; the first half's search has the rest
            keep = [
                words[b] != batch[a] and (side == 0 or words[b][: half[a]] != batch[a][: half[a]])
                for a, b in zip(q.tolist(), w.tolist())
            ]
            q, w = q[keep], w[keep]
            best = np.lexsort((order[w], -counts[w], q))
            q, w = q[best], w[best]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
            out[0].extend(batch[i] for i in q[first])
            out[1].extend(np.diff(np.concatenate([first, [len(q)]])).tolist())
            out[2].extend(counts[w[first]].tolist())
            out[3].extend(words[i] for i in w[first])
    cols = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))]
    return pa.Table.from_arrays(cols, ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, total: int | None = None, block: int = BLOCK) -> DataFrame:
    """For words of a settled frame (``word``, ``n``; distinct, of six code points or more) that have any: ``n_near``,
    the words at exactly one edit, and ``best_n``, ``best``, the most frequent of them (ties: least in code-point order)."""
    dealt = _dealt(words, words.count() if total is None else total, block)
    found = dealt.groupBy("block").applyInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    both = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return both.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the links (word, form), each form followed to its last.

    A form is several times as frequent as its word, so there are no rings and paths are as short as a logarithm of
    the largest count; each round doubles what is followed."""
    at = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = settle(at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots")
        at = step.select("word", "root")
        if step.where("_next IS NOT NULL").isEmpty():
            return at


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, ratio: int = 5,
    block: int = BLOCK,
) -> DataFrame:
    """One row per word of at least ``shortest`` code points (six or more) that occurs ``least`` times or more:
    ``word, form, root, n, n_near, form_n``.

    Words are near if one code point inserted, deleted or replaced makes one of the other.  A word's form is its near word
    of largest ``n`` (ties: the smallest in code-point order) if that is ``ratio`` times its own or more, else null; its root
    is the last of the forms, or the word itself.

    Null and empty texts hold no words; a null id counts as empty text; repeated ids and rows count each; very long texts and
    words are taken whole (a search takes as many steps as its longest word); an empty table gives no row; other columns
    aren't read, whatever their names."""
    if shortest < 2 * GRAM:
        raise ValueError(f"words shorter than {2 * GRAM} code points have halves too short to be dealt by")
    if ratio < 2:
        raise ValueError("forms of equal counts could point at each other; the ratio is two or more")
    words = settle(corpus_words(docs, id_col, text_col, shortest).where(F.col("n") >= least), "words")
    near = settle(near_words(words, words.count(), block), "near_words")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    rows = words.join(near, "word", "left").withColumn("form", form)
    rows = settle(rows.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(form IS NULL, NULL, best_n)").alias("form_n")), "forms")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
