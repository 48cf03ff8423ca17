"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window lengths compared,
thresholds calibrated.

Windows are of three kinds, each with a pair of dictionaries and a threshold of its own: words between white space (a
long run is cut into overlapping windows), ``PHRASE`` neighbouring words, and ``SIGNS`` letters of runs longer than
that, as text without white space has them.  A window is written in a wide code (8 or 16 bytes for each four letters or
each two words) and compressed with both dictionaries; the gain is the ordinary length less the toxic one.  In the wide
code a hit of one or two units outweighs the fixed cost of a compressed block, and shorter chance hits don't count:
plain bytes gave an area under the curve of 0.6 to 0.9 on the given tables, the wide code 0.999.

Dictionaries are raw content: stretches of the training text of their class, the most frequent last.  As toxic documents
are mostly ordinary text, the toxic one holds those stretches of toxic text (beginnings of words, two or three words,
four to eight letters) that set it apart by a likelihood ratio: they stand in many of its documents, in as many
different neighbourhoods (so copies of one document don't count), and hardly elsewhere."""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.pieces import texts_of

GRAM = 4
#: letters of a window, and by how many neighbours of a long run overlap
WINDOW, OVERLAP = 64, 16
#: words of a window of phrases
PHRASE = 3
#: letters of a window of signs; they start every half of it
SIGNS = 16
#: neighbours that are told apart when contexts are counted
CONTEXTS = 64
#: how much likelier a stretch must be in toxic documents
TIMES = 20
#: bytes of an ordinary dictionary
DICTIONARY = 3_000_000
#: windows whose result a worker remembers
KNOWN = 150_000


def windows(text: str) -> list[str]:
    out = []
    for w in text.lower().split():
        if len(w) <= WINDOW:
            out.append(w)
        else:
            out += [w[i : i + WINDOW] for i in range(0, len(w) - OVERLAP, WINDOW - OVERLAP)]
    return out


def grams(padded: str) -> list[str]:
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


class Words:
    """Windows of one word, with the white space around it; stretches are beginnings of 5 to 12 letters."""

    sizes = range(5, 13)

    @staticmethod
    def units(stretch: str) -> list[str]:
        return grams(stretch)

    @staticmethod
    def code(stretch: str) -> bytes:
        return b"".join(xxhash.xxh64_digest(g.encode("utf-8", "surrogatepass")) for g in grams(stretch))

    @staticmethod
    def windows(ws: list[str]) -> list[str]:
        return [f" {w} " for w in ws]

    @staticmethod
    def stretches(ws: list[str], k: int) -> set[str]:
        return {f" {w} "[:k] for w in ws if len(w) + 2 >= k}

    @classmethod
    def places(cls, ws: list[str]) -> Iterator[tuple[str, object, object]]:
        """Every stretch with its neighbours."""
        for i, w in enumerate(ws):
            padded, last, following = f" {w} ", ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else ""
            for k in cls.sizes:
                if k <= len(padded):
                    yield padded[:k], last, following

    @staticmethod
    def samples(ws: list[str]) -> list[str]:
        return [f" {w} " for w in ws]

    marks = frozenset

    @staticmethod
    def candidates(ws: list[str], marks: frozenset, clean: set[str]) -> list[str]:
        """Windows that share a unit with the dictionary; ``clean`` remembers words that don't."""
        new = set(ws).difference(clean)
        sure = {w for w in new if not marks.isdisjoint(grams(f" {w} "))}
        if len(clean) > KNOWN:
            clean.clear()
        clean |= new - sure
        return [f" {w} " for w in ws if w in sure] if sure else []


class Phrases:
    """Windows of three words; stretches are two or three words in a row, units two."""

    sizes = range(2, PHRASE + 1)

    @staticmethod
    def units(stretch: tuple) -> list[tuple]:
        return list(zip(stretch, stretch[1:]))

    @staticmethod
    def code(stretch: tuple) -> bytes:
        return b"".join(xxhash.xxh128_digest(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(stretch, stretch[1:]))

    @staticmethod
    def windows(ws: list[str]) -> list[tuple]:
        return [tuple(ws[i : i + PHRASE]) for i in range(max(len(ws) - PHRASE + 1, 1))] if len(ws) > 1 else []

    @staticmethod
    def stretches(ws: list[str], k: int) -> set[tuple]:
        return set(zip(*(ws[i:] for i in range(k))))

    @classmethod
    def places(cls, ws: list[str]) -> Iterator[tuple[tuple, object, object]]:
        for k in cls.sizes:
            for i, p in enumerate(zip(*(ws[j:] for j in range(k)))):
                yield p, ws[i - 1] if i else "", ws[i + k] if i + k < len(ws) else ""

    @classmethod
    def samples(cls, ws: list[str]) -> list[tuple]:
        return cls.windows(ws)

    @staticmethod
    def marks(units: set[tuple]) -> dict[str, set[str]]:
        """The second words by the first."""
        out = defaultdict(set)
        for a, b in units:
            out[a].add(b)
        return dict(out)

    @staticmethod
    def candidates(ws: list[str], marks: dict[str, set[str]], clean: set[str]) -> list[tuple]:
        at = [i for i, w in enumerate(ws[:-1]) if w in marks and ws[i + 1] in marks[w]]
        last = max(len(ws) - PHRASE, 0)
        starts = {min(max(j, 0), last) for i in at for j in range(i - PHRASE + 2, i + 1)}
        return [tuple(ws[i : i + PHRASE]) for i in sorted(starts)]


class Signs:
    """Windows of 16 letters of runs longer than that; stretches are four to eight letters anywhere in them."""

    sizes = range(4, 9)

    @staticmethod
    def units(stretch: str) -> list[str]:
        return grams(stretch)

    @staticmethod
    def code(stretch: str) -> bytes:
        return b"".join(xxhash.xxh128_digest(g.encode("utf-8", "surrogatepass")) for g in grams(stretch))

    @staticmethod
    def windows(ws: list[str]) -> list[str]:
        half = SIGNS // 2
        return [w[i : i + SIGNS] for w in ws if len(w) > SIGNS for i in range(0, len(w) - half, half)]

    @staticmethod
    def stretches(ws: list[str], k: int) -> set[str]:
        return {w[i : i + k] for w in ws if len(w) > SIGNS for i in range(len(w) - k + 1)}

    @classmethod
    def places(cls, ws: list[str]) -> Iterator[tuple[str, object, object]]:
        for w in ws:
            if len(w) > SIGNS:
                for k in cls.sizes:
                    for i in range(len(w) - k + 1):
                        yield w[i : i + k], w[max(i - 2, 0) : i], w[i + k : i + k + 2]

    @classmethod
    def samples(cls, ws: list[str]) -> list[str]:
        return cls.windows(ws)

    marks = frozenset

    @classmethod
    def candidates(cls, ws: list[str], marks: frozenset, clean: set[str]) -> list[str]:
        return [w for w in cls.windows(ws) if not marks.isdisjoint(grams(w))]


KINDS = (Words, Phrases, Signs)


def originals(docs: list[tuple[list[str], int]]) -> Iterator[tuple[list[str], int]]:
    """The documents without near copies of earlier ones: those that share more than half of their (up to) eight least
    hashed runs of three words.  Copies of one document must not pass for many documents that say the same; documents
    that share a phrase aren't copies."""
    seen: set[int] = set()
    for ws, toxic in docs:
        runs = {xxhash.xxh3_64_intdigest(" ".join(ws[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(len(ws) - 2)}
        least = heapq.nsmallest(8, runs)
        if 2 * len(seen.intersection(least)) <= len(least):
            yield ws, toxic
        seen.update(least)


def distinctive(docs: list[tuple[list[str], int]], kind: type = Words) -> dict:
    """Stretches of toxic text that set it apart, with the documents they stand in; ``docs`` without copies.

    They are counted length by length, and neighbours only of those that documents already speak for, so that little
    is held at a time."""
    n = Counter(t for _, t in docs)
    if not n[1]:
        return {}
    found: dict = {}
    seen: dict = {}  # documents of the stretches found, and of those that lengthen one
    looked = 0
    for k in kind.sizes:
        here: Counter = Counter()
        for ws, toxic in docs:
            if toxic:
                here.update(kind.stretches(ws, k))
        common = {p: c for p, c in here.items() if c > 1}
        del here
        looked += len(common)
        elsewhere: Counter = Counter()
        for ws, toxic in docs:
            if not toxic:
                elsewhere.update(p for p in kind.stretches(ws, k) if p in common)
        for p, a in common.items():
            b = elsewhere[p]
            if a / n[1] >= TIMES * (b + 0.5) / max(n[0], 1):
                found[p] = a, b
            if p in found or p[:-1] in seen:
                seen[p] = a
    significant = 2 * math.log(max(looked, 2))  # so that chance alone lets about one of all of them through
    found = {p: ab for p, ab in found.items() if _ratio(ab[0], n[1], ab[1], n[0]) > significant}
    if not found:
        return {}
    before, after = defaultdict(set), defaultdict(set)
    for ws, toxic in docs:
        for p, last, following in kind.places(ws) if toxic else ():
            if p in found:
                if len(before[p]) < CONTEXTS:
                    before[p].add(last)
                if len(after[p]) < CONTEXTS:
                    after[p].add(following)
    kept = set()
    for p, (a, b) in found.items():
        contexts = min(len(before[p]), len(after[p]))
        a = a if contexts >= CONTEXTS else min(a, contexts)
        if a > 1 and a / n[1] >= TIMES * (b + 0.5) / max(n[0], 1) and _ratio(a, n[1], b, n[0]) > significant:
            kept.add(p)
    # of nested beginnings the shortest, lengthened while most of its documents stay
    longer = defaultdict(list)
    for p in seen:
        longer[p[:-1]].append(p)
    out = {}
    for p in kept:
        if any(p[:k] in kept for k in range(kind.sizes.start, len(p))):
            continue
        while longer[p]:
            q = max(longer[p], key=lambda x: (seen[x], x))
            if seen[q] < 0.7 * seen[p]:
                break
            p = q
        out[p] = seen[p]
    return out


def _ratio(a: int, n1: int, b: int, n0: int) -> float:
    p = (a + b) / (n1 + n0)
    return 2 * (a * math.log(a / (n1 * p)) + (b * math.log(b / (n0 * p)) if b else 0.0))


def _compressor(dictionary: bytes) -> zs.ZstdCompressor:
    """No frame extras, and matches of six bytes at least."""
    params = zs.ZstdCompressionParameters(
        window_log=22, chain_log=20, hash_log=19, search_log=5, min_match=6, target_length=64, strategy=zs.STRATEGY_LAZY2,
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    if not dictionary:
        return zs.ZstdCompressor(compression_params=params)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass
class Pair:
    """The two dictionaries of one kind of windows; ``threshold`` is the least gain of a window that counts as a hit."""

    kind: type
    toxic: bytes
    ordinary: bytes
    marks: frozenset | dict
    threshold: int = 1


@dataclass
class Model:
    """Dictionaries of each kind, and the calibration: a constant, then for each kind the best gain and the hits."""

    pairs: list[Pair]
    weights: tuple[float, ...] = (-3.0,) + (0.0,) * 6
    sample: dict = field(default_factory=dict)

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Gains:
    """Gains of the windows of one kind; what it remembers of windows is bounded."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.co, self.ct = _compressor(pair.ordinary), _compressor(pair.toxic)
        self.alone = _compressor(b"")
        self.clean: set[str] = set()
        self.known: dict = {}

    def gain(self, window) -> int:
        """How many bytes shorter the toxic dictionary makes the window than the ordinary one or none, 0 if not."""
        code = self.pair.kind.code(window)
        return max(0, min(len(self.co.compress(code)), len(self.alone.compress(code))) - len(self.ct.compress(code)))

    def of(self, ws: list[str]) -> list[int]:
        """Gains of those windows that gain.  A window that shares no unit with the toxic dictionary finds nothing in
        it, so its length is that without a dictionary, its gain 0: it isn't compressed."""
        if not self.pair.toxic:
            return []
        out = []
        for w in self.pair.kind.candidates(ws, self.pair.marks, self.clean):
            g = self.known.get(w)
            if g is None:
                if len(self.known) > KNOWN:
                    self.known.clear()
                g = self.known[w] = self.gain(w)
            if g:
                out.append(g)
        return out


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: Model):
        self.model = model
        self.gains = [Gains(p) for p in model.pairs]

    def measure(self, ws: list[str]) -> list[list[int]]:
        return [g.of(ws) for g in self.gains]

    def score(self, text: str) -> float:
        thresholds = [p.threshold for p in self.model.pairs]
        return float(_probability(self.model.weights, _features(self.measure(windows(text)), thresholds)))


def _features(gains: list[list[int]], thresholds: list[int]) -> np.ndarray:
    out = [1.0]
    for given, threshold in zip(gains, thresholds):
        best, hits = max(given, default=0), sum(g >= threshold for g in given)
        out += [min(best, 3 * threshold) / threshold, math.log1p(hits)]
    return np.array(out)


def _probability(weights, x):
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(weights), -30, 30)))


def _dictionaries(docs: list[tuple[list[str], int]]) -> list[Pair]:
    """The dictionaries of each kind.  A stretch goes to the class it is likelier in: ordinary samples that begin with a
    stretch of the toxic dictionary stay out of the ordinary one."""
    docs = list(originals(docs))
    out = []
    for kind in KINDS:
        begins = distinctive(docs, kind)
        if not begins:
            out.append(Pair(kind, b"", b"", frozenset()))
            continue
        lengths = sorted({len(p) for p in begins})
        counts = Counter(w for ws, toxic in docs if not toxic for w in kind.samples(ws))
        parts, size = [], 0
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if any(w[:k] in begins for k in lengths):
                continue
            code = kind.code(w)
            size += len(code)
            if size > DICTIONARY:
                break
            parts.append(code)
        order = sorted(begins, key=lambda p: (begins[p], p))
        marks = kind.marks({u for p in begins for u in kind.units(p)})
        ordinary = b"".join(dict.fromkeys(reversed(parts))) or bytes(range(64))
        out.append(Pair(kind, b"".join(map(kind.code, order)), ordinary, marks))
    return out


def fit_sample(texts: list[tuple[int, str, int]]) -> Model:
    """A model from labelled texts (id, text, 0 or 1).  Dictionaries made from either half of the sample measure the
    other half; on those gains the threshold of each kind and the weights of a logistic score are calibrated; the final
    dictionaries are made from the whole sample.  Without texts of both classes the score is one constant below 0.7.

    Repeated texts and near copies teach once, texts without words nothing; the order of ``texts`` matters only for
    which of several near copies teaches."""
    same: dict[str, str] = {}  # one object for each word
    docs = [([same.setdefault(w, w) for w in windows(t)], toxic, i) for i, t, toxic in texts]
    model = Model(_dictionaries([(ws, toxic) for ws, toxic, _ in docs]))
    model.sample = dict(Counter(toxic for _, toxic, _ in docs))
    if not any(p.toxic for p in model.pairs) or not docs:
        return model
    halves = [[], []]
    for d in docs:
        halves[xxhash.xxh64_intdigest(str(d[2])) & 1].append(d)
    gains, labels = [], []
    for learn, apply in (halves, halves[::-1]):
        scorer = Scorer(Model(_dictionaries([(ws, toxic) for ws, toxic, _ in learn])))
        for ws, toxic, _ in apply:
            gains.append(scorer.measure(ws))
            labels.append(toxic)
    y = np.array(labels, float)
    for i, pair in enumerate(model.pairs):
        tops = np.array([max(g[i], default=0) for g in gains])
        right = {t: np.mean((tops >= t) == (y == 1)) for t in range(1, 65)}
        good = [t for t in right if right[t] >= max(right.values()) - 0.0005]
        pair.threshold = good[len(good) // 2]
    x = np.stack([_features(g, [p.threshold for p in model.pairs]) for g in gains])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a weak prior, which keeps separable samples finite
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.05 * w
        hess = (x.T * (p * (1 - p))) @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    model.weights = tuple(float(v) for v in w)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", toxic_docs: int = 1200, ordinary_docs: int = 2400, longest: int = 65_536,
) -> Model:
    """Fit on a bounded sample of labelled documents: at most ``toxic_docs`` and ``ordinary_docs`` of those that
    ``learn`` (a condition on the id) allows, the first in the order of a hash of the id.  Of a text of more than
    ``longest`` characters a stretch of that length teaches, whose place a hash of the id tells.  Nothing but text and
    label is looked at.  Rows without id, label or text teach nothing; where an id stands on several texts the least one
    teaches, where it has both labels it counts as toxic.  Without labelled rows the score is a constant below 0.7."""
    lab = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y")).where("_lid IS NOT NULL AND _y IN (0, 1)")
    if learn is not None:
        lab = lab.where(learn)
    lab = lab.groupBy("_lid").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_lid"))
    pick = lambda y, n: lab.where(F.col("_y") == y).orderBy("_h", "_lid").limit(n)
    chosen = pick(1, toxic_docs).unionByName(pick(0, ordinary_docs)).drop("_h")
    texts = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).cast("string").alias("_t")).where("_t IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "_lid").groupBy("_lid").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y"))
    start = F.pmod(F.xxhash64("_lid"), F.greatest(F.length("_t") - longest + 1, F.lit(1))).cast("int") + 1
    rows = rows.withColumn("_t", F.when(F.length("_t") <= longest, F.col("_t")).otherwise(F.substring("_t", start, longest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_sample(sorted(given)))], pa.binary())], ["model"])

    # one task gets the sample, which is bounded, and gives the model, a few MB
    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit_sample([])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every whole text, in one pass without shuffle.

    Null and empty texts have no window and get the score of a text without hits; very long ones are read whole; ids
    may be null or repeated, equal texts get equal scores; other columns aren't read; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            s = [scorer.score(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["_id", "score"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: Model, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all its columns and other rows stay as they are.
    Null and empty texts count as texts without hits; repeated rows are judged alike; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "") < limit for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
