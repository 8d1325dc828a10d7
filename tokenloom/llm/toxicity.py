"""Toxicity by multiple-instance learning: a document is toxic if any sentence is, so sentence scores meet in a noisy-or."""

from __future__ import annotations

import functools
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import parts

#: Labelled documents of each class that training takes at most, and bytes of their texts; features that may carry weight; bytes
#: of words, with some 100 for each, that a worker remembers.
SAMPLE, SAMPLE_BYTES, VOCABULARY, MEMORY = 3000, 32 << 20, 4000, 48 << 20
#: Standard deviations by which a feature must be more frequent in toxic documents than chance has it.
APART = 4.5
THRESHOLD = 0.7
_ENDS = ".!?\n\r\x0b\x0c"
#: ASCII only: upper to lower case, marks and digits to a space, sentence ends to a line feed.
_TABLE = bytes(10 if chr(i) in _ENDS else 32 if i < 32 or chr(i) in string.punctuation + string.digits else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def sentences(text: str) -> tuple[list[bytes], bytes]:
    """A text's sentences as bytes of words parted by spaces, and the whole of them as they stand in the text's UTF-8."""
    raw = text.encode("utf-8", "surrogatepass")
    if not text.isascii() and (low := text.lower()) != text and len(y := low.encode("utf-8", "surrogatepass")) == len(raw):
        raw = y  # kept only where offsets stay
    flat = raw.translate(_TABLE)
    return flat.split(b"\n"), flat


def features(word: bytes) -> list[bytes]:
    """A word, and its beginnings of four to eight characters, so that inflected and compound forms share what is learnt."""
    text = word.decode("utf-8", "replace")
    return [word, *(b"^" + text[:n].encode("utf-8", "replace") for n in range(4, min(9, len(text))))]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class NoisyOr:
    """Feature weights and the sentence bias; every distinct word of a sentence adds the weights of its features."""

    weights: dict[bytes, float]
    bias: float
    known: dict[bytes, float] = field(default_factory=dict)
    held: int = 0
    starts: frozenset[bytes] = frozenset()

    def __post_init__(self) -> None:
        self.starts = frozenset(f.removeprefix(b"^")[:3] for f in self.weights)

    def _learn(self, words: set[bytes]) -> None:
        if self.held > MEMORY:
            self.forget()
        for w in [w for w in words if w not in self.known]:
            self.known[w] = sum([self.weights.get(f, 0.0) for f in features(w)]) if w[:3] in self.starts else 0.0
            self.held += len(w) + 100

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def sentence(self, words: bytes) -> float:
        """The log-odds of one sentence."""
        found = {*words.split()}
        self._learn(found)
        return self.bias + sum([self.known[w] for w in sorted(found)])

    def bag(self, text: str | None) -> tuple[float, int | None, int | None, int | None, float | None]:
        """A text's score, and its worst sentence: number, place and length in bytes of the UTF-8 text, and own score.

        The score is 1 - the product of (1 - p) over all sentences that have words, 0 where there are none.  Of equally bad
        sentences the first counts.
        """
        all_ = sentences(text)[0] if text else []
        split = {k: found for k, s in enumerate(all_) if (found := set(s.split()))}
        if not split:
            return 0.0, None, None, None, None
        self._learn(set().union(*split.values()))
        get = self.known.__getitem__
        z = self.bias + np.array([fsum(map(get, found)) for found in split.values()])
        worst = list(split)[int(z.argmax())]
        place = sum(map(len, all_[:worst])) + worst
        return float(-np.expm1(-_softplus(z).sum())), worst, place, len(all_[worst]), float(1 / (1 + np.exp(-z.max())))

    def document(self, text: str | None) -> float:
        return self.bag(text)[0]


def fit(texts: list[str], labels: list[int], vocabulary: int = VOCABULARY, steps: int = 300, decay: float = 1e-3, totals: tuple[int, int] | None = None) -> NoisyOr:
    """Trains by gradient ascent on the noisy-or's log-likelihood.

    ``totals`` are the clean and the toxic documents of which texts are a sample: each class weighs as much as it has there.

    Features that are in clearly more toxic documents than chance has it (APART) get a weight: only such can make a sentence
    offend.  Without documents of both classes none counts and every score is near 0.
    """
    y = np.array(labels, dtype=np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return NoisyOr({}, -20.0)
    n0, n1 = (y == 0).sum(), (y == 1).sum()

    def sets(text: str) -> list[set[bytes]]:  # made anew in each pass, so that no more than one document's is held
        return [w for s in sentences(text)[0] if (w := {*s.split()})]

    toxic: Counter[bytes] = Counter()
    for text, label in zip(texts, labels, strict=True):
        if label == 1:
            toxic.update({f for w in set().union(*sets(text)) for f in features(w)})
    toxic = Counter({f: n for f, n in toxic.items() if n >= 3})
    clean_in: Counter[bytes] = Counter()
    for text, label in zip(texts, labels, strict=True):
        if label == 0:
            clean_in.update({f for w in set().union(*sets(text)) for f in features(w) if f in toxic})

    def apart(f: bytes) -> float:
        a, b = toxic[f], clean_in[f]
        p = (a + b + 1) / (n0 + n1 + 2)
        return (a - n1 * p) / np.sqrt(n1 * p * (1 - p) + 0.05)

    gap = {f: apart(f) for f in toxic}
    known = sorted((f for f, x in gap.items() if x >= APART), key=lambda f: (-gap[f], f))[:vocabulary]
    index = {f: i for i, f in enumerate(known)}
    empty = np.zeros(len(texts))
    row, column, owner = [], [], []
    for d, text in enumerate(texts):
        for s in sets(text):
            if hit := [index[f] for w in sorted(s) for f in features(w) if f in index]:
                row += [len(owner)] * len(hit)
                column += hit
                owner.append(d)
            else:
                empty[d] += 1
    row, column, owner = (np.array(x, dtype=np.int64) for x in (row, column, owner))
    weights, bias = np.zeros(len(known)), -4.0
    t0, t1 = totals or (n0, n1)
    scale = np.where(y == 1, t1 / n1, t0 / n0) / (t0 + t1)
    moment, square = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, weights[column], minlength=len(owner))
        log_clean = -np.bincount(owner, _softplus(z), minlength=len(y)) - empty * np.log1p(np.exp(bias))
        clean = np.exp(log_clean)
        pull = scale * np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)
        grad_z = pull[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(column, grad_z[row], minlength=len(known)) - decay * weights / max(1, len(known)) ** 0.5, grad_z.sum() + (pull * empty).sum() / (1 + np.exp(-bias)))
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        step = 0.15 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        weights, bias = weights + step[:-1], min(bias + step[-1], -1.0)
    return NoisyOr({w: float(x) for w, x in zip(known, weights, strict=True) if abs(x) > 1e-3}, float(bias))


# ---- DataFrames ----------------------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NoisyOr:
    """Fits on at most ``sample`` labelled documents of either class, those with the smallest hash of the id, and on as many of
    these as have ``sample_bytes`` of text.

    Either class weighs as much as it has labels in all, so that the sample's size does not shift how likely a toxic document is.
    ``keep`` is a condition on the label rows (say, a fold).  A document labelled twice counts as toxic if any label says so;
    null ids and labels are left out; of several texts of one id the first by code point is taken.  Without labels, or with
    labels of one class only, every score is near 0.  Only the sample is broadcast and collected.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    if keep is not None:
        known = known.filter(keep(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("toxic")).first()
    order = F.xxhash64("_id"), F.col("_id")
    taken = known.filter("_y = 1").orderBy(*order).limit(sample).unionByName(known.filter("_y = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(taken), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    so_far = Window.partitionBy("_y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over the sample only
    found = texts.withColumn("_sum", F.sum(F.coalesce(F.octet_length("_t"), F.lit(0))).over(so_far)).filter(F.col("_sum") <= sample_bytes).select("_id", "_t", "_y").toArrow()
    rows = sorted((i, t or "", y) for i, t, y in zip(*(c.to_pylist() for c in found.columns), strict=True))
    del found
    return fit([t for _, t, _ in rows], [y for *_, y in rows], totals=(count.n - count.toxic, count.toxic))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst_sentence", pa.int32()), ("worst_start", pa.int64()), ("worst_length", pa.int64()), ("worst_score", pa.float64())])


def _scored(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m: NoisyOr = model.value
    for batch in batches:
        for part in parts(batch):
            found = list(zip(*(m.bag(t.as_py()) for t in part.column(1)), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(found, list(SCORED)[1:], strict=True))], schema=SCORED)
    m.forget()  # a worker may live on


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, and where its worst sentence is: number, place and length in bytes of the UTF-8 text, own score.

    Null and empty texts score 0 and have no sentence; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, worst_sentence int, worst_start long, worst_length long, worst_score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_scored, shared), schema)


def with_score(docs: DataFrame, model: NoisyOr, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """Adds the score as the column ``to``, in place of one of that name; all other columns stay.  Null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m: NoisyOr = shared.value
        out = pa.array([m.document(t.as_py()) for t in texts], pa.float64())
        if m.held > MEMORY // 4:
            m.forget()
        return out

    return docs.withColumn(to, scored(F.col(text_col)))


def _located(model, least: float, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m: NoisyOr = model.value
    for batch in batches:
        for part in parts(batch):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                at, raw = 0, (text or "").encode("utf-8", "surrogatepass")
                for k, s in enumerate(sentences(text or "")[0]):
                    if s.split() and (p := float(1 / (1 + np.exp(-m.sentence(s))))) >= least:
                        rows.append((key, k, at, len(s), p, raw[at : at + len(s)].decode("utf-8", "replace")))
                    at += len(s) + 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence whose own score reaches ``least``: its number, its bytes' place in the UTF-8 text, and the text.

    Null and empty texts have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("text", pa.string())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_located, shared, least, schema), "doc_id long, sentence int, start long, length long, score double, text string")
