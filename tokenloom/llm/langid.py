"""Language identification: scripts narrow the candidates, then Viterbi over word scores labels the spans of a text."""

from __future__ import annotations

import functools
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import parts

#: Documents of each language that training takes at most, bytes of texts of all together, languages (the commonest); what a change
#: of language costs; bytes of words, with some 200 for each, that a worker remembers.
SAMPLE, SAMPLE_BYTES, LANGUAGES, PENALTY, MEMORY = 400, 64 << 20, 256, 8.0, 96 << 20
#: Characters of a word that stay in one piece, and of each piece of longer words and of scripts without spaces.
LONG, PIECE = 64, 16
#: Rows, and about how many bytes of texts, that are labelled at once.
ROWS, BYTES = 2000, 4 << 20
UNKNOWN = "und"
#: First and last code point of common scripts' letters.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
UNSPACED = {"thai", "kana", "han", "other"}
#: What no Latin word has; other words may have to be split.
_NOT_LATIN = re.compile("[\u0250-\u1dff\u1f00-\u1fff\u2070-\U0010ffff]")
_TABLE = bytes(32 if i < 32 or chr(i) in string.punctuation + string.digits else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def script(word: str) -> str | None:
    """The script of a word's first letter; None without letters, "other" outside the ranges."""
    for c in word:
        if c.isalpha():
            return next((name for name, a, b in SCRIPTS if a <= ord(c) <= b), "other")
    return None


@functools.lru_cache(1 << 16)
def pieces(raw: bytes) -> tuple[bytes, ...]:
    """A word, split where its letters change from one script to another; runs without spaces and long ones in pieces of PIECE.

    Nothing is left out: marks between letters stay with those before them, letters of no known script split nothing.
    """
    word = raw.decode("utf-8", "surrogatepass")
    bounds, last = [0], None
    for k, c in enumerate(word):
        if c.isalpha() and (kind := script(c)) != "other":
            if last not in (None, kind):
                bounds.append(k)
            last = kind
    runs = [word[a:b] for a, b in zip(bounds, [*bounds[1:], len(word)], strict=True)]
    cut = [r[k : k + PIECE] for r in runs for k in range(0, len(r), PIECE if len(r) > LONG or script(r) in UNSPACED else LONG)] if len(word) > PIECE else runs
    return tuple(p.encode("utf-8", "surrogatepass") for p in cut)


def words(text: str) -> list[bytes]:
    """Words as UTF-8 bytes, in the place and length they have in the text: cut at ASCII white space, marks and digits.

    Words in more than one script, without spaces or longer than LONG come as their pieces.
    """
    found = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if max(map(len, found), default=0) <= LONG and (text.isascii() or not _NOT_LATIN.search(text)):
        return found
    split = pieces.__wrapped__  # long words are not remembered
    return [p for w in found for p in (pieces(w) if len(w) <= 4 * LONG else split(w))]


def grams(word: str) -> list[str]:
    w = f"\x02{word}\x03"
    return [*word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2)), w]


@dataclass
class Model:
    """Languages, the rows of character grams and their log-probabilities in each language (row 0: of others), and which
    languages each script may be."""

    langs: list[str]
    table: dict[str, int]
    values: np.ndarray
    scripts: dict[str, np.ndarray]
    penalty: float = PENALTY
    known: dict[bytes, int] = field(default_factory=dict)
    matrix: np.ndarray | None = None
    held: int = 0

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """Words' scores in each language, and 1 at the end of those that have a letter."""
        out = np.zeros((len(raws), len(self.langs) + 1), dtype=np.float32)
        get, found, begins, at, kinds = self.table.get, [], [], [], []
        for k, raw in enumerate(raws):
            word = raw.decode("utf-8", "replace").lower()
            if (kind := script(word)) is not None:
                begins.append(len(found))
                found += [get(g, 0) for g in grams(word)]
                at.append(k)
                kinds.append(kind)
        if at:
            sums = 0.5 * np.add.reduceat(self.values[found], begins, axis=0)
            sums = np.maximum(sums - sums.max(axis=1)[:, None], -12.0)
            for kind in set(kinds) & set(self.scripts):
                sums[np.ix_([k for k, x in enumerate(kinds) if x == kind], ~self.scripts[kind])] -= 12.0
            out[at, :-1], out[at, -1] = sums, 1.0
        return out

    def forget(self) -> None:
        self.known.clear()
        self.matrix, self.held = None, 0

    def lookup(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each word its row in the matrix of scores."""
        if self.held > MEMORY:
            self.forget()
        new = [w for w in set().union(*docs) if w not in self.known]
        self.held += sum(map(len, new)) + len(new) * (150 + 8 * len(self.langs))
        many = 0 if self.matrix is None else len(self.known)
        self.known.update(zip(new, range(many, many + len(new)), strict=True))
        if self.matrix is None or len(self.matrix) < len(self.known):
            larger = np.zeros((max(1024, 2 * len(self.known)), len(self.langs) + 1), dtype=np.float32)
            if many:
                larger[:many] = self.matrix[:many]
            self.matrix = larger
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.matrix[many + lo : many + lo + len(part)] = self.scores(part)
        get = self.known.__getitem__
        return [np.fromiter(map(get, d), dtype=np.int32, count=len(d)) for d in docs]

    def constant(self, rows: list[np.ndarray]) -> np.ndarray:
        """For each document the language that is its whole best path, or -1 where that has to be searched for.

        Against the language k of the largest sum no stretch of words gains more than the penalty in any other one, nor do a
        stretch at the beginning and one at the end together.  A path that leaves k for m stretches, each in one language,
        changes m times at least if it has a word in k, and m - 1 times if not; so it can't be better than to stay.
        """
        n = np.array([len(r) for r in rows])
        out = np.full(len(rows), -1)
        some = np.flatnonzero(n)
        if not len(some):
            return out
        scores = self.matrix[np.concatenate([rows[i] for i in some]), :-1].astype(np.float64)
        begin = np.concatenate(([0], np.cumsum(n[some])))
        best = np.add.reduceat(scores, begin[:-1], axis=0).argmax(axis=1)
        doc = np.repeat(np.arange(len(some)), n[some])
        gain = scores - scores[np.arange(len(scores)), best[doc]][:, None]
        after = np.cumsum(gain, axis=0)
        before = after - gain
        apart = doc[:, None] * (2 * (1 + np.abs(after).max()))  # so that a minimum never comes from a document before
        most = np.maximum.reduceat(after - (np.minimum.accumulate(before - apart, axis=0) + apart), begin[:-1], axis=0).max(axis=1)
        head = (np.maximum.reduceat(after, begin[:-1], axis=0) - before[begin[:-1]]).max(axis=1)
        tail = (after[begin[1:] - 1] - np.minimum.reduceat(before, begin[:-1], axis=0)).max(axis=1)
        stays = (most <= self.penalty) & (head + tail <= self.penalty)
        out[some[stays]] = best[stays]
        return out

    def label(self, docs: list[list[bytes]], cells: int = 1 << 20) -> list[np.ndarray]:
        """The language index of every word of every document: the best path, where each change of language costs the penalty.

        All documents of a block go one word further at a time; a block is as many documents as fit ``cells``.
        """
        rows = self.lookup(docs)
        out, whole = [np.empty(0, dtype=np.int32)] * len(docs), self.constant(rows)
        for i in np.flatnonzero(whole >= 0):
            out[i] = np.full(len(rows[i]), whole[i], dtype=np.int32)
        order = sorted((i for i in range(len(docs)) if len(rows[i]) and whole[i] < 0), key=lambda i: -len(rows[i]))
        at = 0
        while at < len(order):
            long = len(rows[order[at]])
            block = order[at : at + max(1, cells // long // max(1, len(self.langs)))]
            for i, path in zip(block, self._block([rows[i] for i in block]), strict=True):
                out[i] = path
            at += len(block)
        return out

    def _block(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        n = np.array([len(r) for r in rows])
        steps, width, langs = int(n[0]), len(rows), len(self.langs)
        index = np.zeros((steps, width), dtype=np.int32)
        for k, r in enumerate(rows):
            index[: len(r), k] = r
        active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # documents that have a word at this step
        best = np.zeros((width, langs), dtype=np.float32)
        kind = np.int8 if langs < 128 else np.int32
        came = np.empty((steps, width, langs), dtype=kind)
        same = np.arange(langs, dtype=kind)
        for t in range(steps):
            b = active[t]
            v = best[:b]
            top = v.argmax(axis=1)
            jump = v[np.arange(b), top][:, None] - np.float32(self.penalty)
            stay = v >= jump
            came[t, :b] = np.where(stay, same, top[:, None].astype(kind))
            best[:b] = np.where(stay, v, jump) + self.matrix[index[t, :b], :langs]
        state = best.argmax(axis=1)
        path = np.empty((steps, width), dtype=np.int32)
        for t in range(steps - 1, -1, -1):
            b = active[t]
            path[t, :b] = state[:b]
            state[:b] = came[t, np.arange(b), state[:b]]
        return [path[: n[k], k] for k in range(width)]

    def _cut(self, text: str, found: list[bytes], path: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, length, language) of the stretches of a path, in bytes of the UTF-8 text."""
        flat = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        begins = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        out, at = [], 0
        for a, b in zip(begins, begins[1:], strict=False):
            start = flat.index(found[a], at)
            if b == len(path):
                end = len(flat.rstrip())
            else:
                at = start
                for w in found[a:b]:
                    at = flat.index(w, at) + len(w)
                end = at
            out.append((start, end - start, self.langs[path[a]]))
        return out

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """The language with most bytes of words with letters, its share of them, and the spans (see ``spans``)."""
        docs = [words(t) if t else [] for t in texts]
        out = []
        for text, path, found in zip(texts, self.label(docs), docs, strict=True):
            if not len(path):
                out.append((UNKNOWN, 0.0, []))
                continue
            index = np.fromiter(map(self.known.__getitem__, found), dtype=np.int32, count=len(found))
            size = np.fromiter(map(len, found), dtype=np.float64, count=len(found)) * self.matrix[index, -1]
            total = np.bincount(path, size, minlength=len(self.langs))
            k = int(total.argmax())
            out.append((self.langs[k], float(total[k] / total.sum()), self._cut(text, found, path)) if total[k] else (UNKNOWN, 0.0, []))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [x[:2] for x in self.identify(texts)]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, length, language) in bytes of the UTF-8 text; words without letters join the span they lie in; none without letters."""
        return self.identify([text])[0][2]


def fit(texts: list[str], langs: list[str], penalty: float = PENALTY) -> Model:
    """Counts character grams of one to three and whole words in each language, smoothed."""
    names = sorted(set(langs))
    counted = {x: Counter() for x in names}
    for text, lang in zip(texts, langs, strict=True):
        counted[lang].update(words(text))
    tables, scripts = {x: Counter() for x in names}, {x: Counter() for x in names}
    for lang, found in counted.items():
        for raw, n in found.items():
            word = raw.decode("utf-8", "replace").lower()
            if kind := script(word):
                scripts[lang][kind] += n
                for g in grams(word):
                    tables[lang][g] += n
    total = {x: sum(tables[x].values()) for x in names}
    shared = Counter(g for x in names for g in tables[x])
    kept = [g for g in shared if sum(tables[x][g] for x in names) >= 3]
    log = lambda c, x: np.log((c + 0.5) / (total[x] + 0.5 * len(kept) + 1))
    values = np.array([[log(0, x) for x in names], *([log(tables[x][g], x) for x in names] for g in kept)])
    may = {k: np.array([scripts[x][k] >= 0.01 * (sum(scripts[x].values()) or 1) for x in names]) for k in {k for x in names for k in scripts[x]}}
    return Model(names, {g: k + 1 for k, g in enumerate(kept)}, values, {k: m for k, m in may.items() if m.any()}, penalty)


# ---- DataFrames ----------------------------------------------------------------------------------------------------


def train(docs: DataFrame, keep=None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most ``sample`` documents of each of the LANGUAGES commonest languages, those with the smallest hash of the id,
    and on as many of these as have ``sample_bytes`` over the number of languages.

    ``keep`` is a condition on the id column.  Ids, texts or languages that are null are left out; of several rows of one id the
    first by language and text is taken.  Each language's count tells how small a hash has to be, so that few rows are ranked.
    Without any row the model knows no language.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).filter("_id IS NOT NULL AND _t IS NOT NULL AND _l IS NOT NULL")
    if keep is not None:
        known = known.filter(keep(F.col("_id")))
    hashed = F.xxhash64("_id")
    counts = known.groupBy("_l").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_l").limit(LANGUAGES)
    share = F.least(F.lit(1.0), (4.0 * sample + 100) / F.col("_n"))
    low = F.lit(-(2.0**63)) + share * 2.0**64
    few = known.select("_id", "_l").join(F.broadcast(counts), "_l").filter(hashed.cast("double") <= low)
    first = few.select("_id", "_l").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy(hashed, "_id"))).filter(F.col("_k") <= sample)
    rows = known.join(F.broadcast(first.select("_id").distinct()), "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("_l", "_t")).alias("r")).select("_id", "r._l", "r._t")
    so_far = Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample only
    rows = rows.withColumn("_sum", F.sum(F.octet_length("_t")).over(so_far)).withColumn("_of", F.size(F.collect_set("_l").over(Window.partitionBy())))
    found = rows.filter(F.col("_sum") <= F.lit(sample_bytes) / F.col("_of")).select("_id", "_l", "_t").collect()
    found.sort(key=lambda r: (r._id, r._l, r._t))
    if not found:
        return Model([], {}, np.zeros((1, 0)), {}, penalty)
    return fit([r._t for r in found], [r._l for r in found], penalty)


def _predicted(shared, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        for part in parts(batch, rows=ROWS, size=BYTES):
            found = model.identify(part.column(1).to_pylist()) if model.langs else [(UNKNOWN, 0.0, [])] * part.num_rows
            spans_ = [[{"start": a, "length": n, "lang": x} for a, n, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans_, schema.field("spans").type)], schema=schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (start and length in bytes of the UTF-8 text, lang) of every row.

    "und" with score 0 and no span where a text is null or has no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_predicted, shared, schema), "doc_id long, lang_pred string, score double, spans array<struct<start: long, length: long, lang: string>>")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span of one language: doc_id, span, start and length in bytes of the UTF-8 text, lang.

    Null texts and texts without a letter have none.
    """
    found = predict(docs, model, id_col, text_col).select("doc_id", F.posexplode("spans").alias("span", "s"))
    return found.select("doc_id", "span", "s.start", "s.length", "s.lang")
