"""Models that cut words into tokens: WordPiece, byte-pair merges and unigram, as kernels and as Arrow batch functions.

Python functions can't be called inside array lambdas, so each model comes in two shapes: for a column of words, and for a
column of arrays of words.  Workers remember words they have cut; at REMEMBERED words they start anew.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.sources.config import TokenizerError

REMEMBERED = 200_000
_STRING = T.StringType()
#: What the basic tokenizer never splits, and the continuation sign and longest word of WordPiece.
NEVER_SPLIT = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
CONTINUED, LONGEST_WORD, MOST_IDS = "##", 100, 512
_PUNCT = regex.compile(r"[\p{P}!-/:-@\[-`{-~]")
#: The byte-level pattern without Unicode classes: \p{L} then means the characters themselves, which the last class leaves out.
_FALLBACK = regex.compile(r"[^pLN{}]+")


class WordPiece:
    """Greedy longest pieces; a word with a gap, or of more than 100 characters, is unknown."""

    def __init__(self, vocab: dict[str, int], unknown: str = "[UNK]"):
        self.vocab, self.unknown = vocab, unknown
        self.longest = max(map(len, vocab), default=0)

    def __call__(self, word: str) -> list[str]:
        if len(word) > LONGEST_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            sign = CONTINUED if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                if (piece := sign + word[at:end]) in self.vocab:
                    break
            else:
                return [self.unknown]
            out.append(piece)
            at = end
        return out


class BytePairs:
    """Merges of the lowest rank first, all its occurrences at once; pieces without an id fall back to bytes."""

    def __init__(self, vocab: dict[str, int], merges: list, unknown: str | None = None):
        self.vocab, self.unknown = vocab, unknown
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in merges)
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}  # of repeated merges the last counts
        self.unknown_id = vocab.get(unknown) if unknown is not None else None

    def pieces(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            rank, pair = min((self.ranks.get(p, len(self.ranks)), p) for p in itertools.pairwise(parts))
            if rank == len(self.ranks):
                break
            new, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    new.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            parts = new
        return [p for x in parts for p in x.split(" ") if p]

    def __call__(self, word: str) -> list[str]:
        out = []
        for piece in self.pieces(word):
            if self.vocab.get(piece, self.unknown_id) != self.unknown_id:
                out.append(piece)
            else:
                out += byte_tokens(piece)
        return out


def byte_tokens(text: str) -> list[str]:
    """<0xHH> for each UTF-8 byte.  As defined, the characters p { L } N vanish."""
    return [f"<0x{b:02X}>" for part in _FALLBACK.findall(text) for b in part.encode("utf-8", "surrogatepass")]


class Unigram:
    """The best path of scored pieces; a character that is no piece costs 10 more than the worst one.

    Of equal paths the one whose last piece is longer is taken, as its left neighbour was there first.
    """

    def __init__(self, vocab: list, unknown_id: int = 0):
        self.ids = {piece: i for i, (piece, _) in enumerate(vocab)}  # of repeated pieces the last counts
        self.scores = {piece: float(vocab[i][1]) for piece, i in self.ids.items()}
        self.unknown_id = unknown_id
        self.unknown = vocab[unknown_id][0] if vocab else ""
        self.penalty = min((float(s) for _, s in vocab), default=0.0) - 10
        self.longest = max(map(len, self.ids), default=1)

    def __call__(self, word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = None
            for at in range(max(0, end - self.longest), end):
                score = self.scores.get(word[at:end])
                if score is None:
                    if at != end - 1:
                        continue
                    score = self.penalty
                total = best[at][0] + score
                if found is None or total > found[0]:
                    found = total, at
            best.append(found)
        out, end = [], len(word)
        while end:
            at = best[end][1]
            out.append(word[at:end])
            end = at
        return out[::-1]


def basic_words(text: str, lower: bool = True) -> list[str]:
    """White-space words, each cut around every punctuation mark; with lower, without marks of accents."""
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    out = []
    for word in text.split():
        if word in NEVER_SPLIT:
            out.append(word)
            continue
        if lower:
            word = word.lower()
        at = 0
        for m in _PUNCT.finditer(word):
            if m.start() > at:
                out.append(word[at : m.start()])
            out.append(m[0])
            at = m.end()
        if at < len(word):
            out.append(word[at:])
    return out


# ---- Column functions ----------------------------------------------------------------------------------------------


def fuse(tokens: list[str], known: Callable[[str], bool]) -> list[str]:
    """Of each run of unknown tokens only the first."""
    return [t for i, t in enumerate(tokens) if known(t) or not i or known(tokens[i - 1])]


class Remembering:
    """A kernel that cuts each distinct word once, as long as REMEMBERED of them are kept; words of over 100 characters are not."""

    def __init__(self, kernel: Callable[[str], list]):
        self.kernel, self.memory = kernel, {}

    def __call__(self, word: str | int) -> list:
        found = self.memory.get(word)
        if found is None:
            found = self.kernel(word)
            if not isinstance(word, str) or len(word) <= LONGEST_WORD:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = found
        return found

    def flat(self, words: pa.Array, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
        """What all words give, one after the other, and where each word's part begins (and the last ends)."""
        coded = words.dictionary_encode()
        made = [self(w) for w in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        begins, index = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths[index])))
        source = np.repeat(begins[index] - ends[:-1], lengths[index]) + np.arange(ends[-1])
        return pa.array(list(itertools.chain.from_iterable(made)), kind).take(pa.array(source)), ends


def _lists(values: pa.Array, offsets: np.ndarray, missing: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=missing)


def on_words(kernel: Callable[[str], list[str]], kind: T.DataType = _STRING) -> Callable[[Column], Column]:
    """A column of words to a column of arrays of what the kernel makes of them; null stays null."""
    cut, made = Remembering(kernel), pa.string() if kind == _STRING else pa.int32()

    @F.arrow_udf(T.ArrayType(kind))
    def column(words: pa.Array) -> pa.Array:
        values, ends = cut.flat(words.fill_null(""), made)
        return _lists(values, ends, words.is_null())

    return column


def on_arrays(kernel: Callable[[str], list], kind: T.DataType = _STRING) -> Callable[[Column], Column]:
    """A column of word arrays to the flat array of what the kernel makes of all their words; null stays null."""
    cut, made = Remembering(kernel), pa.string() if kind == _STRING else pa.int32()

    @F.arrow_udf(T.ArrayType(kind))
    def column(arrays: pa.Array) -> pa.Array:
        values, ends = cut.flat(arrays.flatten(), made)
        offsets = arrays.offsets.to_numpy()
        return _lists(values, ends[offsets - offsets[0]], arrays.is_null())

    return column


def to_text(pieces: list[str | None]) -> Callable[[Column], Column]:
    """A column of id arrays to the texts of their pieces in a row; ids without a piece give nothing; null stays null."""

    @F.arrow_udf(T.StringType())
    def column(arrays: pa.Array) -> pa.Array:
        known = pa.array([*pieces, None], pa.string())
        flat, offsets = arrays.flatten().fill_null(-1).to_numpy(), arrays.offsets.to_numpy()
        outside = (flat < 0) | (flat >= len(pieces))
        found = known.take(pa.array(np.where(outside, len(pieces), flat))).fill_null("")
        at = np.frombuffer(found.buffers()[1], dtype=np.int32, count=len(found) + 1, offset=4 * found.offset) if len(found) else np.zeros(1, dtype=np.int32)
        out = pa.StringArray.from_buffers(len(arrays), pa.py_buffer(np.ascontiguousarray(at[offsets - offsets[0]], dtype=np.int32)), found.buffers()[2] or pa.py_buffer(b""))
        return pa.array(np.zeros(0), pa.string()) if not len(arrays) else pa.compute.if_else(arrays.is_null(), None, out)

    return column


def fuse_column(tokens: Column, unknown: str) -> Column:
    """Native: drops an unknown token that follows another."""
    return F.filter(tokens, lambda x, i: ~((x == unknown) & (i > 0) & (F.get(tokens, (i - 1).cast("int")) == unknown)))


def strict_ids(ids: Column, most: int = MOST_IDS) -> Column:
    """The ids, or an error where they are more than a BERT model takes."""
    return F.when(F.size(ids) > most, F.raise_error(F.lit(f"tooLong: more than {most} tokens"))).otherwise(ids)


def detokenize(tokens: Column) -> Column:
    """Glues WordPiece continuations and parts the words by spaces."""
    return F.regexp_replace(F.replace(F.concat(F.lit(" "), F.array_join(tokens, " ")), F.lit(" ##"), F.lit("")), "^ ", "")


# ---- vocabulary joins ----------------------------------------------------------------------------------------------


def vocabulary(spark, vocab: dict[str, int], added: dict[str, int] | None = None) -> DataFrame:
    """(token, id); added tokens override."""
    return spark.createDataFrame(list({**vocab, **(added or {})}.items()), "token string, id int")


def to_ids(rows: DataFrame, vocab: DataFrame, unknown: int | None, token_col: str = "token", strict: bool = False) -> DataFrame:
    """Adds ``id`` by a left join with the vocabulary: the unknown id, or null, or with strict an error, where it lacks the token."""
    found = rows.join(vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id")).hint("broadcast") if _small(vocab) else vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id")), F.col(token_col) == F.col("_token"), "left")
    other = F.lit(unknown) if unknown is not None else F.raise_error(F.lit("a token has no id")).cast("int") if strict else F.lit(None).cast("int")
    return found.withColumn("id", F.coalesce("_id", other)).drop("_token", "_id")


def to_tokens(rows: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``token``; of several tokens with an id the last counts, which is the greatest here; null without any."""
    last = vocab.groupBy(F.col("id").alias("_id")).agg(F.max("token").alias("token"))
    return rows.join(last, F.col(id_col) == F.col("_id"), "left").drop("_id")


def _small(vocab: DataFrame, most: int = 1_000_000) -> bool:
    """A vocabulary is a list of the description; it is broadcast only if it is counted to be small."""
    return vocab.count() <= most


def prefixes(words: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """Common-prefix search: (word, piece, length) for every vocabulary piece that a word begins with, short to long.

    The beginnings of each word are made and joined by equality, never word by word with the whole vocabulary.
    """
    longest = vocab.agg(F.max(F.length("token"))).first()[0] or 0
    starts = words.select(F.col(word_col).alias("word")).distinct().withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest))))).filter("word <> ''")
    keyed = starts.withColumn("piece", F.left("word", F.col("length")))
    return keyed.join(vocab.select(F.col("token").alias("piece")).distinct(), "piece").select("word", "piece", "length")


def merges(spark, pairs: list) -> DataFrame:
    """(left, right, rank) of a merge list given as pairs or as "a b"."""
    rows = [(*(m.split(" ", 1) if isinstance(m, str) else m), i) for i, m in enumerate(pairs)]
    bad = [r for r in rows if len(r) != 3]
    if bad:
        raise TokenizerError("malformedVocab", f"not a pair: {bad[0]}")
    return spark.createDataFrame(rows, "left string, right string, rank int")
