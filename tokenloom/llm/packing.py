"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import functools
import logging
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import materialise, parts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of words and ids, with some 200 for each word, that a Python worker remembers before it starts anew.
MEMORY = 96 << 20
#: Pieces that one packing task holds at most on average.
TASK_PIECES = 20_000


class WordEncoder:
    """Ids of the word_bpe vocabulary as little-endian bytes, remembered by white-space word and by pre-token.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``: its pre-tokens never cross white space, so words can be
    encoded one by one.  Texts with characters on which Python's and the tokenizer's notion of white space or case could
    differ go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        #: Fixed value: the vocabulary's own pattern.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.odd = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "İ", "Σ", "ς", "<|startoftext|>", "<|endoftext|>")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    @functools.cached_property
    def whole(self):  # noqa: ANN201  only few texts need it
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split(self, word: str) -> list[str]:
        """A word's pre-tokens; the pattern is only needed where more than a last full stop or comma isn't a letter."""
        if word.isalpha():
            return [word]
        if word[-1] in ".," and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def learn(self, missing: list[str]) -> None:
        split = [self.split(w) for w in missing]
        new = [p for p in {p for ps in split for p in ps} if p not in self.pieces]
        for p, e in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.pieces[p] = array("I", e.ids).tobytes()
        get = self.pieces.__getitem__
        for w, ps in zip(missing, split, strict=True):
            self.words[w] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))
            self.held += 200 + 6 * len(w)

    def forget(self) -> None:
        self.words.clear()
        self.pieces.clear()
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMORY:
            self.forget()
        words = [None if any(x in t for x in self.odd) else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split() for t in texts]
        if missing := [w for w in set().union(*[w for w in words if w is not None]) if w not in self.words]:
            self.learn(missing)
        get = self.words.__getitem__
        return [array("I", self.whole.encode(t, add_special_tokens=False).ids).tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


@functools.cache
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _cut(name: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(_vocabulary(name))
    for batch in batches:
        out: list[tuple] = []
        for part in parts(batch, rows=256, size=1 << 20):
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += b"\0\0\0\0"
                out += [(doc, k, k * limit, len(x := ids[s : s + 4 * limit]) // 4, zlib.crc32(x)) for k, s in enumerate(range(0, len(ids), 4 * limit))]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    encoder.forget()  # the worker may live on


def _vocabulary(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, limit: int = 2048, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``limit`` tokens; every text is followed by id 0, so an empty or null one has one token.

    ``vocabulary`` is a name known to public_tokenizers or a path.  Repeated rows are cut each on its own.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_cut, vocabulary, limit), PIECES)


# ---- packing -------------------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.  Open bins are kept by free space; a bit mask of the spaces in use finds the tightest."""
    n = len(lengths)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.lexsort((np.arange(n), -lengths)).tolist():
        size = int(lengths[i])
        above = mask >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            b, space, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - space
        if left := space - size:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest of the sums under dual-feasible functions.

    ``u`` (the identity), the threshold functions of Martello and Toth (an item above capacity - t counts as a whole bin, one
    below t not at all) for each t, and the rounding functions of Fekete and Schepers for k up to 20.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * sizes)))
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (capacity * k))))
    return best


def _pack(group: pa.Table, capacity: int) -> pa.Table:
    """Packs a group; each row also gets its bin, that bin's fill, and the group's bins and bound."""
    order = np.lexsort([group[c].fill_null(-1).to_numpy() for c in ("ids_crc32", "length", "piece", "doc_id")])  # reruns agree whatever order rows come in
    group = group.take(pa.array(order))
    lengths = group["length"].to_numpy()
    bins, offsets = best_fit_decreasing(lengths, capacity)
    used, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
    for name, values in (("bin", bins), ("offset", offsets), ("fill", fill), ("bins", np.full(len(bins), used)), ("bound", np.full(len(bins), bound))):
        group = group.append_column(name, pa.array(values, pa.int64()))
    return group


def _pack_by(pieces: DataFrame, groups: int, capacity: int, salt: int) -> DataFrame:
    """Pieces dealt at random: a hash of their number, so that rows of one document, repeated or without id, don't meet in one group."""
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("number", F.lit(salt)), F.lit(groups)).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        return _pack(group, capacity)

    return keyed.groupBy("part").applyInArrow(packed, PIECES + ", number long, part int, bin long, offset long, fill long, bins long, bound long")


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int | None = None, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Packs pieces (as token_pieces makes them) into sequences of at most ``capacity`` tokens.

    Whole pieces are sequences of their own.  The others are dealt by a hash over as many groups as hold ``task_pieces`` each
    and packed best-fit decreasing; a dual-feasible-function bound tells for each group how many bins any packing needs.
    Groups that used more give up their bins that are not full: those documents are dealt anew over fewer groups, so that
    they meet others', and are packed again; a group that meets its bound is final.  Exchanges go on until all do, one group
    is left or an exchange no longer lowers the number of bins (what was before it then stays), at most ``rounds`` times if
    given; a warning tells how many groups remain above their bound.  An empty table gives an empty result.
    """
    small = materialise(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")  # written, so numbers stay as they are
    full = small.filter(F.col("length") == capacity)
    rest = small.filter(F.col("length") < capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    groups, base, turn, kept, before, above, done = max(1, -(-rest.count() // task_pieces)), 0, 0, None, 0, (0, 0), []
    is_open = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
    while True:
        packed = materialise(_pack_by(rest.select(*names), groups, capacity, turn), f"packed{turn}")
        by_group = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max(F.col("bins") - F.col("bound")).alias("above"), F.count_distinct(F.when(is_open, F.col("bin"))).alias("open"), F.sum(is_open.cast("long")).alias("pieces"))
        state = by_group.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("bins", "above", "open", "pieces")), F.count(F.when(F.col("above") > 0, 1)).alias("groups")).first()
        if kept is not None and state.bins >= before:
            done.append(kept)
            break
        # a number from (group, counted over all turns, and bin): 33 bits, 30 bits; whole pieces number themselves by document below zero
        numbered = packed.withColumn("sequence_id", (F.lit(base).cast("long") + F.col("part")) * F.lit(1 << 30) + F.col("bin"))
        above = state.groups, state.above
        if not state.pieces or groups == 1 or turn == rounds:
            done.append(numbered)
            break
        done.append(numbered.filter(~is_open))
        kept, before, rest = numbered.filter(is_open), state.open, packed.filter(is_open)
        base, turn, groups = base + groups, turn + 1, max(1, -(-state.pieces // task_pieces))
    if above[0]:
        logging.getLogger(__name__).warning("%d groups remain above their bound, by %d sequences in all", *above)
    out = functools.reduce(DataFrame.unionByName, (d.select(*names[:-1], "sequence_id", "offset") for d in done))
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(alone)


def packed_documents(docs: DataFrame, limit: int = 2048, vocabulary: str = "word_bpe_49k.json", **columns: str) -> DataFrame:
    """The pieces of all texts in sequences of at most ``limit`` tokens.

    A null text counts as empty: one token.  Rows with equal ids are packed each on its own; null ids stay null.
    """
    return pack(token_pieces(docs, limit, vocabulary, **columns), limit)
