"""Jaccard self-join of documents on word n-grams by adaptive multi-match prefixes, and the groups that its links form."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm import shingles
from tokenloom.llm._common import materialise, parts, release

#: Shingles are counted in 2**BITS cells by their first bits; that many numbers are sent to every executor.
BITS = 18
#: Longest multi-match; cost of verifying a candidate per shingle, as a share of reading one entry of a posting list.
MOST_MATCHES, VERIFY = 4, 0.125
#: A posting list so long holds its entries against its smallest document even where few tokens are shared.
LONG = 16
#: Entries of a cell beyond the usual that are dealt to one task; differences from one leader that one task compares at a time.
HOT, TOGETHER = 100_000, 20_000
#: Bits of a sketch for each shingle, at least.
SKETCH = 4
#: Ids that are broadcast to pick out documents at most; beyond it the documents are shuffled instead.
BROADCAST_IDS = 1_000_000
#: Stands for a null id.
NO_ID = -(1 << 63)


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in the common order, rare first, and the matches it asks for.

    With l matches the prefix is n - needed(n) + l tokens long: two sets that link share their l first common tokens within
    both prefixes, l being the smaller of their two.  l is the one of 1 to MOST_MATCHES with the least estimated cost: entries
    read, plus candidates to verify, which fall with the square of the matches asked for.
    """
    n = len(tokens)
    o = needed(n, percent)
    if n <= 1:
        return tokens, 1
    longest = min(MOST_MATCHES, o)
    reach = n - o + longest
    other = np.cumsum(rarity[:reach])  # other documents expected at the tokens so far
    best = min(range(1, longest + 1), key=lambda k: (n - o + k + other[n - o + k - 1] * (1 + VERIFY * n / k**2), k))
    return tokens[: n - o + best], best


# ---- passes over the texts -----------------------------------------------------------------------------------------


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each document's number of shingles and a 128-bit hash of its set; at the end the partition's counts by cell."""
    cells = np.zeros(1 << BITS, dtype=np.int64)
    names = ["doc_id", "n", "s1", "s2", "cell", "count"]
    none = lambda k: pa.nulls(k, pa.int64())
    for batch in batches:
        for part in parts(batch):
            found = list(shingles.sets(part.column(1).to_pylist(), size))
            every = np.concatenate(found)
            cells += np.bincount((every >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
            n = np.array([len(x) for x in found])
            at = np.concatenate(([0], np.cumsum(n)))
            sums = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(shingles.mix(every ^ np.uint64(s))))) for s in (0x1234567, 0x89ABCDEF)]
            s1, s2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), none(len(n)), none(len(n))], names=names)
    cell = np.flatnonzero(cells)
    for lo in range(0, len(cell), 50_000):
        x = cell[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([*[none(len(x))] * 4, pa.array(x), pa.array(cells[x])], names=names)


def _prefixes(shared, size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of each set.  ``salt`` deals the tokens of cells with very many documents to several tasks, from 1 on."""
    order, rarity, salts = shared.value
    low, top = np.uint64((1 << (64 - BITS)) - 1), np.uint64(64 - BITS)
    for batch in batches:
        for part in parts(batch):
            ids = part.column(0).to_numpy()
            held: list[np.ndarray] = []
            facts: list[tuple[int, int, int, int]] = []
            for k, found in enumerate(shingles.sets(part.column(1).to_pylist(), size)):
                if not len(found):
                    continue
                tokens = np.sort((order[found >> top] << top) | (found & low))
                tokens, matches = prefix(tokens, rarity[tokens >> top], percent)
                held.append(tokens)
                facts.append((ids[k], len(found), matches, len(tokens)))
            if facts:
                doc, n, matches, times = (np.array(x) for x in zip(*facts, strict=True))
                token, doc = np.concatenate(held), np.repeat(doc, times)
                of = salts[token >> top]
                salt = np.where(of > 1, 1 + (shingles.mix(doc.view(np.uint64)) % of.astype(np.uint64)).astype(np.int32), 0)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(np.repeat(n, times).astype(np.int32)), pa.array(np.repeat(matches, times).astype(np.int32))], names=["token", "salt", "doc", "n", "matches"])


# ---- sketches ------------------------------------------------------------------------------------------------------


def sketch(found: np.ndarray) -> bytes:
    """A bit for each value of some last bits of a hash: whether an odd number of shingles has it; SKETCH bits a shingle or more."""
    bits = max(64, 1 << int(SKETCH * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """Shingles that at most one of two sets has, from their sketches: as many at least, since only such tell two sketches apart."""
    x, y = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sketched(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            found = list(shingles.sets(part.column(1).to_pylist(), size))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary())], names=["doc_id", "size", "sketch"])


def most_apart(n: int, m: int, percent: int, near: bool) -> int:
    """Shingles that only one of two sets may have for them to link or, with ``near``, for half of the larger to be common."""
    return max((n + m) * (100 - percent) // (100 + percent), min(n, m) if near else 0)


def _likely(percent: int, near: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets' sizes and sketches those that these don't rule out."""
    for batch in batches:
        n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
        kept = [k for k, (x, y) in enumerate(zip(n, m, strict=True)) if apart_at_least(batch.column(3)[k].as_py(), batch.column(5)[k].as_py()) <= most_apart(x, y, percent, near)]
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])


# ---- pairs of texts ------------------------------------------------------------------------------------------------


def _pairs(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Slices of pairs (a, b, ta, tb) with the sets of both, made again from the whole texts."""
    for batch in batches:
        for half in parts(batch, 2, 250):
            for part in parts(half, 3, 250):
                texts = [*part.column(2).to_pylist(), *part.column(3).to_pylist()]
                new = list(dict.fromkeys(texts))
                seen = dict(zip(new, shingles.sets(new, size), strict=True))
                yield part, [seen[t] for t in texts[: part.num_rows]], [seen[t] for t in texts[part.num_rows :]]


def _verified(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are as alike as asked."""
    for part, left, right in _pairs(size, batches):
        kept = []
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                kept.append(k)
        yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])


def delta(x: np.ndarray, leader: np.ndarray, percent: int) -> tuple[bool, bool, list[tuple[int, np.ndarray]]]:
    """How a set lies to its leader: linked, a satellite (half of the larger in common), and its prefixes of differences.

    Two satellites a and b of a leader of n shingles, of which they lack D and to which they add X, share n - Da - Db shingles
    and as many more as their differences have in common.  If a isn't linked with the leader, what they need is more than
    that: at least [p (n + X) - 100 (n - D) + p] / (100 + p) common differences for a against any b but the leader, and more than
    [100 D + p X] / (100 + p) for either against one that isn't linked.  So prefixes of their differences, additions first, must meet.  Roles: 0 and 1
    of a set that isn't linked, against linked ones and against its like; 2 of a linked set.
    """
    n, both = len(leader), len(np.intersect1d(x, leader, assume_unique=True))
    linked = both > 0 and 100 * both >= percent * (len(x) + n - both)
    if 2 * both < max(n, len(x)):
        return linked, False, []
    added, lost = len(x) - both, n - both
    new = np.setdiff1d(x, leader, assume_unique=True)
    gone = shingles.mix(np.setdiff1d(leader, x, assume_unique=True) ^ np.uint64(0x5EED))
    whole = np.concatenate((np.sort(new), np.sort(gone)))
    half = (100 * lost + percent * added) // (100 + percent) + 1
    if linked:
        needs = [(2, half)]
    else:
        needs = [(0, max(1, -(-(percent * (n + added) - 100 * both + percent) // (100 + percent)))), (1, half)]
    return linked, True, [(role, whole[: max(0, len(whole) - c + 1)]) for role, c in needs]


def _measured(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of a leader a and a document b: a row that tells whether they link and b is a satellite, then b's differences."""
    names = ["a", "b", "linked", "near", "role", "token"]
    for part, left, right in _pairs(size, batches):
        a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
        found = [delta(y, x, percent) for x, y in zip(left, right, strict=True)]
        linked, near = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked), pa.array(near), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())], names=names)
        lists = [(k, role, tokens) for k, f in enumerate(found) for role, tokens in f[2]]
        if lists:
            times = np.array([len(x[2]) for x in lists])
            k, role = (np.repeat(np.array([x[i] for x in lists]), times) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a[k]), pa.array(b[k]), pa.array(linked[k]), pa.array(near[k]), pa.array(role.astype(np.int32)), pa.array(np.concatenate([x[2] for x in lists]).view(np.int64))], names=names)


def meeting(b: np.ndarray, role: np.ndarray, token: np.ndarray, group: np.ndarray, fits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs x < y of satellites that have a difference in common and may link: both of role 1, or one of 0 and one of 2.

    Rows that are already known to be of one group aren't paired; ``fits(x, y)`` tells which pairs of an array may link.
    """
    order = np.lexsort((b, token))
    b, role, token, group = b[order], role[order], token[order], group[order]
    edges = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
    seen: list[np.ndarray] = []
    size = 0
    known = np.zeros((0, 2), dtype=b.dtype)

    def new(parts_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.unique(np.concatenate(parts_), axis=0)
        if len(known):
            both, at, count = np.unique(np.concatenate((known, every)), axis=0, return_index=True, return_counts=True)
            every = both[(count == 1) & (at >= len(known))]
        return every[fits(every[:, 0], every[:, 1])] if len(every) else every, every

    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi - lo < 2:
            continue
        ids, roles, of = b[lo:hi], role[lo:hi], group[lo:hi]
        one, zero, two = (np.flatnonzero(roles == k) for k in (1, 0, 2))
        for left, right, own in ((one, one, True), (zero, two, False)):
            step = max(1, 500_000 // max(1, len(right)))
            for at in range(0, len(left), step):
                i, j = np.meshgrid(left[at : at + step], right, indexing="ij")
                keep = (of[i] != of[j]) & ((ids[i] < ids[j]) if own else (ids[i] != ids[j]))
                if keep.any():
                    x, y = ids[i[keep]], ids[j[keep]]
                    seen.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
                    size += len(x)
                if size > 1_000_000:
                    good, every = new(seen)
                    known, seen, size = np.concatenate((known, every)) if len(known) < 1_000_000 else every, [], 0
                    yield good[:, 0], good[:, 1]
    if seen:
        good, _ = new(seen)
        yield good[:, 0], good[:, 1]


def _met(percent: int, rows: pa.Table) -> pa.Table:
    """One leader's satellites, or a share of their differences: a row for each difference, one with the sketch for each satellite."""
    is_sketch = np.asarray(rows["sketch"].is_valid())
    sketched, rest = rows.filter(pa.array(is_sketch)), rows.filter(pa.array(~is_sketch))
    order = np.argsort(sketched["b"].to_numpy())
    ids, sizes = sketched["b"].to_numpy()[order], sketched["size"].to_numpy()[order]
    made = sketched["sketch"].take(pa.array(order)).to_pylist()
    long = np.array([len(x) // 8 for x in made])
    folded: dict[int, np.ndarray] = {}  # by words: the sketches that have as many or more, folded; others are no part

    def level(words: int) -> np.ndarray:
        if words not in folded:
            folded[words] = np.zeros((len(made), words), dtype=np.uint64)
            for k in np.flatnonzero(long >= words):
                folded[words][k] = np.bitwise_xor.reduce(np.frombuffer(made[k], dtype=np.uint64).reshape(-1, words), axis=0)
        return folded[words]

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs may link; ids with several texts have an empty sketch, which rules nothing out."""
        i, j = np.searchsorted(ids, x), np.searchsorted(ids, y)
        n, m, words = sizes[i], sizes[j], np.minimum(long[i], long[j])
        out = words == 0
        for w in np.unique(words[words > 0]).tolist():
            at, bits = np.flatnonzero(words == w), level(w)
            for lo in range(0, len(at), step := max(1, (1 << 20) // w)):
                k = at[lo : lo + step]
                apart = np.bitwise_count(bits[i[k]] ^ bits[j[k]]).sum(axis=1, dtype=np.int64)
                out[k] = (apart <= (n[k] + m[k]) * (100 - percent) // (100 + percent)) & (100 * np.minimum(n[k], m[k]) >= percent * np.maximum(n[k], m[k]))
        return out

    found = list(meeting(*(rest[c].to_numpy() for c in ("b", "role", "token", "group")), fits))
    x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


# ---- links and components ------------------------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that can be reached from each node of the links (a, b).

    Large-star and small-star by turns: every node's neighbours are joined to the smallest of them, until nothing changes.
    Minima are aggregated before they are joined, so a node with very many neighbours isn't gathered anywhere.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        last, edges = edges, materialise(small.select("u", "v").unionByName(small.select(F.col("w").alias("u"), "v")).filter("u <> v").distinct(), "stars")
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _only(docs: DataFrame, ids: DataFrame, number: int, how: str) -> DataFrame:
    """docs that have (left_semi) or lack (left_anti) an id; the ids are broadcast where their number allows."""
    return docs.join(F.broadcast(ids) if number <= BROADCAST_IDS else ids, "doc_id", how)


class _Pairs:
    """Candidate pairs (a, b) of one set of documents, thinned out by sketches before texts are moved for them."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent

    def sketches(self, ids: DataFrame, most: int, label: str) -> DataFrame:
        """doc_id, size, sketch of the documents with the ids (doc_id, distinct), of which there are ``most`` at most."""
        made = _only(self.docs, ids, most, "left_semi").mapInArrow(functools.partial(_sketched, self.size), "doc_id long, size long, sketch binary")
        return materialise(made, f"{label}-sketches")

    def likely(self, pairs: DataFrame, label: str, near: bool = False, known: DataFrame | None = None) -> DataFrame:
        """The pairs that may link or, with ``near``, may have half in common; known: sketches, if there are some already."""
        made = known is None
        if made:
            known = self.sketches(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * pairs.count(), label)
        joined = pairs
        for x in "ab":
            joined = joined.join(known.select(F.col("doc_id").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
        out = joined.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(functools.partial(_likely, self.percent, near), "a long, b long")
        out = materialise(out, f"{label}-likely")
        if made:
            release(known)
        return out

    def with_texts(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ta, tb) of written pairs.  Only texts of documents that are in a pair are moved, to the side on which they are."""
        joined, most = pairs, pairs.count()
        for x in "ba":
            texts = _only(self.docs, pairs.select(F.col(x).alias("doc_id")).distinct(), most, "left_semi")
            joined = joined.join(texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")), x)
        return joined.select("a", "b", "ta", "tb")

    def measured(self, pairs: DataFrame) -> DataFrame:
        made = self.with_texts(pairs).mapInArrow(functools.partial(_measured, self.size, self.percent), "a long, b long, linked boolean, near boolean, role int, token long")
        return materialise(made, "measured")

    def links(self, pairs: DataFrame, label: str, known: DataFrame | None = None) -> DataFrame:
        """The pairs that link."""
        likely = self.likely(pairs, label, known=known)
        out = materialise(self.with_texts(likely).mapInArrow(functools.partial(_verified, self.size, self.percent), "a long, b long"), f"{label}-links")
        release(likely)
        return out


def _labels(near: DataFrame, name: str) -> DataFrame:
    """(doc, to): the smallest document that each is linked with, two steps further at most."""
    label = first = materialise(near.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("to")), name)
    on = first.select(F.col("doc").alias("to"), F.col("to").alias("further"))
    for _ in range(2):
        label = label.join(on, "to", "left").select("doc", F.coalesce("further", "to").alias("to"))
    return label


def _satellites(pairs: _Pairs, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between satellites of one leader, of which at least one isn't linked with it; apart: (a, b, role, token).

    In each list of a difference all are first held against the smallest that isn't linked with the leader: copies that share
    their changes find a second leader there.  What that has not put together is compared within tasks of TOGETHER differences
    each: every pair once for a task, and only pairs that sketches allow come out.
    """
    heads = apart.groupBy("a", "token").agg(F.min(F.when(F.col("role") < 2, F.col("b"))).alias("head"), F.min("b").alias("low"), F.max("b").alias("high"))
    heads = heads.filter("head IS NOT NULL AND low <> high").select("a", "token", "head")
    listed = materialise(apart.join(heads, ["a", "token"]), "listed")
    members = materialise(listed.select("a", "b").distinct(), "members")
    known = pairs.sketches(members.select(F.col("b").alias("doc_id")).distinct(), members.count(), "satellites")
    second = listed.filter("b <> head").select(F.least("b", "head").alias("a"), F.greatest("b", "head").alias("b")).distinct()
    seconds = materialise(second, "seconds")
    first = pairs.links(seconds, "seconds", known)
    release(seconds)
    label = _labels(first, "second")
    of = label.select(F.col("doc").alias("b"), F.col("to"))
    sizes = listed.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    grouped = listed.join(of, "b", "left").join(sizes, "a").select("a", "b", "role", "token", F.coalesce("to", "b").alias("group"), F.pmod(F.xxhash64("token"), F.col("salts")).cast("int").alias("salt"))
    once = known.groupBy(F.col("doc_id").alias("b")).agg(F.when(F.min("sketch") == F.max("sketch"), F.max("sketch")).otherwise(F.lit(b"")).alias("sketch"), F.max("size").alias("size"))
    kept = members.join(once, "b").join(sizes, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    rows = grouped.select("a", "salt", "b", "role", "token", "group", none("long").alias("size"), none("binary").alias("sketch")).unionByName(kept.select("a", "salt", "b", none("int").alias("role"), none("long").alias("token"), none("long").alias("group"), "size", "sketch"))
    percent = pairs.percent

    def met(group: pa.Table) -> pa.Table:
        return _met(percent, group)

    found = materialise(rows.groupBy("a", "salt").applyInArrow(met, "a long, b long"), "met")
    release(listed, members, known)
    return first, found


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with class representatives, and the links between representatives that hold all groups together.

    The first: doc_id, n_shingles, rep (the smallest id with an equal set; null without shingles).  The second: a, b.  Every
    pair of linked sets is joined by links, directly or through others that are verified.  A posting list's entries are first
    held against its smallest document, the leader.  Those that are near the same leader are compared further only where
    their differences from it meet (see ``delta``); what has neither leader nor group in common is paired entry by entry.
    So thousands of near copies of one text take about as many comparisons as they are, not their square.  Candidates whose
    sketches differ in more bits than linked sets can are dropped before any text is moved; the others are verified on sets
    made again from whole texts.  Shingles are compared by 64-bit hashes: it is exact as far as these tell shingles apart.

    Rows with equal ids are one document; where their texts differ it links with whatever any of them links with, and
    n_shingles is that of the smallest set.  Null ids count as one id.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = _Pairs(texts, size, percent)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _signed(batches, size)

    first = materialise(texts.mapInArrow(signed, "doc_id long, n long, s1 long, s2 long, cell long, count long"), "sets")
    counts = first.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()  # 2**BITS rows at most
    cells = np.zeros(1 << BITS, dtype=np.int64)
    cells[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    order = np.empty(1 << BITS, dtype=np.uint64)
    by = np.argsort(cells, kind="stable")
    order[by] = np.arange(1 << BITS, dtype=np.uint64)
    usual = float(np.median(cells))
    above = np.maximum(0.0, cells[by] - usual - 3 * usual**0.5)
    shared = docs.sparkSession.sparkContext.broadcast((order, 0.25 + above, (1 + above // HOT).astype(np.int32)))

    of_id = first.filter("cell IS NULL").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("s"), F.max(F.struct("n", "s1", "s2")).alias("t"))
    sets = materialise(of_id.select("doc_id", F.col("s.n").alias("n_shingles"), F.col("s.s1").alias("s1"), F.col("s.s2").alias("s2"), (F.col("s") == F.col("t")).alias("one")), "by-id")
    release(first)
    some = sets.filter("n_shingles > 0 AND one").select("doc_id", "n_shingles", "s1", "s2")
    classes = materialise(some.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")).filter("members > 1").drop("members"), "classes")
    members = materialise(some.join(classes, ["n_shingles", "s1", "s2"]).filter("doc_id <> rep").select("doc_id", "rep"), "members")
    release(classes)
    reps = _only(texts, members.select("doc_id"), members.count(), "left_anti")

    entries = reps.mapInArrow(functools.partial(_prefixes, shared, size, percent), "token long, salt int, doc long, n int, matches int")
    together = Window.partitionBy("token", "salt")
    lists = materialise(entries.withColumn("long", F.count("*").over(together)).filter("long > 1 OR salt > 0").drop("long"), "entries")
    heads = lists.groupBy("token").agg(F.min(F.struct("doc", "n", "matches")).alias("first"), F.count("*").alias("long")).filter("long > 1")
    heads = materialise(heads, "heads")

    # stars: each entry against the smallest document of its list
    alike = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    with_head = lists.drop("salt").join(heads, "token").filter("doc <> first.doc")
    stars = with_head.groupBy(F.col("doc").alias("b"), F.col("first.doc").alias("a")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("first.n").alias("m"), F.first(F.least("matches", "first.matches")).alias("asked"), F.max("long").alias("long"))
    stars = materialise(stars.filter(f"{alike} AND shared >= asked OR long >= {LONG} AND 2 * least(n, m) >= greatest(n, m)").select("a", "b"), "stars")
    likely = pairs.likely(stars, "stars", near=True)
    release(stars)
    measured = pairs.measured(likely)
    release(likely)
    told = measured.filter("role IS NULL")
    near = told.filter("linked").select("a", "b")
    home = told.filter("near").groupBy("b").agg(F.min("a").alias("a"))
    apart = materialise(measured.filter("role IS NOT NULL").join(home, ["a", "b"]).select("a", "b", "role", "token"), "apart")
    seconds, met = _satellites(pairs, apart)
    release(apart)

    # the rest of a list is paired entry by entry where neither leader nor group is common
    label = _labels(near, "label")
    grouped = lists.join(heads.select("token"), "token", "left_semi").drop("salt").join(label, "doc", "left").join(home.select(F.col("b").alias("doc"), F.col("a").alias("home")), "doc", "left")
    grouped = materialise(grouped.withColumn("group", F.coalesce("to", "doc")).withColumn("home", F.coalesce("home", "doc")).drop("to"), "grouped")
    release(lists, heads)
    several = grouped.groupBy("token").agg(*(f(x).alias(f"{k}_{x}") for x in ("group", "home") for k, f in (("low", F.min), ("high", F.max)))).filter("low_group <> high_group AND low_home <> high_home").select("token")
    mixed = materialise(grouped.join(several, "token", "left_semi"), "mixed")
    release(grouped)
    left = mixed.select("token", F.col("doc").alias("a"), F.col("n"), F.col("matches").alias("k"), F.col("group").alias("ga"), F.col("home").alias("ha"))
    right = mixed.select("token", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("matches").alias("l"), F.col("group").alias("gb"), F.col("home").alias("hb"))
    across = left.join(right, "token").filter(f"a < b AND ga <> gb AND ha <> hb AND {alike}").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least("k", "l")).alias("asked"))
    others = materialise(across.filter("shared >= asked").select("a", "b").unionByName(met).distinct(), "pairs")
    release(mixed, met)
    far = pairs.links(others, "pairs")
    release(others)
    every = sets.join(members, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    return every, near.unionByName(seconds).unionByName(far)


def groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links (its own for texts without words); one row per id."""
    every, links = join(docs, size, percent, id_col, text_col)
    reached = components(links).select(F.col("node").alias("rep"), "component")
    out = every.join(reached, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the smallest id; all columns stay.

    Rows with equal ids are one document: of them the one with the smallest hash of the text stays.  Rows with null ids stay.
    """
    gone = groups(docs.filter(F.col(id_col).isNotNull()), size, percent, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    gone = materialise(gone, "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(*docs.columns)
    again = materialise(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "again")
    number = again.count()
    if not number:
        return kept
    again = F.broadcast(again) if number <= BROADCAST_IDS else again
    row = F.struct(*(F.col(c) for c in docs.columns))
    first = kept.join(again, id_col, "left_semi").groupBy(F.col(id_col).alias("key")).agg(F.min_by(row, F.xxhash64(text_col)).alias("row")).select("row.*")
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
