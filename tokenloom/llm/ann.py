"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched through one queue."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import materialise

#: Distinct vectors on which the trees are fitted at most; trees; rows of a leaf.
SAMPLE, TREES, LEAF = 20_000, 12, 64
#: A query's leaves hold REACH * rows ** 0.7 rows in sum, times the root of the number of trees.
REACH = 3.4
#: Neighbouring leaves that meet their queries together; rows, and queries, that such a group holds at once.
NEIGHBOURS, BLOCK = 16, 40_000
#: Queries with too few answers that are sent to all rows at once.
EXACT = 2_000


@dataclass
class Tree:
    """Inner nodes have a direction, a threshold and children; a child below 0 is leaf -1 - child."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    sizes: np.ndarray


@dataclass
class Forest:
    trees: list[Tree]
    longest: float
    rows: int

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors on the unit sphere: one more coordinate makes the largest inner product the smallest angle."""
        x = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        lifted, out = self._lifted(x), np.empty((len(x), len(self.trees)), dtype=np.int32)
        for t, tree in enumerate(self.trees):
            node = np.zeros(len(x), dtype=np.int64) if len(tree.cuts) else np.full(len(x), -1)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = np.einsum("ij,ij->i", lifted[inner], tree.directions[at]) > tree.cuts[at]
                node[inner] = tree.children[at, side.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def probes(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until the leaves hold ``share`` of the sample in sum, times the root of
        the number of trees (they overlap).

        A branch waits with the sum of squares of how far the query lies beyond the cuts that lead there, which, directions being
        nearly at right angles, is about the least squared distance to anything in it.
        """
        q = q / np.abs(q).max()
        lifted = np.append(q / np.linalg.norm(q), 0.0)
        margins = [tree.directions @ lifted - tree.cuts if len(tree.cuts) else np.zeros(0) for tree in self.trees]
        queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(self.trees)]
        out, seen, goal = [], 0, share * self.rows * len(self.trees) ** 0.5
        while queue and (seen < goal or len(out) < len(self.trees)):
            far, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while node >= 0:
                m = float(margins[t][node])
                near, other = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (far + m * m, t, int(tree.children[node, other])))
                node = int(tree.children[node, near])
            out.append((t, -1 - node))
            seen += int(tree.sizes[-1 - node])
        return out


def grow(x: np.ndarray, trees: int, leaf: int, seed: int = 17) -> Forest:
    """Each node cuts its rows at the median of their projection on the difference of two of them plus noise."""
    most = np.abs(x).max() if len(x) else 1.0  # squares of the largest doubles would be infinite
    longest = float(most * np.sqrt(np.einsum("ij,ij->i", x / most, x / most).max())) if len(x) else 1.0
    forest = Forest([], longest, len(x))
    lifted = forest._lifted(x) if len(x) else x
    for t in range(trees):
        rng = np.random.default_rng((seed, t))
        directions, cuts, children, sizes = [], [], [], []

        def node(rows: np.ndarray, rng=rng, directions=directions, cuts=cuts, children=children, sizes=sizes) -> int:
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = lifted[rng.choice(rows, 2, replace=False)]
                    r = a - b + rng.normal(size=lifted.shape[1]) * np.linalg.norm(a - b) * 0.3 / lifted.shape[1] ** 0.5
                    n = np.linalg.norm(r)
                    if n == 0:
                        continue
                    p = lifted[rows] @ (r / n)
                    cut = float(np.median(p))
                    right = p > cut
                    if right.any() and not right.all():
                        me = len(cuts)
                        directions.append(r / n)
                        cuts.append(cut)
                        children.append([0, 0])
                        children[me][0] = node(rows[~right])
                        children[me][1] = node(rows[right])
                        return me
            sizes.append(len(rows))
            return -len(sizes)

        node(np.arange(len(x)))
        forest.trees.append(Tree(np.array(directions).reshape(len(cuts), lifted.shape[-1]), np.array(cuts), np.array(children, dtype=np.int64).reshape(len(cuts), 2), np.array(sizes)))
    return forest


# ---- DataFrames ----------------------------------------------------------------------------------------------------


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v of the rows that take part: no null, no component null or not finite, not all zero, of the commonest length.

    Components stay as they are, floats or doubles; other numbers become doubles.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast(f"array<{kind if kind == 'float' else 'double'}>")
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = x.filter(finite & F.exists("v", lambda e: e != 0))
    common = x.groupBy(F.size("v").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).select("_d")
    return x.join(F.broadcast(common), F.size("v") == F.col("_d"), "left_semi")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Vectors as they came: what was read as floats is one again, without loss."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()).cast(kind))


def _placed(forest, salts: int, copies: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row in its leaf of every tree, once for each block of queries."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
            leaf = forest.value.leaves(x)
            n, trees = leaf.shape
            for c in range(copies):
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(leaf[:, t]), pa.array((ids % salts).astype(np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(ids), _list(x, part.column(1).type.value_type)], names=["tree", "leaf", "salt", "side", "id", "v"])


def _asked(forest, share: float, salts: int, copies: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every query at each leaf of its search, once for each block of the leaf's rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
            found = [(t, leaf, s, k) for k, q in enumerate(x) for t, leaf in forest.value.probes(q, share) for s in range(salts)]
            tree, leaf, salt, k = np.array(found, dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array((ids[k] // 20 % copies).astype(np.int32)), pa.array(ids[k]), _list(x[k], part.column(1).type.value_type)], names=["tree", "leaf", "salt", "side", "id", "v"])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, component by component: the same value for a pair in whatever block it comes."""
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * x[None, :, d]
    return out


_BEST = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def _ranked(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of each query among the rows of those leaves that it asks for."""
    if not rows.num_rows or not asked.num_rows:
        return _BEST.empty_table()
    leaf, ids = rows["leaf"].to_numpy(), rows["id"].to_numpy()
    order = np.lexsort((ids, leaf))
    leaf, ids, x = leaf[order], ids[order], _matrix(rows["v"])[order]
    names, want, q = asked["id"].to_numpy(), asked["leaf"].to_numpy(), _matrix(asked["v"])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        query, rep, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((rep, -score, query))
        query, rep, score = query[by], rep[by], score[by]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        return query[place < k], rep[place < k], score[place < k]

    size = 0
    for a in np.unique(leaf):
        lo, hi = np.searchsorted(leaf, (a, a + 1))
        who = np.flatnonzero(want == a)
        step = max(1, 1_000_000 // (hi - lo))
        for at in range(0, len(who), step):
            part = who[at : at + step]
            held.append((np.repeat(names[part], hi - lo), np.tile(ids[lo:hi], len(part)), products(q[part], x[lo:hi]).ravel()))
            size += len(part) * (hi - lo)
            if size > 2_000_000:
                held = [best(held)]
                size = len(held[0][0])
    return pa.table(list(best(held)), schema=_BEST) if held else _BEST.empty_table()


def _exact(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of a few queries among the rows of a partition."""
    ids, q = shared.value
    best: list[np.ndarray] = [np.zeros((0, 2))] * len(ids)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            names, score = part.column(0).to_numpy(), products(q, _matrix(part.column(1)))
            for i in range(len(ids)):
                mine = np.flatnonzero(names != ids[i])
                every = [*best[i], *zip((-score[i, mine]).tolist(), names[mine].tolist(), strict=True)]
                best[i] = heapq.nsmallest(k, map(tuple, every))
    rows = [(int(i), int(r), -s) for i, found in zip(ids, best, strict=True) for s, r in found]
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BEST, strict=True)], schema=_BEST)


def _topped_up(found: DataFrame, rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """found, with all rows searched for those queries that have fewer answers than there are: k, or all other ids."""
    found, asked = materialise(found, "found"), materialise(asked, "asked")
    number = rows.select("vec_id").distinct().limit(k + 1).count()  # of candidates, as far as it matters
    most = min(k, max(0, number - 1))
    short = asked.join(found.groupBy("query_id").count(), F.col("id") == F.col("query_id"), "left").filter(F.coalesce("count", F.lit(0)) < most).select("id", "v")
    short = materialise(short, "short")
    count = short.count()
    if not count:
        return found
    parts, blocks = [found.join(short, F.col("query_id") == F.col("id"), "left_anti")], -(-count // EXACT)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    for b in range(blocks):
        these = short.filter(block == b).collect()  # about EXACT of them
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r.id for r in these], dtype=np.int64), np.array([r.v for r in these], dtype=np.float64)))
        near = rows.dropDuplicates(["vec_id", "v"]).mapInArrow(functools.partial(_exact, shared, k), "query_id long, rep long, score double")
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
        parts.append(near.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("rep").alias("vec_id"), "score"))
    return functools.reduce(DataFrame.unionByName, parts)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, reach: float = REACH, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows by inner product, rows of its own id left out.

    Equal vectors stand together behind one representative with the k + 1 smallest ids, more than which no answer can hold.
    The forest is fitted on ``sample`` distinct vectors at most (those with the smallest hash) and sent to all executors: its
    size is bounded by the sample.  Every distinct vector is then put into its leaf of every tree.  A query's leaves come
    from one queue over all trees.  Leaves, numbered as they lie in the tree, meet their queries in groups of NEIGHBOURS, and
    these in blocks of BLOCK.  A query whose leaves hold fewer than k others is held against all rows, in blocks of EXACT
    queries, so that none has fewer answers than there are.

    Scores are in double precision, of the vectors as they are.  Of several query rows with one id the first by vector counts;
    candidate rows with equal ids and different vectors are candidates each.
    """
    rows = valid(vectors, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k + 1)
    reps = materialise(kept.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids"), "vectors")
    asked = valid(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("id"), "v")
    number = reps.count()
    chosen = reps.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").toArrow()
    x = _matrix(chosen["v"]) if number else np.zeros((0, 0))
    forest = grow(x, trees, max(4, leaf * len(x) // max(1, number)))
    share = reach * max(1, number) ** -0.3
    groups = max(1, sum(len(t.sizes) for t in forest.trees) // NEIGHBOURS)
    shared = reps.sparkSession.sparkContext.broadcast(forest)
    salts = -(-max(1, number * trees // groups) // BLOCK)
    asks = asked.count() * max(trees, int(share * number * trees**0.5 / leaf)) // groups
    copies = -(-max(1, asks) // BLOCK)
    kind = reps.schema["v"].dataType.simpleString()
    schema = f"tree int, leaf int, salt int, side int, id long, v {kind}"
    placed = reps.select("id", "v").mapInArrow(functools.partial(_placed, shared, salts, copies), schema)
    probes = asked.select("id", F.col("v").cast(kind).alias("v")).mapInArrow(functools.partial(_asked, shared, share, salts, copies), schema)
    key = [F.col("tree"), F.floor(F.col("leaf") / NEIGHBOURS).alias("near"), F.col("salt"), F.col("side")]

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        return _ranked(left, right, k + 1)

    found = placed.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(ranked, "query_id long, rep long, score double")
    once = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    best = once.withColumn("_k", F.row_number().over(near)).filter(F.col("_k") <= k + 1)
    every = best.join(reps.select(F.col("id").alias("rep"), "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = every.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return _topped_up(ranks, rows, asked, k)
