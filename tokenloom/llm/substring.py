"""Substring deduplication: content-defined chunks cut by a gear rolling hash, compared by digest."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import free_name, materialise, parts, release, utf8

#: A cut lies where the gear hash is the largest of so many bytes on either side: chunks of 16 bytes at least, 33 on average.
REACH = 16
#: Runs of repeated chunks that reach so many bytes, or so many words, are duplicates; shorter ones are chance or stock
#: phrases. Of what two texts share, the chunks at both ends are lost: some 45 bytes, about 10 of 51 words.
LEAST, WORDS = 120, 20
#: Bytes of texts that are cut at once, and the zero bytes that keep texts apart.
BLOCK, GAP = 1 << 19, 64
#: A random value for each byte; byte 0 counts nothing, so that what stands before a text is like nothing.
GEAR = np.concatenate(([0], np.random.default_rng(2024).integers(1, 1 << 16, 255))).astype(np.uint16)
CHUNKS = "doc_id long, mark long, start long, length int, words int, first boolean, digest long"
#: Stands for a null id.
NO_ID = -(1 << 63)


def priorities(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 8 bytes up to it, above it a bit for white space; 0 inside a UTF-8 character.

    The rolling hash h = 2 h + GEAR[byte] modulo 2**16 is summed by doubling, and only over 8 bytes.
    """
    h = GEAR[data]
    for k in (1, 2, 4):
        h[k:] += h[:-k] << np.uint16(k)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    out = (h >> np.uint16(1)).astype(np.uint16) | np.uint16(1)
    out |= space.astype(np.uint16) << np.uint16(15)
    out[(data & 0xC0) == 0x80] = 0
    out[data == 0] = 0
    return out


def cuts(data: np.ndarray) -> np.ndarray:
    """Bytes before which a chunk ends: those whose priority is none below of the REACH before and of those after.

    A cut depends on some 24 bytes before and 16 after it, so text that is inserted or deleted moves no cut farther away.
    Where the same few words, or one character, come on and on, equal priorities follow each other: of those the first is
    taken and then each that is REACH away from the last, so that all chunks there begin at one place of what repeats.
    """
    p = priorities(data)
    window, top = 1, p.copy()  # top[i] = max(p[i : i + window])
    while window * 2 <= REACH:
        top[:-window] = np.maximum(top[:-window], top[window:])
        window *= 2
    if window < REACH:
        rest = REACH - window
        top[:-rest] = np.maximum(top[:-rest], top[rest:])
    before, after = np.zeros_like(p), np.zeros_like(p)
    before[REACH:] = top[:-REACH]
    after[:-1] = top[1:]
    found = np.flatnonzero((p >= before) & (p >= after) & (p > 0))
    near = np.flatnonzero(np.diff(found) < REACH)
    if not len(near):
        return found
    taken = np.ones(len(found), dtype=bool)
    at = 0
    for k in near.tolist():  # found[k + 1] is too near to found[k]
        if k >= at:
            at = int(np.searchsorted(found, found[k] + REACH))
            taken[k + 1 : at] = False
    return found[taken]


def chunk(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, cuts) of each text: where its chunks begin and end, from 0 to its length."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < BLOCK):
            size += len(texts[to]) + GAP
            to += 1
        data = np.frombuffer(bytes(GAP) + bytes(GAP).join(texts[at:to]) + bytes(GAP), dtype=np.uint8)
        found, start = cuts(data), GAP
        for k in range(at, to):
            end = start + len(texts[k])
            lo, hi = np.searchsorted(found, (start + 1, end))
            yield k, np.concatenate(([0], found[lo:hi] - start, [end - start])) if end > start else np.zeros(1, dtype=np.int64)
            start = end + GAP
        at = to


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in parts(batch):
            ids, marks = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
            texts = [utf8(t) for t in part.column(1).to_pylist()]
            counts, starts, lengths, n_words, first = [], [], [], [], []
            digests: list[int] = []
            for k, bounds in chunk(texts):
                text, edges = texts[k], bounds.tolist()
                pieces = [text[x:y] for x, y in zip(edges, edges[1:], strict=False)]
                own = [digest(x) for x in pieces]
                n_words += [len(x.split()) for x in pieces]
                seen: set[int] = set()
                first += [not (d in seen or seen.add(d)) for d in own] if len(set(own)) < len(own) else [True] * len(own)
                digests += own
                counts.append(len(own))
                starts.append(bounds[:-1])
                lengths.append(np.diff(bounds))
            if digests:
                n = np.array(counts)
                columns = np.repeat(ids, n), np.repeat(marks, n), np.concatenate(starts).astype(np.int64), np.concatenate(lengths).astype(np.int32), np.array(n_words, dtype=np.int32), np.array(first), np.array(digests, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "mark", "start", "length", "words", "first", "digest"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: doc_id, mark (a hash of the text), start and length in UTF-8 bytes, words, whether the text has had the
    chunk before, and a digest of 64 bits.

    Null and empty texts have no chunk.  A text without white space is cut at other characters.
    """
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).mapInArrow(_chunked, CHUNKS)


def repeated_spans(docs: DataFrame, least: int = LEAST, within: bool = False, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Spans to remove: doc_id, mark, start, length (UTF-8 bytes), chunks, kept_doc_id (where the span's first chunk stays) and
    kept_doc_ids (where any of its chunks does, sorted).

    A chunk stays in the document with the smallest id of all that hold its digest; with ``within``, only the first time it
    occurs there.  Others, where they form runs that reach ``least`` bytes or ``words`` words, make a span.  Digests are counted before they are joined: a digest is one
    row there however often it occurs, and the join's large partitions can be split, so neither a third of all rows with one
    text nor a passage in every document meets in one task.  Rows with equal ids remove nothing from each other; null ids
    count as the smallest id.  A chance repetition of digests can't make a span, as it takes several in a row.
    """
    every = materialise(chunks(docs, id_col, text_col), "chunks")
    counted = materialise(every.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_doc_id")).filter("n > 1").drop("n"), "digests")
    again = every.join(counted, "digest").filter("kept_doc_id < doc_id OR NOT first" if within else "kept_doc_id < doc_id")
    again = again.groupBy("doc_id", "mark", "start").agg(F.max("length").alias("length"), F.max("words").alias("words"), F.max("kept_doc_id").alias("kept_doc_id"))
    order = Window.partitionBy("doc_id", "mark").orderBy("start")
    marked = again.withColumn("new", (F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(-1)) != F.col("start")).cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc_id", "mark", "run").agg(F.min("start").alias("start"), F.sum("length").cast("long").alias("length"), F.sum("words").alias("words"), F.count("*").alias("chunks"), F.min_by("kept_doc_id", "start").alias("kept_doc_id"), F.sort_array(F.collect_set("kept_doc_id")).alias("kept_doc_ids"))
    out = materialise(spans.filter((F.col("length") >= least) | (F.col("words") >= words)).drop("run", "words"), "spans")
    release(every, counted)
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of its UTF-8 bytes."""
    raw, at, out = utf8(text), 0, []
    for start, length in sorted(spans):
        out.append(raw[at:start])
        at = max(at, start + length)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, least: int = LEAST, within: bool = False, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of docs, each text without its repeated spans; all other columns stay.  Null and empty texts stay as they are."""
    key, mark, held = (free_name(docs, x) for x in ("_id", "_mark", "_spans"))
    spans = repeated_spans(docs, least, within, id_col, text_col, words)
    by_row = spans.groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(F.collect_list(F.struct("start", "length")).alias(held))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([None if t is None else without(t, [(s["start"], s["length"]) for s in ls]) for t, ls in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.string())

    once = cut.asNondeterministic()  # so that no filter above it makes Spark cut a second time
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), mark: F.xxhash64(text_col)})
    joined = keyed.join(by_row, [key, mark], "left")
    left = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(once(F.when(F.col(held).isNotNull(), F.col(text_col)), held))
    return joined.withColumn(text_col, left).select(*docs.columns)
