"""Media, archives, mixing, packing, search, licenses, toxicity and languages: brute force, round trips, held-out accuracy, edges."""

import binascii
import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import TABLES
from pyspark.sql import functions as F

from tokenloom.llm import ann, gif, langid, licenses, mixing, packing, queries, toxicity, warc

EDGES = [(1, "plain text"), (2, ""), (3, None), (4, "é" * 40000), (5, "plain text"), (5, "plain text")]
DOCS = "doc_id long, text string"


def test_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert gif.round_trip(none).count() == 0 and packing.packed_documents(none).count() == 0
    assert mixing.mix(none.withColumn("source", F.lit("a"))).count() == 0
    assert toxicity.score(none, toxicity.fit([], [])).count() == 0 and langid.predict(none, langid.fit([], [])).count() == 0
    assert licenses.scan(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(vectors, vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_responses(pages), "response_id")).count() == 0


# ---- media ---------------------------------------------------------------------------------------------------------


def lzw_encode(samples, least):
    """A plain encoder with a growing table, to test the reader with."""
    clear, end = 1 << least, (1 << least) + 1
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    table, width, word = {bytes([i]): i for i in range(clear)}, least + 1, b""
    put(clear, width)
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word], width)
        table[word + bytes([s])] = len(table) + 2
        if len(table) + 2 > 1 << width and width < 12:
            width += 1
        if len(table) + 2 >= 4095:
            put(clear, width)
            table, width = {bytes([i]): i for i in range(clear)}, least + 1
        word = bytes([s])
    if word:
        put(table[word], width)
    put(end, width)
    if bits:
        out.append(held & 255)
    return bytes(out)


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw(least):
    rng = np.random.default_rng(least)
    for n in (0, 1, 5, 300, 20000):
        samples = (rng.integers(0, 1 << least, n) // rng.integers(1, 3)).astype(np.uint8)
        assert (gif.lzw_decode(lzw_encode(samples.tobytes(), least), least, n) == samples).all()
        if n:
            assert (gif.lzw_decode(gif.lzw_encode(samples.tobytes(), least), least, n) == samples).all()


def plain_codes(data, least):
    """The codes of a stream, one after the other, and how many stand for more than a sample."""
    clear, width, table, at, bits = 1 << least, least + 1, 0, 0, int.from_bytes(data, "little")
    codes = []
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        codes.append(code)
        if code == clear + 1:
            return codes
        if code == clear:
            width, table = least + 1, -1
        else:
            table += 1
            if clear + 2 + table >= 1 << width and width < 12:
                width += 1


def test_streams_have_entries_of_the_table():
    text = b"the quick brown fox jumps over the lazy dog and the quick brown cat " * 300
    codes = plain_codes(gif.lzw_encode(text), 8)
    assert sum(c > 257 for c in codes) > 0.8 * len(codes) and len(codes) < len(text) // 8
    noise = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    assert plain_codes(gif.lzw_encode(noise), 8).count(256) > 5 and gif.lzw_decode(gif.lzw_encode(noise), 8, len(noise)).tobytes() == noise


def test_a_full_table_may_stay():
    """Some writers send no clear code when the table is full."""
    noise = np.random.default_rng(2).integers(0, 4, 60_000).astype(np.uint8).tobytes()
    table, codes, word = {bytes([i]): i for i in range(4)}, [4], b""
    for s in noise:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        codes.append(table[word])
        if len(table) + 2 < 4096:
            table[word + bytes([s])] = len(table) + 2
        word = bytes([s])
    codes += [table[word], 5]
    held = at = 0
    for k, c in enumerate(codes):
        width = 3 if k == 0 else int(gif._widths(2)[min(k - 1, len(gif._widths(2)) - 1)])
        held |= c << at
        at += width
    assert gif.lzw_decode(held.to_bytes(at // 8 + 1, "little"), 2, len(noise)).tobytes() == noise


def test_a_header_alone_costs_nothing():
    assert list(gif.decode(b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";")) == []
    big = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x01\x4c\0;"
    with pytest.raises(gif.GifError):
        list(gif.decode(big))


def test_stored_texts_use_palettes_transparency_and_disposal():
    payload = bytes(range(256)) * 80
    shown = list(gif.decode(gif.encode(payload)))
    assert b"".join(f.indices.tobytes() for f in shown) == payload and len(shown) == 5
    assert [f.disposal for f in shown] == [1, 2, 3, 2, 1] and {f.transparent for f in shown} == {0}
    assert shown[0].rgb[0, 9].tolist() == [9, 9, 9] and shown[1].rgb[0, 9].tolist() == gif.WARM[9].tolist() and shown[3].rgb[0, 9].tolist() == gif.COOL[9].tolist()


def test_frames_with_palettes_disposal_transparency_and_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def image(left, top, w, h, samples, disposal, clear=None, interlaced=False, delay=5):
        flags = disposal << 2 | (clear is not None)
        return b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, clear or 0, 0) + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + gif._blocks(lzw_encode(samples, 2))

    data = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0x81, 0, 0) + palette
    data += image(0, 0, 2, 8, bytes([1] * 16), 1) + image(0, 0, 1, 2, bytes([2, 3]), 3, clear=3) + image(1, 1, 1, 1, bytes([3]), 2)
    data += image(0, 0, 2, 8, bytes([0, 0, 1, 1, 2, 2, 3, 3] * 2), 0, interlaced=True) + b";"
    a, b, c, d = gif.decode(data)
    assert (a.rgb == [255, 0, 0]).all() and [f.start for f in (a, b, c, d)] == [0, 5, 10, 15]
    assert b.rgb[0, 0].tolist() == [0, 255, 0] and b.rgb[1, 0].tolist() == [255, 0, 0]
    assert c.rgb[0, 0].tolist() == [255, 0, 0]
    assert d.indices[[0, 4, 2, 6, 1, 3, 5, 7], 0].tolist() == [0, 1, 2, 3, 0, 1, 2, 3]
    for bad in (b"", b"GIF89a", data[:-1], data[:60], data[:20] + b"\x99" + data[20:]):
        with pytest.raises(gif.GifError):
            list(gif.decode(bad))


def test_media_round_trip(spark):
    long = "x" * (gif.WIDTH * gif.ROWS + 100)
    df = spark.createDataFrame([*EDGES, (6, long)], DOCS).withColumn("media", F.lit(1))
    for r in gif.round_trip(df).collect():
        raw = (dict([*EDGES, (6, long)])[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    shown = gif.frames(gif.store_texts(df)).filter("doc_id = 6").orderBy("frame").collect()
    assert [f.start_ms for f in shown] == [0, 100] and [r.frames for r in gif.round_trip(df).filter("doc_id = 6").collect()] == [2] and b"".join(f.indices for f in shown).rstrip(b"\0") == long.encode() and sum(shown[0].colours) == gif.WIDTH * gif.ROWS
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"GIF"))], "doc_id long, media binary")
    assert all(r.error for r in gif.frames(broken).collect())


# ---- archives ------------------------------------------------------------------------------------------------------


def test_archives(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 5000, "<p>a</p>"] + [f"<html><body>page {i} " + "word " * i for i in range(30)]
    rows = [(i, f"http://x/{i}" if i % 2 else None, h, 0) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response int").coalesce(1)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(warc.with_responses(pages), "response_id")).collect()}
    assert len(got) == len(rows)
    best = {}
    for i, h in enumerate(html):
        best[h or ""] = i
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[i]
        assert r.error is None and r.payload_bytes == len(raw) and r.payload_digest == warc.digest(raw)
        assert (r.record_type, r.refers_to) == (("response", None) if best[h or ""] == i else ("revisit", best[h or ""]))
        assert r.payload == (raw if r.record_type == "response" else None)
    assert len({r.refers_to for r in warc.with_responses(pages, 1).selectExpr("response_id AS refers_to").collect()}) == 2


def test_archives_without_ids_with_clashing_columns(spark):
    rows = [(None, None, "a", 1, 2), (3, None, "a", 1, 2), (3, None, "a", 1, 2), (None, None, None, 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _sha int, _best int")
    linked = warc.with_responses(pages)
    assert linked.columns == [*pages.columns, "response_id"] and {(r._sha, r._best) for r in linked.collect()} == {(1, 2)}
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.error) for r in warc.read_archives(warc.write_archives(linked, "response_id")).collect())
    assert got == [(0, "response", 0, None), (0, "revisit", 3, None), (3, "response", 0, None), (3, "response", 0, None)]


def test_archives_are_read_in_linear_time():
    import time

    noise = np.random.default_rng(3).integers(0, 256, 1 << 20).astype(np.uint8).tobytes()

    def took(n):
        data = b"".join(warc.write_archive([warc.record(i, None, noise[i % 1000 : i % 1000 + 16384], None)])[8:] for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.read_frames(data)) == n
        return time.process_time() - began

    took(100)
    assert took(4096) < 3 * 8 * max(0.01, took(512))


def test_archive_faults():
    records = [warc.record(i, None, b"payload %d " % i * 50, None) for i in range(20)]
    data = warc.write_archive(records)
    assert list(warc.read_frames(data)) == records and data[:4] == struct.pack("<I", 0x184D2A5D)
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(data[:-3]))
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(data[:100]))
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(data[:-40] + b"\0" * 40))
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"HTTP/1.1"), records[0].replace(b"payload 0", b"payload X", 1), records[0].replace(b"WARC-Type", b"X-Type")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# ---- mixing --------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, share, most):
    left, out = share * sum(sizes.values()), {}
    free = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [weights[i % len(weights)] for i in range(len(sizes))], strict=True))
    while free:
        level = left / sum(free.values())
        full = [s for s in free if level * free[s] > most * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in free.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(60))), rng.choice(["b", "a", "a", "a", "é", None, "z"])) for i in range(400)] + [(400, None, "a"), (401, "x\x0by\xa0z", "tiny"), (401, "x\x0by\xa0z", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "rank": F.lit(1), "of": F.lit(2)})
    got = mixing.mix(df.repartition(3)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len([w for w in (t or "").replace("\x0b", " ").split(" ") if w])
    want, taken = water_fill(sizes, (3, 1, 2), 1.5, 2.0), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    lines = defaultdict(list)
    for r in got:
        lines[r.source].append(r)
    schedules = (mixing.RISING, mixing.FALLING)
    for rank, source in enumerate(sorted(lines, key=lambda s: (s is None, (s or "").encode()))):
        (t0, w0), (t1, w1) = schedules[rank % 2]
        walk, at, own = round(want[source]), 0, {}
        for r in sorted(lines[source], key=lambda r: (r.key, r.doc_id)):
            places = [at + p * sizes[source] for p in range(2) if at + p * sizes[source] < walk] if r.taken else []
            assert len(r.positions) == len(places)
            for x, place in zip(r.positions, places, strict=True):
                demanded = (w0 * x + (w1 - w0) * x * x / 2) / ((w0 + w1) / 2)
                assert demanded == pytest.approx(place / walk, abs=1e-9)
            at += r.size
    key = lambda x: (x.doc_id, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    again = mixing.resample(df.withColumns({"_position": F.lit(1), "row": F.lit(2), "positions": F.lit(3)})).drop("_position", "row", "positions")
    order = [r.doc_id for r in mixing.resample(spark.range(300).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "'one' AS source").coalesce(1)).collect()]
    twice = [x for x in set(order) if order.count(x) == 2]
    assert len(twice) == 150 and all(order[::-1].index(x) + order.index(x) < len(order) - 50 for x in twice)
    assert again.columns == df.columns and again.filter("source = 'tiny'").count() in (2, 3, 4)
    assert abs(again.select(F.sum(mixing.word_count(F.col("text")))).first()[0] - sum(want.values())) < 0.1 * sum(want.values())


def test_schedules_are_inverted(spark):
    for schedule in (mixing.RISING, mixing.FALLING, ((0, 1), (1, 1)), ((0, 0), (0.5, 2), (1, 0))):
        times = [r[0] for r in spark.range(101).select(mixing.invert(schedule, F.col("id") / 100)).collect()]
        xs = np.linspace(0, 1, 20001)
        demand = np.concatenate(([0], np.cumsum(np.interp((xs[1:] + xs[:-1]) / 2, *zip(*schedule, strict=True))))) / 20000
        assert np.abs(np.interp(times, xs, demand / demand[-1]) - np.arange(101) / 100).max() < 1e-3
    with pytest.raises(ValueError, match="schedule"):
        mixing.invert(((0, 0), (1, 0)), F.lit(1))


# ---- packing -------------------------------------------------------------------------------------------------------


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing._vocabulary("word_bpe_49k.json")
    tokenizer, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["Hello, WORLD's don't 123 é ﬁ™ 日本 ÉÀ", "", "a\x1cb\x85c İstanbul ΣΑΣ", "<|endoftext|> x <|EndOfText|>", "x." * 50, "tab\tnl\n nbsp　z", "नमस्ते दुनिया", "‘quoted’ — _under_score 3,14 a'b 'll"]
    rng = random.Random(2)
    texts += ["".join(rng.choice("abcÉß'., \n0_́x") for _ in range(80)) for _ in range(300)]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing._vocabulary("word_bpe_49k.json"))
    docs = [(i, t) for i, (_, t) in enumerate(EDGES)] + [(k, "word " * (k * 37 % 900)) for k in range(10, 60)]
    rows = packing.packed_documents(spark.createDataFrame(docs, DOCS).withColumn("piece", F.lit(0))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in docs:
        ids, pieces = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(p.start, p.length) for p in pieces] == [(s, min(2048, len(ids) - s)) for s in range(0, len(ids), 2048)]
        assert all(p.ids_crc32 == binascii.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length])) for p in pieces)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_bounds_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(60):
        cap = int(rng.integers(10, 60))
        lengths = rng.integers(1, cap + 1, rng.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(lengths, cap)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= cap and packing.lower_bound(lengths, cap) <= bins.max() + 1
    assert packing.lower_bound(np.array([6, 6, 6, 4]), 10) == 3 and packing.lower_bound(np.array([], dtype=int), 10) == 0


def test_groups_with_gaps_exchange(spark):
    pieces = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "700 + id * 7919 % 700 AS length", "1L AS ids_crc32")
    rows = packing.pack(pieces, 2048, rounds=2, task_pieces=100).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    alone = packing.pack(pieces, 2048, rounds=0, task_pieces=100).select("sequence_id").distinct().count()
    assert max(r.n for r in rows) <= 2048 and len(rows) <= alone and sum(r.n for r in rows) == sum(700 + i * 7919 % 700 for i in range(4000))


def test_packing_exchanges_until_nothing_is_gained(spark, caplog):
    rng = random.Random(12)
    rows = [(i, 0, 0, rng.randrange(300, 1100), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(pieces, 2048, task_pieces=60).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i, n) for i, _, _, n, _ in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 2048
    two = packing.pack(pieces, 2048, rounds=2, task_pieces=60).select("sequence_id").distinct().count()
    assert len(bins) < two
    assert "groups remain above their bound" in caplog.text


# ---- search --------------------------------------------------------------------------------------------------------


def brute_nearest(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 20 == 0:
            scores = [(-float((v.astype(np.float64) * w.astype(np.float64)).sum()), i) for i, w in vectors.items() if i != q]
            out[q] = sorted(scores)[:k]
    return out


def test_search_recall(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float32) for r in t.collect()}
    got = defaultdict(list)
    for r in ann.search(t, t.filter("vec_id % 20 = 0")).collect():
        got[r.query_id].append(r)
    want, hits = brute_nearest(vectors, 20), 0
    for q, best in want.items():
        rows = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21)) and all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))
        assert all(abs(r.score - float(vectors[q].astype(float) @ vectors[r.vec_id].astype(float))) < 1e-12 for r in rows)
        hits += len({r.vec_id for r in rows} & {i for _, i in best})
    assert hits >= 0.9 * 20 * len(want)


def test_search_edges(spark):
    one = [1.0, 2.0]
    rows = [(i, one) for i in range(60)] + [(60, None), (61, [0.0, 0.0]), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (65, [1.0]), (80, [3.0, 1.0]), (81, [-1.0, 0.5]), (80, [3.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(1)})
    got = defaultdict(list)
    for r in ann.search(t, t.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 80}
    assert got[20] == [(i, 5.0) for i in range(20)] and got[80] == [(i, 5.0) for i in range(20)]


# ---- licenses ------------------------------------------------------------------------------------------------------


def windows_that_hold(texts):
    """(document, license) by brute force over all windows."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for name, t in licenses.TEMPLATES.items():
        own = shingles(licenses.words(t))
        wide, step = licenses.window(len(licenses.words(t)))
        for doc, w in texts.items():
            if any(len(own & shingles(w[a : a + wide])) >= 0.8 * len(own) for a in range(0, max(1, len(w) - 4), step)):
                out.add((doc, name))
    return out


def test_licenses(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "license", "gamma", "software"]) for _ in range(n))
    docs, named = [], set()
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        docs.append((i, f"{noise(rng.randrange(60))}\n{text.upper() if i % 2 else text}\n{noise(rng.randrange(60))}"))
        named.add((i, name))
    docs += [(50, noise(300)), (51, ""), (52, None), (53, "Released under the MIT Licence."), (0, docs[0][1])]
    w = licenses.TEMPLATES["MIT permission"].split()
    docs += [(54, " ".join([*w[:60], "changed", *w[61:]])), (55, " ".join(w[:40]))]
    named |= {(54, "MIT permission"), (6, "Apache-2.0 line")}  # the notice begins with the line
    want = windows_that_hold({k: licenses.words(t or "") for k, t in docs[::-1]})
    assert named <= want
    got = licenses.scan(spark.createDataFrame(docs, DOCS).withColumns({"license": F.lit(1), "h": F.lit(2)})).collect()
    assert {(r.doc_id, r.license) for r in got} == want and all(0.8 <= r.containment <= 1 for r in got)
    with pytest.raises(ValueError, match="words"):
        licenses.scan(spark.createDataFrame(docs, DOCS), {"x": "too short"})


def test_license_query_is_brute_force(spark):
    texts = {r.doc_id: licenses.words(r.text or "") for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    want = windows_that_hold(texts)
    assert {(r.doc_id, r.license) for r in queries.op8_license_windows(spark, TABLES).collect()} == want


def test_license_plan_is_native(spark):
    for name in ("op6_mix_sources", "op8_license_windows"):
        plan = getattr(queries, name)(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# ---- models --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity_noisy_or(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [d for d in labels if got[d].held_out]
    hit = sum(got[d].predicted for d in held if labels[d])
    wrong = sum(got[d].predicted for d in held if not labels[d])
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in held) and len(got) == 10000
    assert hit >= 0.75 * sum(labels[d] for d in held) and wrong <= 0.02 * len(held)


def test_toxicity_sample_keeps_the_share_of_toxic_documents(spark):
    # a tenth is labelled toxic, of which half has a toxic sentence
    rng = random.Random(2)
    plain = lambda n: " ".join(f"A {rng.choice('bcdfgh')}at {rng.choice('lmnpr')}ies here." for _ in range(n))
    rows = [(i, plain(12) + (" You vile scum." if i % 10 == 0 and i % 20 else ""), int(i % 10 == 0)) for i in range(1200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    whole, part = toxicity.train(docs, labels), toxicity.train(docs, labels, sample=120)
    assert abs(whole.bias - part.bias) < 0.3
    long = plain(150)
    assert whole.document(long) < toxicity.THRESHOLD and part.document(long) < toxicity.THRESHOLD
    assert part.document(long + " You vile scum.") >= toxicity.THRESHOLD
    assert toxicity.train(docs, labels.filter("toxic = 0")).document(long) < 0.01


def test_toxic_sentences(spark):
    bad = ["you are a blorg today", "what a blorg", "blorg again and more"] * 10
    good = ["you are a friend today", "what a day", "again and more of this"] * 10
    model = toxicity.fit([f"A fine start. {b}! And so on." for b in bad] + [f"A fine start. {g}! And so on." for g in good], [1] * 30 + [0] * 30)
    df = spark.createDataFrame([(1, "All is well. Such a blorg! Bye."), (2, "All is well."), (3, None), (4, ""), (5, "É. a blorg")], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got[1] > 0.7 and got[2] < 0.3 and got[3] == 0 and got[4] == 0 and got[5] > 0.7
    spans = {r.doc_id: r.text.strip() for r in toxicity.offending_sentences(df, model).collect()}
    assert spans == {1: "Such a blorg", 5: "a blorg"}
    assert [c for c in toxicity.with_score(df, model).columns] == ["doc_id", "text", "toxicity"]


def test_languages_held_out(spark):
    got = {r.doc_id: r for r in queries.op5_language_spans(spark, TABLES).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    held = [d for d in langs if got[d].held_out and langs[d]]
    assert sum(got[d].lang_pred == langs[d] for d in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_language_spans(spark):
    texts = {"en": "the house of this that with which", "de": "der das ist nicht und auf schön für", "ru": "это дом который есть мир"}
    model = langid.fit([t for t in texts.values() for _ in range(5)], [k for k in texts for _ in range(5)], penalty=4.0)
    mixed = "the house of this 12 der das ist nicht, это дом"
    df = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "12 !?"), (5, "дом"), (6, "漢字")], DOCS)
    spans = [(r.lang, mixed.encode()[r.start : r.start + r.length].decode()) for r in langid.spans(df, model).orderBy("doc_id", "span").filter("doc_id = 1").collect()]
    assert [s[0] for s in spans] == ["en", "de", "ru"] and spans[2][1] == "это дом"
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[5] == ("ru", 1.0) and got[6][0] in texts


def test_languages_without_spaces_are_read_to_the_end(spark):
    han, kana, thai = "今天天气很好我们去公园散步吧", "きょうはとてもいいてんきですね", "วันนี้อากาศดีมากเราไปเดินเล่นกัน"
    texts = {"zh": han * 9, "ja": kana * 9, "th": thai * 9, "en": "the house of this that with which " * 9}
    model = langid.fit([t for t in texts.values() for _ in range(3)], [k for k in texts for _ in range(3)], penalty=4.0)
    runs = [(1, han * 6 + kana * 40), (2, kana * 6 + "，" + thai * 40 + han * 6), (3, "─" * 80 + "thehouseofthis"), (4, "─" * 80), (5, "thehouse" * 9 + han * 20)]
    df = spark.createDataFrame(runs, DOCS)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["ja", "th", "en", "und", "zh"] and got[4].score == 0
    assert abs(got[1].score - 40 * len(kana) / (40 * len(kana) + 6 * len(han))) < 0.01
    spans = [(r.lang, r.start, r.length) for r in langid.spans(df, model).filter("doc_id = 2").orderBy("span").collect()]
    ends = [len(x.encode()) for x in (kana * 6 + "，", thai * 40, han * 6)]
    assert spans == [("ja", 0, ends[0]), ("th", ends[0], ends[1]), ("zh", ends[0] + ends[1], ends[2])]
    for text in (runs[1][1], "ab\ud800" * 50, "wordслово漢字 x" * 9, "naïve—" * 30):
        assert b"".join(langid.words(text)) == text.encode("utf-8", "surrogatepass").replace(b" ", b"")
    late = langid.fit(["漢" * 64 + "字" * 64, "漢" * 64 + "文" * 64], ["a", "b"])  # differ only after 64 characters
    assert [x for x, _ in late.predict(["字" * 20, "文" * 20])] == ["a", "b"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {}, penalty=1.5)
    words = [f"w{i}".encode() for i in range(8)]
    model.known = {w: i for i, w in enumerate(words)}
    model.matrix = np.column_stack([rng.normal(size=(8, 3)), np.ones(8)]).astype(np.float32)
    docs = [[words[i] for i in rng.integers(0, 8, n)] for n in (1, 3, 6, 0, 6, *rng.integers(1, 7, 60))]
    import itertools

    for doc, path in zip(docs, model.label(docs, cells=9), strict=True):
        worth = lambda p: sum(model.matrix[model.known[w]][k] for w, k in zip(doc, p, strict=True)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
        if doc:
            assert worth(path.tolist()) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=len(doc)))), abs=1e-4)


def test_many_languages():
    langs = [f"l{i:03d}" for i in range(200)]
    texts = [f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 30 for i in range(200)]
    model = langid.fit(texts, langs, penalty=1.0)
    assert [x for x, _ in model.predict(texts)] == langs
    assert [x for *_, x in model.spans(texts[3] + texts[150])] == ["l003", "l150"]


def test_models_without_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", None, 1, 2)], "doc_id long, text string, lang string, score int, spans int")
    model = langid.train(docs)
    assert model.langs == [] and [(r.lang_pred, r.score, r.spans) for r in langid.predict(docs, model).collect()] == [("und", 0.0, [])]
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        fitted = toxicity.train(docs, known)
        assert toxicity.score(docs, fitted).first().score < 0.01 and toxicity.with_score(docs, fitted).columns == [*docs.columns, "toxicity"]


def test_samples_have_bounds(spark):
    rows = [(i, "word " * 200, "ab"[i % 2]) for i in range(300)] * 3 + [(7, "other", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real, langid.fit = langid.fit, lambda texts, langs, penalty: seen.append((texts, langs)) or real(texts, langs, penalty)
    try:
        langid.train(docs, sample=20)
        langid.train(docs, sample=20, sample_bytes=4000)
    finally:
        langid.fit = real
    assert [len(t) for t, _ in seen] == [40, 4] and sorted(set(seen[0][1])) == ["a", "b"]


def test_noisy_or_is_brute_force():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    model = toxicity.NoisyOr({w.encode(): rng.uniform(-1, 3) for w in words[:20]}, -3.0)
    for _ in range(50):
        split = [[rng.choice(words) for _ in range(rng.randrange(0, 8))] for _ in range(rng.randrange(1, 9))]
        text, clean, own = ". ".join(" ".join(s) for s in split), 1.0, []
        text = text.replace("w", "w").translate({i: 0x61 + i - 48 for i in range(48, 58)})
        model = toxicity.NoisyOr({w.translate({i: 0x61 + i - 48 for i in range(48, 58)}).encode(): x for w, x in zip(words, [rng.uniform(-1, 3) for _ in range(20)], strict=False)}, -3.0)
        for s in text.split(". "):
            if s.split():
                p = 1 / (1 + np.exp(-(-3.0 + sum(model.weights.get(w.encode(), 0.0) for w in set(s.split())))))
                own.append(p)
                clean *= 1 - p
        score, worst, start, length, top = model.bag(text)
        assert score == pytest.approx(1 - clean if own else 0.0)
        if own:
            assert top == pytest.approx(max(own)) and text[start : start + length].strip() == text.split(". ")[worst].strip()


def test_very_long_texts(spark):
    long = "der das ist nicht und auf sch\u00f6n. " * 40_000
    df = spark.createDataFrame([(1, long), (2, "x" * 3_000_000)], DOCS)
    model = langid.fit(["der das ist nicht und auf sch\u00f6n", "the house of this that with"], ["de", "en"])
    assert langid.predict(df, model).filter("doc_id = 1").first().lang_pred == "de"
    tox = toxicity.fit(["such blorg", "fine day"] * 9, [1, 0] * 9)
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, tox).collect())
    assert licenses.scan(df.withColumn("text", F.concat("text", F.lit(" Released under the MIT License.")))).count() == 2
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert [r.error for r in warc.read_archives(warc.write_archives(pages)).collect()] == [None, None]


def test_ties_of_mixing(spark):
    rows = [(1, "a b c", "s")] * 6 + [(2, "d", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 7 and sum(r.taken for r in got) == 29 and sorted(map(len, (r.positions for r in got))) == sorted(map(len, (r.positions for r in mixing.mix(df.repartition(4)).collect())))


def test_exact_scores_and_enough_answers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) * np.pi
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, [1e-300] * 6), (401, [1e200] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(t, t.filter("vec_id % 20 = 0"), k=5).collect():
        got[r.query_id].append(r)
    assert len(got) == 21 and all(len(v) == 5 for v in got.values())
    for q, found in got.items():
        for r in found:
            score = 0.0
            for a, b in zip(rows[q][1], rows[r.vec_id][1], strict=True):
                score += a * b
            assert r.score == score
    few = ann.search(t, t.filter("vec_id % 20 = 0"), k=390, reach=0.01, trees=1, leaf=4)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {390}
    best = sorted(((float(x[0] @ x[i]), i) for i in range(1, 400)), reverse=True)[:3]
    assert best[0][1] in {r.vec_id for r in few.filter("query_id = 0 AND rank <= 3").collect()}


@pytest.mark.parametrize("rows", [3_000, 30_000])
def test_search_recall_by_size(spark, rows):
    rng = np.random.default_rng(rows)
    centres = rng.normal(size=(rows // 50, 24))
    x = (centres[rng.integers(0, len(centres), rows)] + 0.6 * rng.normal(size=(rows, 24))).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    asked = list(range(0, rows, rows // 100))
    found = defaultdict(set)
    for r in ann.search(t, t.filter(F.col("vec_id").isin(asked))).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in asked:
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(found[q] & {*np.argsort(-s)[:20].tolist()})
    assert hits >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    df = queries.queries()[name](spark, TABLES)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and want
