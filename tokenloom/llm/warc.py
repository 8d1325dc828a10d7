"""WARC records in Zstandard archives: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import free_name, materialise

#: Magic number of the skippable frame that holds a dictionary, and of a dictionary itself.
DICTIONARY_FRAME, DICTIONARY = 0x184D2A5D, 0xEC30A437
#: Pages from which the dictionary of an archive is trained at most, its bytes, and an archive's uncompressed bytes (about).
SAMPLE, DICTIONARY_BYTES, ARCHIVE_BYTES = 256, 16 << 10, 8 << 20
#: A record larger than this is refused; no value of a Spark column makes one so large.
MOST = 1 << 32
#: A block of a Zstandard frame holds so many bytes at most.
BLOCK = 128 << 10
#: Groups of equal payloads that are broadcast at most; beyond it the pages are shuffled.
BROADCAST_GROUPS = 500_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
#: Fixed value: how a page without id is named.
NO_PAGE = "<urn:page:none>"


class WarcError(ValueError):
    """The archive or a record in it is malformed."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return NO_PAGE if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit that keeps the HTTP header (with the payload's length) and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or no bytes where the samples are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes]) -> bytes:
    step = max(1, len(records) // SAMPLE)
    trained = dictionary([r[: 32 << 10] for r in records[::step][:SAMPLE]])
    maker = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained + b"".join([maker.compress(r) for r in records])


def frame_size(data: bytes | memoryview, at: int) -> tuple[int, int]:
    """Compressed bytes of the Zstandard frame that begins at ``at``, and how many bytes it can hold at most, from its block headers."""
    try:
        head = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
        size = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame header: {e}") from None
    last, most = False, 0
    while not last:
        if size + 3 > len(data):
            raise WarcError("the archive ends within a frame")
        block = int.from_bytes(data[size : size + 3], "little")
        last, kind, length = block & 1, block >> 1 & 3, block >> 3
        size += 3 + (1 if kind == 1 else length)
        most += length if kind < 2 else BLOCK
    size += 4 * head.has_checksum
    if size > len(data):
        raise WarcError("the archive ends within a frame")
    return size - at, most


def _decoded(reader: zstandard.ZstdDecompressor, frame: bytes, most: int) -> bytes:
    """A frame's content, of which no more is held than its blocks can hold."""
    if most > MOST:
        with reader.stream_reader(io.BytesIO(frame)) as stream:
            out = stream.read(MOST + 1)
        if len(out) > MOST:
            raise WarcError("a record is too large")
        return out
    size = zstandard.frame_content_size(frame)
    if size > most:
        raise WarcError("a frame's size isn't that of its blocks")
    return b"" if size == 0 else reader.decompress(frame, max_output_size=most)


def read_frames(data: bytes) -> Iterator[bytes]:
    """Each record's bytes.  The dictionary may itself be a Zstandard frame, as the format allows; other skippable frames are passed over.

    Frames are told apart by their block headers, so each byte is read once.
    """
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            raise WarcError("the archive ends within its dictionary")
        body, at = data[8 : 8 + size], 8 + size
        try:
            if body[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
                body = _decoded(zstandard.ZstdDecompressor(), body, frame_size(body, 0)[1])
            if body:
                if body[:4] != struct.pack("<I", DICTIONARY):
                    raise WarcError("the leading frame holds no dictionary")
                known = zstandard.ZstdCompressionDict(body)
        except zstandard.ZstdError as e:
            raise WarcError(f"the dictionary can't be decoded: {e}") from None
    reader = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(data)
    while at < len(data):
        if len(data) < at + 8:
            raise WarcError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        size, most = frame_size(view, at)
        try:
            out = _decoded(reader, data[at : at + size], most)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from None
        at += size
        yield out


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a header line without a colon: {line[:40]}")
        out[name.strip().lower()] = value.strip()
    return first, out


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") and urn != NO_PAGE else None


def parse(raw: bytes) -> tuple:
    """A row of RECORDS from one record; raises WarcError where a header, a length or a digest doesn't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, h = _headers(head)
    if not gap or not version.startswith("WARC/1."):
        raise WarcError("no WARC header")
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in h]:
        raise WarcError(f"no {missing[0]}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length isn't Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("the block's digest doesn't hold")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, inner = _headers(http)
    if not gap or not status.startswith("HTTP/") or not inner.get("content-length", "").isdigit():
        raise WarcError("no HTTP header")
    said, kind = h.get("warc-payload-digest", "").removeprefix("sha1:"), h["warc-type"]
    size = int(inner["content-length"])
    if kind == "response" and (size != len(payload) or said != digest(payload)):
        raise WarcError("the payload's length or digest doesn't hold")
    if kind == "revisit" and (payload or h.get("warc-profile") != REVISIT or "warc-refers-to" not in h):
        raise WarcError("a revisit without profile or reference")
    return _page(h["warc-record-id"]), kind, h.get("warc-target-uri"), said, size, _page(h.get("warc-refers-to")), payload if kind == "response" else None, None


# ---- DataFrames ----------------------------------------------------------------------------------------------------


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([write_archive(held)], pa.binary())], names=["records", "archive"])
    for batch in batches:
        for key, url, html, target in zip(*batch.columns, strict=True):
            one = record(key.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), target.as_py())
            held.append(one)
            size += len(one)
            if size >= ARCHIVE_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def write_archives(pages: DataFrame, refers_to: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """records, archive: archives of about 8 MB of records each.  ``refers_to`` names the column whose page a revisit cites.

    A null html is an empty payload, a null url leaves its header out, a null id is read back as null.
    """
    target = F.col(refers_to).cast("long") if refers_to else F.lit(None).cast("long")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), target.alias("target")).mapInArrow(_archived, "records int, archive binary")


def _parsed(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(RECORDS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS, strict=True)], schema=RECORDS)

    for batch in batches:
        for archive in batch.column(0):
            rows: list[tuple] = []
            try:
                for raw in read_frames(archive.as_py() or b""):
                    try:
                        row = parse(raw)
                    except WarcError as e:
                        row = (None,) * (len(RECORDS) - 1) + (str(e),)
                    rows.append(row if payloads else (*row[:6], None, row[7]))
            except WarcError as e:
                rows.append((None,) * (len(RECORDS) - 1) + (str(e),))
            yield out(rows)


def read_archives(archives: DataFrame, archive_col: str = "archive", payloads: bool = True) -> DataFrame:
    """One row per record, validated; a malformed record gives a row with ``error`` set and the next ones still follow.

    A frame that can't be decoded ends its archive with such a row.  Null or empty archives hold no record.
    """
    return archives.select(archive_col).mapInArrow(functools.partial(_parsed, payloads), "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary, error string")


def with_responses(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Adds ``response_id``: the largest id with an equal payload, where that isn't the row's own and the payload has ``least_bytes``.

    Digests, ids and lengths are summed up to a row for each payload that occurs twice.  Up to BROADCAST_GROUPS of these are sent
    to the pages; beyond, pages are shuffled by digest, where large groups of equal payloads can be split.  Null html is empty;
    rows with null ids refer to the largest id, if any has one; of rows with the largest id none refers to another.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    sha, best_id = free_name(pages, "_sha"), free_name(pages, "_best")
    digests = pages.select(F.unhex(F.sha1(payload.cast("binary"))).alias(sha), F.octet_length(payload).alias("bytes"), F.col(id_col).alias("id")).filter(F.col("bytes") >= least_bytes)
    best = digests.groupBy(sha).agg(F.max("id").alias(best_id), F.count("*").alias("n")).filter(f"n > 1 AND {best_id} IS NOT NULL").drop("n")
    best = materialise(best, "payloads")
    keyed = pages.withColumn(sha, F.unhex(F.sha1(payload.cast("binary"))))
    joined = keyed.join(F.broadcast(best) if best.count() <= BROADCAST_GROUPS else best, sha, "left")
    return joined.withColumn("response_id", F.when(~F.col(best_id).eqNullSafe(F.col(id_col)), F.col(best_id))).drop(sha, best_id)
