"""The corpus operators as queries over the driver's tables, and their SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import ann, gif, langid, licenses, mixing, ngram_join, packing, substring, toxicity, warc
from tokenloom.llm._common import fold_column, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "chunks", "kept_doc_id", "kept_doc_ids")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(table(spark, sf_dir, "documents"))


def op4_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, keep=lambda key: fold_column(key, 3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold_column(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "worst_start", "worst_length", "worst_score")


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, keep=lambda key: fold_column(key, 5) != 0)
    return langid.predict(docs, model).select("doc_id", (fold_column(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "spans")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_position(mixing.mix(table(spark, sf_dir, "documents"))).drop("key")


def op7_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.with_responses(table(spark, sf_dir, "pages"))
    records = warc.read_archives(warc.write_archives(pages, refers_to="response_id"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_ngram_jaccard, op3_media_gif, op4_toxicity_noisy_or, op5_language_spans, op6_mix_sources, op7_forest_search, op8_license_windows, op9_pack_sequences, op10_warc_zstd)}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All pairs of documents that share a shingle, and what can be reached by those that link.
_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 3 THEN list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i + 2], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT w.doc_id, count(s.x) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * p.k >= 90 * (na.n + nb.n - p.k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON n.doc_id = r.a GROUP BY n.doc_id, n.n"""


def _license_sql() -> str:
    """Every window of every document against every template."""
    rows = []
    for name, text in licenses.TEMPLATES.items():
        w = licenses.words(text)
        own = {" ".join(w[i : i + licenses.SIZE]) for i in range(len(w) - licenses.SIZE + 1)}
        rows += [f"('{name}', {len(own)}, {licenses.window(len(w))[0]}, {licenses.window(len(w))[1]}, '{x}')" for x in sorted(own)]
    return rf"""WITH own(license, n, wide, step, x) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[a-z0-9]+') AS a FROM documents),
s AS (SELECT doc_id, i - 1 AS p, array_to_string(a[i:i + 4], ' ') AS x FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM w)),
m AS (SELECT doc_id, license, n, x, unnest(range(CAST(greatest(0, ceil((p - wide + 5) / step)) AS BIGINT) * step, p + 1, step)) AS place FROM s JOIN own USING (x)),
c AS (SELECT doc_id, license, place, count(DISTINCT x) / n AS containment FROM m GROUP BY doc_id, license, n, place)
SELECT doc_id, license, max(containment) AS containment, count(*) AS windows, CAST(min(place) AS INTEGER) AS first_word FROM c WHERE containment >= {licenses.LEAST} GROUP BY doc_id, license"""


#: Equal payloads by their text; 40 hexadecimal digits of SHA-1 are 8 groups of 20 bits, four base32 letters each.
_ARCHIVES = """SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
array_to_string(flatten(list_transform(range(0, 8), lambda g: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)))), '') AS payload_digest,
CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": _JACCARD, "op8_license_windows": _license_sql(), "op10_warc_zstd": _ARCHIVES}
