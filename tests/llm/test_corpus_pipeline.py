"""The five stages in a row, against what each has to do, and on awkward tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import ngram_join

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(300)}" for _ in range(n))


def made(spark, path, docs, labels=(), more=()):
    df = spark.createDataFrame(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))
    df.withColumns(dict(more)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = ngram_join.materialise(stage(spark, docs, sf_dir), "test")
        out.append((name, docs))
    return dict(out)


def test_each_stage_does_its_part(spark, tmp_path):
    shared = prose(77, 60)
    docs = [(i, prose(i, 40) + (". you blorg." if i % 5 == 0 else "."), "en", "ab"[i % 2], 0) for i in range(60)]
    docs += [(100, docs[1][1], "en", "a", 0), (101, docs[1][1].replace(" ", "  "), "en", "a", 0), (102, docs[2][1] + " more", "en", "b", 0)]
    docs += [(110, prose(200, 30) + " " + shared, "en", "a", 0), (111, prose(201, 30) + " " + shared + " " + prose(202, 30), "en", "b", 0)]
    docs += [(120, None, None, None, 0), (121, "", "en", "b", 0), (None, "no id at all", "en", "b", 0), (122, "four words are few", "en", "a", 0)]
    docs += [(130, prose(300, 40), "en", "a", 0)] * 3
    sf_dir = made(spark, tmp_path, docs, [(i, 1, int(i % 5 == 0)) for i in range(60)], [("_toxicity", F.lit(1)), ("_before", F.lit("b")), ("_id", F.lit(7)), ("doc", F.lit("x")), ("a", F.lit(2))])
    found = stages(spark, sf_dir)
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(df.columns == names for df in list(found.values())[:-1])
    kept = {name: df.collect() for name, df in found.items()}
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in kept.items()}
    want = Counter(i for i, *_ in docs if i is None or i >= 60 or i % 5)
    assert ids["toxicity"] == want
    for gone in (100, 101, 102):
        del want[gone]
    want[130] = 1
    assert ids["ngram jaccard"] == want
    cut = {r.doc_id: r for r in kept["substring dedup"]}
    before = {r.doc_id: r for r in kept["ngram jaccard"]}
    assert ids["substring dedup"] == want and cut[110].text == before[110].text and cut[120].text is None and cut[121].text == ""
    assert len(before[111].text) - len(cut[111].text) > 0.7 * len(shared) and cut[111].n_chars == len(cut[111].text)
    assert all(cut[i].text == before[i].text for i in cut if i not in (111,)) and all(r._before == "b" and r._id == 7 for r in cut.values())
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(kept["mix sources"]) - 1.5 * words(kept["substring dedup"])) < 200 and max(ids["mix sources"].values()) == 2
    assert ids["mix sources"][120] == ids["mix sources"][121] == 1
    pieces = kept["pack sequences"]
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == ids["mix sources"]
    fill = defaultdict(int)
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    again = corpus_pipeline.run(spark, sf_dir)
    key = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(again.collect()) == key(pieces)


@pytest.mark.parametrize("docs", [[], [(None, None, None, None, None)] * 3, [(1, "", None, None, 0), (1, "x" * 200_000, "en", "a", 0)]])
def test_awkward_tables(spark, tmp_path, docs):
    sf_dir = made(spark, tmp_path, docs)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {d[0] for d in docs} and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
