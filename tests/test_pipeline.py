"""Whole descriptions, streams, plans, and the queries against their SQL."""

import duckdb
import pytest
from conftest import TABLES
from pyspark.sql import functions as F

from tokenloom.functions import bytemap
from tokenloom.plans import queries
from tokenloom.plans.tokenizer import Tokenizer
from tokenloom.sources.config import TokenizerError
from tokenloom.streaming import encode

BYTES = {"pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"}, "model": {"vocab": {c: i for i, c in enumerate(bytemap.ALPHABET)}, "merges": []}}
ADDED = {**BYTES, "added_tokens": [{"id": 300, "content": "<s>", "special": True}]}


def test_added_tokens_round_trip(spark):
    t = Tokenizer({"tokenizer_class": "GPT2Tokenizer"}, ADDED)
    df = spark.createDataFrame([(1, "a<s>b é", "x"), (2, None, "y"), (3, "", "z"), (1, "a<s>b é", "x")], "k int, text string, other string")
    got = {(r.k, r.text): r for r in t.encode(df).select("k", "text", "ids", t.decode(F.col("ids")).alias("back"), t.decode(F.col("ids"), skip_special=True).alias("bare")).collect()}
    assert t.encode(df).count() == 4
    assert got[1, "a<s>b é"].ids[1] == 300 and got[1, "a<s>b é"].back == "a<s>b é" and got[1, "a<s>b é"].bare == "ab é"
    assert got[2, None].ids is None and got[3, ""].ids == []


def test_bert(spark):
    vocab = {x: i for i, x in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hel", "##lo", ",", "you"])}
    data = {"normalizer": {"type": "BertNormalizer"}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "post_processor": {"type": "BertProcessing", "sep": ["[SEP]", 3], "cls": ["[CLS]", 2]}, "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True}, "model": {"vocab": vocab}}
    t = Tokenizer({"tokenizer_class": "BertTokenizerFast"}, data)
    row = t.encode(spark.createDataFrame([("Héllo, you zzz",)], "text string")).select("ids", t.decode(F.col("ids")).alias("back")).first()
    assert row.ids == [2, 4, 5, 6, 7, 1, 3] and row.back == "[CLS] hello, you [UNK] [SEP]"


def test_unigram_and_chat(spark):
    data = {"pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "addPrefixSpace": True}, "decoder": {"type": "Metaspace", "replacement": "▁", "addPrefixSpace": True}, "model": {"unk_id": 0, "vocab": [["<unk>", 0], ["▁a", -1], ["b", -1], ["▁", -2]]}}
    t = Tokenizer({"tokenizer_class": "T5Tokenizer", "chat_template": "{% for m in messages %}{{ m.content }} {% endfor %}", "model_max_length": 1e30}, data)
    df = spark.createDataFrame([([{"role": "u", "content": "ab"}, {"role": "u", "content": "a"}],)], "messages array<struct<role:string,content:string>>")
    assert t.has_chat_template() and t.apply_chat_template(df, max_length=3, truncation=True).first().ids == [1, 2, 1]


def test_errors():
    for settings, data in ((None, {}), ({}, {}), ({"tokenizer_class": "X"}, BYTES), ({"tokenizer_class": "T5Tokenizer"}, BYTES), ({"tokenizer_class": "GPT2Tokenizer"}, {})):
        with pytest.raises(TokenizerError):
            Tokenizer(settings, data)


def test_table_function(spark):
    t = Tokenizer({"tokenizer_class": "GPT2Tokenizer"}, BYTES)
    t.register(spark, "cut")
    texts = spark.createDataFrame([(1, "the cat's"), (2, ""), (3, None)], "k int, text string")
    texts.withColumn("words", t.words(F.col("text"))).createOrReplaceTempView("texts")
    want = {r.k: r.tokens or [] for r in t.tokenize(texts).collect()}
    got = spark.sql("SELECT k, t.* FROM texts, LATERAL cut(words) t ORDER BY k, pos").collect()
    assert {k: [r.token for r in got if r.k == k] for k in want} == want and len(want[1]) > 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("ab", "2020-01-01 00:00:01"), ("c", "2020-01-01 00:11:00")], "text string, at string").select("text", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in"))
    t = Tokenizer({"tokenizer_class": "GPT2Tokenizer"}, BYTES)
    query = encode.token_counts(stream, t, "at").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.tokens for r in spark.table("counts").collect()) == [1, 2]
    added = Tokenizer({"tokenizer_class": "GPT2Tokenizer"}, ADDED)
    assert encode.encode_stream(stream, added).isStreaming


def test_native_plans_have_no_python(spark):
    for name in ("p_bytelevel", "p_bert", "o_roberta", "d_bytefallback", "c_chatml", "m_token_to_id", "s_sync_decision", "e_tokens_by_lang"):
        plan = queries.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got = queries.queries()[name](spark, TABLES)
    want = sql.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["a_added_isolate", "a_added_strip", "d_replace", "e_tokens_by_lang", "p_metaspace_first", "p_metaspace_never"])
def test_same_as_sql_on_empty_texts(spark, tmp_path, name):
    texts = [("", "en"), (None, "en"), (" ", "en"), ("the  end", "de"), ("", "de"), ("other and the", "fr"), ("", None)]
    spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_skip_special_takes_whole_texts(spark, tmp_path):
    texts = {1: "aB c-" * 300, 2: "X" * 500 + "tail é end", 3: "", 4: "12 !?", 5: "ab", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.out for r in queries.queries()["d_skip_special"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else "".join(c for c in t if "a" <= c <= "z") for k, t in texts.items()}
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.out for r in queries.queries()["d_skip_special"](spark, TABLES).collect()}
    assert len(got) == len(rows) and all(got[r.doc_id] == (None if r.text is None else "".join(c for c in r.text if "a" <= c <= "z")) for r in rows)


def test_texts_that_hold_the_mark(spark):
    from tokenloom.operators import pretokenizers, splits

    text = "a\x01b the c\x01\x01 the"
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(splits.sections(F.col("text"), [{"content": "the", "id": 1}]).alias("s"), pretokenizers.split({"Regex": "[bc]"})(F.col("text"), F.lit(True)).alias("r")).first()
    assert found.s == ["a\x01b ", "the", " c\x01\x01 ", "the"] and found.r == ["a\x01", "b", " the ", "c", "\x01\x01 the"]
    same = text.replace("\x01", "x")
    other = spark.createDataFrame([(same,)], "text string").select(splits.sections(F.col("text"), [{"content": "the", "id": 1, "lstrip": True}]).alias("s")).first()
    marked = df.select(splits.sections(F.col("text"), [{"content": "the", "id": 1, "lstrip": True}]).alias("s")).first()
    assert [x.replace("\x01", "x") for x in marked.s] == other.s


def test_words_that_normalize_to_an_added_token_are_cut(spark):
    data = {**ADDED, "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}}
    t = Tokenizer({"tokenizer_class": "GPT2Tokenizer"}, {**data, "pre_tokenizer": {"type": "WhitespaceSplit"}})
    df = spark.createDataFrame([("<S> <s> a",)], "text string")
    assert t.tokenize(df).first().tokens == ["<", "s", ">", "<s>", "a"]
    assert "Exchange" not in t.encode(df)._jdf.queryExecution().executedPlan().toString()


def test_special_tokens_have_ids():
    t = Tokenizer({"tokenizer_class": "GPT2Tokenizer", "bos_token": "<s>", "unk_token": {"content": "!"}}, ADDED)
    assert t.special_tokens() == {"bos": ("<s>", 300), "unk": ("!", 33)}


def test_long_names(spark):
    from tokenloom.functions import strings

    name = "_".join(["ab"] * 1500)
    assert spark.createDataFrame([(name,)], "n string").select(strings.camel(F.col("n"))).first()[0] == "ab" + "Ab" * 1499


def test_snapshots_do_what_is_decided(spark, tmp_path):
    from tokenloom.sources import manifest

    registry, target = tmp_path / "registry", tmp_path / "there"
    (registry / "sub").mkdir(parents=True)
    for name, text in (("a.json", "one"), ("b.json", "two"), ("sub/c.json", "three"), ("d.bin", "four")):
        (registry / name).write_text(text)
    run = lambda commit, *globs: {r.path: (r.action, r.done, r.fraction) for r in manifest.snapshot(spark, str(registry), str(target), commit, list(globs)).collect()}
    commit = "0" * 40
    assert run(commit, "*.json") == {"a.json": ("fetch", 1, 1 / 3), "b.json": ("fetch", 2, 2 / 3), "sub/c.json": ("fetch", 3, 1.0)}
    assert (target / "sub/c.json").read_text() == "three" and not (target / "d.bin").exists()
    assert {v[0] for v in run(commit).values()} == {"keep", "fetch"} and (target / "d.bin").read_text() == "four"
    (registry / "b.json").write_text("new")
    (target / manifest.KEPT / "a.json.txt").write_text("broken")
    (target / manifest.KEPT / ".a.json.txt.crc").unlink()
    got = {k: v[0] for k, v in run("1" * 40).items()}
    assert got == {"a.json": "refresh", "b.json": "fetch", "d.bin": "refresh", "sub/c.json": "refresh"}
    assert (target / "b.json").read_text() == "new" and (target / manifest.KEPT / "a.json.txt").read_text().startswith("1" * 40)
