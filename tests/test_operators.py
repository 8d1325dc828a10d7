"""Literal cases: an input, a description, what comes out."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import bytemap, strings
from tokenloom.operators import chat, decoders, models, normalizers, postprocessors, pretokenizers, splits
from tokenloom.operators.templates import Template
from tokenloom.sources import config, folder, manifest


def apply(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in rows.select("i", make(F.col("t"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "description,text,want",
    [
        ({"type": "Lowercase"}, "Café Ünal", "café ünal"),
        ({"type": "NFD"}, "\u00e9", "e\u0301"),
        ({"type": "NFC"}, "e\u0301", "\u00e9"),
        ({"type": "NFKD"}, "\ufb01\u00e9", "fie\u0301"),
        ({"type": "NFKC"}, "ﬁ™", "fiTM"),
        ({"type": "StripAccents"}, "é™", "éTM"),
        ({"type": "Precompiled"}, "q～℡\x1fw", "q～TEL\x1fw"),
        ({"type": "Precompiled", "stripControls": True}, "℡\x1fw", "TELw"),
        ({"type": "Strip"}, "  a b　\n", "a b"),
        ({"type": "Strip", "stripLeft": False}, " a ", " a"),
        ({"type": "Prepend", "prepend": "▁"}, "", "▁"),
        ({"type": "Replace", "pattern": {"Regex": "[ab]"}, "content": "$1\\"}, "xaby", "x$1\\$1\\y"),
        ({"type": "Replace", "pattern": {"String": "a.b"}, "content": ""}, "a.bxaxb", "xaxb"),
        ({"type": "Replace", "pattern": {"String": "a"}}, "aa", "aa"),
        ({"type": "BertNormalizer"}, "Á\t中b\x00", "a  中 b\x00"),
        ({"type": "BertNormalizer", "lowercase": False}, "Á", "Á"),
        ({"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}]}, "\u00c9", "e\u0301"),
    ],
)
def test_normalizers(spark, description, text, want):
    assert apply(spark, [text, None], normalizers.build(description)) == [want, None]


def test_unknown_types_are_errors():
    for build in (normalizers.build, pretokenizers.build, postprocessors.build, decoders.build):
        assert build(None) is None and build({}) is None
        with pytest.raises(config.TokenizerError):
            build({"type": "Nothing"})


@pytest.mark.parametrize(
    "description,text,want",
    [
        ({"type": "BertPreTokenizer"}, "Hey, you. (ok)", ["Hey", ",", "you", ".", "(", "ok", ")"]),
        ({"type": "Whitespace"}, "Hi, you there", ["Hi,", "you", "there"]),
        ({"type": "Punctuation"}, "Hey, (you)!? ", ["Hey", ",", " ", "(", "you", ")!?", " "]),
        ({"type": "Digits"}, "ab12c3", ["ab", "12", "c", "3"]),
        ({"type": "Digits", "individualDigits": True}, "ab12c", ["ab", "1", "2", "c"]),
        ({"type": "Split", "pattern": {"String": " "}}, "a b c", ["a", " ", "b", " ", "c"]),
        ({"type": "Split", "pattern": {"String": " "}, "invert": True}, "a b c", ["a", "b", "c"]),
        ({"type": "Split", "pattern": {"Regex": r"\s"}, "invert": True}, "a b", ["a", " ", "b"]),
        ({"type": "Metaspace", "replacement": "▁", "addPrefixSpace": True}, "Hey my  friend", ["▁Hey", "▁my", "▁", "▁friend"]),
        ({"type": "Metaspace", "replacement": "▁"}, "Hey my", ["Hey", "▁my"]),
        ({"type": "ByteLevel"}, "Hey friend!  é", ["Hey", "Ġfriend", "!", "Ġ", "ĠÃ©"]),
        ({"type": "ByteLevel", "addPrefixSpace": True}, "Hey!", ["ĠHey", "Ġ!"]),
        ({"type": "ByteLevel", "useRegex": False}, "a b", ["aĠb"]),
        ({"type": "ByteLevel"}, "", [""]),
        ({"type": "BertPreTokenizer"}, "", []),
        ({"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits"}]}, "a1 b", ["a", "1", "b"]),
    ],
)
def test_pretokenizers(spark, description, text, want):
    step = pretokenizers.build(description)
    assert apply(spark, [text], lambda c: step(c, F.lit(True))) == [want]


@pytest.mark.parametrize(
    "text,behavior,want",
    [
        ("one-red--kite--", "mergedWithPrevious", ["one-", "red-", "-", "kite-", "-"]),
        ("--one-red", "mergedWithPrevious", ["-", "-", "one-", "red"]),
        ("--one-red--kite-", "mergedWithNext", ["-", "-one", "-red", "-", "-kite", "-"]),
        ("one-red--kite", "isolated", ["one", "-", "red", "-", "-", "kite"]),
        ("one-red--kite", "removed", ["one", "red", "kite"]),
    ],
)
def test_delimiters(spark, text, behavior, want):
    assert apply(spark, [text], lambda c: splits.by_delimiter(c, "-", behavior)) == [want]


def test_added_tokens(spark):
    tokens = [{"content": "[[stop]]", "id": 1, "rstrip": True}, {"content": "[[x]]", "id": 2, "rstrip": True}]
    texts = ["[[x]][[stop]] it", "[[stop]]", "a [[stop]] \n b", "plain", ""]
    want = [["[[x]]", "[[stop]]", "it"], ["[[stop]]"], ["a ", "[[stop]]", "b"], ["plain"], [""]]
    assert apply(spark, texts, lambda c: splits.sections(c, tokens)) == want


def test_postprocessors(spark):
    rows = spark.createDataFrame([(["  a ", " b"], ["c"], [])], "a array<string>, b array<string>, e array<string>")
    roberta = postprocessors.build({"type": "RobertaProcessing", "sep": ["s", 1], "cls": [2, "k"]})
    bert = postprocessors.build({"type": "BertProcessing", "sep": ["s", 1], "cls": ["k", 2]})
    bare = postprocessors.build({"type": "RobertaProcessing", "sep": ["s", 1], "cls": ["k", 2], "addPrefixSpace": False})
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    got = rows.select(roberta(a, None, False).alias("1"), roberta(a, b, True).alias("2"), bert(a, b, True).alias("3"), bert(a, e, True).alias("4"), bare(a, e, True).alias("5"), bert(a, b, False).alias("6")).first()
    assert list(got) == [["k", " a ", " b", "s"], ["k", " a ", " b", "s", "s", "c", "s"], ["k", "  a ", " b", "s", "c", "s"], ["k", "  a ", " b", "s"], ["k", "a", "b", "s"], ["  a ", " b", "c"]]
    with pytest.raises(config.TokenizerError):
        postprocessors.from_special_tokens({"add_bos_token": True}, None)
    assert postprocessors.from_special_tokens({}, {"type": "TemplateProcessing"}) is None


@pytest.mark.parametrize(
    "description,tokens,want",
    [
        ({"type": "WordPiece", "prefix": "##", "cleanup": True}, ["##a", "##b", "c", "."], ["##a", "b", " c", "."]),
        ({"type": "ByteFallback"}, ["<0xE5>", "<0x8F>", "<0xAB>", "a", "<0x41>"], ["叫", "a"]),
        ({"type": "ByteFallback", "flushTail": True}, ["a", "<0x41>"], ["a", "A"]),
        ({"type": "Fuse"}, ["a", "b"], ["ab"]),
        ({"type": "Strip", "content": "x", "start": 1, "stop": 1}, ["  a ", "xbx"], [" a", "xbx"]),
        ({"type": "Metaspace", "addPrefixSpace": True, "replacement": "▁"}, ["▁Hey", "▁friend"], ["Hey", " friend"]),
        ({"type": "ByteLevel"}, ["Ġa", "Ã", "©"], [" aé"]),
        ({"type": "Metaspace", "addPrefixSpace": True}, [], []),
    ],
)
def test_decoders(spark, description, tokens, want):
    rows = spark.createDataFrame([(tokens,)], "a array<string>")
    assert rows.select(decoders.build(description)(F.col("a"))).first()[0] == want


def test_byte_level_decoder_keeps_added_tokens(spark):
    rows = spark.createDataFrame([(["Ġa", "<s>", "Ã", "©"],)], "a array<string>")
    assert rows.select(decoders.build({"type": "ByteLevel"}, ["<s>"])(F.col("a"))).first()[0] == [" a", "<s>", "é"]


def test_byte_alphabet(spark):
    assert len(set(bytemap.ALPHABET)) == 256
    text = "".join(map(chr, range(1, 600))) + "😀"
    assert apply(spark, [text], lambda c: bytemap.from_alphabet(bytemap.to_alphabet(c))) == [text]


def test_word_piece():
    piece = models.WordPiece({t: i for i, t in enumerate(["[UNK]", "un", "##aff", "##able", "a"])})
    assert piece("unaffable") == ["un", "##aff", "##able"] and piece("unx") == ["[UNK]"] and piece("") == [] and piece("a" * 101) == ["[UNK]"]


def test_byte_pairs():
    vocab = {t: i for i, t in enumerate(["<unk>", "a", "b", "c", "ab", "abc"])}
    pairs = models.BytePairs(vocab, ["a b", ["ab", "c"]], "<unk>")
    assert pairs("abcab") == ["abc", "ab"] and pairs("é") == ["<0xC3>", "<0xA9>"] and pairs("pé{") == ["<0xC3>", "<0xA9>"]
    assert models.BytePairs({"a": 0}, [])("ab") == ["a", "<0x62>"]
    overlapping = models.BytePairs({"aa": 0, "a": 1}, ["a a"])
    assert overlapping("aaa") == ["aa", "a"]


def test_unigram():
    vocab = [["<unk>", 0.0], ["a", -1.0], ["b", -1.0], ["ab", -2.0], ["abc", -9.0]]
    cut = models.Unigram(vocab)
    assert cut("ab") == ["ab"], "of equal paths the longer last piece"
    assert cut("abx") == ["ab", "x"] and cut("") == []


def test_basic_words():
    assert models.basic_words("Héllo, [MASK] wOrld!") == ["hello", ",", "[MASK]", "world", "!"]


def test_fused_unknowns(spark):
    rows = spark.createDataFrame([(["u", "u", "a", "u"],)], "a array<string>")
    assert rows.select(models.fuse_column(F.col("a"), "u")).first()[0] == ["u", "a", "u"]
    assert models.fuse(["u", "u", "a"], lambda t: t == "a") == ["u", "a"]


def test_prefix_search(spark):
    vocab = spark.createDataFrame([("sea",), ("seal",), ("sun",)], "token string")
    got = models.prefixes(spark.createDataFrame([("sealing",), ("",)], "word string"), vocab).collect()
    assert sorted(r.piece for r in got) == ["sea", "seal"]


def test_ids(spark):
    vocab = models.vocabulary(spark, {"a": 0, "b": 1}, {"b": 7})
    got = models.to_ids(spark.createDataFrame([("a",), ("b",), ("z",)], "token string"), vocab, 9).collect()
    assert sorted((r.token, r.id) for r in got) == [("a", 0), ("b", 7), ("z", 9)]
    with pytest.raises(Exception, match="no id"):
        models.to_ids(spark.createDataFrame([("z",)], "token string"), vocab, None, strict=True).collect()


def test_templates():
    source = "{%- for m in messages if m.role != 'x' -%}\n{% if loop.first and not m['role'] == 'system' %}<{{ m['role'] | upper }}>{% elif loop.last %}[{% else %}({% endif %}{{ m.content | trim }}{{ ',' if not loop.last }}{% endfor %}{% set n = messages | length %}{{ n + 1 }}{{ missing }}{{ ['a', 1] | tojson }}"
    got = Template(source).render(messages=[{"role": "user", "content": " a "}, {"role": "x", "content": "-"}, {"role": "b", "content": "c"}])
    assert got == '<USER>a,[c4["a", 1]'
    with pytest.raises(config.TokenizerError, match="boom"):
        Template("{{ raise_exception('boom') }}").render()
    with pytest.raises(config.TokenizerError):
        Template("{% macro x() %}")
    ns = "{% set ns = namespace(x=0) %}{% for i in range(3) %}{% set ns.x = ns.x + i %}{% endfor %}{{ ns.x }}"
    assert Template(ns).render() == "3"


def test_template_selection():
    named = {"chat_template": [{"name": "default", "template": "d"}, {"name": "tool_use", "template": "t"}]}
    assert chat.select_template(named) == "d" and chat.select_template(named, tools=[{}]) == "t"
    assert chat.select_template({"chat_template": "x"}, name="other") == "x" and chat.select_template({}, "lit") == "lit"
    for settings, name in ((named, "no"), ({}, None)):
        with pytest.raises(config.TokenizerError):
            chat.select_template(settings, name=name)


def test_names(spark):
    assert strings.snake("addedTokens") == "added_tokens" and config.get({"added_tokens": 1}, "addedTokens") == 1
    assert apply(spark, ["addedTokens", "vocab"], strings.uncamel) == ["added_tokens", "vocab"]
    assert apply(spark, ["bERT"], strings.capitalize) == ["Bert"]
    assert apply(spark, ["a/b.json", "axjson"], lambda c: strings.matches_glob(c, ["*.json"])) == [True, False]
    assert apply(spark, ['W/"ab"', '"c"'], strings.etag) == ["ab", "c"]


def test_folder(tmp_path):
    (tmp_path / "config.json").write_text('{"model_type": "gpt2"}')
    with pytest.raises(config.TokenizerError):
        folder.load(str(tmp_path))
    (tmp_path / "tokenizer.json").write_text('{"model": {"x": "a\\\\nb"}}')
    found = folder.load(str(tmp_path))
    assert found.data == {"model": {"x": "a\nb"}} and found.resolved()["tokenizer_class"] == "GPT2Tokenizer"
    (tmp_path / "tokenizer_config.json").write_text('{"bos_token": "x"}')
    assert folder.load(str(tmp_path)).resolved()["bos_token"] == "x"
    with pytest.raises(config.TokenizerError):
        config.parse("[1]")


def test_local_files(spark, tmp_path):
    (tmp_path / "repo" / "sub").mkdir(parents=True)
    (tmp_path / "repo" / "a.json").write_text("x")
    (tmp_path / "repo" / "sub" / "b.bin").write_bytes(b"yz")
    got = {r.path: (r.size, r.sha256[:6]) for r in manifest.local_files(spark, str(tmp_path / "repo")).collect()}
    assert got == {"a.json": (1, "2d7116"), "sub/b.bin": (2, got["sub/b.bin"][1])}
    assert [r.path for r in manifest.local_files(spark, str(tmp_path / "repo"), "*.json").collect()] == ["a.json"]


def test_strict_ids(spark):
    rows = spark.createDataFrame([([1] * 3,)], "ids array<int>")
    assert rows.select(models.strict_ids(F.col("ids"), 3)).first()[0] == [1, 1, 1]
    with pytest.raises(Exception, match="tooLong"):
        rows.select(models.strict_ids(F.col("ids"), 2)).collect()


def test_sync_of_missing_values(spark):
    remote = spark.createDataFrame([("a", None, None), ("b", "f" * 40, "e"), ("c", "f" * 40, "0" * 64), ("d", "main", "e")], "path string, commit string, etag string")
    local = spark.createDataFrame([("b", "f" * 40, "x", "y"), ("c", None, None, "0" * 64), ("d", "main", "e", "z")], "path string, local_commit string, local_etag string, sha256 string")
    assert {r.path: r.action for r in manifest.sync(remote, local).collect()} == {"a": "fetch", "b": "keep", "c": "refresh", "d": "refresh"}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{% for m in messages %}{{ loop.previtem.role if loop.previtem is defined else '-' }}>{{ m.role }} {% else %}none{% endfor %}", "->user user>system system>user "),
        ("{% for m in [] %}x{% else %}none{% endfor %}", "none"),
        ("{{ messages | selectattr('role', 'equalto', 'user') | map(attribute='content') | join('+') }}", "one+three"),
        ("{{ messages | rejectattr('role', 'eq', 'user') | list | length }}", "1"),
        ("{{ '{{ }} %}' }}|{% if '%}' in '{%}' %}yes{% endif %}", "{{ }} %}|yes"),
        ("{% macro say(who, what='hi', end='.') %}{{ who }}:{{ what }}{{ end }}{% endmacro %}{{ say('a') }}{{ say('b', end='!', what='ho') }}", "a:hi.b:ho!"),
        ("{{ messages[::-1][0].content }}{{ messages[1:] | length }}", "three2"),
        ("{% set x %}a{{ 1 + 1 }}{% endset %}[{{ x }}]", "[a2]"),
        ("{% for i in range(9) %}{% if i == 1 %}{% continue %}{% endif %}{% if i is divisibleby(4) and i > 0 %}{% break %}{% endif %}{{ i }}{% endfor %}", "023"),
        ("{{ ['b', 'a', 'b'] | unique | sort | join }}{{ 'x\ny' | indent(2) }}{{ {'k': 1}.get('k') }}{% for k, v in {'q': 2}.items() %}{{ k }}{{ v }}{% endfor %}", "abx\n  y1q2"),
        ("{% generation %}{{ ['A', 'b'] | map('lower') | join(',') }}{% endgeneration %}{{ loop is undefined }}", "a,bTrue"),
    ],
)
def test_more_of_templates(source, want):
    from tokenloom.operators.templates import Template

    messages = [{"role": "user", "content": "one"}, {"role": "system", "content": "two"}, {"role": "user", "content": "three"}]
    assert Template(source).render(messages=messages) == want
