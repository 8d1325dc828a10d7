"""The whole pipeline: a description is compiled once on the driver into functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.operators import chat, decoders, models, normalizers, postprocessors, pretokenizers, splits
from tokenloom.sources import folder
from tokenloom.sources.config import TokenizerError, as_token, get, merged

#: Stands before an added token among words, which then is no word that the model cuts.
ADDED = "\ufdd0"
#: The tokenizer classes (without "Fast") by kind of model.
BERT = ("BertTokenizer", "DistilbertTokenizer", "DistilBertTokenizer")
BPE = ("CodeGenTokenizer", "CodeLlamaTokenizer", "FalconTokenizer", "GemmaTokenizer", "GPT2Tokenizer", "Gpt2Tokenizer", "LlamaTokenizer", "WhisperTokenizer", "CohereTokenizer", "Qwen2Tokenizer", "PreTrainedTokenizer")
UNIGRAM = ("T5Tokenizer",)


class Tokenizer:
    """Encodes and decodes columns of text as a description says.

    Texts stay whole.  Sections and words are made by the JVM's regular expressions; only the model, and normalizers that need
    Unicode's normal forms, run in Arrow batches.
    """

    def __init__(self, settings: dict | None, data: dict):
        if settings is None:
            raise TokenizerError("tokenizerConfigNotFound", "no tokenizer settings")
        name = get(settings, "tokenizerClass")
        if name is None:
            raise TokenizerError("missingTokenizerClassInConfig", "no tokenizer class")
        self.kind = name.removesuffix("Fast")
        if self.kind == "LlamaTokenizer":
            data = llama(settings, data)
        self.settings, self.data = settings, data
        self.added = [t for t in get(data, "addedTokens", [])]
        self.added_ids = {t["content"]: t["id"] for t in self.added}
        self.special_ids = sorted({t["id"] for t in self.added if t.get("special")})
        self._normalizer = normalizers.build(get(data, "normalizer"))
        self._pre = pretokenizers.build(get(data, "preTokenizer"))
        self._post = postprocessors.build(get(data, "postProcessor"))
        self._decoder = decoders.build(get(data, "decoder"), list(self.added_ids))
        self.clean_up = get(settings, "cleanUpTokenizationSpaces", True)
        self._model(get(data, "model", {}))

    def _model(self, model: dict) -> None:
        vocab = get(model, "vocab")
        if vocab is None:
            raise TokenizerError("missingVocab", "the model has no vocabulary")
        s = self.settings
        text = lambda k: v if isinstance(v := get(s, k), str) else None
        self.bos, self.eos, self.fuses = text("bosToken"), text("eosToken"), bool(get(s, "fuseUnk", False))
        if self.kind in BERT:
            self.vocab, self.unknown = dict(vocab), "[UNK]"
            lower, cjk = get(s, "doLowerCase", True), get(s, "handleChineseChars", True)
            piece = models.WordPiece(self.vocab)
            spaced = (lambda t: "".join(f" {c} " if "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿" else c for c in t)) if cjk else (lambda t: t)
            self.kernel = lambda word: [p for w in models.basic_words(spaced(word), lower) for p in piece(w)]
        elif self.kind in UNIGRAM:
            if not isinstance(vocab, list):
                raise TokenizerError("malformedVocab", "a unigram vocabulary is a list")
            self.kernel = models.Unigram(vocab, get(model, "unkId", 0))
            self.vocab, self.unknown, self.fuses, self.bos = self.kernel.ids, self.kernel.unknown, True, " "
        elif self.kind in BPE:
            self.vocab, self.unknown = merged(vocab, self.added_ids), as_token(get(s, "unkToken"))
            self.kernel = models.BytePairs(self.vocab, get(model, "merges", []), self.unknown)
        else:
            raise TokenizerError("unsupportedTokenizer", self.kind)
        self.unknown_id = self.vocab.get(self.unknown) if self.unknown is not None else None

    @classmethod
    def from_folder(cls, path: str) -> Tokenizer:
        d = folder.load(path)
        return cls(d.resolved(), d.data)

    @classmethod
    def from_pretrained(cls, name: str, registry: str) -> Tokenizer:
        """By name from a local registry: a folder of description folders.  Nothing is downloaded."""
        return cls.from_folder(f"{registry}/{name}")

    # ---- stages

    def normalize(self, c: Column) -> Column:
        return self._normalizer(c) if self._normalizer else c

    def pre_tokenize(self, c: Column, first: Column | None = None) -> Column:
        return self._pre(c, F.lit(True) if first is None else first) if self._pre else F.array(c)

    def post_process(self, a: Column, b: Column | None = None, special: bool = True) -> Column:
        return self._post(a, b, special) if self._post else (a if b is None else F.concat(a, b))

    def decode_tokens(self, a: Column) -> Column:
        return self._decoder(a) if self._decoder else a

    # ---- whole texts

    def words(self, text: Column) -> Column:
        """The words of a text.  Added tokens are words of their own, each marked by ADDED before it."""
        if not self.added:
            return self.pre_tokenize(self.normalize(text))
        found = splits.flagged(text, self.added)
        texts = F.transform(found, lambda s: s["text"])
        normal = normalizers.each(self._normalizer, texts) if self._normalizer else texts
        both = F.zip_with(found, normal, lambda s, t: F.struct(s["text"].alias("text"), s["is_match"].alias("added"), t.alias("normal")))
        return F.flatten(F.transform(both, lambda s, i: F.when(s["added"], F.array(F.concat(F.lit(ADDED), s["text"]))).otherwise(self.pre_tokenize(s["normal"], i == 0))))

    def _cutter(self) -> Callable[[str], list[str]]:
        """From a word to its tokens; unknown runs are fused within it."""
        kernel, vocab, unknown, fuses, added = self.kernel, self.vocab, self.unknown, self.fuses, frozenset(self.added_ids)

        def cut(word: str) -> list[str]:
            if added and word.startswith(ADDED) and word[1:] in added:
                return [word[1:]]
            out = kernel(word)
            return models.fuse(out, lambda t: t in vocab and t != unknown) if fuses else out

        return cut

    def tokens(self, words: Column) -> Column:
        """The model on an array of words."""
        return models.on_arrays(self._cutter())(words)

    def tokenize(self, df: DataFrame, text_col: str = "text", to: str = "tokens") -> DataFrame:
        """Adds the token array of every text, as a projection; nulls stay null."""
        return df.withColumn(to, self.tokens(self.words(F.col(text_col))))

    def ids(self, tokens: Column) -> Column:
        """Ids of a token array by the vocabulary; null where a token has none and there is no unknown id."""
        vocab, other = self.vocab, self.unknown_id
        return models.on_arrays(lambda t: [vocab.get(t, other)], T.IntegerType())(tokens)

    def encode(self, df: DataFrame, text_col: str = "text", to: str = "ids", special: bool = True, strict: bool = False) -> DataFrame:
        """Adds the id array of every text; strict makes a token without id an error.

        From words to ids is one Arrow function, unless the post-processor changes tokens that are not its own.
        """
        words, cut, vocab, other = self.words(F.col(text_col)), self._cutter(), self.vocab, self.unknown_id
        around = postprocessors.frame(get(self.data, "postProcessor"), special)
        if around is None:
            made = self.ids(self.post_process(self.tokens(words), None, special))
        else:
            ids = models.on_arrays(lambda w: [vocab.get(t, other) for t in cut(w)], T.IntegerType())(words)
            before, after = (F.array(*(F.lit(vocab.get(t, other)).cast("int") for t in side)).cast("array<int>") for side in around)
            made = F.concat(before, ids, after) if any(around) else ids
        out = df.withColumn(to, made)
        if strict:
            out = out.withColumn(to, F.when(F.exists(to, lambda x: x.isNull()), F.raise_error(F.lit("a token has no id")).cast("array<int>")).otherwise(F.col(to)))
        return out

    def decode(self, ids: Column, skip_special: bool = False) -> Column:
        """Text of an id array: special ids dropped if asked for, unknown ids dropped, decoder, joined, tidied."""
        tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        if skip_special:
            tokens = {i: t for i, t in tokens.items() if i not in set(self.special_ids)}
        if decoders.joins_first(get(self.data, "decoder"), list(self.added_ids)) and max(tokens, default=0) < 4 * len(tokens) + 1000:
            joined = models.to_text([tokens.get(i) for i in range(max(tokens, default=-1) + 1)])(ids.cast("array<long>"))
            text = F.array_join(self.decode_tokens(F.array(joined)), "")
        else:
            look = models.on_arrays(lambda i: [tokens[int(i)]] if i is not None and int(i) in tokens else [])
            text = F.array_join(self.decode_tokens(look(ids.cast("array<long>"))), "")
        return decoders.clean_up(text) if self.clean_up else text

    def apply_chat_template(self, df: DataFrame, messages_col: str = "messages", to: str = "ids", max_length: int | None = None, truncation: bool = False, **how) -> DataFrame:
        text = df.withColumn("_chat", chat.render(F.col(messages_col), self.settings, **how))
        return self.encode(text, "_chat", to, special=False).withColumn(to, chat.truncate(F.col(to), max_length, get(self.settings, "modelMaxLength"), truncation)).drop("_chat")

    def has_chat_template(self) -> bool:
        return get(self.settings, "chatTemplate") is not None

    def special_tokens(self) -> dict[str, tuple[str, int | None]]:
        """The special tokens that the settings name, as they are called there, each with its text and id."""
        named = {k: as_token(get(self.settings, k)) for k in ("bosToken", "eosToken", "unkToken", "sepToken", "padToken", "clsToken", "maskToken")}
        ids = {**self.added_ids, **self.vocab}
        return {k.removesuffix("Token"): (t, ids.get(t)) for k, t in named.items() if t is not None}

    def register(self, spark, name: str) -> None:
        """A SQL table function name(words) with (pos, token, id), for LATERAL joins.

        Its words are those of ``words``, so that they are made as the description says: SELECT t.* FROM docs, LATERAL name(words) t.
        A description that has neither added tokens nor normalizer nor pre-tokenizer takes a text as it is, too.
        """
        cut, vocab, other = self._cutter(), self.vocab, self.unknown_id
        whole = not (self.added or self._normalizer or self._pre)

        @F.udtf(returnType="pos int, token string, id int")
        class Tokens:
            def eval(self, words):  # noqa: ANN001, ANN201
                if isinstance(words, str):
                    if not whole:
                        raise ValueError("the description makes words of a text first")
                    words = [words]
                for i, t in enumerate(t for w in words or [] for t in cut(w)):
                    yield i, t, vocab.get(t, other)

        spark.udtf.register(name, Tokens)


def llama(settings: dict, data: dict) -> dict:
    """Newer descriptions drop the normalizer for Metaspace; special tokens come from the settings."""
    out = dict(data)
    if get(settings, "legacy", True) is False:
        out.pop("normalizer", None)
        out["pre_tokenizer"] = {"type": "Metaspace", "replacement": "▁", "add_prefix_space": True, "prepend_scheme": "first"}
    new = postprocessors.from_special_tokens(settings, get(data, "postProcessor"))
    return out if new is None else {**out, "post_processor": new}
