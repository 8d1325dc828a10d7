"""Normalizers: descriptions to functions from a text column to a text column."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.patterns import WS, literal, replacement, to_java
from tokenloom.sources.config import TokenizerError, get

Normalizer = Callable[[Column], Column]


def each(step: Normalizer, texts: Column) -> Column:
    """A normalizer over an array of texts.  Native steps go into a lambda; those in Python have an ``each`` of their own."""
    return step.each(texts) if hasattr(step, "each") else F.transform(texts, step)


def _batched(one: Callable[[str], str]) -> Normalizer:
    """A Python function of texts as a normalizer, on columns and on arrays; a distinct text is worked on once in a batch."""

    def mapped(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        made = pa.array([None if t is None else one(t) for t in coded.dictionary.to_pylist()], pa.string())
        return made.take(coded.indices)

    @F.arrow_udf(T.StringType())
    def column(texts: pa.Array) -> pa.Array:
        return mapped(texts)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def arrays(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), mapped(lists.flatten()), mask=lists.is_null())

    def step(c: Column) -> Column:
        return column(c)

    step.each = arrays
    return step


_FULL_WIDTH_TILDE = "\uFF5E"
_CONTROL = re.compile("r[\x01-\x08\x0b\x0e-\x1f\x7f\x8f\x9f]")
_CONTROL_STRICT = re.compile("[\x01-\x08\x0b\x0e-\x1f\x7f\x8f\x9f]")


def unicode_form(form: str) -> Normalizer:
    """NFC, NFD, NFKC or NFKD.  Spark has no built-in, so this is an Arrow batch function; ASCII texts pass untouched."""
    return _batched(lambda t: t if t.isascii() else unicodedata.normalize(form, t))


def precompiled(strip_controls: bool = False) -> Normalizer:
    """NFKC around the full-width tilde.  As it is defined a control character only goes after an "r"; strip_controls removes all."""
    pattern = _CONTROL_STRICT if strip_controls else _CONTROL
    return _batched(lambda t: _FULL_WIDTH_TILDE.join(unicodedata.normalize("NFKC", p) for p in pattern.sub("", t).split(_FULL_WIDTH_TILDE)))


def prepend(text: str) -> Normalizer:
    return lambda c: F.concat(F.lit(text), c)


def replace(pattern: dict | None, content: str | None) -> Normalizer:
    """All occurrences of a string or of a regular expression, by content as it stands.  An unfinished description does nothing."""
    if content is None or not pattern:
        return lambda c: c
    if (text := get(pattern, "String")) is not None:
        return lambda c: F.replace(c, F.lit(text), F.lit(content))
    if (regex := get(pattern, "Regex")) is not None:
        return lambda c: F.regexp_replace(c, to_java(regex), replacement(content))
    return lambda c: c


def strip(left: bool = True, right: bool = True) -> Normalizer:
    space = f"[{WS}\\x85]+"
    pattern = "|".join([f"^{space}"] * left + [f"{space}$"] * right)
    return (lambda c: F.regexp_replace(c, pattern, "")) if pattern else (lambda c: c)


def clean(c: Column) -> Column:
    """Tabs and line ends become spaces; other control characters stay."""
    return F.translate(c, "\t\n\r", "   ")


def space_ideographs(c: Column) -> Column:
    return F.regexp_replace(c, r"([\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF])", " $1 ")


def _without_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\u0300-\u036F]", "")


def strip_accents(c: Column) -> Column:
    """Decomposes and drops combining marks; the rest stays decomposed."""
    return _without_marks(unicode_form("NFD")(c))


def bert(clean_text: bool = True, handle_chinese_chars: bool = True, lowercase: bool = True, strip: bool | None = None) -> Normalizer:
    steps: list[Normalizer] = [clean] * clean_text + [space_ideographs] * handle_chinese_chars
    steps += [unicode_form("NFD"), _without_marks] * (lowercase if strip is None else strip) + [F.lower] * lowercase
    return sequence(steps)


def sequence(steps: list[Normalizer]) -> Normalizer:
    def run(c: Column) -> Column:
        return functools.reduce(lambda x, step: step(x), steps, c)

    if any(hasattr(step, "each") for step in steps):
        run.each = lambda a: functools.reduce(lambda x, step: each(step, x), steps, a)
    return run


def build(config: dict | None) -> Normalizer | None:
    """The normalizer of a description; None where there is none."""
    kind = get(config, "type")
    if kind is None:
        return None
    match kind.lower():
        case "sequence":
            return sequence([n for x in get(config, "normalizers", []) if (n := build(x))])
        case "prepend":
            return prepend(get(config, "prepend", ""))
        case "replace":
            return replace(get(config, "pattern"), get(config, "content"))
        case "lowercase":
            return F.lower
        case "nfd" | "nfc" | "nfkd" | "nfkc":
            return unicode_form(kind.upper())
        case "bert" | "bertnormalizer":
            return bert(get(config, "cleanText", True), get(config, "handleChineseChars", True), get(config, "lowercase", True), get(config, "stripAccents"))
        case "precompiled":
            return precompiled(get(config, "stripControls", False))
        case "stripaccents":  # as defined: compatibility composition
            return unicode_form("NFKC")
        case "strip":
            return strip(get(config, "stripLeft", True), get(config, "stripRight", True))
    raise TokenizerError("unsupported", f"normalizer {kind}")


__all__ = ["Normalizer", "bert", "build", "clean", "each", "literal", "precompiled", "prepend", "replace", "sequence", "space_ideographs", "strip", "strip_accents", "unicode_form"]
