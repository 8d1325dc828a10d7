"""Pre-tokenizers: descriptions to functions from a text column to an array of words."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.bytemap import to_alphabet
from tokenloom.functions.patterns import BYTE_LEVEL, PUNCT, WS, to_java
from tokenloom.operators.splits import around, by_delimiter, by_string
from tokenloom.sources.config import TokenizerError, get

#: From a text and whether it is the first section.
PreTokenizer = Callable[[Column, Column], Column]


def _all(pattern: str) -> PreTokenizer:
    return lambda c, first: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


bert = _all(f"[^{WS}{PUNCT}]+|[{PUNCT}]")
whitespace = _all(f"[^{WS}]+")
punctuation = _all(f"[^{PUNCT}]+|[{PUNCT}]+")


def digits(individual: bool = False) -> PreTokenizer:
    return _all("[^0-9]+|[0-9]" + "+" * (not individual))


def metaspace(add_prefix_space: bool = False, replacement: str = " ", str_rep: str | None = None, scheme: str | None = "always") -> PreTokenizer:
    """Spaces become the replacement, which starts words; a prefix is added if asked for, always or to the first section only."""
    sign = replacement if str_rep is None else str_rep

    def split(c: Column, first: Column) -> Column:
        text = F.replace(c, F.lit(" "), F.lit(sign))
        if add_prefix_space and scheme != "never":
            lacks = ~text.startswith(replacement)
            text = F.when(lacks & first if scheme == "first" else lacks, F.concat(F.lit(sign), text)).otherwise(text)
        return F.when(text == "", F.array(F.lit(""))).otherwise(by_delimiter(text, replacement, "mergedWithNext"))

    return split


def byte_level(add_prefix_space: bool = False, use_regex: bool = True) -> PreTokenizer:
    """Words of the byte-level pattern in the byte alphabet; the prefix space goes to every word that lacks one."""

    def split(c: Column, first: Column) -> Column:
        words = F.regexp_extract_all(c, F.lit(BYTE_LEVEL), F.lit(0)) if use_regex else F.array(c)
        words = F.when(c == "", F.array(F.lit(""))).otherwise(words)
        spaced = (lambda x: F.when(x.startswith(" "), x).otherwise(F.concat(F.lit(" "), x))) if add_prefix_space else (lambda x: x)
        return F.transform(words, lambda x: to_alphabet(spaced(x)))

    return split


def split(pattern: dict | None, invert: bool = False) -> PreTokenizer:
    """At a string, whose occurrences stay unless inverted; or around a regular expression, whose matches always stay."""
    if (text := get(pattern, "String")) is not None:
        return lambda c, first: by_string(c, text, keep=not invert)
    if (regex := get(pattern, "Regex")) is not None:
        java = to_java(regex.replace("?i:", "i:"))
        return lambda c, first: around(c, java)
    return lambda c, first: F.array(c)


def sequence(steps: list[PreTokenizer]) -> PreTokenizer:
    def run(c: Column, first: Column) -> Column:
        one = lambda step: lambda x: step(x, first)
        return functools.reduce(lambda out, step: F.flatten(F.transform(out, one(step))), steps, F.array(c))

    return run


def build(config: dict | None) -> PreTokenizer | None:
    kind = get(config, "type")
    if kind is None:
        return None
    match kind.lower():
        case "sequence":
            return sequence([p for x in get(config, "pretokenizers", []) if (p := build(x))])
        case "bytelevel":
            return byte_level(get(config, "addPrefixSpace", False), get(config, "useRegex", True))
        case "punctuation":
            return punctuation
        case "digits":
            return digits(get(config, "individualDigits", False))
        case "split":
            return split(get(config, "pattern"), get(config, "invert", False))
        case "whitespace" | "whitespacesplit":
            return whitespace
        case "metaspace":
            return metaspace(get(config, "addPrefixSpace", False), get(config, "replacement", " "), get(config, "strRep"), get(config, "prependScheme", "always"))
        case "bert" | "bertpretokenizer":
            return bert
    raise TokenizerError("unsupported", f"pre-tokenizer {kind}")
