"""Decoders: token arrays back to pieces of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.bytemap import from_alphabet
from tokenloom.functions.patterns import WS, literal
from tokenloom.operators import normalizers
from tokenloom.sources.config import TokenizerError, get

Decoder = Callable[[Column], Column]
_STRINGS = "array<string>"


def word_piece(prefix: str = "", cleanup: bool = False) -> Decoder:
    """Continuations lose their prefix, other words but the first get a space."""

    def tidy(x: Column) -> Column:
        if not cleanup:
            return x
        x = F.regexp_replace(x, f"[{WS}]+([.?!,]|'[{WS}]|n't|'m|'s|'ve|'re)", "$1")
        return F.replace(x, F.lit(" do not"), F.lit(" don't"))

    def run(a: Column) -> Column:
        glued = lambda x: F.when(x.startswith(prefix), F.substr(x, F.lit(len(prefix) + 1))).otherwise(F.concat(F.lit(" "), x)) if prefix else x
        return F.transform(a, lambda x, i: tidy(F.when(i == 0, x).otherwise(glued(x))))

    return run


def byte_level(added: list[str] = ()) -> Decoder:
    """Runs of ordinary tokens are one text in the byte alphabet; added tokens pass through on their own."""
    if not added:
        return lambda a: F.array(from_alphabet(F.array_join(a, "")))
    names = [F.lit(x) for x in added]

    def run(a: Column) -> Column:
        start = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("held"))
        flush = lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(from_alphabet(s["held"]))))
        step = lambda s, x: F.when(x.isin(*names), F.struct(F.concat(flush(s), F.array(x)).alias("out"), F.lit("").alias("held"))).otherwise(F.struct(s["out"].alias("out"), F.concat(s["held"], x).alias("held")))
        return F.aggregate(a, start, step, flush)

    return run


def byte_fallback(flush_tail: bool = False) -> Decoder:
    """Runs of <0xHH> become the text of their bytes.  As defined a run at the end is lost; flush_tail keeps it."""

    def run(a: Column) -> Column:
        start = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("hex"))
        text = lambda h: F.decode(F.unhex(h), "UTF-8")
        flush = lambda s: F.when(s["hex"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(text(s["hex"]))))
        is_byte = lambda x: x.rlike("^<0x[0-9A-Fa-f]{2}>$")
        step = lambda s, x: F.when(is_byte(x), F.struct(s["out"].alias("out"), F.concat(s["hex"], F.substr(x, F.lit(4), F.lit(2))).alias("hex"))).otherwise(F.struct(F.concat(flush(s), F.array(x)).alias("out"), F.lit("").alias("hex")))
        return F.aggregate(a, start, step, flush if flush_tail else lambda s: s["out"])

    return run


def fuse(a: Column) -> Column:
    return F.array(F.array_join(a, ""))


def replace(pattern: dict | None, content: str | None) -> Decoder:
    step = normalizers.replace(pattern, content)
    return lambda a: F.transform(a, step)


def strip(start: int = 0, stop: int = 0) -> Decoder:
    """Takes at most so many spaces off each end of each token, whatever character is named."""
    return lambda a: F.transform(a, lambda x: F.regexp_replace(F.regexp_replace(x, f"^ {{0,{start}}}", ""), f" {{0,{stop}}}$", ""))


def metaspace(add_prefix_space: bool = False, replacement: str = "_") -> Decoder:
    def run(a: Column) -> Column:
        spaced = lambda x: F.replace(x, F.lit(replacement), F.lit(" "))
        if not add_prefix_space:
            return F.transform(a, spaced)
        return F.transform(a, lambda x, i: F.when((i == 0) & spaced(x).startswith(" "), F.substr(spaced(x), F.lit(2))).otherwise(spaced(x)))

    return run


def sequence(steps: list[Decoder]) -> Decoder:
    def run(a: Column) -> Column:
        for step in steps:
            a = step(a)
        return a

    return run


#: What tidying up replaces, in order.
CLEAN_UP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def clean_up(c: Column) -> Column:
    for old, new in CLEAN_UP:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def joins_first(config: dict | None, added: list[str]) -> bool:
    """Whether a decoder begins by putting all tokens in a row, so that it may as well be given their text as one token."""
    kind = (get(config, "type") or "").lower()
    if kind == "sequence":
        return bool(steps := get(config, "decoders", [])) and joins_first(steps[0], added)
    return kind == "fuse" or kind == "bytelevel" and not added


def build(config: dict | None, added: list[str] = ()) -> Decoder | None:
    kind = get(config, "type")
    if kind is None:
        return None
    match kind.lower():
        case "wordpiece":
            return word_piece(get(config, "prefix", ""), get(config, "cleanup", False))
        case "sequence":
            return sequence([d for x in get(config, "decoders", []) if (d := build(x, added))])
        case "bytelevel":
            return byte_level(added)
        case "replace":
            return replace(get(config, "pattern"), get(config, "content"))
        case "bytefallback":
            return byte_fallback(get(config, "flushTail", False))
        case "fuse":
            return fuse
        case "strip":
            return strip(get(config, "start", 0), get(config, "stop", 0))
        case "metaspace":
            return metaspace(get(config, "addPrefixSpace", False), get(config, "replacement", "_"))
    raise TokenizerError("unsupported", f"decoder {kind}")


__all__ = ["CLEAN_UP", "Decoder", "build", "byte_fallback", "byte_level", "clean_up", "fuse", "joins_first", "literal", "metaspace", "replace", "sequence", "strip", "word_piece"]
