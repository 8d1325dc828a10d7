"""Cutting texts at patterns: by delimiter behaviours, with separators, and around added tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.patterns import MARK, WS, literal


def _nonempty(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def around(c: Column, pattern: str, kept: str = "$0") -> Column:
    """Pieces between matches and what ``kept`` says of the matches, in order; empty pieces go.

    One replacement puts marks around all matches.  Texts that hold the mark themselves are matched twice instead, for what is
    between and for what matches; there an empty match parts nothing.
    """
    marked = F.split(F.regexp_replace(c, pattern, f"{MARK}{kept}{MARK}"), MARK)
    between, matches = F.split(c, pattern, -1), F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: m != "")
    said = matches if kept == "$0" else F.transform(matches, lambda m: F.regexp_replace(m, pattern, kept))
    woven = F.flatten(F.zip_with(between, said, lambda x, m: F.array(F.coalesce(x, F.lit("")), F.coalesce(m, F.lit("")))))
    return _nonempty(F.when(F.contains(c, F.lit(MARK)), woven).otherwise(marked))


def by_delimiter(c: Column, delimiter: str, behavior: str = "removed") -> Column:
    """Splits at one character: removed, isolated, mergedWithPrevious or mergedWithNext."""
    d, rest = literal(delimiter), f"[^{literal(delimiter)}]+"
    pattern = {"removed": rest, "remove": rest, "isolated": f"{rest}|{d}", "isolate": f"{rest}|{d}", "mergedwithprevious": f"{rest}{d}?|{d}", "mergedwithnext": f"{d}?{rest}|{d}"}
    return F.regexp_extract_all(c, F.lit(pattern[behavior.lower()]), F.lit(0))


def by_string(c: Column, separator: str, keep: bool = False) -> Column:
    return around(c, literal(separator)) if keep else _nonempty(F.split(c, literal(separator)))


def added_pattern(tokens: list[dict]) -> str | None:
    """Alternatives for added tokens, longest first; lstrip and rstrip swallow the white space beside them."""
    space = f"[{WS}]*"
    one = lambda t: (space if t.get("lstrip") else "") + f"({literal(t['content'])})" + (space if t.get("rstrip") else "")
    ordered = sorted((t for t in tokens if t.get("content")), key=lambda t: -len(t["content"]))
    return "|".join(map(one, ordered)) or None


def sections(c: Column, tokens: list[dict]) -> Column:
    """A text's sections: added tokens on their own, and what lies between them; an empty text is one empty section."""
    pattern = added_pattern(tokens)
    if not pattern:
        return F.array(c)
    groups = len([t for t in tokens if t.get("content")])
    kept = "".join(f"${k}" for k in range(1, groups + 1))
    found = around(c, pattern, kept)
    return F.when(c == "", F.array(F.lit(""))).otherwise(found)


def flagged(c: Column, tokens: list[dict]) -> Column:
    """Sections with whether each is an added token."""
    names = [t["content"] for t in tokens]
    return F.transform(sections(c, tokens), lambda x: F.struct(x.alias("text"), x.isin(names).alias("is_match")))
