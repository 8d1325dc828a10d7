"""String helpers as Column functions: names, globs, tags, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.patterns import literal


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def uncamel(c: Column) -> Column:
    """addedTokens to added_tokens; for ASCII names."""
    return F.lower(F.regexp_replace(c, r"(?<=[^A-Z])(?=[^a-z])", "_"))


def camel(c: Column) -> Column:
    parts = F.split(c, "_")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), capitalize), ""))


def snake(name: str) -> str:
    """The same for a name on the driver; digits and _ count as both cases."""
    out = []
    for i, ch in enumerate(name):
        if i and not ("A" <= name[i - 1] <= "Z") and not ("a" <= ch <= "z"):
            out.append("_")
        out.append(ch.lower())
    return "".join(out)


def glob_pattern(glob: str) -> str:
    """* is anything, also over slashes; ? is one character; all else is itself."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else literal(c) for c in glob) + "$"


def matches_glob(c: Column, globs: list[str]) -> Column:
    """Whether any glob matches; no globs match everything."""
    out = F.lit(not globs)
    for g in globs:
        out = out | c.rlike(glob_pattern(g))
    return out


def etag(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "^W/", ""), F.lit('"'), F.lit(""))


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_commit(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{40}$")


def inverted(m: Column) -> Column:
    """A map's keys by their values; of equal values the last counts."""
    values, keys = F.map_values(m), F.map_keys(m)
    last = F.transform(values, lambda v, i: F.array_position(F.reverse(values), v) == F.size(values) - i)
    kept = lambda a: F.transform(F.filter(F.zip_with(a, last, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda p: p["k"]), lambda p: p["x"])
    return F.map_from_arrays(kept(values), kept(keys))


def merged(*maps: Column) -> Column:
    """Maps put together; of equal keys the last counts."""
    entries = F.flatten(F.array(*(F.map_entries(m) for m in maps)))
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), (F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i).alias("k"))), lambda p: p["k"])
    return F.map_from_entries(F.transform(kept, lambda p: p["e"]))
