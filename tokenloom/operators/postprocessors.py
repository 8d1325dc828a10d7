"""Post-processors: special tokens around token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.patterns import WS
from tokenloom.sources.config import TokenizerError, as_token, get

#: From tokens, a second array or None, and whether special tokens are wanted.
PostProcessor = Callable[[Column, Column | None, bool], Column]


def _one(token: str) -> Column:
    return F.array(F.lit(token))


def template(single: list[dict], pair: list[dict]) -> PostProcessor:
    def run(a: Column, b: Column | None, special: bool) -> Column:
        parts = []
        for item in single if b is None else pair:
            if (s := get(item, "SpecialToken")) is not None:
                parts += [_one(get(s, "id"))] * special
            elif (s := get(item, "Sequence")) is not None:
                if get(s, "id") == "A":
                    parts.append(a)
                elif b is not None:
                    parts.append(b)
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    return run


def roberta(sep: str, cls: str, trim_offset: bool = True, add_prefix_space: bool = True) -> PostProcessor:
    """cls A sep [sep B sep], always; tokens keep one space at each side at most, or none."""
    if not trim_offset:
        trim = lambda a: a
    elif add_prefix_space:
        trim = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"^ +(?= )|(?<= ) +$", ""))
    else:
        trim = lambda a: F.transform(a, lambda x: F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", ""))

    def run(a: Column, b: Column | None, special: bool) -> Column:
        out = F.concat(_one(cls), trim(a), _one(sep))
        if b is None:
            return out
        return F.when(F.size(b) > 0, F.concat(out, _one(sep), trim(b), _one(sep))).otherwise(out)

    return run


def bert(sep: str, cls: str) -> PostProcessor:
    def run(a: Column, b: Column | None, special: bool) -> Column:
        if not special:
            return a if b is None else F.concat(a, b)
        out = F.concat(_one(cls), a, _one(sep))
        return out if b is None else F.when(F.size(b) > 0, F.concat(out, b, _one(sep))).otherwise(out)

    return run


def sequence(steps: list[PostProcessor]) -> PostProcessor:
    """In order; the second array goes to the first step only."""

    def run(a: Column, b: Column | None, special: bool) -> Column:
        for k, step in enumerate(steps):
            a = step(a, b if k == 0 else None, special)
        return a

    return run


def frame(config: dict | None, special: bool) -> tuple[list[str], list[str]] | None:
    """The tokens before and after a single text, where a post-processor does no more than add such; None where it does."""
    kind = (get(config, "type") or "").lower()
    if kind in ("", "bytelevel"):
        return [], []
    if kind == "bertprocessing":
        return ([_pair(config, "cls")], [_pair(config, "sep")]) if special else ([], [])
    if kind == "templateprocessing":
        items = [("special", get(get(x, "SpecialToken"), "id")) if get(x, "SpecialToken") is not None else ("text", get(get(x, "Sequence"), "id")) for x in get(config, "single", [])]
        at = [k for k, x in enumerate(items) if x == ("text", "A")]
        if len(at) != 1:
            return None
        return tuple([t for _, t in part if special] for part in (items[: at[0]], [x for x in items[at[0] + 1 :] if x[0] == "special"]))
    if kind == "sequence":
        before, after = [], []
        for step in get(config, "processors", []):
            found = frame(step, special)
            if found is None:
                return None
            before, after = found[0] + before, after + found[1]
        return before, after
    return None


def build(config: dict | None) -> PostProcessor | None:
    kind = get(config, "type")
    if kind is None:
        return None
    match kind.lower():
        case "templateprocessing":
            single, pair = get(config, "single"), get(config, "pair")
            if single is None or pair is None:
                raise TokenizerError("missingConfig", "a template needs single and pair")
            return template(single, pair)
        case "bytelevel":
            return lambda a, b, special: a if b is None else F.concat(a, b)
        case "robertaprocessing":
            return roberta(_pair(config, "sep"), _pair(config, "cls"), get(config, "trimOffset", True), get(config, "addPrefixSpace", True))
        case "bertprocessing":
            return bert(_pair(config, "sep"), _pair(config, "cls"))
        case "sequence":
            return sequence([p for x in get(config, "processors", []) if (p := build(x))])
    raise TokenizerError("unsupported", f"post-processor {kind}")


def _pair(config: dict, name: str) -> str:
    """The token of a [token, id] pair, in either order."""
    found = next((x for x in get(config, name, []) if isinstance(x, str)), None)
    if found is None:
        raise TokenizerError("missingConfig", f"post-processor without {name}")
    return found


def from_special_tokens(settings: dict, existing: dict | None) -> dict | None:
    """A template for add_bos_token and add_eos_token; None where the existing template is to stay."""
    if (get(existing, "type") or "").lower() == "templateprocessing":
        return None
    bos, eos = as_token(get(settings, "bosToken")), as_token(get(settings, "eosToken"))
    wants = {"bos": get(settings, "addBosToken", False), "eos": get(settings, "addEosToken", False)}
    for name, token in (("bos", bos), ("eos", eos)):
        if wants[name] and token is None:
            raise TokenizerError("mismatchedConfig", f"add_{name}_token without {name}_token")
    special = lambda t, k: [{"SpecialToken": {"id": t, "type_id": k}}]
    side = lambda s, k: special(bos, k) * bool(wants["bos"]) + [{"Sequence": {"id": s, "type_id": k}}] + special(eos, k) * bool(wants["eos"])
    return {"type": "TemplateProcessing", "single": side("A", 0), "pair": side("A", 0) + side("B", 1)}
