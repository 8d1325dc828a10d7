"""Access to JSON settings: camelCase names fall back to snake_case, missing values are None."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.strings import snake


class TokenizerError(ValueError):
    """What is wrong with a description or a call; ``kind`` names it."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def get(config: dict | None, name: str, default: Any = None) -> Any:
    if not config:
        return default
    for key in (name, snake(name)):
        if config.get(key) is not None:
            return config[key]
    return default


def as_token(value: Any) -> str | None:
    """A token given as text or as {"content": text}."""
    return value.get("content") if isinstance(value, dict) else value


def merged(left: dict | None, right: dict | None) -> dict:
    return {**(left or {}), **(right or {})}


def parse(text: str) -> dict:
    r"""JSON of which raw doubled-backslash line feeds are read as line feeds' escapes; anything but an object is an error."""
    try:
        found = json.loads(text.replace("\\\\n", "\\n"))
    except ValueError as e:
        raise TokenizerError("parse", str(e)) from None
    if not isinstance(found, dict):
        raise TokenizerError("parse", "not an object")
    return found


def parse_column(c: Column) -> Column:
    """The same as a column: a map from names to their values' JSON or texts; null where a text isn't an object."""
    return F.from_json(F.replace(c, F.lit("\\\\n"), F.lit("\\n")), "map<string,string>")
