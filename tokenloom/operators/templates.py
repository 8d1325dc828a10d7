"""Chat templates: the part of Jinja that such templates use, evaluated without any other package."""

from __future__ import annotations

import json
import re
from typing import Any

from tokenloom.sources.config import TokenizerError

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~<>()\[\]{},.:|=]))")
_INSIDE = r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?"
_TAG = re.compile(rf"(\{{\{{-?{_INSIDE}-?\}}\}}|\{{%-?{_INSIDE}-?%\}}|\{{#-?.*?-?#\}})", re.DOTALL)


class Undefined:
    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self):
        return iter(())


UNDEFINED = Undefined()


class Namespace(dict):
    pass


class _Break(Exception):  # noqa: N818
    """The end of a loop, or with ``further`` of one of its rounds."""

    def __init__(self, further: bool):
        self.further = further


def _fail(message: str) -> TokenizerError:
    return TokenizerError("chatTemplate", message)


class Expression:
    """A parsed expression: nested tuples, built by precedence and evaluated on a scope."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise _fail(f"unknown sign at: {text[at : at + 20]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.tree = self._choice()
        if self.at < len(self.tokens):
            raise _fail(f"unexpected {self.tokens[self.at][1]}")

    def _is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str"

    def _take(self, *values: str) -> str | None:
        if self._is(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise _fail(f"{value} expected")

    def _choice(self):
        value = self._or()
        if self._take("if"):
            condition = self._or()
            other = self._choice() if self._take("else") else ("const", UNDEFINED)
            return "if", condition, value, other
        return value

    def _or(self):
        left = self._and()
        while self._take("or"):
            left = "or", left, self._and()
        return left

    def _and(self):
        left = self._not()
        while self._take("and"):
            left = "and", left, self._not()
        return left

    def _not(self):
        return ("not", self._not()) if self._take("not") else self._compare()

    def _compare(self):
        left = self._sum()
        while True:
            if op := self._take("==", "!=", "<", ">", "<=", ">=", "in"):
                left = "op", op, left, self._sum()
            elif self._is("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                left = "not", ("op", "in", left, self._sum())
            elif self._take("is"):
                negative = bool(self._take("not"))
                name = self.tokens[self.at][1]
                self.at += 1
                args = self._arguments(")")[0] if self._take("(") else []
                left = ("not", ("test", name, left, args)) if negative else ("test", name, left, args)
            else:
                return left

    def _sum(self):
        left = self._product()
        while op := self._take("+", "-", "~"):
            left = "op", op, left, self._product()
        return left

    def _product(self):
        left = self._unary()
        while op := self._take("*", "/", "//", "%"):
            left = "op", op, left, self._unary()
        return left

    def _unary(self):
        if self._take("-"):
            return "op", "-", ("const", 0), self._unary()
        return self._filters(self._postfix(self._atom()))

    def _arguments(self, end: str):
        plain, named = [], {}
        while not self._take(end):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1][1] == "=":
                name = self.tokens[self.at][1]
                self.at += 2
                named[name] = self._choice()
            else:
                plain.append(self._choice())
            if not self._is(end):
                self._need(",")
        return plain, named

    def _postfix(self, value):
        while True:
            if self._take("."):
                value = "get", value, ("const", self.tokens[self.at][1])
                self.at += 1
            elif self._take("["):
                if self._is(":"):
                    first = None
                else:
                    first = self._choice()
                if self._take(":"):
                    last = None if self._is("]", ":") else self._choice()
                    step = None if not self._take(":") or self._is("]") else self._choice()
                    value = "slice", value, first, last, step
                else:
                    value = "get", value, first
                self._need("]")
            elif self._take("("):
                value = "call", value, *self._arguments(")")
            else:
                return value

    def _filters(self, value):
        while self._take("|"):
            name = self.tokens[self.at][1]
            self.at += 1
            value = "filter", name, value, *(self._arguments(")") if self._take("(") else ([], {}))
            value = self._postfix(value)
        return value

    def _atom(self):
        if self.at >= len(self.tokens):
            raise _fail("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return "const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)
        if kind == "num":
            return "const", float(text) if "." in text else int(text)
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", fixed[text]) if text in fixed else ("name", text)
        if text == "(":
            value = self._choice()
            self._need(")")
            return value
        if text == "[":
            return "list", self._arguments("]")[0]
        if text == "{":
            pairs = []
            while not self._take("}"):
                key = self._choice()
                self._need(":")
                pairs.append((key, self._choice()))
                if not self._is("}"):
                    self._need(",")
            return "dict", pairs
        raise _fail(f"unexpected {text}")


def _raise(message: str = "") -> None:
    raise _fail(str(message))


_shown = str


def _index(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value[key] if key in value else getattr(value, key) if key in ("items", "keys", "values", "get") else UNDEFINED
    if isinstance(value, list | str) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    if isinstance(value, str) and key in ("strip", "lstrip", "rstrip", "upper", "lower", "title", "split", "startswith", "endswith", "replace"):
        return getattr(value, key)
    return UNDEFINED


_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b, "~": lambda a, b: _shown(a) + _shown(b)}
_TESTS = {"defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict), "iterable": lambda x: isinstance(x, list | dict | str), "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool), "true": lambda x: x is True, "false": lambda x: x is False, "sequence": lambda x: isinstance(x, list | str), "boolean": lambda x: isinstance(x, bool), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "float": lambda x: isinstance(x, float), "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "divisibleby": lambda x, n: x % n == 0, "callable": callable, "in": lambda x, xs: x in xs}
_TESTS |= {name: _OPS[op] for op, names in (("==", ("eq", "equalto")), ("!=", ("ne",)), ("<", ("lt", "lessthan")), (">", ("gt", "greaterthan")), ("<=", ("le",)), (">=", ("ge",))) for name in names}
_FILTERS = {"trim": lambda x: _shown(x).strip(), "upper": lambda x: _shown(x).upper(), "lower": lambda x: _shown(x).lower(), "length": len, "count": len, "first": lambda x: x[0] if x else UNDEFINED, "last": lambda x: x[-1] if x else UNDEFINED, "string": _shown, "int": int, "list": list, "join": lambda x, by="": by.join(map(_shown, x)), "items": lambda x: [list(i) for i in x.items()], "default": lambda x, other="": other if x is UNDEFINED else x, "replace": lambda x, a, b: x.replace(a, b), "tojson": lambda x, indent=None: json.dumps(x, ensure_ascii=False, indent=indent)}
_FILTERS |= {"capitalize": lambda x: _shown(x).capitalize(), "title": lambda x: _shown(x).title(), "reverse": lambda x: x[::-1], "sum": sum, "min": min, "max": max, "abs": abs, "float": float, "safe": lambda x: x, "unique": lambda x: list(dict.fromkeys(x)), "round": lambda x, n=0: round(float(x), n), "sort": lambda x, reverse=False, attribute=None: sorted(x, key=(lambda r: r) if attribute is None else lambda r: _path(r, attribute), reverse=reverse), "indent": lambda x, width=4, first=False: ("" if not first else " " * width) + _shown(x).replace("\n", "\n" + " " * width), "dictsort": lambda x: [list(i) for i in sorted(x.items())], "groupby": lambda x, attribute: [[k, [r for r in x if _path(r, attribute) == k]] for k in sorted({_path(r, attribute) for r in x})]}


def _path(row: Any, attribute: Any) -> Any:
    """An attribute by its name, or several in a row with points between."""
    for key in str(attribute).split(".") if isinstance(attribute, str) else [attribute]:
        row = _index(row, key)
    return row


def _passes(value: Any, test: tuple) -> bool:
    if not test:
        return bool(value)
    name, *args = test
    if name not in _TESTS:
        raise _fail(f"unknown test {name}")
    return bool(_TESTS[name](value, *args))


def _mapped(rows: Any, *how: Any, **named: Any) -> list:
    """An attribute of each row (with a default), or a filter of each."""
    if "attribute" in named:
        return [named.get("default", UNDEFINED) if (found := _path(r, named["attribute"])) is UNDEFINED else found for r in rows]
    if not how or how[0] not in _FILTERS:
        raise _fail("map needs an attribute or a filter")
    return [_FILTERS[how[0]](r, *how[1:], **named) for r in rows]


_FILTERS |= {"map": _mapped, "select": lambda x, *t: [r for r in x if _passes(r, t)], "reject": lambda x, *t: [r for r in x if not _passes(r, t)], "selectattr": lambda x, a, *t: [r for r in x if _passes(_path(r, a), t)], "rejectattr": lambda x, a, *t: [r for r in x if not _passes(_path(r, a), t)]}


def value_of(tree: tuple, scope: dict) -> Any:
    ev = lambda t: value_of(t, scope)
    match tree:
        case ("const", x):
            return x
        case ("name", x):
            return scope.get(x, UNDEFINED)
        case ("list", xs):
            return [ev(x) for x in xs]
        case ("dict", pairs):
            return {ev(k): ev(v) for k, v in pairs}
        case ("if", c, a, b):
            return ev(a) if ev(c) else ev(b)
        case ("or", a, b):
            return ev(a) or ev(b)
        case ("and", a, b):
            return ev(a) and ev(b)
        case ("not", a):
            return not ev(a)
        case ("op", op, a, b):
            try:
                return _OPS[op](ev(a), ev(b))
            except TypeError as e:
                raise _fail(str(e)) from None
        case ("test", name, a, args):
            return _passes(ev(a), (name, *map(ev, args)))
        case ("get", a, k):
            return _index(ev(a), ev(k))
        case ("slice", a, *bounds):
            return ev(a)[slice(*(None if x is None else ev(x) for x in bounds))]
        case ("filter", name, a, args, named):
            if name not in _FILTERS:
                raise _fail(f"unknown filter {name}")
            return _FILTERS[name](ev(a), *map(ev, args), **{k: ev(v) for k, v in named.items()})
        case ("call", f, args, named):
            known = {"raise_exception": _raise, "range": lambda *a: list(range(*a)), "namespace": lambda **k: Namespace(k), "dict": lambda **k: k}
            found = known[f[1]] if f[0] == "name" and f[1] in known else ev(f)
            if not callable(found):
                raise _fail("not a function")
            return found(*map(ev, args), **{k: ev(v) for k, v in named.items()})
    raise _fail("unknown expression")


class Template:
    """A template, parsed once; ``render`` takes the names it may use."""

    def __init__(self, source: str):
        parts = _TAG.split(source.removesuffix("\n"))
        items: list[tuple[str, str]] = []
        for i, p in enumerate(parts):
            if i % 2 == 0:
                text = p
                if i and parts[i - 1][-3] == "-":
                    text = text.lstrip()
                if i + 1 < len(parts) and parts[i + 1][2] == "-":
                    text = text.rstrip()
                items.append(("text", text))
            elif not p.startswith("{#"):
                items.append(("show" if p.startswith("{{") else "tag", p[2:-2].strip("-").strip()))
        self.items, self.at = items, 0
        self.body, end = self._block(())
        if end:
            raise _fail(f"unexpected {end}")

    def _block(self, ends: tuple[str, ...]) -> tuple[list, str]:
        out: list = []
        while self.at < len(self.items):
            kind, text = self.items[self.at]
            self.at += 1
            if kind == "text":
                out.append(("text", text))
            elif kind == "show":
                out.append(("show", Expression(text).tree))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return out, text
                if word == "for":
                    m = re.match(r"(\w+(?:\s*,\s*\w+)*)\s+in\s+(.*?)(?:\s+if\s+(?!.*\belse\b)(.*))?$", rest, re.DOTALL)
                    if not m:
                        raise _fail(f"for {rest}")
                    body, end = self._block(("else", "endfor"))
                    other = self._block(("endfor",))[0] if end.startswith("else") else []
                    out.append(("for", [x.strip() for x in m[1].split(",")], Expression(m[2]).tree, Expression(m[3]).tree if m[3] else None, body, other))
                elif word == "if":
                    branches, other, end = [], [], text
                    condition = Expression(rest).tree
                    while True:
                        body, end = self._block(("elif", "else", "endif"))
                        branches.append((condition, body))
                        head, _, tail = end.partition(" ")
                        if head != "elif":
                            break
                        condition = Expression(tail).tree
                    if head == "else":
                        other, _ = self._block(("endif",))
                    out.append(("if", branches, other))
                elif word == "set":
                    name, sign, value = rest.partition("=")
                    if sign:
                        out.append(("set", name.strip(), Expression(value).tree))
                    else:
                        out.append(("capture", name.strip(), self._block(("endset",))[0]))
                elif word == "macro":
                    m = re.match(r"(\w+)\s*\((.*)\)$", rest, re.DOTALL)
                    if not m:
                        raise _fail(f"macro {rest}")
                    plain, named = Expression(f"f({m[2]})").tree[2:]
                    out.append(("macro", m[1], [x[1] for x in plain], named, self._block(("endmacro",))[0]))
                elif word == "generation":  # marks what a model answers; shows it as it is
                    out += self._block(("endgeneration",))[0]
                elif word in ("break", "continue"):
                    out.append((word,))
                else:
                    raise _fail(f"unknown tag {word}")
        if ends:
            raise _fail(f"{ends[-1]} expected")
        return out, ""

    def render(self, **names: Any) -> str:
        return self._text(self.body, dict(names))

    def _run(self, body: list, scope: dict, out: list[str]) -> None:
        for item in body:
            match item:
                case ("text", text):
                    out.append(text)
                case ("show", tree):
                    out.append(_shown(value_of(tree, scope)))
                case ("set", name, tree):
                    value = value_of(tree, scope)
                    if "." in name:
                        space, _, key = name.partition(".")
                        scope[space][key] = value
                    else:
                        scope[name] = value
                case ("if", branches, other):
                    self._run(next((b for c, b in branches if value_of(c, scope)), other), scope, out)
                case ("capture", name, inner):
                    scope[name] = self._text(inner, dict(scope))
                case ("macro", name, names, defaults, inner):
                    scope[name] = self._function(names, defaults, inner, scope)
                case ("break" | "continue",):
                    raise _Break(item[0] == "continue")
                case ("for", names, tree, condition, inner, other):
                    rows = list(value_of(tree, scope) or ())
                    pairs = [dict(zip(names, r if len(names) > 1 else [r], strict=True)) for r in rows]
                    if condition is not None:
                        pairs = [p for p in pairs if value_of(condition, scope | p)]
                    shown = [p[names[0]] if len(names) == 1 else list(p.values()) for p in pairs]
                    for i, pair in enumerate(pairs):
                        n = len(pairs)
                        loop = {"index0": i, "index": i + 1, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n, "previtem": shown[i - 1] if i else UNDEFINED, "nextitem": shown[i + 1] if i + 1 < n else UNDEFINED, "cycle": lambda *xs, i=i: xs[i % len(xs)]}
                        try:
                            self._run(inner, scope | pair | {"loop": loop}, out)
                        except _Break as e:
                            if not e.further:
                                break
                    if not pairs:
                        self._run(other, scope, out)

    def _text(self, body: list, scope: dict) -> str:
        out: list[str] = []
        self._run(body, scope, out)
        return "".join(out)

    def _function(self, names: list[str], defaults: dict, body: list, scope: dict) -> Any:
        """A macro: what its body shows with the arguments by their places or names."""

        def call(*args: Any, **named: Any) -> str:
            given = dict(zip([*names, *defaults], args, strict=False)) | named
            other = {k: value_of(t, scope) for k, t in defaults.items() if k not in given}
            return self._text(body, scope | dict.fromkeys(names, UNDEFINED) | other | given)

        return call
