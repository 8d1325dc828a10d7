"""Character classes and patterns in Java's dialect, with the meaning that ECMAScript gives them."""

from __future__ import annotations

import re

#: ECMAScript white space, for use inside a class; punctuation of BERT (ASCII marks and Unicode P).
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
PUNCT = r"\p{P}!-/:-@\[-`{-~"
#: Fixed value: the byte-level split pattern.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
#: Marks the edges of matches while a text is cut, unless the text holds it.
MARK = "\x01"


def literal(text: str) -> str:
    """A pattern that matches the text itself, in Java and in RE2."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def replacement(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def to_java(pattern: str) -> str:
    r"""An ECMAScript pattern in Java: \s and \S get Unicode's white space, a bare [ within a class is escaped."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS if inside else f"[{WS}]")
            elif nxt == "S":
                out.append(f"&&[^{WS}]" if inside else f"[^{WS}]")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if c == "[":
            out.append("\\[" if inside else "[")
            inside = True
        else:
            if c == "]":
                inside = False
            out.append(c)
        i += 1
    return "".join(out)
