"""The printable alphabet of byte-level models: one character for each of the 256 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alphabet() -> list[str]:
    """Printable Latin-1 stands for itself; the others take the characters from U+0100 on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, new = [], 256
    for b in range(256):
        out.append(chr(b if b in kept else new))
        new += b not in kept
    return out


LATIN = "".join(map(chr, range(256)))
ALPHABET = "".join(alphabet())


def to_alphabet(c: Column) -> Column:
    """UTF-8 bytes as characters of the alphabet."""
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), LATIN, ALPHABET)


def from_alphabet(c: Column) -> Column:
    """Back to text; characters outside the alphabet vanish, malformed UTF-8 is an error."""
    known = F.regexp_replace(c, "[^" + "".join(f"\\x{{{ord(x):x}}}" for x in ALPHABET) + "]", "")
    return F.decode(F.encode(F.translate(known, ALPHABET, LATIN), "ISO-8859-1"), "UTF-8")
