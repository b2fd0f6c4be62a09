"""Case- and accent-insensitive matching, and hashes and names of strings."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _table() -> tuple[str, str]:
    """Lower-case letters with marks and their base letters, then combining
    marks (dropped).  Literals and columns are folded by this one table; it
    holds every character of the basic plane that decomposes to one character
    and marks.  Hangul syllables are letters of their own."""
    plain, pairs, marks = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)), [], []
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]):
        if unicodedata.combining(c):
            marks.append(c)
        elif len(base := plain(c)) == 1 and base != c:
            pairs.append((c, base))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@cache
def _map() -> dict[int, str | None]:
    letters, bases = _table()
    return {ord(c): bases[i] if i < len(bases) else None for i, c in enumerate(letters)}


def fold(text: str) -> str:
    """``text`` in lower case without diacritics (for literals)."""
    return text.lower().translate(_map())


def fold_column(text: Column) -> Column:
    """The same for a column, by built-in functions."""
    return F.translate(F.lower(text), *_table())


def like(folded: Column, pattern: str) -> Column:
    """Whole-string match of a folded column; ``*`` is any text, ``?`` one
    character, and a backslash takes the next character literally."""
    out, wild, at = [], False, 0
    plain = []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            c = fold(pattern[at])
            plain.append(c)
            out.append("\\" + c if c in "%_\\" else c)
        elif c in "*?":
            wild = True
            out.append("%" if c == "*" else "_")
        else:
            c = fold(c)
            plain.append(c)
            out.append("\\" + c if c in ("%", "_", "\\") else c)
        at += 1
    return folded.like("".join(out)) if wild else folded == "".join(plain)


def fnv1a(text: str) -> str:
    """64-bit FNV-1a hash of the UTF-8 bytes as 16 hex digits."""
    h = 14695981039346656037
    for byte in text.encode():
        h = (h ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a_column(text: Column) -> Column:
    """The same for a column.  64-bit wrapping products are no built-in, so
    this one runs as an Arrow-batched function; use xxhash64 where the value
    need not equal stored ones."""
    import numpy as np
    import pandas as pd

    def run(values):
        # all values advance together, a byte at a time, the longest last
        data = [v.encode() if isinstance(v, str) else b"" for v in values]
        lengths = np.array([len(x) for x in data], np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(data), np.uint8)
        h, many = np.full(len(data), 14695981039346656037, np.uint64), len(data)
        for at in range(int(lengths.max(initial=0))):
            while lengths[order[many - 1]] <= at:
                many -= 1
            on = order[:many]
            h[on] = (h[on] ^ flat[starts[on] + at]) * np.uint64(1099511628211)
        return pd.Series([None if v is None else f"{x:016x}" for v, x in zip(values, h.tolist())], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def safe_component(text: Column) -> Column:
    """A file-name component: other characters than letters, digits and
    ``-_.`` become ``_``; at most 80 characters."""
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_.-]", "_"), 1, 80)
