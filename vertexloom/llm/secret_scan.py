"""Secret scans over whole texts.

Three fixed kinds are found by pattern (assignments, access keys, hex runs).
Beyond them, candidate strings are scanned with a sliding window: for every
character class the Shannon entropy of the window's characters is kept up to
date from incremental counts, and windows above the class's threshold become
``entropy`` spans unless an allow-list suppresses them.

Defined results: a null text is an empty one and has no spans; spans are in
code points, end exclusive.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy runs of 16 or more are just the long enough maximal runs
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Characters, window length and least entropy (bits a character) of each class.
#: Random keys of a narrow alphabet stay below the base64 threshold, so base32
#: and lower-case alphanumerics have their own.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 24, 3.0),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 24, 3.9),
    "base32": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 24, 3.4),
    "lower": (frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 24, 3.4),
}
#: Runs of a class from this length up to its window are scored over their own length.
SHORTEST = 20
RUNS = {name: re.compile("(?<![{0}])[{0}]{{{1},{2}}}(?![{0}])".format(re.escape("".join(sorted(chars))), SHORTEST, width - 1)) for name, (chars, width, _) in CLASSES.items()}
#: Ranges of these classes count only if letters and digits alternate: words, and words with a number at an end, do not.
MIXED = {"base32": re.compile(r"[A-Z][0-9]+[A-Z]|[0-9][A-Z]+[0-9]"), "lower": re.compile(r"[a-z][0-9]+[a-z]|[0-9][a-z]+[0-9]")}
#: Words of a placeholder at the start of a candidate; what follows them is scanned.
FILLER = re.compile(r"(?:(?i:example|sample|placeholder|changeme|dummy)[/_=+-]*)+")
#: Whole candidates that look random and are no secrets: letters of one case with
#: or without separators (words, paths), digits only, UUIDs.
ALLOW = (
    re.compile(r"[A-Z]?[a-z]+(?:[/_=+-]+[A-Z]?[a-z]+)*[/_=+-]*"),
    re.compile(r"[A-Z]+(?:[/_=+-]+[A-Z]+)*[/_=+-]*"),
    re.compile(r"[0-9/_=+-]+"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the fixed kinds, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def high_windows(text: str, chars: frozenset, width: int, least: float) -> list[tuple[int, int]]:
    """Merged ranges of the windows of ``width`` characters, all of them in
    ``chars``, whose Shannon entropy is ``least`` or more.

    The window keeps S, the sum of c log2 c over its counts; a step changes two
    counts, and the entropy is log2(width) - S / width.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, inside, out = 0.0, 0, []
    for at, c in enumerate(text):
        if c not in chars:
            counts, total, inside = {}, 0.0, 0
            continue
        if inside == width:
            old = text[at - width]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
        else:
            inside += 1
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if inside == width and math.log2(width) - total / width >= least - 1e-9:
            start = at + 1 - width
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((start, at + 1))
    return out


def class_ranges(word: str, name: str) -> list[tuple[int, int]]:
    """Ranges of high entropy of one class: windows, and runs too short for a
    window, whose threshold falls with the log of their length."""
    chars, width, least = CLASSES[name]
    found = high_windows(word, chars, width, least)
    for m in RUNS[name].finditer(word):
        n = len(m[0])
        found += [m.span()] * bool(high_windows(m[0], chars, n, least * math.log2(n) / math.log2(width)))
    mixed = MIXED.get(name)
    return [(lo, hi) for lo, hi in found if mixed is None or mixed.search(word, lo, hi)]


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of high entropy within candidate strings, classes merged."""
    out = []
    for m in CANDIDATE.finditer(text):
        start, word = m.start(), m[0]
        if filler := FILLER.match(word):
            start, word = start + filler.end(), word[filler.end() :]
        if len(word) < SHORTEST or any(p.fullmatch(word) for p in ALLOW):
            continue
        found = sorted(r for name in CLASSES for r in class_ranges(word, name))
        merged: list[tuple[int, int]] = []
        for lo, hi in found:
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        out += [("entropy", start + lo, start + hi) for lo, hi in merged]
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with the entropy spans, in order."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, mark: str = "[secret]") -> str:
    """``text`` with each stretch of spans replaced by ``mark``."""
    out, last = [], 0
    end = -1
    for _, s, e in all_spans(text)[1]:
        if s <= end:  # overlaps or touches the stretch that is open
            end = max(end, e)
            last = end
            continue
        out += [text[last:s], mark]
        last = end = e
    return "".join(out) + text[last:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digest, spans = [], []
        for text in batch.column(1):
            base, both = all_spans(text.as_py() or "")
            for kind, column in zip(KINDS, counts):
                column.append(sum(k == kind for k, _, _ in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(both))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per row."""
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: Column) -> Column:
    """``text`` with its secrets replaced by a mark; null stays null."""
    import pandas as pd

    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t))

    clean.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(clean, "string")(text)
