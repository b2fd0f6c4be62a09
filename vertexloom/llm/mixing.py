"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of ``block`` rows.  With target weight w,
a source's block k may run from slot floor(k / w) on and must run before slot
ceil((k + 1) / w); among the released blocks the one with the earliest
deadline takes the slot.  While all sources last, after any number of slots
each source has had less than one block more or less than its weight's share.

Weights are exact fractions with a common denominator A, so the schedule
repeats every A slots: the driver simulates one period, or the phase if that is
shorter, and each block's slot follows from its number.  No weight is rounded,
so a source's deviation stays below one block however long a phase is.  When a source runs out, a new phase begins with the weights
of those left, so no document is dropped or repeated.  The driver sees one row
a source (its number of documents) and plans at most one phase a source.

Defined results: a null source is a source of its own; sources without a
weight share equally in what ``weights`` leaves (all of it if it is null, the
least weight if it leaves none); repeated rows are separate rows; order within
a source is by a hash of doc_id and text.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from heapq import heappop, heappush
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh


#: Rows of a block.
BLOCK = 64
#: Target weights of the registered mix; other sources share equally in the rest.
TARGETS = {"src0": 0.2, "src1": 0.15, "src2": 0.1, "src3": 0.08, "src4": 0.06}


def exact(weight) -> Fraction:
    """The weight as written: 0.3 is 3/10, not the binary number next to it."""
    return Fraction(str(weight)) if isinstance(weight, float) else Fraction(weight)


def shares(weights: dict, denominator: int | None = None) -> dict:
    """The least whole numbers in exactly the proportion of ``weights``.

    denominator: rounds to so many parts instead, at least 1 each (largest
    remainders; ties by name).
    """
    given = {s: exact(w) for s, w in weights.items()}
    if denominator is None:
        scale = lcm(*(w.denominator for w in given.values()))
        whole = {s: int(w * scale) for s, w in given.items()}
    else:
        parts = {s: w / sum(given.values()) * denominator for s, w in given.items()}
        whole = {s: max(1, int(x)) for s, x in parts.items()}
        rest = denominator - sum(whole.values())
        for s in sorted(parts, key=lambda s: (int(parts[s]) - parts[s], s is None, s or ""))[: max(0, rest)]:
            whole[s] += 1
    common = gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def period(counts: dict, slots: int | None = None) -> list:
    """The source that has each slot of one period of sum(counts) slots, or of
    its first ``slots``."""
    total, out, done = sum(counts.values()), [], dict.fromkeys(counts, 0)
    waiting, ready = [(0, s is None, s or "", s) for s in sorted(counts, key=lambda s: (s is None, s or ""))], []
    for slot in range(total if slots is None else min(slots, total)):
        while waiting and waiting[0][0] <= slot:
            _, last, name, s = heappop(waiting)
            heappush(ready, (-(-(done[s] + 1) * total // counts[s]), last, name, s))
        _, last, name, s = heappop(ready)
        out.append(s)
        done[s] += 1
        heappush(waiting, (done[s] * total // counts[s], last, name, s))
    return out


def phases(blocks: dict, weights: dict, denominator: int | None = None) -> list[tuple]:
    """``(source, phase, first block, last block + 1, blocks a period, slots a
    period, first slot, slots of its blocks within a period)``."""
    left, used, at, out, number = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, [], 0
    while left:
        counts = shares({s: weights[s] for s in left}, denominator and max(denominator, len(left)))
        total = sum(counts.values())
        # a source's last block runs before its deadline, so the phase is over by the first of these
        plan = period(counts, min(-(-n * total // counts[s]) for s, n in left.items()))
        places: dict = {s: [] for s in counts}
        for i, s in enumerate(plan):
            places[s].append(i)
        length = len(plan)
        whole = length == total
        slot_of = lambda s, k: k // counts[s] * length + places[s][k % counts[s]]
        end = min(slot_of(s, n - 1) for s, n in left.items() if whole or n <= len(places[s])) + 1  # a source runs out
        for s in list(left):
            n = end // length * len(places[s]) + bisect_left(places[s], end % length)
            if n:
                out.append((s, number, used[s], used[s] + n, len(places[s]), length, at, places[s]))
            used[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at += end
        number += 1
    return out


def mix_sources(docs: DataFrame, *, weights: dict | None = None, block: int = BLOCK, sub_buckets: int = 256, denominator: int | None = None, names: tuple[str, ...] = ("block", "slot", "position")) -> DataFrame:
    """``docs`` with the columns block (of its source), slot and position.

    Positions order the mixed stream: slot * block + place within the block.
    ``names`` names the three columns; they must not be columns of ``docs``.
    denominator: rounds the weights to so many parts (null: exact weights).
    """
    spark = docs.sparkSession
    sub, number, before, key, first, last, a, length, start, places, s = fresh(docs, "_sub", "_number", "_before", "_key", "_first", "_last", "_a", "_length", "_start", "_places", "_s")
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))]
    # null sources get a key of their own; a prefix keeps it apart from any name
    rows = docs.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn(sub, F.pmod(F.xxhash64("doc_id", "text"), F.lit(sub_buckets)))
    counts = rows.groupBy(key, sub).agg(F.count(F.lit(1)).alias(number))
    per_source = {(r[0][1:] if r[0][0] == "s" else None): r[1] for r in counts.groupBy(key).agg(F.sum(number)).collect()}
    given = {x: exact(w) for x, w in (weights or {}).items()}
    bare = [x for x in per_source if x not in given]
    if bare:
        spare = max(Fraction(0), 1 - sum(given.values())) / len(bare)
        given |= dict.fromkeys(bare, spare or min([w for w in given.values() if w > 0], default=Fraction(1)))
    bad = [x for x in per_source if not given[x] > 0]
    if bad:
        raise ValueError(f"target weights must be positive: {bad}")
    plan = phases({x: -(-n // block) for x, n in per_source.items()}, {x: given[x] for x in per_source}, denominator)
    table = spark.createDataFrame([("n" if x is None else "s" + x, *rest) for x, *rest in ((p[0], *p[2:]) for p in plan)], f"{s} string, {first} long, {last} long, {a} long, {length} long, {start} long, {places} array<int>")
    starts = counts.withColumn(before, F.coalesce(F.sum(number).over(Window.partitionBy(key).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(number)
    numbered = rows.withColumn(number, F.row_number().over(Window.partitionBy(key, sub).orderBy(*order)) - 1).join(starts, [key, sub])
    block_name, slot_name, position_name = names
    numbered = numbered.withColumn(number, F.col(before) + F.col(number)).withColumn(block_name, F.floor(F.col(number) / block).cast("long"))
    # at most a row a source and phase: phases are as many as sources, and the places of a phase are one period at most, or its blocks if fewer
    placed = numbered.join(F.broadcast(table), (F.col(key) == F.col(s)) & (F.col(block_name) >= F.col(first)) & (F.col(block_name) < F.col(last)))
    k = F.col(block_name) - F.col(first)
    slot = F.col(start) + F.floor(k / F.col(a)) * F.col(length) + F.element_at(F.col(places), (F.pmod(k, F.col(a)) + 1).cast("int"))
    placed = placed.withColumn(slot_name, slot.cast("long")).withColumn(position_name, (F.col(slot_name) * block + F.pmod(F.col(number), F.lit(block))).cast("long"))
    return placed.select(*docs.columns, *names)
