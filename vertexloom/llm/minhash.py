"""MinHash near-dedup by ProbMinHash.

Shingles of five words are weighted by how often they occur.  Every shingle
starts a Poisson process whose rate is its weight; arrivals fall on random
registers, and a register keeps the shingle that arrives first.  A shingle's
process stops once it is later than all registers (early termination).  Two
texts agree in a register with probability J_P, the probability Jaccard
similarity, which is the Jaccard similarity where no shingle repeats.

Texts with equal words are one node.  Signatures are cut into bands; each band
bucket links its members to its smallest member, and these pairs are verified
exactly on the shingles of the whole texts.  A bucket whose members then still
belong to several components is compared in blocks, to which members bring
signature and shingles: pairs of different components are verified there, and
what leaves a block is which components it joined, never a pair.  So no link
between different texts of a bucket is lost and yet copies are not expanded.

Defined results: a null or empty text, or one of white space, has no words and
is alone in its class (class_id: its doc_id); a text of 1 to 4 words has one
shingle.  class_id is the smallest doc_id of the class, null if all are null.
A class keeps its first row by doc_id (nulls last), then by the digest of its
text; rows equal in both are all marked kept by ``near_duplicates`` and
``keep_one`` leaves one of them, whichever.  Rows that share a doc_id and have
other texts are other documents.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, fresh, hot_join, materialize, slices, small_batches
from .textvec import U, Words, mix, words_of

GOLDEN = U(0x9E3779B97F4A7C15)
#: Shingles whose processes advance together.
ARRIVING = 1 << 18
#: Shingles' bytes of one side of a block comparison, about.
BLOCK_BYTES = 8 << 20

Weighted = tuple[np.ndarray, np.ndarray]


def prob_minhash(sets: list[Weighted], registers: int, seed: int = 1) -> np.ndarray:
    """Signatures (uint32, a row a set) of weighted sets (hashes, weights).

    Sets of like size advance together, since few shingles need many rounds.
    """
    out = np.zeros((len(sets), registers), np.uint32)
    sizes = np.array([len(h) for h, _ in sets])
    order = np.argsort(sizes, kind="stable")
    for at in order[sizes[order] == 1]:  # one shingle arrives first everywhere
        out[at] = _label(sets[at][0])
    order = order[sizes[order] > 1]
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[order[lo:]]), ARRIVING, side="right")))
        group = [sets[at] for at in order[lo:hi]]
        time, kept = np.full((hi - lo, registers), np.inf), np.zeros((hi - lo, registers), np.uint32)
        if hi - lo > 1:
            _arrivals(group, time, kept, seed)
        else:  # it may be a long text: part by part; a later part stops sooner
            ((h, w),) = group
            for at in range(0, len(h), ARRIVING):
                _arrivals([(h[at : at + ARRIVING], w[at : at + ARRIVING])], time, kept, seed)
        out[order[lo:hi]] = kept
        lo = hi
    return out


def _label(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + GOLDEN) >> U(32)).astype(np.uint32)


def _arrivals(sets: list[Weighted], time: np.ndarray, kept: np.ndarray, seed: int) -> None:
    """Lets the shingles of ``sets`` arrive at registers that hold ``kept`` since ``time``.

    All processes advance together, one arrival a round.
    """
    n, registers = time.shape
    hashes = np.concatenate([h for h, _ in sets])
    rates = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h, _ in sets])
    flat_time, flat_kept = time.reshape(-1), kept.reshape(-1)
    state = mix(hashes ^ mix(np.array([seed], U)))
    label = _label(hashes)
    now = np.zeros(len(hashes))
    last = time.max(1)
    while len(now):
        state = mix(state + GOLDEN)
        uniform = ((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        now = now - np.log(uniform) / rates
        on = now < last[owner]
        state, now, owner, rates, label = state[on], now[on], owner[on], rates[on], label[on]
        cell = owner * np.int64(registers) + (mix(state) % U(registers)).astype(np.int64)
        np.minimum.at(flat_time, cell, now)
        first = flat_time[cell] == now
        flat_kept[cell[first]] = label[first]
        active = np.unique(owner)
        last[active] = time[active].max(1)


def prob_jaccard(a: Weighted, b: Weighted) -> float:
    """Exact J_P of two weighted sets (ascending hashes, weights): the sum over
    shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    shared, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    wa, wb = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    end = np.searchsorted(ratio, ratio, side="right")  # of the shingles whose ratio is at most mine
    below = np.concatenate([[0.0], np.cumsum(wb)])[end] + only_b
    above = wa.sum() - np.concatenate([[0.0], np.cumsum(wa)])[end] + only_a
    return float((1.0 / (above / wa + below / wb)).sum())


def weighted_shingles(texts: list[str | None], k: int) -> list[Weighted]:
    return Words([words_of(t) for t in texts]).shingles(k)


def _signer(k: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            content, sets, some = [None] * len(texts), [], []
            for lo, hi in slices(texts):
                words = [words_of(t) for t in texts[lo:hi]]
                sets += [s for s in Words(words).shingles(k) if len(s[0])]
                for i, w in enumerate(words, lo):
                    if w:
                        content[i] = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        some.append(i)
            column: list = [None] * len(texts)
            for i, s in zip(some, prob_minhash(sets, registers)):
                column[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary()), pa.array(column, pa.binary())], names=["doc_id", "digest", "content", "signature"])

    return run


def _shingler(k: int):
    """Ascending shingle hashes of each text, and their weights (null: all 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                sets = weighted_shingles(texts[lo:hi], k)
                weights = [w.astype(np.int64).tobytes() if (w > 1).any() else None for _, w in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array(weights, pa.binary())], names=["node", "shingles", "weights"])

    return run


def _set(shingles: bytes, weights: bytes | None) -> Weighted:
    h = np.frombuffer(shingles, U)
    return h, np.frombuffer(weights, np.int64) if weights is not None else np.ones(len(h), np.int64)


def _bander(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, -1)[:, : bands * rows].reshape(n, bands, rows).astype(U)
            total = np.tile(np.arange(1, bands + 1, dtype=U), (n, 1))
            for j in range(rows):
                total = mix(total + s[:, :, j] * GOLDEN)
            yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64).ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["band", "t", "node"])

    return run


def _agreement(least: float):
    """Pairs (a, b, signatures) whose signatures agree in ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(batch), -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least)) if len(batch) else batch.select(["a", "b"])

    return run


def _verifier(threshold: float):
    """Pairs (a, b, their shingles and weights) whose J_P is the threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(_set(x, v), _set(y, w), threshold) for x, v, y, w in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def similar(a: Weighted, b: Weighted, threshold: float) -> bool:
    return prob_jaccard(a, b) >= threshold - 1e-12


class Block:
    """Members of two parts of a bucket, and which components they join."""

    def __init__(self, members: pa.StructArray, threshold: float):
        field = lambda name: members.field(name)
        self.component = field("component").to_numpy()
        self.label = self.component.copy()
        self.side = field("blk").to_numpy()
        self.signature = np.frombuffer(b"".join(field("signature").to_pylist()), np.uint32).reshape(len(self.side), -1)
        self.sets = [_set(h, w) for h, w in zip(field("shingles").to_pylist(), field("weights").to_pylist())]
        self.plain = np.array([w is None for w in field("weights").to_pylist()])
        self.threshold = threshold

    def join(self, x: int, y: int) -> None:
        old, new = self.label[x], self.label[y]
        self.label[self.label == max(old, new)] = min(old, new)

    def links(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` x links with, by exact J_P."""
        out = np.zeros(len(others), bool)
        mine, plain = self.sets[x][0], self.plain[others] & self.plain[x]
        if plain.any():  # J_P is the Jaccard similarity of the sets: all at once
            sets = [self.sets[y][0] for y in others[plain]]
            sizes = np.array([len(h) for h in sets])
            h = np.concatenate(sets)
            place = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
            shared = np.add.reduceat(mine[place] == h, np.cumsum(sizes) - sizes, dtype=np.int64)
            out[plain] = shared / (sizes + len(mine) - shared) >= self.threshold - 1e-12
        for i in np.flatnonzero(~plain):
            out[i] = similar(self.sets[x], self.sets[others[i]], self.threshold)
        return out

    def compare(self, x: int, others: np.ndarray, share: np.ndarray) -> None:
        """Verifies x with ``others`` as long as they are of other components,
        the likeliest first alone, as it often settles the rest."""
        order = np.argsort(-share, kind="stable")
        others, many = others[order], 1
        while len(others := others[self.label[others] != self.label[x]]):
            part, others = others[:many], others[many:]
            for y in part[self.links(x, part)]:
                if self.label[x] != self.label[y]:
                    self.join(x, y)
            many = 64


def _block_links(threshold: float, least: float, bands: int, rows: int):
    """Pairs of components that pairs of members of a block join.

    A pair is verified if its signatures agree in ``least`` or more, in the
    first band that its texts share and in no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for t, i, j, members in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                block = Block(members.values, threshold)
                s, right = block.signature, np.flatnonzero(block.side == j)
                for x in np.flatnonzero(block.side == i):
                    other = right[(block.label[right] != block.label[x]) & ((right > x) if i == j else True)]
                    same = s[other] == s[x]
                    share = same.mean(1)
                    good = share >= least
                    same, other, share = same[good, : bands * rows], other[good], share[good]
                    here = same.reshape(len(other), bands, rows).all(2).argmax(1) == t
                    if here.any():
                        block.compare(x, other[here], share[here])
                moved = block.label != block.component
                out_a.append(block.label[moved])
                out_b.append(block.component[moved])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_a, out_b))
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5, registers: int = 256, slack: float = 0.08, block: int = 512, hot: int = 1000, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``doc_id, class_id, kept, digest`` for each row of ``docs``; digest is
    the md5 of its text.

    A class is a set of documents linked by pairs with J_P >= threshold that
    meet in a band.  The first bands x rows registers make the bands: a pair at
    J_P 0.8 meets in some band with probability 0.99995.  slack: pairs whose
    signatures agree in less than threshold - slack of all registers are not
    verified (3.2 standard deviations at J_P 0.8).  block: most rows of one
    side of a block comparison.  hot: buckets of more members (or of more than
    a 2000th of all) are dealt to several tasks.  broadcast_ids: documents to
    verify are picked out of ``docs`` by a broadcast of their digests up to
    this many, beyond it by a shuffle join.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text")
    signed = materialize(source.mapInArrow(_signer(k, registers), "doc_id long, digest binary, content binary, signature binary"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    # equal content has equal signatures; a node's number is fixed once it is written
    reps = signed.where("content is not null").groupBy("content").agg(F.min(place).alias("place"), F.first("signature").alias("signature"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()))
    banded = reps.select("node", "signature").mapInArrow(_bander(bands, rows), "band long, t int, node long")
    leaders = materialize(banded.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = materialize(hot_join(banded, leaders, "band", "size", max(hot, reps.count() // 2000), "node"))

    wanted = members.select("node").distinct().join(reps.select("node", F.col("place.digest").alias("digest")), "node")
    wanted = materialize(wanted)
    if wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)
    texts = source.select("digest", "text").join(wanted, "digest").select("node", "text").dropDuplicates(["node"])
    sets = materialize(texts.mapInArrow(_shingler(k), "node long, shingles binary, weights binary"))

    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = reps.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    second = reps.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    likely = materialize(stars.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(_agreement(threshold - slack), "a long, b long"))
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("ha"), F.col("weights").alias("wa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("hb"), F.col("weights").alias("wb"))
    both = likely.join(first, "a").join(second, "b").select("a", "b", "ha", "wa", "hb", "wb")
    component = materialize(connected_components(both.mapInArrow(_verifier(threshold), "a long, b long")))

    joined = connected_components(_open_blocks(members, component, reps, sets, block).mapInArrow(_block_links(threshold, threshold - slack, bands, rows), "a long, b long"))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    linked = component.unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()
    classes = linked.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("class"))
    named = materialize(classes.join(reps.select("node", "place"), "node"))
    keepers = materialize(named.groupBy("class").agg(F.min("place").alias("keeper"), F.count(F.lit(1)).alias("n")))
    chosen = hot_join(named.select("class", "node"), keepers, "class", "n", max(hot, named.count() // 2000), "node").select("node", "keeper")
    nodes = reps.select("content", "node", "place").join(chosen, "node", "left").select("content", F.coalesce("keeper", "place").alias("keeper"))
    found = signed.select("doc_id", "digest", "content").join(nodes, "content", "left")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("digest") == F.col("keeper.digest"))
    wordless = F.col("content").isNull()
    return found.select("doc_id", F.when(wordless, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"), (wordless | is_keeper).alias("kept"), "digest")


def _open_blocks(members: DataFrame, component: DataFrame, reps: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """``t, i, j, rows``: the pairs of blocks of buckets with several components.

    A bucket of two is decided by its star.  Members of a bucket's most
    frequent component are not compared with one another: only the other
    members are, among themselves and with these.
    """
    sized = sets.select("node", F.octet_length("shingles").cast("long").alias("bytes"))
    placed = members.where("size > 2").join(sized, "node").join(component, "node", "left")
    placed = materialize(placed.select("band", "t", "size", "node", "bytes", F.coalesce("component", "node").alias("component")))
    counted = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    mixed = counted.groupBy("band").agg(F.max(F.struct("n", "bytes", "component")).alias("main"), F.sum("n").alias("total"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES)).cast("int")
    n, size = F.col("main.n"), F.col("main.bytes")
    mixed = materialize(mixed.select("band", F.col("main.component").alias("main"), blocks(n, size).alias("mains"), blocks(F.col("total") - n, F.col("bytes") - size).alias("others"), "total"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int")
    copies = F.sequence(F.lit(0), F.ceil(F.col("total") / block).cast("int") - 1)
    open_ = placed.withColumn("salt", salt).join(mixed.withColumn("salt", F.explode(copies)), ["band", "salt"]).drop("salt")
    # blocks of the other members come first, then those of the main component
    is_main = F.col("component") == F.col("main")
    open_ = open_.withColumn("blk", F.when(is_main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("band", "t", "node", "component", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    rich = open_.join(sets.join(reps.select("node", "signature"), "node"), "node")
    return rich.groupBy("band", "t", "i", "j").agg(F.collect_list(F.struct("component", "blk", "signature", "shingles", "weights")).alias("rows")).select("t", "i", "j", "rows")


def keep_one(docs: DataFrame, classes: DataFrame, *, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows that are not kept by their class, and one of
    those that are equal in doc_id and text; all rows with a null text stay."""
    classes = materialize(classes.groupBy("doc_id", "digest", "kept").count())
    name, key = fresh(docs, "_name", "_key")
    told = lambda rows: F.broadcast(rows) if rows.count() <= broadcast_ids else rows
    pick = lambda rows: told(rows.select(F.col("doc_id").alias(name), F.col("digest").alias(key)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (text_digest(F.col("text")) == F.col(key))
    left = docs.join(pick(classes.where("not kept")), same, "left_anti")
    repeated = classes.where("kept and count > 1")
    if repeated.isEmpty():
        return left
    again = pick(repeated)
    first = left.join(again, same, "left_semi").withColumn(key, text_digest(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return left.join(again, same, "left_anti").unionByName(first)
