"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its word vector (none for rare words) and the mean of its
hashed character gram vectors.  Windows of ``WIDTH`` words, half a window apart, run through
a gated recurrent unit in either direction; attention pools the states, and a
window's logit comes from the pooled state.  Every window of every text is
scored; a document's score is a sigmoid of the weighted sum of its highest,
third and fifth highest window logits, so that repeated weak signs count.

Training is Adam in numpy with the gradient written out.  A label says that a
document has a toxic window, not which one: every epoch takes each document's
highest window under the current model (and a random one of clean documents).
The weights over windows are fitted on a fifth of the sample that the network
does not see.

A long text is scored piece by piece, with the windows of the whole.

Defined results: a null text is an empty one, and a text without words has the
score of a window without words.  Rows are scored one by one, whatever their
ids.  Without usable labels every score is 0.5 or near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fitted, held_out, labelled_sample
from .shared import slices, small_batches
from .textvec import U, Words, words_of

WIDTH, STEP = 32, 16
CHARS = 1 << 15
#: Words and character grams that fewer training texts have than this get no vector.
LEAST_TEXTS = 5
#: Bytes of a character gram, and odd multipliers of its hash.
GRAM, MULTIPLIERS = 5, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
DIM_WORD, DIM_CHAR, HIDDEN = 12, 8, 10
#: Window logits count up to this size.
CAP = 8.0
#: How much a toxic text may weigh against a clean one when window weights are
#: fitted: the first of these at which so many clean texts are left alone.
LEANS, LEFT_ALONE = (5.0, 3.0, 2.0, 1.0), 0.97
#: Windows that run through the network at once.
BATCH = 4096

Model = dict[str, np.ndarray]


def fresh_model(seed: int, vocabulary: np.ndarray) -> Model:
    rng = np.random.default_rng(seed)
    d, h = DIM_WORD + DIM_CHAR, HIDDEN
    draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    model = {"vocabulary": vocabulary, "top": np.array([1, 0, 0, 0], np.float64), "word": draw(len(vocabulary) + 1, DIM_WORD), "char": draw(CHARS, DIM_CHAR), "a": draw(2 * h), "o": draw(2 * h), "c": np.zeros(1, np.float32)}
    for side in "fb":  # input and recurrent weights of update gate, reset gate and candidate
        model |= {f"W{side}": draw(d, 3 * h, scale=d**-0.5), f"U{side}": draw(h, 3 * h, scale=h**-0.5), f"b{side}": np.zeros(3 * h, np.float32)}
    return model


class Tokens:
    """Word ids, and gram ids of each word, of a batch of texts."""

    def __init__(self, texts: list[str | None], vocabulary: np.ndarray):
        w = Words([words_of(t) for t in texts])
        self.first, self.counts, self.doc, self.hashes = w.first, w.counts, w.doc, w.hashes
        self.word = np.zeros(len(w.hashes), np.int64)
        if len(vocabulary):
            place = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
            self.word = np.where(vocabulary[place] == w.hashes, place + 1, 0)
        data, starts, lengths = w.data, w.starts, w.lengths
        # every word has a gram for each of its bytes: from the byte before it on
        total = int(lengths.sum())
        begin = np.cumsum(lengths) - lengths
        at = np.arange(total) - np.repeat(begin, lengths) + np.repeat(starts, lengths)
        left = np.repeat(lengths, lengths) - (np.arange(total) - np.repeat(begin, lengths))
        code = data[at - 1].astype(np.uint32) * np.uint32(MULTIPLIERS[0])
        for j in range(GRAM - 1):  # bytes past the word's end count as none
            byte = np.where(j <= left, data[np.minimum(at + j, len(data) - 1)], 0).astype(np.uint32)
            code = (code ^ (code >> np.uint32(13))) * np.uint32(MULTIPLIERS[1]) + byte * np.uint32(MULTIPLIERS[2])
        self.gram = ((code ^ (code >> np.uint32(15))) & np.uint32(CHARS - 1)).astype(np.int32)
        self.begin, self.lengths = begin, lengths

    def inputs(self, model: Model, lo: int, hi: int) -> np.ndarray:
        """Input vectors of words lo..hi-1."""
        if hi <= lo:
            return np.zeros((0, DIM_WORD + DIM_CHAR), np.float32)
        t0 = self.begin[lo]
        t1 = self.begin[hi - 1] + self.lengths[hi - 1]
        chars = np.add.reduceat(model["char"][self.gram[t0:t1]], self.begin[lo:hi] - t0, axis=0) / self.lengths[lo:hi, None].astype(np.float32)
        return np.concatenate([model["word"][self.word[lo:hi]], chars], axis=1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index, first word and number of words of every window: they
        start ``STEP`` words apart and the last reaches the text's end; a text
        without words has one window without words."""
        n = np.maximum(1, -(-np.maximum(self.counts - WIDTH, 0) // STEP) + 1)
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = k * STEP
        return doc, self.first[doc] + begin, np.minimum(WIDTH, self.counts[doc] - begin)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: Model, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows.  x: input vectors; at: their row for each window and
    step; mask: 1 where there is a word.  keep: also what backward needs."""
    n, steps, h = len(at), at.shape[1], HIDDEN
    states = np.zeros((steps, n, 2 * h), np.float32)
    saved = {}
    for s, side in enumerate("fb"):
        gates = x @ model[f"W{side}"] + model[f"b{side}"]
        u, cur = model[f"U{side}"], np.zeros((n, h), np.float32)
        trace = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = gates[at[:, t]]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + cur @ u[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(g[:, 2 * h :] + (r * cur) @ u[:, 2 * h :])
            live = mask[:, t, None]
            new = cur + live * z * (cand - cur)
            if keep:
                trace.append((t, cur, z, r, cand, live))
            cur = new
            states[t, :, s * h : (s + 1) * h] = cur
        saved[side] = trace
    e = states @ model["a"]
    e = np.where(mask.T > 0, e, -1e9)
    w = np.exp(e - e.max(0)) * mask.T
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = (w[:, :, None] * states).sum(0)
    logits = pooled @ model["o"] + model["c"]
    return (logits, (states, saved, w, pooled)) if keep else logits


def backward(model: Model, x, at, mask, kept, d_logit) -> tuple[Model, np.ndarray]:
    """Gradients of the weights, and of the input vectors."""
    states, saved, w, pooled = kept
    h = HIDDEN
    grad = {k: np.zeros_like(v) for k, v in model.items() if k not in ("word", "char", "vocabulary", "top")}
    grad["o"] = pooled.T @ d_logit
    grad["c"] = d_logit.sum(keepdims=True)
    d_pool = d_logit[:, None] * model["o"]
    d_w = (states * d_pool).sum(2)
    d_e = w * (d_w - (w * d_w).sum(0))
    d_states = w[:, :, None] * d_pool + d_e[:, :, None] * model["a"]
    grad["a"] = np.einsum("tn,tnh->h", d_e, states)
    d_x = np.zeros_like(x)
    for s, side in enumerate("fb"):
        u, wt = model[f"U{side}"], model[f"W{side}"]
        d_gates = np.zeros((len(x), 3 * h), np.float32)
        d_next = np.zeros((len(at), h), np.float32)
        for t, cur, z, r, cand, live in reversed(saved[side]):
            d = d_next + d_states[t, :, s * h : (s + 1) * h]
            d_cand = d * live * z * (1 - cand * cand)
            d_z = d * live * (cand - cur) * z * (1 - z)
            d_rc = d_cand @ u[:, 2 * h :].T
            d_r = d_rc * cur * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], 1)
            d_next = d * (1 - live * z) + d_rc * r + d_zr @ u[:, : 2 * h].T
            grad[f"U{side}"][:, : 2 * h] += cur.T @ d_zr
            grad[f"U{side}"][:, 2 * h :] += (r * cur).T @ d_cand
            np.add.at(d_gates, at[:, t], np.concatenate([d_zr, d_cand], 1))
        grad[f"W{side}"] += x.T @ d_gates
        grad[f"b{side}"] += d_gates.sum(0)
        d_x += d_gates @ wt.T
    return grad, d_x


def _placed(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WIDTH)
    mask = step < count[:, None]
    return np.where(mask, first[:, None] + step, 0), mask.astype(np.float32)


def window_logits(model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Text index and logit of every window, some thousands at a time."""
    doc, first, count = tokens.windows()
    out = np.empty(len(doc), np.float32)
    for lo in range(0, len(doc), BATCH):
        f, c = first[lo : lo + BATCH], count[lo : lo + BATCH]
        w0, w1 = int(f.min()), int((f + c).max())
        x = tokens.inputs(model, w0, w1)
        if not len(x):
            x = np.zeros((1, DIM_WORD + DIM_CHAR), np.float32)
        at, mask = _placed(f - w0, c)
        steps = max(1, int(c.max()))
        out[lo : lo + BATCH] = forward(model, x, at[:, :steps], mask[:, :steps])
    return doc, out


def highest(doc: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts: its highest, third and fifth highest window logit
    (its lowest where it has fewer windows), and 1."""
    order = np.lexsort((-logit, doc))
    doc, logit = doc[order], np.clip(logit[order], -CAP, CAP)
    begin = np.searchsorted(doc, np.arange(n))
    end = np.searchsorted(doc, np.arange(n), side="right") - 1
    out = np.ones((n, 4), np.float64)
    for column, k in enumerate((0, 2, 4)):
        out[:, column] = logit[np.minimum(begin + k, end)]
    return out


#: Bytes of a text that are scored at once.
PIECE = 1 << 18


def pieces(words: str) -> Iterator[str]:
    """``words`` (joined by single spaces) in parts whose windows are together
    just the windows of the whole."""
    data = words.encode("utf-8", "surrogatepass")
    if len(data) <= PIECE:
        yield words
        return
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    at, n = 0, len(ends)
    while True:
        begin = int(ends[at - 1]) + 1 if at else 0
        steps = max(1, (int(np.searchsorted(ends, begin + PIECE)) - at - WIDTH) // STEP + 1)
        last = at + WIDTH + STEP * (steps - 1)  # of so many full windows
        yield data[begin : int(ends[min(last, n) - 1])].decode("utf-8", "surrogatepass")
        if last >= n:
            return
        at += steps * STEP


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for lo, hi in slices(texts):
        parts = [(i, p) for i, t in enumerate(texts[lo:hi]) for p in pieces(words_of(t))]
        docs, logits, group, size = [], [], [], 0
        for k, (i, part) in enumerate(parts):
            group.append((i, part))
            size += len(part)
            if size >= PIECE or k == len(parts) - 1:
                doc, logit = window_logits(model, Tokens([p for _, p in group], model["vocabulary"]))
                docs.append(np.array([i for i, _ in group])[doc])
                logits.append(logit)
                group, size = [], 0
        out[lo:hi] = sigmoid(highest(np.concatenate(docs), np.concatenate(logits), hi - lo) @ model["top"])
    return out


def fit_top(x: np.ndarray, y: np.ndarray, lean: float = 1.0) -> np.ndarray:
    """Logistic weights over the highest windows, by gradient descent with a
    small ridge towards the highest window alone.  lean: how much a toxic text
    weighs against a clean one."""
    start = np.array([1.0, 0, 0, 0])
    w, weight = start.copy(), np.where(y > 0, lean, 1.0)
    weight = weight / weight.sum()
    for _ in range(3000):
        w -= 0.02 * (x.T @ (weight * (sigmoid(x @ w) - y)) + 0.002 * (w - start))
    return w


def lean_top(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``fit_top`` by the strongest of ``LEANS`` that leaves clean texts alone."""
    for lean in LEANS:
        w = fit_top(x, y, lean)
        if (x[y == 0] @ w < 0).mean() >= LEFT_ALONE:
            break
    return w


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def apply(self, model: Model, grad: Model, rows: dict[str, np.ndarray]) -> None:
        """rows: for a table, the rows that ``grad`` has gradients of."""
        self.step += 1
        fix = (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, g in grad.items():
            at = rows.get(k, slice(None))
            m, v = self.m.setdefault(k, np.zeros_like(model[k])), self.v.setdefault(k, np.zeros_like(model[k]))
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            model[k][at] -= self.rate * fix * m[at] / (np.sqrt(v[at]) + 1e-8)


def known(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ascending ids that at least ``LEAST_TEXTS`` texts have."""
    order = np.lexsort((doc, ids))
    ids, doc = ids[order], doc[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
    values, counts = np.unique(ids[new], return_counts=True)
    return values[counts >= LEAST_TEXTS]


def train(sample: pd.DataFrame, *, epochs: int = 8, batch: int = 128, rate: float = 0.01, drop: float = 0.3, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    nothing = np.zeros(0, U)
    if sample.empty or sample.y.nunique() < 2:
        return fresh_model(seed, nothing) | {"top": np.zeros(4)}
    apart = np.arange(len(sample)) % 5 == 4
    tops = sample[apart]
    sample = sample[~apart] if sample.y[~apart].nunique() == 2 else sample
    every = Tokens(sample.text.tolist(), nothing)
    model = fresh_model(seed, known(every.hashes, every.doc))
    tokens, y = Tokens(sample.text.tolist(), model["vocabulary"]), sample.y.to_numpy().astype(np.float32)
    may_char = np.zeros(CHARS, bool)
    may_char[known(tokens.gram, np.repeat(tokens.doc, tokens.lengths))] = True
    model["char"][~may_char] = 0
    model["word"][0] = 0
    doc, first, count = tokens.windows()
    adam = Adam(rate)
    # clean documents are the many: weigh the classes alike
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    starts = np.searchsorted(doc, np.arange(len(y)))
    sizes = np.diff(np.append(starts, len(doc)))
    for epoch in range(epochs):
        logit = window_logits(model, tokens)[1] if epoch else rng.normal(size=len(doc))
        order = np.lexsort((-logit, doc))
        best = order[starts]
        # in the first epoch, before the model can tell windows apart, all windows of short texts
        pick = [best, (starts + rng.integers(0, sizes))[y == 0]]
        if not epoch:
            pick.append(np.flatnonzero(sizes[doc] <= 4))
        chosen = np.unique(np.concatenate(pick))
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), batch):
            rows = chosen[lo : lo + batch]
            at, mask = _placed(first[rows], count[rows])
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(len(rows), WIDTH)
            x = _inputs_at(tokens, model, used)
            live = rng.random(len(used)) >= drop  # without its word vector a word must do with its characters
            x[:, :DIM_WORD] *= live[:, None]
            logits, kept = forward(model, x, at, mask, keep=True)
            d = (sigmoid(logits) - y[doc[rows]]) * weight[doc[rows]] / len(rows)
            grad, d_x = backward(model, x, at, mask, kept, d.astype(np.float32))
            word_rows, word_grad = _summed(tokens.word[used], d_x[:, :DIM_WORD] * live[:, None])
            lengths = tokens.lengths[used]
            spread = np.repeat(d_x[:, DIM_WORD:] / lengths[:, None], lengths, axis=0)
            char_rows, char_grad = _summed(tokens.gram[_ranges(tokens.begin[used], lengths)], spread)
            word_grad[word_rows == 0] = 0
            char_grad[~may_char[char_rows]] = 0
            adam.apply(model, grad | {"word": word_grad, "char": char_grad}, {"word": word_rows, "char": char_rows})
    if tops.y.nunique() == 2:
        told = window_logits(model, Tokens(tops.text.tolist(), model["vocabulary"]))
        model["top"] = lean_top(highest(*told, len(tops)), tops.y.to_numpy())
    return model


def _ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    skip = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(skip, lengths) + np.repeat(begin, lengths)


def _inputs_at(tokens: Tokens, model: Model, words: np.ndarray) -> np.ndarray:
    lengths = tokens.lengths[words]
    chars = np.add.reduceat(model["char"][tokens.gram[_ranges(tokens.begin[words], lengths)]], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None].astype(np.float32)
    return np.concatenate([model["word"][tokens.word[words]], chars], axis=1)


def _summed(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    rows, begin = np.unique(ids[order], return_index=True)
    return rows, np.add.reduceat(grads[order], begin, axis=0).astype(np.float32)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = 3000, chars: int = 10_000_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, by a
    model fitted on at most ``rows`` labelled rows of at most ``chars``
    characters together, toxic and clean ones in turn."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(docs, labels, "toxic", rows, chars, alike=True), train))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(scores(model.value, part.tolist()))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(run, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
