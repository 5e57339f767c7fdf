"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text as segments of ``SEGMENT`` bytes. Two gated recurrent layers, one in each
direction, give every byte position a softmax over the learned languages; the probabilities of all
positions of a document are averaged. Training is plain numpy: back-propagation through time with
Adam on a bounded, class-balanced sample of labelled documents.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything
when there is no labelled row to learn from. Texts of any length are read whole. Equal texts get
equal results. Rows without a language, or with a blank one, are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import free_names
from .words import slices, text_buffers

SEGMENT = 128
HIDDEN = 8
SAMPLE_PER_LANGUAGE = 1500   # bound of the labelled rows that are fitted on, per language
SAMPLE_BYTES = SEGMENT * 4   # bytes of a sampled document, taken at a place that its hash chooses
STEPS, BATCH, RATE = 360, 256, 0.02
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _times(direction: str, n: int) -> range:
    return range(n) if direction == "f" else range(n - 1, -1, -1)


class ByteNetwork:
    """Parameters of both directions and the position-wise softmax."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        h, c = hidden, max(len(labels), 1)
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = (rng.normal(size=(256, 3 * h)) * 0.3).astype(np.float32)
            self.p[f"{d}u"] = (rng.normal(size=(h, 3 * h)) / np.sqrt(h)).astype(np.float32)
            self.p[f"{d}c"] = np.zeros(3 * h, np.float32)   # bias of the recurrent part
            self.p[f"{d}o"] = (rng.normal(size=(h, c)) / np.sqrt(h)).astype(np.float32)
        self.p["o"] = np.zeros(c, np.float32)

    def _run(self, d: str, codes: np.ndarray):
        """States and gates of one direction for training; ``codes`` is (time, batch)."""
        h, p = self.hidden, self.p
        x, u, c = p[f"{d}x"], p[f"{d}u"], p[f"{d}c"]
        state = np.zeros((codes.shape[1], h), np.float32)
        for t in _times(d, len(codes)):
            given, recurrent = x.take(codes[t], axis=0), state @ u + c
            gate = _sigmoid(given[:, :2 * h] + recurrent[:, :2 * h])
            inner = recurrent[:, 2 * h:]
            fresh = np.tanh(given[:, 2 * h:] + gate[:, :h] * inner)
            new = fresh + gate[:, h:] * (state - fresh)
            yield t, new, (state, gate, inner, fresh)
            state = new

    def _states(self, d: str, codes: np.ndarray):
        """The states of ``_run`` alone, in buffers that the next step overwrites.

        Gates have arrays of their own, because numpy is slow on slices of narrow rows, and
        ``exp`` replaces ``tanh``, which numpy computes at half the speed.
        """
        h, p = self.hidden, self.p
        x, u, c = p[f"{d}x"], p[f"{d}u"], p[f"{d}c"]
        part = [np.s_[:, k * h:(k + 1) * h] for k in range(3)]
        given = [np.ascontiguousarray(-x[k] - c[i * h:(i + 1) * h]) if i < 2 else np.ascontiguousarray(2 * x[k]) for i, k in enumerate(part)]
        inner = [np.ascontiguousarray(-u[k]) if i < 2 else np.ascontiguousarray(2 * u[k]) for i, k in enumerate(part)]
        bias = 2 * c[2 * h:]
        size = (codes.shape[1], h)
        state, reset, update, fresh, taken = (np.zeros(size, np.float32) for _ in range(5))
        one = np.float32(1)
        with np.errstate(over="ignore"):
            for t in _times(d, len(codes)):
                now = codes[t]
                for out, k in ((reset, 0), (update, 1)):
                    np.matmul(state, inner[k], out=out)
                    given[k].take(now, axis=0, out=taken, mode="clip")
                    out += taken
                    np.exp(out, out=out)
                    out += one
                    np.reciprocal(out, out=out)
                np.matmul(state, inner[2], out=fresh)
                fresh += bias
                fresh *= reset
                given[2].take(now, axis=0, out=taken, mode="clip")
                fresh += taken
                np.exp(fresh, out=fresh)
                fresh += one
                np.divide(np.float32(-2), fresh, out=fresh)
                fresh += one
                state -= fresh
                state *= update
                state += fresh
                yield t, state

    def position_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Softmax of every position: (time, batch, languages)."""
        p = self.p
        logits = np.empty((*codes.shape, len(p["o"])), np.float32)
        codes = codes.astype(np.intp)
        for t, state in self._states("f", codes):
            np.matmul(state, p["fo"], out=logits[t])
        for t, state in self._states("b", codes):
            logits[t] += state @ p["bo"]
        logits += p["o"]
        # States lie within -1 and 1, so the logits are bounded by the weights and exp cannot overflow.
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        flat = logits.reshape(-1, len(p["o"]))
        flat /= flat @ np.ones((len(p["o"]), len(p["o"])), np.float32)
        return logits

    def _gradients(self, codes: np.ndarray, weight: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """``weight`` is 0 at padded positions; ``target`` is the language of a segment."""
        h, p = self.hidden, self.p
        logits = np.zeros((*codes.shape, len(p["o"])), np.float32)
        kept = {}
        for d in "fb":
            kept[d] = []
            for t, state, gates in self._run(d, codes):
                logits[t] += state @ p[f"{d}o"]
                kept[d].append((t, state, gates))
        logits += p["o"]
        logits -= logits.max(axis=2, keepdims=True)
        delta = np.exp(logits)
        delta /= delta.sum(axis=2, keepdims=True)
        delta[:, np.arange(codes.shape[1]), target] -= 1
        delta *= (weight / weight.sum())[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["o"] = delta.sum(axis=(0, 1))
        for d in "fb":
            u = p[f"{d}u"]
            back = np.zeros((codes.shape[1], h), np.float32)
            inputs = np.empty((len(codes), codes.shape[1], 3 * h), np.float32)
            for t, state, (before, gate, inner, fresh) in reversed(kept[d]):
                back = back + delta[t] @ p[f"{d}o"].T
                grads[f"{d}o"] += state.T @ delta[t]
                reset, update = gate[:, :h], gate[:, h:]
                d_fresh = back * (1 - update) * (1 - fresh * fresh)
                d_update = back * (before - fresh) * update * (1 - update)
                d_reset = d_fresh * inner * reset * (1 - reset)
                d_inner = d_fresh * reset
                recurrent = np.concatenate([d_reset, d_update, d_inner], axis=1)
                grads[f"{d}u"] += before.T @ recurrent
                grads[f"{d}c"] += recurrent.sum(axis=0)
                inputs[t] = np.concatenate([d_reset, d_update, d_fresh], axis=1)
                back = back * update + recurrent @ u.T
            flat, rows = codes.reshape(-1), inputs.reshape(-1, 3 * h)
            order = np.argsort(flat, kind="stable")
            values, at = np.unique(flat[order], return_index=True)
            grads[f"{d}x"][values] = np.add.reduceat(rows[order], at, axis=0)
        return grads

    def fit(self, codes: np.ndarray, weight: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 11) -> ByteNetwork:
        """Adam over batches that draw every language equally often; arrays are (segment, time)."""
        rng = np.random.default_rng(seed)
        members = [np.flatnonzero(target == k) for k in range(len(self.labels))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            share = max(1, BATCH // len(members))
            pick = np.concatenate([rng.choice(m, share) for m in members])
            grads = self._gradients(codes[pick].T.copy(), weight[pick].T.copy(), target[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            scale = min(1.0, 1.0 / max(norm, 1e-12))
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def segments(raw: np.ndarray, offsets: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (segment, time), valid length and text number of all segments of all texts."""
    lengths = np.diff(offsets)
    per = (lengths + size - 1) // size
    owner = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    valid = np.minimum(lengths[owner] - nth * size, size)
    # The bytes of all texts fill the valid places in order; an index for every place would take 16 times the text.
    codes = np.zeros((len(owner), size), np.uint8)
    codes[np.arange(size) < valid[:, None]] = raw
    return codes, valid, owner


def document_probabilities(net: ByteNetwork, raw: np.ndarray, offsets: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Mean of the position probabilities per text; zeros for an empty text."""
    codes, valid, owner = segments(raw, offsets)
    sums = np.zeros((len(offsets) - 1, len(net.labels)))
    order = np.argsort(-valid, kind="stable")   # segments of like length share a batch
    for at in range(0, len(order), batch):
        pick = order[at:at + batch]
        longest = int(valid[pick].max())
        p = net.position_probabilities(np.ascontiguousarray(codes[pick, :longest].T))
        if int(valid[pick].min()) < longest:
            p *= (np.arange(longest)[:, None] < valid[pick])[:, :, None]
        np.add.at(sums, owner[pick], p.sum(axis=0, dtype=np.float64))
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def train(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang",
          per_language: int = SAMPLE_PER_LANGUAGE, steps: int = STEPS) -> ByteNetwork:
    """Fit on at most about ``per_language`` rows of each label; every label that has usable rows is learned.

    ``learn`` tells which rows may be learned from. Which rows are taken is decided by a hash of
    the text; of each, ``SAMPLE_BYTES`` bytes at a hashed place are read.
    """
    known = docs.where(learn & F.col(label).isNotNull() & (F.trim(F.col(label).cast("string")) != "") & F.col(text).rlike(r"\p{L}")) \
        .select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    net = ByteNetwork(labels)
    if not labels:
        return net
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    shares = F.map_from_arrays(F.lit(labels), F.lit([min(1.0, 1.3 * per_language / counts[name]) for name in labels]))
    share = F.element_at(shares, F.col("label"))
    span = F.greatest(F.length("text") - SAMPLE_BYTES // 2, F.lit(1))
    part = F.substring(F.col("text"), F.pmod(F.xxhash64(F.lit(3), "text"), span).cast("int") + 1, F.lit(SAMPLE_BYTES))
    rows = known.where(draw < share).select("label", part.alias("text"), F.xxhash64(F.lit(5), "text").alias("o")) \
        .orderBy("o", "label", "text").limit(2 * per_language * len(labels)).toArrow()
    raw, offsets = text_buffers(rows["text"])
    codes, valid, owner = segments(raw, offsets)
    place = {name: k for k, name in enumerate(labels)}
    target = np.array([place[x] for x in rows["label"].to_pylist()])[owner]
    taken = np.zeros(len(labels), int)
    weight = (np.arange(SEGMENT) < valid[:, None]).astype(np.float32)
    keep = valid >= 4
    for k in range(len(labels)):
        taken[k] = (keep & (target == k)).sum()
        if not taken[k]:
            keep |= target == k
    return net.fit(codes[keep], weight[keep], target[keep], steps)


def identify(docs: DataFrame, net: ByteNetwork, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``lang_score`` for every row.

    Where the input has columns of these names, the new ones get underscores in front (``stores.free_names``).
    """
    columns = docs.columns
    pred, sure, letter = free_names(columns, "lang_pred", "lang_score", "_letter")
    schema = docs.withColumns({pred: F.lit("").cast("string"), sure: F.lit(0.0)}).schema
    marked = docs.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.labels, UNDETERMINED], dtype=object)
        for whole in batches:
            for batch in slices(whole, text):
                raw, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
                known = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool)
                if net.labels:
                    p = document_probabilities(net, raw, offsets)
                    best = np.where(known, p.argmax(axis=1), len(net.labels))
                    score = np.where(known, np.clip(p.max(axis=1), 0.0, 1.0), 0.0)
                else:
                    best, score = np.zeros(len(known), int), np.zeros(len(known))
                out = [batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(names[best], pa.string()), pa.array(score)], [*columns, pred, sure])

    return marked.mapInArrow(label, schema)
