"""Toxicity score: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A text counts as the list of its different words in order of first use, so that a word repeated a
thousand times says no more than once. A word is the mean embedding of its hashed features: the whole word and its character n-grams of
3 to 5 bytes between word marks, so an unseen misspelling shares most vectors with the word it
bends. ``PASSAGE`` words of that list are averaged into one vector, a linear softmax gives the
probability of label 1, and a document takes its most toxic passage: a few words count equally
in a short and in a very long text.

Defined results: a null text, an empty one and one without words score the probability of the
bias alone, as does every text when no labelled row can be learned from. Equal texts score alike.
Rows whose label is neither 0 nor 1 are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import free_names
from .words import mix, slices, text_buffers, word_hashes

BUCKETS_LOG2, WIDTH, PASSAGE = 18, 8, 16
GRAMS = (3, 4, 5)
SAMPLE = {1: 4000, 0: 8000}   # bound of the labelled rows that are fitted on, per label
SAMPLE_CHARS = 20_000         # longer labelled texts are not fitted on
STEPS, BATCH, RATE = 900, 128, 0.4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_features(raw: np.ndarray, first: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the given words and ``n + 1`` feature offsets."""
    size = end - first
    marked = size + 2
    begin = np.cumsum(marked) - marked
    total = int(marked.sum())
    text = np.empty(total, np.uint8)
    place = np.arange(total) - np.repeat(begin, marked)
    source = np.repeat(first, marked) + place - 1
    text[:] = _FOLD[raw[np.clip(source, 0, max(len(raw) - 1, 0))]]
    text[begin], text[begin + marked - 1] = ord("<"), ord(">")
    left = np.repeat(marked, marked) - place          # bytes from here to the end of the word
    padded = np.concatenate([text, np.zeros(max(GRAMS), np.uint8)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(first), dtype=np.int32), marked)
    packed = np.zeros(total, np.uint64)
    codes, owners, done = [hashes], [np.arange(len(first), dtype=np.int32)], 0
    for n in GRAMS:
        while done < n:
            packed |= padded[done:done + total] << np.uint64(8 * done)
            done += 1
        has = left >= n
        codes.append(packed[has] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
        owners.append(owner[has])
    owners = np.concatenate(owners)
    buckets = (mix(np.concatenate(codes)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(first)))])


def _means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of each non-empty run."""
    return np.add.reduceat(values, offsets[:-1]) / np.diff(offsets) if len(offsets) > 1 else np.zeros(0)


def different_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` of the first use of each word in each text."""
    hashes, first, end, word_offsets = word_hashes(raw, offsets)
    owner = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    _, at = np.unique(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    at.sort()
    return hashes[at], first[at], end[at], np.searchsorted(at, word_offsets)


def _different_words_by_parts(raw: np.ndarray, offsets: np.ndarray, part: int = 4 << 20) -> tuple[np.ndarray, ...]:
    """The same in pieces of about ``part`` bytes, so that only what is kept is held whole."""
    found, at = [], 0
    while at < len(offsets) - 1:
        end = min(max(int(np.searchsorted(offsets, offsets[at] + part, side="right")) - 1, at + 1), len(offsets) - 1)
        base = offsets[at]
        h, a, b, w = different_words(raw[base:offsets[end]], offsets[at:end + 1] - base)
        found.append((h, a + base, b + base, np.diff(w)))
        at = end
    h, a, b, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, a, b, np.concatenate([[0], np.cumsum(counts)])


def passages(word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every passage (plus the end) and ``n + 1`` passage offsets of the texts."""
    counts = np.diff(word_offsets)
    per = (counts + PASSAGE - 1) // PASSAGE
    nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return np.append(np.repeat(word_offsets[:-1], per) + nth * PASSAGE, word_offsets[-1]), np.concatenate([[0], np.cumsum(per)])


class SubwordBag:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.normal(size=(1 << BUCKETS_LOG2, WIDTH)) * 0.05).astype(np.float32)
        self.softmax = (rng.normal(size=(WIDTH, 2)) * 0.3).astype(np.float32)
        self.bias = 0.0

    def projection(self) -> np.ndarray:
        """Log odds that one feature alone adds: averages of embeddings and of this are the same thing."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])

    def calibrate(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, steps: int = 30) -> SubwordBag:
        """Scale and shift the log odds (logistic regression with both labels at equal weight) on rows not fitted on."""
        if len(set(label.tolist())) < 2:
            return self
        p = document_scores(self.projection(), self.bias, raw, offsets)
        z = np.log(p / (1 - p))
        x = np.stack([z, np.ones(len(z))], axis=1)
        weight = np.array([0.5 / (label == k).sum() for k in (0, 1)])[label]
        a, ridge = np.array([1.0, 0.0]), 1e-3
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            gradient = x.T @ (weight * (q - label)) + ridge * (a - [1.0, 0.0])
            curvature = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(2)
            move = np.linalg.solve(curvature, gradient)
            a = a - move * min(1.0, 1.0 / max(np.abs(move).max(), 1e-12))
        if a[0] > 0:
            self.softmax *= np.float32(a[0])
            self.bias = float(self.bias * a[0] + a[1])
        return self

    def fit(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = 6) -> SubwordBag:
        """Adagrad. The first quarter of the epochs weighs passages by their probability, later ones take the best."""
        hashes, first, end, word_offsets = _different_words_by_parts(raw, offsets)
        _, one, ids = np.unique(hashes, return_index=True, return_inverse=True)
        buckets, at = word_features(raw, first[one], end[one], hashes[one])
        rng = np.random.default_rng(seed)
        share = np.array([0.5 / max((label == k).sum(), 1) for k in (0, 1)])[label] * len(label)
        past, past_w, past_b = np.full(len(self.vectors), 1e-6, np.float32), np.full(self.softmax.shape, 1e-6), 1e-6
        epochs = min(steps, -(-steps * BATCH // max(len(label), 1)))   # an epoch is one batch at least
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for begin in range(0, len(order), BATCH):
                docs = np.sort(order[begin:begin + BATCH])
                docs = docs[np.diff(word_offsets)[docs] > 0]
                if not len(docs):
                    continue
                sizes = np.diff(word_offsets)[docs]
                own = np.concatenate([[0], np.cumsum(sizes)])
                places = np.arange(own[-1]) + np.repeat(word_offsets[docs] - own[:-1], sizes)
                used, word = np.unique(ids[places], return_inverse=True)
                counts = np.diff(at)[used]
                fo = np.concatenate([[0], np.cumsum(counts)])
                features = buckets[np.arange(fo[-1]) + np.repeat(at[used] - fo[:-1], counts)]
                direction = self.softmax[:, 1] - self.softmax[:, 0]
                rows = self.vectors[features]
                score = _means(rows @ direction, fo)[word]
                starts, po = passages(own)
                logit = self.bias + _means(score, starts)
                top = np.maximum.reduceat(logit, po[:-1])
                owner = np.repeat(np.arange(len(docs)), np.diff(po))
                if epoch * 4 < epochs:
                    pull = np.exp(logit - top[owner])
                    pull /= np.add.reduceat(pull, po[:-1])[owner]
                else:
                    pull = (logit == top[owner]).astype(float)
                    pull /= np.add.reduceat(pull, po[:-1])[owner]
                z = np.add.reduceat(pull * logit, po[:-1])
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[docs]) * share[docs] / len(docs)
                per_word = np.repeat(pull * error[owner] / np.diff(starts), np.diff(starts))
                per_used = np.bincount(word, per_word, len(used)) / counts
                per_row = np.repeat(per_used, counts)
                grad = np.bincount(features, per_row, len(self.vectors))
                hit = np.flatnonzero(grad)
                toward = (per_row @ rows)[:, None] * np.array([-1.0, 1.0])
                past[hit] += (grad[hit] ** 2).astype(np.float32)
                self.vectors[hit] -= (RATE * grad[hit] / np.sqrt(past[hit]))[:, None].astype(np.float32) * direction * 0.3
                past_w += toward ** 2
                self.softmax -= (0.02 * toward / np.sqrt(past_w)).astype(np.float32)
                past_b += error.sum() ** 2
                self.bias -= 0.1 * error.sum() / np.sqrt(past_b)
        return self


def document_scores(projection: np.ndarray, bias: float, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 per text."""
    hashes, first, end, word_offsets = different_words(raw, offsets)
    logit = np.full(len(offsets) - 1, bias)
    if len(hashes):
        _, one, ids = np.unique(hashes, return_index=True, return_inverse=True)
        buckets, at = word_features(raw, first[one], end[one], hashes[one])
        score = _means(projection[buckets].astype(float), at)[ids]
        starts, po = passages(word_offsets)
        some = np.diff(po) > 0
        logit[some] += np.maximum.reduceat(_means(score, starts), po[:-1][some])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: dict[int, int] = SAMPLE) -> SubwordBag:
    """Fit on at most ``sample[k]`` labelled rows of label ``k``; a hash of the key decides which.

    The sampled keys, a bounded number, are broadcast to the documents, so no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    hashed = known.withColumn("o", F.xxhash64(F.lit(9), "k"))
    some = [hashed.where(F.col("label") == k).orderBy("o", "k").limit(n) for k, n in sorted(sample.items())]
    few = some[0].unionAll(some[1])
    rows = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(key).alias("k"), F.col(text).alias("text")) \
        .join(F.broadcast(few), "k").select(F.lower("text").alias("text"), "label", "o")
    table = rows.orderBy("o", "text").toArrow()
    bag = SubwordBag()
    label_of = table["label"].to_numpy()
    if len(set(label_of.tolist())) < 2:
        bag.vectors[:] = 0
        bag.bias = float(np.log((1 + (label_of == 1).sum()) / (1 + (label_of == 0).sum())))
        return bag
    # Rows are in the order of a hash, so every fifth one is as good as a random draw.
    aside = np.arange(len(label_of)) % 5 == 4
    fitted, kept = np.flatnonzero(~aside), np.flatnonzero(aside)
    text_of = table["text"].combine_chunks()
    return bag.fit(*text_buffers(text_of.take(pa.array(fitted))), label_of[fitted]) \
        .calibrate(*text_buffers(text_of.take(pa.array(kept))), label_of[kept])


def score(docs: DataFrame, bag: SubwordBag, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``toxicity`` between 0 and 1 (with underscores in front if there is one)."""
    columns = docs.columns
    name, lower = free_names(columns, "toxicity", "_lower")
    schema = docs.withColumn(name, F.lit(0.0)).schema
    # One number per bucket is all that scoring needs: 1 MB at any corpus size.
    shipped = docs.sparkSession.sparkContext.broadcast((bag.projection(), bag.bias))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, bias = shipped.value
        for whole in batches:
            for batch in slices(whole, lower):
                raw, offsets = text_buffers(batch.column(len(columns)))
                out = [batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(document_scores(projection, bias, raw, offsets))], [*columns, name])

    return docs.withColumn(lower, F.lower(F.col(text))).mapInArrow(label, schema)
