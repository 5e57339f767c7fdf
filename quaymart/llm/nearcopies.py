"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A document is its bag of word shingles. A shingle weighs its number of uses times an inverse
document frequency between 1, for a shingle in every document, and 2, for one in fewer than
``FREQUENT`` of them: ``1 + log(N / df) / log(1 / FREQUENT)``. Frequencies are exact counts over all
documents. Frequent shingles are few (at most the mean number of shingles of a document divided
by ``FREQUENT``, at any corpus size), so their table is broadcast.

Each of ``BANDS * ROWS`` samples draws one shingle with consistent weighted sampling; documents that
agree in all samples of a band are candidates, and candidates are near copies if their weighted
Jaccard similarity is at least ``SIMILARITY``. Groups are the connected components.

Exact copies are collapsed first. In a bucket of candidates every text is compared with the bucket's
hub, the text that shares most buckets with most others. Where a bucket still holds different
components, pairs between these are compared too. In large buckets such pairs are sought by an exact
prefix filter on what tells texts from the hub: texts that are not like the hub can be near each other only if they
differ from it in much the same shingles. Shingles that no other text of these buckets has, as merged tables of saturating counters
tell, are joined with nothing. A group of thousands of copies thus costs about one comparison per text.

Defined results: a null text counts as empty; equal texts, also empty ones, are one class; a text
without words is like no other text. A text of one to four words is one shingle. ``class_id`` is
the smallest id of a class; null ids come last and give a null class only if all ids are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stores import free_names, stored, text_key
from .words import mix, shingle_hashes, slices, text_buffers, word_hashes

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
FREQUENT = 1 / 256
CHUNK_DOCS = 4096          # documents counted together when candidates for frequent shingles are sought
PASS_CANDIDATES = 4_000_000  # candidates counted in one pass
ELEMENTS = 1 << 15
SLICE = 1 << 20            # text bytes shingled at once, which bounds the working arrays of a task
CELLS_LOG2, LEAST_LOG2, CHUNK_LOG2 = 26, 16, 18   # counters of a table: at most, at least, and in one chunk of it
EARLY = 16                 # tokens of a prefix that every later one of it carries, so that a pair is made once
SMALL_BUCKET = 32          # up to here the pairs between components are compared at once, without the filter
APART = (1 - SIMILARITY) / (1 + SIMILARITY)   # similar texts differ by at most this part of the sum of their weights


def shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, _, _, word_offsets = word_hashes(*text_buffers(column))
    return shingle_hashes(words, word_offsets)


def cut(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``SLICE`` bytes in each of the text columns, or one row."""
    if not columns:
        yield batch
        return
    for part in slices(batch, columns[0], SLICE):
        yield from cut(part, *columns[1:])


def bags(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of every text, their numbers of uses, and ``n + 1`` offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, at, counts = np.unique(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    order = np.argsort(at)
    at, counts = at[order], counts[order]
    return hashes[at], counts, np.searchsorted(at, offsets)


class Frequencies:
    """Document frequencies of the frequent shingles and the weight of any shingle."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.keys = hashes[order].astype(np.uint64)
        idf = 1 + np.log(max(total, 1) / np.maximum(df[order], 1)) / np.log(1 / FREQUENT)
        self.idf = np.clip(idf, 1.0, 2.0)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), 2.0)
        if len(self.keys) and len(hashes):
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[place] == hashes
            out[hit] = self.idf[place[hit]]
        return out


def _frequent_in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in at least ``FREQUENT`` of the documents of some chunk: every shingle that is frequent overall is one."""
    held: list[np.ndarray] = []
    docs = 0
    spare: tuple[list, int] = ([], 0)

    def frequent(parts, n):
        values = np.concatenate([np.zeros(0, np.uint64), *parts])
        parts.clear()
        values.sort()
        least = max(math.ceil(n * FREQUENT), 1)
        starts = values[:max(len(values) - least + 1, 0)]
        often = starts[values[least - 1:] == starts]   # runs of that many equal values
        return pa.RecordBatch.from_arrays([pa.array(np.unique(often).view(np.int64))], ["h"])

    for whole in batches:
        for batch in cut(whole, "text"):
            hashes, _, offsets = bags(*shingled(batch.column(0)))
            held.append(hashes)
            docs += len(batch)
            if docs >= CHUNK_DOCS:
                if spare[1]:
                    yield frequent(*spare)
                spare, held, docs = (held, docs), [], 0
    if docs >= CHUNK_DOCS // 4 and spare[1]:
        yield frequent(*spare)
        spare = ([], 0)
    if docs or spare[1]:
        spare[0].extend(held)
        held.clear()
        yield frequent(spare[0], spare[1] + docs)


def frequencies(docs: DataFrame, text: str = "text") -> Frequencies:
    """Exact document frequencies of all shingles in at least ``FREQUENT`` of the documents."""
    rows = docs.select(F.col(text).alias("text"))
    context, total = docs.sparkSession.sparkContext, rows.count()
    # A task of few documents would call everything frequent.
    wide = rows.coalesce(max(1, total // CHUNK_DOCS))
    candidates = stored(wide.mapInArrow(_frequent_in_chunks, "h long").distinct())
    passes = max(1, -(-candidates.count() // PASS_CANDIDATES))
    hashes, counts = [], []
    for k in range(passes):
        part = candidates.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k).toArrow()["h"].to_numpy()
        shipped = context.broadcast(np.sort(part.view(np.uint64)))

        def count(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            keys = shipped.value
            seen = np.zeros(1 << 22, bool)
            seen[(keys >> np.uint64(42)).astype(np.int64)] = True
            found = np.zeros(len(keys), np.int64)
            for whole in batches:
                for batch in cut(whole, "text"):
                    h, offsets = shingled(batch.column(0))
                    owner = np.repeat(np.arange(len(batch), dtype=np.uint64), np.diff(offsets))
                    some = seen[(h >> np.uint64(42)).astype(np.int64)]
                    h, owner = h[some], owner[some]
                    if len(h) and len(keys):
                        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        hit = keys[place] == h
                        # once for each document
                        pair = np.unique(place[hit].astype(np.uint64) << np.uint64(32) | owner[hit])
                        found += np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(keys))
            some = np.flatnonzero(found)
            for at in range(0, len(some), 100_000):
                part = some[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(found[part])], ["h", "n"])

        if len(part):
            table = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= total * FREQUENT).toArrow()
            hashes.append(table["h"].to_numpy().view(np.uint64))
            counts.append(table["n"].to_numpy())
    return Frequencies(np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *counts]), total)


class WeightedSampler:
    """Improved consistent weighted sampling in single precision.

    Of shingle s with weight w, sample k draws r and c from Gamma(2, 1) and b from the unit interval,
    all by s and k alone; t = floor(log w / r + b) and log a = log c - r (t - b + 1). The shingle with
    the smallest a is the sample. Equal a means equal s and t, so a itself stands for the sample.
    """

    def __init__(self, samples: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(1, 1 << 63, samples, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.b = rng.random(1 << 16, dtype=np.float32)

    def signatures(self, hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, samples) of 32-bit patterns; texts without shingles get zeros."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.factors)), np.uint32)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return out
        cuts = offsets[:-1][some]
        log_w = np.log(weights).astype(np.float32)
        low = np.empty(len(hashes), np.float32)
        scale, least = np.float32(2.0 ** -24), np.float32(2.0 ** -25)
        for k, factor in enumerate(self.factors):
            for at in range(0, len(hashes), ELEMENTS):
                h = hashes[at:at + ELEMENTS] * factor
                h ^= h >> np.uint64(32)
                row = (h & np.uint64(0xFFFF)).astype(np.intp)
                u = (h >> np.uint64(40)).astype(np.float32)
                u *= scale
                u += least
                v = ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32)
                v *= scale
                v += least
                u *= v
                np.log(u, out=u)
                np.negative(u, out=u)
                np.log(u, out=u)                     # log c
                b = self.b.take(row)
                t = log_w[at:at + ELEMENTS] * self.inverse.take(row)
                t += b
                np.floor(t, out=t)
                t -= b
                t += np.float32(1)
                t *= self.r.take(row)
                np.subtract(u, t, out=low[at:at + ELEMENTS])
            out[some, k] = np.minimum.reduceat(low, cuts).view(np.uint32)
        return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per text and band."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys + signatures[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
    return keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def similarities(a: pa.Array, b: pa.Array, frequent: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row; 0 where one has no words."""
    n = len(a)
    sides = []
    for side in (a, b):
        h, counts, offsets = bags(*shingled(side))
        sides.append((h ^ mix(np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets)) + np.uint64(1)), counts * frequent.weights(h),
                      np.repeat(np.arange(n), np.diff(offsets))))
    total = sum(np.bincount(owner, weights, n) for _, weights, owner in sides)
    (ha, wa, oa), (hb, wb, _) = sides
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = np.bincount(oa[ia], np.minimum(wa[ia], wb[ib]), n)
    return np.where(common > 0, common / np.maximum(total - common, 1e-300), 0.0)


def _verified(pairs: DataFrame, texts: DataFrame, shipped) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "ta", "tb"):
                s = similarities(batch.column(2), batch.column(3), shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "similarity"])

    with_b = pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return stored(with_both.mapInArrow(compare, "a binary, b binary, similarity double").where(F.col("similarity") >= SIMILARITY))


class Counters:
    """Saturating counters of shingles: whether a cell was met never, once or more often."""

    def __init__(self, log2: int):
        self.log2, self.count = log2, np.zeros(1 << log2, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        cells, times = np.unique(_cells(hashes, self.log2), return_counts=True)
        self.count[cells] = np.minimum(self.count[cells] + times, 2)

    def chunks(self, size: int) -> Iterator[tuple[int, bytes]]:
        """Number and packed bits (met, met more often) of each chunk of ``size`` cells that is not empty."""
        for k in range(len(self.count) // size):
            part = self.count[k * size:(k + 1) * size]
            if part.any():
                yield k, zstandard.compress(np.packbits(part > 0).tobytes() + np.packbits(part > 1).tobytes(), 1)


def _cells(hashes: np.ndarray, log2: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - log2)).astype(np.intp)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the cells that all tables together met exactly once; only one table is held."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            met, more = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(2, -1)
            if k not in held:
                held[k] = [met.copy(), more.copy()]
            else:
                held[k][1] |= more | (held[k][0] & met)
                held[k][0] |= met
    for k, (met, more) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(met & ~more).tobytes()], pa.binary())], ["chunk", "bits"])


def _once(texts: DataFrame, log2: int) -> np.ndarray:
    """Packed bits of the cells that exactly one text's shingles met: ``2 ** (log2 - 3)`` bytes at any number of texts."""
    size = 1 << min(CHUNK_LOG2, log2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Counters(log2)
        for whole in batches:
            for batch in cut(whole, "text"):
                table.add(bags(*shingled(batch.column(0)))[0])
        for k, packed in table.chunks(size):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "bits"])

    tables = texts.select("text").mapInArrow(count, "chunk int, bits binary")
    found = tables.repartition(max(1, (1 << log2) // size), "chunk").mapInArrow(_merged, "chunk int, bits binary").toArrow()
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for k, part in zip(found["chunk"].to_pylist(), found["bits"].to_pylist(), strict=True):
        bits[k * size // 8:(k + 1) * size // 8] = np.frombuffer(part, np.uint8)
    return bits


def _differences(sides: DataFrame, texts: DataFrame, log2: int, shipped) -> DataFrame:
    """``hub``, ``uid``, ``linked``, weight ``w`` of the text, weight ``d`` of its difference from its hub, ``tokens`` of the difference in the order of the filter, for each the weight ``rest`` of the difference from there on, and how many of
    the tokens the ``short`` prefix has (see ``_by_differences``)."""
    once = texts.sparkSession.sparkContext.broadcast(_once(texts, log2))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text", "hub_text"):
                n, keys, sums = len(batch), [], []
                found = []
                for column, sign in ((3, 1), (4, -1)):
                    h, counts, offsets = bags(*shingled(batch.column(column)))
                    owner = np.repeat(np.arange(n), np.diff(offsets))
                    keys.append(h ^ mix(owner.astype(np.uint64) + np.uint64(1)))
                    found.append((h, counts * sign, owner))
                    sums.append(np.bincount(owner, counts * shipped.value.weights(h), n))
                h, counts, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                _, first, group = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                held = np.bincount(group, counts < 0, len(first)) > 0
                h, owner, diff = h[first], owner[first], np.bincount(group, counts, len(first))
                some = diff != 0
                h, owner, diff, held = h[some], owner[some], diff[some], held[some]
                cells, idf = _cells(h, log2), shipped.value.weights(h)
                own = (once.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool) & ~held
                order = np.lexsort((h, -idf, diff < 0, ~own, owner))
                h, owner, diff, own, weight = h[order], owner[order], diff[order], own[order], (np.abs(diff) * idf)[order]
                d = np.bincount(owner, weight, n)
                before = np.cumsum(weight) - weight - np.concatenate([[0.0], np.cumsum(d)])[owner]
                linked = batch.column(2).to_numpy(zero_copy_only=False)
                w, hub = sums
                far = (d + (hub - w) * APART) / 2                           # least overlap with a text that is not like the hub
                near = np.where(linked, far, (d - (w + hub) * APART) / 2)   # least overlap with any text
                slack = 1e-6 * (w + hub + 1)
                long = (before <= (d - near + slack)[owner]) & ~own
                short = long & (before <= (d - far + slack)[owner])
                ends = pa.array(np.searchsorted(owner[long], np.arange(n + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array((h[long] ^ (diff[long] < 0)).view(np.int64)))
                rests = pa.ListArray.from_arrays(ends, pa.array((d[owner] - before)[long]))
                counted = pa.array(np.bincount(owner[short], minlength=n).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(w), pa.array(d), lists, rests, counted],
                                                 ["hub", "uid", "linked", "w", "d", "tokens", "rest", "short"])

    return sides.select("hub", "uid", "linked", "text", "hub_text") \
        .mapInArrow(differ, "hub binary, uid binary, linked boolean, w double, d double, tokens array<long>, rest array<double>, short int")


def _by_differences(open_: DataFrame, texts: DataFrame, shipped) -> DataFrame:
    """Pairs (a, b) of texts of one bucket in different components that may be similar enough; ``open_`` names the hub of each bucket.

    Let D(x) be the difference between x and the hub: shingles that x has more often, and those that it has less often. For x and y
    with weights v and w, the weight of their own difference is |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and they are similar enough if that is at
    most ``APART * (v + w)``. At least one of them, being in another component, is not like the hub, so |D| is more than
    ``APART`` times its weight and the hub's: D(x) and D(y) must have a certain weight in common. All differences of a hub are ordered alike
    (what no other text has, then what the hub lacks, then what the text lacks), so such pairs share a token of the prefixes that leave
    less than that weight. Tokens that no other text has are joined with nothing. The first token that D(x) and D(y) share bounds what they can
    have in common by the lesser weight from there on, so pairs that meet too late in their order are not made, and a token makes
    no pair that one of the first ``EARLY`` tokens of both has made. None of these steps can lose a link.

    Shingles are counted in a table of saturating counters whose size follows the bytes of the texts up to
    ``2 ** CELLS_LOG2`` cells; more texts are taken in passes by hub, each with a table of its own. Shingles that share a cell look
    shared, which makes more tokens and never loses a link.
    """
    members = stored(open_.select("hub", "uid", "c", "bands").distinct())
    some = stored(texts.join(members.select("uid").distinct(), "uid").select("uid", "text", (F.octet_length("text") / 4 + 1).cast("bigint").alias("room")))
    room = some.agg(F.sum("room")).first()[0] or 0
    passes = 1
    if room > 1 << CELLS_LOG2:
        wide = members.join(some.select("uid", "room"), "uid").agg(F.sum("room")).first()[0]
        passes = -(-wide // (1 << CELLS_LOG2))
    log2 = min(max(int(room).bit_length(), LEAST_LOG2), CELLS_LOG2)
    hubs = members.where(F.col("hub") == F.col("uid")).select("hub", F.col("c").alias("hub_c"))
    placed = members.where(F.col("hub") != F.col("uid")).join(hubs, "hub").select("hub", "uid", (F.col("c") == F.col("hub_c")).alias("linked"))
    overlap = F.least("restx", "resty")
    condition = (F.col("cx") < F.col("cy")) & ((F.col("linkedx") != F.col("linkedy")) | (F.col("shortx") & F.col("shorty"))) \
        & (F.col("dx") + F.col("dy") - 2 * overlap <= APART * (F.col("wx") + F.col("wy")) + 1e-6 * (F.col("wx") + F.col("wy") + 1)) \
        & ~F.arrays_overlap("earlyx", "earlyy") & F.arrays_overlap("bandsx", "bandsy")
    out = None
    for k in range(passes):
        of_pass = lambda df: df if passes == 1 else df.where(F.pmod(F.xxhash64("hub"), F.lit(passes)) == k)  # noqa: B023, E731
        of_part = some if passes == 1 else some.join(of_pass(members).select("uid").distinct(), "uid")
        sides = of_pass(placed).join(some.select(F.col("uid").alias("hub"), F.col("text").alias("hub_text")), "hub").join(some.select("uid", "text"), "uid")
        known = stored(_differences(sides, of_part, log2, shipped).where(F.size("tokens") > 0))
        rows = known.join(members, ["hub", "uid"]) \
            .select("hub", "uid", "linked", "w", "d", "c", "bands", "short", F.slice("tokens", 1, EARLY).alias("early"), F.posexplode(F.arrays_zip("tokens", "rest")).alias("at", "x")) \
            .select("hub", "uid", "linked", "w", "d", "c", "bands", (~F.col("linked") & (F.col("at") < F.col("short"))).alias("short"),
                    F.slice("early", F.lit(1), F.col("at")).alias("early"), F.col("x.tokens").alias("token"), F.col("x.rest").alias("rest"))
        side = lambda n: rows.select(*[F.col(c).alias(c + n) for c in rows.columns])  # noqa: B023, E731
        pairs = side("x").join(side("y"), (F.col("hubx") == F.col("huby")) & (F.col("tokenx") == F.col("tokeny")) & condition) \
            .select(F.least("uidx", "uidy").alias("a"), F.greatest("uidx", "uidy").alias("b"))
        out = pairs if out is None else out.unionAll(pairs)
    return out


def _across(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of one small bucket in different components."""
    side = lambda n: open_.select("band", *[F.col(c).alias(c + n) for c in open_.columns if c != "band"])
    # A pair that shares several bands is made in the first of them alone.
    earlier = F.zip_with(F.slice("bandsx", 1, F.col("ix")), F.slice("bandsy", 1, F.col("ix")), lambda a, b: a == b)
    condition = (F.col("cx") < F.col("cy")) & ~F.exists(earlier, lambda same: same)
    return side("x").join(side("y").withColumnRenamed("band", "band_y"), (F.col("band") == F.col("band_y")) & condition) \
        .select(F.least("uidx", "uidy").alias("a"), F.greatest("uidx", "uidy").alias("b"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``uid`` (stands for the text) and ``class_id`` of every row of ``docs``."""
    frequent = frequencies(docs, text)
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(BANDS * ROWS)
        for whole in batches:
            for batch in cut(whole, "text"):
                h, counts, offsets = bags(*shingled(batch.column(2)))
                keys = band_keys(sampler.signatures(h, counts * shipped.value.weights(h), offsets)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()),
                                                 mask=pa.array(np.diff(offsets) == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["k", "uid", "bands"])

    key_type = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_key(text).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stored(rows.mapInArrow(sign, f"k {key_type}, uid binary, bands array<long>"))
    order = F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"))
    units = stored(signed.groupBy("uid").agg(F.min(F.struct(order.alias("id"), "bands")).alias("x")).select("uid", "x.id", "x.bands"))

    members = units.select("uid", "id", F.posexplode("bands").alias("i", "band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    inside = stored(members.join(buckets, "band"))
    met = inside.join(inside.groupBy("uid").agg(F.sum("n").alias("met")), "uid")
    hubs = met.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("met"), "id", "uid"))["uid"].alias("hub"))
    stars = stored(inside.join(hubs, "band").where(F.col("uid") != F.col("hub")).select(F.least("hub", "uid").alias("a"), F.greatest("hub", "uid").alias("b")).distinct())

    # The text of each unit that is in a bucket, from the row that holds its first id.
    wanted = inside.groupBy("uid").agg(F.min("id.k").alias("k"))
    found_rows = rows.select("k", "uid", "text").join(wanted.select(F.col("uid").alias("u"), F.col("k").alias("uk")), (F.col("uid") == F.col("u")) & F.col("k").eqNullSafe(F.col("uk")))
    texts = stored(found_rows.groupBy("uid").agg(F.min("text").alias("text")))
    edges = _verified(stars, texts, shipped)

    found = components(edges)
    placed = inside.join(found.withColumnRenamed("node", "uid"), "uid", "left").select("band", "i", "uid", "n", F.coalesce("component", "uid").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("band")
    open_ = stored(placed.join(mixed, "band").join(units.select("uid", "bands"), "uid"))
    across = _across(open_.where(F.col("n") <= SMALL_BUCKET)).unionAll(_by_differences(open_.where(F.col("n") > SMALL_BUCKET).join(hubs, "band"), texts, shipped))
    more = _verified(across.distinct().join(stars, ["a", "b"], "left_anti"), texts, shipped)
    if more.limit(1).count():
        found = components(edges.select("a", "b").unionAll(more.select("a", "b")))

    named = units.select("uid", "id").join(found.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "id", F.coalesce("component", "uid").alias("c"))
    heads = named.groupBy("c").agg(F.min("id")["k"].alias("class_id"))
    classes = named.join(heads, "c").select("uid", "class_id")
    return signed.select("k", "uid").join(classes, "uid").select(F.col("k").alias(key), "uid", "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class with the smallest id, all columns unchanged; of rows that repeat it, one."""
    found = near_copies(docs, key, text)
    keepers = found.where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("uid").alias("uid"))
    uid, kept, kept_uid = free_names(docs.columns, "_uid", "_kept", "_kept_uid")
    keepers = keepers.select(F.col("class_id").alias(kept), F.col("uid").alias(kept_uid))
    marked = docs.withColumn(uid, text_key(text))
    joined = marked.join(keepers, F.col(key).eqNullSafe(F.col(kept)) & (F.col(uid) == F.col(kept_uid)), "left_semi")
    return joined.dropDuplicates([key, uid]).select(*docs.columns)
