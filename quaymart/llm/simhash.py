"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; bit ``b`` is 1 if it is set in over half of the XXH64 hashes of the text's
shingles. Two fingerprints link if they differ in at most ``RADIUS`` bits; documents are one component
if a chain of links joins them.

**Covering masks.** Every bit gets a non-zero vector of ``RADIUS + 1`` bits, all vectors equally often. For
each non-zero ``v`` the mask of table ``v`` keeps the bits whose vector has an odd inner product with ``v``.
At most ``RADIUS`` differing bits give ``RADIUS`` equations in ``RADIUS + 1`` unknowns, so some non-zero ``v``
is orthogonal to all of them: that table's mask hides every difference, and the pair shares a bucket there.
The tables number ``2 ** (RADIUS + 1) - 1``, and each compares 36 or 37 bits.

**Within a bucket** nothing is paired off. Two fingerprints differ in at most two bits exactly if some value
lies within one bit of both. Each fingerprint of a shared bucket is therefore listed under itself and under
its one-bit changes among the hidden bits; all that meet under one value link to the smallest of them.
At most 65 different fingerprints can meet under a value, whatever the size of the bucket.

Equal fingerprints are one row with their smallest id before any of this.

Defined results: a null or empty text, or one of blanks only, has no words and the fingerprint zero, which
links like any other. Texts of fewer words than a shingle have one shingle of all their words. Rows that
repeat an id are each returned. A null id is never the smallest; a component of null ids only has a null
component. Columns of the input other than the id and the text are not looked at, so their names cannot clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stores import attach, stored

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
PIECE = 1 << 16   # shingles whose bits are unpacked at once


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned. ASCII letters count as lower case, ASCII blanks part words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        cut = zip(starts[at:at + PIECE].tolist(), ends[at:at + PIECE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cut], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and its ``fingerprint`` (a long, the 64 bits as they are) of every row, by a map over Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["k", "fingerprint"])

    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(prints, f"k {kind}, fingerprint long")
    return found.withColumnRenamed("k", key)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks: bits kept by each table."""
    vectors = (1 << (radius + 1)) - 1
    given = [1 + bit % vectors for bit in range(BITS)]
    return [sum(1 << bit for bit in range(BITS) if (given[bit] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def links(prints: DataFrame) -> DataFrame:
    """``a`` and ``b``: links that join all the given different fingerprints (column ``p``) within two bits.

    Every link is true, and the components of these links are those of all links.
    """
    tables = masks()
    kept = F.array(*[F.lit(_signed(m)) for m in tables])
    hidden = F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1]) for m in tables])
    # A bucket is named by a hash of table and kept bits; a clash of names would only list a few values in vain.
    dealt = prints.select("p", F.posexplode(kept).alias("t", "m")) \
        .select("p", "t", F.xxhash64("t", F.col("p").bitwiseAND(F.col("m"))).alias("bucket"))
    dealt = stored(dealt)
    crowded = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = attach(dealt, crowded, "bucket").where(F.col("n").isNotNull())
    changes = F.transform(F.element_at(hidden, F.col("t") + 1), lambda bit: F.col("p").bitwiseXOR(bit))
    near = members.select("p", F.explode(F.concat(F.array("p"), changes)).alias("value"))
    met = near.groupBy("value").agg(F.collect_set("p").alias("ps")).where(F.size("ps") > 1)
    return met.select(F.array_min("ps").alias("a"), F.explode("ps").alias("b")).where("a != b").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest ``key`` of its component, of every row."""
    prints = stored(fingerprints(docs, key, text).select(F.col(key).alias("k"), F.col("fingerprint").alias("p")))
    units = stored(prints.groupBy("p").agg(F.min("k").alias("first")))
    joined = components(links(units.select("p")))
    named = stored(units.join(joined.withColumnRenamed("node", "p"), "p", "left")
                   .select("p", "first", F.coalesce("component", "p").alias("component")))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = stored(attach(named, heads, "component").select("p", "component_id"))
    return attach(prints, placed, "p").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")
