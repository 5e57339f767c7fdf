"""SimHash components, hard negatives and whitening against brute force."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quaymart.llm import negatives, simhash, whitening


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


# ---- SimHash ----


def plain_fingerprint(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch == " " or "\t" <= ch <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints):
    """Smallest key reachable, by comparing all pairs."""
    parent = {p: p for p in set(prints.values())}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    units = sorted(parent)
    for i, a in enumerate(units):
        for b in units[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[top(a)] = top(b)
    heads = {}
    for k, p in prints.items():
        heads[top(p)] = min(k, heads.get(top(p), k))
    return {k: heads[top(p)] for k, p in prints.items()}


def test_fingerprints_of_odd_texts():
    for text in [None, "", " \t\n", "One", "one two", "ONE two three", "ÄRGER und Äpfel sind da", "a\x0bb\x0cc\x1cd e f g", "x " * 70_000, "a  b\r\nc d " * 5,
                 "lone \U0001f600 face here again"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text and text[:30]


def test_fingerprint_hash_is_the_session_hash(spark):
    text = "Alpha beta GAMMA"
    got = spark.range(1).select(F.xxhash64(F.lit("alpha beta gamma")).alias("h")).first()["h"]
    assert simhash.fingerprint(text) == got % (1 << 64)


def test_masks_cover_every_two_differing_bits():
    tables = simhash.masks()
    assert len(tables) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in tables)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    prints, key = {}, 0
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints[key] = p
            key += 1
            for _ in range(rng.randrange(0, 4)):
                p ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints.values())], "p long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    joined = {p: p for p in prints.values()}

    def top(p):
        while joined[p] != p:
            p = joined[p]
        return p

    for a, b in edges:
        joined[top(a)] = top(b)
    want = plain_components(prints)
    groups = {}
    for k, p in prints.items():
        groups.setdefault(top(p), set()).add(k)
    wanted = {}
    for k, c in want.items():
        wanted.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_crowded_bucket_makes_no_pairs(spark):
    base = 0x0123456789ABCDEF
    bits = [b for b in range(64) if not simhash.masks()[0] >> b & 1]
    rng = random.Random(1)
    values = list({base ^ sum(1 << b for b in rng.sample(bits, 9)) for _ in range(3000)})
    frame = spark.createDataFrame([(p,) for p in values], "p long")
    edges = simhash.links(frame).collect()
    assert len(edges) <= 65 * len(values)
    near = {(r["a"], r["b"]) for r in edges}
    assert all((a ^ b).bit_count() <= 2 for a, b in near)
    want = plain_components(dict(enumerate(values)))
    from quaymart.llm.components import components
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(list(near), "a long, b long")).collect()} if near else {}
    key = {p: k for k, p in enumerate(values)}
    parts, wanted = {}, {}
    for p in values:
        parts.setdefault(got.get(p, p), set()).add(p)
        wanted.setdefault(want[key[p]], set()).add(p)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_near_copies_of_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(prints)
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (9, "a b c d"), (4, "A B\tc d"), (4, "a b c d"), (None, "a b c d"), (None, "quite another text here"), (7, "x")]
    frame = spark.createDataFrame([(k, t, "y") for k, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_copies(frame).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (9, 4), (4, 4), (4, 4), (None, 4), (None, None), (7, 7)], key=str)
    assert simhash.near_copies(frame.limit(0)).count() == 0


# ---- hard negatives ----


def plain_negatives(rows, positives=5, negatives=10):
    """Rows are (id, label, whole numbers)."""
    out = []
    for a, la, x in rows:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, lb) for b, lb, y in rows if b != a)
        for minus, b, _ in [s for s in scored if s[2] == la][:positives]:
            fits = [(c, -t) for t, c, lc in scored if lc != la and 30 * -minus <= 100 * -t <= 90 * -minus][:negatives]
            out += [(a, b, rank, c, -minus, s) for rank, (c, s) in enumerate(fits, 1)]
    return sorted(out)


def got_negatives(frame, **more):
    found = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("width", "top"), [(1, 3), (64, 150), (300, 4000), (700, 1 << 20)])
def test_residue_products_are_exact(width, top):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-top, top + 1, (7, width)), rng.integers(-top, top + 1, (9, width))
    a[0], b[0], b[1] = top, top, -top
    primes = negatives.moduli(width, width * top * top)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()
    assert len(set(primes)) == len(primes)
    assert min(width, negatives.CHUNK) * (max(primes) // 2) ** 2 <= 1 << 24


def test_first_of_keeps_ties_to_the_left():
    rng = np.random.default_rng(2)
    for k in (1, 3, 10):
        score = rng.integers(0, 4, (50, 40))
        score[rng.random(score.shape) < 0.5] = negatives.NONE
        r, c = negatives.first_of(score, k)
        for row in range(50):
            order = sorted((-s, i) for i, s in enumerate(score[row]) if s != negatives.NONE)[:k]
            assert sorted(c[r == row]) == sorted(i for _, i in order)


def test_negatives_of_whole_table(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    frame = table.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    rows = [(r["vec_id"], r["label"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in frame.collect()]
    want = plain_negatives(rows)
    assert got_negatives(frame) == want
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "CELLS", 1000)
    assert got_negatives(frame.repartition(5)) == want


def test_negatives_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, k % 3, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(260)]
    rows += [rows[5], rows[100], (300, None, [1.0] * 4), (400, 1, None), (500, 1, [1.0, None, 1.0, 1.0]), (600, 2, [1.0, float("nan"), 0.0, 0.0]),
             (601, 2, [float("inf")] * 4), (602, 2, [1e300] * 4), (603, 2, [1.0]), (604, 2, []), (None, 2, [1.0] * 4)]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, label int, embedding array<double>, rank int, score double")
    plain = [(k, label, [int(256 * x) for x in v]) for k, label, v in rows[:260]]
    assert got_negatives(frame) == plain_negatives(plain)
    assert got_negatives(frame.limit(0)) == []
    assert got_negatives(frame.where("vec_id % 100 != 0")) == []
    alone = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0])], "vec_id long, label string, embedding array<double>")
    assert got_negatives(alone) == []
    named = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [1.0]), (2, "b", [0.5])], "vec_id long, label string, embedding array<float>")
    assert got_negatives(named) == [(0, 1, 1, 2, 65536, 32768)]


# ---- whitening ----


def exact_covariance(x):
    n, cols = len(x), list(zip(*x))
    sums = [sum(c) for c in cols]
    return [[Fraction(n * sum(p * q for p, q in zip(a, b)) - sa * sb, n * n) for b, sb in zip(cols, sums)] for a, sa in zip(cols, sums)]


def test_refinement_tells_clustered_eigenvalues_apart():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    for _ in range(4):   # orthogonal to extended precision
        turn = turn @ (np.eye(30, dtype=np.longdouble) + (np.eye(30, dtype=np.longdouble) - turn.T @ turn) / 2)
    values = np.array([5.0] * 3 + [4 + k * 1e-9 for k in range(9)] + [3 + k * 1e-12 for k in range(8)] + list(np.linspace(0.1, 2, 10)), np.longdouble)
    got, vectors = whitening.refined((turn * values) @ turn.T)
    order = np.argsort(-values)
    assert np.abs(got - values[order]).max() < 1e-17
    assert np.abs(vectors.T @ vectors - np.eye(30)).max() < 1e-15
    same = np.abs(vectors.T @ turn[:, order])
    single = [i for i, v in enumerate(values[order]) if v != 5]
    assert np.abs(same[np.ix_(single, single)] - np.eye(len(single))).max() < 1e-5   # gaps of 1e-12 under rounding of 1e-19
    wide = [i for i in single if not 3 <= values[order][i] < 3.5]
    assert np.abs(same[np.ix_(wide, wide)] - np.eye(len(wide))).max() < 1e-9


def test_refinement_of_degenerate_matrices():
    for m in (np.zeros((3, 3)), np.eye(4) * 7, np.diag([1.0, 0.0]), np.ones((5, 5)), np.zeros((0, 0))):
        values, vectors = whitening.refined(m.astype(np.longdouble))
        assert np.abs((vectors * values) @ vectors.T - m).max(initial=0) < 1e-15


def white_rows(frame):
    net = whitening.fit(frame)
    out = whitening.whiten(frame, net)
    return net, out


def test_whitening_of_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = {r["vec_id"]: [int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in table.collect()}
    n, keys = len(rows), sorted(rows)
    x = np.array([rows[k] for k in keys], object)
    sums = x.sum(axis=0)
    v = exact_covariance([rows[k] for k in keys])
    net, out = white_rows(table.repartition(3))
    assert net.rows == n and net.sums == list(sums) and len(net.values) == 32
    wide = np.array([[np.longdouble(str(c.numerator)) / np.longdouble(str(c.denominator)) for c in row] for row in v])
    values, vectors = np.linalg.eigh(wide.astype(np.float64))
    assert np.allclose(net.values, values[::-1][:32], rtol=1e-10)
    held = net.vectors.astype(np.longdouble)
    assert np.abs(wide @ held - held * net.values).max() < 1e-13 * values.max()   # rounding of the vectors to doubles
    assert np.abs(held.T @ held - np.eye(32)).max() < 1e-15
    centred = np.array([[float(Fraction(int(c)) - Fraction(int(s), n)) for c, s in zip(row, sums)] for row in x])
    got = {r["vec_id"]: r for r in out.collect()}
    assert sorted(got) == keys
    for row, c, k in zip(x, centred, keys):
        assert got[k]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        assert np.allclose(got[k]["whitened"], (c @ net.vectors) / np.sqrt(net.values), atol=1e-10)
    assert np.allclose(net.explained, values[::-1][:32] / np.trace(wide.astype(np.float64)), rtol=1e-9)
    assert 0 <= whitening.identity_error(out, "whitened", 32, n) < 1e-9


def test_whitening_does_not_depend_on_partitions(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    one, many = whitening.fit(table.coalesce(1)), whitening.fit(table.repartition(9))
    assert (one.vectors == many.vectors).all() and (one.values == many.values).all()


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, whitened string, deviation int"
    good = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [2.5, 2.0, -3.0]), (4, [0.0, 2.0, 9.0]), (5, [100_000.5, 2.0, 0.25])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [1.0, float("nan"), 2.0]), (9, [float("inf"), 1.0, 2.0]), (10, [1.0]), (11, []), (12, [1e300, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "s", 3) for r in good + bad], kind)
    net, out = white_rows(frame)
    assert net.rows == 5 and len(net.values) == 2          # one dimension has no variance
    rows = out.collect()
    assert out.columns == ["vec_id", "embedding", "whitened", "deviation", "_whitened", "_deviation"] and len(rows) == 5
    assert whitening.identity_error(out, "_whitened", 2, 5) < 1e-9
    assert whitening.fit(frame.limit(0)) is None
    equal = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    net, out = white_rows(equal)
    assert len(net.values) == 0 and [r["whitened"] for r in out.collect()] == [[]] * 3
    assert whitening.identity_error(out, "whitened", 0, 3) == 0.0


def test_deviation_is_exact_or_null(spark):
    big = float(1 << 39)
    frame = spark.createDataFrame([(1, [big]), (2, [-big]), (3, [0.0])], "vec_id long, embedding array<double>")
    _, out = white_rows(frame)
    got = {r["vec_id"]: r["deviation"] for r in out.collect()}
    assert got[1] is None and got[3] == 0
