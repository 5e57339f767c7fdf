"""Near copies, repeated passages, lines and benchmark items against brute force."""

import difflib
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame, words

from quaymart.llm import decontaminate, lines, nearcopies, passages
from quaymart.llm.components import components
from quaymart.llm.words import mix, shingle_hashes, text_buffers, word_hashes

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def shingles(text):
    t = tokens(text)
    return [tuple(t[i:i + 5]) for i in range(len(t) - 4)] if len(t) >= 5 else [tuple(t)] if t else []


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + 1] = rng.choice([[f"new{rng.randrange(10**6)}"], [], [out[at], f"new{rng.randrange(10**6)}"]])
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_word_hashes_follow_words(odd_texts):
    texts = ["Abc abc, ABC", *[t for t in odd_texts], "a" * 600_000 + " b"]
    hashes, _, _, offsets = word_hashes(*text_buffers(pa.array(texts, pa.string())))
    assert np.diff(offsets).tolist() == [len(tokens(t)) for t in texts]
    assert len(set(hashes[:3].tolist())) == 1
    spelled = dict(zip(hashes.tolist(), [w for t in texts for w in tokens(t)]))
    assert [spelled[h] for h in hashes.tolist()] == [w for t in texts for w in tokens(t)]
    _, counts = shingle_hashes(hashes, offsets)
    assert np.diff(counts).tolist() == [len(shingles(t)) for t in texts]


def brute_classes(docs, similarity=0.8):
    """Connected components of exact weighted similarity over all pairs that share a shingle."""
    bags = {d: Counter(shingles(t)) for d, t in docs.items()}
    df = Counter(s for b in bags.values() for s in b)
    n = len(docs)

    def weight(s):
        return min(2.0, 1 + np.log(n / df[s]) / np.log(256)) if df[s] >= n / 256 else 2.0
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    by_text, holders = {}, defaultdict(list)
    for d, t in docs.items():
        if (t or "") in by_text:
            up[find(d)] = find(by_text[t or ""])
        by_text.setdefault(t or "", d)
        for s in bags[d]:
            holders[s].append(d)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[:i]}
    for a, b in pairs:
        common = sum(min(bags[a][s], bags[b][s]) * weight(s) for s in bags[a] if s in bags[b])
        total = sum(c * weight(s) for x in (a, b) for s, c in bags[x].items()) - common
        if common / total >= similarity:
            up[find(a)] = find(b)
    groups = defaultdict(set)
    for d in docs:
        groups[find(d)].add(d)
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("small", [nearcopies.SMALL_BUCKET, 0])
def test_near_copies_are_those_of_brute_force(spark, corpus, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL_BUCKET", small)
    rng = random.Random(4)
    docs = dict(corpus)
    base = [words(k, 120) for k in range(12)]
    for i in range(60):
        docs[10_000 + i] = " ".join(edited(rng, base[i % 12], rng.randrange(0, 4)))
    frame_ = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in nearcopies.near_copies(frame_).collect()}
    assert found == brute_classes(docs)


def test_weighted_samples_agree_as_often_as_similar():
    a, b = [" ".join(words(k, 200)) for k in range(200)], []
    rng = random.Random(1)
    for t in a:
        b.append(" ".join(edited(rng, t.split(), 6)))
    none = nearcopies.Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    sampler, signs = nearcopies.WeightedSampler(128), []
    for side in (a, b):
        h, counts, offsets = nearcopies.bags(*nearcopies.shingled(pa.array(side)))
        signs.append(sampler.signatures(h, counts * none.weights(h), offsets))
    assert abs((signs[0] == signs[1]).mean() - nearcopies.similarities(pa.array(a), pa.array(b), none).mean()) < 0.02


def test_frequencies_are_exact(spark, corpus):
    docs = spark.createDataFrame([(k, f"{v} one line that all of them do share") for k, v in corpus.items()], "doc_id long, text string").repartition(3)
    found = nearcopies.frequencies(docs)
    df = Counter()
    for t in corpus.values():
        h, o = nearcopies.shingled(pa.array([f"{t} one line that all of them do share"]))
        df.update(set(h.tolist()))
    want = sorted(h for h, n in df.items() if n >= len(corpus) / 256)
    assert sorted(found.keys.tolist()) == want


@pytest.mark.parametrize("log2", [8, 16, 20])
def test_counters_never_call_a_shared_shingle_single(spark, log2):
    rng = np.random.default_rng(log2)
    bags_ = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)) for _ in range(40)]
    common = bags_[0][:100]
    bags_ = [np.unique(np.concatenate([b, common])) for b in bags_]
    tables = []
    for at in range(0, 40, 7):
        table = nearcopies.Counters(log2)
        for b in bags_[at:at + 7]:
            table.add(b)
        k, packed = zip(*table.chunks(1 << min(nearcopies.CHUNK_LOG2, log2)))
        tables.append(pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bits"]))
    size = 1 << min(nearcopies.CHUNK_LOG2, log2)
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for batch in nearcopies._merged(iter(tables)):
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bits[k * size // 8:(k + 1) * size // 8] = np.frombuffer(part, np.uint8)
    once = np.unpackbits(bits).astype(bool)
    cells = Counter(c for b in bags_ for c in nearcopies._cells(b, log2).tolist())
    assert once.tolist() == [cells[c] == 1 for c in range(1 << log2)]


def test_bound_in_passes_and_small_tables(spark, corpus, monkeypatch):
    monkeypatch.setattr(nearcopies, "SMALL_BUCKET", 0)
    monkeypatch.setattr(nearcopies, "CELLS_LOG2", 10)
    monkeypatch.setattr(nearcopies, "LEAST_LOG2", 8)
    monkeypatch.setattr(nearcopies, "CHUNK_LOG2", 8)
    rng = random.Random(8)
    base = [words(k, 120) for k in range(6)]
    docs = {i: " ".join(edited(rng, base[i % 6], rng.randrange(0, 5))) for i in range(80)}
    frame_ = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nearcopies.near_copies(frame_).collect()} == brute_classes(docs)


@pytest.mark.parametrize("log2", [12, 20])
def test_differences_from_the_hub_lose_no_link(spark, monkeypatch, log2):
    monkeypatch.setattr(nearcopies, "CELLS_LOG2", log2)
    monkeypatch.setattr(nearcopies, "LEAST_LOG2", 6)
    monkeypatch.setattr(nearcopies, "CHUNK_LOG2", min(log2, 18))
    rng = random.Random(21)
    base = words(5, 100)
    texts_ = [" ".join(base)]
    for spot in range(12):
        drifted = edited(rng, base, 1 + spot % 5)
        for _ in range(6):
            texts_.append(" ".join(edited(rng, drifted, rng.randrange(4))))
    texts_ += [" ".join(base[:60 + k] + words(800 + k, 30)) for k in range(8)] + [" ".join(base * 2), " ".join(base[:30] * 3), " ".join(base + base[:20])]
    texts_ = sorted(set(texts_), key=texts_.index)
    common = Counter(s for t in texts_ for s in set(nearcopies.shingled(pa.array([t]))[0].tolist()))
    often = [s for s, k in common.items() if k > 20]
    weights = nearcopies.Frequencies(np.array(often, np.uint64), np.array([common[s] for s in often]), len(texts_))
    of = lambda pairs: nearcopies.similarities(pa.array([texts_[a] for a, _ in pairs]), pa.array([texts_[b] for _, b in pairs]), weights)
    near_hub = of([(0, k) for k in range(len(texts_))]) >= nearcopies.SIMILARITY
    name = lambda k: f"{k:04d}".encode()
    open_ = spark.createDataFrame([(name(0), name(k), name(0 if near_hub[k] else k), [7]) for k in range(len(texts_))],
                                  "hub binary, uid binary, c binary, bands array<long>")
    frame_ = spark.createDataFrame([(name(k), t) for k, t in enumerate(texts_)], "uid binary, text string")
    found = {(int(bytes(r.a)), int(bytes(r.b))) for r in nearcopies._by_differences(open_, frame_, spark.sparkContext.broadcast(weights)).distinct().collect()}
    every = [(a, b) for a in range(len(texts_)) for b in range(a + 1, len(texts_)) if not (near_hub[a] and near_hub[b])]
    links = {p for p, s in zip(every, of(every)) if s >= nearcopies.SIMILARITY}
    assert links and links <= found <= set(every)
    assert any(near_hub[a] != near_hub[b] for a, b in links) and any(not near_hub[a] and not near_hub[b] for a, b in links)
    if log2 == 20:
        assert len(found) < len(every) / 2


def test_pairs_of_large_buckets_are_made_once(spark):
    rng = random.Random(23)
    base, other = words(5, 100), words(6, 40)
    texts_ = [" ".join(base)] + [" ".join(edited(rng, base[:60] + other, 1)) for _ in range(40)]
    none = nearcopies.Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.int64), len(texts_))
    name = lambda k: f"{k:04d}".encode()
    open_ = spark.createDataFrame([(name(0), name(k), name(k), [7]) for k in range(len(texts_))], "hub binary, uid binary, c binary, bands array<long>")
    frame_ = spark.createDataFrame([(name(k), t) for k, t in enumerate(texts_)], "uid binary, text string")
    made = [(int(bytes(r.a)), int(bytes(r.b))) for r in nearcopies._by_differences(open_, frame_, spark.sparkContext.broadcast(none)).collect()]
    every = [(a, b) for a in range(1, len(texts_)) for b in range(a + 1, len(texts_))]
    near = nearcopies.similarities(pa.array([texts_[a] for a, _ in every]), pa.array([texts_[b] for _, b in every]), none) >= nearcopies.SIMILARITY
    links = {p for p, s in zip(every, near) if s}
    assert links and links <= set(made)
    assert len(made) <= 1.1 * len(set(made))


def test_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = words(77, 150)
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(300)]
    rows += [(5000 + i, " ".join(words(i, 60))) for i in range(100)]
    found = {r.doc_id: r.class_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i, _ in rows if i < 5000} == {0}
    assert all(found[i] == i for i, _ in rows if i >= 5000)
    kept = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == 101


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[102] == 100 and found[200] == 200


def test_compact_windows_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 60, 5))])
        hashes = rng.integers(0, 1 << 63, offsets[-1]).astype(np.uint64)
        owner, _, a, c, b = passages.compact_windows(hashes, offsets, 1, 7)
        values, want = mix(hashes + np.uint64(3 * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> passages.PLACE_BITS, set()
        for d in range(5):
            v = values[offsets[d]:offsets[d + 1]]
            for p in range(len(v)):
                x = y = p
                while x and v[x - 1] > v[p]:
                    x -= 1
                while y < len(v) - 1 and v[y + 1] > v[p]:
                    y += 1
                if y - x + 1 >= 7:
                    want.add((d, x, p, y))
        assert set(zip(owner.tolist(), a.tolist(), c.tolist(), b.tolist())) == want


def test_stretches_give_the_passages_of_whole_texts():
    shared = words(3, 80)
    x = " é ".join([" ".join(words(10, 7000)), " ".join(shared), " ".join(words(11, 30))])
    y = " ".join(words(12, 20) + shared[:40] + ["new"] + shared[40:] + words(13, 400))
    sides, held = [], []
    for text in (x, y):
        found, _, _, at = passages.word_hashes(*passages.text_buffers(pa.array([text])))
        hashes, offsets = passages.shingle_hashes(found, at)
        sides.append(hashes)
        held.append([{int(k): (int(a), int(c), int(b)) for _, k, a, c, b in zip(*passages.compact_windows(hashes, offsets, f))} for f in range(passages.FUNCTIONS)])
    matches = [(f, *held[0][f][k], *held[1][f][k]) for f in range(passages.FUNCTIONS) for k in held[0][f].keys() & held[1][f].keys()]
    names = ["f", "a", "c", "b", "ha", "hc", "hb"]
    rows = pa.RecordBatch.from_pylist([{"k": 2, "u": 2, "hk": 1, "hu": 1, "found": [dict(zip(names, m)) for m in matches], "x": x}] * 2)
    cut = [r for batch in passages._stretches(iter([rows])) for r in batch.to_pylist()]
    assert len(cut) == 2 and cut[0] == cut[1]
    assert len(cut[0]["x"]) < len(x) / 2
    low = cut[0]["low"]
    found, _, _, at = passages.word_hashes(*passages.text_buffers(pa.array([cut[0]["x"]])))
    short = passages.shingle_hashes(found, at)[0]
    assert (short == sides[0][low:low + len(short)]).all()
    moved = [(f, a - low, c - low, b - low, *other) for f, a, c, b, *other in matches]
    whole = passages.common_passages(*sides, matches)
    assert whole and whole == [(i + low, j + low, *other) for i, j, *other in passages.common_passages(short, sides[1], moved)]


def test_passages_are_found_where_planted(spark, corpus):
    rng = random.Random(5)
    passage = [words(900 + k, 80) for k in range(6)]
    docs = dict(corpus)
    for i in range(60):
        near = edited(rng, passage[i % 6], i // 6 % 2)
        docs[20_000 + i] = " ".join(words(3000 + i, rng.randrange(10, 90)) + near + words(6000 + i, rng.randrange(10, 90)))
    for i in range(30):
        docs[30_000 + i] = " ".join(words(9000 + i, 150))
    rows = passages.repeated_passages(spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, text string")).collect()
    caught = {r.doc_id for r in rows} | {r.other_doc_id for r in rows}
    assert all(20_000 + i in caught for i in range(60)) and not any(30_000 + i in caught for i in range(30))
    for r in rows:
        assert r.other_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        a, b = (tokens(docs[d])[s:s + n] for d, s, n in ((r.doc_id, r.start_word, r.n_words), (r.other_doc_id, r.other_start_word, r.other_n_words)))
        x, y = Counter(shingles(" ".join(a))), Counter(shingles(" ".join(b)))
        assert sum((x & y).values()) / sum((x | y).values()) == pytest.approx(r.similarity)
    # every exact run of 50 words that an earlier text holds belongs to a caught document
    first = {}
    for d in sorted(docs):
        t = tokens(docs[d])
        for run in {tuple(t[i:i + 50]) for i in range(len(t) - 49)}:
            if first.setdefault(run, d) != d:
                assert d in {r.doc_id for r in rows}


def multiset_similarity(a, b):
    x, y = Counter(shingles(" ".join(a))), Counter(shingles(" ".join(b)))
    return sum((x & y).values()) / sum((x | y).values())


def drifting(rng, chains, generations, phrases):
    """Documents that each hold a passage of 64 words with one word of its predecessor's changed, between other words and frequent phrases."""
    docs, passage_of = {}, {}
    for chain in range(chains):
        passage = words(40_000 + chain, 64)
        for g in range(generations):
            if g:
                passage = list(passage)
                passage[rng.randrange(len(passage))] = f"new{rng.randrange(10**6)}"
            at = 1_000 * g + chain
            around = [words(50_000 + 2 * at + side, rng.randrange(10, 60)) + rng.choice(phrases) for side in (0, 1)]
            docs[at], passage_of[at] = " ".join(around[0] + list(passage) + around[1]), list(passage)
    return docs, passage_of


@pytest.mark.parametrize("ordered", [True, False])
def test_copies_of_copies_are_found(spark, ordered):
    rng = random.Random(11)
    docs, passage_of = drifting(rng, 30, 8, [words(60_000 + k, 14) for k in range(5)])
    if not ordered:   # generations in random order of ids, chain by chain
        to = {}
        for chain in range(30):
            mine = [d for d in docs if d % 1_000 == chain]
            to.update(zip(mine, rng.sample(mine, len(mine))))
        docs, passage_of = {to[d]: t for d, t in docs.items()}, {to[d]: t for d, t in passage_of.items()}
    rows = passages.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    wanted = {d for d in docs if any(e < d and e % 1_000 == d % 1_000 and multiset_similarity(passage_of[d], passage_of[e]) >= 0.8 for e in docs)}
    recall = len(wanted & {r.doc_id for r in rows}) / len(wanted)
    print(f"recall {recall:.3f} of {len(wanted)}")
    assert len(wanted) > 100 and recall >= (0.95 if ordered else 0.9)
    assert len({(r.doc_id, r.start_word, r.other_doc_id) for r in rows}) == len(rows)
    for r in rows:
        assert r.doc_id % 1_000 == r.other_doc_id % 1_000 and r.other_doc_id < r.doc_id and r.n_words >= 50
        a, b = (tokens(docs[d])[s:s + n] for d, s, n in ((r.doc_id, r.start_word, r.n_words), (r.other_doc_id, r.other_start_word, r.other_n_words)))
        assert multiset_similarity(a, b) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_the_only_similar_holder_is_found_at_any_distance(spark):
    """Every shingle of the passage is once in each of 162 sets of three pieces, before and between the two texts that hold the whole of it."""
    passage, docs = words(81_000, 64), {}
    for i in range(3 * 162):
        at = 20 * (i % 3)
        docs[i + (i >= 36)] = " ".join(words(82_000 + 2 * i, 60) + passage[at:at + 24] + words(82_001 + 2 * i, 60))
    for i in (36, 487):
        docs[i] = " ".join(words(90_000 + 2 * i, 60) + passage + words(90_001 + 2 * i, 60))
    rows = passages.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_doc_id) for r in rows} == {(487, 36)}


def test_ended_tables_and_shuffles_leave_the_disk(spark, monkeypatch):
    """Of the tables that a run stores, those that its result does not read are gone at its end; shuffle files go with their step."""
    folders, plain = [], passages.stored

    def recorded(df, **options):
        table = plain(df, **options)
        folders.append(Path(table.inputFiles()[0].removeprefix("file:")).parent)
        return table

    blocks = [Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    count = lambda: sum(1 for x in blocks for _ in x.glob("*/shuffle_*.data"))
    monkeypatch.setattr(passages, "stored", recorded)
    docs = spark.createDataFrame([(i, " ".join(words(91_000, 60))) for i in range(6)], "doc_id long, text string")
    passages.release_shuffles(docs)
    time.sleep(3)
    before = count()
    rows = passages.repeated_passages(docs)
    assert not folders[0].exists() and not folders[2].exists()   # windows, texts
    assert rows.count() >= 5 and sum(x.exists() for x in folders) < len(folders) - 5
    until = time.time() + 20
    while count() > before + 4 and time.time() < until:
        time.sleep(0.5)
    assert count() <= before + 4   # those of the count above, in four parts


def test_distances_reach_every_near_holder_and_the_farthest():
    for holders in (0, 1, 15, 16, 17, 1_000, 10 ** 6):
        steps = passages._distances(holders)
        assert steps[:16] == list(range(1, 17)) and steps[-1] >= holders and sorted(set(steps)) == steps
        assert all(b - a <= max(1, a // 4) for a, b in zip(steps, steps[1:])) and len(steps) <= 100


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(rng.randrange(12))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(12) for _ in range(rng.randrange(3))]
        found = lines.aligned(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
    long = list(range(200))
    assert lines.aligned(long, long[:50] + [-1] + long[60:]) == [(i, i) for i in range(50)] + [(i, i - 9) for i in range(60, 200)]
    assert difflib.SequenceMatcher(None, long, long[5:]).ratio() > 0.9 and len(lines.aligned(long, long[5:])) == 195


def test_lines_go_from_later_texts_only(spark, corpus):
    cut = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(list(corpus.items()), "doc_id long, text string")).collect()}
    first = {}
    for d in sorted(corpus):
        for x in corpus[d].split("\n"):
            first.setdefault(x.strip(), d)
    left = {x.strip() for r in cut.values() for x in r.text.split("\n")}
    assert all(x in left for x in first)
    for d, r in cut.items():
        gone = Counter(corpus[d].split("\n")) - Counter(r.text.split("\n"))
        assert r.n_lines == len(corpus[d].split("\n")) and all(first[x.strip()] < d for x in gone if x.strip())


def test_rare_blocks_and_frequent_lines_go(spark):
    block = [f"shared line number {i} of the block" for i in range(4)]
    docs = [(i, f"own {i}\nAll rights reserved.\nother {i}\nlast {i}\nvery last {i}") for i in range(400)]
    docs += [(1000, "\n".join(["head", *block, "", "tail"])), (1001, "\n".join(["top", *block, "", "end"])), (1002, "\n".join(["top", *block, "", "end"])), (1003, None), (1004, "\n \n")]
    out = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == (i > 0) for i in range(400)) and out[1000].n_removed == 0
    assert out[1001].text == "top\nend" and out[1002].text == "" and out[1002].n_left == 0
    assert out[1003].text is None and out[1003].n_lines == 0 and out[1004].n_removed == 0


def test_lines_that_many_texts_share_go(spark):
    """Against all pairs of texts: lines keep their order and occur once a text, so that no alignment can cross."""
    rng = random.Random(4)
    docs = {}
    for i in range(300):
        own = [(rng.randrange(1000), f"own line {i} {k}") for k in range(6)]
        common = [(100 * k, f"line {k} that a third of the texts hold") for k in range(3) if rng.random() < 0.33]
        block = [(500 + k / 10, f"line {k} of a block that a third of the texts hold") for k in range(4)] * (rng.random() < 0.33)
        docs[i] = [x for _, x in sorted(own + common + block)]
    ids = sorted(docs)
    want = {d: {docs[d][j] for e in ids if e < d and set(docs[e]) & set(docs[d]) for a, b in lines.common_blocks(docs[e], docs[d]) for j in range(a, b)} for d in ids}
    rows = lines.line_dedup(spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()], "doc_id long, text string")).collect()
    assert sum(map(len, want.values())) > 400
    assert {r.doc_id: set(docs[r.doc_id]) - set(r.text.split("\n")) for r in rows} == want


def test_holder_of_many_texts_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lines, "SLOT", 7)
    docs = [(i, f"own {i}\nshared one\nother {i}\nshared two\nlast {i}") for i in range(50)] + [(100 + i, f"any {i}\nshared one\nmore {i}") for i in range(20)]
    rows = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0].n_removed == 0 and all(rows[i].n_removed == 2 for i in range(1, 50))


def brute_leaks(docs, items, similarity=0.8):
    out = {}
    bytes_of = lambda s: sum(len(w.encode()) for w in s)
    for k, t in items.items():
        bag = Counter(shingles(t))
        if not bag:
            continue
        n = len(tokens(t))
        for d, text in docs.items():
            words_ = tokens(text)
            if n < 5:
                runs = [[tuple(words_[i:i + n])] for i in range(len(words_) - n + 1)]
            else:
                s = shingles(text)
                size = min(sum(bag.values()), len(s))
                runs = [s[i:i + size] for i in range(len(s) - size + 1)] if any(x in bag for x in s) else []
            for run in map(Counter, runs):
                common = sum((run & bag)[x] * bytes_of(x) for x in run & bag)
                score = common / sum((run | bag)[x] * bytes_of(x) for x in run | bag)
                if score >= similarity:
                    out[d, k] = max(out.get((d, k), 0), score)
    return out


def test_leaks_are_those_of_brute_force(spark, corpus):
    rng = random.Random(8)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    items |= {900: "four words in all", 901: "", 902: None, 903: items[3]}
    docs = dict(corpus)
    for i in range(80):
        inside = edited(rng, items[i % 40].split(), rng.randrange(0, 4))
        docs[40_000 + i] = " ".join(words(i, rng.randrange(0, 40)) + inside + words(i + 500, rng.randrange(0, 40)))
    docs[50_000] = "here are Four words, in all of this"
    frames = [spark.createDataFrame(list(x.items()), f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(*frames).collect()}
    want = brute_leaks(docs, items)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    clean = {r.doc_id for r in decontaminate.without_leaks(*frames).collect()}
    assert clean == docs.keys() - {d for d, _ in want}


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    index = decontaminate._Size(prints.tolist(), list(range(300)))
    asked = prints[:100].copy()
    for i in range(100):
        for bit in rng.choice(64, rng.integers(0, decontaminate.RADIUS + 4), replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(bit)
    window, item, distance = index.within(asked)
    every = np.bitwise_count(asked[:, None] ^ prints[None])
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*map(list, np.nonzero(every <= decontaminate.RADIUS))))
    assert (every[window, item] == distance).all()


def test_odd_frames(spark, odd_texts):
    docs = frame(spark, [*odd_texts, (None, "no id at all here"), (3, "twice the same row here"), (3, "twice the same row here")])
    items = spark.createDataFrame([(1, "same text of five words"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {8, 9}
    assert decontaminate.without_leaks(docs, items).columns == docs.columns
    classes = nearcopies.near_copies(docs).collect()
    assert len(classes) == docs.count()
    by_id = {r.doc_id: r.class_id for r in classes}
    assert by_id[1] == 0 and by_id[9] == 8 and by_id[11] == 10
    assert nearcopies.one_of_each(docs).columns == docs.columns
    cut = lines.line_dedup(docs)
    assert cut.columns[:len(docs.columns)] == docs.columns and cut.count() == docs.count()
    assert {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(docs).collect()} == {(11, 10)}


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(none, items).count() == decontaminate.without_leaks(none, items).count() == 0
    assert nearcopies.near_copies(none).count() == nearcopies.one_of_each(none).count() == 0
    assert lines.line_dedup(none).count() == passages.repeated_passages(none).count() == 0


def test_candidates_for_frequent_shingles_take_little_more_memory_than_the_shingles():
    rng = np.random.default_rng(3)
    said = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(["such a very common phrase"] * (i % 2) + [said[k] for k in rng.integers(0, len(said), 300)]) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    held = sum(len(t.split()) - 4 for t in texts) * 8
    tracemalloc.start()
    found = [h for part in nearcopies._frequent_in_chunks(iter([batch])) for h in part.column(0).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    phrase, _ = nearcopies.shingled(pa.array(["such a very common phrase"], pa.large_string()))
    assert found == phrase.view(np.int64).tolist() and most < 2 * held + (24 << 20)   # and the arrays of one slice


def test_parts_of_a_batch_are_bounded_in_both_texts():
    rng = np.random.default_rng(4)
    a, b = (["x" * int(n) for n in rng.integers(0, 200_000, 60)] for _ in range(2))
    a[7], b[11], b[12] = None, "y" * (3 << 20), None
    whole = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["ta", "tb"])
    parts = list(nearcopies.cut(whole, "ta", "tb"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole]))
    for part in parts:
        for column in part.columns:
            assert len(part) == 1 or sum(len(t or "") for t in column.to_pylist()) <= nearcopies.SLICE
