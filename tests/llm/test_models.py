"""Language, toxicity, neighbours and the pipeline: gradients, held-out accuracy and brute force."""

import tracemalloc

import numpy as np
import pytest
from conftest_llm import frame
from pyspark.sql import functions as F

import corpus_pipeline
from quaymart.llm import language, neighbours, pieces, toxicity, unigram
from quaymart.llm.hilbert import hilbert_keys
from quaymart.llm.queries import op6_neighbours, op9_language_id, op10_toxicity

FOLDER = "/root/testdata/sf0.001"


def test_network_gradients():
    net = language.ByteNetwork(["a", "b", "c"], hidden=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    codes, weight, target = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.ones((6, 5)), np.array([0, 1, 2, 2, 1])
    weight[4:, 1] = 0

    def loss():
        logits = sum(np.stack([s @ net.p[f"{d}o"] for _, s in sorted(((t, s) for t, s, _ in net._run(d, codes)), key=lambda x: x[0])]) for d in "fb") + net.p["o"]
        logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return -(logp[:, np.arange(5), target] * weight).sum() / weight.sum()
    grads = net._gradients(codes, weight, target)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_segments_take_little_more_memory_than_the_texts():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 400, 10_000)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    raw = rng.integers(0, 256, offsets[-1]).astype(np.uint8)
    tracemalloc.start()
    codes, valid, owner = language.segments(raw, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * len(raw)
    assert (valid.sum(), len(valid)) == (len(raw), sum(-(-lengths // language.SEGMENT)))
    for text in (0, 1, 9_999):
        held = np.concatenate([c[:v] for c, v in zip(codes[owner == text], valid[owner == text])] or [raw[:0]])
        assert (held == raw[offsets[text]:offsets[text + 1]]).all()


def test_fast_states_are_the_trained_ones():
    net, rng = language.ByteNetwork(["a", "b"]), np.random.default_rng(1)
    codes = rng.integers(0, 256, (40, 7)).astype(np.uint8)
    logits = np.zeros((40, 7, 2)) + net.p["o"]
    for d in "fb":
        for t, s, _ in net._run(d, codes):
            logits[t] += s @ net.p[f"{d}o"]
    want = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    assert np.allclose(net.position_probabilities(codes), want, atol=1e-5)


def test_languages_held_out(spark):
    rows = op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and held and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_languages_of_odd_frames(spark, odd_texts):
    docs = frame(spark, odd_texts, langs=["en", None, "", " ", *["en", "de"] * 6])
    net = language.train(docs, F.lit(True), steps=3)
    assert set(net.labels) == {"en", "de"}
    told = language.identify(docs, net)
    assert told.columns == [*docs.columns, "lang_pred", "lang_score"]
    rows = {r.doc_id: r for r in told.collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {0, 1, 2, 3, 6, 14} and rows[0].lang_score == 0
    assert rows[8].lang_score == rows[9].lang_score
    nothing = language.train(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.where("doc_id < 0"), net).count() == 0


def test_every_label_is_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20, f"l{k}") for k in range(90)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), steps=1)
    assert len(net.labels) == 90


def test_clashing_names(spark, odd_texts):
    docs = frame(spark, odd_texts, langs=[None, *["en", "de"] * 8])
    clash = docs.select("doc_id", "text", "lang", *[F.lit(k).alias(c) for k, c in enumerate(("_letter", "lang_pred", "lang_score", "_lower", "toxicity", "Ids", "decoded", "n_tokens"))])
    net = language.train(clash, F.lit(True), steps=1)
    told = language.identify(clash, net)
    assert told.columns == [*clash.columns, "_lang_pred", "_lang_score"] and told.where("_letter = 0 AND lang_pred = 1").count() == len(odd_texts)
    bag = toxicity.train(clash, spark.createDataFrame([(4, 1), (5, 0), (5, 1), (5, 0)], "doc_id long, toxic int"))
    scored = toxicity.score(clash, bag)
    assert scored.columns == [*clash.columns, "_toxicity"] and scored.where("_toxicity between 0 and 1 AND toxicity = 4").count() == len(odd_texts)
    coded = pieces.encode(clash, corpus_pipeline.PIECES, decode=True)
    assert coded.columns == [*clash.columns, "_ids", "_decoded"] and coded.where("Ids = 5 AND _decoded is not null").count() == len(odd_texts)
    back = pieces.decode(coded, corpus_pipeline.PIECES, ids="_ids")
    assert back.columns[-1] == "__decoded" and back.where("__decoded = _decoded").count() == len(odd_texts)
    counted = unigram.token_counts(clash, unigram.rank_vocabulary(corpus_pipeline.PIECES))
    assert counted.columns == [*clash.columns, "_n_tokens"] and counted.where("n_tokens = 7 AND _n_tokens >= 0").count() == len(odd_texts)
    kept = corpus_pipeline.by_language(spark, clash, FOLDER)
    assert kept.columns == clash.columns


def test_few_labelled_rows_take_few_batches():
    import pyarrow as pa

    from quaymart.llm.words import text_buffers
    drawn = []
    class Draws:
        def __init__(self, seed):
            self.real = np.random.Generator(np.random.PCG64(seed))
        def __getattr__(self, name):
            return getattr(self.real, name)
        def permutation(self, n):
            drawn.append(n)
            return self.real.permutation(n)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity.np.random, "default_rng", Draws)
        toxicity.SubwordBag().fit(*text_buffers(pa.array(["nice words here", "nasty words here"])), np.array([0, 1]), steps=7)
    assert drawn == [2] * 7


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = op10_toxicity(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    rank = rows.score.rank()
    ones = rows.toxic == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    # 300 toxic texts to learn from, a tenth of them without any toxic word
    assert auc > 0.8 and ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(list("bcdfg")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(300)]
    import pyarrow as pa

    from quaymart.llm.words import text_buffers
    texts = [" ".join([*rng.choice(clean, 30), *(["horrible"] if k % 2 else [])]) for k in range(400)]
    bag = toxicity.SubwordBag().fit(*text_buffers(pa.array(texts)), np.arange(400) % 2, steps=200)
    p = toxicity.document_scores(bag.projection(), bag.bias, *text_buffers(pa.array([" ".join(clean[:20]), " ".join(clean[:20]) + " horible", ""])))
    assert p[1] > p[0] + 0.2


def test_toxicity_of_odd_frames(spark, odd_texts):
    docs = frame(spark, odd_texts)
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (8, 0), (9, None), (None, 1), (10, 7)], "doc_id long, toxic int")
    bag = toxicity.train(docs, labels)
    scored = toxicity.score(docs, bag)
    assert scored.columns == [*docs.columns, "toxicity"]
    rows = {r.doc_id: r.toxicity for r in scored.collect()}
    assert all(0 <= x <= 1 for x in rows.values()) and rows[0] == rows[1] == rows[2] and rows[8] == rows[9]
    assert toxicity.score(docs.where("doc_id < 0"), bag).count() == 0
    one_sided = toxicity.train(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs, one_sided).select("toxicity").distinct().count() == 1


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 3), (3, 2), (4, 2)])
def test_hilbert_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute_neighbours(vectors, queries, k=10):
    out = {}
    for q, v in queries.items():
        found = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in vectors if i != q)
        out[q] = found[:k]
    return out


def test_neighbours_reach_the_recall(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, {i: v for i, v in rows if i % 100 == 0})
    found = {}
    for r in op6_neighbours(spark, FOLDER).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found.keys() == want.keys() and all(len(x) == 10 for x in found.values())
    assert np.mean([len({i for _, i in found[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    exact = dict(rows)
    for q, pairs in found.items():
        assert pairs == sorted(pairs)
        assert all(s == pytest.approx(np.sqrt(((np.array(exact[q]) - np.array(exact[i])) ** 2).sum()), abs=1e-12) for s, i in pairs)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), "x") for i in range(40)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0], "x") for i in range(500)]
    rows += [(2000, None, "x"), (2100, [0.0] * 4, "x"), (2200, [float("nan"), 1.0, 1.0, 1.0], "x"), (2300, [None, 1.0, 1.0, 1.0], "x"), (2400, [float("inf"), 1.0, 1.0, 1.0], "x"),
             (2500, [1.0], "x"), (2600, [], "x"), (None, [1.0] * 4, "x"), (100, rng.normal(size=4).tolist(), "x"), (100, rng.normal(size=4).tolist(), "x")]
    frame_ = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, label string, h int, first int")
    found = {}
    for r in neighbours.nearest(frame_, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == {0, 100, *range(1000, 1500, 100)}
    assert [i for _, i in found[1100]] == list(range(1000, 1010)) and [i for _, i in found[1000]] == list(range(1001, 1011))
    assert all([k for k, _ in x] == list(range(1, 11)) for x in found.values())
    few = neighbours.nearest(frame_.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert neighbours.nearest(frame_.where("vec_id < 0"), F.lit(True)).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_copies", "benchmark", "pieces"]
    odd = docs.unionByName(spark.createDataFrame([(9001, "... 123 !!!", "en", "src0", 11), (9002, None, None, None, None)], docs.schema))
    told = corpus_pipeline.by_language(spark, odd, FOLDER)
    assert told.columns == columns and {r.doc_id for r in odd.collect()} - {r.doc_id for r in told.collect()} == {9001, 9002}
    from test_copies import brute_classes, brute_leaks
    cut = corpus_pipeline.by_lines(spark, docs, FOLDER)
    assert cut.columns == columns and all(r.n_chars == len(r.text) for r in cut.collect())
    kept = corpus_pipeline.by_near_copies(spark, docs, FOLDER)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(brute_classes({r.doc_id: r.text for r in docs.collect()}).values())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    clean = corpus_pipeline.by_benchmark(spark, docs, FOLDER)
    hit = {d for d, _ in brute_leaks({r.doc_id: r.text for r in docs.collect()}, items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - hit
    coded = corpus_pipeline.as_pieces(spark, docs, FOLDER)
    assert coded.where("round_trip").count() == docs.count() and coded.where("n_tokens != size(ids) OR element_at(ids, -1) != 2").count() == 0


def test_pipeline_runs_through(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.count() <= 200
