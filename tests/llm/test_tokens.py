"""Token counts, pieces and token files against the libraries."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest_llm import frame
from tokenizers import Tokenizer, models, pre_tokenizers

from quaymart.llm import pieces, tokenfiles, unigram
from quaymart.llm.queries import PIECES, WORDS, op2_token_counts, op4_pieces, op5_token_files

FOLDER = "/root/testdata/sf0.001"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = list("abcXYZ.,!'st d\n\t\x1c\xa0ßÀéµ½|<>-_#0123▁") + ["<|endoftext|>", "İ", "Σ", "日本", "क़", "\U0001F916", "  ", "there", "tion"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def unigram_library(vocabulary, byte_fallback):
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return library


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("ties", [False, True])
def test_counts_are_those_of_the_library(byte_fallback, ties, odd_texts):
    vocabulary = unigram.rank_vocabulary(PIECES)
    if ties:
        vocabulary = [(p, float(round(s))) for p, s in vocabulary]
    if not byte_fallback:
        vocabulary = [(p, s) for p, s in vocabulary if not p.startswith("<0x")]
    library = unigram_library(vocabulary, byte_fallback)
    count = unigram.UnigramCounter(vocabulary, byte_fallback).counter(limit=50)
    for text in [t for t in odd_texts if t and len(t) < 50_000] + random_texts(1500):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]
    assert count(None) == count("") == 0


def test_pieces_are_those_of_the_library(odd_texts):
    merges = pieces.MergeEncoder(PIECES)
    texts = odd_texts + random_texts(3000)
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        for text, ids in zip(part, merges.encode(part, [])):
            assert ids == merges.library.encode(text or ""), (text or "")[:80]


def test_heap_and_matrix_agree():
    merges = pieces.MergeEncoder(PIECES)
    words = list({w for t in random_texts(2000, 5) for w in merges.words(t)})
    assert merges.encode_words(words) == [merges.encode_word("▁" + w) for w in words]


def test_words_are_those_of_the_library(odd_texts):
    library, mine = Tokenizer.from_file(WORDS), tokenfiles.WordIds(WORDS)
    texts = [t for t in odd_texts if t is None or len(t) < 50_000] + random_texts(4000)
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        for text, ids in zip(part, mine.encode(part, b"")):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_few_held_words_give_the_same_ids(odd_texts, monkeypatch):
    texts = [t for t in odd_texts if t is None or len(t) < 50_000] + random_texts(400)
    many, merges = tokenfiles.WordIds(WORDS).encode(texts, b""), pieces.MergeEncoder(PIECES)
    right = merges.encode(texts, [])
    monkeypatch.setattr(tokenfiles, "WORDS_HELD", 60)
    monkeypatch.setattr(pieces, "HELD", 60)
    few, merges = tokenfiles.WordIds(WORDS), pieces.MergeEncoder(PIECES)
    for _ in range(2):
        assert [x for at in range(0, len(texts), 9) for x in few.encode(texts[at:at + 9], b"")] == many
        assert [x for at in range(0, len(texts), 9) for x in merges.encode(texts[at:at + 9], [])] == right


def test_one_object_per_worker_and_key():
    from quaymart.llm.memo import per_worker
    made = []
    make = lambda: made.append(1) or object()
    first = per_worker("test", 1, make)
    assert per_worker("test", 1, make) is first and len(made) == 1
    assert per_worker("test", 2, make) is not first and len(made) == 2


def test_shard_round_trip_and_damage(tmp_path):
    docs = [(None, b""), (1, np.arange(5, dtype="<u4").tobytes()), (2, np.arange(200_000, dtype="<u4").tobytes()), (2, b""), (9, np.array([7], "<u4").tobytes())]
    path = str(tmp_path / "s")
    with pa.OSFile(path, "wb") as stream:
        shard = tokenfiles.ShardWriter(stream)
        for d in docs:
            shard.add(*d)
        assert shard.close() == (5, 200_006)
    with pa.OSFile(path, "rb") as file:
        reader = tokenfiles.ShardReader(file)
        assert [(d, ids) for d, _, ids in reader.documents()] == docs
        seen = []
        plain = reader.read_frame
        reader.read_frame = lambda k: seen.append(k) or plain(k)
        assert [(d, s) for d, s, _ in reader.documents({9})] == [(9, 200_005)]
        assert len(seen) == 1   # only the frame that holds it
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with pa.OSFile(path, "rb") as file, pytest.raises(Exception):
        list(tokenfiles.ShardReader(file).documents())


def test_queries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = op4_pieces(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    words, start = Tokenizer.from_file(WORDS), 0
    found = {r.doc_id: r for r in op5_token_files(spark, FOLDER).collect()}
    for d in sorted(docs):
        ids = [*words.encode(docs[d], add_special_tokens=False).ids, 1]
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    counts = unigram_library(unigram.rank_vocabulary(PIECES), True)
    for r in op2_token_counts(spark, FOLDER).collect():
        assert r.n_tokens == len(counts.encode(docs[r.doc_id], add_special_tokens=False).ids)


def test_odd_frames(spark, odd_texts, tmp_path):
    docs = frame(spark, [*odd_texts, (None, "no id"), (3, "twice"), (3, "twice")])
    coded = pieces.encode(docs, PIECES, end_id=2, decode=True)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    for r in coded.collect():
        assert r.ids[-1] == 2 and (r.text is None or r.decoded == r.text or "▁" in r.text)
    assert pieces.decode(coded.drop("decoded"), PIECES).where("decoded is null").count() == 0
    assert unigram.token_counts(docs, unigram.rank_vocabulary(PIECES)).where("n_tokens = 0").count() == 2
    folder = str(tmp_path / "tokens")
    tokenfiles.write_token_files(docs, folder, WORDS, 1)
    back = tokenfiles.read_token_files(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in back) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert back and max(r.start + r.n_tokens for r in back) == sum(r.n_tokens for r in back)
    one = tokenfiles.read_token_files(spark, folder, wanted=[4]).collect()
    assert [r.doc_id for r in one] == [4]


def test_empty_tables(spark, tmp_path):
    none = frame(spark, ["x"]).where("doc_id < 0")
    assert pieces.encode(none, PIECES).count() == 0
    assert unigram.token_counts(none, unigram.rank_vocabulary(PIECES)).count() == 0
    folder = str(tmp_path / "empty")
    tokenfiles.write_token_files(none, folder, WORDS, 1)
    assert tokenfiles.read_token_files(spark, folder).count() == 0


def test_vocabulary_file_is_read_from_its_own_place():
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES
