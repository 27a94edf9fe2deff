"""Operators 2 and 4: byte-level BPE against the library, token store round trips."""

import base64
import hashlib
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from creditspark.llm import arrays as A
from creditspark.llm import bpe, queries, token_store

from .helpers import AWKWARD, docs_of, with_clashes

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'’stmdrevlLSTA019²½٣é中文한à́!?.,-_$​ 　\U0001f600\x00́ſΣσςİ", "'ll", "'re", "<|endoftext|>", "<|"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    fixed = ["", "'", "''s", "'s's'll", "don't  'll   \n 've'", "   ", "a  ", " a", "\n\na", "x" * 5000, "ab" * 3000, "中" * 700, "ß" * 300]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_library_and_decodes(library):
    texts = random_texts(5000, 1)
    v = bpe.Vocabulary(RANKS)
    ids, ends, at = v.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    assert v.decode(ids).tobytes() == "".join(texts).encode()
    i = 9
    own, own_ends = ids[at[i]: at[i + 1]], ends[at[i]: at[i + 1]]
    first, raw = bpe.decode_range(own, own_ends, 3, 8, v)
    assert raw == texts[i].encode()[first: own_ends[7]]


def test_scan_is_associative():
    compose, apply, _ = bpe.transitions()
    assert compose.shape[1] == 9 and apply.shape[1] == 8
    symbols = np.random.default_rng(3).integers(0, 9, 5000).astype(np.uint8)
    state, want = bpe.IDLE, []
    for s in symbols:
        want.append(state)
        state = apply[s, state]
    for block in (1, 7, 256, 10_000):
        assert bpe.scan_states(symbols, block).tolist() == want


def test_classes_are_the_librarys():
    kinds, ranks = bpe.code_point_classes(), {bytes([b]): b for b in range(256)}
    points = [c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000] + list(range(1, 0x300))
    for c in points:
        for lead in "a1!":
            ranks.setdefault((lead + chr(c)).encode(), len(ranks))
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in points:
        one = [len(e.encode_ordinary(lead + chr(c))) == 1 for lead in "a1!"]
        want = bpe.LETTER if one[0] else bpe.NUMBER if one[1] else bpe.OTHER if one[2] else bpe.BLANKS
        if c != 39:
            assert kinds[c] == want, hex(c)


def test_bpe_frames(spark, library):
    docs = with_clashes(docs_of(spark, AWKWARD)).repartition(3)
    got = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS), RANKS).select("doc.*", "ids", "ends", "decoded").drop("ids").columns
    assert "decoded" in got
    rows = bpe.bpe_decode(bpe.bpe_encode(docs.select("doc_id", "text", "ends"), RANKS), RANKS).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in rows) == sorted((library.encode_ordinary(t or ""), (t or "").encode()) for _, t in AWKWARD)
    assert bpe.bpe_encode(docs.limit(0), RANKS).count() == 0


def test_round_trip_has_one_worker_a_task(spark, library):
    import corpus_pipeline

    docs = with_clashes(docs_of(spark, AWKWARD)).repartition(3)
    got = bpe.bpe_round_trip(docs, RANKS)
    assert got.columns == ["doc", "ids", "ends", "decoded"] and got.schema["doc"].dataType == bpe.bpe_encode(docs, RANKS).schema["doc"].dataType
    two = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS), RANKS)
    assert sorted((str(r.doc), r.ids, r.ends, bytes(r.decoded)) for r in got.collect()) == sorted((str(r.doc), r.ids, r.ends, bytes(r.decoded)) for r in two.collect())
    many = docs_of(spark, [(i, f"word {i}") for i in range(2 * bpe.DECODED_ROWS + 1)]).coalesce(1)
    assert all(bytes(r.decoded) == f"word {r.doc.doc_id}".encode() and r.ids == library.encode_ordinary(f"word {r.doc.doc_id}") for r in bpe.bpe_round_trip(many, RANKS).collect())
    assert bpe.bpe_round_trip(docs.limit(0), RANKS).count() == 0
    stage = corpus_pipeline.byte_bpe(spark, docs.selectExpr("doc_id", "'en' lang", "'a' source", "text"), SF)
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_op2_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_hash_cache_clears_and_grows():
    cache = A.HashCache(bits=6)
    rng = np.random.default_rng(0)
    for n in (10, 20, 25, 200, 3):
        h = rng.integers(0, 1 << 40, n).astype(np.uint64)
        h = np.concatenate([h, h])
        ids, at = A.cached_ids(cache, h, lambda new, h=h: [[int(x) % 97] * (int(x) % 3) for x in h[new]])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[int(x) % 97] * (int(x) % 3) for x in h]


def test_word_ids_equal_library():
    texts = random_texts(4000, 2) + ["a<|endoftext|>b", "<|STARTOFTEXT|> <|startoftext|>", "x<|y"]
    plain = Tokenizer.from_file(WORDS)
    ids, at = token_store.CachedTokenizer(WORDS).encode(*A.utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_dac_random_access():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 1 << rng.integers(1, 33, 4000)).astype(np.uint32), np.zeros(0, np.uint32), np.zeros(1500, np.uint32), np.full(513, 2**32 - 1, np.uint32)):
        reader = token_store.DacReader(token_store.dac_levels(ids))
        assert all(reader[i] == ids[i] for i in range(0, len(ids), 7))
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (reader.slice(a, b) == ids[a:b]).all()


def test_token_store(spark):
    plain = Tokenizer.from_file(WORDS)
    for shard in (1000, 4_000_000):
        path = tempfile.mkdtemp(prefix="tokens-") + "/t"
        token_store.write_tokens(with_clashes(docs_of(spark, AWKWARD)), path, WORDS, chars_per_shard=shard)
        order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        start, want, flat = 0, [], []
        for key, text in order:
            ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
            want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
            flat += ids
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_store.read_tokens(spark, path).collect()]
        # rows with one null key and equal keys are told apart by start
        assert sorted(got, key=lambda r: r[1]) == want
        assert token_store.read_range(spark, path, 5, 40).tolist() == flat[5:40]
    path = tempfile.mkdtemp(prefix="tokens-") + "/t"
    token_store.write_tokens(docs_of(spark, []), path, WORDS)
    assert token_store.read_tokens(spark, path).count() == 0
