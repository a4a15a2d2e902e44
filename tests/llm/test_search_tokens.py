import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from sentencepiece import SentencePieceProcessor

from pathloom.llm import suffix_pieces, vector_search
from tests.llm.conftest import words

VOCABULARY = suffix_pieces.vocabulary()


def brute_top(rows, k=5, every=50):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in ok]
    queries = {}
    for i, v in ints:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, qv in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(qv))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n, dim=16):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).tolist()


@pytest.mark.parametrize("case", ["plain", "ties", "odd", "large"])
def test_top_k(spark, case):
    rows = list(enumerate(vectors(1, 400)))
    if case == "ties":
        same = vectors(2, 3)
        rows = [(i, same[i % 3]) for i in range(300)] + [(1000 + i, v) for i, v in enumerate(vectors(3, 60))]
    elif case == "odd":
        rows += [(None, rows[0][1]), (500, None), (550, []), (551, []), (600, [float("nan")] * 16), (650, [None] * 16), (700, [float("inf")] + [0.0] * 15), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (50, rows[3][1]), (7, rows[7][1]), (800, [0.0] * 16)]
    elif case == "large":
        rows = [(i, [x * 1000 * (1 + i % 5) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, ids string")
    assert sorted(map(tuple, vector_search.top_k(df).collect())) == brute_top(rows)


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PAIRS", 40)
    same, some = vectors(7, 1)[0], vectors(8, 60)
    rows = [(50, same)] * 2 + [(i, same) for i in range(51, 56)] + [(100 + i, v) for i, v in enumerate(some)]
    rows += [(200, [3 * (1 + n) * x for x in same]) for n in range(9)] + [(300, same)] * 8 + [(7, [2 * x for x in same])] * 7 + [(7, same)] * 3 + [(8, v) for v in some[:20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vector_search.top_k(df).collect()))
    assert got == brute_top(rows)
    near = spark.createDataFrame(rows[:7] + [(60, [x / 2 for x in same])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vector_search.top_k(near).orderBy("rank").collect()] == [51, 52, 53, 54, 55]


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector_search, "PAIRS", 64)
    rows = list(enumerate(vectors(5, 500)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_search.top_k(df).collect())) == brute_top(rows)


def test_only_a_part_of_the_exact_vectors_is_read(spark, monkeypatch):
    read = []
    inner = vector_search._read
    monkeypatch.setattr(vector_search, "_read", lambda pairs, entries, queries: read.append(pairs.count()) or inner(pairs, entries, queries))
    rows = list(enumerate(vectors(9, 3000)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_search.top_k(df).collect())) == brute_top(rows)
    assert sum(read) < 0.05 * 60 * 3000


def test_bounds_hold_for_large_numbers():
    rng = np.random.default_rng(3)
    for size in (10, 1 << 20, 1 << 28):
        queries, ints = rng.integers(-size, size, (7, 16)), rng.integers(-size, size, (40, 16))
        shift = np.full(40, max(0, int(size).bit_length() - vector_search.CELL_BITS + 1))
        scan = vector_search.Scan(np.arange(7), queries, 5)
        lower, upper = scan.bounds((ints >> shift[:, None]).astype(np.int8), shift)
        exact = [[sum(a * b for a, b in zip(q, x, strict=True)) for x in ints.tolist()] for q in queries.tolist()]
        assert all(lower[i, j] <= exact[i][j] <= upper[i, j] for i in range(7) for j in range(40))


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_search.top_k(df).collect()] == [(0, 1, 1, 64 * 256 + 128 * 256)]
    assert vector_search.top_k(df.limit(0)).count() == 0


# --- pieces -------------------------------------------------------------------------------------------


MODEL = SentencePieceProcessor(model_file=suffix_pieces.VOCABULARY)
LETTERS = "abcdeéñ 中\n\t'"
TEXTS = ["", " ", "Hello  world\n foo\tb", "日本語 テキスト привет распределение", "a" * 3000, "\x00\x01 é ", words(1, 300), "The quick brown fox", "ÀÉ\r\nx y", "ab" * 500 + " " * 77 + "z", "日本語のテキスト、空白なし。" * 60, "<s> <0x0A> </s> <unk>", "👍🏽 ok 𝔘"]


def test_ids_are_those_of_the_model():
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("").tolist()
    rng = random.Random(3)
    texts = TEXTS + docs + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(400))) for _ in range(200)]
    encoder = suffix_pieces.Encoder(*VOCABULARY)
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == MODEL.encode(text)
        assert encoder.decode(ids) == text.encode()


def test_a_sign_that_looks_like_the_mark_comes_back():
    encoder = suffix_pieces.Encoder(*VOCABULARY)
    for text in ("x▁▁y", "▁", "a ▁ b"):
        assert encoder.decode(encoder.encode([text.encode()])[0]) == text.encode()


@pytest.mark.parametrize("text", ["日本語のテキスト、空白なし。" * 400, "ab" * 3000, "Donaudampfschifffahrtsgesellschaft" * 90, "=" * 5000 + "é" * 900])
def test_long_words_are_cut_where_no_piece_crosses(text, monkeypatch):
    monkeypatch.setattr(suffix_pieces, "INDEX_BYTES", 256)
    encoder = suffix_pieces.Encoder(*VOCABULARY)
    assert b"".join(encoder.parts(text.encode())) == text.encode()
    assert encoder.encode([text.encode()])[0].tolist() == MODEL.encode(text)


def test_long_runs_are_cut_where_the_segmentation_is_sure(monkeypatch):
    """Ids of words in which pieces cross each place are the model's, whatever the windows."""
    monkeypatch.setattr(suffix_pieces, "RUN_BYTES", 96)
    rng, cut = random.Random(1), 0
    for _ in range(300):
        signs = rng.choice(["a", "ab", "= ", "a=", "日本", "abc -", "e ", "-_=", "lo", "01", " "])
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(100, 900))) if rng.random() < 0.6 else rng.choice(["ab", "abc", "lol", "haha", "==-", "日本", "  a"]) * rng.randrange(50, 300)
        monkeypatch.setattr(suffix_pieces, "INDEX_BYTES", rng.choice([256, 1 << 18]))
        encoder = suffix_pieces.Encoder(*VOCABULARY)
        assert encoder.encode([text.encode()])[0].tolist() == MODEL.encode(text)
        cut += len(encoder.fronts)
    assert cut > 100


@pytest.mark.parametrize("sign", [" ", "=", "a", "ab"])
def test_megabytes_of_one_sign(sign):
    tracemalloc.start()
    text = sign * (4_000_000 // len(sign))
    ids = suffix_pieces.Encoder(*VOCABULARY).encode([text.encode()])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == MODEL.encode(text)
    assert most < 500 << 20


def test_suffix_array_finds_every_occurrence():
    data = words(3, 200).encode() + "приветствие приветствие".encode()
    pieces = [b"w", b"w1", b" w", "приветствие".encode(), "приве".encode(), b"absent", b"wabsentabsent"]
    encoder = suffix_pieces.Encoder(pieces, np.arange(len(pieces), dtype=np.int32), pieces, np.arange(256, dtype=np.int32))
    start, piece = encoder.edges(data)
    for n, p in enumerate(pieces):
        assert sorted(start[piece == n].tolist()) == [i for i in range(len(data)) if data[i : i + len(p)] == p]


def test_tokens_of_tables(odd_docs, no_docs):
    found = suffix_pieces.token_digest(odd_docs)
    assert found.count() == odd_docs.count() and found.where("text_sha256 <> decoded_sha256").count() == 0
    encoded = suffix_pieces.encode(odd_docs)
    back = sorted((str(r["doc_id"]), r["text"]) for r in suffix_pieces.decode(encoded).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in odd_docs.select("doc_id", "text").collect())
    assert suffix_pieces.token_digest(no_docs).count() == 0
