import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import importance, lexical_index, rotation_codes
from pathloom.llm.common import member_filter, with_ordinal
from tests.llm.conftest import words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RUN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


# --- importance resampling ----------------------------------------------------------------------------


def runs_of(text, least, most):
    found = RUN.findall((text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + n]) for n in range(least, most + 1) for i in range(len(found) - n + 1)]


def brute_resample(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    read = [(i, *runs_of(t, least, most)) for i, t in docs]
    s, t = Counter(bucket(x) for _, _, xs in read for x in xs), Counter(bucket(x) for text in target for x in runs_of(text, least, most)[1])
    ss, tt = s.total(), t.total()
    rows = []
    for i, n, xs in read:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in map(bucket, xs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(xs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: sum(r[4] for r in rows) * percent // 100]
    return sorted((str(r[0]), *r[1:4]) for r in rows), [(r[0], r[3]) for r in drawn]


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice(["Alpha", "béta", "GAMMA_x", "d-e", "ÀÉ", "w" + str(r.randrange(50))]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("case", ["plain", "runs", "few buckets", "many buckets"])
def test_resampling_is_brute_force_s(spark, case):
    options = {"plain": {}, "runs": {"least": 1, "most": 3}, "few buckets": {"least": 2, "most": 2, "buckets": 7, "percent": 35}, "many buckets": {"buckets": 1_000_000}}[case]
    docs = [*enumerate(texts(1, 300)), (7, "again " * 40), (7, "again " * 40), (None, words(5, 200)), (400, None), (401, ""), (402, " ._ "), (403, words(6, 20000)), (404, "a" * 200_000)]
    target = [*texts(2, 20), None, ""]
    df = spark.createDataFrame([(i, t, 1, 2.5) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(5)
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()
    rows, drawn = brute_resample(docs, target, **options)
    assert sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"]) for r in found) == rows
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


def test_resampling_of_odd_tables(spark, odd_docs, no_docs):
    found = importance.resample(odd_docs, odd_docs)
    assert found.count() == odd_docs.count() and found.where("rank is not null").count() == 0
    assert importance.resample(no_docs, odd_docs).count() == 0
    alone = importance.resample(odd_docs, no_docs, percent=100, least_words=0)
    assert sorted(r["rank"] for r in alone.collect()) == list(range(1, odd_docs.count() + 1))
    drawn = importance.resampled_documents(odd_docs, odd_docs, percent=100)
    assert drawn.columns == odd_docs.columns and drawn.count() == 8


def test_spans_are_those_of_the_runs():
    text = importance.collapsed("Ab, c__D  é\x00x1".encode())
    assert text == "ab c d é x1".encode()
    assert [text[a:b].decode() for a, b in importance.run_spans(text, 2, 3)] == ["ab c", "c d", "d é", "é x1", "ab c d", "c d é", "d é x1"]


def test_ordinals_of_many_equal_keys(spark):
    df = spark.range(5000).selectExpr("id % 3 as k", "id")
    found = with_ordinal(df, df["k"].desc(), df["id"].asc()).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in found] == list(range(5000))
    assert [(r["k"], r["id"]) for r in found] == sorted(((i % 3, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


# --- lexical search -----------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, ws, Counter(ws)) for i, ws in terms if ws]
    n, total, df = len(terms), sum(len(x[1]) for x in terms), Counter(w for x in terms for w in x[2])
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, query in asked.items():
        weight = {w: times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w, times in query.items() if df[w]}
        scores = []
        for i, ws, tf in terms:
            m = 100 - 75 + (75 * len(ws) * n) // total
            score = sum(weight[w] * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in weight if tf[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(str(item), r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found_by(df, rows, items, spark, **options):
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in lexical_index.ranked_documents(df, items, **options).collect()), key=str)


@pytest.mark.parametrize("case", ["plain", "small shards", "few items at a time"])
def test_search_is_brute_force_s(spark, case, monkeypatch):
    if case != "plain":
        monkeypatch.setattr(lexical_index, "BLOCK", 4)
        monkeypatch.setattr(lexical_index.shard_postings, "__defaults__", (4,))
    if case == "few items at a time":
        monkeypatch.setattr(lexical_index, "ITEMS", 2)
    r = random.Random(4)
    word = lambda: "W" + str(int(r.paretovariate(0.5)) % 300)
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 80)))) for i in range(700)]
    docs += [(i, docs[3][1]) for i in range(1000, 1060)] + [(3, docs[3][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, " .-_ "), (2003, words(3, 9000) + " w1 w2 W2"), (2004, "ÀÉ é w7_w8")]
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)] + [(10, docs[3][1]), (11, None), (12, ""), (13, "unheardof"), (None, "w1 w2"), (14, "É é w7 W7"), (15, "w2 w2 w2 w9"), (15, "w9 w3")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, shard int").repartition(3)
    assert found_by(df, docs, items, spark, shard_bytes=2000 if case == "small shards" else 1 << 20) == brute_search(docs, items)


def test_blocks_are_rejected_before_they_are_read():
    r = random.Random(8)
    # every document has some of the frequent words; one word in a hundred documents decides
    docs = [" ".join(["common"] * r.randrange(1, 4) + ["usual"] * r.randrange(3) + (["rare"] if i % 100 == 0 else []) + [f"x{r.randrange(9999)}"] * r.randrange(1, 60)).encode() for i in range(20_000)]
    terms, x, sizes = lexical_index.shard_postings(docs)
    norm = lexical_index.Norm(len(docs), int(sizes.sum()))
    lists = {}
    for n, term in enumerate(terms):
        if term in (b"common", b"usual", b"rare"):
            b, e = slice(*x["blocks_to"][n : n + 2]), slice(*x["best_to"][n : n + 2])
            raw = bytes(x["raw"][x["bytes_to"][n] : x["bytes_to"][n + 1]])
            lists[term] = lexical_index.Postings({"df": int(x["df"][n]), "last": x["last"][b], "stop": x["stop"][b], "best_stop": x["best_stop"][b], "best_tf": x["best_tf"][e], "best_size": x["best_size"][e], "postings": raw}, norm)
    m, ids = norm.m(sizes), np.arange(len(docs))
    weights = {b"common": 5, b"usual": 40, b"rare": 5000}
    got = lexical_index.Query([(weights[t], p) for t, p in lists.items()], m, ids, np.ones(len(docs), dtype=bool), 10).run()
    brute = []
    for i, d in enumerate(docs):
        tf = Counter(d.split())
        score = sum(w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * int(m[i]))) for t, w in weights.items() if tf[t])
        brute.append((-score, i))
    assert got == [(i, -s) for s, i in sorted(brute)[:10]]
    assert len(lists[b"common"].read) < 0.5 * len(lists[b"common"].last)
    for p in lists.values():
        docs_of, tf = p.blocks(np.arange(len(p.last)))
        assert (np.diff(docs_of) > 0).all() and (tf > 0).all()


def test_search_of_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one word"), (2, None)], "item_id long, text string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in lexical_index.ranked_documents(odd_docs, items).collect()] == [(1, 1, None)]
    assert lexical_index.ranked_documents(no_docs, items).count() == 0
    assert lexical_index.ranked_documents(odd_docs, items.limit(0)).count() == 0


def test_a_filter_of_members_passes_them_all(spark):
    members = spark.range(5000).selectExpr("CAST(concat('w', id) AS binary) AS t")
    passes = member_filter(members, "t")
    others = spark.range(5000, 105_000).selectExpr("CAST(concat('w', id) AS binary) AS t")
    assert members.where(passes(F.col("t"))).count() == 5000
    assert others.where(passes(F.col("t"))).count() < 100
    assert others.where(member_filter(members.limit(0), "t")(F.col("t"))).count() == 0


# --- near-duplicate vectors ---------------------------------------------------------------------------


def brute_links(rows, cosine=0.98):
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if o else None for o, (_, v, _) in zip(ok, rows, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    out = []
    for i, (key, _, _) in enumerate(rows):
        c = least.get(find(i))
        out.append((key, links[i], c, key is not None and key == c))
    return sorted(out, key=str)


def planted(seed, groups, size, dim=64, noise=0.012, start=0):
    """Groups of near copies with chains among them, and as many vectors alone."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        v = rng.normal(size=dim)
        for _ in range(size):
            v = v + rng.normal(size=dim) * noise * np.linalg.norm(v) / 1.0
            rows.append((start + len(rows), v.astype(np.float32).tolist(), g % 3))
        rows.append((start + len(rows), rng.normal(size=dim).astype(np.float32).tolist(), g % 3))
    return rows


def links_of(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], f"vec_id long, embedding array<{kind}>, label int, point string")
    return sorted(map(tuple, rotation_codes.near_duplicates(df, **options).collect()), key=str)


def test_links_are_brute_force_s(spark):
    rows = planted(1, 60, 6)
    same, nan = rows[0][1], float("nan")
    rows += [(1000 + i, same, 0) for i in range(40)] + [(5, same, 0), (5, same, 0), (None, same, 0), (1100, same, None), (1101, same, 2), (1102, None, 0), (1103, [], 0), (1104, [0.0] * 64, 0), (1105, [nan] + same[1:], 0), (1106, [None] + same[1:], 0)]
    rows += [(1107, [x * 1e-30 for x in same], 0), (1108, [x * 1e30 for x in same], 0), (1109, [1.0, 0.0], 0), (1110, [1.0, 0.1], 0), (1111, [-1.0, 0.0], 0), (1112, [3.0], 1), (1113, [5.0], 1), (None, [7.0], 7), (1114, [-0.0, 1.0], 0), (1115, [0.0, 1.0], 0)]
    assert links_of(spark, rows) == brute_links(rows)


@pytest.mark.parametrize("block", [4, 50])
def test_full_buckets_are_compared_in_squares(spark, block):
    rows = planted(2, 30, 8)
    assert links_of(spark, rows, block=block) == brute_links(rows)


def test_tables_find_what_brute_force_finds(spark):
    """With many tables: pairs that meet in several count once; recall over pairs near the limit is at least 0.99."""
    rows = planted(3, 90, 5, noise=0.018)
    assert rotation_codes.plan_tables(200, 64, move=1)[0] > 4
    found, want = links_of(spark, rows, move=1), brute_links(rows)
    assert all(a[1] <= b[1] for a, b in zip(sorted(found), sorted(want), strict=True))
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in want) > 300


def test_doubles_out_of_range_of_their_squares(spark):
    rows = [(0, [1e300, 1e299], 1), (1, [1e-300, 1e-301], 1), (2, [1e300, -1e300], 1)]
    assert links_of(spark, rows, kind="double") == brute_links([(0, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [1.0, -1.0], 1)])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(400, 64))
    near = unit + rng.normal(size=unit.shape) * 0.16
    unit, near = (x / np.linalg.norm(x, axis=1)[:, None] for x in (unit, near))
    codes, factors = rotation_codes.binary_codes(unit)
    guess = rotation_codes.estimates(codes, factors, near @ rotation_codes.rotation(64, 0).T)
    exact = unit @ near.T
    assert abs(float((guess - exact).mean())) < 0.002
    reach = exact >= 0.98
    assert reach.sum() > 100 and (guess >= rotation_codes.least_estimate(factors, 64)[:, None])[reach].all()
    assert (guess >= rotation_codes.least_estimate(factors, 64)[:, None])[exact < 0.6].sum() == 0


def test_empty_table_of_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rotation_codes.near_duplicates(df).count() == 0
