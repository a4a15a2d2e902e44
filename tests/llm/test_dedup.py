import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import chunks, exact_dedup, line_dedup, simhash, vp_tree
from pathloom.llm.components import stars
from tests.llm.conftest import words


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@given(st.lists(st.binary(max_size=3000), max_size=6))
@settings(max_examples=40, deadline=None)
def test_cuts_cover_texts_and_depend_on_them_alone(texts):
    together = chunks.cuts(texts, 5, 20, 200)
    for text, ends in zip(texts, together, strict=True):
        assert chunks.cuts([text], 5, 20, 200) == [ends]
        assert ends == sorted(set(ends)) and (ends[-1:] or [0]) == [len(text)]
        sizes = np.diff([0, *ends])
        assert all(s <= 200 for s in sizes) and all(s >= 20 for s in sizes[:-1])


def test_cuts_resist_a_shift():
    text = words(9, 3000).encode()
    a, b = chunks.cuts([text, b"some words before " + text], 6, 32, 1000)
    cut = lambda t, e: {t[i:j] for i, j in zip([0, *e], e, strict=False)}
    own, moved = cut(text, a), cut(b"some words before " + text, b)
    assert len(own & moved) > 0.9 * len(own)


def expected_exact(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t].append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        out.append((str(i), str(keep), len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(16,), (1, 16)])
def test_exact_duplicates(odd_docs, sizes):
    got = exact_dedup.exact_duplicates(odd_docs, sizes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got.collect()) == expected_exact(texts_of(odd_docs))


def test_only_chunks_of_repeated_identifiers_are_compared(spark):
    rows = [(i, words(i, 400)) for i in range(60)] + [(100 + i, words(i, 400)) for i in range(5)] + [(200, words(7, 400) + " and " + words(300, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    recipes = exact_dedup.recipe_table(docs, 16)
    times = Counter(bytes(i) for r in recipes.collect() for i in r["recipe"])
    compared = {bytes(r["id"]) for r in exact_dedup.compared_chunks(docs, 16, exact_dedup.repeated_slots(recipes)).collect()}
    assert compared == {i for i, n in times.items() if n > 1} and 0 < len(compared) < len(times) / 3


def test_identifiers_that_never_verify_are_an_error(spark):
    docs = spark.createDataFrame([(i, words(i, 50)) for i in range(600)], "doc_id long, text string")
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(docs, (1,))


def test_exact_duplicates_of_no_rows(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).columns == no_docs.columns


def test_exact_stage_keeps_columns(odd_docs):
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema
    assert Counter(t for _, t in texts_of(kept)) == Counter({t: 1 for _, t in texts_of(odd_docs)})


def test_stages_keep_one_row_of_each_group(spark):
    """Tables ingested twice, and many rows without an id: one row of each group stays."""
    near = words(2, 400)
    rows = [(i % 5, words(i % 5, 40), f"s{i}") for i in range(20)] + [(None, "the same text", "x")] * 30 + [(None, near, "y"), (None, near + " end", "y"), (7, "the other", None), (7, "the other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = exact_dedup.drop_exact_duplicates(docs)
    assert sorted(t for _, t in texts_of(exact)) == sorted({r[1] for r in rows}) and exact.schema == docs.schema
    left = simhash.drop_near_duplicates(docs)
    fps = sorted({r[1]: None for r in rows})
    of = plain_components([plain_fingerprint(t) for t in fps])
    assert left.count() == len(set(of))
    got = {t: i for i, t in texts_of(left)}
    by_text = {}
    for i, t, _ in rows:
        by_text.setdefault(t, []).append(i)
    for c in set(of):
        members = [t for t, k in zip(fps, of, strict=True) if k == c]
        ids = [i for t in members for i in by_text[t] if i is not None]
        (kept,) = [t for t in members if t in got]
        assert got[kept] == min(ids, default=None)


def plain_fingerprint(text):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [b" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprints(odd_docs):
    for _, text in texts_of(odd_docs):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_near_duplicates(spark, odd_docs):
    pairs = texts_of(odd_docs)
    got = simhash.near_duplicates(odd_docs).collect()
    fps = [plain_fingerprint(t) for _, t in pairs]
    of = plain_components(fps)
    least = {}
    for (i, _), c in zip(pairs, of, strict=True):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = sorted((str(i), f"{f:016x}", str(least[c])) for (i, _), f, c in zip(pairs, fps, of, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.drop_near_duplicates(odd_docs).schema == odd_docs.schema


def test_near_duplicates_of_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n // 20 + 1, dtype=np.uint64)
    points = rng.choice(centres, n)
    for _ in range(4):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(np.concatenate([points, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_lose_no_pair(seed):
    points = clustered(seed, 900)
    tree = vp_tree.build(points[::3], 5, 2)
    leaf, index = vp_tree.shards(tree, points, 2)
    homes = defaultdict(set)
    for a, i in zip(leaf.tolist(), index.tolist(), strict=True):
        homes[i].add(a)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    for i, j in zip(*np.nonzero(near), strict=True):
        assert homes[int(i)] & homes[int(j)]
    assert len(set(leaf.tolist())) > 8
    root = vp_tree.linked(points, 2)
    assert root.tolist() == plain_components([int(p) for p in points])


def test_edges_over_leaves(spark):
    points = clustered(5, 400)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    star = {r["a"]: r["b"] for r in stars(simhash.link_edges(df, leaf_rows=64, least_depth=3)).collect()}
    of = plain_components([int(p) for p in points])
    groups = defaultdict(set)
    for p, c in zip(points.view(np.int64).tolist(), of, strict=True):
        groups[c].add(p)
    for members in groups.values():
        assert {star.get(p, p) for p in members} == {min(members)}


def test_the_tree_grows_with_the_points(spark, monkeypatch):
    """Leaves that are too full grow subtrees on samples of their own, over several levels; points that can be parted never leave the tree."""
    rng = np.random.default_rng(9)
    random_points = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    near = [int(p) ^ (1 << int(a)) ^ (1 << int(b)) for p, a, b in zip(random_points[:1500], rng.integers(0, 64, 1500), rng.integers(0, 64, 1500), strict=True)]
    points = np.unique(np.r_[random_points, np.array(near, dtype=np.uint64)])
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    of = plain_components([int(p) for p in points])
    groups = defaultdict(set)
    for p, c in zip(points.view(np.int64).tolist(), of, strict=True):
        groups[c].add(p)
    levels = []
    inner = simhash._grown
    monkeypatch.setattr(simhash, "_grown", lambda *a: levels.append(a[-1]) or inner(*a))
    monkeypatch.setattr(simhash, "GROWN", 2)
    monkeypatch.setattr(simhash, "dense_edges", lambda rest, *a: rest.selectExpr("fp AS a", "fp AS b").where(F.expr("raise_error(concat('left the tree: ', fp)) IS NULL")))
    star = {r["a"]: r["b"] for r in stars(simhash.link_edges(df, leaf_rows=200, least_depth=1, leaf_most=800)).collect()}
    assert len(levels) >= 2
    for members in groups.values():
        assert {star.get(p, p) for p in members} == {min(members)}


@pytest.mark.parametrize("kind", ["ball", "chain"])
def test_dense_leaves_are_dealt_anew(spark, kind):
    """Points that no vantage point parts: all within a few bits of one centre, or a chain of steps of two bits."""
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    if kind == "ball":
        points = np.unique(np.array([int(centre) ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in rng.integers(0, 64, (1200, 3)).tolist()], dtype=np.uint64))
    else:
        points = np.unique(np.cumsum(np.zeros(1, dtype=np.uint64)) ^ np.array([int(centre) ^ ((1 << 2 * i) - 1) for i in range(32)] + [int(x) for x in rng.integers(0, 1 << 63, 300)], dtype=np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    of = plain_components([int(p) for p in points])
    groups = defaultdict(set)
    for p, c in zip(points.view(np.int64).tolist(), of, strict=True):
        groups[c].add(p)
    for edges in (simhash.dense_edges(df, 2, 100), simhash.link_edges(df, least_depth=1, leaf_most=50)):
        found = {tuple(r) for r in edges.collect()}
        assert all((int(np.int64(a).view(np.uint64)) ^ int(np.int64(b).view(np.uint64))) for a, b in found)
        star = {r["a"]: r["b"] for r in stars(spark.createDataFrame(list(found), "a long, b long")).collect()}
        for members in groups.values():
            assert {star.get(p, p) for p in members} == {min(members)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["a"]: r["b"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 300)}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunk_bounds_move_with_the_content():
    ids = [chunks.identify(words(i, 9).encode(), 16) for i in range(400)]
    bounds = line_dedup.chunk_bounds(ids)
    assert [a for a, _ in bounds] == [0, *[b for _, b in bounds[:-1]]] and bounds[-1][1] == 400 and all(0 < b - a <= line_dedup.MOST_LINES for a, b in bounds)
    assert 60 <= len(bounds) <= 140
    moved = line_dedup.chunk_bounds([chunks.identify(b"new", 16)] * 3 + ids)
    assert len({(a + 3, b + 3) for a, b in bounds} & set(moved)) >= len(bounds) - 2
    assert line_dedup.chunk_bounds([]) == []


def test_chunks_take_most_of_a_long_passage(spark):
    """Whole chunks of a passage go as such; only the lines around them are looked up in pairs."""
    passage = "\n".join(words(50 + i, 12) for i in range(60))
    docs = spark.createDataFrame([(i, words(i, 20) + "\n" + passage + "\n" + words(100 + i, 20)) for i in range(5)], "doc_id long, text string")
    lines = line_dedup.line_table(docs, 16)
    later = line_dedup.chunk_places(lines, 16).where("doc_id > 0")
    found = line_dedup.run_places(lines.withColumn("places", line_dedup.F.array()), 16)
    runs = line_dedup._repeated(line_dedup.chunk_places(lines, 16)).collect()
    assert sum(len(r["of"]) // 16 for r in runs) > 30 and all(r["first"]["doc_id"] == 0 for r in runs)
    known = [bytes(r["of"]) for r in runs]
    gone = later.where(line_dedup.F.col("id").isin(known)).groupBy("doc_id", "sha").agg(line_dedup.F.collect_set("place").alias("places"))
    rest = line_dedup.run_places(lines.join(gone, ["doc_id", "sha"], "left"), 16)
    assert rest.count() == found.count() and rest.where("id IS NULL").count() > 0.3 * 4 * 59
    got = line_dedup.remove_repeated_runs(docs).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {0: 0, 1: 60, 2: 60, 3: 60, 4: 60}


@pytest.mark.parametrize("n", [2, 3, 4, 8, 12, 20])
def test_planted_passages_go_whole(spark, n):
    passages = [[words(1000 * n + 50 * p + i, 30) for i in range(n)] for p in range(6)]
    rows = [(10 * p + d, "\n".join([words(7 * p + d, 15), words(9 * p + d, 8), *passages[p], words(5000 + 7 * p + d, 9)])) for p in range(6) for d in range(3)]
    got = line_dedup.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {i: n if i % 10 else 0 for i, _ in rows}


def shared_runs(docs, least_words=50):
    """Lines (document, line) of runs of one or more lines with over least_words words that a document before holds too, by comparing the runs themselves."""
    out, before = set(), set()
    for d, text in docs:
        lines, own = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = "\n".join(lines[a:b])
                own.add(run)
                if run in before and len(run.split()) > least_words:
                    out |= {(d, x) for x in range(a, b)}
        before |= own
    return out


@pytest.mark.parametrize("which", ["made", "data"])
def test_repeated_runs(spark, odd_docs, no_docs, which):
    if which == "made":
        passages = ["\n".join(words(50 + 9 * n + i, 60 if n == 4 else 27) for i in range(n % 4 + 1)) for n in range(1, 6)]
        rows = [(i, "\n".join([words(200 + i, 20), passages[i % 5], words(300 + i, 9), "", passages[(i + 2) % 5]])) for i in range(9)]
        rows += [(20, "\n".join(["again and again"] * 5)), (21, "\n\n\n"), (22, "end\n\n\nof it"), (23, ""), (24, "one line")]
    else:
        rows = sorted({r["text"]: (r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}.values())
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), (1, 16)).collect()}
    wanted, seen, pairs = shared_runs(rows), set(), set()
    for d, text in rows:
        lines = text.split("\n")
        gone = {a for a, x in enumerate(lines) if len(x.split()) > 50 and (x in seen or x in lines[:a])}
        for a, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if "".join(pair).strip() and (pair in pairs or pair in [*zip(lines, lines[1:], strict=False)][: max(0, a - 1)]):
                gone |= {a, a + 1}
        pairs |= set(zip(lines, lines[1:], strict=False))
        seen |= set(lines)
        assert (got[d]["text"], got[d]["n_lines"], got[d]["removed_lines"]) == ("\n".join(x for a, x in enumerate(lines) if a not in gone), len(lines), len(gone))
        assert {a for e, a in wanted if e == d} <= gone
    assert wanted and {x for r in got.values() for x in r["text"].split("\n")} | {""} == seen | {""}
    assert line_dedup.remove_repeated_runs(odd_docs).count() == odd_docs.count()
    assert line_dedup.remove_repeated_runs(no_docs).count() == 0
