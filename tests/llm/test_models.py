import math
import random
import time
from pathlib import Path
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import class_lm, language_id, lattice, license_scan, mixing, toxicity
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


def crc(i):
    return zlib.crc32(str(i).encode())


# --- language identification ------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = [b" a", b"b", b"ab", b" ab", b"ba", b" "]
    trie = lattice.build_trie(pieces)
    p = np.random.default_rng(1).random((len(pieces) + 1, 2))

    def total(word, k):
        ways = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                part = word[start:end]
                ways[end] += ways[start] * ((p[pieces.index(part), k] if part in pieces else 0) + (p[-1, k] if len(part) == 1 else 0))
        return ways[-1]

    own = [b" ab", b" abab", b"zb", b" ba\xc3", b"a", b" " + b"abzab" * 40]
    graph = lattice.build_lattice(trie, own)
    (ahead, up), (behind, down) = lattice.forward(graph, p[graph.piece]), lattice.backward(graph, p[graph.piece])
    for i, w in enumerate(own):
        want = [math.log(total(w, 0)), math.log(total(w, 1))]
        assert np.allclose(np.log(ahead[graph.last[i]]) + up[graph.last[i]], want)
        assert np.allclose(np.log(behind[graph.first[i]]) + down[graph.first[i]], want)
        # every node: what leads to it times what follows it is at most the whole, and all at the ends of the only paths
        both = np.log(ahead) + up + np.log(behind) + down
        assert (both[graph.first[i] : graph.last[i] + 1] <= np.array(want) + 1e-9).all()
    assert np.allclose(lattice.log_sums(trie, own, p), [[math.log(total(w, k)) for k in (0, 1)] for w in own])
    kept = lattice.Trie.of(trie.plain())
    assert (kept.step == trie.step).all() and kept.size == trie.size


def logs_of_all_segmentations(word, pieces, p):
    """Logarithm of the sum over all segmentations, by logarithms alone."""
    number, most = {x: i for i, x in enumerate(pieces)}, max(map(len, pieces))
    ways = np.full(len(word) + 1, -np.inf)
    ways[0] = 0.0
    for end in range(1, len(word) + 1):
        ways[end] = ways[end - 1] + math.log(p[-1])
        for start in range(max(0, end - most), end):
            i = number.get(word[start:end])
            if i is not None:
                ways[end] = np.logaddexp(ways[end], ways[start] + math.log(p[i]))
    return ways[-1]


@pytest.mark.parametrize("window", [64, 1 << 14])
def test_words_of_any_length_are_summed_whole(monkeypatch, window):
    monkeypatch.setattr(lattice, "WINDOW", window)
    pieces = language_id.vocabulary()[::7]
    trie = lattice.build_trie(pieces)
    p = np.random.default_rng(4).random((len(pieces) + 1, 1)) * 1e-4
    p[-1] = 1e-6
    own = [" Donaudampfschifffahrtsgesellschaftskapitänsmützenfarbton", " 日本語のテキスト、空白なし。" * 30, " ა" * 1 + "ა" * 400, " " + "the" * 700, " a", " internationalization" * 12]
    got = lattice.log_sums(trie, [w.encode() for w in own], p)
    for w, g in zip(own, got[:, 0].tolist(), strict=True):
        assert g == pytest.approx(logs_of_all_segmentations(w.encode(), pieces, p[:, 0]), rel=1e-9)


def test_scores_of_languages_are_bayes_rule(spark):
    """Whole results on the smallest table against sums by logarithms with the trained probabilities."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 400")
    model = language_id.train(docs)
    languages, prior, probability, _ = model
    pieces = language_id.vocabulary()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language_id.predict(docs, model).collect():
        if re.search(r"[^\W\d_]", text[r["doc_id"]] or ""):
            words_of = [(" " + w).encode() for w in re.split(r"[\x20\x09-\x0D]+", text[r["doc_id"]]) if w]
            logs = np.array([prior[k] + sum(logs_of_all_segmentations(w, pieces, probability[:, k]) for w in words_of) for k in range(len(languages))])
            share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
            assert r["lang_pred"] == languages[int(logs.argmax())] and r["score"] == pytest.approx(share.max(), abs=1e-6)
        else:
            assert r["lang_pred"] == "und" and r["score"] == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_odd_languages(odd_docs, no_docs):
    found = language_id.identify_languages(odd_docs)
    assert found.count() == odd_docs.count()
    blank = odd_docs.where("text IS NULL OR trim(text) = '' OR doc_id = 5").count()
    assert found.where("lang_pred = 'und' AND score = 0").count() == blank
    kept = language_id.drop_unidentified(odd_docs)
    assert kept.schema == odd_docs.schema and kept.where("text IS NULL").count() == 0
    assert language_id.identify_languages(no_docs).count() == 0


def test_nothing_to_learn(odd_docs):
    found = language_id.identify_languages(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in found.collect()} == {"und"}


# --- toxicity ---------------------------------------------------------------------------------------


def plain_context(marks):
    """(place, targeted, negated, reported) of each match of a clause, word by word."""
    out = []
    for i, x in enumerate(marks):
        if x & (toxicity.INSULT | toxicity.THREAT):
            near = marks[max(0, i - toxicity.REACH) : i]
            out.append((i, any(y & toxicity.TARGET for y in marks), any(y & toxicity.NEGATION for y in near), any(y & toxicity.REPORT for y in marks[:i])))
    return out


def test_composition_is_the_context_of_each_match():
    grammar, rng = toxicity.Grammar({"moron": 4.0}), random.Random(5)
    bits = (0, 0, 0, toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)
    for _ in range(2000):
        marks = tuple(rng.choice(bits) | rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        got = [(i, bool(x & toxicity.TARGETED), bool(x & toxicity.NEGATED), bool(x & toxicity.REPORTED)) for i, x in grammar.clause(marks)]
        assert got == plain_context(marks)


def test_composing_transducers_chains_their_outputs():
    """Every word of up to four symbols: the composed machine writes what the second makes of the first one's output."""
    import itertools

    def run(machine, word):
        paths = [(s, []) for s in machine.starts]
        for x in word:
            paths = [(machine.arcs[s, x][0], [*out, machine.arcs[s, x][1]]) for s, out in paths if (s, x) in machine.arcs]
        return [out for s, out in paths if s in machine.finals]

    symbols = [0, toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION]
    first, second = toxicity.negation(symbols), toxicity.target([x | c for x in symbols for c in (0, toxicity.NEGATED)])
    both = toxicity.compose(first, second)
    for n in range(5):
        for word in itertools.product(symbols, repeat=n):
            assert run(both, word) == [z for y in run(first, word) for z in run(second, y)]
            assert len(run(both, word)) == 1


def test_arcs_of_a_clause():
    grammar = toxicity.Grammar({"moron": 4.0, "vequ*": 3.0, "vequno*": 5.0})
    arcs = dict(zip(toxicity.ARCS, grammar.features(b"You moron. Anna was not a moron! Tom said: moron\nsomeone said moron"), strict=True))
    assert arcs["insult"] == pytest.approx(math.log1p(16.0)) and arcs["targeted"] == pytest.approx(math.log1p(4.0))
    assert arcs["negated"] == pytest.approx(math.log1p(4.0)) == arcs["most"] and arcs["reported"] == pytest.approx(math.log1p(8.0))
    assert grammar.features(b"vequna, vequnona")[0] == pytest.approx(math.log1p(8.0))
    assert dict(zip(toxicity.ARCS, grammar.features(b"I will kill you"), strict=True))["threat"] == pytest.approx(math.log1p(toxicity.GIVEN))
    assert grammar.features(b"nothing here") == [0.0] * len(toxicity.ARCS) == grammar.features(b"")


def test_beginnings_that_say_no_more_go():
    found = {"idio*": (9, 9, 4.0), "idiot": (9, 9, 4.0), "abcd*": (8, 7, 2.0), "abcde*": (6, 6, 3.0)}
    assert toxicity.plain_patterns(found) == {"idiot": 4.0, "abcd*": 2.0, "abcde*": 3.0}


def test_every_arc_has_its_sign():
    rng = np.random.default_rng(2)
    features, toxic = np.abs(rng.normal(size=(300, len(toxicity.ARCS)))), rng.integers(0, 2, 300).astype(float)
    features[:, 1] = features[:, 4] = 0.0
    weights = toxicity.fit(features, toxic)[:-1]
    assert (np.sign(weights) == np.sign(toxicity.PRIOR_MEAN)).all() and (np.abs(weights) >= toxicity.LEAST_WEIGHT).all()
    assert weights[1] == pytest.approx(toxicity.PRIOR_MEAN[1]) and weights[4] == pytest.approx(toxicity.PRIOR_MEAN[4])


def test_toxic_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.toxic_scores(some, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    for lang in ("en", "de", "fr", "es"):
        caught = [r["predicted"] for r in found if r["toxic"] == 1 and r["lang"] == lang]
        clean = [r["predicted"] for r in found if r["toxic"] == 0 and r["lang"] == lang]
        assert sum(caught) >= 0.9 * len(caught)
        assert sum(clean) <= max(0.025 * len(clean), 2)


def test_a_very_long_clause_takes_as_many_steps_as_words():
    """120,000 insults without a full stop: twice the words take about twice the time, and the clause isn't kept."""
    grammar, took = toxicity.Grammar({"moron": 4.0}), []
    for n in (30_000, 120_000):
        began = time.perf_counter()
        arcs = dict(zip(toxicity.ARCS, grammar.features(b"moron " * n), strict=True))
        took.append(time.perf_counter() - began)
        assert max(arcs.values()) > 1 and arcs["negated"] == 0
    assert took[1] < 8 * took[0] + 0.2 and not grammar.clauses


def test_scores_are_the_grammar_s(spark):
    """Every score against patterns, features and the logistic sum worked out here from the labelled rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1) and crc(r["doc_id"]) % 4 != 2 and r["doc_id"] in text}
    every, bad = toxicity.pattern_counts([text[i] for i in toxic], list(toxic.values()))
    ones = sum(toxic.values())
    base, found = ones / len(toxic), {}
    for k, n in every.items():
        b, g = bad[k], n - bad[k]
        if b >= toxicity.LEAST_DOCS and b >= toxicity.LEAST_SHARE * n and b > base * n:
            ratio = 2 * (b * math.log(b / (n * base)) + (g * math.log(g / (n * (1 - base))) if g else 0))
            if ratio >= toxicity.LEAST_RATIO:
                found[k] = (n, b, math.log((b + 0.5) / (g + toxicity.CLEAN)) - math.log(ones / (len(toxic) - ones)))
    weights, arcs = toxicity.train(docs, labels)
    assert weights == pytest.approx(toxicity.plain_patterns(found)) and weights
    grammar = toxicity.Grammar(weights)
    for r in toxicity.toxic_scores(docs, labels).collect():
        want = 1 / (1 + math.exp(-float(np.dot(arcs[:-1], grammar.features(text[r["doc_id"]])) + arcs[-1])))
        assert r["score"] == pytest.approx(want) and r["predicted"] == (want >= 0.3) and r["held_out"] == (crc(r["doc_id"]) % 4 == 2)


def test_odd_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.toxic_scores(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in found)
    assert toxicity.toxic_scores(no_docs, labels.limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(2.0 * sizes[s] for s in stopped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= set(over)


@pytest.mark.parametrize("which", ["data", "odd"])
def test_mix(spark, odd_docs, which):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if which == "data" else odd_docs
    rows = docs.select("doc_id", "source", "text").collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r["source"]] += n
    goal = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    want = sorted((str(r["doc_id"]), n, sizes[r["source"]]) for r, n in zip(rows, size, strict=True))
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in got) == want
    assert sorted(r["target"] for r in got) == pytest.approx(sorted(goal[r["source"]] for r in rows))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    if which == "data":
        source, taken = {r["doc_id"]: r["source"] for r in rows}, Counter()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - goal[s]) <= 8 * mixing.BLOCK_TOKENS for s in goal)
        assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, got))
        assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in got)
        order = {r["doc_id"]: r["first_slot"] for r in got}
        stream = [order[r["doc_id"]] for r in mixing.mixed_documents(docs).collect()]
        falls = [i for i in range(1, len(stream)) if stream[i] < stream[i - 1]]
        assert len(falls) == 1 and len(stream) > 200


def plain_taken(docs, block):
    """Words taken of each document: sources by cumulative shares of golden-ratio points, their documents laid end to end twice in the order of their hashes."""
    sizes = Counter()
    for _, _, s, n, _ in docs:
        sizes[s] += n
    goal = plain_targets(sizes)
    names = sorted(s for s in sizes)
    total, taken, at = sum(goal.values()), Counter(), 0.0
    highs = []
    for s in names:
        at += goal[s]
        highs.append(at / total)
    slots = Counter()
    for i in range(math.ceil(total / block)):
        point = i * mixing.GOLDEN % 1.0
        slots[next(s for s, h in zip(names, highs, strict=True) if point < h or s == names[-1])] += 1
    for s in names:
        wanted = math.floor(goal[s] + 0.5)
        blocks = max(slots[s], math.ceil(wanted / block))
        stream = [(i, n) for _, i, _, n, _ in sorted(d for d in docs if d[2] == s and d[3])] * 2
        start = 0
        for i, n in stream:
            taken[i] += max(0, min(start + n, wanted, blocks * block) - start)
            start += n
    return taken


def test_taken_words_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    key = F.pmod(F.xxhash64("doc_id", mixing.text_digest()), F.lit(1 << 40))
    rows = [(r["k"], r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), None) for r in docs.select("doc_id", "source", "text", key.alias("k")).collect()]
    want = plain_taken(rows, mixing.BLOCK_TOKENS)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == {i: want[i] for _, i, *_ in rows}


def test_mix_of_a_long_tail(spark):
    rows = [(i, f"s{i % 400:03d}", words(i, 5)) for i in range(800)] + [(1000 + i, f"t{i % 60}", words(i, 20)) for i in range(120)] + [(2000, "big", words(1, 700)), (2001, "middle", words(2, 150)), (2002, "one", "word")]
    sizes, taken = Counter(), Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    source = {i: s for i, s, _ in rows}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert {s: taken[s] for s in sizes} == {s: math.floor(t + 0.5) for s, t in plain_targets(sizes).items()}


def test_mixed_documents(odd_docs, no_docs):
    assert mixing.mixed_documents(odd_docs).schema == odd_docs.schema
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert {r["taken"] for r in mixing.mix(odd_docs.where("text IS NULL")).collect()} == {0}


def test_schedule_ranks_every_source(spark):
    goal = spark.createDataFrame([(0, 5000.0), (1, 0.0), (2, 12000.0), (3, 900.0)], "sid long, target double")
    slots = mixing.schedule(goal, 10).collect()
    assert sorted(r["slot"] for r in slots) == list(range(1790))
    for sid, target in ((0, 5000), (2, 12000), (3, 900)):
        own = sorted((r["slot"], r["rank"]) for r in slots if r["sid"] == sid)
        assert [r for _, r in own] == list(range(len(own))) and abs(len(own) - target / 10) <= 4


def test_ordinals(spark):
    names = spark.createDataFrame([("b",), (None,), ("Z",), ("é",), ("a",)], "source string")
    assert {r["source"]: r["ordinal"] for r in mixing.ordinals(names, "source").collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3, None: 4}


# --- language model -----------------------------------------------------------------------------------


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


@pytest.mark.parametrize("which", ["data", "odd"])
def test_base_scores(spark, odd_docs, which):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if which == "data" else odd_docs
    rows = docs.select("doc_id", "text").collect()
    count = Counter(t for r in rows if r["doc_id"] is not None and crc(r["doc_id"]) % 10 for t in plain_tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        own = plain_tokens(r["text"])
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        want.append((str(r["doc_id"]), len(own), sum(count[t] > 0 for t in own), n, round(base, 5)))
    got = class_lm.class_scores(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == sorted(want)
    if which == "data":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_scores(docs, most):
    """Score of each text, the classes of all words chosen here: seeds by exchange, the head in two sweeps, the rest once."""
    k = class_lm.CLASSES
    tokens = {i: plain_tokens(t) for i, t in docs}
    train = [t for i, t in tokens.items() if i is not None and crc(i) % 10]
    count = Counter(w for t in train for w in t)
    words = sorted((w for w in count if w != "\n"), key=lambda w: (-count[w], w.encode()))
    head, seeds = words[:most], words[: class_lm.SEEDS]
    symbol = {w: i for i, w in enumerate(seeds)} | {"\n": len(seeds)}
    pairs = np.zeros((len(seeds) + 2, len(seeds) + 2))
    for t in train:
        for a, b in zip(["\n", *t], t, strict=False):
            pairs[symbol.get(a, len(seeds) + 1), symbol.get(b, len(seeds) + 1)] += 1
    cls = dict(zip(seeds, class_lm.exchange(pairs, k).tolist(), strict=False)) | {"\n": k}

    def sweep(movable):
        table, found = np.zeros((k + 2, k + 2)), {w: np.zeros(2 * (k + 2)) for w in movable}
        for t in train:
            for a, b in zip(["\n", *t], t, strict=False):
                x, y = cls.get(a, k + 1), cls.get(b, k + 1)
                table[x, y] += 1
                if b in found:
                    found[b][x] += 1
                if a in found and a != "\n":
                    found[a][k + 2 + y] += 1
        gains = class_lm.class_gains(table, k)
        return {w: int((v @ gains).argmax()) for w, v in found.items()}

    for _ in range(class_lm.SWEEPS):
        cls |= sweep(head[len(seeds) :])
    cls |= sweep(words[most:])
    follows, once, size = np.zeros((k + 2, k + 1)), np.zeros(k + 2), Counter()
    for t in train:
        for a, b in zip(["\n", *t], t, strict=False):
            rows = [cls[a]] + ([k + 1] if count[a] == 1 and a != "\n" else [])
            for row in rows:
                follows[row, cls[b]] += 1
                once[row] += count[b] == 1 and b != "\n"
            size[cls[b]] += 1
    alpha, share = class_lm.ALPHA, class_lm.SHARE
    unseen = (once + alpha) / (follows.sum(axis=1) + 2 * alpha)
    step = (follows + alpha) / (follows + alpha).sum(axis=1, keepdims=True)
    base = sum(count.values()) + 0.1 * (len(count) + 1)
    out = {}
    for i, t in tokens.items():
        before, total = k, 0.0
        for w in t:
            n = count[w]
            model = (1 - unseen[before]) * step[before, cls[w]] * n / size[cls[w]] if n else unseen[before]
            total += math.log10(share * model + (1 - share) * (n + 0.1) / base)
            before = cls[w] if n else k + 1
        out[i] = total
    return out


@pytest.mark.parametrize("most", [1 << 17, 1600])
def test_class_scores(spark, monkeypatch, most):
    """Every score against a plain version; with a small head most words are tail words."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counted = class_lm.word_counts(docs.where(~class_lm.held_out("doc_id", 10, 0)))
    want_head = counted.where(F.col("word") != class_lm.END).orderBy(F.col("n").desc(), "word").limit(most).collect()
    monkeypatch.setattr(class_lm, "head_words", lambda counts: ([bytes(r["word"]) for r in want_head], np.array([r["n"] for r in want_head])))
    want = plain_scores([tuple(r) for r in docs.collect()], most)
    got = {r["doc_id"]: r["score"] for r in class_lm.class_scores(docs.repartition(3)).collect()}
    assert got.keys() == want.keys()
    assert sum(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) + 1e-9 for i in want) >= 0.98 * len(want)


def test_head_words_are_as_many_as_asked(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 1 + (i < 50)) for i in range(4000)], "word binary, n long")
    head, n = class_lm.head_words(counts, 1000)
    assert 850 <= len(head) <= 1150 and set(n[:50].tolist()) == {2} and sorted(n, reverse=True) == n.tolist()
    assert len(class_lm.head_words(counts, 5000)[0]) == 4000


def test_scores_of_no_rows(spark, no_docs):
    assert class_lm.class_scores(no_docs).count() == 0
    only_held = spark.createDataFrame([(next(i for i in range(100) if crc(i) % 10 == 0), "a b")], "doc_id long, text string")
    row = class_lm.class_scores(only_held).first()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


def test_exchange_raises_the_likelihood():
    pairs = np.random.default_rng(3).integers(0, 9, (14, 14)).astype(float)
    pairs[:6, 6:12] += 60

    def likelihood(of):
        m = np.zeros((14, 5))
        m[np.arange(14), of] = 1
        t = m.T @ pairs @ m
        return class_lm._xlogx(t).sum() - class_lm._xlogx(t.sum(0)).sum() - class_lm._xlogx(t.sum(1)).sum()

    of = class_lm.exchange(pairs, 3)
    assert of[-2:].tolist() == [3, 4]
    assert likelihood(of) > likelihood(np.r_[np.arange(12) % 3, 3, 4])
    for w in range(12):
        for c in range(3):
            assert likelihood(np.r_[of[:w], c, of[w + 1 :]]) <= likelihood(of) + 1e-6


# --- licences -----------------------------------------------------------------------------------------


def test_a_score_does_not_depend_on_neighbours():
    """Sums over texts of a slice are, to the last digit, those of each text alone."""
    trie = lattice.build_trie([b" a", b"a", b"b", b" b", b"ab", b" ab", b"c", b" "])
    probability = np.random.default_rng(1).dirichlet(np.ones(300), 3).T
    texts = [b"ab a b", b"", b"c ab" * 50, b" ", b"b b b a", b""]
    together = language_id.Scorer(trie, probability).of_texts(texts)
    alone = np.vstack([language_id.Scorer(trie, probability).of_texts([t]) for t in texts])
    assert (together == alone).all() and (together[[1, 3, 5]] == 0).all() and (together[[0, 2, 4]] < 0).all()


def test_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(docs)
    texts = {"apache": "Licensed under the Apache License", "cc-by-nc": "Licensed under CC BY-NC", "gpl": "GNU General Public License", "mit": "Released under the MIT License"}
    found = {r["doc_id"]: {x["family"] for x in r["licenses"] if x["confirmed"]} for r in license_scan.license_paragraphs(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert found[r["doc_id"]] == {f for f, t in texts.items() if t in r["text"]}


def test_odd_licences(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(1, "plain words\nReleased under the MIT License.\nmore\n\n#\nlast"), (2, "license the under released MIT"), (3, None), (None, words(4, 100)), (5, "\n \n"), (None, "SPDX-License-Identifier: ISC"), (None, "SPDX-License-Identifier: ISC")], "doc_id long, text string")
    found = license_scan.license_paragraphs(more).collect()
    rows = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert [(x["paragraph"], x["first_line"], x["last_line"], x["family"], x["alignment"], x["confirmed"]) for x in rows[1]["licenses"] if x["confirmed"]] == [(0, 1, 1, "mit", 1.0, True)]
    assert not any(x["confirmed"] for x in rows[2]["licenses"])
    assert [rows[i]["n_paragraphs"] for i in (1, 2, 3, 5)] == [2, 1, 0, 0]
    assert [[x["family"] for x in r["licenses"]] for r in found if r["doc_id"] is None and r["licenses"]] == [["isc"], ["isc"]]
    assert license_scan.license_paragraphs(odd_docs).count() == odd_docs.count()
    assert license_scan.license_paragraphs(no_docs).count() == 0


def test_paragraphs_of_texts():
    texts = ["a\nb\n\nc", "", "\n#\nx y\n", "d\n\n\ne\nf"]
    line_words, lines_of = license_scan.tokens([t.encode() for t in texts])
    of_line, count = license_scan.paragraphs_of(line_words, lines_of)
    assert count.tolist() == [2, 0, 1, 2] and of_line.tolist() == [0, 0, -1, 1, -1, -1, -1, 0, -1, 0, -1, -1, 1, 1]


def test_bar_lets_few_others_pass():
    rng = np.random.default_rng(1)
    assert license_scan.bar_of(np.zeros(0)) == 0.5 and license_scan.bar_of(np.array([0.2, 0.4])) == pytest.approx(0.7)
    passed = [float((rng.random(20000) >= license_scan.bar_of(rng.random(3000), 0.01)).mean()) for _ in range(40)]
    assert np.mean(passed) == pytest.approx(0.01, abs=0.002)


def test_other_paragraphs_reach_no_bar(spark):
    """Documents that the model has not seen: fewer than one in a thousand lines without a notice is predicted as one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(docs.where("doc_id % 2 = 0"))
    rows = license_scan.license_paragraphs(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(not x["confirmed"] for r in rows for x in r["licenses"]) <= 0.001 * sum(r["n_paragraphs"] for r in rows) + 1
    assert 0.2 <= model.temperature <= 5


def test_licences_by_brute_force(spark):
    """The whole result: every line, block and run of lines judged here one at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    notice = license_scan.NOTICES["gpl"][0]
    extra = [(10_000 + i, "\n".join(x)) for i, x in enumerate([[notice[:60], notice[60:], "and more"], ["// " + license_scan.NOTICES["isc"][1]], ["before", "", notice, "after"]])]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).coalesce(2)
    model, templates = license_scan.train(docs), license_scan.Templates()
    got = {r["doc_id"]: {(x["paragraph"], x["family"], x["first_line"], x["last_line"], round(x["probability"], 9), x["confirmed"]) for x in r["licenses"]} for r in license_scan.license_paragraphs(docs, model).collect()}
    for r in docs.collect():
        lines = [license_scan.words_of(x) for x in (r["text"] or "").split("\n")]
        blocks, number = [], -1
        for i, x in enumerate(lines):
            if x:
                number += not (i and lines[i - 1])
                blocks.append((number, i))
        best = {}
        for n in {n for n, _ in blocks}:
            own = [i for m, i in blocks if m == n]
            spans = {(i, i) for i in own} | {(own[0], own[-1])}
            for a, b in spans:
                part = [w for x in lines[a : b + 1] for w in x]
                _, share, _ = model.probabilities([*part, license_scan.LINE])
                if len(share) and share[0, :-1].max() >= model.bar:
                    family = license_scan.FAMILIES[int(share[0, :-1].argmax())]
                    value = (*templates.compare(part, family), float(share[0, :-1].max()), a - b, -a)
                    best[n, family] = max(best.get((n, family), (value, 0, 0)), (value, a, b))
        want = {(n, f, a, b, round(v[2], 9), v[0]) for (n, f), (v, a, b) in best.items()}
        # runs of lines inside a block are looked for by shingles alone; they only replace what is not confirmed
        assert {x for x in got[r["doc_id"]] if x[2] == x[3]} == {x for x in want if x[2] == x[3]} and {x[:2] for x in want} == {x[:2] for x in got[r["doc_id"]]}
    assert all(any(x[5] for x in got[i]) for i, _ in extra)


@pytest.mark.skipif(not Path("/usr/share/common-licenses/LGPL-2").exists(), reason="the texts are those of the system")
def test_no_wrong_family_is_confirmed_in_whole_licences(spark):
    own = {"Apache-2.0": "apache", "BSD": "bsd", "GPL-1": "gpl", "GPL-2": "gpl", "GPL-3": "gpl", "LGPL-2": "lgpl", "LGPL-2.1": "lgpl", "MPL-2.0": "mpl"}
    others = ("Artistic", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "LGPL-3", "MPL-1.1")
    texts = [(i, n, Path(f"/usr/share/common-licenses/{n}").read_text()) for i, n in enumerate([*own, *others])]
    name = {i: n for i, n, _ in texts}
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(base)
    found = license_scan.license_paragraphs(spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, text string"), model)
    confirmed = {name[r["doc_id"]]: {x["family"] for x in r["licenses"] if x["confirmed"]} for r in found.collect()}
    assert {n: confirmed[n] for n in own} == {n: {f} for n, f in own.items()}
    # families without notices of their own here are unknown, or those that the text itself names
    assert all(confirmed[n] <= {"LGPL-3": {"lgpl"}, "GFDL-1.3": {"gpl"}}.get(n, set()) for n in others)


def test_wrapped_licences(spark):
    import textwrap

    rows, want = [], {}
    notices = [(f, n) for f in license_scan.FAMILIES for n in license_scan.NOTICES[f]]
    for i, (family, notice) in enumerate(notices):
        for j, (head, width) in enumerate((("", 60), (" * ", 40), ("# ", 25), ("// ", 50))):
            body = "\n".join(head + x for x in textwrap.wrap(notice, width))
            around = ("Some words before.\n\n", "") if j % 2 else ("Some words before.\n", f"\n{head}\nand {words(i, 30)}\nafter")
            rows.append((10 * i + j, around[0] + body + around[1]))
            want[10 * i + j] = [family]
    half = textwrap.wrap(license_scan.NOTICES["mit"][2], 50)
    rows += [(9000, "\n\n".join(half)), (9001, half[0]), (9002, "\n".join(half[1:]))]
    want |= {9000: [], 9001: [], 9002: []}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(docs)
    found = license_scan.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    assert {r["doc_id"]: [x["family"] for x in r["licenses"] if x["confirmed"]] for r in found} == want
    assert all(x["paragraph"] == r["doc_id"] % 2 for r in found for x in r["licenses"] if x["confirmed"])
