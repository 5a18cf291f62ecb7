import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import abuse, hash_forest, knn_tree, mixture, near_groups, shingles, stable_sample, tokens
from tarnwork.llm.shingles import jaccard, normal, trigrams


def make_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        kind = rng.integers(0, 5) if rows else 0
        if kind < 2:
            text = " ".join(rng.choice(words, 30))
        elif kind == 2:
            text = rows[rng.integers(0, len(rows))][1]
        elif kind == 3:
            src = (rows[rng.integers(0, len(rows))][1] or "").split()
            for _ in range(2):
                if src:
                    src[rng.integers(0, len(src))] = rng.choice(words)
            text = " ".join(src)
        else:
            text = [None, "", "   ", "short", "X" * 50][rng.integers(0, 5)]
        rows.append((i + 1, text, "extra", i * 4 // n))
    return rows


def truth(rows):
    live = [(i, b, normal(t)) for i, t, _, b in rows if normal(t)]
    grams = [trigrams(t) for _, _, t in live]
    near = {k: [j for j in range(len(live)) if j != k and jaccard(grams[k], grams[j]) >= 0.8] for k in range(len(live))}
    comp = list(range(len(live)))
    for _ in live:
        comp = [min([comp[k], *(comp[j] for j in near[k])]) for k in range(len(live))]
    groups = {(live[comp[k]][0], live[k][0]) for k in range(len(live)) if near[k]}
    kept, cases = set(), set()
    for k, (i, b, _) in enumerate(live):
        hit = [live[j][0] for j in near[k] if j in kept] if b else []
        if hit:
            cases.add((min(hit), i))
        else:
            kept.add(k)
    return groups, cases


SCHEMA = "id int, text string, digest string, batch_no int"


def test_near_duplicates_match_brute_force(spark):
    rows = make_texts(160)
    docs = spark.createDataFrame(rows, SCHEMA)
    groups, cases = truth(rows)
    assert {tuple(r) for r in near_groups.near_groups(docs).collect()} == groups and groups
    assert {tuple(r) for r in hash_forest.repeats(docs).collect()} == cases and cases


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_groups.near_groups(none).collect() == [] and hash_forest.repeats(none).collect() == []
    twice = spark.createDataFrame([(1, "a" * 30 + "b" * 30, "", 0)] * 2 + [(None, "a" * 60, "", 0), (2, "z" * 30 + "y" * 30, "", None)], SCHEMA)
    assert near_groups.near_groups(twice).collect() == []


def test_estimate_is_close():
    draw = lambda s: "".join(np.random.default_rng(s).choice(list("abcdefgh"), 400))
    texts = [draw(1), draw(2), draw(1) + draw(2), draw(1)[:60]]
    sets, (size, slots) = [trigrams(t) for t in texts], shingles.signatures(texts, near_groups.PASSES)
    regs = near_groups.registers(slots)
    assert [len(s) for s in sets] == size.tolist()
    assert near_groups.estimate(regs[0], regs[0], size[0], size[0]) == 1
    for i, j in [(0, 2), (0, 1), (0, 3)]:
        assert abs(near_groups.estimate(regs[i], regs[j], size[i], size[j]) - jaccard(sets[i], sets[j])) < 0.15


def test_signatures_do_not_depend_on_the_block():
    texts = ["".join(np.random.default_rng(s).choice(list("abcdefgh "), 50 + 40 * s)) for s in range(30)]
    whole = shingles.signatures(texts, 2)[1]
    assert all((shingles.signatures([t], 2)[1][0] == whole[i]).all() for i, t in enumerate(texts))


def family(n, first=1, word="w"):
    """n texts that differ in one number only; any two are nearly the same."""
    base = " ".join(f"{word}{i:03d}" for i in range(40))
    return [(first + i, f"{base} {i:05d}", "", None) for i in range(n)]


def test_a_hot_bucket_is_not_paired(spark):
    docs = family(400) + [(9000, " ".join(f"z{i:03d}" for i in range(40)), "", None)]
    table = spark.createDataFrame(docs, SCHEMA)
    assert {tuple(r) for r in near_groups.near_groups(table).collect()} == {(1, i) for i in range(1, 401)}


def test_crossing_pairs_members_outside_the_largest_component_only(spark):
    n = 20_000
    placed = spark.range(1, n + 2).select(F.lit(7).cast("bigint").alias("key"), "id", F.lit(100).alias("size"), F.lit(1).cast("bigint").alias("f"), F.lit(1).cast("bigint").alias("g"))
    comps = spark.range(1, n + 1).select("id", F.lit(1).cast("bigint").alias("comp"))
    pairs = near_groups.crossing(placed, comps, 0.8)
    got = pairs.agg(F.count("*"), F.min("b"), F.max("b")).first()
    assert tuple(got) == (n, n + 1, n + 1)


def numbered(rows, batch):
    return [(i, t, x, batch) for i, t, x, _ in rows]


def test_forest_with_hot_ranges(spark):
    rows = numbered(family(60), 0) + numbered(family(60, 100), 1) + numbered(family(60, 300, "v"), 1) + numbered(family(30, 500, "v"), 2)
    want = {(1, i) for i in range(100, 160)} | {(300, i) for i in range(301, 360)} | {(300, i) for i in range(500, 530)}
    assert {tuple(r) for r in hash_forest.repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_rounds_within_a_batch(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "FIRST", 2)
    monkeypatch.setattr(hash_forest, "STEP", 2)
    monkeypatch.setattr(hash_forest, "ONE_TASK", 3)
    rows = make_texts(120, 5)
    assert {tuple(r) for r in hash_forest.repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == truth(rows)[1]


def test_forest_without_seed_and_empty_batches(spark):
    forest = hash_forest.HashForest(spark)
    batch = spark.createDataFrame(family(3) + [(7, None, "", None), (None, "x" * 60, "", None)], SCHEMA)
    assert forest.check(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {tuple(r) for r in forest.check(batch).collect()} == {(1, 2), (1, 3)}
    assert forest.check(batch).collect() == [] or {tuple(r) for r in forest.check(batch).collect()} == {(1, 2), (1, 3)}
    assert sum(r["rows"] for r in forest.state["runs"]) == 1
    forest.close()


def test_forest_reopens_and_reads_what_it_needs(spark, tmp_path):
    path = f"{tmp_path}/forest"
    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(12))
    read, first = [], [(i, text(), "", 0) for i in range(300)]
    forest = hash_forest.HashForest(spark, path, rows_per_file=64)
    forest.seed(spark.createDataFrame(first, SCHEMA))
    for turn in range(2):
        again = hash_forest.HashForest(spark, path, rows_per_file=64)  # as another session would
        again.ask_from = 0
        got = again.check(spark.createDataFrame([(10_000 + turn, first[5][1] + "!", "", 1)], SCHEMA)).collect()
        assert [tuple(r) for r in got] == [(5, 10_000 + turn)]
        read.append((again.files_read["keys"], again.files_read["texts"]))
        again.seed(spark.createDataFrame([(20_000 * (turn + 1) + i, text(), "", 0) for i in range(600)], SCHEMA))
    every = sum(len(r["keys"]["files"]) for r in again.state["runs"])
    assert read[1][0] <= 2 * hash_forest.TREES + 8 < every and read[1][1] <= 2
    assert len(again.state["batches"]) == 5 and all(r["dir"] for run in again.state["runs"] for r in (run["keys"], run["texts"]))


def test_prefixes_widen(spark):
    forest = hash_forest.HashForest(spark)
    assert forest.depth < hash_forest.DEPTH and forest.state["recall"] >= 0.9999
    assert hash_forest.HashForest(spark, threshold=0.97, target=0.9).depth == hash_forest.DEPTH


def test_every_pair_of_many_copies(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64).astype(np.float32).tolist()
    rows = [(i, one) for i in range(20)] + [(100 + i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(50)]
    got = [(r.a, r.b) for r in knn_tree.nearest(spark.createDataFrame(rows, "pk bigint, embedding array<float>"), k=15).collect()]
    assert len(got) == len(set(got)) and all(sum(i in p for p in got) >= 15 for i in range(20)) and len(got) == 120 + 60


def test_large_leaves_are_searched_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    rows = [(i, (base + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(300)] + [(5, base.astype(np.float32).tolist())]
    table = spark.createDataFrame(rows, "pk bigint, embedding array<float>")
    plain = {(r.a, r.b) for r in knn_tree.nearest(table, leaf_rows=1000).collect()}
    monkeypatch.setattr(knn_tree, "BLOCK", 64)
    assert {(r.a, r.b) for r in knn_tree.nearest(table, leaf_rows=1000).collect()} == plain and len(plain) > 600


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 64))
    x = np.concatenate([base, base[:150] + 0.2 * rng.standard_normal((150, 64)), np.repeat(base[:1], 12, axis=0) * 3])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 64), (1002, [1.0]), (1003, [float("nan")] * 64), (None, [1.0] * 64)]
    got = {(r.a, r.b) for r in knn_tree.nearest(spark.createDataFrame(rows, "pk bigint, embedding array<float>"), leaf_rows=64).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -1)
    same = {0, *range(550, 562), 400}
    want = {(min(a, b), max(a, b)) for a in range(len(u)) if a not in same for b in np.argsort(-sims[a])[:5] if sims[a, b] >= 0.85 and b not in same}
    got_rest = {p for p in got if not set(p) & same}
    assert len(want & got_rest) >= 0.97 * len(want) and got_rest <= want | {p for p in got_rest if sims[p] >= 0.85}
    for a in range(550, 562):
        assert sum(a in p for p in got) >= 5


def test_walks_and_calibration_hold_little():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40_000, 8)).astype(np.float32)
    tree = knn_tree.Tree(x[:8000], 1000)
    peaks = []
    for rows in (2048, 40_000):
        tracemalloc.start()
        bins = tree.visits(x[:rows], 6)
        peaks.append(tracemalloc.get_traced_memory()[1] - bins.nbytes)
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] and (bins >= 0).all() and all(len(set(r)) == 6 for r in bins[:500].tolist())
    assert (tree.visits(x[:50], 2000) >= 0).sum() == 50 * 1000
    assert knn_tree.first_met(np.array([[5, 7, 9], [1, 2, -1]]), np.array([[9, 5, 1], [3, 4, -1]])).tolist() == [2, np.inf]


def test_neighbouring_leaves_share_a_group():
    children = [np.arange(1, 4), np.arange(4, 6), np.arange(0), np.arange(6, 8), *[np.arange(0)] * 4]
    leaves, load = [4, 5, 2, 6, 7], np.array([0, 0, 9e9, 0, 30_000, 30_000, 30_000, 40_000])
    group = knn_tree.grouped(children, load, np.where(load > 1e9, 9, 1))[leaves].tolist()
    assert group == [0, 0, 1, 2, 3]


def test_no_vectors(spark):
    assert knn_tree.nearest(spark.createDataFrame([(1, None)], "pk bigint, embedding array<float>")).collect() == []


def test_sample_is_stable(spark):
    tags = spark.createDataFrame([("docs_1", 1, True, 5, True), ("docs_2", 2, True, 5, False), ("other", 3, True, 5, True)], "tag_name string, created_at int, for_training boolean, seed bigint, deterministic_order boolean")
    rows = [("docs_1", f"docs:{i}") for i in range(200)] * 2 + [("docs_2", f"docs:{i}") for i in range(10, 400)] + [("docs_1", None)]
    take = lambda r, n: sorted(map(tuple, stable_sample.tag_samples(spark.createDataFrame(r, "tag_name string, primary_key string").repartition(n), tags).collect()))
    one = take(rows, 3)
    assert one == take(rows[::-1], 7)
    first, second = ({k for t, k, _ in one if t == n} for n in ("docs_1", "docs_2"))
    again = {k for k in first if int(k[5:]) >= 10}
    assert len(first) == 20 and len(second) == 39 and again <= second
    assert sorted(p for t, _, p in one if t == "docs_1") == list(range(1, 21)) and all(p is None for t, _, p in one if t == "docs_2")
    assert stable_sample.tag_samples(spark.createDataFrame([], "tag_name string, primary_key string"), tags).collect() == []


def test_ledger_reopens(spark, tmp_path):
    keys = lambda *spans: spark.createDataFrame([(f"docs:{i}",) for a, b in spans for i in range(a, b)], "primary_key string")
    names = lambda df: {r.primary_key for r in df.collect()}
    first = names(stable_sample.SelectionLedger(spark, f"{tmp_path}/l").take(keys((0, 100)), 3, draw="a"))
    again = stable_sample.SelectionLedger(spark, f"{tmp_path}/l")  # as another session would
    assert names(again.take(keys((0, 5)), 3, draw="a")) == first
    second = names(again.take(keys((0, 300)), 3, draw="b"))
    assert len(first) == 10 and first < second and len(second) == 30
    assert names(stable_sample.SelectionLedger(spark, f"{tmp_path}/l").drawn("b")) == second


@pytest.mark.parametrize("text", ["", "plain words", "Müller 😀 café <|endoftext|>\n\tx", "データ" * 50, "a" * 20_000])
def test_tokens_round_trip(text):
    ids = tokens.encode_texts([text], tokens.VOCABULARY)[0]
    assert tokens.decode_ids(ids, tokens.VOCABULARY) == text
    spans = tokens.offsets(text, ids, tokens.VOCABULARY)
    assert len(spans) == len(ids) and (not text or spans[0][0] == 0 and spans[-1][1] == len(text))


def test_encode_rows(spark):
    docs = spark.createDataFrame([(1, "hello", "x"), (2, None, "x"), (None, "", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(docs).collect()}
    assert got[2] == [] and got[None] == [] and tokens.decode_ids(got[1], tokens.VOCABULARY) == "hello"


def test_offsets_rows(spark):
    docs = spark.createDataFrame([(1, "h\u00e9llo \U0001f600", "x"), (2, None, "x"), (None, "", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in tokens.encode_with_offsets(docs).collect()}
    assert got[2].ids == got[2].starts == [] and got[None].ends == [] and got[1].starts[0] == 0 and got[1].ends[-1] == 7
    assert len(got[1].ids) == len(got[1].starts) == len(got[1].ends)


def test_budgets():
    tree = {"d": {"en": {"a": {}, "b": {}}, "de": {"c": {}}}, "e": {"en": {"x": {}}}}
    room = {("d", "en", "a"): 10, ("d", "en", "b"): 100, ("d", "de", "c"): 100, ("e", "en", "x"): 100}
    w = {("d",): 0.5, ("e",): 0.5, ("d", "en"): 0.4, ("d", "de"): 0.1, ("e", "en"): 0.5, ("d", "en", "a"): 0.3, ("d", "en", "b"): 0.1, ("d", "de", "c"): 0.1, ("e", "en", "x"): 0.5}
    got = mixture.budgets(tree, w, room, 100)
    assert abs(sum(got.values()) - 100) < 1e-6 and got["d", "en", "a"] == 10 and abs(got["d", "en", "b"] - 30) < 1e-6 and abs(got["e", "en", "x"] - 50) < 1e-6


def test_mixture(spark):
    docs = [(i, "word " * (i % 7 + 1), "en" if i % 3 else "DE-x", "big") for i in range(200)] + [(1000 + i, "tiny text", None, "small") for i in range(3)] + [(None, "x", "en", "big"), (5000, None, "en", "big"), (5001, "x", "en", None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    goals = spark.createDataFrame([("big", 0.8, 1), ("small", 0.1, 2), ("none", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(table, goals, total=400)
    used = {r.doc_id: r.repeats for r in m.documents().collect()}
    assert all(used.get(1000 + i) == 2 for i in range(3)) and max(v for k, v in used.items() if k < 1000) == 1 and not {5000, 5001, None} & set(used)
    shares = {r.source: r.actual_share for r in m.shares().collect()}
    assert shares["none"] == 0 and abs(sum(shares.values()) - 1) < 1e-6 and abs(sum(r.tokens for r in m.shares().collect()) - 400) < 20
    assert mixture.Mixture(table.limit(0), goals).documents().collect() == []


def test_abuse_held_out(spark):
    rng = np.random.default_rng(0)
    bad = ["you {} idiot", "shut up, {} moron", "I will hurt you, {}"]
    good = ["the planner read {} pages", "please restart {} nodes", "the cache kept {} rows", "thanks {}, all fine"]
    rows = []
    for i in range(300):
        s = [rng.choice(good).format(rng.choice(["dumb", "old", "few", "warm"])) for _ in range(4)]
        if i % 3 == 0:
            s[rng.integers(0, 4)] = rng.choice(bad).format(rng.choice(["old", "dumb"]))
        rows.append((i, ". ".join(s), "s"))
    docs = spark.createDataFrame([*rows, (900, None, "s"), (901, "", None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "r") for i in range(150)] * 2 + [(1, None, "r2"), (None, 1, "r")], "doc_id bigint, abusive int, rater string")
    marked = abuse.scored(docs, abuse.train(docs, labels), ("doc_id", "source"))
    got = {r.doc_id: r.chance >= abuse.CUTOFF for r in marked.collect()}
    assert np.mean([got[i] == (i % 3 == 0) for i in range(150, 300)]) > 0.95 and not got[900] and not got[901]
    assert sum(r.documents for r in abuse.rates(marked).collect()) == 302
    flat = abuse.train(docs, labels.limit(0))
    assert abuse.scored(docs, flat).where("chance >= 0.35").count() == 0


@pytest.mark.parametrize(("a", "b"), [("1d107", "idiot"), ("i d i o t s", "idiots"), ("idiooooot", "idiot"), ("іdіоt", "idiot"), ("IDIOT", "idiot")])
def test_odd_spellings_share_a_feature(a, b):
    assert abuse.token_numbers(b)[0] in [abuse.token_numbers(t)[0] for t in abuse.spelt(a)] or "107" in a


def test_pieces_of_whole_words():
    a, b = ("x" * 7 + "abcdefghij" * 3 + end for end in ("idiotkind", "friendly"))
    assert set(abuse.token_numbers(a)[1]) != set(abuse.token_numbers(b)[1])
    slot, sentence, text = abuse.features([f"one {a}. two", None, "", "three"])
    assert text.tolist() == [0, 0, 3] and set(sentence.tolist()) == {0, 1, 2}
