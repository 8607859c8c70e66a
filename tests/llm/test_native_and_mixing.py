import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumisift.llm import decontaminate, fingerprint, mixing, registry

from .conftest import prose


def test_registry_names():
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def python_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
    return out


def test_mix_query(spark, docs, as_table):
    rows = registry.queries()["op10_mix_sources"](spark, as_table(documents=docs)).collect()
    texts = docs.select("text", "source").collect()
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    want = python_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    largest = defaultdict(int)
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(rows) == len(texts) and all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in want)


def test_mix_is_reproducible(spark, docs):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(mixing.mix_documents(docs)) == key(mixing.mix_documents(docs.repartition(5)))


def test_mix_empty(no_docs):
    assert mixing.mix_documents(no_docs).count() == 0


def test_sizes_near_target_on_many_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 40 for r in got)


def test_many_sources(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), None if i % 41 == 0 else f"h{(i * i) % 97}é" if i % 2 else f"h{i % 13}") for i in range(2000)]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = python_targets(sizes)
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["text"] is not None
    assert len(sizes) > 40 and all(abs(taken[s] - want[s]) <= 31 for s in want)
    clash = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c", "d"]), (4, ["d"])], "doc_id long, members array<string>").withColumn("size", F.lit(5))
    assert sum(r["taken"] for r in mixing.mix(clash, {"a": 5}).collect()) == 5  # a chain of linked sources is one flow


def test_groups_of_linked_sources_are_flows_of_their_own(spark):
    """Many small groups: each is spent as the flow of all of them says."""
    rng = random.Random(9)
    capacity, quota = {}, {}
    for g in range(12):
        a, b, c = (None if g == 5 else f"a{g}"), f"b{g}", f"c{g}"
        for p in ((b, a) if a is None else (a, b), (b,), (b, c), (a,)):
            capacity[p] = rng.randint(0, 9)
        quota |= {a: rng.randint(0, 20), b: rng.randint(0, 20), c: rng.randint(0, 9)}
    capacity[()] = 7
    frame = spark.createDataFrame([(list(p), n) for p, n in capacity.items()], "_pattern array<string>, n long").repartition(5)
    plan = mixing.planned(frame, spark.createDataFrame(list(quota.items()), "source string, quota long"), 2).collect()
    got = {tuple(r["_pattern"]): r["base"] * capacity[tuple(r["_pattern"])] + r["room"] for r in plan}
    used = mixing.route(capacity, quota)
    cost = lambda u: sum(sum(1 + k // capacity[p] for k in range(n)) for p, n in u.items())
    assert set(got) == set(capacity) and sum(got.values()) == sum(used.values()) and cost(got) == cost(used)
    assert all(n <= 2 * capacity[p] for p, n in got.items())


def test_mix_keeps_all_columns(docs):
    got = mixing.mix_documents(docs.withColumn("size", F.lit("x")).withColumn("kept", F.lit(1)))
    assert got.columns == [*docs.columns, "kept", "size", "source_size", "target", "taken"]
    key = lambda df: Counter(map(repr, df.select(*docs.columns).collect()))
    assert key(got) == key(docs)


def brute_cost(capacity, quota, epochs=2):
    """Cheapest total cost of units for tiny instances, by trying all flows unit by unit."""
    best = None
    patterns = list(capacity)

    def go(sources, used, cost, short):
        nonlocal best
        if not sources:
            best = min(best, (short, cost)) if best is not None else (short, cost)
            return
        s, *rest = sources
        choices = [p for p in patterns if s in p and used[p] < epochs * capacity[p]]
        for p in choices:
            go(rest, used | {p: used[p] + 1}, cost + 1 + used[p] // capacity[p], short)
        go(rest, used, cost, short + 1)

    go([s for s, n in quota.items() for _ in range(n)], dict.fromkeys(patterns, 0), 0, 0)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_route_is_cheapest(seed):
    rng = random.Random(seed)
    capacity = {p: rng.randint(1, 2) for p in [("a",), ("b",), ("a", "b"), ("b", "c")]}
    quota = {"a": rng.randint(0, 3), "b": rng.randint(0, 3), "c": rng.randint(0, 2)}
    used = mixing.route(capacity, quota)
    cost = sum(sum(1 + u // capacity[p] for u in range(n)) for p, n in used.items())
    assert (sum(quota.values()) - sum(used.values()), cost) == brute_cost(capacity, quota) and all(n <= 2 * capacity[p] for p, n in used.items())


def test_single_sources_go_through_the_flow(spark):
    plan = mixing.planned(spark.createDataFrame([(["a"], 10), (["b"], 4)], "_pattern array<string>, n long"), spark.createDataFrame([("a", 13), ("b", 9)], "source string, quota long"), 2)
    assert {tuple(r["_pattern"]): (r["base"], r["room"]) for r in plan.collect()} == {("a",): (1, 3), ("b",): (2, 0)}


def test_convex_costs_spare_documents(spark):
    """b can be served by its own documents twice, or by shared ones once: nothing is repeated while anything fresh is left."""
    rows = [(i, 10, ["b"] if i < 10 else ["a", "b"]) for i in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, members array<string>"), {"a": 100, "b": 200}).collect()
    assert all(r["taken"] == 10 for r in got)  # 300 units of 300: by b's quota alone, its own 100 would be taken twice
    more = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, members array<string>"), {"a": 100, "b": 260}).collect()
    assert sum(r["taken"] for r in more) == 360 and min(r["taken"] for r in more) == 10 and max(r["taken"] for r in more) == 20


def test_a_group_of_very_many_patterns():
    """A chain of 60,000 linked patterns is one flow; layers keep it to few passes."""
    n = 60_000
    capacity = {(f"s{i:06d}", f"s{i + 1:06d}"): 2 for i in range(n)}
    quota = {f"s{i:06d}": 2 for i in range(n + 1)}
    used = mixing.route(capacity, quota)
    assert sum(used.values()) == 2 * n + 2 and sum(max(0, u - 2) for u in used.values()) == 2


def test_overlapping_members(spark):
    rows = [(i, 10, [["a"], ["b"], ["a", "b"], [], None][i % 5]) for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, members array<string>"), {"a": 200, "b": 100}).collect()
    assert sum(r["taken"] for r in got) == 300 and all(r["taken"] == 0 for r in got if not r["members"])


def test_items_of_one_text_and_hot_seeds(spark):
    rng = random.Random(9)
    common = "one common opening of seven words here"
    items = [(i, common + " " + " ".join(f"i{i}w{j}" for j in range(8))) for i in range(60)] + [(100, None), (101, "short item"), (102, "short item")]
    items += [(200 + i, items[3][1]) for i in range(3)]
    docs = [(i, " ".join(f"d{rng.randrange(999)}" for _ in range(20)) + " " + common) for i in range(40)]
    docs += [(50, "lead " + items[3][1] + " tail"), (51, "a short item is here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.col("doc_id"))
    for block in (1500, 10**6):
        got = {(r["doc_id"], r["item_id"], r["words"], r["equal"]) for r in decontaminate.find_overlaps(frame, benchmark, block_seeds=block).collect()}
        assert got == {(50, i, 15, 15) for i in (3, 200, 201, 202)} | {(51, 101, 2, 2), (51, 102, 2, 2)}


# --- fingerprints -------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, as_table):
    folder = as_table(documents=docs)
    rows = registry.queries()["op5_fingerprints"](spark, folder).collect()
    source = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    assert len(rows) == len(source)
    import hashlib

    first = {}
    for d, t in source:
        if d is not None:
            first.setdefault(d, []).append(t)
    ids = sorted(first)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    want = Counter()
    for d, t in source:
        k = len(t) // 4
        opening = "" if d is None else min(x[:k] if len(first[after[d]]) == 1 else x for x in first[after[d]])[:k]
        want[d, len(t), hashlib.sha256((t[: len(t) - k] + opening).encode()).hexdigest()] += 1
    single = {d for d in first if len(first[after[d]]) == 1} | {None}
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    assert {k: v for k, v in got.items() if k[0] in single} == {k: v for k, v in want.items() if k[0] in single}
    by_text = defaultdict(set)
    texts = {(d, len(t)): t for d, t in source}
    for r in rows:
        by_text[texts[r["doc_id"], r["n_chars"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] is None) == (r["doc_id"] is None)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {"0" * 32}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda p: (signed(int(p, 16) & (1 << 64) - 1), signed(int(p, 16) >> 64))
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    prints = defaultdict(list)
    for r in rows:
        prints[r["doc_id"]].append(r["fingerprint"])
    edited = defaultdict(set)
    for r in rows:
        edited[r["edited_sha256"]].add(r["edited_fingerprint"])
        assert r["near_edited"] == 1 - apart(r["fingerprint"], r["edited_fingerprint"]) / 128
        if r["doc_id"] is not None:
            assert r["near_next"] == 1 - apart(r["fingerprint"], min(prints[after[r["doc_id"]]], key=halves)) / 128
        asked = r["doc_id"] is not None and r["doc_id"] % 50 == 0
        assert r["n_near"] == (sum(apart(r["fingerprint"], p) <= 3 for many in prints.values() for p in many) if asked else None)
    assert all(len(v) == 1 for v in edited.values())
    # An edited text equal to some document's text has that document's fingerprint.
    own = {hashlib.sha256(t.encode()).hexdigest(): by_text[t] for t in by_text}
    assert any(sha in own for sha in edited) and all(own[sha] == prints_of for sha, prints_of in edited.items() if sha in own)


def test_fingerprints_empty(no_docs):
    assert fingerprint.fingerprint_documents(no_docs).count() == 0


def test_near_fingerprints_is_exact(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = {b ^ sum(1 << p for p in rng.sample(range(128), rng.randint(0, 6))) for b in base for _ in range(20)}
    half = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(half(p & (1 << 64) - 1), half(p >> 64)) for p in prints], "f0 long, f1 long")
    found = {(r["q0"], r["q1"], r["f0"], r["f1"]): r["distance"] for r in fingerprint.near_fingerprints(df, df, 3).collect()}
    want = {(half(a & (1 << 64) - 1), half(a >> 64), half(b & (1 << 64) - 1), half(b >> 64)): (a ^ b).bit_count() for a in prints for b in prints if (a ^ b).bit_count() <= 3}
    assert found == want


def test_simhash_votes(spark):
    """Against a plain count of votes."""
    import math

    texts = spark.createDataFrame([(1, "a b b c"), (2, "  a  "), (3, "")], "id long, text string")
    hashes = {r["w"]: (r["h0"], r["h1"]) for r in spark.createDataFrame([(w,) for w in "abc"], "w string").select("w", F.xxhash64("w").alias("h0")).withColumn("h1", F.xxhash64("h0", F.lit(1))).collect()}
    for r in fingerprint.simhash(texts, ["id"]).collect():
        words = Counter({1: "abbc", 2: "a", 3: ""}[r["id"]])
        for half in (0, 1):
            want = 0
            for bit in range(64):
                weight = {w: round(8 * (1 + math.log(n))) for w, n in words.items()}
                votes = sum(weight[w] for w in words if hashes[w][half] >> bit & 1)
                want |= (votes * 2 > sum(weight.values())) << bit
            assert r[f"f{half}"] & (1 << 64) - 1 == want


# --- decontamination ----------------------------------------------------------------------------------


def overlaps(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["start"], r["words"], r["equal"]) for r in decontaminate.find_overlaps(d, b, **more).collect()}


def test_overlaps(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    noise = [f"n{i}" for i in range(30)]
    swapped = [*item]
    for i in (6, 13, 20, 33):
        swapped[i] = f"z{i}"
    docs = [(1, " ".join(noise + item + noise)), (2, " ".join(noise + swapped)), (3, " ".join(item[:20] + noise)), (4, " ".join(noise)), (5, None), (6, ""), (7, " ".join(item[:8])), (8, " ".join(item).upper()), (1, " ".join(noise + item + noise)), (9, "  " + "\n".join(item) + "\t")]
    got = overlaps(spark, docs, [(1, " ".join(item)), (2, None), (3, "short item"), (4, ""), (None, " ".join(f"q{i}" for i in range(20)))])
    assert got == {(1, 1): (30, 40, 40), (2, 1): (30, 40, 36), (3, 1): (0, 20, 20), (8, 1): (0, 40, 40), (9, 1): (0, 40, 40)}
    assert got == overlaps(spark, docs, [(1, " ".join(item))], block_seeds=10)  # in many blocks of the benchmark
    assert overlaps(spark, docs, []) == {} and overlaps(spark, [], [(1, " ".join(item))]) == {}


def brute_stretch(hits, least, share=0.8):
    """(equal, words) of the qualifying stretch with most equal, then fewest words, over all lengths and placements."""
    all_of = [(sum(hits[i:j]), i - j) for i in range(len(hits)) for j in range(i + least, len(hits) + 1) if sum(hits[i:j]) >= share * (j - i) - 1e-9]
    return (max(all_of)[0], -max(all_of)[1]) if all_of else None


def test_best_stretch_equals_brute_force(spark):
    rng = random.Random(8)
    cases = [[rng.random() < rng.choice((0.5, 0.75, 0.85, 0.95)) for _ in range(rng.randint(0, 45))] for _ in range(600)]
    cases += [[i not in (4, 9, 14) for i in range(20)], [i != 5 for i in range(10)], [True] * 10, [False] * 12, [i % 5 != 4 for i in range(43)]]
    rows = [(n, [0] * len(c), [0 if hit else 1 for hit in c]) for n, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, a array<int>, b array<int>")
    got = {r["n"]: r["found"] for r in df.select("n", decontaminate.best_stretch(F.col("a"), F.col("b"), 0.8, 10).alias("found")).collect()}
    for n, hits in enumerate(cases):
        want = brute_stretch(hits, 10)
        assert [(f["equal"], f["words"]) for f in got[n]] == ([want] if want else []), hits
        for f in got[n]:
            assert f["start"] >= 0 and f["start"] + f["words"] <= len(hits) and sum(hits[f["start"] : f["start"] + f["words"]]) == f["equal"]


def test_substitution_that_cuts_a_short_passage(spark):
    item = [f"a{i}" for i in range(13)]
    changed = [*item[:3], "z", *item[4:]]
    assert overlaps(spark, [(1, "x y " + " ".join(changed)), (2, "x y")], [(7, " ".join(item))]) == {(1, 7): (2, 13, 12)}


def test_every_overlap_holds_a_seed():
    """Walk all texts that hold no mask: none has ten words or more, four fifths of them equal, at any length.

    A state is the last ten words (1 equal, 0 other); an equal word adds 1 and another takes 4, so a
    stretch with the share has no negative sum. The best sums settle below zero and repeat, lower, five words later.
    """
    span = 10
    assert max(map(len, decontaminate.MASKS)) <= span
    masks = [int(m, 2) for m in decontaminate.MASKS]
    best, sums = {0: 0}, []
    for _ in range(60):
        after = {}
        for state, total in best.items():
            for bit in (0, 1):
                to = (state << 1 | bit) & (1 << span) - 1
                if not any(to & m == m for m in masks):
                    after[to] = max(after.get(to, -(10**9)), total + (1 if bit else -4))
        best = after
        sums.append(dict(best))
    assert all(max(s.values()) < 0 for s in sums[9:])
    # No state gains over a period of five words: no longer text can reach zero either.
    assert all(total <= sums[-6][state] for state, total in sums[-1].items())


def test_sparse_seeds_and_whole_short_items(spark):
    item = [f"a{i}" for i in range(40)]
    fifth = [w if i % 5 != 4 else f"z{i}" for i, w in enumerate(item)]
    texts = ["x y " + " ".join(item[12:22]) + " x y", " ".join(fifth), "x " + " ".join(item[3:6] + ["z", "z"] + item[8:13]) + " y", "x Short exact Item y", "short item exact", "only"]
    got = overlaps(spark, list(enumerate(texts)), [(1, " ".join(item)), (2, "short exact item"), (3, "  "), (4, "only"), (5, None)])
    assert got == {(0, 1): (2, 10, 10), (1, 1): (0, 39, 32), (2, 1): (1, 10, 8), (3, 2): (1, 3, 3), (5, 4): (0, 1, 1)}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(9)
    items, docs, want = [], [], {}
    for n in range(150):
        item = [f"i{n}w{k}" for k in range(rng.randint(10, 24))]
        text = [w if rng.random() < 0.8 else "z" for w in item]
        items.append((n, " ".join(item)))
        docs.append((n, " ".join(["x"] * rng.randint(0, 4) + text + ["y"])))
        found = brute_stretch([a == b for a, b in zip(item, text, strict=True)], 10)
        if found:
            want[n, n] = found
    got = overlaps(spark, docs, items)
    assert {k: (v[2], v[1]) for k, v in got.items()} == want and len(want) > 50


def test_item_shorter_than_a_mask(spark):
    item = " ".join(f"a{i}" for i in range(11))
    assert overlaps(spark, [(1, f"x y {item} z"), (2, "x y z")], [(7, item)]) == {(1, 7): (2, 11, 11)}


def test_drop_contaminated_keeps_columns(spark, docs):
    rng = random.Random(6)
    passage = prose(rng, "en", 30, 30)
    leak = docs.limit(1).withColumn("text", F.concat(F.lit(passage), F.lit(" end"))).withColumn("doc_id", F.lit(9999).cast("long"))
    both = docs.unionByName(leak)
    kept = decontaminate.drop_contaminated(both, spark.createDataFrame([(1, passage, "x")], "item_id long, text string, key string"))
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.filter("doc_id = 9999").count() == 0
    assert decontaminate.drop_contaminated(docs.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("make", [lambda d: fingerprint.fingerprint_documents(d), lambda d: decontaminate.drop_contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text"))])
def test_no_python_in_native_plans(docs, make):
    plan = make(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_overlaps_of_very_repetitive_texts(spark):
    """A word that fills a document and an item: one overlap, found without meeting at every pair of places."""
    item = " ".join(["word"] * 2000)
    docs = [(1, "x " + " ".join(["word"] * 20_000)), (2, " ".join(["word"] * 30) + " y"), (3, " ".join(["a", "b"] * 40)), (4, "z " * 50)]
    got = overlaps(spark, docs, [(1, item), (2, " ".join(["b", "a"] * 15))])
    assert {k: v[1:] for k, v in got.items()} == {(1, 1): (2000, 2000), (2, 1): (30, 30), (3, 2): (30, 30)}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    seeds = lambda df: decontaminate.with_seeds(df.select(decontaminate.word_hashes("text").alias("words")), ["111011"]).groupBy("h", "before").count()
    assert seeds(d.filter("doc_id = 1")).count() < 12  # of 20,000 places nearly all have one hash, before and at them
