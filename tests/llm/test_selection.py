"""Importance resampling, vector codes and MinHash near-dedup against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lumisift.llm import minhash_dedup, registry, resample, vector_codes

QUERIES = registry.queries()


# --- 11 importance resampling ---------------------------------------------------------------------------


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text, most=2, buckets=10_000):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for i in range(len(w)) for n in range(1, most + 1) if i + n <= len(w)]


def plain_resample(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score) of every row, and how many are drawn."""
    s, t = Counter(b for _, x in docs for b in plain_buckets(x)), Counter(b for x in target for b in plain_buckets(x))
    many, few = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (many + 10_000) / ((s[b] + 1) * (few + 10_000)))) for b in s}
    out = []
    for d, x in docs:
        f = plain_buckets(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= least))
    return out, sum(r[4] for r in out) * percent // 100


def test_resample_query(spark, docs, as_table):
    target = spark.createDataFrame([(1, "the of And tion er", 3), (2, None, 3), (3, "", 3), (4, "die der und 42 keit", 3)], "item_id long, text string, n long")
    rows = QUERIES["op11_resample"](spark, as_table(documents=docs, benchmark=target)).collect()
    want, drawn = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert Counter(tuple(r)[:4] for r in rows) == Counter(r[:4] for r in want) and drawn > 5
    ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in rows if r["rank"])
    best = sorted((-r[3], r[0] is None, r[0] or 0) for r in want if r[4])[:drawn]
    assert [(n, -s, d is None, d or 0) for n, s, d in ranked] == [(n, *b) for n, b in enumerate(best, 1)]


def test_spans_stand_at_word_boundaries():
    clean = resample.collapse("  One,TWO\t\x00three--4é five! ".encode())
    assert clean == "one two three 4é five".encode()
    cut = [clean[a:b].decode() for a, b in resample.ngram_spans(clean, 3)]
    words = clean.decode().split()
    assert cut == [" ".join(words[i : i + n]) for i in range(5) for n in (1, 2, 3) if i + n <= 5]
    assert list(resample.feature_buckets(clean, resample.ngram_pattern(3), 1 << 32)) == [zlib.crc32(x.encode()) for x in cut]
    assert list(resample.ngram_spans(b"", 2)) == [] and resample.collapse(b" .\x7f ") == b""


def test_a_text_of_one_very_long_word_and_one_of_very_many():
    pattern = resample.ngram_pattern(2)
    assert list(resample.feature_buckets(b"x" * 300_000, pattern, 7)) == [zlib.crc32(b"x" * 300_000) % 7]
    assert len(list(resample.feature_buckets(b" ".join([b"ab"] * 200_000), pattern, 7))) == 399_999


def test_resample_keeps_rows_and_draws_what_is_like_the_target(spark):
    rng = random.Random(3)
    make = lambda words: " ".join(rng.choice(words) for _ in range(40))
    like, other = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, make(like if i % 4 == 0 else other), "x", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, rank long")
    target = spark.createDataFrame([(make(like),) for _ in range(20)], "text string")
    got = resample.resample(df, target)
    assert got.columns == df.columns and got.count() == 50
    assert sum(r["doc_id"] % 4 == 0 for r in got.collect()) >= 35
    assert {tuple(r) for r in got.collect()} <= set(rows)
    everything = resample.ResampleSettings(percent=100, least_words=0)
    assert resample.resample(df, target.limit(0), everything).count() == 200


def test_resample_empty(spark, no_docs, as_table):
    target = spark.createDataFrame([], "item_id long, text string")
    assert QUERIES["op11_resample"](spark, as_table(documents=no_docs, benchmark=target)).count() == 0


def test_ranks_cross_partitions(spark):
    rng = random.Random(5)
    rows = [((rng.randrange(500),), 30, 4, 0, rng.randrange(40)) for _ in range(3000)]
    scored = spark.createDataFrame(rows, "row struct<doc_id:long>, n_words long, n_features long, weight long, score long").repartition(7)
    got = resample.with_ranks(scored, resample.ResampleSettings(percent=50)).filter("rank is not null").collect()
    assert [(r["score"], r["row"]["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(-s, d) for s, d in sorted((-r[4], r[0][0]) for r in rows)[:1500]]
    assert sorted(r["rank"] for r in got) == list(range(1, 1501))


# --- 12 vector codes -----------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error) and the codebooks, by loops over Python integers."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = [(v, [math.floor(4096 * float(np.float32(x))) for x in vec], label) for v, vec, label in rows if vec and all(x is not None and math.isfinite(x) for x in vec)]
    if not kept:
        return [], []
    dims = len(min(kept, key=key)[1])
    kept = sorted((r for r in kept if len(r[1]) == dims), key=key)
    cut = [len(x) for x in np.array_split(np.arange(dims), parts)]
    at = [sum(cut[:p]) for p in range(parts + 1)]
    books = [[v[at[p] : at[p + 1]] for _, v, _ in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((apart(v[at[p] : at[p + 1]], e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = [(near(v, p)[1], v[at[p] : at[p + 1]]) for _, v, _ in kept]
            books[p] = [[sum(x) // len(x) for x in zip(*own, strict=True)] if (own := [v for j, v in mine if j == i]) else e for i, e in enumerate(books[p])]
    out = []
    for v, vec, label in kept:
        found = [near(vec, p) for p in range(parts)]
        out.append((v, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, books


def vectors(seed, n=120, dims=16):
    rng = random.Random(seed)
    rows = [(i * 7 % n, [rng.choice((0.0, 0.25, -0.5)) if seed == 1 else rng.gauss(0, 1) for _ in range(dims)], None if i % 9 == 0 else i % 4) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] * dims, [inf] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1), [1.0] * (dims + 1), [1.0]]
    return rows + [(n + i, v, 1) for i, v in enumerate(bad)] + [rows[5], rows[5], (None, rows[3][1], None), (rows[2][0], rows[8][1], 2)]


@pytest.mark.parametrize(("seed", "dims"), [(0, 16), (1, 16), (2, 13), (3, 5)])
def test_vector_codes_equal_brute_force(spark, as_table, seed, dims):
    rows = vectors(seed, dims=dims)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, n long").repartition(5)
    got = QUERIES["op12_vector_codes"](spark, as_table(embeddings=df)).collect()
    want, books = plain_codes(rows)
    by_label = Counter()
    for _, label, _, error in want:
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((v, code, error, by_label[label], digest) for v, label, code, error in want)


def test_blocks_of_any_size_give_the_same_codes(spark, monkeypatch):
    df = spark.createDataFrame(vectors(4), "vec_id long, embedding array<float>, label int")
    one, books = vector_codes.compress_vectors(df)
    plain = Counter(map(tuple, one.collect()))
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    other, again = vector_codes.compress_vectors(df.repartition(3))
    assert Counter(map(tuple, other.collect())) == plain and all((a == b).all() for a, b in zip(books, again, strict=True))


def test_few_vectors_large_values_and_decoding(spark):
    rows = [(1, [1e30, -1e30, 0.5, 1.0] * 2, 0), (2, [-1e30, 1e30, 2.0, -3.0] * 2, 0), (3, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress_vectors(df)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()}
    assert all(e == 0 for _, e in got.values()) and got[3][0] == "02" * 8 and len(books[0]) == 3
    codes = np.array([[int(got[v][0][2 * p : 2 * p + 2], 16) for p in range(8)] for v in (1, 2, 3)])
    back = vector_codes.decode(codes, books)
    assert back[0][2:4].tolist() == [0.5, 1.0] and back[2].tolist() == [0.0] * 8 and back[0][0] > 100_000
    wide = vector_codes.compress_vectors(df, vector_codes.VectorCodeSettings(entries=1, rounds=1))[0].agg(F.sum("error").alias("e")).first()["e"]
    assert wide is None or wide > 0


def test_dictionaries_hold_each_distinct_integer_once():
    vectors = np.array([[5, -1], [5, 2], [-3, 2], [5, 2]])
    values, codes = vector_codes.encode_block(vectors)
    assert [v.tolist() for v in values] == [[-3, 5], [-1, 2]] and codes.tolist() == [[1, 0], [1, 1], [0, 1], [1, 1]]
    best, apart = vector_codes.nearest(values, codes, np.array([[5, 2], [-3, 2], [5, 2]]), range(2))
    assert best.tolist() == [0, 0, 1, 0] and apart.tolist() == [9, 0, 0, 0]


def test_no_vectors(spark, as_table):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert QUERIES["op12_vector_codes"](spark, as_table(embeddings=df)).count() == 0


# --- 13 MinHash near-dedup --------------------------------------------------------------------------------


def plain_sets(text, n=2):
    low = b"".join(bytes([c + 32]) if 65 <= c <= 90 else bytes([c]) for c in (text or "").encode())
    w = low.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows):
    """(doc_id, n_shingles, component_id, kept) of each row: all pairs compared."""
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    name = {r: min((d for d in of if d is not None), default=None) for r, of in ids.items()}
    return [(d, len(s), name[find(i)], d is not None and d == name[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_texts(seed, groups=25, copies=6, words=(3, 60)):
    rng = random.Random(seed)
    vocabulary = [f"V{i}" for i in range(3000)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(copies):
            near = [*base]
            for _ in range(rng.randint(0, max(1, len(near) // 12))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near[: len(near) - rng.randint(0, 1 + len(near) // 6)]))
    rng.shuffle(texts)
    return texts


def test_minhash_query(spark, docs, as_table):
    rows = QUERIES["op13_minhash_dedup"](spark, as_table(documents=docs)).collect()
    assert Counter(map(tuple, rows)) == Counter(plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize(("seed", "tile"), [(1, 512), (2, 4), (3, 9)])
def test_minhash_equals_brute_force(spark, monkeypatch, seed, tile):
    """Many pairs on both sides of the threshold; small tiles let a group meet in many tasks."""
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    monkeypatch.setattr(minhash_dedup, "SET_TILE", tile)
    rows = list(enumerate(near_texts(seed)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(rows)
    assert Counter(map(tuple, got)) == Counter(want) and 30 < len({r[2] for r in want}) < 145


def test_a_hot_group_of_near_copies(spark, monkeypatch):
    """A chain in which each text is similar to its neighbours only, and a crowd of which nearly all are similar: the forests leave pairs open."""
    monkeypatch.setattr(minhash_dedup, "TILE", 16)
    monkeypatch.setattr(minhash_dedup, "SET_TILE", 8)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(130)]
    rows = [(i, " ".join(base[i * 4 : i * 4 + 60])) for i in range(17)]
    crowd = [f"c{rng.randrange(10**6)}" for _ in range(40)]
    for i in range(90):
        near = [*crowd]
        for _ in range(rng.randint(1, 6)):
            near[rng.randrange(40)] = f"z{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(near)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(rows)
    assert Counter(map(tuple, got)) == Counter(want) and len({r[2] for r in want}) > 2


def test_open_pairs_are_settled_by_full_sets(spark):
    """Two components which the first pass left apart, though one pair across them is similar."""
    settings = minhash_dedup.MinHashSettings()
    texts = near_texts(5, groups=4, copies=8, words=(30, 60))
    marks = minhash_dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), settings, key_col="node").collect()
    sets = {r["node"]: sorted(int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in minhash_dedup.shingle_sets([texts[r["node"]].encode()], 2)[0]) for r in marks}
    rows = [(k, band, r["node"], r["n"], bytes(r["places"]), r["node"], sets[r["node"]], 2) for r in marks for band, k in enumerate(r["keys"])]
    held = spark.createDataFrame(rows, "k long, band int, node long, n long, places binary, label long, shingles array<long>, tiles int")
    links = {(r["u"], r["v"]) for r in minhash_dedup.confirmed_in_tiles(held, settings).collect()}
    want = plain_components(list(enumerate(texts)))
    label = list(range(len(texts)))
    for u, v in links:
        assert len(set(sets[u]) & set(sets[v])) * 9 >= (len(sets[u]) + len(sets[v])) * 4
        low, high = sorted((label[u], label[v]))
        label = [low if x == high else x for x in label]
    assert label == [r[2] for r in want]
    opened = {r["node"] for r in minhash_dedup.open_nodes(held.drop("shingles"), settings).collect()}
    assert {n for link in links for n in link} <= opened


def scalar_signature(elements, places):
    """SuperMinHash one element and one step at a time, with no early stop."""
    mask = (1 << 64) - 1
    mix = lambda x: int(minhash_dedup.W.mix(np.array([x], np.uint64))[0])
    out = [mask] * places
    for e in elements:
        order = list(range(places))
        for j in range(places):
            x = mix(int(e) + minhash_dedup._STEP * (j + 1) & mask)
            k = j + ((x >> 32) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 56 | mix(x ^ int(minhash_dedup._DRAW)) >> 8)
    return out


def test_super_minhash_stops_early_without_a_difference(monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 5, 40, 300, 0, 3])
    elements = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    got = minhash_dedup.super_minhash(elements, counts, 16)
    starts = np.concatenate(([0], np.cumsum(counts)))
    for i, n in enumerate(counts):
        assert got[i].tolist() == (scalar_signature(elements[starts[i] : starts[i + 1]], 16) if n else [(1 << 64) - 1] * 16)
    monkeypatch.setattr(minhash_dedup, "ELEMENTS", 13)
    assert (minhash_dedup.super_minhash(elements, counts, 16) == got).all()


def test_super_minhash_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(4)
    places, errors = 128, []
    for _ in range(150):
        both, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        sig = minhash_dedup.super_minhash(np.concatenate((both, own[:10], both, own[10:])), np.array([90, 90]), places)
        errors.append((sig[0] == sig[1]).mean() - 0.8)
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.01 and (errors**2).mean() < 0.16 / places


def test_minhash_empty_and_wordless(spark, no_docs):
    assert minhash_dedup.near_duplicates(no_docs).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (None, None)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, False)])


def test_pairs_meet_at_the_first_band_that_their_places_share(spark):
    """A pair is compared at its first equal band only, so bands of equal bytes must have one key."""
    rng = random.Random(11)
    texts = []
    for _ in range(1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:55], *(f"z{rng.randrange(10**6)}" for _ in range(5))])]
    settings = minhash_dedup.MinHashSettings()
    marks = sorted(minhash_dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), settings).collect(), key=lambda r: r["doc_id"])
    places = np.frombuffer(b"".join(r["places"] for r in marks), np.uint8).reshape(len(marks), settings.bands, settings.rows)
    keys = np.array([r["keys"] for r in marks])
    equal = (places[::2] == places[1::2]).all(axis=2)
    assert equal.any(axis=1).all() and (keys[::2] == keys[1::2])[equal].all()


def test_pairs_of_later_tiles_are_met(spark, monkeypatch):
    """One band of one place: unlike nodes share keys, and tiles of one node are many."""
    monkeypatch.setattr(minhash_dedup, "TILE", 1)
    monkeypatch.setattr(minhash_dedup, "SET_TILE", 1)
    settings = minhash_dedup.MinHashSettings(bands=1, rows=1, least_places=0)
    texts = near_texts(12, groups=150, copies=2, words=(20, 40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {r["doc_id"]: r["keys"][0] for r in minhash_dedup.signatures(df, settings).collect()}
    sets = [plain_sets(t) for t in texts]
    similar = [(i, j) for i, a in enumerate(sets) for j in range(i) if key[i] == key[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, settings).collect()}
    assert len(similar) > 20 and [(i, j) for i, j in similar if got[i] != got[j]] == []
