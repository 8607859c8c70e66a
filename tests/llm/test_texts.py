import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumisift.llm import chat, ctw, graph, langid, line_dedup, registry, shared, simhash_dedup, substring_dedup, warc
from lumisift.llm import words as W

from .conftest import WORDS, prose

QUERIES = registry.queries()


# --- shared helper ------------------------------------------------------------------------------------


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 64)
    texts = [b"", b"  a bb\tccc\x0b a ", b"x" * 300 + b" y " * 200, b"a", b"\xc2\xa0 \x1c"]
    hashes, counts = W.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_spans_don_t_depend_on_place():
    hashes, _ = W.word_hashes([b"a b c d a b c e"])
    sums = W.run_sums(hashes)
    at = W.span(sums, np.array([0, 4, 1, 0]), np.array([3, 7, 4, 2]))
    assert at[0] == at[1] and len(set(at.tolist())) == 3


def test_vote_counts():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 700, 0, 1])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2)
    want = np.zeros((5, 64), int)
    at = 0
    for i, n in enumerate(counts):
        for h in hashes[at : at + n]:
            want[i] += [int(h) >> b & 1 for b in range(64)]
        at += n
    assert (W.vote_counts(hashes, counts) == want).all()


def test_even_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": ["a" * 1000] * 100})
    parts = list(W.even_batches(iter([batch, batch.slice(0, 0)]), 10_000))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 10 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_tables_are_released(spark):
    import os

    one, two = (shared.materialize(spark.range(n), "released") for n in (3, 4))
    files = [df.inputFiles()[0].removeprefix("file://") for df in (one, two)]
    shared.release(one)
    assert [os.path.exists(f) for f in files] == [False, True] and two.count() == 4
    shared.release(two.select("id"))  # not a table of its own
    assert os.path.exists(files[1]) and shared.release_all(spark) >= 1 and not os.path.exists(files[1])


# --- 1 language ID ------------------------------------------------------------------------------------


def test_language_query(spark, docs, as_table):
    rows = QUERIES["op1_language_id"](spark, as_table(documents=docs)).collect()
    assert len(rows) == docs.count()
    texts = {(r["doc_id"], (r["text"] or "")[:20]): r for r in docs.collect()}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {*WORDS, "und"}
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    blank = {r["doc_id"] for r in texts.values() if r["text"] is None or not any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} <= blank


def plain_language(text, model, settings):
    """Language, score, margin: every block after the carrier, one fresh compressor each."""
    import math

    import regex
    import zstandard as zstd

    clean = " ".join(regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())).encode("utf-8", "replace")
    if not clean or not model:
        return "und", 0.0, 0.0
    sizes = {}
    for lang, content in sorted(model.items()):
        cut = min(settings.carrier_bytes, len(content) // 4)
        carrier, rest = content[:cut] + b" ", content[cut:]

        def packed(data, rest=rest):
            params = zstd.ZstdCompressionParameters.from_level(
                settings.level, source_size=settings.block_bytes + settings.carrier_bytes, dict_size=len(rest), format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            made = zstd.ZstdCompressionDict(rest, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=params)
            return len(zstd.ZstdCompressor(dict_data=made, compression_params=params).compress(data))

        alone = packed(carrier)
        sizes[lang] = sum(max(1, packed(carrier + clean[i : i + settings.block_bytes]) - alone) for i in range(0, len(clean), settings.block_bytes))
    best = min(sizes, key=lambda x: (sizes[x], x))
    others = [n for lang, n in sizes.items() if lang != best]
    if not others:
        return best, 1.0, 1.0
    return best, 1 / (1 + sum(math.exp(-(n - sizes[best]) / 2) for n in others)), (min(others) - sizes[best]) / min(others)


def test_language_query_and_stage_equal_brute_force(spark, docs, as_table):
    """Every row of the query and every decision of the stage against plain loops; the dictionaries come from the allowed rows alone."""
    settings, plain = langid.LangIdSettings(), docs.select("doc_id", "text", "lang").collect()
    folds = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in plain if r["doc_id"] is not None}
    allowed = docs.filter(F.col("doc_id").isin([d for d, f in folds.items() if f != 2]))
    model = langid.fit(allowed)
    want = Counter((r["doc_id"], *plain_language(r["text"], model, settings)) for r in plain)
    got = Counter((r["doc_id"], r["lang_pred"], r["score"], r["margin"]) for r in QUERIES["op1_language_id"](spark, as_table(documents=docs)).collect())
    close = lambda rows: sorted((str(d), lang, round(score, 9), round(margin, 9), n) for (d, lang, score, margin), n in rows.items())
    assert close(got) == close(want)
    whole = langid.fit(docs)
    judged = [(r, plain_language(r["text"], whole, settings)) for r in plain]
    kept = Counter((r["doc_id"], r["text"]) for r, (lang, _, margin) in judged if lang != "und" and margin >= settings.min_margin)
    assert Counter((r["doc_id"], r["text"]) for r in langid.accept_known(docs).collect()) == kept and 0 < len(kept) < len(plain)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, rng.randint(4, 200)), lang) for i, lang in enumerate(list(WORDS) * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df.filter("doc_id % 2 = 0"))).filter("doc_id % 2 = 1")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count() and got.filter("lang_rejected").count() <= 0.05 * got.count()


def test_no_labels_and_empty(docs, no_docs):
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.accept_known(no_docs).count() == 0 and langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert langid.accept_known(docs).columns == docs.columns


# --- 2 chat -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "\\", "\\<|", "<\\|im_start|>", "<", "|x", "a\\n\nb", "<|image|>", "<<||", "\\\\<|a|>"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text) and chat.unescape_role(chat.escape_role(text)) == text


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|> "}, {"type": "image", "uri": "i.png", "width": 28, "height": 15}, {"type": "audio", "uri": "a", "seconds": 2.0}, None, {"type": "document", "uri": None, "pages": 3}, {"type": "text", "text": None}]
    out = chat.format_turns([{"role": "user", "parts": parts}, {"role": "assistant", "parts": [{"type": "text", "text": "ok"}]}])
    assert [a["kind"] for a in out["attachments"]] == ["image", "audio", "document"] and [a["tokens"] for a in out["attachments"]] == [4, 25, 1536] and out["expanded_tokens"] == 1565
    for a in out["attachments"]:
        assert out["formatted"][a["offset"] :].startswith(f"<|{a['kind']}|>") and a["turn"] == 0
    assert chat.parse(out["formatted"]) == [("user", "see <|im_end|> "), ("assistant", "ok")] and chat.masked_text(out["formatted"], out["loss_spans"]) == "ok"


def test_chat_query_on_awkward_turns(spark, as_table):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\b<|im_end|>"), (1, 1, "assistant", "a\\b<|im_end|>"), (2, 5, None, "x"), (None, 0, "assistant", "é\U0001f600"), (3, None, "assistant", ""), (4, 0, "as\nsistant<|", "t")]
    folder = as_table(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)))
    got = {r["conv_id"]: r for r in QUERIES["op2_format_chats"](spark, folder).collect()}
    want = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert QUERIES["op2_format_chats"](spark, folder).columns[:2] == ["conv_id", "n_turns"]


def test_turn_rows_join_to_conversations(spark):
    """A conversation of many Arrow batches, read back turn by turn and whole, among short ones."""
    rows = [(1, i, "assistant" if i % 2 else "user", [("text", f"<|t{i}|>", None, None, None, None, None), ("image", None, f"u{i}", 14, 14, None, None)]) for i in range(25_000)]
    rows += [(c, i, "assistant", [("text", f"{c}", None, None, None, None, None)]) for c in (0, 2, None) for i in range(3)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").repartition(4)
    each, whole = chat.format_each_turn(turns), chat.format_chats(turns)
    assert sorted(map(repr, chat.read_back(each).collect())) == sorted(map(repr, chat.read_back(whole).collect()))
    found = {r["conv_id"]: r for r in whole.collect()}
    assert {c: r["n_turns"] for c, r in found.items()} == {0: 3, 1: 25_000, 2: 3, None: 3}
    made = chat.format_turns([{"role": r, "parts": [dict(zip(("type", "text", "uri", "width", "height"), p, strict=False)) for p in parts]} for c, _, r, parts in rows if c == 1])
    assert found[1]["formatted"] == made["formatted"] and [(x["start"], x["end"]) for x in found[1]["loss_spans"]] == [(x["start"], x["end"]) for x in made["loss_spans"]]
    assert [x["offset"] for x in found[1]["attachments"]] == [x["offset"] for x in made["attachments"]] and found[1]["expanded_tokens"] == made["expanded_tokens"] == 25_000


def test_no_conversations(spark):
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.read_back(chat.format_chats(empty)).count() == 0


# --- 3 context-tree weighting -------------------------------------------------------------------------


def brute_ctw(training, texts, depth):
    """Block probabilities in exact terms: counts in dictionaries, weights by recursion."""
    import math

    counts = defaultdict(lambda: [0, 0])
    for t in training:
        s = b"\n" * depth + ctw.stream(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for k in range(8):
                    counts[d, s[i - d : i], 1 << k | s[i] >> 8 - k][s[i] >> 7 - k & 1] += 1
    kept = dict(counts)
    kids = defaultdict(list)
    for d, c, p in kept:
        if d:
            kids[d - 1, c[1:], p].append((d, c, p))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    alpha = {}

    def weight(n):
        a, b = kept[n]
        own = kt(a, b)
        if not kids[n]:
            alpha[n] = 1.0
            return own
        under = sum(weight(k) for k in kids[n])
        both = max(own, under) + math.log(0.5 * math.exp(own - max(own, under)) + 0.5 * math.exp(under - max(own, under)))
        alpha[n] = 0.5 * math.exp(own - both)
        return both

    for n in [n for n in kept if n[0] == 0]:
        weight(n)
    out = []
    for t in texts:
        s, total = b"\n" * depth + ctw.stream(t), 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                p, sure, left = 0.5, 0.0, 1.0
                for d in range(depth + 1):
                    n = (d, s[i - d : i], 1 << k | s[i] >> 8 - k)
                    if n not in kept:
                        break
                    own = (kept[n][1] + 0.5) / (sum(kept[n]) + 1)
                    p, sure, left = sure + left * own, sure + left * alpha[n] * own, left * (1 - alpha[n])
                total += math.log10(p if s[i] >> 7 - k & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("depth", [1, 3, 5, 6])
def test_ctw_equals_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(ctw, "_BUCKET", 50)
    monkeypatch.setattr(ctw, "_GROUP", 400)
    rng = random.Random(8)
    training = [prose(rng, "en", 60) for _ in range(6)]
    texts = [training[0][:200], prose(rng, "en", 20), "Zürich \U0001f600", None, ""]
    rows = [(i, False, False, t) for i, t in enumerate(texts)] + [(100 + i, False, True, t) for i, t in enumerate(training)]
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, learn boolean, text string").repartition(3)
    got = {r["doc_id"]: r for r in ctw.score(df, ctw.CtwSettings(depth=depth)).collect()}
    want = brute_ctw([t.encode() for t in training], [(t or "").encode() for t in texts], depth)
    for i, w in enumerate(want):
        assert got[i]["score"] == pytest.approx(w, rel=1e-7)


def test_scores_stay_finite_at_large_counts(spark):
    runs = spark.createDataFrame([(int.from_bytes(b"abcdee"), 3 * 10**12), (int.from_bytes(b"abcde\x00"), 0), (int.from_bytes(b"zzzzz\xff"), 0), (int.from_bytes(b"bcdeee"), 1)], "key long, n long")
    logs = {r["key"]: r["v"] for r in ctw.run_log_table(runs, ctw.CtwSettings()).collect()}
    assert all(np.isfinite(v) and v <= 0 for v in logs.values())
    assert logs[int.from_bytes(b"abcdee")] > -1e-9 and -60 < logs[int.from_bytes(b"abcde\x00")] < -11


def test_score_query(spark, docs, as_table):
    import math

    rows = QUERIES["op3_ctw_scores"](spark, as_table(documents=docs)).collect()
    source = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    learn = [w for d, w in source if d is not None and zlib.crc32(str(d).encode()) % 10]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()) + len(learn), len(c) + 1
    log = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter((d, len(w) + 1, sum(1 for x in w if c[x]) + 1, n, round(sum(log(c[x]) for x in w) + log(len(learn)), 5)) for d, w in source)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_score_without_training(docs):
    rows = docs.select("doc_id", F.lit(True).alias("held_out"), F.lit(False).alias("learn"), "text")
    got = ctw.score(rows).collect()
    assert len(got) == docs.count() and all(r["n_known"] == 0 and r["score"] == pytest.approx(-8 * r["n_bytes"] * 0.30103, rel=1e-4) for r in got)
    assert ctw.score(rows.limit(0)).count() == 0


# --- 4 WARC -------------------------------------------------------------------------------------------


def test_warc_query(spark, as_table, duck):
    body = "<p>" + "ä" * 200
    rows = [(5, "u5", body), (3, "u3", body), (9, "u9", body), (1, None, "short"), (2, "a\r\nb", "short"), (4, "", None), (6, "u", ""), (None, "n", body), (7, "u7", "HTTP/1.1\r\n\r\nWARC/1.1\r\n" + "z" * 300), (3, "u3", body), (8, "big", "y" * 3_000_000)]
    folder = as_table(pages=spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in QUERIES["op4_warc_round_trip"](spark, folder).collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == body and page is not None and page != 3
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want


def test_normaliser_makes_members(spark, tmp_path):
    import gzip
    import json

    rows = [(i, f"u{i}", ("x%d " % i) * 50, "d", None) for i in range(40)]
    records = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to long").withColumn("digest", F.sha2("html", 256)).coalesce(1)
    one = warc.write_archives(records, f"file://{tmp_path}/mono", limit=3000)
    assert one.count() > 1
    index = warc.normalise(one, f"file://{tmp_path}/members")
    for r in index.collect():
        raw = open(r["path"], "rb").read()
        entries = [json.loads(x) for x in open(r["index_path"])]
        assert len(entries) == r["records"] and sum(e["length"] for e in entries) == len(raw)
        for e in entries:
            member = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and e["id"].encode() in member
    pages = warc.read_archives(index, f"file://{tmp_path}/members", with_payload=True).collect()
    assert {(r["page_id"], r["payload"].decode()) for r in pages} == {(r[0], r[2]) for r in rows}


def test_no_pages(spark, as_table):
    assert QUERIES["op4_warc_round_trip"](spark, as_table(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# --- 6 line dedup -------------------------------------------------------------------------------------


def cut(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.drop_aligned_lines(df, **limits).collect()}


LINES = [" ".join(f"word{i}x{j}" for j in range(9)) for i in range(400)]


def test_aligned_blocks_leave_the_later_document(spark):
    a = "\n".join([LINES[0], "", LINES[1], "short", LINES[2]])
    b = "\n".join([LINES[10], LINES[1], "", "short", LINES[2], "own"])
    c = "\n".join([LINES[2], LINES[20], LINES[1], "short"])
    rows = [(1, a), (2, b), (3, c), (4, None), (5, "")]
    got = cut(spark, rows)
    assert got[1] == (a, 0) and got[2] == (f"{LINES[10]}\nown", 4) and got[3] == (LINES[20], 3) and got[4] == (None, 0) and got[5] == ("", 0)
    assert cut(spark, rows, moved=False)[3] == (f"{LINES[2]}\n{LINES[20]}", 2)  # out of order: the longer block aligns


@pytest.mark.parametrize("copies", [2, 100, 101, 130])
def test_deletion_does_not_depend_on_the_number_of_copies(spark, copies):
    one = [(i, f"{LINES[300]}\n{LINES[i]}") for i in range(copies)]
    got = cut(spark, one)
    assert got[0][1] == 0 and all(got[i] == (LINES[i], 1) for i in range(1, copies))
    whole = cut(spark, [(i, "\n".join(LINES[:3])) for i in range(copies)] + [(900 + i, "a\nb c") for i in range(copies)])
    assert sum(n for _, n in whole.values()) == 5 * (copies - 1) and whole[900] == ("a\nb c", 0) and whole[901] == ("", 2)


def test_a_block_whose_lines_were_first_seen_apart(spark):
    lines = ["one two three four five", "six seven eight nine ten", "eleven twelve thirteen fourteen"]
    rows = [(i, f"{line}\n{LINES[i]}") for i, line in enumerate(lines)] + [(10 + i, "\n".join([LINES[10 + i], *lines, LINES[30 + i]])) for i in range(6)]
    got = cut(spark, rows)
    assert all(got[i][1] == 0 for i in (0, 1, 2, 10)) and all(got[10 + i] == (f"{LINES[10 + i]}\n{LINES[30 + i]}", 3) for i in range(1, 6))


def brute_aligned(texts, least):
    """All pairs of documents: a line goes if a block of enough bytes around it stands in an earlier one."""
    docs = [[b" ".join(x.split()) for x in (t or "").encode().split(b"\n") if x.split()] for t in texts]
    runs = [{(tuple(d[i:j])) for i in range(len(d)) for j in range(i + 1, len(d) + 1)} for d in docs]
    out = []
    for k, d in enumerate(docs):
        gone = set()
        for i in range(len(d)):
            for j in range(i + 1, len(d) + 1):
                if sum(map(len, d[i:j])) >= least and any(tuple(d[i:j]) in r for r in runs[:k]):
                    gone |= set(range(i, j))
        if sum(map(len, d)) < least and d in docs[:k]:
            gone = set(range(len(d)))
        out.append([x.decode() for i, x in enumerate(d) if i not in gone])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"v{rng.randrange(99)}" for _ in range(rng.randint(1, 8))) for _ in range(14)] + ["", "  "]
    texts = [None, *("\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(60))]
    got = cut(spark, list(enumerate(texts)), least_bytes=25)
    for i, want in enumerate(brute_aligned(texts, 25)):
        assert [" ".join(x.split()) for x in (got[i][0] or "").split("\n") if x.split()] == want


def test_patience_pairs():
    """Equal lines, rising in both; of lines that occur once, as many as any alignment has; anchors split what repeats."""
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = line_dedup.patience_pairs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    for _ in range(100):
        a, b = (rng.sample(range(14), rng.randrange(12)) for _ in range(2))
        at = {x: j for j, x in enumerate(b)}
        best = [0] * (len(a) + 1)
        for i in reversed(range(len(a))):
            best[i] = 0 if a[i] not in at else 1 + max((best[k] for k in range(i + 1, len(a)) if a[k] in at and at[a[k]] > at[a[i]]), default=0)
        assert len(line_dedup.patience_pairs(a, b)) == max(best)
    assert line_dedup.patience_pairs("x{y{z}w}", "x{q{z}w}") == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_nothing_goes_but_by_alignment(monkeypatch):
    ours, sizes, seeds = list("abcde"), [70] * 5, [(i, i, i) for i in range(5)]
    assert line_dedup.aligned_lines(ours, ours, sizes, seeds, 60) == {0, 1, 2, 3, 4}
    assert line_dedup.aligned_lines(ours, list("edcba"), sizes, [(i, i, 4 - i) for i in range(5)], 60, moved=False) == {4}  # one of five: the last of equally long runs
    assert line_dedup.aligned_lines(ours, list("edcba"), sizes, [(i, i, 4 - i) for i in range(5)], 60) == {0, 1, 2, 3, 4}
    monkeypatch.setattr(line_dedup, "patience_pairs", lambda a, b: [])
    assert line_dedup.aligned_lines(ours, ours, sizes, seeds, 60) == set()


def test_without_moves_what_rises_in_both_goes(spark):
    """Later texts are earlier ones in another order: of each, a longest rising run goes and the rest stays."""
    rng = random.Random(12)
    rows, want = [], {}
    for n in range(30):
        base = LINES[n * 12 : n * 12 + rng.randint(2, 12)]
        order = rng.sample(range(len(base)), len(base))
        if n % 2:  # one cut moved to the front
            turn = rng.randrange(len(base))
            order = [*range(turn, len(base)), *range(turn)]
        best = [1] * len(order)
        for i in range(len(order)):
            best[i] += max((best[k] for k in range(i) if order[k] < order[i]), default=0)
        rows += [(n, "\n".join(base)), (100 + n, "\n".join(base[i] for i in order))]
        want[100 + n] = max(best)
    got = cut(spark, rows, moved=False)
    assert all(got[k][1] == n for k, n in want.items()) and all(got[k][1] == 0 for k in range(30))
    for n in range(30):
        gone = [x for x in rows[2 * n + 1][1].split("\n") if x not in (got[100 + n][0] or "").split("\n")]
        at = [rows[2 * n][1].split("\n").index(x) for x in gone]
        assert at == sorted(at)


def test_line_dedup_on_awkward_rows(docs, no_docs):
    out = line_dedup.drop_aligned_lines(docs)
    assert out.count() == docs.count() and line_dedup.drop_aligned_lines(no_docs).count() == 0
    assert line_dedup.keep_unaligned(docs).columns == docs.columns


def test_longest_rising():
    rng = random.Random(0)
    for _ in range(50):
        values = [rng.randrange(12) for _ in range(rng.randrange(12))]
        best = max((len(s) for m in range(1 << len(values)) for s in [[v for i, v in enumerate(values) if m >> i & 1]] if all(a < b for a, b in zip(s, s[1:], strict=False))), default=0)
        got = [values[i] for i in line_dedup.longest_rising(values)]
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:], strict=False))


# --- 7 substring dedup --------------------------------------------------------------------------------


def brute_repeats(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substring_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6 if seed == 2 else 500)]
    pool = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    texts = [" ".join(x for _ in range(rng.randint(0, 5)) for x in rng.choice(pool)[rng.randint(0, 4) :]) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.drop_repeats(df, window=12, seed_words=4).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 12)


def test_substring_query(spark, docs, as_table):
    rows = QUERIES["op7_substring_dedup"](spark, as_table(documents=docs)).collect()
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (d, _), (n, gone, kept) in zip(source, brute_repeats([t for _, t in source], 35), strict=True))
    assert Counter(map(tuple, rows)) == want


def test_maximal_repeats_are_objects(spark):
    """Stretches as long as they repeat, told by their words; two that overlap stay two."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    a, b = words[:40], words[40:70]
    own = iter(words[100:])
    fill = lambda n: [next(own) for _ in range(n)]
    texts = [fill(5) + a + fill(3), a + fill(9) + b, fill(2) + b, fill(30), a[10:] + b[:12], fill(1) + a[25:] + b]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["begin"], r["n_words"]): r for r in substring_dedup.maximal_repeats(df, window=12, seed_words=4).collect()}
    count = Counter(tuple(t[i : i + 12]) for t in texts for i in range(len(t) - 11))
    want = {}
    for d, t in enumerate(texts):
        again = [count[tuple(t[i : i + 12])] > 1 for i in range(len(t) - 11)]
        for i, hit in enumerate(again):
            if hit and (i == 0 or not again[i - 1]):
                end = next((j for j in range(i, len(again)) if not again[j]), len(again))
                want[d, i, end - i + 11] = tuple(t[i : end + 11])
    assert set(got) == set(want) and len(want) == 6
    of = Counter(want.values())
    assert all(r["places"] == of[want[k]] for k, r in got.items())
    assert all((got[k]["h0"], got[k]["h1"]) == (got[m]["h0"], got[m]["h1"]) or want[k] != want[m] for k in got for m in got)
    assert substring_dedup.maximal_repeats(df.limit(0)).count() == 0


def test_no_texts(no_docs):
    assert substring_dedup.drop_repeats(no_docs).count() == 0


# --- 9 SimHash near-dedup -----------------------------------------------------------------------------


def brute_components(fps, radius=2):
    nodes = list(fps)
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash_query(spark, docs, as_table):
    rows = QUERIES["op9_simhash_dedup"](spark, as_table(documents=docs)).collect()
    fps = {}
    for r in docs.collect():
        words = (r["text"] or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.setdefault(r["doc_id"], set()).add(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    assert len(rows) == docs.count()
    for r in rows:
        assert int(r["fingerprint"], 16) in fps[r["doc_id"]] and len(r["fingerprint"]) == 16
    # Components of all fingerprints, each named by the smallest id that its rows have.
    root = brute_components({f: f for f in {int(r["fingerprint"], 16) for r in rows}})
    name = {}
    for r in rows:
        name.setdefault(root[int(r["fingerprint"], 16)], []).append(r["doc_id"])
    for r in rows:
        of = [d for d in name[root[int(r["fingerprint"], 16)]] if d is not None]
        assert r["component_id"] == min(of, default=None)
    assert len(name) > 20 and any(len(v) > 2 for v in name.values())


@pytest.mark.parametrize("tile", [4096, 8])
def test_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = random.Random(7)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = {i: rng.choice(centers) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for i in range(300)} | {1000: 0, 1001: 1, 1002: 0}
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.components(df).collect()}
    assert got == brute_components(fps)


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 0), (4, 48)])
def test_links_within(words, radius):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, (130, words), dtype=np.uint64)
    fps[60:] = fps[:70] ^ (np.uint64(1) << rng.integers(0, 63, (70, words), dtype=np.uint64))
    q, k = simhash_dedup.links_within(fps, fps, radius, later=np.arange(1, 131))
    distance = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))
    assert set(zip(q.tolist(), k.tolist(), strict=True)) == {(i, j) for i in range(130) for j in range(i + 1, 130) if distance(fps[i], fps[j]) <= radius}


def test_graph(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (7, None), (102, 100)]
    got = {r["node"]: r["label"] for r in graph.smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.smallest_reachable(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_random_graphs(spark):
    """Sparse and dense graphs, stars with a large and a small centre, a long path in mixed order; then joined by further edges."""
    rng = random.Random(14)
    path = rng.sample(range(5000, 5200), 200)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1000 + j) for i in range(25) for j in range(i)] + [(2000 + i, 2999) for i in range(60)] + [(3000, 3001 + i) for i in range(60)] + list(zip(path, path[1:], strict=False))
    further = [(1000, 2030), (3050, 9000), (9001, 9002), (5, 5), (299, 7000)]

    def roots(edges):
        label = {}

        def find(x):
            while label.setdefault(x, x) != x:
                x = label[x]
            return x

        for u, v in edges:
            if u != v:
                a, b = sorted((find(u), find(v)))
                label[b] = a
        return {x: find(x) for x in label}

    labels = graph.smallest_reachable(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["label"] for r in labels.collect()} == roots(edges)
    more = graph.joined_further(labels, spark.createDataFrame(further, "u long, v long"))
    assert {r["node"]: r["label"] for r in more.collect()} == roots(edges + further) and more.count() == len(roots(edges + further))
    assert graph.joined_further(labels, spark.createDataFrame([], "u long, v long")).count() == labels.count()


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(3)
    base = [prose(rng, "en", 300).split() for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:15]):
        near = [*w]
        near[150] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(200, " ".join(base[20])), (201, None), (202, ""), (203, " ".join(base[21])), (203, " ".join(base[21]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    kept = simhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(30), 201]
    assert simhash_dedup.drop_near_duplicates(df.limit(0)).count() == 0


def brute_groups(texts):
    """Smallest index of each text's group: sets of five-word shingles, all pairs compared, joined at 0.8."""
    words = [(t or "").lower().encode().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(texts)))
    similarity = {}
    for i in range(len(texts)):
        for j in range(i):
            inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            similarity[j, i] = 1.0 if not union else inter / union
            if inter * 5 >= union * 4:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, similarity


@pytest.mark.parametrize("words", [12, 60, 400])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(words)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(words // 2, words))]
        texts.append(" ".join(base))
        for _ in range(3):
            near = [*base]
            for _ in range(rng.randint(0, max(1, len(near) // 25))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near if rng.random() < 0.5 else base[: len(base) - rng.randint(1, 1 + len(base) // 4)]))
    label, similarity = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(df).collect()}
    want = set(label)
    assert want <= kept  # nothing goes without a similar document
    recall = 1 - len(kept - want) / (len(texts) - len(want))
    assert recall >= 0.99
    assert sum(1 for x in similarity.values() if 0.8 <= x < 1) > 20 and sum(1 for x in similarity.values() if 0.6 < x < 0.8) > 20


def test_a_fingerprint_of_null_ids_is_a_bridge(spark):
    rows = [(1, 0), (None, 3), (2, 15), (None, 1 << 40 | 1 << 50 | 1 << 60), (7, 0x7F00)]
    got = simhash_dedup.components(spark.createDataFrame(rows, "doc_id long, fp long"), radius=2).collect()
    assert {(r["fp"], r["component_id"]) for r in got} == {(0, 1), (3, 1), (15, 1), (rows[3][1], None), (0x7F00, 7)}


def test_spanning_pairs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b, w = rng.integers(0, 12, 30), rng.integers(0, 12, 30), rng.integers(0, 9, 30)
        total, label = 0, np.arange(12)
        for i in np.argsort(w, kind="stable"):
            x, y = label[a[i]], label[b[i]]
            if x != y:
                total += w[i]
                label[label == max(x, y)] = min(x, y)
        got = simhash_dedup.spanning_pairs(12, a, b, w)
        assert w[got].sum() == total and (simhash_dedup.forest(12, a[got], b[got]) == simhash_dedup.forest(12, a, b)).all()


def test_a_repeated_passage_votes_once(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(150))
    rows = [(i, " ".join([passage] * 20) + " " + own()) for i in range(12)]  # a Jaccard similarity of 0.17
    same = own()
    rows += [(20, same), (21, same + " " + same)]  # 146 shingles of 150
    kept = simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(12), 20]


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_runs_stage_by_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = after
    whole = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in whole.collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_awkward_documents(spark, docs, as_table):
    folder = as_table(documents=docs, benchmark=spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() > 10
