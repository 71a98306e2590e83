"""Every corpus operator against brute force, round trips or held-out accuracy, and on odd tables."""

import functools
import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shadespark.llm import chat, common, decontaminate, gif, language, minhash_join, mixing, quality, substring_dedup, suffix_dedup, toxicity, training, windows

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
FORM = "doc_id long, text string, lang string, source string, n_chars long, kept string, n int, bucket int, rank int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], FORM)


def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a very long text, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977} word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", None, 7), (5, "one two", "fr", "b", 7), (6, long, "en", "a", 1), (7, "x " * 500, "en", "b", 2), (7, "x " * 500, "en", "b", 2)]
    rows += [(None, "no id here at all in this row", "en", "a", 1), (8, long, "de", "b", 1), (9, "Ünï çødé ñ " * 40, "es", "c", 1), (10, "A b c d e f g h", "en", "a", 1), (11, "a B c D e f g h", "en", "a", 1), (12, "12345 67", "en", "a", 1)]
    return make(spark, rows)


def corpus(spark, seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(25, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            w = rng.choice(rows)[1].split() or ["z"]
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        elif kind < 0.45:
            t = "it " * rng.randint(5, 300)
        else:
            t = " ".join([*rng.choices(vocabulary, k=rng.randint(0, 120)), rng.choice(passages) if rng.random() < 0.5 else "", *rng.choices(vocabulary, k=rng.randint(0, 60))])
        rows.append((i, t))
    return rows


@pytest.fixture
def scattered(spark):
    """Many shuffle partitions that stay apart, as on large tables: small ones would meet in one task, where keys of different types still find each other."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_mixing_meets_targets_on_a_larger_table(spark, scattered):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert len(got) > 5 and all(abs(r["taken"] - r["target"]) <= 1 and r["over"] <= 0 for r in got), got


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_windows(rows, tokens, window, join):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = tokens(t or "")
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                cover[i : i + window] = [True] * window
            seen.add(k)
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out[d] = (len(w), sum(cover), runs, hashlib.sha256(join([x for x, c in zip(w, cover) if not c])).hexdigest())
    return out


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 3)])
def test_substring_and_suffix_dedup_equal_brute_force(spark, seed, hot, monkeypatch, scattered):
    monkeypatch.setattr(windows, "HOT", hot)  # 3: every frequent minimiser is split over buckets
    rows = corpus(spark, seed)
    want = brute_windows(rows, lambda t: t.encode().split(), 20, b" ".join)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.substring_dedup(frame(spark, rows), with_text=False).collect()}
    assert got == {k: (a, b, s) for k, (a, b, _, s) in want.items()}
    want = brute_windows(rows, lambda t: list(t.encode()), 100, bytes)
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("span", [1 << 23, 7])
def test_minimiser_does_not_hang_on_the_slice(span, monkeypatch):
    """Hashes that agree in all but their low bits: a window read alone and in a long slice has the same minimiser."""
    monkeypatch.setattr(common, "kgrams", lambda h, k: h[: len(h) - k + 1])
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 6000, dtype=np.uint64) << np.uint64(40) | rng.integers(0, 1 << 20, 6000, dtype=np.uint64)
    doc = np.repeat([0, 1], [3500, 2500])
    monkeypatch.setattr(windows, "SPAN", span)
    of = {}
    for a, z, key in zip(*windows.runs(h, doc, 20, 6)):
        of |= {w: key for w in range(a, z)}
    assert sorted(of) == [w for w in range(6000 - 19) if doc[w] == doc[w + 19]]
    for w in of:
        alone = windows.runs(h[w : w + 20], doc[w : w + 20], 20, 6)
        assert (alone[0].tolist(), alone[1].tolist(), alone[2].tolist()) == ([0], [1], [of[w]])


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    rows = corpus(spark, 6, 60)
    long = max((t for _, t in rows), key=len)
    other = " ".join(long.split()[5:]) + " and other words at the end"
    # the same row three times, and one doc_id with two texts and a null, each before and behind the others
    rows = [(-1, long + " x"), (-1, long + " x"), (-1, long + " x"), (-2, long), (-2, other), (-2, None), *rows, *rows[:20], (90, other), (90, long)]
    for words in (True, False):
        sha = lambda t: hashlib.sha256(b" ".join((t or "").encode().split()) if words else (t or "").encode()).hexdigest()  # noqa: B023, E731
        one = {}
        for d, t in rows:
            one[d] = min(one.get(d, t), t, key=sha)
        if words:
            want = brute_windows(one.items(), lambda t: t.encode().split(), 20, b" ".join)
            got = {r[0]: tuple(r[1:]) for r in substring_dedup.substring_dedup(frame(spark, rows), with_text=False).collect()}
            assert got == {k: (a, b, s) for k, (a, b, _, s) in want.items()}
        else:
            want = brute_windows(one.items(), lambda t: list(t.encode()), 100, bytes)
            found = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
            assert {r[0]: tuple(r[1:5]) for r in found} == want
            assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found)


def test_kept_text_and_bytes_agree_with_their_digests(spark):
    rows = corpus(spark, 5, 60)
    for r in substring_dedup.substring_dedup(frame(spark, rows)).where("n_removed > 0").collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
    for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_previous_factor_neighbours():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        p = rng.permutation(n)
        before, after = suffix_dedup.smaller_neighbours(p)
        for i in range(n):
            left = [j for j in range(i) if p[j] < p[i]]
            right = [j for j in range(i + 1, n) if p[j] < p[i]]
            assert before[i] == (left[-1] if left else -1) and after[i] == (right[0] if right else -1)


def components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("seed,block,family", [(1, 4096, 1_000_000), (4, 2, 60)])
def test_minhash_equals_brute_force(spark, seed, block, family, monkeypatch, scattered):
    monkeypatch.setattr(minhash_join, "LIST_BLOCK", block)
    monkeypatch.setattr(minhash_join, "FAMILY_BLOCK", family)
    rows = corpus(spark, seed, 160)
    got = {r[0]: tuple(r[1:]) for r in minhash_join.minhash_dedup(frame(spark, rows), 4).collect()}
    assert got == components(rows, 4, 80)


@pytest.mark.parametrize("family", [1_000_000, 300])
def test_minhash_on_a_chain_of_half_similar_documents_and_near_copies(spark, family, monkeypatch):
    """One family: a chain whose neighbours are half similar, a large group of near copies, and copies of chain members that link at the end."""
    monkeypatch.setattr(minhash_join, "LIST_BLOCK", 5)
    monkeypatch.setattr(minhash_join, "FAMILY_BLOCK", family)
    rng = random.Random(8)
    words = [f"c{i}" for i in range(600)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 50])) for i in range(40)]
    rows += [(100 + i, " ".join([*words[12 * i : 12 * i + 50], f"e{i}"])) for i in range(0, 40, 7)]
    for i in range(60):
        w = words[:50] + [f"n{k}" for k in range(40)]
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((200 + i, " ".join(w)))
    got = {r[0]: tuple(r[1:]) for r in minhash_join.minhash_dedup(frame(spark, rows), 4).collect()}
    assert got == components(rows, 4, 80)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 50)))) for i in range(12)] + [(50, None), (51, ""), (52, "short one")]
    rows = [(1000, "short one"), (1001, items[0][1].rsplit(" ", 1)[0])]
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        if i % 2:
            item = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                item[rng.randrange(len(item))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        rows.append((i, " ".join(w).title()))

    def grams(w):
        k = min(5, len(w))
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []

    want = set()
    for d, t in rows:
        g = grams(t.lower().split())
        for i, x in items:
            ref = Counter(grams((x or "").split()))
            n = sum(ref.values())
            if n and g:
                for a in range(max(1, len(g) - n + 1)):
                    mine = Counter(g[a : a + n])
                    both = sum((mine & ref).values())
                    if 100 * both >= 80 * (sum(mine.values()) + n - both):
                        want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], i) for r in decontaminate.decontaminate(frame(spark, rows), bench).collect() for i in r["item_ids"]}
    assert got == want
    assert not {i for _, i in got} & {50, 51}


def test_hamming_blocks_hold_their_guarantee_and_prune():
    """All items within the radius of random and of near fingerprints, against a plain scan; under 5 % of the items are looked at."""
    D, rng = decontaminate, np.random.default_rng(2)
    codes = rng.integers(0, 1 << D.WIDTH, (2000, D.BLOCKS)).astype(np.int32)
    blocks, looked = D.Blocks(codes), []
    for k in range(60):
        code = codes[k].copy()
        for bit in rng.choice(D.BLOCKS * D.WIDTH, min(D.RADIUS + 3, 2 * k), replace=False):
            code[bit // D.WIDTH] ^= 1 << (bit % D.WIDTH)
        plain = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= D.RADIUS)
        assert blocks.near(code).tolist() == plain.tolist() and (k in plain) == (min(D.RADIUS + 3, 2 * k) <= D.RADIUS)
        looked.append(len(blocks.looked_at(code)))
    assert np.mean(looked) < 0.05 * len(codes)


def test_fingerprints_of_similar_windows_are_within_the_radius():
    """Recall at the threshold: windows of similarity just over 0.8, of many lengths; and rolling fingerprints against single ones."""
    D, rng, missed, total = decontaminate, np.random.default_rng(3), 0, 0
    for size in (9, 12, 18, 27, 36, 55):
        for _ in range(60):
            item = rng.integers(1, 2**63, size, dtype=np.uint64)
            other = item.copy()
            some = rng.choice(size, size // 9, replace=False)
            other[some] = rng.integers(1, 2**63, len(some), dtype=np.uint64)
            a, b = (D.simhash(x, np.zeros(1, np.int64), size)[0] for x in (item, other))
            missed, total = missed + (np.bitwise_count(a ^ b).sum() > D.RADIUS), total + 1
    assert missed <= 0.02 * total
    long = rng.integers(1, 2**63, 6000, dtype=np.uint64)
    first = np.concatenate((np.arange(0, 3000), np.arange(3500, 3510), np.arange(5900, 5981)))
    rolling = D.simhash(long, first, 20)
    for k in (0, 1, 2047, 2048, 2999, 3005, len(first) - 1):
        assert (rolling[k] == D.simhash(long[first[k] : first[k] + 20], np.zeros(1, np.int64), 20)[0]).all()


def test_decontamination_in_several_indexes(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect())) == whole


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be ### kind"), (1, 1, "user", "\\h \\b </turn> ### user: x"), (1, 2, "assistant", "a\n### assistant: b</turn>\n\\"), (1, 3, "user", "tail"), (2, 0, "assistant", None), (2, 1, "ro:le", ""), (3, 5, "user", "only"), (None, None, None, None), (4, 1, "assistant", "t"), (4, 1, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.chat_examples(df)
    got = {r["conv_id"]: r for r in chat.chat_digests(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r["trainable"] for r in examples.where("conv_id = 1").orderBy("example").collect()] == [True, False]
    assert chat.chat_digests(chat.chat_examples(df.limit(0))).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    grammar = toxicity.fit_grammar(docs, labels)
    r = toxicity.toxicity_scores(docs, grammar).join(labels, "doc_id").where(common.is_held_out(5, 0)).groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in r}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03


def test_toxicity_recall_in_each_language(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    told = toxicity.toxicity_scores(docs, toxicity.fit_grammar(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where(common.is_held_out(5, 0))
    found = told.groupBy("lang").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("alarms")).where("lang is not null").collect()
    assert len(found) == 4 and all(r["recall"] >= 0.9 and r["alarms"] < 0.03 for r in found), found


def test_composed_grammar_equals_a_plain_reading():
    """Random clauses: the marks of every insult and threat, found by looking at the words around it."""
    T, rng = toxicity, np.random.default_rng(5)
    assert T.GRAMMAR.next.shape[0] > 8  # a product of states
    n = 6000
    kind = rng.choice(6, n, p=[0.5, 0.15, 0.1, 0.1, 0.08, 0.07])
    clause = np.cumsum(rng.random(n) < 0.08)
    place = np.flatnonzero(kind > T.OTHER)
    code, weight = T.marked(kind[place], clause[place], place)
    assert (weight == 1).all()
    for i, c in zip(place.tolist(), code.tolist()):
        want = int(kind[i])
        if kind[i] in (T.INSULT, T.THREAT):
            same = np.flatnonzero(clause == clause[i])
            before, after = [j for j in same if j < i], [j for j in same if j > i]
            want |= T.NEGATED * any(kind[j] == T.NEGATION and i - j <= T.NEGATION_REACH for j in before)
            want |= T.REPORTED * any(kind[j] == T.REPORT for j in before)
            want |= T.BEFORE * any(kind[j] == T.TARGET and i - j <= T.TARGET_REACH for j in before)
            want |= T.AFTER * any(kind[j] == T.TARGET and j - i <= T.TARGET_REACH for j in after)
        assert c == want
    T_ = lambda *x: T.CHANNEL[T.marked(np.array([k for k, _ in x]), np.zeros(len(x), int), np.array([p for _, p in x]))[0]].tolist()
    assert T_((T.INSULT, 0)) == [0] and T_((T.TARGET, 0), (T.INSULT, 2)) == [-1, 1] and T_((T.INSULT, 0), (T.TARGET, 2)) == [1, -1]
    assert T_((T.NEGATION, 0), (T.INSULT, 2)) == [-1, 2] and T_((T.REPORT, 0), (T.INSULT, 6)) == [-1, 3] and T_((T.NEGATION, 0), (T.INSULT, 4)) == [-1, 0]
    assert T_((T.THREAT, 0), (T.TARGET, 1)) == [4, -1] and T_((T.NEGATION, 0), (T.THREAT, 1), (T.TARGET, 2)) == [-1, -1, -1]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language.fit_language(docs)
    r = language.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(common.is_held_out(5, 0))
    assert r.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    code = language.code_matrix(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 10


def test_every_language_is_learned_and_decoding_takes_the_nearest_codeword(spark):
    """Seventy languages, each of its own letters; decoding against a plain sum of losses for each codeword."""
    rng = random.Random(1)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        rows += [(100 * k + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(20)), f"l{k:02}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs)
    assert len(model.languages) == 70
    right = language.identify_language(docs, model).join(docs, "doc_id").where(common.is_held_out(5, 0)).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9
    x = np.random.default_rng(0).normal(size=(5, language.BUCKETS)).astype(np.float32)
    best, share, close = model.decode(x)
    for i in range(5):
        margin = x[i] @ model.weights + model.bias
        loss = [sum(np.log1p(np.exp(-np.clip(m * c, -30, 30))) for m, c in zip(margin, word)) for word in model.code]
        assert loss[best[i]] == pytest.approx(min(loss)) and share[i] == pytest.approx(1 / sum(np.exp(min(loss) - v) for v in loss), rel=1e-3)
        assert close[i] == (share[i] < language.AMBIGUOUS)


def test_labels_that_disagree_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "other 3")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 0), (8, 0), (9, None), (None, 1)], "doc_id long, label int")
    got = {(r["doc_id"], r["text"], r["label"]) for r in training.labelled_sample(docs, labels, 100, 5, 0).collect()}
    known = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 and i != 7}
    assert got == {(i, t, i % 2) for i in known for t in [f"text {i}", *(["other 3"] if i == 3 else [])]}
    assert training.labelled_sample(docs, labels, 3, 5, 0).groupBy("label").agg(F.count_distinct("doc_id").alias("n")).where("n > 3").count() == 0
    rows = [(i, f"t{i}", "aa") for i in range(1, 30)] + [(4, "t4", "bb"), (5, "x5", "bb"), (6, "t6", None), (6, "t6", "aa"), (8, None, "aa")]
    got = {(r["text"], r["label"]) for r in training.own_label_sample(spark.createDataFrame(rows, "doc_id long, text string, label string"), 100, 5, 0).collect()}
    assert got == {(t, lang) for d, t, lang in rows if t and lang and d != 4 and zlib.crc32(str(d).encode()) % 5} | ({("x5", "bb")} if zlib.crc32(b"5") % 5 else set())


def test_word_vectors_and_pooling_equal_plain_sums(spark):
    rows = [(1, "a b c a b"), (2, None), (3, ""), (4, "c  d\ta"), (5, "ü a"), (6, "xy")]
    texts = [(t or "").encode() for _, t in rows]
    index, trigrams = quality._index(quality.SLOTS, 1), quality._index(quality.TRIGRAMS, 3)
    slot = lambda w: int(common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), lower=False)[0] % np.uint64(quality.SLOTS))
    context = np.zeros((quality.SLOTS, quality.SIZE))
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if i != j:
                    context[slot(w[i])] += index[slot(w[j])]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    got = quality.context_vectors(frame(spark, rows))
    assert np.allclose(got, context, atol=1e-6)
    x = quality.pooled(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), got, trigrams)
    for k, t in enumerate(texts):
        v = [context[slot(w)] for w in t.split()]
        n = max(len(v), 1)
        assert np.allclose(x[k, :32], sum(v, np.zeros(32)) / n, atol=1e-5)
        assert np.allclose(x[k, 32:64], sum((a * b for a, b in zip(v, v[1:])), np.zeros(32)) / n, atol=1e-5)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    r = quality.quality_scores(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where(common.is_held_out(4, 2))
    assert r.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95


def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(50, "a"), (1, "a"), (0, "a"), (700, "b"), (3, None), (20, "c"), (9, "d"), (400, "b"), (300, "e")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3)).collect()))
    assert sorted(mixing.permuted(np.arange(77), np.full(77, 77), np.full(77, 5)).tolist()) == list(range(77))


def test_slots_blocks_and_shards_are_drawn_without_loss(spark, monkeypatch):
    one = lambda n: np.full(n, n)
    for n in (1, 2, 5, 77, 1000):
        p = mixing.permuted(np.arange(n), one(n), np.full(n, 5))
        assert sorted(p.tolist()) == list(range(n)) and (mixing.permuted(p, one(n), np.full(n, 5), back=True) == np.arange(n)).all()
    far = np.arange(1000) + 3 * 10**11  # far beyond a billion slots
    p = mixing.permuted(far, np.full(1000, 4 * 10**11), np.full(1000, 7))
    assert len(set(p.tolist())) == 1000 and p.max() < 4 * 10**11 and (mixing.permuted(p, np.full(1000, 4 * 10**11), np.full(1000, 7), back=True) == far).all()
    for size, want, rank in itertools.product((1, 7, 8, 9, 50, 61), (0, 1, 30, 61, 100), (1, 2, 3)):
        blocks, given, k = -(-size // 8), 0, 0
        while given < want:  # slot after slot until the words are enough
            take = int(mixing.permuted(np.array([k % blocks]), np.array([blocks]), np.array([mixing._seeds(rank, k // blocks, 7)]))[0])
            given, k = given + min(8, size - 8 * take), k + 1
        assert mixing.slots_of(size, want, rank, 8, 7) == k
    monkeypatch.setattr(mixing, "SLOTS", 16)
    monkeypatch.setattr(mixing, "TASK_SHARDS", 1)
    sources = spark.createDataFrame([(1, 9000, 4000.0), (2, 100, 200.0), (3, 1000, 1500.4), (4, 0, 0.0)], "rank long, source_size long, target double")
    got = mixing.slot_table(sources, 8, 7).toPandas()
    assert len(got) == 500 + 26 + 188 and sorted(zip(got["shard"], got["slot"])) == [(k // 16, k % 16) for k in range(len(got))]
    assert got.groupby("rank")["last"].sum().tolist() == [1, 1, 1] and set(got.loc[got["rank"] == 2, "block"]) == set(range(13))
    share = got[got["shard"] < 44].groupby("shard")["rank"].apply(lambda r: (r == 1).mean())
    assert share.nunique() > 3 and abs(share.mean() - 500 / 714) < 0.05


@pytest.mark.parametrize("step", [2000, 1])
def test_mixing_makes_the_mix(spark, step, monkeypatch, scattered):
    monkeypatch.setattr(mixing, "STEP", step)  # 1: most blocks lie in several parts
    rng = random.Random(4)
    rows = [(i, "\t ".join([f"d{i}w{k}ü" for k in range(rng.choice([0, 1, 3, 9, 150]))]) + rng.choice(["", " \n"]), rng.choice(["a", "b", None])) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[7], (None, "no id", "a"), (99, None, "a")], "doc_id long, text string, source string")
    got, streams, taken = mixing.mixed_blocks(docs, block=8).collect(), defaultdict(dict), Counter()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, k) for k in range(len(got))]
    words = {d: (t or "").split() for d, t, _ in rows} | {None: ["no", "id"]}
    for r in got:
        made = [w for s in r["spans"] for w in words[s["doc_id"]][s["start"] : s["start"] + s["n"]]]
        assert r["text"] == " ".join(made) and len(made) == r["words"] <= 8
        for s in r["spans"]:
            taken[s["doc_id"]] += s["n"]
        for k, w in enumerate(made):
            assert streams[r["source"]].setdefault(8 * r["block"] + k, w) == w  # repeats of a block agree
    # blocks of 8 words follow each other in a source; at most one slot of a source is cut
    for source, placed in streams.items():
        whole = Counter(w for r in docs.collect() if r["source"] == source for w in (r["text"] or "").split())
        assert not Counter(placed.values()) - whole
    counts = mixing.mix_sources(docs, block=8).collect()
    by_source = {r["source"]: (r["source_size"], r["target"]) for r in counts}
    for source, (size, target) in by_source.items():
        mine = [r["words"] for r in got if r["source"] == source]
        assert abs(sum(mine) - target) <= 0.5 and sum(n != 8 for n in mine) <= 1 + -(-target // size)
    want = Counter()
    for r in counts:
        want[r["doc_id"]] += r["taken"]
    assert +want == taken
    spans = mixing.mixed_spans(docs, block=8).collect()
    assert Counter({d: n for d, n in taken.items()}) == sum((Counter({r["doc_id"]: r["taken"]}) for r in spans), Counter())
    assert all(r["text"].split() == words[r["doc_id"]][r["start"] : r["start"] + r["taken"]] for r in spans)


def test_gif_round_trip_and_rules(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "ab" * 20_000), (5, "".join(chr(33 + i * i % 90) for i in range(30_000)))]
    media = gif.gif_media(frame(spark, rows))
    for r in gif.gif_digests(media).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
    frames = gif.gif_frames(media.select("doc_id", "media")).where("doc_id = 4").orderBy("frame").collect()
    assert [f["start_cs"] for f in frames] == [10 * k for k in range(len(frames))] and sum(frames[0]["histogram"]) == 192 * 64

    def block(left, top, w, h, pixels, disposal, clear=None):
        stream = gif.lzw_encode(bytes(pixels))
        return b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0]) + b"\0\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, 0, 8, len(stream)]) + stream + b"\0"

    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255]) + bytes(765 - 9 + 3)
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0xF7, 0, 0]) + palette
    data = head + block(0, 0, 2, 1, [0, 1], 1) + block(0, 0, 2, 1, [2, 1], 2, 1) + block(0, 0, 1, 1, [0], 3) + block(1, 0, 1, 1, [1], 0) + b";"
    shown = [f.canvas.reshape(-1, 4).tolist() for f in gif.decode_gif(data)]  # each is read before the next
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown == [[red, green], [blue, green], [red, none], [none, green]]
    assert list(gif.decode_gif(b"no")) == [] and len(list(gif.decode_gif(data[:-20]))) == 3


def plain_lzw(pixels, bits, clear_when_full=True):
    """A code stream by the definition, bit by bit: strings as tuples, a clear code first, and when the table is full or never again."""
    table, width, out = {}, bits + 1, []

    def put(code):
        out.extend((code >> k) & 1 for k in range(width))

    def reset():
        nonlocal width
        table.clear()
        table.update({(i,): i for i in range(1 << bits)})
        width = bits + 1

    reset()
    put(1 << bits)
    w = ()
    for c in pixels:
        if (*w, c) in table:
            w = (*w, c)
            continue
        put(table[w])
        new = len(table) + 2
        if new < 4096:
            table[(*w, c)] = new
            if new == 1 << width and width < 12:
                width += 1
        elif clear_when_full:
            put(1 << bits)
            reset()
        w = (c,)
    put(table[w])
    if len(table) + 2 == 1 << width and width < 12:
        width += 1
    put((1 << bits) + 1)
    out += [0] * (-len(out) % 8)
    return bytes(sum(b << k for k, b in enumerate(out[i : i + 8])) for i in range(0, len(out), 8))


def test_foreign_code_streams_and_broken_files():
    # the stream of a widely printed 10 x 10 example of three colours
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert gif.lzw_decode(stream, 2, 100) == bytes(int(c) for c in "".join(rows))
    rng = np.random.default_rng(0)
    for bits in (1, 2, 3, 5, 8):
        for n, clear in ((1, True), (700, True), (40_000, True), (40_000, False)):
            pixels = rng.integers(0, 1 << bits, n) if n < 1000 else rng.integers(0, 1 << bits, n) * (rng.random(n) < 0.4)
            assert gif.lzw_decode(plain_lzw(pixels.tolist(), max(bits, 2), clear), max(bits, 2), n) == bytes(pixels.tolist())
    assert gif.lzw_encode(bytes(range(256)) * 40) and gif.lzw_decode(gif.lzw_encode(b"abab" * 999), 8, 3996) == b"abab" * 999
    frame_of = lambda w, h, code, at=(0, 0): b"\x2c" + struct.pack("<HHHHB", *at, w, h, 0) + b"\x02" + bytes([len(code)]) + code + b"\0"
    head = lambda w, h: b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(12)
    good = frame_of(10, 10, stream)
    # a canvas of 16 GiB, of which little is drawn on; a frame that is too large; nothing after it
    got = [(f.width, f.canvas.shape) for f in gif.decode_gif(head(65535, 65535) + good + frame_of(10, 10, stream, (20, 5)) + b";")]
    assert got == [(10, (15, 30, 4))] * 2
    assert len(list(gif.decode_gif(head(65535, 65535) + good + frame_of(65535, 65535, stream) + good + b";"))) == 1
    whole = head(10, 10) + good + good + b";"
    for cut in range(len(whole)):  # any end, and any byte changed
        assert len(list(gif.decode_gif(whole[:cut]))) <= 2
        list(gif.decode_gif(whole[:cut] + bytes([whole[cut] ^ 0xFF]) + whole[cut + 1 :]))


def test_odd_tables(spark):
    docs = odd(spark)
    ids = sorted([r[0] for r in docs.select("doc_id").collect()], key=repr)
    once = sorted(set(ids), key=repr)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (2, 4, 5, 6, 9, 10)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (None, "x"), (2, None)], "item_id long, text string")
    got = {
        "each": [toxicity.toxicity_scores(docs, toxicity.fit_grammar(docs, labels)), language.identify_language(docs, language.fit_language(docs)), quality.quality_scores(docs, quality.fit_quality(docs, labels)), mixing.mix_sources(docs), gif.gif_digests(gif.gif_media(docs))],
        "once": [minhash_join.minhash_dedup(docs, 4), suffix_dedup.suffix_dedup(docs), substring_dedup.substring_dedup(docs), decontaminate.decontaminate(docs, bench)],
    }
    for df in got["each"]:
        assert sorted([r["doc_id"] for r in df.collect()], key=repr) == ids
    for df in got["once"]:
        assert sorted([r["doc_id"] for r in df.collect()], key=repr) == once
    near = {r["doc_id"]: r["component_id"] for r in got["once"][0].collect()}
    assert (near[5], near[8], near[11], near[1], near[None]) == (4, 6, 10, 1, None)
    und = {r["doc_id"]: r["lang_pred"] for r in got["each"][1].collect()}
    assert und[1] == und[2] == und[12] == "und" and und[6] != "und"
    hits = {r["doc_id"] for r in got["once"][3].where("contaminated").collect()}
    assert hits == {10, 11}


def test_empty_tables(spark):
    docs = odd(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (toxicity.toxicity_scores(docs, toxicity.fit_grammar(docs, labels)), language.identify_language(docs, language.fit_language(docs)), quality.quality_scores(docs, quality.fit_quality(docs, labels)), mixing.mix_sources(docs), gif.gif_digests(gif.gif_media(docs)), minhash_join.minhash_dedup(docs), suffix_dedup.suffix_dedup(docs), substring_dedup.substring_dedup(docs), decontaminate.decontaminate(docs, bench)):
        assert df.count() == 0


@functools.cache
def word_key(word):
    return toxicity.key_of_bytes(word)


def plain_toxicity(grammar, text):
    """The score of a text by the definition: letter runs, clauses between stops, the lexicon's longest known beginning, marks by looking around."""
    T, lex = toxicity, {int(k): (int(c), w) for k, c, w in zip(grammar.lexicon.key, grammar.lexicon.kind, grammar.lexicon.weight)}
    clauses, words, data = [[]], 0, text.encode()
    for run in re.findall(rb"[A-Za-z\x80-\xff]+|[.,;:!?\n\r]", data):
        if len(run) == 1 and run in b".,;:!?\n\r":
            clauses.append([])
            continue
        found = (T.OTHER, 0.0)
        for size in T.STEMS:
            if len(run) > size:
                found = lex.get(int(np.uint64(word_key(run[:size])) ^ np.uint64(0xA5A5)), found)
        clauses[-1].append(lex.get(word_key(run), found))
        words += 1
    out = np.zeros(len(T.OUTPUTS))
    for c in clauses:
        got = np.zeros(5)
        for i, (kind, weight) in enumerate(c):
            if kind not in (T.INSULT, T.THREAT):
                continue
            before, after = [k for k, _ in c[:i]], [k for k, _ in c[i + 1 :]]
            if kind == T.INSULT:
                near = T.TARGET in before[-T.TARGET_REACH :] or T.TARGET in after[: T.TARGET_REACH]
                got[3 if T.REPORT in before else 2 if T.NEGATION in before[-T.NEGATION_REACH :] else 1 if near else 0] += weight
            elif kind == T.THREAT and T.TARGET in after[: T.TARGET_REACH] and T.REPORT not in before and T.NEGATION not in before[-T.NEGATION_REACH :]:
                got[4] += weight
        out[:5] += got
        out[5], out[6] = max(out[5], got[0] + got[1] + got[4]), out[6] + (got.sum() > 0)
    out[7] = (out[0] + out[1]) / max(words, 1) * 100
    return float(grammar.score(out[None])[0])


def test_toxicity_scores_equal_a_plain_reading(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grammar = toxicity.fit_grammar(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert (grammar.lexicon.kind == toxicity.INSULT).sum() > 3
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, grammar).collect()}
    assert len(set(got.values())) > 20
    for r in rows:
        assert got[r["doc_id"]] == pytest.approx(plain_toxicity(grammar, r["text"] or ""), abs=1e-9)


def plain_contaminated(rows, items):
    """doc_ids that hold a window as long as an item with a weighted 5-word-shingle similarity of 0.8 or more."""

    def grams(text):
        w = text.lower().split()
        k = min(5, len(w))
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []

    refs = [(Counter(grams(t)), len(grams(t))) for t in items if t and t.strip()]
    out = set()
    for d, t in rows:
        g = grams(t or "")
        have = set(g)
        for ref, n in refs:
            if g and have & set(ref):
                for a in range(max(1, len(g) - n + 1)):
                    mine = Counter(g[a : a + n])
                    both = sum((mine & ref).values())
                    if 100 * both >= 80 * (sum(mine.values()) + n - both):
                        out.add(d)
                        break
    return out


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision, on the small tables and on odd rows."""
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd(spark)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            known = {d: t for d, t in rows if d is not None}
            docs = common.written(stage(spark, docs, SMALL), f"test-{name}")
            got = docs.collect()
            if name != "mixing":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
            if name == "toxicity":
                grammar = toxicity.fit_grammar(before, labels)
                want = [(d, t) for d, t in rows if plain_toxicity(grammar, t or "") < 0.5]
                assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted(want, key=repr)
            if name == "minhash":
                want = [d for d, (_, _, kept) in components(known.items(), 5, 80).items() if kept] + [d for d, _ in rows if d is None]
                assert sorted([r["doc_id"] for r in got], key=repr) == sorted(want, key=repr)
            if name == "substring":
                want = brute_windows(known.items(), lambda t: t.encode().split(), 20, b" ".join)
                for r in got:
                    if r["doc_id"] is not None:
                        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == want[r["doc_id"]][3]
                assert {r["doc_id"] for r in got} == {d for d, (n, gone, _, _) in want.items() if not gone or gone < n} | {d for d, _ in rows if d is None}
            if name == "decontamination":
                bad = plain_contaminated(known.items(), bench)
                assert sorted([r["doc_id"] for r in got], key=repr) == sorted([d for d, _ in rows if d not in bad or d is None], key=repr)
            if name == "mixing":
                sizes, taken, words = Counter(), Counter(), {}
                for r in before.collect():
                    words.setdefault(r["doc_id"], []).append((r["text"] or "").split())
                    sizes[r["source"]] += len((r["text"] or "").split())
                for r in got:
                    taken[r["source"]] += r["taken"]
                    assert any(w[r["start"] : r["start"] + r["taken"]] == r["text"].split() for w in words[r["doc_id"]])
                aim = {r["source"]: r["target"] for r in mixing.mix_sources(before).collect()}
                assert all(abs(taken[s] - aim[s]) <= 1 for s in sizes)


def test_chat_on_odd_tables(spark):
    """Very long texts, nulls, ties, repeated rows and extra columns with clashing names."""
    long = "### a </turn> \\ " * 20_000
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (2, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, example int, prompt string, turns int")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.chat_examples(df)).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[None]["n_turns"]) == (3, 0, 1)
