"""Context trees, periodic runs and ranked search against brute force, and on odd tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shadespark.llm import common, context_tree, lexical_search, periodic_runs, queries, toxicity
from test_operators import corpus, make, odd

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def write(tmp_path, spark, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pieces_of_long_rows():
    """Cut rows have the words of whole ones, however long a word is."""
    rng = random.Random(2)
    texts = [" ".join("é" * rng.randint(1, 40) if rng.random() < 0.1 else "ab1"[: rng.randint(1, 3)] for _ in range(rng.randint(0, 80))) for _ in range(30)] + [None, "", " " * 300, "x" * 500]
    for inside, form in ((common.IN_WORD, rb"[^\x20\x09-\x0D]+"), (lexical_search.IN_TERM, rb"[0-9A-Za-z\x80-\xff]+")):
        got = [[] for _ in texts]
        for i, j, data, at in common.steps(pa.array(texts), inside, limit=64):
            start, end, row = common.word_bounds(data, at, inside)
            for s, e, r in zip(start.tolist(), end.tolist(), row.tolist()):
                got[i + r].append(data[s:e].tobytes())
        assert got == [re.findall(form, (t or "").encode()) for t in texts]


def plain_scores(rows, depth):
    """(n_tokens, n_known, train_tokens, base_score, score) of each row, from a dictionary of nodes."""
    nodes, counts, children = {}, Counter(), {}

    def read(t):
        words = WORD.findall((t or "").encode().lower() if (t or "").isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        return words, b"\n" * depth + b"".join(w + b" " for w in words) + b"\n"

    for i, t in rows:
        if i is not None and crc(i) % 7 == 2:
            continue
        words, s = read(t)
        counts.update([*words, b"\n"])
        for k in range(depth, len(s)):
            for b in range(8):
                for d in range(depth + 1):
                    nodes.setdefault((s[k - d : k], (1 << b) | (s[k] >> (8 - b))), [0, 0])[(s[k] >> (7 - b)) & 1] += 1
    for c, p in nodes:
        if c:
            children.setdefault((c[1:], p), []).append((c, p))
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.lru_cache(None)
    def weighted(c, p):
        e = estimate(*nodes.get((c, p), (0, 0)))
        return e if len(c) == depth else np.logaddexp(e, sum(weighted(*x) for x in children.get((c, p), ()))) - math.log(2)

    @functools.lru_cache(None)
    def probability(c, p, bit):
        total, rest = 0.0, 1.0
        for d in range(depth + 1):
            n = nodes.get((c[depth - d :], p), (0, 0))
            stop = 1.0 if d == depth else math.exp(estimate(*n) - weighted(c[depth - d :], p)) / 2
            total, rest = total + rest * stop * (n[bit] + 0.5) / (sum(n) + 1), rest * (1 - stop)
        return total

    every, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        words, s = read(t)
        tokens = [*words, b"\n"]
        bits = ((s[k - depth : k], (1 << b) | (s[k] >> (8 - b)), (s[k] >> (7 - b)) & 1) for k in range(depth, len(s)) for b in range(8))
        yield i, len(tokens), sum(counts[w] > 0 for w in tokens), every, sum(math.log10((counts[w] + 1) / (every + distinct + 1)) for w in tokens), sum(math.log10(probability(*x)) for x in bits)


@pytest.mark.parametrize("depth", [4, 6, 7])
def test_context_tree_equals_brute_force(spark, depth):
    rng = random.Random(depth)
    names = ["Alpha", "beta", "GAMMA", "éa", "ñandú", "x", "to", "the", "日本"]
    rows = [(i, " ".join(rng.choice(names) if rng.random() < 0.9 else "".join(rng.choice("abcé") for _ in range(5)) for _ in range(rng.randint(0, 30)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "no id"), (3, "again THE"), (3, "again THE"), (2, "É Z")]
    got = context_tree.context_tree_scores(make(spark, [(i, t, "en", "a", 0) for i, t in rows]), depth=depth).collect()
    want = list(plain_scores(rows, depth))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 4))
    got, want = sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [x for r in got for x in r[4:]] == pytest.approx([x for r in want for x in r[4:]], rel=1e-6)


def test_context_tree_over_blocks_and_buckets(spark, monkeypatch):
    """The model hangs neither on how texts are dealt to blocks nor on parts and buckets."""
    docs = make(spark, [(i, t, "en", "a", 0) for i, t in corpus(spark, 8, 60)])
    table = lambda: {r["doc_id"]: r for r in context_tree.context_tree_scores(docs).collect()}
    whole = table()
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(context_tree, "PART_BYTES", 3000)
    monkeypatch.setattr(context_tree, "BUCKET_GRAMS", 500)
    cut = table()
    assert whole.keys() == cut.keys() and all(cut[k]["n_known"] == r["n_known"] and cut[k]["score"] == pytest.approx(r["score"], rel=1e-6) for k, r in whole.items())
    assert all(r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / r["n_bytes"]) for r in whole.values())


def test_context_tree_predicts_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    r = context_tree.context_tree_scores(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.avg("n_known").alias("k")).first()
    assert r["score"] > 0.985 * r["base"] and r["k"] > 10  # both negative


def test_context_tree_on_odd_tables(spark):
    df = odd(spark)
    got = context_tree.context_tree_scores(df).collect()
    assert len(got) == df.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert context_tree.context_tree_scores(df.limit(0)).count() == 0
    held = make(spark, [(i, "only held out", "en", "a", 0) for i in range(200) if crc(i) % 7 == 2])
    r = context_tree.context_tree_scores(held).first()
    assert r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == pytest.approx(-math.log10(2) * 8 * r["n_bytes"], rel=1e-6)
    with pytest.raises(ValueError):
        context_tree.context_tree_scores(df, depth=9)


def test_packed_numbers():
    for x in (np.array([], np.int64), np.array([3, 2**62, 2**63 - 1]), np.sort(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 1000))):
        assert (context_tree.unpacked(context_tree.packed(x)) == x).all()
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000))
    find = context_tree._lookup(keys, np.arange(len(keys), dtype=float))
    assert (find(keys[::-1]) == np.arange(len(keys))[::-1]).all()


def plain_runs(w):
    """All runs (start, length, period) of a list, period by period."""
    spans = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                spans.setdefault(q, []).append((i, j + q))
            i = j + 1
    return sorted(((s, e - s, q) for q, x in spans.items() for s, e in x if not any(r < q and q % r == 0 and any(a <= s and e <= z for a, z in y) for r, y in spans.items())), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)

    def fibonacci(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    for k in range(400):
        w = fibonacci(rng.randint(20, 300)) if k % 6 == 0 else []
        while len(w) < rng.randint(20, 260) and k % 6:
            p = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 30))]
            w = w + p * rng.randint(1, 6) + p[: rng.randint(0, len(p))] + [rng.randrange(5) for _ in range(rng.randint(1, 9))] * (rng.random() < 0.3)
        number = {}
        w = [number.setdefault(x, len(number)) for x in w]
        assert periodic_runs.runs_of(w) == plain_runs(w)


def test_repair_derives_the_words():
    """Nonterminals derive what stands at their first place, no pair is left twice, and the last one derives all."""
    rng = random.Random(6)
    for _ in range(60):
        w = [rng.randrange(4) for _ in range(rng.randint(2, 200))] + list(range(4))
        rules, n = periodic_runs.repair(w)
        whole = lambda x: [x] if x < n else whole(rules[x - n][0]) + whole(rules[x - n][1])  # noqa: E731, B023
        assert all(whole(n + k) == w[i : i + size] for k, (_, _, i, size) in enumerate(rules)) and whole(n + len(rules) - 1) == w


def plain_run_row(i, t):
    words = WORD.findall((t or "").encode())
    n, h = len(words), crc(i)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t) for i, t in corpus(spark, 9, 80)] + [(1000 + i, " ".join([f"a{k}" for k in range(i)] + ["la  la\tboo"] * i)) for i in range(30)] + [(2000, None), (2001, ""), (2002, "\n \t")]
    rows += [(3000 + i, " ".join(rng.choices("abc", k=200))) for i in range(30)]
    sf = write(tmp_path, spark, documents=make(spark, [(i, t, "en", "a", 0) for i, t in rows]))
    got = sorted(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.op12_runs(spark, sf).collect())
    assert got == sorted(plain_run_row(i, t) for i, t in rows)
    assert any(r[1] > 1 for r in got)


def test_runs_on_odd_tables(spark):
    df = odd(spark)
    rows = [(50, "w " * 700_000, "en", "a", 0), (51, "ab cd\n" * 100 + "x" * 3_000_000, "en", "a", 0)]  # over one step, and a word longer than a step
    got = {}
    for r in periodic_runs.periodic_runs(df.unionByName(make(spark, rows))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == df.count() + 2 and len(got[7]) == 2 and len(got[None]) == 1
    assert [tuple(x) for x in got[50][0]["runs"]] == [(0, 700_000, 1)] and got[50][0]["collapsed"] == "w"
    assert [tuple(x) for x in got[51][0]["runs"]] == [(0, 200, 2)] and len(got[51][0]["collapsed"]) == 3_000_006 and got[51][0]["n_words"] == 201
    assert got[1][0]["n_words"] == 0 and got[1][0]["collapsed"] == "" and got[7][0]["collapsed"] == "x"
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def plain_search(docs, items, k):
    lower = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, lower(t)) for i, t in docs if i is not None]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(x for _, _, c in bags for x in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(lower(t))
    for item, terms in asked.items():
        scored = []
        for i, w, tf in bags:
            m = 50 + (50 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in terms if x in tf)
            if s > 0:
                scored.append((-s, i))
        yield from ((item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1))


@pytest.mark.parametrize("bound", [None, "VOCABULARY", "POSTINGS"])
def test_search_equals_brute_force(spark, monkeypatch, bound):
    """With the vocabulary broadcast or shuffled, and terms of items broadcast or joined; many copies of one text, of which an item shows the first."""
    if bound:
        monkeypatch.setattr(lexical_search, bound, 3)
    rng = random.Random(11)
    docs = [(i, t.replace("v1", "V1") if i % 3 else t) for i, t in corpus(spark, 12, 90)] + [(500 + i, "v1 v2, v3!") for i in range(40)] + [(600 + i, "v3 V2; v1") for i in range(20)] + [(700, None), (701, ""), (702, "... !"), (None, "v1 v2"), (703, "É v1"), (703, "É v1")]
    items = [(i, " ".join(rng.choices([f"V{k}" for k in range(320)], k=rng.randint(0, 12))) + " v1") for i in range(12)] + [(90, None), (91, "unknown"), (3, "v7 v7 v8"), (None, "v1"), (92, "é É-v3")]
    got = lexical_search.lexical_search(make(spark, [(i, t, "en", "a", 0) for i, t in docs]), make(spark, [(i, t, "en", "a", 0) for i, t in items]).withColumnRenamed("doc_id", "item_id"), k=15)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == sorted(plain_search(docs, items, 15))


def test_search_on_odd_tables(spark):
    df = odd(spark)
    items = df.select(F.col("doc_id").alias("item_id"), "text", "kept", "rank", "bucket")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, lexical_search.lexical_search(df, items, k=5).collect())) == sorted(plain_search(docs, docs, 5))
    assert lexical_search.lexical_search(df.limit(0), items).count() == lexical_search.lexical_search(df, items.limit(0)).count() == 0


def test_toxicity_weighs_threats_and_reports(spark):
    """Where threats make documents toxic, and reported insults do not, the layer says so."""
    rng = random.Random(13)
    filler = lambda k: " ".join(rng.choices([f"w{i}" for i in range(400)], k=k))
    rows = []
    for i in range(900):
        kind = 0 if i % 30 < 4 else 1 if i % 30 < 8 else 2 if i % 30 == 8 else 3
        middle = {0: "they will kill you and hurt them", 1: "you zorgle and you blarfen", 2: "he said you zorgle and blarfen", 3: "nothing of that"}[kind]
        rows.append((i, f"{filler(20)}. {middle}. {filler(15)}", int(kind < 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit_grammar(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    weight = dict(zip(toxicity.OUTPUTS, grammar.weights))
    assert weight["threat"] > 0.1 and weight["targeted"] > 0.1 and weight["reported"] < 0.1, weight
    wrong = toxicity.toxicity_scores(docs, grammar).join(docs.select("doc_id", "toxic"), "doc_id").where("predicted <> toxic").count()
    assert wrong == 0
