"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexicon maps words to symbols (insult, threat, target, negation, report) with weights. Transducers
over these symbols mark insults and threats: a target nearby, a negation just before, a verb of
reporting earlier in the clause. They are tables of states, and their composition by product is one
machine that reads each clause once from left to right, after one machine that reads it from right to
left for targets that follow. A table gives the output of every marked symbol; outputs are summed over
matched clauses, and a logistic layer, fitted on labelled documents, turns them into a score.

The insult lexicon is learned: words and word beginnings that are much more frequent in documents
labelled toxic, with their log odds as weights. The labelled sample gives both lexicon and layer: the layer
reads each fold of it with the lexicon of the other folds, and the lexicon of all folds is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U
from .training import labelled_sample

#: Documents of each label in the fitting sample, and entries of the learned lexicon, at most.
SAMPLE, LEXICON = 4000, 5000
#: Bytes of the word beginnings that the lexicon may hold beside whole words.
STEMS = (4, 5, 6, 8)
MIN_DOCS, MIN_WEIGHT = 5, 2.0
#: Parts of the labelled sample, each read with the lexicon of the others to fit the layer.
FOLDS = 4
#: Terms that may enter the lexicon by chance, among all that are tried.
CHANCE = 5.0

# Fixed word lists of the grammar.
THREATS = "kill hurt beat destroy punch shoot stab burn crush töten schlagen zerstören verletzen tuer frapper détruire blesser matar golpear destruir herir".split()
TARGETS = "you your yours yourself he him she her they them u ur du dich dir dein ihr euch sie tu toi te vous votre ils elle usted tú ti tus ellos ustedes".split()
NEGATIONS = "not no never without nor hardly nicht kein keine nie ohne ne pas jamais sans nunca jamás sin ni".split()
REPORTS = "said says told wrote writes claimed called quoted reported according sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó según".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Marks of insults and threats, added to their symbol.
NEGATED, REPORTED, BEFORE, AFTER = 8, 16, 32, 64
CODES = 128
#: Words that a target and a negation may stand away.
TARGET_REACH, NEGATION_REACH = 4, 3
#: Outputs of the grammar for each document.
OUTPUTS = ("plain", "targeted", "negated", "reported", "threat", "strongest", "clauses", "share")


def word_keys(data: np.ndarray, at: np.ndarray):
    """Letter runs of joined texts: row, clause, and the hashes of the whole run and of its beginnings (0 where shorter)."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    n = len(data)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, np.empty((0, 1 + len(STEMS)), U)
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge], last[edge - 1] = letter[edge], letter[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    stop = np.isin(data, np.frombuffer(b".,;:!?\n\r", np.uint8))
    clause = np.cumsum(stop)[start] + np.searchsorted(at, start, "right")
    keys = np.zeros((len(start), 1 + len(STEMS)), U)
    keys[:, 0] = common.word_hashes(data, start, end, lower=True)
    for k, size in enumerate(STEMS, 1):
        longer = end - start > size
        keys[longer, k] = common.word_hashes(data, start[longer], start[longer] + size, lower=True) ^ U(0xA5A5)
    return np.searchsorted(at, start, "right") - 1, clause, keys


def key_of_bytes(word: bytes) -> int:
    return int(common.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), lower=True)[0])


def key_of(word: str) -> int:
    return key_of_bytes(word.encode())


@dataclass
class Lexicon:
    """Sorted keys with class and weight."""

    key: np.ndarray
    kind: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, learned: dict[int, float]) -> Lexicon:
        rows = {k: (INSULT, w) for k, w in learned.items()}  # words of the grammar keep their class
        rows |= {key_of(w): (kind, 1.0) for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}
        key = np.array(sorted(rows), U)
        return cls(key, np.array([rows[int(k)][0] for k in key], np.int8), np.array([rows[int(k)][1] for k in key]))

    def classes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word: of the whole word, or else of its longest known beginning."""
        kind, weight = np.zeros(len(keys), np.int8), np.zeros(len(keys))
        table = np.zeros(1 << 16, bool)
        table[(self.key >> U(48)).astype(np.int64)] = True
        for k in [*range(1, keys.shape[1]), 0]:
            near = np.flatnonzero(table[(keys[:, k] >> U(48)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.key, keys[near, k]), len(self.key) - 1)
            hit = self.key[where] == keys[near, k]
            kind[near[hit]], weight[near[hit]] = self.kind[where[hit]], self.weight[where[hit]]
        return kind, weight


@dataclass(frozen=True)
class Transducer:
    """Next state, output code and weight for each state and input code; it starts in state 0 at each clause."""

    next: np.ndarray
    out: np.ndarray
    weight: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what self writes. States are the reachable pairs, weights multiply."""
        pairs, rows = {(0, 0): 0}, []
        for a, b in iter_growing(pairs):
            row = []
            for x in range(CODES):
                y = int(self.out[a, x])
                to = (int(self.next[a, x]), int(other.next[b, y]))
                row.append((pairs.setdefault(to, len(pairs)), int(other.out[b, y]), float(self.weight[a, x] * other.weight[b, y])))
            rows.append(row)
        table = np.array(rows)
        return Transducer(table[..., 0].astype(np.int64), table[..., 1].astype(np.int64), table[..., 2])

    def read(self, code: list[int], gap: list[int]) -> tuple[list[int], list[float]]:
        """Output codes and weights of joined clauses of known words: gap counts the other words before each, or is -1 where a clause begins."""
        skip, most = [list(range(len(self.next)))], max(TARGET_REACH, NEGATION_REACH)
        for _ in range(most):  # the states after so many other words; after more than the reach they stay
            skip.append([int(self.next[s, OTHER]) for s in skip[-1]])
        step, out, weight = self.next.tolist(), self.out.tolist(), self.weight.tolist()
        state, codes, weights = 0, [], []
        for x, n in zip(code, gap):
            state = 0 if n < 0 else skip[min(n, most)][state]
            codes.append(out[state][x])
            weights.append(weight[state][x])
            state = step[state][x]
        return codes, weights


def iter_growing(known: dict):
    """The keys of a dict that grows while they are read."""
    k = 0
    while k < len(known):
        yield list(known)[k]
        k += 1


def _marker(states: int, move, mark: int) -> Transducer:
    """Marks insults and threats in every state but 0; move(state, symbol) is the next state."""
    state, code = np.indices((states, CODES))
    head = np.isin(code & 7, (INSULT, THREAT)) & (state > 0)
    step = np.array([[move(s, x & 7) for x in range(CODES)] for s in range(states)])
    return Transducer(step, np.where(head, code | mark, code), np.ones((states, CODES)))


def within(symbol: int, reach: int, mark: int) -> Transducer:
    """Marks what stands at most `reach` words after the symbol; the state counts the words left."""
    return _marker(reach + 1, lambda s, x: reach if x == symbol else max(s - 1, 0), mark)


def ever(symbol: int, mark: int) -> Transducer:
    """Marks all that stands after the symbol in its clause."""
    return _marker(2, lambda s, x: int(s or x == symbol), mark)


#: Read from right to left, then from left to right.
FOLLOWED = within(TARGET, TARGET_REACH, AFTER)
GRAMMAR = within(NEGATION, NEGATION_REACH, NEGATED).then(ever(REPORT, REPORTED)).then(within(TARGET, TARGET_REACH, BEFORE))


def _channel(code: int) -> int:
    """The output (of OUTPUTS) that a marked symbol counts for, or -1: a threat counts if it has an object and is neither negated nor reported."""
    if code & 7 == INSULT:
        return 3 if code & REPORTED else 2 if code & NEGATED else 1 if code & (BEFORE | AFTER) else 0
    return 4 if code & 7 == THREAT and code & AFTER and not code & (NEGATED | REPORTED) else -1


CHANNEL = np.array([_channel(x) for x in range(CODES)])


def marked(symbol: np.ndarray, clause: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of known words (in order, with their clause and their place among all words)."""
    new = np.append(True, clause[1:] != clause[:-1])[: len(clause)]
    gap = np.where(new, -1, np.diff(place, prepend=0) - 1)
    back = np.where(np.append(new[1:], True)[: len(new)], -1, np.append(gap[1:], 0)[: len(new)])
    code, first = FOLLOWED.read(symbol[::-1].tolist(), back[::-1].tolist())
    code, then = GRAMMAR.read(code[::-1], gap.tolist())
    return np.array(code, np.int64), np.array(first[::-1]) * np.array(then)


def grammar_outputs(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """OUTPUTS of each row."""
    rows = len(at) - 1
    out = np.zeros((rows, len(OUTPUTS)))
    row, clause, keys = word_keys(data, at)
    if not len(row):
        return out
    kind, weight = lexicon.classes(keys)
    live = np.unique(clause[(kind == INSULT) | (kind == THREAT)])
    where = np.flatnonzero((kind > OTHER) & np.isin(clause, live))
    words = np.bincount(row, minlength=rows)
    if not len(where):
        return out
    code, times = marked(kind[where], clause[where], where)
    channel = CHANNEL[code]
    tells = channel >= 0
    of = np.searchsorted(live, clause[where])
    sums = np.bincount((of * 5 + channel)[tells], (weight[where] * times)[tells], len(live) * 5).reshape(-1, 5)
    owner = np.zeros(len(live), np.int64)
    owner[of] = row[where]
    np.add.at(out[:, :5], owner, sums)
    np.maximum.at(out[:, 5], owner, sums[:, 0] + sums[:, 1] + sums[:, 4])
    out[:, 6] = np.bincount(owner, sums.sum(axis=1) > 0, rows)
    out[:, 7] = out[:, :2].sum(axis=1) / np.maximum(words, 1) * 100
    return out


def _layer(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


@dataclass
class Grammar:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_layer(x) @ self.weights + self.bias, -30, 30)))


def _fold() -> object:
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(FOLDS)).cast("int")


def _lexicon(terms: DataFrame, n: Column, bad: Column, docs: int, toxic: int) -> Lexicon:
    """The lexicon of terms that n documents hold, bad of them toxic, among docs documents and toxic ones."""
    terms = terms.select("key", n.alias("n"), bad.alias("bad")).where(F.col("n") >= MIN_DOCS)
    # how surprising the share of toxic documents is (a likelihood ratio), against chance among so many terms
    share, part = max(toxic, 1) / max(docs, 1), F.col("bad") / F.col("n")
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (docs - toxic + 1))
    surprise = F.col("bad") * F.log(part / share) + F.when(part < 1, (F.col("n") - F.col("bad")) * F.log((1 - part) / max(1 - share, 1e-9))).otherwise(0.0)
    chance = math.log(max(terms.count(), 1) / CHANCE)
    terms = terms.withColumn("weight", odds).where((F.col("bad") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT)).where(surprise >= chance)
    return Lexicon.of({r["key"] % (1 << 64): r["weight"] for r in terms.orderBy(F.desc(F.col("bad") * F.col("weight")), "key").limit(LEXICON).collect()})


def fit_grammar(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Grammar:
    """Learn lexicon (its LEXICON best terms) and layer from at most `sample` documents of each label; held-out rows are never read."""
    common.bounded_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels.select("doc_id", F.col("toxic").alias("label")), sample, parts, held_out).withColumn("fold", _fold())
    rows = common.written(rows, "toxic-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, fold = common.int64(b.column(2)), common.int64(b.column(3))
            for i, j, data, at in common.slices(b.column(1)):
                row, _, keys = word_keys(data, at)
                of = np.repeat(row, keys.shape[1])
                key = keys.ravel()
                pair = np.unique(np.stack([key, of.astype(U)])[:, key != 0], axis=1) if len(key) else np.empty((2, 0), U)
                key, of = pair[0], i + pair[1].astype(np.int64)
                order = np.lexsort((fold[of], key))
                key, of = key[order], of[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (fold[of][1:] != fold[of][:-1])))[: len(key)]
                bad = np.add.reduceat(label[of], first) if len(key) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(fold[of][first]), pa.array(np.diff(np.append(first, len(key))).astype(np.int64)), pa.array(bad.astype(np.int64))], ["key", "fold", "n", "bad"])

    of_fold = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect()
    n = {"n": sum(r["n"] for r in of_fold), "bad": sum(r["bad"] for r in of_fold)}
    within_fold = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    terms = rows.select("doc_id", "text", "label", "fold").mapInArrow(counts, "key long, fold long, n long, bad long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), *(within_fold(c, f) for c in ("n", "bad") for f in range(FOLDS)))
    terms = common.written(terms.where(F.col("n") >= MIN_DOCS), "toxic-terms")
    lexicon, second = _lexicon(terms, F.col("n"), F.col("bad"), n["n"], n["bad"]), []
    for r in sorted(of_fold, key=lambda r: r["fold"]):
        f = r["fold"]
        others = _lexicon(terms, F.col("n") - F.col(f"n{f}"), F.col("bad") - F.col(f"bad{f}"), n["n"] - r["n"], n["bad"] - r["bad"])
        second += grammar_columns(rows.where(F.col("fold") == f).select("doc_id", "text", "label"), others, "label").orderBy("doc_id").collect()
    x, y = _layer(np.array([r["x"] for r in second]).reshape(-1, len(OUTPUTS))), np.array([r["label"] for r in second], float)
    weights, bias = np.zeros(len(OUTPUTS)), -3.0
    if len(y) and 0 < y.sum() < len(y):
        share = n["bad"] / max(n["n"], 1)
        importance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * np.where(y > 0, max(share, 0.1), 1 - max(share, 0.1)) * 2
        full, w = np.hstack([x, np.ones((len(x), 1))]), np.append(weights, bias)
        ridge = np.append(np.full(len(weights), 1.0), 1e-3)

        def loss(v: np.ndarray) -> float:
            z = full @ v
            return float((importance * (np.logaddexp(0, z) - y * z)).sum() + (ridge * v * v).sum() / 2)

        for _ in range(100):  # damped Newton steps
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            slope = full.T @ (importance * (p - y)) + ridge * w
            bend = (full * (importance * p * (1 - p))[:, None]).T @ full + np.diag(ridge)
            move, size = np.linalg.solve(bend, slope), 1.0
            while size > 1e-6 and loss(w - size * move) > loss(w):
                size /= 2
            w = w - size * move
            if np.abs(size * move).max() < 1e-6:
                break
        weights, bias = w[:-1], w[-1]
    return Grammar(lexicon, weights, float(bias))


def grammar_columns(docs: DataFrame, lexicon: Lexicon, *more: str) -> DataFrame:
    """doc_id, x array<double> (OUTPUTS), and integer columns `more` unchanged."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in common.slices(b.column(1)):
                x = grammar_outputs(data, at, lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(OUTPUTS)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, *(b.column(2 + k).slice(i, j - i) for k in range(len(more)))], ["doc_id", "x", *more])

    form = ", ".join(["doc_id long, x array<double>", *(f"{c} int" for c in more)])
    return docs.select("doc_id", "text", *(F.col(c).cast("int").alias(c) for c in more)).mapInArrow(of, form)


def toxicity_scores(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and outputs (the grammar's sums) of every whole text.

    Null and empty texts match no clause and get the score of no match. Every row of docs gives a row,
    rows without doc_id and repeated ones too. Columns other than doc_id and text are not read.
    """
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in common.slices(b.column(1)):
                x = grammar_outputs(data, at, grammar.lexicon)
                p = grammar.score(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(OUTPUTS)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32)), lists], ["doc_id", "score", "predicted", "outputs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, score double, predicted int, outputs array<double>")


def toxicity_filter(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold; null and empty texts stay unless no match scores that high."""
    common.bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in common.slices(b.column(place)):
                p = grammar.score(grammar_outputs(data, at, grammar.lexicon))
                yield b.slice(i, j - i).filter(pa.array(p < threshold))

    return docs.mapInArrow(of, docs.schema)
