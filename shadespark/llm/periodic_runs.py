"""Periodic runs of words, found on a grammar.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q) words that no
neighbouring word extends with that period. The steps for a document:

1. A run holds 16 consecutive words that stand again q words later, at any q: with q below LEAST / TIMES the run is
   LEAST words long, and beyond it is 3 q. So each of its words is in a window of REPEAT words that occurs twice in the
   document. Windows are compared by hash, a slice of documents at once; the maximal stretches that repeated windows
   cover are read on, and hold every run whole. Equal words have equal hashes, so nothing is lost.
2. Re-Pair on the words of a stretch: the most frequent pair of symbols, the oldest of equally frequent ones, gives way
   to a nonterminal until no pair occurs twice. What is left gets a balanced tree of nonterminals of its own.
3. Each nonterminal is searched once, on the words of its first occurrence, for runs that cross the border of its two
   parts. One side of a run holds half of its words, so at period q the words next to the border on that side stand again
   q words further away from it: a hash of prefixes tests all q of many nonterminals at once, and those that pass are
   compared word by word.
4. Runs of a nonterminal are moved to all its places in the derivation. The nonterminal that holds a run and of which no
   part does gives it whole; intervals of one period that share q words are the same run and are merged; those inside a
   run whose period divides theirs have a smaller period and go.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U

#: Words of a run at least, and its length in periods at least.
LEAST, TIMES = 24, 3
#: Consecutive words of a run, at least, that stand again one period later.
REPEAT = LEAST * (TIMES - 1) // TIMES
#: Pairs of a nonterminal and a period that one vectorised step tests.
STEP = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1


def repair(words: list[int]) -> tuple[list[tuple[int, int, int, int]], int]:
    """A grammar of words (numbers from 0 below their count): its nonterminals as (first part, second part, first place,
    words), numbered from len(words) on, parts before wholes; the last one, if any, derives all. Also that first number."""
    n = len(words)
    symbol, after, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
    count = {p: len(x) for p, x in places.items()}
    queue = [(-c, k, p) for k, (p, c) in enumerate(count.items()) if c > 1]
    heapq.heapify(queue)
    order, rules, size = len(count), [], {}
    while queue:
        c, _, pair = heapq.heappop(queue)
        now = count.get(pair, 0)
        if now < 2:
            continue
        if now != -c:
            heapq.heappush(queue, (-now, order, pair))
            order += 1
            continue
        a, b = pair
        found, free = [], -1
        for i in sorted(places.pop(pair)):
            if i >= free and symbol[i] == a and after[i] < n and symbol[after[i]] == b:
                found.append(i)
                free = after[i] + 1  # of places that overlap, the first stands
        del count[pair]
        if len(found) < 2:
            continue
        x = n + len(rules)
        size[x] = size.get(a, 1) + size.get(b, 1)
        rules.append((a, b, found[0], size[x]))
        fresh = {}
        for i in found:
            j = after[i]
            p, k = before[i], after[j]
            if p >= 0:
                old, new = (symbol[p], a), (symbol[p], x)
                if old in count:
                    count[old] -= 1
                places.setdefault(new, []).append(p)
                count[new] = count.get(new, 0) + 1
                fresh[new] = True
            if k < n:
                old, new = (b, symbol[k]), (x, symbol[k])
                if old in count:
                    count[old] -= 1
                places.setdefault(new, []).append(i)
                count[new] = count.get(new, 0) + 1
                fresh[new] = True
                before[k] = i
            symbol[i], symbol[j], after[i] = x, -1, k
        for p in fresh:
            if count.get(p, 0) > 1:
                heapq.heappush(queue, (-count[p], order, p))
                order += 1
    row, i = [], 0
    while i < n:
        row.append((symbol[i], i, size.get(symbol[i], 1)))
        i = after[i]
    while len(row) > 1:
        above = []
        for (a, i, m), (b, _, o) in zip(row[::2], row[1::2]):
            above.append((n + len(rules), i, m + o))
            rules.append((a, b, i, m + o))
        row = above + row[len(row) - len(row) % 2 :]
    return rules, n


def crossing(words: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each of the parts [low, high) of words, the runs (start, end, period) of it that touch the border at mid."""
    n = len(words)
    power = np.full(n + 1, _BASE, U)
    power[0] = 1
    power = np.cumprod(power, dtype=U)
    prefix = np.zeros(n + 1, U)
    np.cumsum(common.mix(words.astype(U) + U(1)) * power[:n], out=prefix[1:])
    out: list[list[tuple[int, int, int]]] = [[] for _ in low]
    seen: list[list[tuple[int, int, int]]] = [[] for _ in low]
    for rightward in (True, False):
        most = ((high - mid if rightward else mid - low) * 2 + 2) // 3  # a side of half the run is 1.5 periods
        cuts = np.flatnonzero(np.diff(np.cumsum(most) // STEP)) + 1
        for part in np.split(np.arange(len(low)), cuts):
            node = np.repeat(part, most[part])
            q = np.arange(len(node)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
            again = np.maximum((q + 1) // 2, LEAST // 2 - q)
            first = mid[node] if rightward else mid[node] - q - again
            fits = (first + again + q <= high[node]) if rightward else first >= low[node]
            node, q, again, first = node[fits], q[fits], again[fits], first[fits]
            same = (prefix[first + again] - prefix[first]) * power[q] == prefix[first + again + q] - prefix[first + q]
            for k, p, i, m in zip(node[same].tolist(), q[same].tolist(), first[same].tolist(), again[same].tolist()):
                if any(p % r == 0 and s <= i and i + m + p <= e for s, e, r in seen[k]):
                    continue
                s, e = _spread(words, int(low[k]), int(high[k]), i, i + m, p)
                if e - s < p:
                    continue
                seen[k].append((s, e, p))
                if e - s >= max(LEAST, TIMES * p):
                    out[k].append((s, e, p))
    return out


def _spread(words: np.ndarray, low: int, high: int, i: int, j: int, q: int) -> tuple[int, int]:
    """The longest stretch of period q within [low, high) that holds [i, j + q); empty if that has another word."""
    if not np.array_equal(words[i:j], words[i + q : j + q]):
        return i, i
    step = 64
    while j + q < high:
        end = min(high - q, j + step)
        differ = np.flatnonzero(words[j:end] != words[j + q : end + q])
        j = j + int(differ[0]) if len(differ) else end
        if len(differ):
            break
        step *= 2
    step = 64
    while i > low:
        begin = max(low, i - step)
        differ = np.flatnonzero(words[begin:i] != words[begin + q : i + q])
        i = begin + int(differ[-1]) + 1 if len(differ) else begin
        if len(differ):
            break
        step *= 2
    return i, j + q


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of words, numbers from 0 below their count, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    rules, base = repair(words)
    array = np.array(words, np.int64)
    long = [k for k, r in enumerate(rules) if r[3] >= LEAST]
    low, size = (np.array([rules[k][c] for k in long], np.int64) for c in (2, 3))
    left = np.array([1 if rules[k][0] < base else rules[rules[k][0] - base][3] for k in long], np.int64)
    own = dict(zip(long, crossing(array, low, low + left, low + size)))
    useful = [False] * len(rules)
    for k, (a, b, _, _) in enumerate(rules):
        useful[k] = bool(own.get(k)) or any(x >= base and useful[x - base] for x in (a, b))
    at: dict[int, list[np.ndarray]] = {len(rules) - 1: [np.zeros(1, np.int64)]}
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(len(rules) - 1, -1, -1):
        if not useful[k] or k not in at:
            continue
        a, b, first, _ = rules[k]
        where = np.concatenate(at.pop(k))
        for s, e, q in own.get(k, ()):
            found.setdefault(q, []).append((where + (s - first), where + (e - first)))
        for x, shift in ((a, 0), (b, 1 if a < base else rules[a - base][3])):
            if x >= base and useful[x - base]:
                at.setdefault(x - base, []).append(where + shift)
    spans = {q: _merged(np.concatenate([s for s, _ in x]), np.concatenate([e for _, e in x]), q) for q, x in found.items()}
    runs = []
    for q in sorted(spans):
        s, e = spans[q]
        for r in spans:
            if r < q and q % r == 0:
                within = np.searchsorted(spans[r][0], s, "right") - 1
                inside = (within >= 0) & (spans[r][1][within] >= e)
                s, e = s[~inside], e[~inside]
        runs += zip(s.tolist(), (e - s).tolist(), [q] * len(s))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _merged(start: np.ndarray, end: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of those that share q places."""
    order = np.lexsort((end, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1] - q)
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _covered(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of words, within documents, that windows of REPEAT words cover which occur again in their document."""
    g = common.kgrams(h, REPEAT)
    if not len(g):
        return (np.empty(0, np.int64),) * 2
    at = np.flatnonzero(doc[: len(g)] == doc[REPEAT - 1 :])
    value = common.mix(g[at] ^ common.mix(doc[at].astype(U) + U(1)))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    again = np.sort(at[order[np.append(same, False) | np.append(False, same)]])
    if not len(again):
        return (np.empty(0, np.int64),) * 2
    new = np.append(True, (np.diff(again) > REPEAT) | (np.diff(doc[again]) > 0))
    return again[new], again[np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)] + REPEAT


def periodic_runs(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> by start and period, collapsed_sha256 and, if with_text, collapsed.

    docs: doc_id, text; other columns are ignored. Words are numbered from 0. collapsed: the words, joined by one space,
    without those that some run holds after its first period. Null and empty texts have no words, no runs and an empty
    collapsed text. One row for each row of docs, those without doc_id or with a repeated one too. A text is the unit of work:
    one task reads it whole, in about 50 bytes a word besides the text.
    """
    common.bounded_batches(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    form = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed_sha256", pa.string()), ("collapsed", pa.string())]
    form = pa.schema(form if with_text else form[:-1])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in common.slices(b.column(1)):
                parts = [(x, *common.word_bounds(data[x:y], at if j - i > 1 else np.array([0, y - x]))) for x, y in (common.pieces(data, common.IN_WORD) if j - i == 1 else [(0, len(data))])]
                h = np.concatenate([common.word_hashes(data[x:], s, e, lower=False) if j - i > 1 else common.word_hashes(data[x : x + int(e[-1])], s, e, lower=False) for x, s, e, _ in parts if len(s)] or [np.empty(0, U)])
                start, end, doc = np.concatenate([x + s for x, s, _, _ in parts]), np.concatenate([x + e for x, _, e, _ in parts]), np.concatenate([d for *_, d in parts])
                first = np.searchsorted(doc, np.arange(j - i + 1))
                runs: list[list[dict]] = [[] for _ in range(j - i)]
                for s, e in zip(*_covered(h, doc)):
                    number: dict[bytes, int] = {}
                    words = [number.setdefault(data[x:y].tobytes(), len(number)) for x, y in zip(start[s:e].tolist(), end[s:e].tolist())]
                    lead = int(s - first[doc[s]])
                    runs[doc[s]] += [{"start": lead + a, "length": n, "period": q} for a, n, q in runs_of(words)]
                texts = [_kept(data, start[x:y], end[x:y], r) for x, y, r in zip(first[:-1], first[1:], runs)]
                columns = {"doc_id": b.column(0).slice(i, j - i), "n_words": np.diff(first), "runs": runs}
                columns["collapsed_sha256"] = [hashlib.sha256(t).hexdigest() for t in texts]
                if with_text:
                    columns["collapsed"] = [t.decode() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in form], schema=form)

    names = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string" + ", collapsed string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, names)


def _kept(data: np.ndarray, start: np.ndarray, end: np.ndarray, runs: list[dict]) -> bytes:
    """The words at [start, end), joined by one space, without those behind the first period of a run."""
    if not len(start):
        return b""
    if not runs:
        return b" ".join(data[start[0] : end[-1]].tobytes().split())
    edge = np.zeros(len(start) + 1, np.int64)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    raw = data.tobytes()
    return b" ".join(raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist()))
