"""Context-tree weighting: the probability of texts under a mixture of byte contexts of all depths up to a bound.

A text is read as its words in lower case (A-Z), each followed by a space, and a line feed at the end. A byte is eight
binary decisions, each with a context tree of its own: a node is the last d bytes (d = 0 to depth) and the bits of the
byte so far. A node that saw a zeros and b ones gives them the Krichevsky-Trofimov estimate
Pe = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1)) whatever their order, and weighs it against its children:
Pw = 1/2 Pe + 1/2 product of the children's Pw (at full depth Pw = Pe). So training is counting, and the tree's next bit has
the probability sum over d of (product of 1 - m over shallower nodes) * m * (count of the bit + 1/2) / (a + b + 1), with
m = Pe / 2 Pw, the share of a node that stops there (1 at full depth). Bytes before the text are line feeds.

The plan:

1. Documents are dealt to blocks of about BLOCK_BYTES of text by a hash. A block asks for each distinct gram (depth bytes
   and the next one) and word of its texts once, with its count in training documents. What it asks for is dealt to parts
   by a hash of all but a gram's last two bytes, and travels packed: one row for each block and part.
2. A part sums the counts over all blocks.
3. Grams meet by their last TOP bytes of context; those groups fill buckets, in which the nodes of depth TOP and more are
   weighed. The shallower levels, whose contexts spread over buckets, are sums over all of them in Spark.
4. From the root down, each node passes on what its mixture holds so far, again in Spark down to depth TOP and then in the
   buckets. That gives each gram of the corpus its probability, whether it was trained on or not.
5. Parts answer what the blocks asked, with values alone, in the order of the questions. A block meets its texts again, finds
   the same grams and words in them, and sums the values.

Nothing of the model is broadcast or collected but two numbers (training tokens and distinct ones). A part holds the grams
of a hash, each once for each block that asks; a bucket, whole groups of TOP context bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U

#: Bytes of text of one block, bytes of text for each part, and grams of one bucket, about.
BLOCK_BYTES, PART_BYTES, BUCKET_GRAMS = 16 << 20, 16 << 20, 50_000
#: Context bytes by which grams are dealt to buckets.
TOP = 4
#: Distinct grams that wait to be merged at most.
HELD = 1 << 20
#: The key of the token that ends each text.
END = 0

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ASKED = "block long, word boolean, part int, keys binary, n binary"


def log_gamma(x, log):
    """ln of the gamma function for x >= 1/2, of arrays or columns: Stirling's series, eight places further on."""
    z, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    r = 1 / (z * z)
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - log(product)


def log_estimate(zeros, ones, log):
    """ln of the Krichevsky-Trofimov probability of these counts, of arrays or columns of doubles."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1, log) - math.log(math.pi)


def _buffers(texts: pa.ChunkedArray, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, last row + 1, the bytes read with depth line feeds before each text, where each row begins in them, its words."""
    lead, part, begin, words, size, first = b"\n" * depth, [], [], [], 0, 0
    for i, x in enumerate(texts):
        w = (x.as_py() or "").encode().translate(_LOWER).split()
        begin.append(size)
        words.append(len(w))
        part += [lead, b" ".join(w), b" \n" if w else b"\n"]
        size += sum(map(len, part[-3:]))
        if size >= common.SLICE_BYTES:
            yield first, i + 1, np.frombuffer(b"".join(part), np.uint8), np.array(begin), np.array(words)
            part, begin, words, size, first = [], [], [], 0, i + 1
    if begin:
        yield first, first + len(begin), np.frombuffer(b"".join(part), np.uint8), np.array(begin), np.array(words)


def _grams(data: np.ndarray, begin: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of bytes that are read, a step of them after the other, and for each the gram: the byte before it as the highest, then the one before that, down to the byte itself."""
    read = np.ones(len(data), bool)
    for k in range(depth):
        read[begin + k] = False
    for a in range(depth, len(data), common.SLICE_BYTES):
        z = min(len(data), a + common.SLICE_BYTES)
        g = data[a:z].astype(U)
        for k in range(1, depth + 1):
            g |= data[a - k : z - k].astype(U) << U(8 * (depth + 1 - k))
        here = read[a:z]
        yield a + np.flatnonzero(here), g[here].view(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as their first bytes together, then all second ones, and so on, compressed."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def released(x: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences."""
    return squeezed(np.diff(x.view(U), prepend=U(0)))


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(released(x, U), dtype=U).view(np.int64)


def part_of(key: np.ndarray, word: bool, parts: int) -> np.ndarray:
    out = np.empty(len(key), np.int32)
    for a in range(0, len(key), common.SLICE_BYTES):
        z = a + common.SLICE_BYTES
        out[a:z] = common.mix(key[a:z].view(U) >> U(0 if word else 16)) % U(parts)
    return out


class Tally:
    """Distinct keys with their counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, times: int) -> None:
        key, n = np.unique(keys, return_counts=True)
        self.put(key, (n * times).astype(np.uint32))  # a block has few gigabytes

    def put(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.held += len(key)
        if self.held > HELD:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0]) // 2  # so that large totals are merged seldom

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) < 2:
            return self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.uint32))
        key, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first], np.add.reduceat(n, first, dtype=n.dtype)


def _distinct(docs: pa.Table, depth: int) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """The distinct grams (False) and words (True) of a block's texts, ascending, with their counts in training texts."""
    grams, words = Tally(), Tally()
    for chunk in docs.select(["held_out", "text"]).to_batches():
        for held_out in (False, True):
            texts, learned = chunk["text"].filter(pc.equal(chunk["held_out"], held_out)), int(not held_out)
            for _, _, data, begin, _ in _buffers(texts, depth):
                for _, g in _grams(data, begin, depth):
                    grams.add(g, learned)
                for x, y in common.pieces(data, common.IN_WORD):
                    start, end, _ = common.word_bounds(data[x:y], np.array([0, y - x]))
                    words.add(common.word_hashes(data[x:y], start, end, lower=False).view(np.int64), learned)
            words.put(np.array([END]), np.array([len(texts) * learned], np.uint32))
    return {False: grams.total(), True: words.total()}


def _by_part(key: np.ndarray, word: bool, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending keys by part, in which they ascend too, and where each part begins in it."""
    part = part_of(key, word, parts)
    order = np.argsort(part, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))


def _asked(depth: int, parts: int):
    """Of one block: its distinct grams and words with their counts in training texts, by part."""

    def of(docs: pa.Table) -> pa.Table:
        block, out = docs["block"][0].as_py(), {"block": [], "word": [], "part": [], "keys": [], "n": []}
        for word, (key, n) in _distinct(docs, depth).items():
            order, first = _by_part(key, word, parts)
            for p in np.flatnonzero(np.diff(first)).tolist():
                at = order[first[p] : first[p + 1]]
                for name, x in (("block", block), ("word", word), ("part", p), ("keys", packed(key[at])), ("n", squeezed(n[at]))):
                    out[name].append(x)
        kinds = {"block": pa.int64(), "word": pa.bool_(), "part": pa.int32(), "keys": pa.binary(), "n": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return of


def _summed(table: pa.Table) -> pa.Table:
    """Of one part: each key once, with its count over all blocks."""
    out = []
    for word in (False, True):
        some, total = table.filter(pc.equal(table["word"], word)), Tally()
        for keys, n in zip(some["keys"], some["n"]):
            total.put(unpacked(keys.as_py()), released(n.as_py(), np.uint32).astype(np.int64))
        out.append((word, *total.total()))
    key, n = (np.concatenate([x[c] for x in out]) for c in (1, 2))
    return pa.table([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out])), pa.array(np.full(len(key), table["part"][0].as_py(), np.int32)), pa.array(key), pa.array(n)], ["word", "part", "key", "n"])


def _answered(asked: pa.Table, values: pa.Table) -> pa.Table:
    """Of one part: for each row that asks, the values of its keys in order."""
    part, out = values["part"][0].as_py(), {"block": [], "word": [], "part": [], "values": []}
    for word in (False, True):
        some = values.filter(pc.equal(values["word"], word))
        key, value = common.int64(some["key"]), some["value"].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order].astype(np.float64 if word else np.float32)
        rows = asked.filter(pc.equal(asked["word"], word))
        for block, keys in zip(rows["block"].to_pylist(), rows["keys"]):
            for name, x in (("block", block), ("word", word), ("part", part), ("values", squeezed(value[np.searchsorted(key, unpacked(keys.as_py()))]))):
                out[name].append(x)
    kinds = {"block": pa.int64(), "word": pa.bool_(), "part": pa.int32(), "values": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


class Nodes:
    """The nodes of depth TOP and more over some grams (ascending unsigned numbers, whole groups of TOP context bytes)."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int) -> None:
        self.key, self.depth = key, depth
        self.id: dict[int, np.ndarray] = {}
        self.zeros: dict[int, np.ndarray] = {}
        self.ones: dict[int, np.ndarray] = {}
        for d in range(depth, TOP - 1, -1):
            c = ((key >> 8 * (depth + 1 - d)) << 8) | (key & 255)
            if d < depth:
                c, inverse = np.unique(c, return_inverse=True)
                m = np.bincount(inverse, weights=n, minlength=len(c))
            else:
                m = n.astype(float)
            ids, zeros, ones = [], [], []
            for b in range(8):
                node = self.node(c, b)
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                one = (c >> (7 - b)) & 1
                ids.append(node[first])
                zeros.append(np.add.reduceat(np.where(one, 0, m), first))
                ones.append(np.add.reduceat(np.where(one, m, 0), first))
            order = np.argsort(np.concatenate(ids))
            self.id[d], self.zeros[d], self.ones[d] = (np.concatenate(x)[order] for x in (ids, zeros, ones))
        self.above = {d: np.searchsorted(self.id[d - 1], (self.id[d] >> 16 << 8) | (self.id[d] & 255)) for d in range(TOP + 1, depth + 1)}
        self.estimate = {d: log_estimate(self.zeros[d], self.ones[d], np.log) for d in self.id}
        self.weighted = {depth: self.estimate[depth]}
        for d in range(depth - 1, TOP - 1, -1):
            children = np.bincount(self.above[d + 1], weights=self.weighted[d + 1], minlength=len(self.id[d]))
            self.weighted[d] = np.logaddexp(self.estimate[d], children) - math.log(2)

    @staticmethod
    def node(c: np.ndarray, b: int) -> np.ndarray:
        """Context, and a one before the first b bits of the byte."""
        return (c >> 8 << 8) | (1 << b) | ((c & 255) >> (8 - b))

    def values(self, zero: np.ndarray, one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability. For the nodes of depth TOP in order: what shallower nodes give the bits 0 and 1, and the weight they leave."""
        for d in range(TOP, self.depth + 1):
            if d > TOP:
                zero, one, rest = (x[self.above[d]] for x in (zero, one, rest))
            stop = np.exp(self.estimate[d] - self.weighted[d] - math.log(2)) if d < self.depth else 1.0
            part = rest * stop / (self.zeros[d] + self.ones[d] + 1)
            zero, one, rest = zero + part * (self.zeros[d] + 0.5), one + part * (self.ones[d] + 0.5), rest * (1 - stop)
        zero, one, out = np.log10(zero), np.log10(one), np.zeros(len(self.key))
        for b in range(8):
            at = np.searchsorted(self.id[self.depth], self.node(self.key, b))
            out += np.where((self.key >> (7 - b)) & 1, one[at], zero[at])
        return out


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, n = common.int64(table["key"]).view(U), common.int64(table["n"])
    order = np.argsort(key)
    return key[order], n[order]


def _roots(depth: int):
    def of(table: pa.Table) -> pa.Table:
        nodes = Nodes(*_ordered(table), depth)
        ids = nodes.id[TOP]
        return pa.table([(ids >> 8).astype(np.int64), (ids & 255).astype(np.int32), nodes.zeros[TOP], nodes.ones[TOP], nodes.weighted[TOP]], ["context", "bits", "zeros", "ones", "weighted"])

    return of


def _valued(depth: int, parts: int):
    def of(grams: pa.Table, tops: pa.Table) -> pa.Table:
        nodes = Nodes(*_ordered(grams), depth)
        order = np.argsort((common.int64(tops["context"]) << 8) | common.int64(tops["bits"]))
        key = nodes.key.view(np.int64)
        return pa.table([part_of(key, False, parts), key, nodes.values(*(tops[c].to_numpy()[order] for c in ("zero", "one", "rest")))], ["part", "key", "value"])

    return of


def _log_sum(x: Column, y: Column) -> Column:
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def _level(below: DataFrame) -> DataFrame:
    """The nodes one byte of context shallower than those of below."""
    out = below.groupBy(F.shiftright("context", 8).alias("context"), "bits").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
    out = out.withColumn("estimate", log_estimate(F.col("zeros"), F.col("ones"), F.log))
    return out.select("context", "bits", "zeros", "ones", "estimate", (_log_sum(F.col("estimate"), F.col("children")) - math.log(2)).alias("weighted"))


def _passed_on(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """context, bits, and what the mixture down to these nodes gives the bits 0 and 1 and leaves to deeper ones."""
    stop = F.exp(F.col("estimate") - F.col("weighted") - math.log(2))
    part = F.col("rest") * stop / (F.col("zeros") + F.col("ones") + 1)
    if above is None:
        nodes = nodes.withColumns({"zero": F.lit(0.0), "one": F.lit(0.0), "rest": F.lit(1.0)})
    else:
        nodes = nodes.withColumn("upper", F.shiftright("context", 8)).join(above.withColumnRenamed("context", "upper"), ["upper", "bits"])
    return nodes.select("context", "bits", (F.col("zero") + part * (F.col("zeros") + 0.5)).alias("zero"), (F.col("one") + part * (F.col("ones") + 0.5)).alias("one"), (F.col("rest") * (1 - stop)).alias("rest"))


def gram_values(grams: DataFrame, depth: int, parts: int = 1) -> DataFrame:
    """part, key, value: log10 of the probability of each gram's last byte after its context. grams: key, n (times in training), distinct and stored."""
    spark = grams.sparkSession
    buckets = max(1, -(-grams.count() // BUCKET_GRAMS))
    bucket = lambda context: F.pmod(F.xxhash64(context), F.lit(buckets)).cast("int").alias("bucket")
    dealt = grams.select(bucket(F.shiftrightunsigned("key", 8 * (depth + 1 - TOP))), "key", "n")
    roots = common.written(dealt.groupBy("bucket").applyInArrow(_roots(depth), "context long, bits int, zeros double, ones double, weighted double"), "ctw-roots", "zstd")
    levels = [common.written(_level(roots), "ctw-level", "zstd")]
    while len(levels) < TOP:
        levels.append(_level(levels[-1]))
    passed = None
    for nodes in reversed(levels):
        passed = _passed_on(nodes, passed)
    above = passed.withColumnRenamed("context", "upper")
    tops = roots.select("context", "bits", F.shiftright("context", 8).alias("upper")).join(above, ["upper", "bits"]).select(bucket(F.col("context")), "context", "bits", "zero", "one", "rest")
    return dealt.groupBy("bucket").cogroup(tops.groupBy("bucket")).applyInArrow(_valued(depth, parts), "part int, key long, value double")


def _lookup(keys: np.ndarray, values: np.ndarray):
    """A function from arrays of these keys to their values: tables by hash, each for the keys that found no slot in the one before."""
    tables, left, k = [], np.arange(len(keys)), 0
    bits = max(4, int(2 * len(keys)).bit_length())
    while len(left):
        slot = ((keys[left].view(U) * U(_MULTIPLIERS[k % len(_MULTIPLIERS)])) >> U(64 - bits)).astype(np.int64)
        table = np.zeros(1 << bits, np.int32)
        table[slot] = left
        tables.append((table, bits, _MULTIPLIERS[k % len(_MULTIPLIERS)]))
        left = left[table[slot] != left]
        bits, k = max(4, min(bits, int(4 * len(left)).bit_length())), k + 1

    def find(asked: np.ndarray) -> np.ndarray:
        out, left = np.empty(len(asked), np.int32), None
        for table, bits, multiplier in tables:
            q = asked if left is None else asked[left]
            at = table[((q.view(U) * U(multiplier)) >> U(64 - bits)).astype(np.int64)]
            miss = np.flatnonzero(keys[at] != q)
            if left is None:
                out, left = at, miss
            else:
                out[left] = at
                left = left[miss]
            if not len(left):
                break
        return values[out].astype(float)

    return find


_MULTIPLIERS = [int(x) | 1 for x in np.random.default_rng(7).integers(1 << 62, 1 << 63, 64)]


def _scored(depth: int, parts: int, tokens: int, distinct: int):
    share = math.log10(tokens + distinct + 1)

    def of(docs: pa.Table, answers: pa.Table) -> pa.Table:
        find = {}
        for word, (key, _) in _distinct(docs, depth).items():
            some = answers.filter(pc.equal(answers["word"], word)).sort_by("part")["values"]
            value = np.concatenate([released(x.as_py(), np.float64 if word else np.float32) for x in some])
            key = key[_by_part(key, word, parts)[0]]
            find[word] = _lookup(key, np.log10(value + 1) if word else value)
        gram, word = find[False], find[True]
        end = word(np.array([END]))
        total, base, known, words, size = (np.zeros(len(docs)) for _ in range(5))
        for i, j, data, begin, w in _buffers(docs["text"].combine_chunks(), depth):
            row = lambda at: np.searchsorted(begin, at, "right") - 1 + i
            for at, g in _grams(data, begin, depth):
                _add(total, row(at[[0, -1]]), begin, at, gram(g), i)
            for x, y in common.pieces(data, common.IN_WORD):
                start, stop, _ = common.word_bounds(data[x:y], np.array([0, y - x]))
                if len(start):
                    v = word(common.word_hashes(data[x:y], start, stop, lower=False).view(np.int64))
                    at = start + x
                    _add(base, row(at[[0, -1]]), begin, at, v, i)
                    _add(known, row(at[[0, -1]]), begin, at, (v > 0).astype(float), i)
            words[i:j] = w
            size[i:j] = np.diff(np.append(begin, len(data))) - depth
        n = words + 1
        base += end[0] - n * share
        known += bool(end[0] > 0)
        count = lambda x: pa.array(x.astype(np.int64))
        columns = [docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), count(n), count(known), pa.array(np.full(len(docs), tokens)), pa.array(base), pa.array(total), count(size)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    return of


def _add(total: np.ndarray, rows: np.ndarray, begin: np.ndarray, at: np.ndarray, value: np.ndarray, lead: int) -> None:
    """Adds value, at ascending places, to the rows that begin at the places begin (row lead first)."""
    if len(at):
        first = np.searchsorted(at, begin[rows[0] - lead : rows[1] + 1 - lead])
        first[0] = 0
        some = np.append(first[1:], len(at)) > first
        total[rows[0] : rows[1] + 1][some] += np.add.reduceat(value, first[some])


def context_tree_scores(docs: DataFrame, depth: int = 6, parts: int = 7, which: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: one row for each row of docs.

    docs: doc_id, text; other columns are ignored. Documents whose crc32(doc_id as text) mod parts is which are held out: they
    are scored and not learned. Tokens are the words in lower case (A-Z) and one end; n_known of them occur in training.
    base_score: sum of log10 of (count in training + 1) / (train_tokens + distinct training tokens + 1). score: log10 of
    the text's probability; bits_per_byte: its code length by the n_bytes read. Null and empty texts are an end alone. Rows without
    doc_id are learned; rows that repeat a doc_id count and are scored each for itself; equal rows share a block. Without
    training texts each bit has probability 1/2. Words are told apart by 64-bit hashes. depth: 4 to 7.
    """
    if not TOP <= depth <= 7:
        raise ValueError(f"depth {depth} is not from {TOP} to 7")
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", common.is_held_out(parts, which))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, parts_ = 1 + size // BLOCK_BYTES, 1 + size // PART_BYTES
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = common.written(docs.groupBy("block").applyInArrow(_asked(depth, parts_), _ASKED), "ctw-asked", "zstd")
    counts = common.written(asked.groupBy("part").applyInArrow(_summed, "word boolean, part int, key long, n long"), "ctw-counts", "zstd")
    known = counts.where("word and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    grams = gram_values(counts.where("not word").select("key", "n"), depth, parts_).select(F.lit(False).alias("word"), "part", "key", "value")
    words = counts.where("word").select("word", "part", "key", F.col("n").cast("double").alias("value"))
    values = common.written(grams.unionByName(words), "ctw-values", "zstd")
    answers = asked.select("part", "block", "word", "keys").groupBy("part").cogroup(values.groupBy("part")).applyInArrow(_answered, "block long, word boolean, part int, values binary")
    form = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(depth, parts_, known["tokens"], known["distinct"]), form)
    return out.withColumn("bits_per_byte", F.col("score") * -math.log2(10) / F.col("n_bytes"))
