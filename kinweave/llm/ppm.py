"""Language-model scores by prediction by partial matching (PPM-C with exclusion).

The model is a trie of byte contexts of up to ``ORDER`` bytes, held as one sorted
table of n-grams per order. A symbol seen in the longest known context is coded
there with count / (total + distinct); otherwise an escape of distinct / (total +
distinct) leads to the next shorter context, where the symbols of the longer one
are excluded from totals and distinct counts, down to an even share among the
symbols never seen. Every text ends with an end symbol, so the probabilities of
all texts add up to one.

Pretrained: counts come from all training texts. Counting happens in map tasks,
which sort packed n-grams, and one keyed aggregation. All n-grams and contexts are
kept as tables. The ``MAX_GRAMS`` most frequent leaves are broadcast with their
probabilities; n-grams outside that part, rare or never seen, meet the tables in
joins, so its size bounds memory and changes no score.

Adaptive: :func:`adaptive_log10` learns from the text it codes, from nothing.

Texts are UTF-8 bytes with A-Z lower-cased; null is empty. An empty corpus gives
the even model.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import kernels as K
from kinweave.llm.common import materialise

ORDER = 5
MAX_GRAMS = 1 << 21
MAX_WORDS = 1 << 20
#: Bytes that UTF-8 never has: what stands before a text, and its end.
START, END = 0xFF, 0xFE
#: Byte values that can be coded: all but START.
SYMBOLS = 255
#: Entries a task merges at a time, and bytes of text it codes at a time: two workers share an executor.
FLUSH = 2_000_000
CHUNK = 1 << 19
GRAM, WORD, TEXT = 0, 1, 2


def held_out(fold: int = 2, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def packed(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1)-byte keys, context then symbol, of every byte and end of the texts; offsets of the texts in them."""
    n, pad = len(off) - 1, order + 1
    out = np.full(len(data) + n * pad, START, np.uint8)
    shift = np.repeat(np.arange(n) * pad + order, np.diff(off))
    out[np.arange(len(data)) + shift] = data
    out[off[1:] + np.arange(1, n + 1) * pad - 1] = END
    key = np.zeros(len(out), np.uint64)
    for k in range(pad):
        key[k:] |= out[: len(out) - k].astype(np.uint64) << np.uint64(8 * k)
    coded = np.ones(len(out), bool)
    first = off[:-1] + np.arange(n) * pad
    for k in range(order):
        coded[first + k] = False
    return key[coded], off + np.arange(n + 1)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


class Tally:
    """Counts of one kind, merged now and then, handed out when they get many."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = tally(keys)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > FLUSH:
            merged = tally(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.size = [merged], len(merged[0])
            if self.size > FLUSH // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, n = tally(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.size = [], 0
            for lo in range(0, len(keys), 100_000):
                k = keys[lo : lo + 100_000].view(np.int64)
                kind = np.full(len(k), self.kind, np.int32)
                yield pa.record_batch({"kind": kind, "key": k, "n": n[lo : lo + 100_000]})


def count_corpus(training: DataFrame) -> DataFrame:
    """(kind, key, n): n-grams, hashed words and the number of texts of the whole training corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, texts = Tally(GRAM), Tally(WORD), 0
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(0), CHUNK):
                data = K.LOWER[data]
                yield from grams.add(packed(data, off)[0])
                start, end, _ = K.words(data, off)
                yield from words.add(K.span_hashes(K.prefix_sums(data), start, end))
                texts += hi - lo
        yield from grams.flush()
        yield from words.flush()
        yield pa.record_batch({"kind": np.array([TEXT], np.int32), "key": np.zeros(1, np.int64), "n": np.array([texts], np.int64)})

    parts = training.select("text").mapInArrow(run, "kind int, key long, n long")
    return materialise(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def frequent(rows: DataFrame, limit: int, value: str = "n") -> tuple[np.ndarray, np.ndarray, int]:
    """The keys with the largest counts, ``limit`` at most, ascending, their values, and the least count among them."""
    by_count = rows.groupBy(F.least("n", F.lit(1 << 16)).alias("c")).count().orderBy(F.desc("c")).toLocalIterator()
    kept, least = 0, 1 << 62
    for c, k in by_count:
        if kept + k > limit:
            break
        kept, least = kept + k, c
    table = rows.filter(F.col("n") >= least).select("key", value).toArrow()
    keys, found = table["key"].to_numpy().astype(np.int64).view(np.uint64), table[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], found[order], least


def suffix(m: int) -> Column:
    """The n-gram of order ``m`` at the end of a key."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * (m + 1)) - 1))


def model(leaves: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """By order, all n-grams (key, n) and all contexts (context, total, distinct, covered).

    ``covered`` is what a context's symbols weigh in the next shorter one.
    """
    grams, contexts = {ORDER: leaves}, {}
    for m in range(ORDER, -1, -1):
        rows = grams[m].withColumn("_covers", F.lit(0).cast("long"))
        if m:
            grams[m - 1] = materialise(grams[m].groupBy(suffix(m - 1).alias("key")).agg(F.sum("n").alias("n")), "grams")
            shorter = grams[m - 1].select(F.col("key").alias("_shorter"), F.col("n").alias("_covers"))
            rows = grams[m].withColumn("_shorter", suffix(m - 1)).join(shorter, "_shorter")
        table = rows.groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count("n").alias("distinct"), F.sum("_covers").alias("covered")
        )
        contexts[m] = materialise(table, "contexts")
    return grams, contexts


def bounded(table: DataFrame, n_bytes: int) -> DataFrame:
    """Tables keyed by up to two bytes have 65536 rows at most and are broadcast."""
    return F.broadcast(table) if n_bytes <= 2 else table


def walk(asked: DataFrame, grams: dict[int, DataFrame], contexts: dict[int, DataFrame]) -> DataFrame:
    """(key, log) of distinct keys with ``log`` null where no leaf is known: those escape from the longest known context down."""
    zero = F.lit(0).cast("long")
    rows = asked.select("key", F.col("log").isNotNull().alias("done"), F.coalesce("log", F.lit(0.0)).alias("log"), zero.alias("known"), zero.alias("weigh"))
    for m in range(ORDER, -1, -1):
        rows = rows.withColumn("context", F.shiftright(suffix(m), 8)).join(bounded(contexts[m], m), "context", "left")
        if m < ORDER:
            found = grams[m].select(F.col("key").alias("_gram"), "n")
            rows = rows.withColumn("_gram", suffix(m)).join(bounded(found, m + 1), "_gram", "left")
        else:
            rows = rows.withColumn("n", F.lit(None).cast("long"))
        here, hit = ~F.col("done") & F.col("total").isNotNull(), F.col("n").isNotNull()
        fresh = F.col("distinct") - F.col("known")
        share = F.coalesce("n", fresh) / F.greatest(F.col("total") - F.col("weigh") + fresh, F.lit(1))
        rows = rows.select(
            "key", (F.col("done") | (here & hit)).alias("done"),
            (F.col("log") + F.when(here & (hit | (fresh > 0)), F.log10(share)).otherwise(0.0)).alias("log"),
            F.when(here, F.col("distinct")).otherwise(F.col("known")).alias("known"),
            F.when(here, F.col("covered")).otherwise(F.col("weigh")).alias("weigh"),
        )
    even = F.log10(F.greatest(F.lit(SYMBOLS) - F.col("known"), F.lit(1)))
    return rows.select("key", (F.col("log") - F.when(F.col("done"), 0.0).otherwise(even)).alias("log"))


class Lookup:
    """Open-addressing table from distinct 64-bit keys to their rows, probed for whole arrays at once; holds rows only."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = keys if len(keys) else np.zeros(1, np.uint64)
        self.row = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.row[slot] < 0
            s, t = slot[free], todo[free]
            self.row[s] = t
            lost = self.row[s] != t
            todo = np.concatenate((todo[~free], t[lost]))
            slot = (np.concatenate((slot[~free], s[lost])) + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        row = self.row[slot]
        other = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(other):
            at = (slot[other] + 1) & self.mask
            slot[other] = at
            row[other] = self.row[at]
            other = other[(row[other] >= 0) & (self.keys[row[other]] != keys[other])]
        return row


class Trie:
    """Static PPM-C in memory: log10 probability of a symbol after a context, for arrays of packed keys.

    The tables of :func:`model` give the same values for any number of n-grams.
    Built from distinct keys in ascending order, which are shared and not copied, and their counts.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.grams, self.contexts, first_of = {}, {}, {}
        for m in range(order, -1, -1):
            if m < order:
                keys, counts = tally(keys & np.uint64((1 << 8 * (m + 1)) - 1), counts)
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            self.grams[m] = (Lookup(keys), counts)
            self.contexts[m] = (Lookup(context[first]), total, np.diff(np.append(first, len(keys))))
            first_of[m] = first
        self.covered = {}  # what a context's symbols weigh in the next shorter one
        for m in range(order, 0, -1):
            keys, first = self.grams[m][0].keys, first_of[m]
            row = self.grams[m - 1][0].find(keys & np.uint64((1 << 8 * m) - 1))
            self.covered[m] = np.add.reduceat(self.grams[m - 1][1][row], first) if len(first) else np.zeros(0, np.int64)
        counts = self.grams[order][1]
        _, total, distinct = self.contexts[order]
        self.seen = np.log10(counts / np.repeat(total + distinct, distinct))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        row = self.grams[self.order][0].find(keys)
        out = self.seen[row] if len(self.seen) else np.zeros(len(keys))
        missed = np.flatnonzero(row < 0)
        if len(missed):
            rare, back = np.unique(keys[missed], return_inverse=True)
            out[missed] = self.escape(rare)[back]
        return out

    def escape(self, keys: np.ndarray) -> np.ndarray:
        """The whole walk from the longest known context down."""
        out, todo = np.zeros(len(keys)), np.ones(len(keys), bool)
        weigh, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded so far
        for m in range(self.order, -1, -1):
            key = keys & np.uint64((1 << 8 * (m + 1)) - 1)
            where, total, distinct = self.contexts[m]
            at = where.find(key >> np.uint64(8))
            here = todo & (at >= 0)
            if not here.any():
                continue
            a = at[here]
            left, fresh = total[a] - weigh[here], distinct[a] - known[here]
            row = self.grams[m][0].find(key[here])
            hit = row >= 0
            share = np.where(hit, self.grams[m][1][row], fresh) / np.maximum(left + fresh, 1)
            out[here] += np.where(hit | (fresh > 0), np.log10(np.maximum(share, 1e-300)), 0.0)
            known[here] = distinct[a]
            weigh[here] = self.covered[m][a] if m else 0
            todo[np.flatnonzero(here)[hit]] = False
        out[todo] -= np.log10(np.maximum(SYMBOLS - known[todo], 1))
        return out


_loaded: dict[str, tuple] = {}


def _load(name: str, shared) -> tuple:
    """Leaf and word tables of a broadcast, built once per worker process."""
    if name not in _loaded:
        _loaded.clear()
        grams, gram_logs, words, n = shared.value
        _loaded[name] = Lookup(grams), gram_logs, Lookup(words), np.log10(n + 1.0)
    return _loaded[name]


def score(documents: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = documents.sparkSession
    counts = count_corpus(training)
    texts = counts.filter(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    vocabulary, tokens = counts.filter(F.col("kind") == WORD).agg(F.count("key"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, vocabulary = tokens + texts, vocabulary + (texts > 0)
    grams, contexts = model(counts.filter(F.col("kind") == GRAM).select("key", "n"))
    leaves = grams[ORDER].withColumn("context", F.shiftright("key", 8)).join(contexts[ORDER], "context")
    leaves = materialise(leaves.select("key", "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("log")), "leaves")
    common_grams, gram_logs, least_gram = frequent(leaves, MAX_GRAMS, "log")
    words, word_counts, least = frequent(counts.filter(F.col("kind") == WORD), MAX_WORDS)
    shared, name = spark.sparkContext.broadcast((common_grams, gram_logs, words, word_counts)), uuid.uuid4().hex
    end_log, end_known = math.log10(texts + 1), int(texts > 0)
    fields = [documents.schema["doc_id"], T.StructField("held_out", T.BooleanType())]
    for column, kind in (("n_tokens", T.LongType()), ("_known", T.LongType()), ("_log", T.DoubleType()), ("_score", T.DoubleType()), ("_rare", T.ArrayType(T.LongType())), ("_grams", T.ArrayType(T.LongType()))):
        fields.append(T.StructField(column, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, leaf_logs, table, logs = _load(name, shared)
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(2), CHUNK):
                data = K.LOWER[data]
                keys, bounds = packed(data, off)
                row = leaf.find(keys)
                missed = row < 0
                log = np.zeros(len(keys))
                log[~missed] = leaf_logs[row[~missed]]
                run_sum = np.concatenate(([0.0], np.cumsum(log)))
                n_missed = np.concatenate(([0], np.cumsum(missed)))[bounds].astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(n_missed), pa.array(keys[missed].view(np.int64)))
                start, end, before = K.words(data, off)
                word = K.span_hashes(K.prefix_sums(data), start, end)
                row = table.find(word)
                common = row >= 0
                owner = np.repeat(np.arange(hi - lo), np.diff(before))
                log = np.bincount(owner[common], weights=logs[row[common]], minlength=hi - lo) + end_log
                known = np.bincount(owner[common], minlength=hi - lo) + end_known
                rare = np.concatenate(([0], np.cumsum(np.bincount(owner[~common], minlength=hi - lo)))).astype(np.int32)
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), np.diff(before) + 1, known, log]
                cols += [run_sum[bounds[1:]] - run_sum[bounds[:-1]], pa.ListArray.from_arrays(pa.array(rare), pa.array(word[~common].view(np.int64))), grams]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[f.name for f in fields])

    marked = documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, T.StructType(fields))
    scored = materialise(marked.withColumn("_row", F.monotonically_increasing_id()), "scored")
    # words outside the broadcast table meet their counts in a join
    rare = scored.select("_row", F.explode("_rare").alias("key"))
    rest = counts.filter((F.col("kind") == WORD) & (F.col("n") < least)).select("key", "n")
    met = rare.join(rest, "key", "left").groupBy("_row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("_more"), F.count("n").alias("_seen")
    )
    # n-grams outside the broadcast part meet the tables: leaves first, then the walk down for what was never seen
    missed = scored.select("_row", F.explode("_grams").alias("key"))
    fewer = leaves.filter(F.col("n") < least_gram).select("key", "log")
    asked = missed.select("key").distinct().join(fewer, "key", "left")
    told = materialise(walk(asked, grams, contexts), "walked")
    walked = missed.join(told, "key").groupBy("_row").agg(F.sum("log").alias("_walked"))
    return scored.join(met, "_row", "left").join(walked, "_row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_log") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * math.log10(tokens + vocabulary + 1)).alias("base_score"),
        (F.col("_score") + F.coalesce("_walked", F.lit(0.0))).alias("score"),
    )


def score_query(documents: DataFrame) -> DataFrame:
    return score(documents, documents.filter(~held_out()))


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that learns it symbol by symbol."""
    trie: dict[bytes, dict[int, int]] = {}
    history, total = bytes([START]) * order, 0.0
    for symbol in (*text, END):
        excluded: set[int] = set()
        for m in range(order, -1, -1):
            here = {s: n for s, n in trie.get(history[len(history) - m :], {}).items() if s not in excluded}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if symbol in here:
                total += math.log10(here[symbol] / whole)
                break
            total += math.log10(len(here) / whole)
            excluded |= here.keys()
        else:
            total -= math.log10(max(SYMBOLS - len(excluded), 1))
        for m in range(order + 1):
            node = trie.setdefault(history[len(history) - m :], {})
            node[symbol] = node.get(symbol, 0) + 1
        history = (history + bytes([symbol]))[-order:] if order else b""
    return total
