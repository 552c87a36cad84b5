"""N-gram Jaccard join of whole texts by prefix trees over globally ordered sets.

The set of a text holds its distinct five-word shingles (64-bit hashes); a text
of fewer words has its whole word sequence as one shingle. Sets are sorted in one
global order, rare shingles first, by counts over all texts. Two sets of similarity
0.8 share a shingle within their first 20 %, so only sets that share such a prefix
shingle are compared. As shingles that occur once come first, a set that differs
from all others in more than its prefix is never compared at all.

Counting is exact and nothing of it is broadcast: map tasks send the distinct
shingles of every block of texts to buckets by hash range, buckets send the counts
of those that occur elsewhere too back to the blocks, and blocks order their sets.

Equal sets are one node from the start. Then links are sought in two phases:

1. Stars. Per prefix shingle every set meets only the most central set that holds
   it. A hub and its partners, ``TRIE_SETS`` a task, are joined in a prefix tree.
   This links families of near copies without listing their pairs.
2. The rest. Only prefix shingles that still hold two components are left. Their
   sets of different components are paired, bounded by what the prefixes leave
   possible, and the survivors verified by the same trees.

A tree holds the ordered sets; the hub's set walks down it, sets that share a path
share its partial overlap, and a subtree is left when the overlap so far plus the
shorter remainder cannot reach the threshold.

Texts that are null or have no word have an empty set and link with nothing. Rows
without id get no component. Rows that repeat an id are one node for each text;
each gets the component of its own text. Ids are whole numbers. Other columns are
not read. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import idfilter
from kinweave.llm import kernels as K
from kinweave.llm.common import materialise
from kinweave.llm.components import components

WORDS = 5
PERCENT = 80
TRIE_SETS = 256
#: Shingles that a bucket counts, about: the number of buckets follows the size of the texts.
BUCKET_KEYS = 1 << 19
#: Texts of a block at most, so that two bytes number them, and the count in a block from which on one byte does not do.
BLOCK_ROWS, MANY = 60_000, 255
DOC, KEYS, SHARED = 0, 1, 2
PARTS = "bucket int, block long, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 63-bit shingle hashes of each text, ascending, and the offsets of the texts in them."""
    data = K.LOWER[data]
    start, end, before = K.words(data, off)
    word = K.span_hashes(K.prefix_sums(data), start, end)
    n_words = np.diff(before)
    n = len(n_words)
    many = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        many = many * np.uint64(K.BASE) + word[k : len(word) - WORDS + 1 + k]
    owner = np.repeat(np.arange(n), n_words)
    whole = owner[: len(many)] == owner[WORDS - 1 :] if len(many) else np.zeros(0, bool)
    value, text = [K.mix64(many[whole])], [owner[: len(many)][whole]]
    for i in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
        h = np.uint64(n_words[i])
        with np.errstate(over="ignore"):
            for w in word[before[i] : before[i + 1]]:
                h = h * np.uint64(K.BASE) + w
        value.append(K.mix64(np.array([h])))
        text.append(np.array([i]))
    value, text = np.concatenate(value) >> np.uint64(1), np.concatenate(text)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(n + 1))


def set_ids(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that does not depend on the order; 0 for the empty set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix64(value + np.uint64(0x51ED270B)))))
    out = K.mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))
    out[at[1:] == at[:-1]] = 0
    return out


def prefix_length(n):
    """How many of n ordered shingles must be looked at so that a partner cannot be missed."""
    return n - (PERCENT * n + 99) // 100 + 1


def needed(a, b):
    """Least overlap of sets of a and b shingles at the threshold: 100 * i >= PERCENT * (a + b - i)."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def bucket_bits(documents: DataFrame) -> int:
    """Bits of a shingle that name its bucket: a shingle takes about four bytes of text."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(28, max(6, (size // (4 * BUCKET_KEYS)).bit_length()))


def _cells(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary cells of the runs of ``data`` that begin at ``at``."""
    off = (np.append(at, len(data)) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"bucket": pa.int32(), "block": pa.int64(), "kind": pa.int32()}
    full = [pa.array(columns[c], kinds[c]) for c in kinds] + [columns.get(c, pa.nulls(n, pa.binary())) for c in "abcdefg"]
    return pa.record_batch(full, names=[*kinds, *"abcdefg"])


def blocks(documents: DataFrame, bits: int, many_from: int = MANY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every block of texts as one DOC row - ids, their validity, set names, sizes, and texts of its most common tokens -
    and, per bucket, one KEYS row: its distinct tokens there, their numbers of texts, and these texts.

    A token is a shingle's first ``bits`` + 32 bits, the bucket in front. Tokens only
    order the sets; a token that two shingles share makes candidates, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = (TaskContext.get().partitionId() << 32) - 1, set()
        for whole in batches:
            for row in range(0, whole.num_rows, block_rows):
                b = whole.slice(row, block_rows)
                for lo, hi, data, off in K.chunks(b.column(1)):
                    block += 1
                    value, at = shingles(data, off)
                    name, n = set_ids(value, at), np.diff(at)
                    fresh = np.array([(x not in seen and not seen.add(x)) for x in name.tolist()], bool) & (n > 0)
                    mine = np.repeat(fresh, n)
                    token = value[mine] >> np.uint64(31 - bits)
                    order = np.argsort(token, kind="stable")
                    token, text = token[order], np.repeat(np.arange(hi - lo), n)[mine][order].astype(np.uint16)
                    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
                    count = np.diff(np.append(first, len(token)))
                    key = token[first]
                    many = count >= many_from
                    apart = np.repeat(many, count)
                    ids = b.column(0).slice(lo, hi - lo).cast(pa.int64())
                    known = ids.is_valid().to_numpy(zero_copy_only=False)
                    ids = ids.fill_null(0).to_numpy()
                    one = np.zeros(1, np.int64)
                    yield _batch(
                        bucket=[block % (1 << bits)], block=[block], kind=[DOC],
                        a=_cells(ids, one), b=_cells(known.astype(np.uint8), one), c=_cells(name, one), d=_cells(n.astype(np.int64), one),
                        e=_cells(key[many], one), f=_cells(count[many], one), g=_cells(text[apart], one),
                    )
                    bucket = (key >> np.uint64(32)).astype(np.int32)
                    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(key) else np.zeros(0, np.int64)
                    sent = np.concatenate(([0], np.cumsum(np.where(many, 0, count))))
                    yield _batch(
                        bucket=bucket[start], block=np.full(len(start), block), kind=np.full(len(start), KEYS, np.int32),
                        a=_cells(key.astype(np.uint32), start), b=_cells(np.minimum(count, many_from).astype(np.uint8), start), c=_cells(text[~apart], sent[start]),
                    )
        K.tidy()

    return documents.select("doc_id", "text").mapInArrow(run, PARTS)


def _numbers(cells: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in cells]


def _count_task(table: pa.Table, many: int = MANY) -> pa.Table:
    """Passes DOC rows on; of KEYS rows the tokens that occur in other texts too, with their rank by count (0 to 255)."""
    kind = table["kind"].to_numpy()
    out = [table.filter(pa.array(kind == DOC))]
    rows = table.filter(pa.array(kind == KEYS))
    if rows.num_rows:
        keys, counts, texts = _numbers(rows["a"], np.uint32), _numbers(rows["b"], np.uint8), _numbers(rows["c"], np.uint16)
        every, weight = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(every, kind="stable")
        new = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        total = np.empty(len(every), np.int64)
        total[order] = np.add.reduceat(weight[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        shared = total > 1
        rank = np.minimum(255, np.log2(total) * 8).astype(np.uint8)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        sent = np.where(weight < many, weight, 0)
        begin = np.searchsorted(owner[shared], np.arange(len(keys)))
        before = np.concatenate(([0], np.cumsum(sent[shared])))
        token = (np.uint64(rows["bucket"][0].as_py()) << np.uint64(32)) | every[shared].astype(np.uint64)
        batch = _batch(
            bucket=rows["bucket"].to_numpy(), block=rows["block"].to_numpy(), kind=np.full(len(keys), SHARED, np.int32),
            a=_cells(token, begin), b=_cells(rank[shared], begin), c=_cells(weight[shared].astype(np.uint8), begin),
            d=_cells(np.concatenate(texts)[np.repeat(shared, sent)], before[begin]),
        )
        out.append(pa.Table.from_batches([batch]).filter(pa.array(np.diff(np.append(begin, shared.sum())) > 0)))
    return pa.concat_tables([t.cast(out[-1].schema) for t in out])


def _order_task(table: pa.Table, many: int = MANY) -> pa.Table:
    """(token, node, n, pos) of the shared tokens in the ordered prefixes of a block's sets."""
    kind = table["kind"].to_numpy()
    doc, rows = table.filter(pa.array(kind == DOC)), table.filter(pa.array(kind == SHARED))
    if not rows.num_rows or not doc.num_rows:
        return pa.table({"token": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "pos": pa.array([], pa.int32())})
    get = lambda t, c, k: np.concatenate(_numbers(t[c], k))
    name, n = get(doc, "c", np.int64), get(doc, "d", np.int64)
    token, rank, count = get(rows, "a", np.uint64), get(rows, "b", np.uint8), get(rows, "c", np.uint8).astype(np.int64)
    few = count < many
    text = [get(rows, "d", np.uint16)]
    parts = [(np.repeat(token[few], count[few]), np.repeat(rank[few], count[few]))]
    if not few.all():  # tokens of very many texts of the block travel with the block
        key, times = get(doc, "e", np.uint64), get(doc, "f", np.int64)
        place = np.searchsorted(key, token[~few])
        by_key = np.zeros(len(key), np.uint8)
        by_key[place] = rank[~few]
        parts.append((np.repeat(key, times), np.repeat(by_key, times)))
        text.append(get(doc, "g", np.uint16))
    text, token, rank = np.concatenate(text).astype(np.int64), *(np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((token, rank, text))
    text, token = text[order], token[order]
    have = np.bincount(text, minlength=len(n))
    pos = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have) + (n - have)[text]
    take = pos < prefix_length(n)[text]
    text, pos = text[take], pos[take]
    return pa.table({"token": token[take].view(np.int64), "node": name[text], "n": n[text].astype(np.int32), "pos": pos.astype(np.int32)})


def unpack(described: DataFrame) -> DataFrame:
    """(doc_id, node, n_shingles) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, valid, c, d in zip(*(b.column(i) for i in range(4)), strict=True):
                ids = np.frombuffer(a.as_buffer(), np.int64)
                known = np.frombuffer(valid.as_buffer(), np.uint8).astype(bool)
                cols = [pa.array(ids, mask=~known), pa.array(np.frombuffer(c.as_buffer(), np.int64)), pa.array(np.frombuffer(d.as_buffer(), np.int64))]
                yield pa.record_batch(cols, names=["doc_id", "node", "n_shingles"])

    return described.filter(F.col("kind") == DOC).select(*"abcd").mapInArrow(run, "doc_id long, node long, n_shingles long")


def fetch_sets(documents: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, key) of the nodes asked for: their ordered sets, packed; texts are found by the id of one owner."""
    asked = materialise(owners.join(nodes, "node", "left_semi").select("doc_id"), "asked")
    bitmap = idfilter.build(asked, idfilter.bits_for(asked.count()))
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(idfilter.passes(shared.value, b.column(0).cast(pa.int64()))))
            for _, _, data, off in K.chunks(b.column(1)):
                value, at = shingles(data, off)
                packed = [value[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([pa.array(set_ids(value, at).view(np.int64)), pa.array(packed, pa.binary())], names=["node", "key"])
        K.tidy()

    found = documents.select("doc_id", "text").mapInArrow(run, "node long, key binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def tree_join(hub: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the ordered sets reach the threshold with ``hub``: a walk over their prefix tree.

    Sorted, the sets lie in the tree's depth-first order; what one shares with the
    one before is the path they have in common, whose partial overlap is kept.
    """
    linked = np.zeros(len(sets), bool)
    walk = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    path, overlap, cut = np.zeros(0, np.uint64), np.zeros(1, np.int64), None
    for i in walk:
        own = sets[i]
        size, most = len(own), min(len(own), len(path))
        differ = np.flatnonzero(own[:most] != path[:most])
        depth = int(differ[0]) if len(differ) else most
        need = needed(size, len(hub))
        if cut is not None and depth >= cut[0] and cut[1] + min(size - cut[0], cut[2]) < need:
            continue  # in the subtree that was left, and no longer set revives it
        place = np.searchsorted(hub, own[depth:])
        hit = hub[np.minimum(place, len(hub) - 1)] == own[depth:]
        below = overlap[depth] + np.cumsum(hit)
        path, overlap = own, np.concatenate((overlap[: depth + 1], below))
        left = len(hub) - (place + hit)
        bound = below + np.minimum(size - depth - 1 - np.arange(len(hit)), left)
        short = np.flatnonzero(bound < need)
        cut = (depth + int(short[0]) + 1, int(below[short[0]]), int(left[short[0]])) if len(short) else None
        linked[i] = overlap[-1] >= need
    return linked


def _tree_task(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(k, np.uint64) for k in table["key"].to_pylist()]
    hubs = np.flatnonzero(table["node"].to_numpy() == table["hub"].to_numpy())
    others = np.flatnonzero(table["node"].to_numpy() != table["hub"].to_numpy())
    if not len(hubs) or not len(others):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    hit = others[tree_join(keys[hubs[0]], [keys[i] for i in others])]
    return pa.table({"a": table["hub"].to_numpy()[hit], "b": table["node"].to_numpy()[hit]})


def verify(pairs: DataFrame, documents: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs (hub, node) that reach the threshold, as edges (a, b)."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct()
    sets = materialise(fetch_sets(documents, nodes, owners), "sets")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).cast("int").alias("parts"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
    dealt = members.unionByName(hubs).join(sets, "node").select("hub", "part", "node", "key")
    return materialise(dealt.groupBy("hub", "part").applyInArrow(_tree_task, "a long, b long"), "links")


def join(documents: DataFrame, many: int = MANY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    counted = materialise(blocks(documents, bucket_bits(documents), many, block_rows).groupBy("bucket").applyInArrow(lambda t: _count_task(t, many), PARTS), "counted")
    rows = materialise(unpack(counted), "rows")
    owners = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    ordered = counted.groupBy("block").applyInArrow(lambda t: _order_task(t, many), "token long, node long, n int, pos int")
    light = materialise(ordered, "prefixes")
    tokens = light.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token")
    shared = materialise(light.join(tokens, "token").distinct(), "shared")

    # phase 1: stars around the most central set of each shingle
    df = shared.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    prefix = F.col("n") - F.floor((PERCENT * F.col("n") + 99) / 100) + 1
    strong = shared.join(df, "token").groupBy("node").agg(F.sum("df").alias("s"), F.count(F.lit(1)).alias("c"), F.max(prefix).alias("p"))
    strong = strong.filter("4 * c >= p").select("node", (F.col("s") / F.col("p")).alias("weight"))
    able = shared.join(strong, "node")
    hubs = able.groupBy("token").agg(F.max(F.struct("weight", "node", "n")).alias("h")).select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    stars = able.join(hubs, "token").filter((F.col("node") != F.col("hub")) & _sizes_fit("n", "hub_n"))
    stars = stars.groupBy("hub", "node").agg(F.count(F.lit(1)).alias("c"), F.max(prefix).alias("p")).filter("4 * c >= p")
    first = verify(stars.select("hub", "node"), documents, owners)

    # phase 2: prefix shingles that still hold several components
    known = materialise(components(first), "components")
    told = shared.join(known.withColumnRenamed("id", "node"), "node", "left")
    told = told.select("token", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))
    mixed = told.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = materialise(told.join(mixed, "token"), "rest")
    a = rest.select("token", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "pos", "comp")])
    b = rest.select("token", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "pos", "comp")])
    need = F.floor((PERCENT * (F.col("a_n") + F.col("b_n")) + 99 + PERCENT) / (100 + PERCENT))
    # A pair that reaches the threshold has its first common shingle where both remainders still can; that lists it.
    first_common = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= need
    apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_comp") != F.col("b_comp"))
    listed = a.join(b, "token").filter(apart & _sizes_fit("a_n", "b_n") & first_common)
    # Listed pairs go to the trees as they are: a row per prefix shingle that they share would outgrow them by the length of the texts.
    listed = materialise(listed.select(F.col("a_node").alias("hub"), F.col("b_node").alias("node")).distinct(), "listed")
    second = verify(listed, documents, owners)

    found = materialise(components(first.unionByName(second)), "components").withColumnRenamed("id", "node")
    named = rows.join(found, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    least = named.filter("n_shingles > 0 and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _sizes_fit(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def keep_documents(documents: DataFrame) -> DataFrame:
    """The row with the smallest id of each group; rows that repeat an id stay together, rows without id stay."""
    gone = join(documents).filter("component_id <> doc_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
