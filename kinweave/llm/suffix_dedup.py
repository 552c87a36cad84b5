"""Suffix-array deduplication: removes bytes of 100-byte strings that occur earlier.

Comparing every suffix of a corpus would sort all of it. A window of ``WINDOW``
bytes is instead anchored at its minimizer, the ``GRAM`` bytes in it with the
smallest hash: equal windows have equal anchors at equal places, so only anchors
that occur twice matter, and windows with the same anchor lie side by side in one
short context. Nothing is lost by that, and it needs one exchange of hashes.

Contexts that are equal byte for byte become one before they are shuffled, with
the first place they occur at. The distinct contexts are dealt to shards by
anchor. Each shard builds the suffix array of its text (Larsson-Sadakane), its
common prefixes (Kasai), and thereby the groups of equal windows and the first
place of each. An anchor with more than ``SHARD`` distinct contexts is dealt to
several shards; these hand out their distinct windows as runs sorted by digest,
cut into ranges by binary search at common splitters, and the runs of a range
are merged by binary search and give every shard the first place over all.

Texts are UTF-8 bytes, null is empty; matches never cross texts. Places are
ordered by (id, text digest, position), a null id first. Rows that repeat both id
and text count as one text: each keeps what the other has. The result has one row
per row. Texts shorter than the window are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import idfilter
from kinweave.llm import kernels as K
from kinweave.llm.common import materialise
from kinweave.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 100
GRAM = 32
#: Distinct contexts of a shard; an anchor with more is dealt to several.
SHARD = 20_000
#: Distinct contexts sorted together where no anchor is that frequent, and bytes of text hashed together: what a core's cache holds.
TOGETHER = 5_000
CHUNK = 1 << 18
NULL_ID = -(1 << 63)


def anchors(data: np.ndarray, off: np.ndarray):
    """(hash, place, first window, last window, text) of every run of windows that share their minimizer."""
    n = len(data)
    if n < WINDOW:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, z
    grams = K.gram_hashes(K.prefix_sums(data), GRAM)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # smallest hash, then leftmost
    span, width = WINDOW - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    # windows that would run past their text start in its last WINDOW - 1 bytes, or anywhere in a shorter text
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(off[1:] - WINDOW + 1, off[:-1]), 1)
    np.add.at(edge, off[1:], -1)
    valid = np.cumsum(edge[: len(least)], dtype=np.int32) == 0
    moved = least[1:] != least[:-1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | moved
    last = valid.copy()
    last[:-1] &= ~valid[1:] | moved
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    place = (least[lo] & low).astype(np.int64)
    return grams[place], place, lo, hi, np.searchsorted(off, lo, side="right") - 1


def repeated_anchors(documents: DataFrame) -> DataFrame:
    """(anchor) of the anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, off in K.chunks(b.column(0), CHUNK):
                value, count = np.unique(anchors(data, off)[0], return_counts=True)
                yield pa.record_batch({"anchor": value.view(np.int64), "n": count})

    counts = documents.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return materialise(counts.filter("n > 1").select("anchor"), "anchors")


MEMBER = "anchor long, context long, doc long, text long, place int, lo int, hi int"


def occurrences(documents: DataFrame, bitmap, with_bytes: bool) -> DataFrame:
    """Every occurrence of a repeated anchor: where it is, its windows, a digest of its context, and the context itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(1), CHUNK):
                hashed, place, first, last, text = anchors(data, off)
                keep = np.flatnonzero(idfilter.member(bitmap.value, hashed)) if len(hashed) else np.zeros(0, np.int64)
                hashed, place, first, last, text = (x[keep] for x in (hashed, place, first, last, text))
                sums = K.prefix_sums(data)
                whole = K.span_hashes(sums, off[:-1], off[1:]).view(np.int64)
                ids = b.column(0).slice(lo, hi - lo).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                begin = off[:-1][text]
                cols = {
                    "anchor": hashed.view(np.int64), "context": K.span_hashes(sums, first, last + WINDOW).view(np.int64),
                    "doc": ids[text], "text": whole[text], "place": (place - begin).astype(np.int32),
                    "lo": (first - begin).astype(np.int32), "hi": (last - begin).astype(np.int32),
                }
                if with_bytes:
                    raw = data.tobytes()
                    cols["bytes"] = pa.array([raw[i:j] for i, j in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)], pa.binary())
                yield pa.record_batch(cols)

    return documents.select("doc_id", "text").mapInArrow(run, MEMBER + (", bytes binary" if with_bytes else ""))


class Shard:
    """The windows of some contexts, grouped by equality with a suffix array."""

    def __init__(self, table: pa.Table):
        get = lambda c: table[c].to_numpy()
        self.anchor, self.context = get("anchor"), get("context")
        data, off = K.column_bytes(table["bytes"].cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
        self.data, self.windows = data, np.diff(off) - WINDOW + 1
        order = np.lexsort((get("place"), get("text"), get("doc")))
        self.doc, self.text, self.place = get("doc"), get("text"), get("place")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.by_rank = order
        used = np.zeros(256, np.int64)
        used[np.unique(data)] = 1
        codes = np.cumsum(used)[data]
        sa = suffix_array(codes, len(codes))  # in full order, as Kasai's bound needs
        group = np.empty(len(data), np.int64)
        group[sa] = np.cumsum(common_prefixes(codes, sa, WINDOW) < WINDOW)
        self.owner = np.repeat(np.arange(len(off) - 1), self.windows)
        self.offset = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.start = off[:-1][self.owner] + self.offset
        _, self.group = np.unique(group[self.start], return_inverse=True)

    def first(self) -> np.ndarray:
        """Context of the first occurrence of each group of equal windows."""
        least = np.full(int(self.group.max()) + 1 if len(self.group) else 0, len(self.rank), np.int64)
        np.minimum.at(least, self.group, self.rank[self.owner])
        return self.by_rank[least]

    def flags(self, removed: np.ndarray) -> pa.Table:
        """One row per context: its first place and which of its windows there are removed."""
        cut = np.concatenate(([0], np.cumsum(self.windows)))
        bits = [np.packbits(removed[a:b]).tobytes() if removed[a:b].any() else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({
            "anchor": self.anchor, "context": self.context, "f_doc": self.doc, "f_text": self.text,
            "f_place": self.place, "bits": pa.array(bits, pa.binary()),
        })


FLAGS = "anchor long, context long, f_doc long, f_text long, f_place int, bits binary"
RUN = "anchor long, part int, cut int, digest array<long>, doc array<long>, text array<long>, place array<int>"


def _solve_shard(table: pa.Table) -> pa.Table:
    shard = Shard(table)
    return shard.flags(shard.rank[shard.owner] > shard.rank[shard.first()][shard.group])


def _digests(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each group of equal windows, and the groups in digest order."""
    example = np.zeros(int(shard.group.max()) + 1, np.int64)
    example[shard.group] = shard.start
    digest = K.span_hashes(K.prefix_sums(shard.data), example, example + WINDOW)
    return digest, np.argsort(digest, kind="stable")


def _sorted_runs(table: pa.Table) -> pa.Table:
    """The distinct windows of one of several shards of an anchor, as runs cut at even splitters of the digest space."""
    shard, parts = Shard(table), table["parts"][0].as_py()
    digest, order = _digests(shard)
    ordered, first = digest[order], shard.first()[order]
    splitters = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    at = np.concatenate(([0], np.searchsorted(ordered, splitters), [len(ordered)])).astype(np.int32)
    lists = lambda v: pa.ListArray.from_arrays(pa.array(at), pa.array(v))
    return pa.table({
        "anchor": pa.array([table["anchor"][0].as_py()] * parts, pa.int64()), "part": pa.array([table["part"][0].as_py()] * parts, pa.int32()),
        "cut": pa.array(np.arange(parts, dtype=np.int32)), "digest": lists(ordered.view(np.int64)),
        "doc": lists(shard.doc[first]), "text": lists(shard.text[first]), "place": lists(shard.place[first]),
    })


def _merge_runs(table: pa.Table) -> pa.Table:
    """Merges the runs of a range: each run is located in the union by binary search and gets the first places found there."""
    flat = {c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("digest", "doc", "text", "place")}
    digest = flat["digest"].view(np.uint64)
    order = np.lexsort((flat["place"], flat["text"], flat["doc"], digest))
    union = digest[order]
    first = order[np.searchsorted(union, digest, side="left")] if len(digest) else order
    at = table["digest"].combine_chunks().offsets.to_numpy()
    offsets = pa.array((at - at[0]).astype(np.int32))
    lists = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v))
    return pa.table({
        "anchor": table["anchor"], "part": table["part"], "cut": table["cut"], "digest": lists(flat["digest"]),
        "doc": lists(flat["doc"][first]), "text": lists(flat["text"][first]), "place": lists(flat["place"][first]),
    })


def _apply_merged(left: pa.Table, right: pa.Table) -> pa.Table:
    shard = Shard(left)
    _, order = _digests(shard)
    right = right.sort_by("cut")
    first = {c: right[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("doc", "text", "place")}
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    at = back[shard.group]
    own = shard.doc[shard.owner], shard.text[shard.owner], shard.place[shard.owner]
    doc, text, place = first["doc"][at], first["text"][at], first["place"][at]
    later = (own[0] > doc) | (own[0] == doc) & ((own[1] > text) | (own[1] == text) & (own[2] > place))
    return shard.flags(later)


def solve(contexts: DataFrame, shard_size: int) -> DataFrame:
    """FLAGS of every distinct context."""
    sizes = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_size)
    hot = materialise(sizes.select("anchor", F.ceil(F.col("n") / shard_size).cast("int").alias("parts")), "hot")
    total = contexts.count()
    shards = max(1, -(-total // min(shard_size, TOGETHER)))
    if not hot.limit(1).count():
        cold, out = contexts, None
    else:
        cold = contexts.join(hot, "anchor", "left_anti")
        dealt = contexts.join(hot, "anchor").withColumn("part", F.pmod(F.xxhash64("context"), "parts").cast("int"))
        runs = dealt.groupBy("anchor", "part").applyInArrow(_sorted_runs, RUN)
        merged = materialise(runs.groupBy("anchor", "cut").applyInArrow(_merge_runs, RUN), "runs")
        out = dealt.groupBy("anchor", "part").cogroup(merged.groupBy("anchor", "part")).applyInArrow(_apply_merged, FLAGS)
    cold = cold.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    solved = cold.groupBy("shard").applyInArrow(_solve_shard, FLAGS)
    return materialise(solved if out is None else solved.unionByName(out), "flags")


def spans(n_bytes: int, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs from (first, last) starts of removed windows."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        a, b = lo, min(hi + WINDOW, n_bytes)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed_windows(lo: int, hi: int, bits: bytes | None) -> list[tuple[int, int]]:
    if bits is None:
        return [(lo, hi)]
    flag = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo + 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag, [0]))))
    return [(lo + int(a), lo + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def removed_spans(documents: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """(doc, text, windows) of the texts that lose something; windows: array of (lo, hi, bits), bits null for all."""
    spark = documents.sparkSession
    repeated = repeated_anchors(documents)
    bitmap = spark.sparkContext.broadcast(idfilter.build(repeated, idfilter.bits_for(repeated.count())))
    found = occurrences(documents, bitmap, with_bytes=True)
    place = F.struct("doc", "text", "place")
    distinct = found.groupBy("anchor", "context").agg(F.min(place).alias("f"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    distinct = distinct.select("anchor", "context", "f.doc", "f.text", "f.place", "bytes", "n")
    contexts = materialise(distinct, "contexts")
    # An anchor met once only passed the filter by chance. One whose occurrences all have the same context is
    # settled by that: its windows occur there only, so all but the first occurrence lose them.
    kinds = contexts.groupBy("anchor").agg(F.sum("n").alias("k"), F.count(F.lit(1)).alias("c")).filter("k > 1")
    kinds = materialise(kinds.select("anchor", "c"), "kinds")
    several = contexts.drop("n").join(kinds.filter("c > 1").select("anchor"), "anchor", "left_semi")
    alone = contexts.join(kinds.filter("c = 1").select("anchor"), "anchor", "left_semi").select(
        "anchor", "context", F.col("doc").alias("f_doc"), F.col("text").alias("f_text"), F.col("place").alias("f_place"), F.lit(None).cast("binary").alias("bits")
    )
    flags = solve(several, shard_size).unionByName(alone)
    members = occurrences(documents, bitmap, with_bytes=False)
    met = members.join(flags, ["anchor", "context"])
    is_first = (F.col("doc") == F.col("f_doc")) & (F.col("text") == F.col("f_text")) & (F.col("place") == F.col("f_place"))
    losing = met.filter(~is_first | F.col("bits").isNotNull())
    window = F.struct("lo", "hi", F.when(is_first, F.col("bits")).alias("bits"))
    return materialise(losing.select("doc", "text", window.alias("w")).groupBy("doc", "text").agg(F.collect_list("w").alias("windows")), "windows")


CLEANED = "doc long, text long, n_removed long, n_spans long, kept_sha256 string"


def clean(documents: DataFrame, shard_size: int = SHARD, texts: bool = False) -> DataFrame:
    """(doc, text, n_removed, n_spans, kept_sha256) of the texts that lose something, and with ``texts`` what is kept (invalid UTF-8 replaced)."""
    windows = removed_spans(documents, shard_size)
    bitmap = documents.sparkSession.sparkContext.broadcast(idfilter.build(windows.select("text"), idfilter.bits_for(windows.count())))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(1)):
                whole = K.span_hashes(K.prefix_sums(data), off[:-1], off[1:])
                take = pa.array(idfilter.member(bitmap.value, whole))
                ids = b.column(0).slice(lo, hi - lo).cast(pa.int64()).fill_null(NULL_ID)
                rows = pa.record_batch([ids, pa.array(whole.view(np.int64)), b.column(1).slice(lo, hi - lo)], names=["doc", "text", "body"])
                yield rows.filter(take)

    bodies = documents.select("doc_id", "text").mapInArrow(keyed, "doc long, text long, body string").dropDuplicates(["doc", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"doc": b.column(0), "text": b.column(1)}
            removed, count, sha, kept_text = [], [], [], []
            for body, windows in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = (body or "").encode()
                gone = spans(len(raw), [r for w in windows for r in _removed_windows(w["lo"], w["hi"], w["bits"])])
                at, kept = 0, []
                for a, z in gone:
                    kept.append(raw[at:a])
                    at = z
                kept = b"".join([*kept, raw[at:]])
                removed.append(len(raw) - len(kept))
                count.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace"))
            rows |= {"n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if texts:
                rows["kept_text"] = pa.array(kept_text, pa.string())
            yield pa.record_batch(rows)

    joined = bodies.join(windows, ["doc", "text"]).select("doc", "text", "body", "windows")
    return joined.mapInArrow(cut, CLEANED + (", kept_text string" if texts else ""))


def text_key(documents: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns with n_bytes, sha256 of the whole text, and the digest that names it here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(1)):
                whole = K.span_hashes(K.prefix_sums(data), off[:-1], off[1:]).view(np.int64)
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(whole), pa.array(np.diff(off)), pa.array(sha, pa.string())], names=["doc_id", "text", "n_bytes", "sha"])

    return documents.select(*carry, "text").mapInArrow(run, "doc_id long, text long, n_bytes long, sha string")


def dedup_query(documents: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = text_key(documents, ["doc_id"]).withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    cleaned = materialise(clean(documents, shard_size), "cleaned")
    zero = F.lit(0).cast("long")
    return rows.join(cleaned, ["doc", "text"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
