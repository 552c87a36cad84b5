"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word
backs off to its character n-grams, longest first: the first length at which any
n-gram of the word is known gives the mean of the log frequencies of those; if
none is known down to single characters the word says nothing. The language with
the highest mean over the words of the whole text wins.

The model is fitted on a bounded sample of the labelled rows: those whose hashed
id falls under ``SAMPLE_TEXTS`` over the rows of their language, so about that
many texts a language. Words and n-grams below a share of ``LEAST_WORD_SHARE``
and ``LEAST_GRAM_SHARE`` of their kind are left out, so no more than one over
that share can remain per language and kind; that bounds what is broadcast. Both
are parameters: at 0 every term of the sample stays, and words met once score by
themselves instead of by their n-grams.

A text that is null or has no letter is ``und`` with score 0, as is every text
if nothing could be learned. A text with letters about which the model knows
nothing, such as one in a script not learned, gets the language with most training
words and an even score. Ties go to the language that sorts first. Labels, sources
and ids are no inputs of a prediction, so repeated ids do not matter; every text is
read whole, however long. Other columns are carried as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.kernels import tidy

SAMPLE_TEXTS = 2000
LEAST_WORD_SHARE = 5e-6
LEAST_GRAM_SHARE = 1e-5
LONGEST_GRAM = 5
#: How much a gap in mean log score counts in the score.
SHARPNESS = 4.0
#: Words of a batch whose scores a worker keeps at most.
CACHE = 100_000


def held_out(fold: int = 0, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(
    labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, word_share: float = LEAST_WORD_SHARE, gram_share: float = LEAST_GRAM_SHARE
) -> DataFrame:
    """(lang, size, term, n, total): words have size 0, n-grams their length; total counts all of that size in the language."""
    rows = labelled.filter("lang is not null and text is not null")
    sizes = rows.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(F.broadcast(sizes), F.col("lang") == F.col("_l")).filter(place * F.col("_n") < sample_texts)
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}']+")).alias("term")
    words = sample.select("lang", word).filter("term <> ''").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit("^"), F.col("term"), F.lit("$"))
    size = F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM)))
    sized = words.select("lang", padded.alias("w"), "n", size.alias("size")).filter("length(w) >= size")
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1), lambda i: F.substring(F.col("w"), i, F.col("size"))))
    grams = sized.select("lang", "size", "n", gram.alias("term")).filter("term not in ('^', '$')").groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
    terms = words.select("lang", F.lit(0).alias("size"), "term", "n").unionByName(grams)
    total = terms.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    share = F.when(F.col("size") == 0, word_share).otherwise(gram_share)
    return terms.join(F.broadcast(total), ["lang", "size"]).filter(F.col("n") >= share * F.col("total"))


class Model:
    """Log frequencies by language of words and n-grams, with add-one smoothing: one matrix a kind, rows found by term."""

    def __init__(self, rows: pa.Table):
        self.langs = sorted(set(rows["lang"].to_pylist()))
        k = len(self.langs)
        lang = pc.index_in(rows["lang"], pa.array(self.langs, pa.string())).to_numpy()
        sizes, n, all_n = (rows[c].to_numpy() for c in ("size", "n", "total"))
        self.row: list[dict[str, int]] = []
        self.score: list[np.ndarray] = []
        words = np.ones(k)
        for size in range(LONGEST_GRAM + 1):
            own = np.flatnonzero(sizes == size)
            terms = rows["term"].take(pa.array(own)).combine_chunks().dictionary_encode()
            count, total = np.zeros((len(terms.dictionary), k)), np.ones(k)
            np.add.at(count, (terms.indices.to_numpy(), lang[own]), n[own])
            total[lang[own]] = all_n[own]
            self.row.append({t: i for i, t in enumerate(terms.dictionary.to_pylist())})
            self.score.append(np.log(count + 1) - np.log(total + len(count) + 1))
            words = total if size == 0 else words
        self.default = int(words.argmax()) if k else 0
        self.cache: dict[str, int] = {}
        self.cached = np.empty((CACHE, k))

    def word(self, word: str) -> np.ndarray:
        """Score of one word in every language; NaN where it says nothing."""
        at = self.row[0].get(word)
        if at is not None:
            return self.score[0][at]
        padded = f"^{word}$"
        for size in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            row = self.row[size]
            known = [g for i in range(len(padded) - size + 1) if (g := row.get(padded[i : i + size])) is not None]
            if known:
                return self.score[size][known].mean(0)
        return np.full(len(self.langs), np.nan)

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's share after a softmax of the mean log scores, sharpened) of each text."""
        n, k = len(texts), len(self.langs)
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        lists = pc.split_pattern_regex(lower, r"[^\pL\pM']+")
        flat = lists.flatten()
        owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        coded = flat.dictionary_encode()
        score = np.empty((len(coded.dictionary), k))
        for i, w in enumerate(coded.dictionary.to_pylist()):
            at = self.cache.get(w)
            if at is None:
                if len(self.cache) == CACHE:
                    self.cache.clear()
                at = self.cache[w] = len(self.cache)
                self.cached[at] = self.word(w) if w.strip("'") else np.nan
            score[i] = self.cached[at]
        code = coded.indices.to_numpy(zero_copy_only=False)
        says = ~np.isnan(score[:, 0]) if k else np.zeros(len(score), bool)
        counted = np.bincount(owner, weights=says[code], minlength=n)
        mean = np.empty((n, k))
        for j in range(k):
            mean[:, j] = np.bincount(owner, weights=np.where(says, score[:, j], 0.0)[code], minlength=n) / np.maximum(counted, 1)
        if not k:
            return ["und"] * n, np.zeros(n)
        lettered = pc.match_substring_regex(lower, r"\pL").to_numpy(zero_copy_only=False)
        best = np.where(counted > 0, mean.argmax(1), self.default)
        share = 1 / np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True))).sum(1)
        return [self.langs[b] if s else "und" for b, s in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0)


def predict(documents: DataFrame, model: DataFrame, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` columns of every row, with the predicted language and its score under the given names."""
    rows = model.toArrow()  # bounded by the model's size limits
    shared = documents.sparkSession.sparkContext.broadcast(rows)
    fields = [documents.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                lang, score = fitted.texts(part.column(len(carry)))
                cols = [part.column(i) for i in range(len(carry))]
                yield pa.record_batch([*cols, pa.array(lang, pa.string()), pa.array(score)], names=[*carry, *names])
        del fitted
        tidy()

    return documents.select(*carry, F.col("text").alias("_kw_text")).mapInArrow(run, schema)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    model = fit(documents.filter(~held_out()).select("doc_id", "lang", "text"))
    marked = documents.select("doc_id", "text", held_out().alias("held_out"))
    return predict(marked, model, ["doc_id", "held_out"])


def keep_documents(documents: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows whose language can be told: ``und`` and scores under ``least_score`` go."""
    model = fit(documents.filter(~held_out()).select("doc_id", "lang", "text"))
    told = predict(documents, model, documents.columns, ("_kw_lang", "_kw_score"))
    return told.filter((F.col("_kw_lang") != "und") & (F.col("_kw_score") >= least_score)).select(*documents.columns)
