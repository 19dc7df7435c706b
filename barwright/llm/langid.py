"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (languages by buckets) is broadcast; a batch of texts becomes one array of bucket
numbers that is gathered from the matrix and summed by document in numpy.

Defined results: a null, empty or letterless text is `und` with score 0; so is every text when nothing could be
learned (an empty table, no labels). Rows without doc_id are predicted but never learned from, and count as not
held out. Repeated rows get equal predictions. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import own_columns, text_chunks, worker_store

BUCKETS = 1 << 14
SMOOTHING = 0.5
SAMPLE_PER_LANGUAGE = 2000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once in a Python worker."""
    store = worker_store("letters")
    if "table" not in store:
        store["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return store["table"]


def ngram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams that start with a letter, the text number of each n-gram's start
    (ascending within an order), and for each text whether it has a letter. Non-letters count as one symbol."""
    lowered = [t.lower() + "   " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    sym = np.where(letter, code, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    one = sym[at] * np.uint32(0x9E3779B1)
    two = (one ^ (sym[at + 1] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35) if len(at) else one
    three = (two ^ (sym[at + 2] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1) if len(at) else one
    shift = np.uint32(32 - int(math.log2(buckets)))
    grams = np.stack([(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for x in (one, two, three)], axis=1)
    has = np.zeros(len(texts), bool)
    has[owner[at]] = True
    return grams.astype(np.int64), owner[at], has


def learnable(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    return docs.filter((rest != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def train(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix with the prior in a last column.

    A language with more than `per_language` rows is thinned to about that many by a hash of doc_id: the
    documented bound of this classifier's training sample. Counts by (language, bucket) reach the driver: as many
    numbers as the model has.
    """
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, buckets + 1), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) / 1_000_000
    number = {k: i for i, k in enumerate(langs)}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(number), buckets), np.int64)
        for part in parts:
            for lang, texts in part.groupby("lang")["text"]:
                for chunk in text_chunks(texts):
                    grams, _, _ = ngram_buckets(chunk, buckets)
                    total[number[lang]] += np.bincount(grams.ravel(), minlength=buckets)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    picked = rows.filter(chance < share[F.col("lang")]).select("lang", "text")
    counted = picked.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), buckets))
    counts[counted["lang"].to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy(float)
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * buckets)
    prior = np.log(np.array([[sizes[k]] for k in langs], float) / sum(sizes.values()))
    return langs, np.hstack([logs, prior]).astype(np.float32)


def score_texts(texts: list[str], langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior for each text."""
    best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if not langs:
        return list(best), score
    grams, owner, has = ngram_buckets(texts, model.shape[1] - 1)
    known = np.flatnonzero(has)
    if not len(known):
        return list(best), score
    starts = np.searchsorted(owner, known)
    sums = np.stack([np.add.reduceat(row[grams].sum(1, dtype=np.float64), starts) for row in model], axis=1) + model[:, -1]
    sums -= sums.max(1, keepdims=True)
    top = sums.argmax(1)
    best[known] = np.array(langs, object)[top]
    score[known] = 1.0 / np.exp(sums).sum(1)
    return list(best), score


def predictor(docs: DataFrame, langs: list[str], model: np.ndarray):
    """A column function: text to struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for batch in batches:
            parts = [score_texts(chunk, names, matrix) for chunk in text_chunks(batch)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    return predict


def predict(docs: DataFrame, text: str | Column = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    langs, model = train(learnable(docs if learn_from is None else learn_from))
    said = predictor(docs, langs, model)(text)
    return docs.withColumn("_said", said).select(*docs.columns, F.col("_said.lang_pred").alias("lang_pred"), F.col("_said.score").alias("score"))


def op8_language_id(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs).select("doc_id", held.alias("held_out"), "lang_pred", "score")


LEAST_SCORE = 0.5


@own_columns
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that have no recognisable language are rejected."""
    names = docs.columns
    kept = predict(docs.select(*names)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*names)
