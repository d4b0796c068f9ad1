"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of a text's lower-cased characters, hashed to 2^bits slots; a value is (1 + log count) x
idf, and a text's vector has length 1. Document frequencies are counted over every text that may be learned from. The
weights are trained with follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties on a bounded sample,
at most max_rows rows and max_entries vector entries, shared evenly by the languages and drawn by a hash of doc_id and text,
the least of each language, chosen on Spark (rows that repeat both are one); a fifth of it is kept back and fits one
temperature, by which the logits are divided. Prediction reads whole texts.

The softmax is over the learned languages alone, so a text in none of them has a score like any other. `known` tells them
apart: the share of a text's letters that the sample has in at least a hundredth of some language's texts.

The driver holds the sample's sparse vectors (max_entries), the frequencies (2^bits) and the weights, none of which grows
with the corpus; the weights go to the tasks.

Defined results: a text that is null or has no letter is `und` with score 0; where nothing can be learned, every text is;
a null doc_id is neither learned from nor held out; rows that repeat are predicted each; of languages with equal scores the
first in order of name is taken; other columns are never read by a prediction and stay as they are: where one has the name of
a result, the result's name gets an underscore more; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x languages
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    report: dict = field(default_factory=dict)
    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))  # code points

    def known(self, text: str | None) -> float:
        """The share of the text's letters that were learned; 0 without a letter."""
        c = _points(text or "")
        c = c[_is_letter()[c]]
        return float(np.isin(c, self.letters).mean()) if len(c) else 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        slots, values = vector(text, self.bits, self.idf)
        p = softmax((values @ self.weights[slots] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    out = np.zeros(0x110000, bool)
    out[[m.start() for m in LETTER.finditer("".join(map(chr, range(0x110000))))]] = True
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the text's character n-grams and how often each occurs."""
    c = _points(text)
    h = c * np.uint32(0x9E3779B1)
    grams = [h >> np.uint32(32 - bits)]
    for _ in range(2):
        if len(h) > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[len(c) - len(h) + 1 :] * np.uint32(0xC2B2AE35)
            grams.append((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits))
    n = np.bincount(np.concatenate(grams), minlength=1)
    slots = np.flatnonzero(n)
    return slots, n[slots]


def vector(text: str, bits: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots, n = counts(text, bits)
    values = (1 + np.log(n)) * idf[slots]
    norm = np.sqrt((values**2).sum())
    return slots, values / norm if norm else values


def _frequencies(bits: int):
    """(slot, texts that have it) for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**bits, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    total[counts(text, bits)[0]] += 1
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    return run


SPARSE = "lang string, draw bigint, size bigint, slots binary, n binary, letters binary"


def _sparse(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                slots, n = counts(t, bits)
                c = np.unique(_points(t))
                rows.append((len(slots), slots.astype("<i4").tobytes(), n.astype("<i4").tobytes(), c[_is_letter()[c]].astype("<u4").tobytes()))
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), *made], ["lang", "draw", "size", "slots", "n", "letters"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal. rows: slots, values and class of each sample, in the order in which they are seen."""
    z, n = np.zeros((slots + 1, classes)), np.zeros((slots + 1, classes))  # the last slot is the bias, without L1

    def solved(zs: np.ndarray, ns: np.ndarray, penalty) -> np.ndarray:
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for at, values, label in rows:
            at, x = np.append(at, slots), np.append(values, 1.0)
            penalty = np.full((len(at), 1), l1)
            penalty[-1] = 0
            zs, ns = z[at], n[at]
            w = solved(zs, ns, penalty)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
    w = solved(z, n, np.r_[np.full(slots, l1), 0.0][:, None])
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, bits: int = 15, max_rows: int = 3000, max_entries: int = 8_000_000) -> Model:
    """Learns from text and non-null lang of the rows of docs that are not held out. The sample has at most max_rows rows, and
    those of a language at most max_entries / languages n-gram slots in all (or one row)."""
    own = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    frequencies = own.select("text").mapInArrow(_frequencies(bits), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    hashed = F.xxhash64("doc_id", "text")
    # rows that repeat count once for the draw: however many there are, a little over share distinct ones pass the limit
    per_lang = {r.lang: r for r in own.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(hashed, 0.02).alias("distinct")).collect()}
    langs = sorted(per_lang)
    total = sum(r.n for r in per_lang.values())
    df = np.zeros(2**bits)
    for r in frequencies:
        df[r.slot] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    if not langs:
        return Model([], idf, np.zeros((2**bits, 0)), np.zeros(0), bits)
    share = max(1, max_rows // len(langs))
    draw = F.pmod(hashed, F.lit(2**62))
    limit = F.lit(0)
    for lang, r in per_lang.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(2**62 * min(1.0, (1.2 * share + 6 * share**0.5) / max(1, r.distinct))))).otherwise(limit)
    once = own.withColumn("draw", draw).where(F.col("draw") <= limit).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sparse = once.withColumn("place", place).where(F.col("place") <= share).select("lang", "draw", "text").mapInArrow(_sparse(bits), SPARSE)
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    drawn = sparse.withColumn("so_far", so_far).where((F.col("so_far") <= max(max_entries // len(langs), 2**bits))).collect()
    letters: list[np.ndarray] = []
    for lang in langs:
        own_letters = [np.frombuffer(r.letters, "<u4") for r in drawn if r.lang == lang]
        points, held = np.unique(np.concatenate([np.zeros(0, np.uint32), *own_letters]), return_counts=True)
        letters.append(points[held >= max(1, len(own_letters) / 100)])
    samples: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for k, lang in enumerate(langs):
        for r in sorted((r for r in drawn if r.lang == lang), key=lambda r: (r.draw, r.slots))[:share]:
            slots, n = np.frombuffer(r.slots, "<i4"), np.frombuffer(r.n, "<i4")
            values = (1 + np.log(n)) * idf[slots]
            samples.append((r.draw, slots, values / np.sqrt((values**2).sum()), k))
    samples.sort(key=lambda s: (s[0], s[3], len(s[1])))
    rows = [s[1:] for s in samples]
    kept_back = rows[::5] if len(rows) >= 20 else []
    w, b = ftrl([r for i, r in enumerate(rows) if i % 5] if kept_back else rows, 2**bits, len(langs))
    logits, labels = np.array([v @ w[s] + b for s, v, _ in kept_back]), np.array([k for _, _, k in kept_back], int)
    model = Model(langs, idf, w.astype(np.float32), b, bits, fit_temperature(logits, labels), letters=np.unique(np.concatenate(letters)))
    model.report = {"sampled": len(rows), "nonzero": float((w != 0).mean()), "temperature": model.temperature, "accuracy": float((logits.argmax(1) == labels).mean()) if len(labels) else None}
    return model


def _guessed(docs: DataFrame, model: Model, name: str, known: bool) -> DataFrame:
    """docs with a column of that name: lang, score and, where it is asked for, known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits x languages: bounded by parameters

    @F.pandas_udf("struct<lang:string,score:double,known:double>")
    def guess(texts):
        import pandas as pd

        own = shared.value
        return pd.DataFrame([(*own.predict(t), own.known(t) if known else None) for t in texts], columns=["lang", "score", "known"])

    return docs.withColumn(name, guess("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; every other column stays as it is."""
    guess, lang, score = (common.fresh(docs, x) for x in ("guess_of_text", "lang_pred", "score"))
    out = _guessed(docs, model, guess, known=False)
    return out.withColumn(lang, F.col(guess)["lang"]).withColumn(score, F.col(guess)["score"]).drop(guess)


def recognised(docs: DataFrame, model: Model, least_score: float = 0.0, least_known: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a likely language: a letter, at least that score, and at least that share of letters
    that were learned. All columns stay."""
    guess = common.fresh(docs, "guess_of_text")
    own = F.col(guess)
    return _guessed(docs, model, guess, known=True).where((own["lang"] != UNKNOWN) & (own["score"] >= least_score) & (own["known"] >= least_known)).drop(guess)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
