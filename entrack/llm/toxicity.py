"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label. A sentence's score is a logistic function
of its words and word beginnings, and the document's score is their noisy-or, 1 - prod(1 - p): one offending
sentence is enough, and a document without one stays low however long it is. Fitting the noisy-or to document
labels teaches the sentence scores, which then locate the offending sentences.

The classifier is fitted on at most SAMPLE labelled documents, chosen by a hash of their id, whose bags have about
SAMPLE_BYTES bytes at most (beyond, a share of them chosen by a hash of their text), with at most FEATURES features, those most associated with the label over the sample. Word beginnings let it recognise
forms of a stem that it has not seen.

Defined cases: a null or empty text has no sentence and score 0; a null label or a label of an id that no row
has teaches nothing; an id labelled toxic and clean counts as toxic; repeated rows are scored one by one;
without labels of both kinds every score is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, crc_mod, table

SAMPLE, SAMPLE_BYTES, FEATURES, LEAST_DOCS, LEAST_GAIN = 20_000, 64_000_000, 4096, 2, 8.0
BEGINNINGS = (4, 5, 6)
THRESHOLD, OFFENDING = 0.7, 0.5
STEPS, RATE, DECAY = 400, 0.1, 2e-4
CACHE_WORDS = 400_000
_LOGIT = float(np.log(OFFENDING / (1 - OFFENDING)))
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?]+(?=\s)|\n")


def features_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings carry a star."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


class _Weights(dict):
    """The summed weight of a word's features by word, 0 where it has none."""

    def __init__(self, words: dict[str, float], starts: dict[str, float]):
        super().__init__()
        self.words, self.starts = words, starts

    def __missing__(self, word: str) -> float:
        found = self.words.get(word, 0.0) + sum(self.starts.get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


class Model:
    """Sentence scores from feature weights; document scores by noisy-or."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.words = {f: w for f, w in weights.items() if not f.endswith("*")}
        self.starts = {f[:-1]: w for f, w in weights.items() if f.endswith("*")}
        self.known = _Weights(self.words, self.starts)

    def __reduce__(self):
        return Model, (self.words | {f"{s}*": w for s, w in self.starts.items()}, self.bias)

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """(document score, number of sentences, the sentences with score >= OFFENDING as (start, end, score))."""
        if not isinstance(text, str) or not text.strip():
            return 0.0, 0, []
        weight, words = self.known.__getitem__, _WORD.findall
        parts = _END.split(text.lower())
        full = [k for k, s in enumerate(parts) if s and not s.isspace()]
        z = self.bias + np.array([sum(map(weight, sorted(set(words(parts[k]))))) for k in full])
        bad = np.flatnonzero(z >= _LOGIT).tolist()
        marked = []
        if bad:
            ends = [0, *[m.end() for m in _END.finditer(text)], len(text)]
            marked = [(ends[full[k]], ends[full[k] + 1], float(1.0 / (1.0 + np.exp(-z[k])))) for k in bad]
        return float(-np.expm1(-np.logaddexp(0.0, z).sum())), len(z), marked


def fit(label: np.ndarray, plain: np.ndarray, sentences: np.ndarray, sizes: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias.

    For each bag: its label, how many sentences without features and how many with features it has. For each
    sentence with features, in order of bags, how many it has; ``feature`` lists them all in that order.
    """
    label, plain, n = label.astype(float), plain.astype(float), len(sizes)
    bag = np.repeat(np.arange(len(label)), sentences)
    sentence = np.repeat(np.arange(n, dtype=np.int32), sizes)
    w, b = np.zeros(n_features), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, STEPS + 1):
        z = b + np.bincount(sentence, w[feature], minlength=n)
        total = np.bincount(bag, np.logaddexp(0, z), minlength=len(label)) + plain * np.logaddexp(0, b)
        pull = np.where(label > 0, -1.0 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)  # d loss / d total
        down = pull[bag] / (1 + np.exp(-z))
        grad = np.bincount(feature, down[sentence], minlength=n_features) / len(label) + DECAY * w
        grad_b = (down.sum() + (pull * plain).sum() / (1 + np.exp(-b))) / len(label)
        g = np.clip(np.append(grad, grad_b), -1, 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _document_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and clean documents of the partition have each feature."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic)].update({f for w in set(_WORD.findall(text.lower())) for f in features_of(w)})
    for toxic, found in counts.items():
        if found:
            yield pd.DataFrame({"feature": list(found), "n": list(found.values())}).assign(toxic=toxic)


def _bags(index: dict[str, int]):
    """Each document as a bag of sentences; lists of numbers travel as int32 bytes, which the driver holds as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                plain, found = 0, []
                for part in _END.split(text.lower()):
                    here = sorted({index[f] for w in set(_WORD.findall(part)) for f in features_of(w) if f in index})
                    if here:
                        found.append(here)
                    elif part and not part.isspace():
                        plain += 1
                sizes = np.array([len(x) for x in found], dtype=np.int32)
                rows.append((int(toxic), plain, len(found), sizes.tobytes(), np.array([i for x in found for i in x], dtype=np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["toxic", "plain", "sentences", "sizes", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits the model on at most ``sample`` rows of ``labels`` for which ``learn`` holds (a condition on doc_id)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    known = known.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = scratch.save(rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "texts")
    n_clean, n_toxic = texts.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n_clean or not n_toxic:
        return Model({}, -50.0)
    counted = texts.mapInPandas(_document_features, "feature string, n long, toxic int").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    n = float(n_clean + n_toxic)
    gain = F.lit(0.0)
    for seen, of in ((F.col("t"), n_toxic), (F.col("c"), n_clean)):
        expected = (F.col("t") + F.col("c")) * (of / n)
        gain = gain + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
        missing = of - seen
        gain = gain + F.when(missing > 0, 2 * missing * F.log(missing / (of - expected))).otherwise(0.0)
    best = counted.where(F.col("t") + F.col("c") >= LEAST_DOCS).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    names = [r["feature"] for r in best.orderBy(F.col("gain").desc(), "feature").limit(FEATURES).collect()]
    index = {f: i for i, f in enumerate(names)}
    packed = texts.mapInPandas(_bags(index), "toxic int, plain long, sentences long, sizes binary, features binary")
    packed = scratch.save(packed, "bags")
    size = packed.agg(F.coalesce(F.sum(F.octet_length("sizes") + F.octet_length("features")), F.lit(0))).first()[0]
    if size > SAMPLE_BYTES:
        packed = packed.where(F.pmod(F.xxhash64("sizes", "features"), F.lit(1_000_000)) < int(1e6 * SAMPLE_BYTES / size))
    bags = _collected(packed)  # ``sample`` rows and about SAMPLE_BYTES at most
    flat = [np.frombuffer(b"".join(bags[c]), dtype=np.int32) for c in ("sizes", "features")]
    w, b = fit(*[bags[c].to_numpy() for c in ("toxic", "plain", "sentences")], *flat, len(names))
    scratch.drop("texts", "bags", "chosen")
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, b)


def _collected(df: DataFrame) -> pd.DataFrame:
    """Rows of a table of bounded size, by Arrow whatever the session's setting."""
    return df.toArrow().to_pandas()


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_sentences, offending) of every row; offending has the sentences with score >= OFFENDING."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                p, count, marked = model.score(t)
                rows.append((p, count, [{"start": a, "end": b, "score": x} for a, b, x in marked]))
            out = pd.DataFrame(rows, columns=["score", "n_sentences", "offending"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>")


def held_out() -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return scored(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))).alias("offending"),
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with all their columns."""
    scores = F.pandas_udf(lambda texts: pd.Series([model.score(t)[0] for t in texts]), "double")
    return docs.where(scores(F.col(text)) < threshold)
