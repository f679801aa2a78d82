"""Subword lattice likelihood.

Every word is spelled by the pieces of an existing unigram vocabulary in all possible ways; a forward
recursion in log space over the word's bytes sums them, so no single segmentation is chosen. The vocabulary's
own scores start the piece weights and a few rounds of expectation-maximisation over the training words adapt
them (the same lattice, forwards and backwards). The whole word is one more arc: words seen in training carry
their discounted counts, and the mass the discount frees goes to the spelling lattice, so known and unknown
words share one distribution and the text's probability, with an end after its words, is a proper one.

Word statistics are tables that grow with the corpus and are joined by word. Only the most frequent words, at
most FREQUENT of at most MOST_BYTES bytes each, travel to every task, and are known there by a hash of 64 bits.
Expectation-maximisation counts every distinct training word once, so common words do not drown the others.

Defined cases: a null, empty or blank text is its end alone; a null id counts as a training row; repeated rows
are counted and scored one by one; an empty table gives an empty result; without training rows the end has
probability 1/2 and words come from the vocabulary alone; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.byte_words import ASCII_LOW, Words, column_bytes, slices
from entrack.llm.common import Scratch, crc_mod, table

FREQUENT, MOST_BYTES = 1 << 18, 64
ROUNDS = 2
LONG_WORD = 48
_MARK = 0xFF  # starts a word; no byte of UTF-8
_BASE = 0x100000001B3
_MASK = (1 << 64) - 1


def coded(word: str) -> bytes:
    return bytes([_MARK]) + word.encode("utf-8", "surrogatepass")


class Pieces:
    """Pieces as byte strings with log weights; hashed so that arrays of candidates are looked up at once."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        if len(np.unique(hashes)) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.tables = []
        left = np.arange(len(pieces))
        for shift in range(8):
            if not len(left):
                break
            slots = self._slots(hashes[left], shift)
            place = np.full(1 << 18, -1, dtype=np.int32)
            place[slots] = left
            self.tables.append(place)
            left = left[place[slots] != left]
        if len(left):
            raise ValueError("pieces do not fit the tables")
        self.hashes = np.append(hashes, np.uint64(0))
        self.weigh(weights)

    def weigh(self, weights: np.ndarray) -> None:
        """Weights are scaled to add up to 1 over all pieces."""
        self.log = np.append(np.log(weights) - math.log(weights.sum()), -np.inf)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * _BASE + b + 1) & _MASK
        return h

    @staticmethod
    def _slots(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1234567 * shift)) >> np.uint64(46)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for none."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        for shift, place in enumerate(self.tables):
            found = place[self._slots(hashes, shift)]
            hit = self.hashes[found] == hashes
            out[hit] = found[hit]
        return out

    def arcs(self, symbols: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece ids of symbols[:, i:j] for all i < j, where any row has one."""
        m, n = symbols.shape
        out = {}
        for i in range(n):
            h = np.zeros(m, dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * np.uint64(_BASE) + symbols[:, j - 1] + np.uint64(1)
                found = self.ids(h)
                if (found >= 0).any():
                    out[i, j] = found
        return out

    def forward(self, arcs: dict[tuple[int, int], np.ndarray], m: int, n: int) -> np.ndarray:
        into: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), found in arcs.items():
            into.setdefault(j, []).append((i, found))
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            alpha[j] = _log_sum([alpha[i] + self.log[found] for i, found in into.get(j, [])], m)
        return alpha

    def log_probability(self, symbols: np.ndarray) -> np.ndarray:
        m, n = symbols.shape
        return self.forward(self.arcs(symbols), m, n)[n]

    def expected(self, symbols: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected uses of every piece to counts."""
        m, n = symbols.shape
        arcs = self.arcs(symbols)
        alpha = self.forward(arcs, m, n)
        outof: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), found in arcs.items():
            outof.setdefault(i, []).append((j, found))
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            beta[i] = _log_sum([beta[j] + self.log[found] for j, found in outof.get(i, [])], m)
        for (i, j), found in arcs.items():
            share = np.exp(alpha[i] + self.log[found] + beta[j] - alpha[n]) * weight
            ok = found >= 0
            counts += np.bincount(found[ok], share[ok], minlength=len(counts))

    def long_word(self, word: bytes) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """Arcs into each position, as (start, id, log weight), and the forward values of one long word."""
        symbols = np.frombuffer(word, np.uint8).astype(np.uint64)
        n = len(symbols)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        h = np.zeros(n, dtype=np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = h[: n - size + 1] * np.uint64(_BASE) + symbols[size - 1 :] + np.uint64(1)
            found = self.ids(h)
            for i in np.flatnonzero(found >= 0).tolist():
                into[i + size].append((i, int(found[i]), float(self.log[found[i]])))
        alpha = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            terms = [alpha[i] + w for i, _, w in into[j]]
            top = max(terms, default=-math.inf)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else -math.inf
        return into, alpha

    def expected_long(self, word: bytes, weight: float, counts: np.ndarray) -> None:
        into, alpha = self.long_word(word)
        beta = [-math.inf] * len(word) + [0.0]
        for j in range(len(word), 0, -1):
            for i, piece, w in into[j]:
                a, b = beta[i], beta[j] + w
                beta[i] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
                counts[piece] += math.exp(alpha[i] + w + beta[j] - alpha[-1]) * weight


def _log_sum(terms: list[np.ndarray], m: int) -> np.ndarray:
    if not terms:
        return np.full(m, -np.inf)
    if len(terms) == 1:
        return terms[0]
    stack = np.stack(terms)
    top = stack.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stack - safe).sum(axis=0))


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | bytes]]:
    """(places, symbols): equally long words as a matrix, words over LONG_WORD symbols one by one as bytes."""
    raw = [coded(t) for t in texts]
    sizes = np.array([len(r) for r in raw])
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        if n > LONG_WORD:
            for p in places:
                yield np.array([p]), raw[p]
            continue
        for lo in range(0, len(places), 20_000):
            some = places[lo : lo + 20_000]
            yield some, np.frombuffer(b"".join([raw[p] for p in some]), np.uint8).reshape(len(some), n).astype(np.uint64)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes, and weights 1 / (3 + rank) from its scores' order.

    All 256 bytes are pieces, so every text can be spelled.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): -float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or "▁" in text[1:]:
            continue
        piece = (bytes([_MARK]) if text[0] == "▁" else b"") + text.removeprefix("▁").encode()
        if piece:
            found[piece] = max(found.get(piece, -math.inf), model.get_score(i))
    pieces = list(found)
    scores = np.array([found[p] for p in pieces])
    rank = np.empty(len(pieces))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
    return pieces, 1.0 / (3.0 + rank)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word_rows(part: pa.RecordBatch) -> tuple[Words, bytes]:
    """The words of a slice of texts and its bytes, A-Z lower-cased."""
    data, offsets = column_bytes(part.column("text"))
    return Words(data, offsets, lower=True), data.tobytes().translate(ASCII_LOW)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, counts and words of several tables as one."""
    hashes, counts, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    kinds, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    return kinds, np.bincount(of, counts).astype(np.int64), found[first]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition, handed on whenever they fill a table of bounded size."""
    held: dict[bool, list] = {True: [], False: []}

    def rows(at_least: int) -> Iterator[pa.RecordBatch]:
        for train, parts in held.items():
            if sum(len(x[0]) for x in parts) > at_least:
                _, counts, found = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.binary()).cast(pa.string()), pa.array(counts), pa.array(np.full(len(counts), train))], ["word", "c", "train"])
                parts.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            words, low = _word_rows(part)
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)[words.doc]
            for flag in (True, False):
                own = np.flatnonzero(train == flag)
                if len(own):
                    hashes, first, counts = np.unique(words.hashes[own], return_index=True, return_counts=True)
                    found = np.empty(len(first), dtype=object)
                    found[:] = [low[a:b] for a, b in zip(words.starts[own[first]].tolist(), words.ends[own[first]].tolist(), strict=True)]
                    held[flag].append((hashes, counts, found))
            yield from rows(1_000_000)
    yield from rows(0)


def _expectation(pieces: Pieces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(pieces.pieces))
        for batch in batches:
            for places, symbols in by_length(batch["word"].tolist()):
                if isinstance(symbols, bytes):
                    pieces.expected_long(symbols, 1.0, counts)
                else:
                    pieces.expected(symbols, np.ones(len(places)), counts)
        used = np.flatnonzero(counts > 0)
        yield pd.DataFrame({"piece": used, "uses": counts[used]})

    return run


def _spelled(pieces: Pieces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["word"].tolist()
            out = np.empty(len(texts))
            for places, symbols in by_length(texts):
                out[places] = pieces.long_word(symbols)[1][-1] if isinstance(symbols, bytes) else pieces.log_probability(symbols)
            yield batch.assign(spelled=out)

    return run


_POSTING = "rid long, doc_id long, word string, n long, known long, base double, score double"


def _postings(frequent: np.ndarray, values: np.ndarray):
    """A row for each text with the sums over its frequent words, and a row for each other word of it.

    ``frequent`` has the sorted hashes of the frequent words; ``values`` the columns known, base and score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        names = ["rid", "doc_id", "word", "n", "known", "base", "score"]
        for batch in batches:
            for part in slices(batch, "text"):
                words, low = _word_rows(part)
                m = part.num_rows
                at = np.searchsorted(frequent, words.hashes)
                at[at == len(frequent)] = 0
                hit = frequent[at] == words.hashes if len(frequent) else np.zeros(len(at), dtype=bool)
                sums = [np.bincount(words.doc[hit], values[at[hit], k], minlength=m).astype(np.float64) for k in range(3)]
                rids = np.arange(rid, rid + m)
                rid += m
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids), part.column("doc_id"), pa.nulls(m, pa.string()), pa.array(np.diff(words.first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names
                )
                rare = np.flatnonzero(~hit)
                if not len(rare):
                    continue
                rare = rare[np.lexsort((words.hashes[rare], words.doc[rare]))]
                doc, h = words.doc[rare], words.hashes[rare]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
                times, one = np.diff(np.append(new, len(rare))), rare[new]
                found = [low[a:b] for a, b in zip(words.starts[one].tolist(), words.ends[one].tolist(), strict=True)]
                zero = np.zeros(len(one))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[doc[new]]), pa.array(zero.astype(np.int64)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(times), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names
                )

    return run


def lattice_scores(
    docs: DataFrame, train: F.Column | None, path: str, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` is a condition on the column doc_id that says which rows are learnt from (all for None);
    ``path`` is the vocabulary file. ``base_score`` is the add-one word unigram log10 probability,
    ``score`` the lattice model's.
    """
    scratch = Scratch(docs.sparkSession, "lattice")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learns = F.coalesce(train, F.lit(True)) if train is not None else F.lit(True)
    counted = rows.select("text", learns.alias("train")).mapInArrow(_count_words, "word string, c long, train boolean")
    every = counted.groupBy("word").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("train"), F.col("c")).otherwise(0)).alias("c"))
    every = scratch.save(every, "words")

    ends = rows.where(learns).count()
    total, kinds, once, twice = every.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    total = total or 0
    tokens, distinct = total + ends, kinds + (1 if ends else 0)
    end = ends / tokens if total else 0.5
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    names, weights = vocabulary(path)
    pieces = Pieces(names, weights)
    for _ in range(rounds if kinds else 0):
        uses = every.where("c > 0").select("word").mapInPandas(_expectation(pieces), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        weights = np.full(len(names), 0.01)
        for r in uses.collect():  # as many rows as the vocabulary has pieces at most
            weights[r["piece"]] += r["uses"]
        pieces = Pieces(names, weights)

    seen = F.greatest(F.col("c") - discount, F.lit(0.0)) / max(total, 1)
    free = discount * kinds / total if total else 1.0
    ln10 = math.log(10)
    first = math.log(1 - end) if end < 1 else -math.inf
    # in log space: a long word's spelling has no positive double
    spelled = F.col("spelled") + math.log(free)
    mixed = F.when(seen > 0, F.log(seen) + F.log1p(F.exp(F.least(F.lit(700.0), spelled - F.log(seen))))).otherwise(spelled)
    scored = every.mapInPandas(_spelled(pieces), "word string, n long, c long, spelled double").select(
        "word",
        "n",
        (F.col("c") > 0).cast("int").alias("known"),
        F.log10((F.col("c") + 1) / F.lit(float(tokens + distinct + 1))).alias("base"),
        ((mixed + first) / ln10).alias("score"),
    )
    scored = scratch.save(scored, "scored")
    scratch.drop("words")

    short = F.octet_length("word") <= MOST_BYTES
    # bins of an eighth of a doubling, so the most frequent words have bins of their own whatever the corpus
    bin_of = F.floor(F.log2("n") * 8).cast("int")
    sizes = scored.where(short).groupBy(bin_of.alias("bin")).count().orderBy(F.col("bin").desc()).collect()
    least, so_far = 1 << 30, 0
    for r in sizes:
        so_far += r["count"]
        if so_far > FREQUENT:
            break
        least = r["bin"]
    top = scored.where(short & (bin_of >= least)).select("word", "known", "base", "score").toArrow()
    data, offsets = column_bytes(top.column("word"))
    hashes = Words(data, offsets, lower=True).hashes
    order = np.argsort(hashes)
    values = np.stack([top.column(c).to_numpy().astype(np.float64) for c in ("known", "base", "score")], axis=1)
    shipped = docs.sparkSession.sparkContext.broadcast((hashes[order], values[order]))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _postings(*shipped.value)(batches)

    parts = scratch.save(rows.mapInArrow(postings, _POSTING), "postings")
    heads = parts.where("word is null").select("rid", "doc_id", "n", "known", "base", "score", F.lit(1).alias("head"))
    rare = parts.where("word is not null").select("rid", "word", F.col("n").alias("times"))
    tails = rare.join(scored.where(~(short & (bin_of >= least))).select("word", "known", "base", "score"), "word").select(
        "rid",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("n"),
        (F.col("times") * F.col("known")).alias("known"),
        (F.col("times") * F.col("base")).alias("base"),
        (F.col("times") * F.col("score")).alias("score"),
        F.lit(0).alias("head"),
    )
    summed = heads.unionByName(tails).groupBy("rid").agg(*[F.max("doc_id").alias("doc_id")], *[F.sum(c).alias(c) for c in ("n", "known", "base", "score")])
    end_base = math.log10((ends + 1) / (tokens + distinct + 1))
    return summed.select(
        "doc_id",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("score") + math.log10(end)).alias("score"),
    )


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = lattice_scores(table(spark, sf_dir, "documents"), ~held_out, vocabulary_path())
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
