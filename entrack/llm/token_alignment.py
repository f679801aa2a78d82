"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

The rule, as ``token_links`` states it relationally: explode both token lists with their positions, sum byte lengths up to each token,
join the tokens of both sides that end at one byte of one text, count those cuts before each token as its group, and
link the tokens of one group whose byte ranges overlap. That makes several rows a token, so ``alignments`` takes the
same steps inside tasks, on arrays: texts are cut at single spaces, where both tokenizers always end a token, each
distinct part of a slice of documents is encoded and aligned once, and documents are put together from their parts. How many documents hold a
pair of ids linked, and which pairs are an id's most frequent, are Spark aggregates over the corpus, joined back to
the documents' distinct pairs.

Defined cases: a text that is null or empty, or that either side doesn't give back byte by byte, has no tokens and
zeros everywhere; ids may be null or repeat; an empty table gives an empty result. Special strings in texts are
plain text. A text of any length is aligned whole: memory is that of one slice, or of the longest text. Other columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, salted_join, table

#: A pair of ids is a * PAIR + b.
PAIR = 1 << 32
#: A table of so many pairs, 16 bytes each, is sent to every executor; a larger one is joined by shuffle.
MOST_SENT = 4_000_000
#: A task remembers so many parts and characters of parts; beyond, it begins anew.
KEPT_PARTS, KEPT_CHARS = 250_000, 8_000_000
#: Documents are taken together up to so many characters.
SLICE_CHARS = 1 << 21
#: A space at which the next part begins: no space before it, no white space after it.
_CUT = re.compile(r"(?<! )(?= \S)")
_ODD = re.compile(r" (?:\s|\Z)")
#: Fixed value: the pattern of byte-level pre-tokenisers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Shorter texts go through the encoder by ranks, whose time grows with the square of a piece.
SHORT_CHARS = 500


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Sides:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from entrack.llm.token_counts import byte_alphabet

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_alphabet().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(back.get(c, 0) for c in n) for n in names]
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        every = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in every]
        self.size_b = list(map(len, self.bytes_b))
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        if self.a.normalizer is not None or len(set(self.bytes_a) & {bytes([b]) for b in range(256)}) < 256:
            raise ValueError(f"{byte_level} does not give every text back byte by byte")
        self.short = self._by_ranks(byte_level)
        # a piece with a space inside would reach over a cut
        self.cuts = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.bytes_b)

    def _by_ranks(self, byte_level: str):
        """The same vocabulary as ranks, which short texts are encoded by in a quarter of the time; none where ids don't follow the merges."""
        import tiktoken

        with open(byte_level, encoding="utf-8") as file:  # part of the installation on every machine
            model = json.load(file)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"][x + y] != 256 + k for k, (x, y) in enumerate(pairs)):
            return None
        ranks = {self.bytes_a[k]: k for k in range(256 + len(pairs))}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.short is None:
            return [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        return [self.short(" " + t) if len(t) < SHORT_CHARS else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text on both sides; both empty where the bytes differ from it."""
        ids_a = self._ids_a(texts)
        ids_b = self.b.encode(texts, num_threads=1)
        whole = [b" " + t.encode() for t in texts]
        sizes = [sum(map(self.size_b.__getitem__, ids)) for ids in ids_b]
        alike = sizes == list(map(len, whole)) and b"".join(map(self.bytes_b.__getitem__, chain.from_iterable(ids_b))) == b"".join(whole)
        for k in () if alike else range(len(texts)):
            if not texts[k] or b"".join(map(self.bytes_b.__getitem__, ids_b[k])) != whole[k]:
                ids_a[k] = ids_b[k] = []
        return ids_a, ids_b

    def parts(self, text: str) -> list[str]:
        """The text at its cuts, each part without the space that begins it."""
        if not self.cuts:
            return [text]
        if "  " in text or text[0].isspace() or _ODD.search(text):
            found = _CUT.split(" " + text)
            return [p[1:] for p in found if p]
        return text.split(" ")


class Parts:
    """Aligned parts: counts, group text and linked pairs of each."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def learn(self, wanted: list[str]) -> None:
        new = [w for w in wanted if w not in self.at]
        size = sum(map(len, new))
        if self.at and (len(self.at) + len(new) > KEPT_PARTS or self.chars + size > KEPT_CHARS):
            self.forget()
            new, size = wanted, sum(map(len, wanted))
        self.chars += size
        if not new:
            return
        self.at.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        ids_a, ids_b = self.sides.encoded(new)
        counts, texts, rows, pairs, times = aligned(ids_a, ids_b, self.sides.len_a, self.sides.len_b)
        self.counts = np.concatenate([self.counts, counts])
        self.texts += texts
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(rows, minlength=len(new)))])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])


def aligned(ids_a: list[list[int]], ids_b: list[list[int]], len_a: np.ndarray, len_b: np.ndarray) -> tuple:
    """Counts (tokens of a, of b, groups, links) and group texts by row, and linked pairs by (row, pair, times).

    Both sides of a row have the same bytes in all, so ends counted over all rows together tell where both end.
    """
    n = len(ids_a)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    row_a = np.repeat(np.arange(n), n_a)
    cut_a, cut_b = (ys[np.minimum(np.searchsorted(ys, xs), len(ys) - 1)] == xs if len(ys) else np.zeros(len(xs), bool) for xs, ys in ((ends_a, ends_b), (ends_b, ends_a)))
    groups = np.bincount(row_a[cut_a], minlength=n)
    # every byte at which a token of either side ends closes one overlap
    seams = np.sort(np.concatenate([ends_a, ends_b[~cut_b]]))
    at_a, at_b = np.searchsorted(ends_a, seams), np.searchsorted(ends_b, seams)
    row = row_a[at_a]
    order = np.lexsort((b[at_b], a[at_a], row))
    pair, row = (a[at_a] * PAIR + b[at_b])[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])[: len(pair)])
    times = np.diff(np.concatenate([first, [len(pair)]]))
    stops_a, stops_b = (np.flatnonzero(cut) + 1 for cut in (cut_a, cut_b))
    words_a, words_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    sides_a = [",".join(words_a[i:j]) for i, j in pairwise([0, *stops_a.tolist()])]
    sides_b = [",".join(words_b[i:j]) for i, j in pairwise([0, *stops_b.tolist()])]
    joined = [f"{x}|{y}" for x, y in zip(sides_a, sides_b, strict=True)]
    texts = [";".join(joined[i:j]) for i, j in pairwise(accumulate(groups.tolist(), initial=0))]
    counts = np.stack([n_a, n_b, groups, np.bincount(row, minlength=n)], axis=1)
    return counts, texts, row[first], pair[first], times


def _documents(known: Parts, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """As ``aligned``, for whole documents: counts, digests, starts of each document's pairs, pairs, times."""
    n = len(texts)
    lists = [known.sides.parts(t) if t else [] for t in texts]
    known.learn(list(dict.fromkeys(chain.from_iterable(lists))))
    sizes = np.array([len(ps) for ps in lists], np.int64)
    part = np.array(list(map(known.at.__getitem__, chain.from_iterable(lists))), np.int64)
    doc = np.repeat(np.arange(n), sizes)
    lost = np.bincount(doc, weights=known.counts[part, 0] == 0, minlength=n) > 0
    keep = ~lost[doc]
    part, doc, sizes = part[keep], doc[keep], np.where(lost, 0, sizes)
    counts = np.stack([np.bincount(doc, weights=known.counts[part, c], minlength=n).astype(np.int64) for c in range(4)], axis=1)
    at, digests = np.concatenate([[0], np.cumsum(sizes)]).tolist(), []
    ids = part.tolist()
    for i, j in pairwise(at):
        text = ";".join([known.texts[p] for p in ids[i:j]])
        digests.append(hashlib.sha256(text.encode()).hexdigest() if i < j else "")
    uses, times = np.unique(doc * len(known.texts) + part, return_counts=True)
    doc, part = uses // max(len(known.texts), 1), uses % max(len(known.texts), 1)
    wide = known.starts[part + 1] - known.starts[part]
    flat = np.arange(wide.sum()) + np.repeat(known.starts[part] - (np.cumsum(wide) - wide), wide)
    doc, pair, times = np.repeat(doc, wide), known.pairs[flat], known.times[flat] * np.repeat(times, wide)
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])[: len(pair)])
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=n))])
    return counts, digests, starts, pair[first], np.add.reduceat(times, first) if len(first) else times


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, paths: tuple[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row.

    ``pairs`` holds the row's distinct linked pairs of ids, ``times`` how often each is linked in it.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parts(Sides(*paths))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, lo = 0, 0
            for hi, t in enumerate(texts, 1):
                sizes += len(t)
                if sizes < SLICE_CHARS and hi < len(texts):
                    continue
                counts, digests, starts, pairs, times = _documents(known, texts[lo:hi])
                columns = [batch.column("doc_id")[lo:hi], *[pa.array(counts[:, c]) for c in range(4)], pa.array(digests, pa.string())]
                at = pa.array(starts, pa.int32())
                columns += [pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"])
                sizes, lo = 0, hi

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(align, schema)


def corpus_pairs(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each pair, and whether no pair of its first id is held by more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # a group has no more rows than the other vocabulary ids
    return counts.withColumn("best", F.col("n") == most)


def aligned_documents(docs: DataFrame, paths: tuple[str, str], doc_id: str = "doc_id", text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """``alignments`` with ``n_best`` and ``count_sum`` from the whole corpus in place of the pairs."""
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.save(alignments(docs, paths, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "rows")
    known = scratch.save(corpus_pairs(rows), "pairs")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    size, total = known.agg(F.count("*"), F.sum("n")).first()
    if size <= most_sent:
        held = links.join(F.broadcast(known), "pair").withColumnRenamed("n", "held")
    else:
        held = salted_join(links, known.withColumn("held", F.col("n")), ["pair"], ["row"], total)
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *_COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def token_links(docs: DataFrame, paths: tuple[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, grp, a_pos, b_pos, a, b, start, end): every overlap of two tokens, by joins and windows alone.

    ``start`` and ``end`` are the bytes of the overlap in a space and the text. Only the encoding runs in Python.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(*paths)
        for batch in batches:
            ids_a, ids_b = sides.encoded([t or "" for t in batch.column("text").to_pylist()])
            lists = [pa.array([[{"id": i, "bytes": int(n[i])} for i in x] for x in ids], pa.list_(pa.struct([("id", pa.int64()), ("bytes", pa.int64())]))) for ids, n in ((ids_a, sides.len_a), (ids_b, sides.len_b))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "a", "b"])

    token = "array<struct<id: long, bytes: long>>"
    scratch = Scratch(docs.sparkSession, "links")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id long, a {token}, b {token}")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")
    upto = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def exploded(side: str) -> DataFrame:
        every = rows.select("row", F.posexplode(side).alias("pos", "token")).select("row", "pos", "token.*")
        return every.withColumn("end", F.sum("bytes").over(upto)).withColumn("start", F.col("end") - F.col("bytes"))

    sides = {side: exploded(side) for side in "ab"}
    cuts = sides["a"].select("row", "end").join(sides["b"].select("row", "end"), ["row", "end"]).withColumn("cut", F.lit(1))

    def grouped(side: str) -> DataFrame:
        marked = sides[side].join(cuts, ["row", "end"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
        group = F.sum("cut").over(upto) - F.col("cut")
        return marked.select("row", group.alias("grp"), F.col("pos").alias(f"{side}_pos"), F.col("id").alias(side), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))

    met = grouped("a").join(grouped("b"), ["row", "grp"]).where("a_start < b_end AND b_start < a_end")
    spans = met.select("row", "grp", "a_pos", "b_pos", "a", "b", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
    return rows.select("row", "doc_id").join(spans, "row")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"), vocabulary_paths())


ORACLE_SQL = None
