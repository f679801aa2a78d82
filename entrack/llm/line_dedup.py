"""Line dedup by content-defined chunks of lines.

Lines end at line feeds and sentence ends and, inside sentences, before words whose hash is the least of some
LINE_WINDOW neighbouring words, so no line has more than LINE_WINDOW words, in any language. A rolling hash over
SPAN line hashes chooses chunk borders: in any WINDOW neighbouring places the least hash is one. Borders depend on
nothing further off than a window, so a passage of 50 words (LINE_WINDOW * (SPAN + WINDOW - 1) words and
LINE_WINDOW - 1 at both ends) has the same border, with its SPAN lines, wherever it stands.

The SPAN lines from a border on that occur elsewhere have the first occurrence (smallest document id, then key and
place) as their model. Neighbouring chunks with one model and one distance to it form a run; the run and what is
around it, up to WINDOW lines to both sides, is compared byte by byte, word for word, with the model's text. Beyond
that, the next run takes over: borders of a repeated passage are never further apart. Words that agree are cut where
they add up to ``least_words`` at least, so of each passage the first occurrence stays. White space is not compared.

Words are runs without ASCII white space; full stops of scripts without spaces end one too. Hashes have 64 bits; of
two different spans with one hash, only the first one's repetitions are found by that span.

Defined cases: null and empty texts are returned as they are; ids may be null (they come first in the order);
rows that repeat an id with the same text are one document, cut or left alike; a text that repeats a passage
keeps the first one; a text without white space is one line; an empty table gives an empty result; extra columns
are returned untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.byte_words import Words, column_bytes, mixed, slices, window_minima
from entrack.llm.common import Scratch, fresh, salted_join, table

LEAST_WORDS = 32
LINE_WINDOW, SPAN, WINDOW = 2, 10, 15
#: Borders of one passage are never further apart, in words.
GAP = LINE_WINDOW * WINDOW + LINE_WINDOW
#: Runs are compared in blocks of so many words of the model.
RUN_BLOCK = 512
#: Per-document marks are broadcast up to so many bytes; beyond, the join is a shuffle.
BROADCAST_BYTES = 48_000_000
_STOPS = "。！？"
_STOP_BYTES = [s.encode() for s in _STOPS]
_WORD = re.compile(rf"[^\x20\x09-\x0D{_STOPS}]*[{_STOPS}]+|[^\x20\x09-\x0D{_STOPS}]+")
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(2**63)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text that begins and ends at word borders."""
    if any(s in text for s in _STOP_BYTES):
        return [w.encode() for w in _WORD.findall(text.decode())]
    return text.split()


def _stop_ends(data: np.ndarray) -> np.ndarray:
    """Places behind a full stop of a script without spaces, where no other stop follows."""
    ends = [np.flatnonzero((data[:-2] == s[0]) & (data[1:-1] == s[1]) & (data[2:] == s[2])) + 3 for s in _STOP_BYTES] if len(data) > 2 else []
    found = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    return np.setdiff1d(found[found < len(data)], found - 3)


class Lines:
    """The lines of all texts of a batch: first word of each, text it belongs to, border places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        has_stops = bool(len(data)) and bool(np.isin(data, [0xE3, 0xEF]).any())
        stops = _stop_ends(data) if has_stops else np.zeros(0, np.int64)
        self.words = w = Words(data, offsets, breaks=stops)
        n = len(w.starts)
        begins = np.zeros(n + 1, dtype=bool)
        begins[w.first] = True
        begins[window_minima(w.hashes, w.doc, LINE_WINDOW)] = True
        begins[np.searchsorted(w.starts, np.flatnonzero(data == 10))] = True
        if n:
            begins[1:] |= np.isin(data[w.ends - 1], [33, 46, 63])
        if len(stops):
            begins[np.searchsorted(w.starts, stops)] = True
        self.starts = np.flatnonzero(begins[:n])
        self.doc = w.doc[self.starts]

    def hashes(self) -> np.ndarray:
        """A hash of each line's words."""
        words, n = self.words.hashes, len(self.starts)
        edges = np.append(self.starts, len(words))
        sizes = np.diff(edges)
        out = words[self.starts] + _ROLL if n else np.zeros(0, np.uint64)
        for k in range(1, LINE_WINDOW):
            more = np.flatnonzero(sizes > k)
            out[more] = out[more] * _ROLL + words[self.starts[more] + k]
        return mixed(out)

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash of its span) of every chunk border."""
        lines = self.hashes()
        n = len(lines) - SPAN + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = lines[:n].copy()
        for k in range(1, SPAN):
            rolled = rolled * _ROLL + lines[k : n + k]
        rolled = mixed(rolled)
        places = window_minima(rolled, self.doc, WINDOW, SPAN - 1) if n >= WINDOW else np.zeros(0, np.int64)
        # inside a line that repeats itself every span is a border; WINDOW / 2 lines apart they do
        same = np.zeros(len(places), dtype=bool)
        same[1:] = (rolled[places[1:]] == rolled[places[:-1]]) & (places[1:] == places[:-1] + 1)
        since = np.arange(len(places)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(places)))) if len(places) else same
        places = places[since % (WINDOW // 2) == 0]
        return places, rolled[places]


_CHUNK = "doc_id long, key long, at int, h long"


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lines = Lines(*column_bytes(part.column("text")))
            places, hashes = lines.chunks()
            if not len(places):
                continue
            doc = lines.doc[places]
            ids, keys = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "key"))
            at = (lines.starts[places] - lines.words.first[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(at), pa.array(hashes.view(np.int64))], ["doc_id", "key", "at", "h"])


_RUN = "key long, a int, z int, model long, ma int, mz int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first and last chunk place, model's key, its first and last chunk place) of every run."""
    for batch in batches:
        marks = batch.column("marks")
        rows = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
        at, model, place = (marks.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("at", "model", "place"))
        if not len(at):
            continue
        order = np.lexsort((at, rows))
        rows, at, model, place = rows[order], at[order], model[order], place[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (model[1:] != model[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] - at[:-1] > GAP)
        new[1:] |= place[1:] // RUN_BLOCK != place[:-1] // RUN_BLOCK
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at)) - 1
        keys = batch.column("key").to_numpy(zero_copy_only=False)[rows[lo]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, at[lo], at[hi], model[lo], place[lo], place[hi])], ["key", "a", "z", "model", "ma", "mz"])


class _Text:
    """One text of a batch with its words (byte places in the text) and the first words of its lines."""

    def __init__(self, lines: Lines, i: int):
        words = lines.words
        at, lo, hi = int(words.offsets[i]), int(words.first[i]), int(words.first[i + 1])
        self.text = words.data[at : int(words.offsets[i + 1])].tobytes()
        self.starts, self.ends = words.starts[lo:hi] - at, words.ends[lo:hi] - at
        first, last = np.searchsorted(lines.starts, (lo, hi))
        self.edges = np.append(lines.starts[first:last], hi) - lo

    def around(self, a: int, z: int) -> tuple[int, int, int, int]:
        """Words: WINDOW lines before a, a, the end of the SPAN lines from z on, WINDOW lines beyond."""
        edges, last = self.edges, len(self.edges) - 1
        i, j = (np.searchsorted(edges, (a, z), "right") - 1).tolist()
        end = min(j + SPAN, last)
        return int(edges[max(0, i - WINDOW)]), a, int(edges[end]), int(edges[min(end + WINDOW, last)])

    def slice(self, a: int, b: int) -> bytes:
        return self.text[self.starts[a] : self.ends[b - 1]] if b > a else b""


def _texts(part: pa.RecordBatch) -> list[_Text]:
    lines = Lines(*column_bytes(part.column("text")))
    return [_Text(lines, i) for i in range(part.num_rows)]


def _lists(column: pa.ListArray, fields: list[str]) -> list[list[tuple]]:
    """The structs of a list column as tuples, by row."""
    sizes = column.value_lengths().to_pylist()
    flat = column.flatten()
    rows = zip(*[flat.field(f).to_pylist() for f in fields], strict=True)
    return [[next(rows) for _ in range(n)] for n in sizes]


_SLICE = "model long, ma int, mz int, before binary, body binary, after binary"


def _model_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted run of a model, and what is around it."""
    names = ["model", "ma", "mz", "before", "body", "after"]
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for key, one, wants in zip(part.column("key").to_pylist(), _texts(part), _lists(part.column("wants"), ["ma", "mz"]), strict=True):
                for ma, mz in wants:
                    p, a, b, q = one.around(ma, mz)
                    rows.append((key, ma, mz, one.slice(p, a), one.slice(a, b), one.slice(b, q)))
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _leading(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def agreeing(one: _Text, run: tuple[int, int], model: tuple[bytes, bytes, bytes]) -> list[tuple[int, int]]:
    """Words of a run and around it that are the same, byte for byte, in the model's text: (first, one past the last)."""
    p, a, b, q = one.around(*run)
    before, body, after = model
    own = one.slice(a, b)
    if own == body:
        found = [[a, b]]
    else:
        same = [x == y for x, y in zip(words_of(own), words_of(body), strict=False)]
        edges = np.flatnonzero(np.diff(np.array([0, *same, 0], np.int8)))
        found = (edges.reshape(-1, 2) + a).tolist()
    if found and found[0][0] == a:
        found[0][0] -= _leading(words_of(one.slice(p, a))[::-1], words_of(before)[::-1])
    if found and found[-1][1] == b:
        found[-1][1] += _leading(words_of(one.slice(b, q)), words_of(after))
    return [(i, j) for i, j in found]


def spans_of(one: _Text, found: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """Byte spans of the passages that agreeing words add up to, with ``least_words`` at least."""
    cover = np.zeros(len(one.starts) + 1, np.int64)
    for a, b in found:
        cover[a] += 1
        cover[b] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]]))).reshape(-1, 2).tolist()
    return [(int(one.starts[a]), int(one.ends[b - 1])) for a, b in edges if b - a >= least_words]


_GROWN = "key long, spans array<struct<start:int,end:int>>"


def _compared(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, one, runs in zip(part.column("key").to_pylist(), _texts(part), _lists(part.column("runs"), ["a", "z", "before", "body", "after"]), strict=True):
                    found = [pair for a, z, *model in runs for pair in agreeing(one, (a, z), tuple(model))]
                    spans = spans_of(one, found, least_words)
                    if spans:
                        rows.append((key, [{"start": a, "end": b} for a, b in spans]))
                if rows:
                    keys, spans = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["key", "spans"])

    return run


def _listed(marks: DataFrame, each: str, width: int) -> DataFrame:
    """The table, to be broadcast where its bytes allow it."""
    rows, parts = marks.agg(F.count("*"), F.coalesce(F.sum(F.size(each)), F.lit(0))).first()
    return F.broadcast(marks) if 64 * rows + width * parts <= BROADCAST_BYTES else marks


def grown_spans(docs: DataFrame, doc_id: str, text: str, least_words: int, scratch: Scratch) -> DataFrame:
    """(key, spans) of the documents with passages to cut; spans in bytes of UTF-8."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id"), document_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    chunks = scratch.save(rows.mapInArrow(_chunk_rows, _CHUNK), "chunks")
    first = F.min(F.struct("doc_id", F.col("key").alias("model"), F.col("at").alias("place")))
    repeated = chunks.groupBy("h").agg(F.count("*").alias("n"), first.alias("m")).where("n > 1").select("h", "n", "m.model", "m.place")
    repeated = scratch.save(repeated, "repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marks = salted_join(chunks.select("h", "key", "at"), repeated, ["h"], ["key"], total).where("not (key = model and at = place)")
    marks = scratch.save(marks.groupBy("key").agg(F.collect_set(F.struct("at", "model", "place")).alias("marks")), "marks")
    scratch.drop("chunks", "repeated")
    runs = scratch.save(marks.mapInArrow(_runs, _RUN), "runs")
    wanted = scratch.save(runs.groupBy("model", "ma", "mz").agg(F.count("*").alias("n")), "wanted")
    wants = scratch.save(wanted.groupBy(F.col("model").alias("key")).agg(F.collect_list(F.struct("ma", "mz")).alias("wants")), "wants")
    slices_ = rows.select("key", "text").join(_listed(wants, "wants", 24), "key").mapInArrow(_model_slices, _SLICE)
    place = ["model", "ma", "mz"]
    models = slices_.groupBy(*place).agg(F.first(F.struct("before", "body", "after")).alias("m"))
    models = scratch.save(models.select(*place, "m.*"), "models").join(wanted, place)
    joined = salted_join(runs, models, place, ["key", "a"], runs.count())
    each = joined.groupBy("key").agg(F.collect_list(F.struct("a", "z", "before", "body", "after")).alias("runs"))
    each = scratch.save(each, "compared")
    marked = _listed(scratch.save(each.select("key", F.array().cast("array<int>").alias("none")), "marked"), "none", 0).select("key")
    texts = rows.select("key", "text").join(marked, "key", "left_semi")
    grown = texts.join(each, "key").mapInArrow(_compared(least_words), _GROWN)
    grown = scratch.save(grown.dropDuplicates(["key"]), "grown")
    scratch.drop("marks", "runs", "wanted", "wants", "models", "compared", "marked")
    return grown


def document_key(doc_id: str, text: str) -> Column:
    """One key for each pair of id and text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def cut_text(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[dict[str, int]]]:
    """The text without the byte spans, and the spans in code points."""
    data = text.encode()
    leads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]).decode(), [{"start": int(leads[a]), "end": int(leads[b])} for a, b in spans]


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    found = [cut_text(t, [(s["start"], s["end"]) for s in own]) if isinstance(t, str) and own is not None else (None, []) for t, own in zip(texts, spans, strict=True)]
    return pd.DataFrame(found, columns=["text", "removed"])


def deduplicated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text cut, plus removed_spans (offsets in the old text, code points)."""
    grown = grown_spans(docs, doc_id, text, least_words, Scratch(docs.sparkSession, "line-dedup"))
    key, spans, done = (fresh(docs, c) for c in ("cut_key", "cut_spans", "cut_done"))
    grown = _listed(grown, "spans", 24).select(F.col("key").alias(key), F.col("spans").alias(spans))
    joined = docs.join(grown, document_key(doc_id, text) == F.col(key), "left")
    # texts without spans stay in the JVM
    cut = F.pandas_udf(_cut, "struct<text:string,removed:array<struct<start:int,end:int>>>")
    joined = joined.withColumn(done, cut(F.when(F.col(spans).isNotNull(), docs[text]), F.col(spans)))
    others = [docs[c] if c != text else F.coalesce(F.col(done)["text"], docs[text]).alias(text) for c in docs.columns]
    return joined.select(*others, F.coalesce(F.col(done)["removed"], F.array().cast("array<struct<start:int,end:int>>")).alias("removed_spans"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))).alias("removed"),
        F.length("text").cast("long").alias("chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
