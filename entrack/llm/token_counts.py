"""Exact token counts at every prefix of a text.

A text is cut into the pieces that the vocabulary's pre-tokeniser makes, and every piece carries the
number of tokens that each of its own prefixes has. The recursion count[i] = count[start of piece] +
piece_count[i - start] then gives the exact number of tokens of text[:i] for every i, so truncation and
budget questions are answered from the stored table and no text is encoded again.

Piece tables come from a dynamic program over the vocabulary's merges: the last token of each prefix is
the one that may follow the last token of what is before it. Texts whose normalisation is not one to one are
normalised cluster by cluster, a base character with what composes onto it, and every character of the text keeps
the place where its normal form ends; a prefix that ends inside a cluster continues the program from the cluster's
beginning with the part's own normal form. Special strings are one token once they are complete.

The increments are part of the result, so any budget is answered from them; a run of any length without white
space costs time in proportion to its length.

Defined cases: a null or empty text has 0 bytes, 0 tokens and an empty table; nulls elsewhere and extra
columns change nothing; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate
from os.path import commonprefix

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.common import table

#: Characters that lower-casing maps one to one and composition leaves alone.
PLAIN = r"[\t-\r\x20-\x7e\xa1-\xa7\xa9-\xff‐-‧一-龥ぁ-ゖ]*"
#: Fixed by the vocabulary file: its pre-tokeniser's pattern, with letters and numbers spelled out for
#: lower-cased plain text; runs of white space, which it drops, are pieces of no tokens here.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ一-龥ぁ-ゖ", "0-9²³¹¼-¾"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r {_LETTERS}{_NUMBERS}]+|[\t-\r ]+"
_SPACE = "\t\n\x0b\x0c\r "
#: The same pattern over all of Unicode, and its white space.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANY_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
_LETTER, _BLANKS = regex.compile(r"\p{L}"), regex.compile(rf"[{_BLANK}]")
#: Contractions that begin like two pieces.
_LATE = ("'re", "'ve", "'ll")
_NEAR = 64
END = "</w>"
CACHE_PIECES = 500_000
_SLICE = 1000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pack(steps: list[int]) -> bytes:
    return array("h", steps).tobytes()


class MergeTable:
    """Merges of a vocabulary file, and prefix counts of a piece of any length."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.parts = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        #: What a run of symbols can be: 1 a token inside a word, 2 one that ends it, 3 both.
        self.kinds: dict[str, int] = {}
        for t in model["vocab"]:
            body = t.removesuffix(END)
            self.kinds[body] = self.kinds.get(body, 0) | (1 if body == t else 2)
        #: The length of the longest token by its last symbol.
        self.longest: dict[str, int] = {}
        for t in self.kinds:
            self.longest[t[-1:]] = max(self.longest.get(t[-1:], 0), len(t))
        self.alphabet = byte_alphabet()
        self.fits: dict[tuple[str, str], bool] = {}

    def follows(self, left: str, token: str) -> bool:
        """Whether token may stand after left: no merge ever joins them across their border.

        Undoes the merges inside both, the latest first, and looks at the two symbols at the border
        each time: they would have joined if their own merge came before the one that used one of them
        (equal merges run from left to right).
        """
        if not left:
            return True
        key = (left, token)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, token)
        return known

    def _apart(self, x: str, y: str) -> bool:
        rank, parts = self.rank, self.parts
        until = len(rank)
        while rank.get((x, y), until) >= until:
            of_x, of_y = parts.get(x), parts.get(y)
            if of_x is None and of_y is None:
                return True
            if of_y is None or (of_x is not None and of_x[0] > of_y[0]):
                until, x = of_x[0], of_x[2]
            else:
                until, y = of_y[0] + 1, of_y[1]
        return False

    def prefix_counts(self, pieces: list[str]) -> Iterator[list[int]]:
        """Tokens of piece[:1], piece[:2], ..., piece for each piece; sorted pieces share their beginnings.

        last[i] is the last token of the first i symbols inside a word, inner[i] their number of tokens and
        ending[i] that number when the word ends there. A token may come last where it follows the last
        token of what is before it; exactly one does.
        """
        last, inner, ending, before = [""], [0], [0], ""
        for piece in pieces:
            s, ends = self.coded(piece)
            shared = len(commonprefix((before, s)))
            del last[shared + 1 :], inner[shared + 1 :], ending[shared + 1 :]
            self.walk(s, last, inner, ending)
            before = s
            yield [ending[i] for i in ends]

    def coded(self, piece: str) -> tuple[str, list[int]]:
        """A piece's bytes as symbols, and where each character ends."""
        if piece.isascii():
            return piece, list(range(1, len(piece) + 1))
        coded = [ch.encode("utf-8", "surrogatepass") for ch in piece]
        return "".join(self.alphabet[b] for c in coded for b in c), list(accumulate(map(len, coded)))

    def walk(self, s: str, last: list[str], inner: list[int], ending: list[int]) -> None:
        """Continues the program to the end of s from the beginning that the three lists cover."""
        kinds, follows, longest = self.kinds, self.follows, self.longest
        for i in range(len(last), len(s) + 1):
            needed, closed = 3, 0
            for n in range(min(longest[s[i - 1]], i), 0, -1):
                t = s[i - n : i]
                kind = kinds.get(t)
                if kind is None or not (kind := kind & needed):
                    continue
                left = last[i - n]
                if kind & 1 and follows(left, t):
                    last.append(t)
                    inner.append(inner[i - n] + 1)
                    needed -= 1
                if kind & 2 and follows(left, t + END):
                    closed = inner[i - n] + 1
                    needed -= 2
                if not needed:
                    break
            ending.append(closed)

    def continued(self, s: str, at: int, last: list[str], inner: list[int], more: str) -> int:
        """Tokens of s[:at] with other symbols behind it, from the program's lists for s."""
        start = max(0, at - max(self.longest.values()))
        near_last, near_inner, ends = last[start : at + 1], inner[start : at + 1], [0] * (at - start + 1)
        self.walk(s[start:at] + more, near_last, near_inner, ends)
        return ends[-1]


class Clusters:
    """Cuts texts into clusters that normalise by themselves."""

    def __init__(self):
        pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
        tails = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
        jamo = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
        #: Characters without a combining class that may still join the one before.
        self.tails = {c for c in tails if not unicodedata.combining(c)} | jamo
        self.forms: dict[str, str] = {}

    def cut(self, text: str) -> list[str]:
        out: list[str] = []
        for c in text:
            if out and (unicodedata.combining(c) or c in self.tails):
                out[-1] += c
            else:
                out.append(c)
        return out

    def form(self, cluster: str) -> str:
        """The normal form: composed, white space as a space, lower case character by character."""
        known = self.forms.get(cluster)
        if known is None:
            if len(self.forms) > 200_000:
                self.forms.clear()
            known = "".join(" " if _BLANKS.match(c) else c.lower() for c in unicodedata.normalize("NFC", cluster))
            self.forms[cluster] = known
        return known


class PrefixCounter:
    """Turns texts into per-character increments of the token count."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = MergeTable(path)
        self.plain = re.compile(PLAIN)
        self.pieces = re.compile(PIECES)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.clusters: Clusters | None = None
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = list(pieces)
        spaces = [p for p in new if p[0] in _SPACE]
        self.cache.update((p, bytes(2 * len(p))) for p in spaces)
        words = sorted(p for p in new if p[0] not in _SPACE)
        for p, counts in zip(words, self.merges.prefix_counts(words), strict=True):
            if p in _LATE:  # its beginning is a sign and a letter, which are two pieces
                counts = [counts[0], counts[0] + next(self.merges.prefix_counts([p[1]]))[0], counts[2]]
            self.cache[p] = pack([b - a for a, b in zip([0, *counts], counts, strict=False)])

    def _size(self, piece: str) -> int:
        self._learn([piece])
        return int(np.frombuffer(self.cache[piece], "<i2").sum(dtype=np.int64))

    def _rare(self, text: str) -> bytes:
        """Increments of a text that is not plain."""
        counts: list[int] = []
        at, base = 0, 0
        for m in self.specials.finditer(text):
            own = self._clustered(text[at : m.end() - 1])
            counts += [base + c for c in own]
            base += (own[m.start() - at - 1] if m.start() > at else 0) + 1
            counts.append(base)
            at = m.end()
        counts += [base + c for c in self._clustered(text[at:])]
        return pack([b - a for a, b in zip([0, *counts], counts, strict=False)])

    def _clustered(self, text: str) -> list[int]:
        """The count at every prefix of a text without special strings."""
        self.clusters = self.clusters or Clusters()
        parts = self.clusters.cut(text)
        forms = [self.clusters.form(c) for c in parts]
        flat = "".join(forms)
        found = list(ANY_PIECE.finditer(flat))
        self._learn([m.group() for m in found])
        upto, reached, total = [0] * (len(flat) + 1), 0, 0
        begins = [0] * (len(flat) + 1)  # by place: where the piece before it begins, or the place itself
        for m in found:
            a, b = m.span()
            for i in range(reached, a):
                upto[i + 1], begins[i + 1] = total, i + 1
            for i, step in enumerate(np.frombuffer(self.cache.get(m.group()) or self._again(m.group()), "<i2").tolist()):
                total += step
                upto[a + i + 1], begins[a + i + 1] = total, a
            reached = b
        for i in range(reached, len(flat)):
            upto[i + 1], begins[i + 1] = total, i + 1
        out, at, held = [], 0, (-1, "", [], [], [])
        for part, form in zip(parts, forms, strict=True):
            for k in range(1, len(part)):
                begin = begins[at]
                inside = self.clusters.form(part[:k])
                if at - begin <= _NEAR:
                    tokens = sum(self._size(p) for p in ANY_PIECE.findall(flat[begin:at] + inside))
                else:
                    if held[0] != begin:
                        end = next(m.end() for m in found if m.start() == begin)
                        s, ends = self.merges.coded(flat[begin:end])
                        held = (begin, s, ends, [""], [0])
                        self.merges.walk(s, held[3], held[4], [0])
                    same = bool(_LETTER.match(flat[at - 1]))
                    n = 0
                    while n < len(inside) and bool(_LETTER.match(inside[n])) == same and ANY_PIECE.match(inside[n]) and (same or not regex.match(r"\p{N}", inside[n])):
                        n += 1
                    symbols = self.merges.coded(inside[:n])[0]
                    tokens = self.merges.continued(held[1], held[2][at - begin - 1], held[3], held[4], symbols)
                    tokens += sum(self._size(p) for p in ANY_PIECE.findall(inside[n:]))
                out.append(upto[begin] + tokens)
            at += len(form)
            out.append(upto[at])
        return out

    def _again(self, piece: str) -> bytes:
        """A piece that a full cache has dropped."""
        self._learn([piece])
        return self.cache[piece]

    def _cut(self, texts: list[str]) -> list[list[str] | None]:
        """The pieces of each text; None for a text that is not plain."""
        return [
            self.pieces.findall(t.lower()) if self.plain.fullmatch(t) is not None and not any(s in t for s in self.special) else None
            for t in texts
        ]

    def learn(self, texts: list[str]) -> None:
        """Piece tables for all of ``texts`` at once: sorted pieces share the work of their beginnings."""
        pieces: set[str] = set()
        for lo in range(0, len(texts), _SLICE):
            for c in self._cut(texts[lo : lo + _SLICE]):
                pieces.update(c or ())
        self._learn(pieces)

    def increments(self, texts: list[str]) -> list[bytes]:
        """For each text, whose pieces have been learnt, a little-endian int16 per code point: what that character adds to the count."""
        cut = self._cut(texts)
        out = []
        for t, c in zip(texts, cut, strict=True):
            out.append(self._rare(t) if c is None else b"".join([self.cache[p] for p in c]))
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def fitting_chars(increments: bytes, budget: int) -> int:
    """The longest prefix, in code points, with at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(increments, "<i2"), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prefix_token_counts(
    docs: DataFrame, path: str, budget: int, doc_id: str = "doc_id", text: str = "text", keep_table: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars, prefix_increments) of every row.

    ``prefix_increments`` holds an int16 for each code point; its running sum is the token count at every
    prefix. ``fit_chars`` is the longest prefix within ``budget`` tokens. ``path`` is the vocabulary file,
    which has the same place on every machine.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, fit_chars long" + ", prefix_increments binary" * keep_table

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = counter(path)
        for batch in batches:
            every = [t if isinstance(t, str) else "" for t in batch["text"]]
            tables.learn(every)
            for lo in range(0, len(batch), _SLICE):
                part, texts = batch.iloc[lo : lo + _SLICE], every[lo : lo + _SLICE]
                inc = tables.increments(texts)
                out = pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n_bytes": [len(t.encode("utf-8")) for t in texts],
                        "n_tokens": [int(np.frombuffer(x, "<i2").sum(dtype=np.int64)) for x in inc],
                        "fit_chars": [fitting_chars(x, budget) for x in inc],
                    }
                )
                yield out.assign(prefix_increments=inc) if keep_table else out

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, schema)


TOKEN_LIMIT = 2048


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), TOKEN_LIMIT, keep_table=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars", "prefix_increments")


ORACLE_SQL = None
