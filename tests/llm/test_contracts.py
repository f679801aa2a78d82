"""The opN queries against brute force or the library, over the whole small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from entrack.llm import queries
from entrack.llm.common import ASCII_LOWER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_duckdb(spark, small, same_as_duckdb, name):
    same_as_duckdb(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


def test_token_counts_equal_the_library(spark, small, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = queries.QUERIES["op9_token_counts"](spark, small).collect()
    assert len(found) == len(documents)
    for r in found:
        text = documents[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 2048)


def base_secrets(text: str) -> tuple[list[int], str]:
    kinds = (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"AKIA[A-Z0-9]+",
        r"[0-9a-f]+",
    )
    names, spans, counts = ("assign", "access", "hex"), [], [0, 0, 0]
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[2 if k == 0 else 0]) >= (6, 20, 24)[k]:
                counts[k] += 1
                spans.append((m.start(), k, m.end()))
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return counts, hashlib.sha256(listed.encode()).hexdigest()


def test_base_secrets(spark, small, documents):
    found = queries.QUERIES["op7_secret_scan"](spark, small).collect()
    assert len(found) == len(documents)
    for r in found:
        counts, digest = base_secrets(documents[r.doc_id])
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, digest)
        assert len([s for s in r.spans.split(",") if s]) == sum(counts) + r.n_random


def test_word_unigram_base(spark, small, documents):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    tokens = {d: WORD.findall(t.translate(ASCII_LOWER)) + [None] for d, t in documents.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for r in queries.QUERIES["op5_lattice_lm"](spark, small).collect():
        own = tokens[r.doc_id]
        expected = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(expected, rel=1e-9)
        assert r.score < 0


def test_lattice_sums_every_segmentation():
    from entrack.llm.lattice_lm import Pieces

    names = [b"a", b"b", b"ab", b"ba", b"aba", b"bb"]
    pieces = Pieces(names, np.array([3.0, 2.0, 4.0, 1.0, 2.5, 0.5]))
    weight = {n: math.exp(w) for n, w in zip(names, pieces.log, strict=False)}

    def brute(word: bytes) -> float:
        return 1.0 if not word else sum(weight[word[:n]] * brute(word[n:]) for n in range(1, len(word) + 1) if word[:n] in weight)

    for word in (b"a", b"abab", b"babbab", b"aabbaabb"):
        symbols = np.frombuffer(word, np.uint8).astype(np.uint64)[None, :]
        assert pieces.log_probability(symbols)[0] == pytest.approx(math.log(brute(word)))
        assert pieces.long_word(word)[1][-1] == pytest.approx(math.log(brute(word)))


def test_toxicity_tells_held_out_documents_apart(spark, small):
    folder = small.replace("0.001", "0.01")
    found = queries.QUERIES["op2_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    toxic = [r.predicted for r in held if r.toxic]
    clean = [r.predicted for r in held if not r.toxic]
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.02


def test_pipeline_keeps_columns_and_packs_every_kept_document(spark, small, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
    packed = corpus_pipeline.run(spark, small)
    ids = [r.doc_id for r in packed.collect()]
    assert len(ids) == len(set(ids)) and 0.4 * len(documents) < len(ids) < len(documents)
