"""Mixing, token alignment and the Merkle manifest: odd rows, planted cases, brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entrack.llm import merkle_manifest, mixing, queries, token_alignment
from entrack.llm.common import Scratch
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, h int, place int, of int, words int, row int, pair int, tree string, path int, n int, cuts int"
EXTRA = ("k", 1, 2, 3, 4, 5, 6, "t", 7, 8, 9)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "a", "en", 0), (None, "a b c", None, None, None), (2, "", "b", "de", 0), (3, " \t\n", None, "", 3), (4, "same text here", "c", "en", 4), (4, "same text here", "c", "en", 4), (4, "other words of the same id", "c", "en", 4), (5, "ß漢字🙂 Grüße  two", "d", "en", 5), (6, "x" * 60_000, "d", "de", 6), (7, "word " * 30_000, "", "de", 7)]
    return table_of(spark, rows)


def sizes(r):
    return len((r.text or "").split())


def test_mixing_odd_rows(spark, odd):
    found = mixing.mixed(odd, mixing.word_count(F.col("text"))).collect()
    assert len(found) == odd.count()
    total = sum(r.size for r in found)
    targets = {r.source: r.target for r in found}
    assert sum(targets.values()) <= 1.5 * total + 1e-6
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies and r.target <= 2 * r.source_size for r in found)
    assert all(r.taken == 0 for r in found if r.size == 0)
    alike = [r.taken for r in found if r.doc_id == 4 and r.size == 3]
    assert len(set(alike)) == 1


def test_mixing_empty_and_without_words(spark, odd):
    assert mixing.mixed(odd.where("false"), mixing.word_count(F.col("text"))).count() == 0
    blank = mixing.mixed(odd.where("doc_id in (1, 2)"), mixing.word_count(F.col("text"))).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


def test_mixing_targets_by_hand(spark):
    sources = spark.createDataFrame([("b", 100, 1), ("a", 10, 1), (None, 50, 1), ("c", 40, 1)], "source string, words long, n long")
    found = {r.source: r.target for r in mixing.targets(sources, Scratch(spark, "t")).collect()}
    # a: 3, b: 1, c: 2, null: 3; 300 words: a stops at 20, null at 100, c at 80, so b gets the other 100
    assert found == {"a": 20.0, "b": 100.0, "c": 80.0, None: 100.0}


def test_mixing_fills_what_a_long_document_leaves_open(spark):
    rows = [(i, "w " * (60 if i == 3 else 1 + i % 5), s, "en", 0) for s in ("a", "b", "c") for i in range(60)]
    found = mixing.mixed(table_of(spark, rows), mixing.word_count(F.col("text")), identity=("doc_id", "source", "text"), share=0.5).collect()
    for s in "abc":
        mine = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


def test_mixing_overshoots_where_that_is_nearer(spark):
    rows = [(1, "w " * 1000, "a", "en", 0), (2, "w " * 10, "a", "en", 0), (3, "w " * 380, "b", "en", 0)]
    found = mixing.mixed(table_of(spark, rows), mixing.word_count(F.col("text"))).collect()
    for s in "ab":
        mine = [r for r in found if r.source == s]
        reachable = {r.size for r in mine}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(reachable) / 2


def test_mixing_is_the_same_in_every_run_and_partitioning(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, second = (mixing.mixed(d, mixing.word_count(F.col("text"))).select("doc_id", "taken") for d in (docs, docs.repartition(7, "text")))
    assert sorted(first.collect()) == sorted(second.collect())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and each leaf's path."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i // arity * arity
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + arity])))
        level, at = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)], [i // arity for i in at]
    return level[0], paths


def plain_manifest(rows: list, arity: int) -> Counter:
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r)))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(by_lang[g])], arity) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], arity)
    out = Counter()
    for k, g in enumerate(order):
        for (_, _, h), path in zip(sorted(by_lang[g]), trees[g][1], strict=True):
            out[(h, trees[g][0], root, sha("".join(a + b for a, b in path + upper[k])))] += 1
    return out


@pytest.mark.parametrize("arity", [2, 3, 100])
def test_manifest_equals_a_plain_tree(spark, small, odd, arity):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    found = merkle_manifest.manifest(docs, arity=arity).withColumn("proof", merkle_manifest.siblings_digest(F.col("path"))).collect()
    assert Counter((r.leaf, r.subroot, r.root, r.proof) for r in found) == plain_manifest(docs.collect(), arity)
    assert all(r.verified and r.folded_root == r.root for r in found)


def test_manifest_odd_tables(spark, odd):
    assert merkle_manifest.manifest(odd.where("false")).count() == 0
    lone = merkle_manifest.manifest(odd.where("doc_id = 5")).first()
    assert lone.leaf == lone.subroot == lone.root and list(lone.path) == []
    assert merkle_manifest.manifest(odd).count() == odd.count()


def test_manifest_finds_every_change(spark, odd):
    offered = merkle_manifest.manifest(odd, {"text": F.concat("text", F.lit("!"))}, F.col("lang") == "en").collect()
    texts = Counter((r.doc_id, r.lang == "en" and r.text is not None) for r in odd.collect())
    assert Counter((r.doc_id, not r.verified) for r in offered) == texts


def plain_alignment(sides, text: str | None) -> tuple:
    whole = (" " + (text or "")).encode()
    a, b = sides.a.encode(" " + (text or ""), add_special_tokens=False).ids, sides.b.encode(text or "")
    if not text or b"".join(sides.bytes_b[i] for i in b) != whole:
        return (0, 0, 0, "", [])
    spans = []
    for ids, size in ((a, sides.bytes_a), (b, sides.bytes_b)):
        at, side = 0, []
        for i in ids:
            side.append((at, at + len(size[i]), i))
            at += len(size[i])
        spans.append(side)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    groups, lo = [], 0
    for hi in cuts:
        groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans))
        lo = hi
    return (len(a), len(b), len(cuts), sha(";".join(groups)), links)


@pytest.fixture(scope="module")
def sides():
    return token_alignment.Sides(*token_alignment.vocabulary_paths())


def expected(sides, texts: list) -> list[tuple]:
    plain = [plain_alignment(sides, t) for t in texts]
    held = Counter(p for x in plain for p in set(x[4]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(*x[:3], len(x[4]), sum(held[p] == most[p[0]] for p in x[4]), sum(held[p] for p in x[4]), x[3]) for x in plain]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_whole_texts(spark, small, sides):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    short = {d: t for d, t in docs.items() if len(t or "") < 3000}  # the plain version is quadratic; counts need all texts
    want = dict(zip(docs, expected(sides, list(docs.values())), strict=True)) if len(short) == len(docs) else None
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_token_alignment"](spark, small).collect()}
    assert set(found) == set(docs)
    if want is not None:
        assert found == want
    for d, t in short.items():
        n_a, n_b, n_groups, digest, links = plain_alignment(sides, t)
        assert found[d][:4] == (n_a, n_b, n_groups, len(links)) and found[d][6] == digest


TEXTS = [None, "", " ", "  two  spaces ", "a\n\nb \n c", "a \tb", "x" * 3000, "▁ kept", "漢字 仮名 混じり文。", "<|endoftext|> <s> <0x41>", "don't 'll stop", "é é 🙂🙂 ﬁ", "  b  c", "the same", "the same", "word " * 2000, "\x1c a\x85 b"]


@pytest.mark.parametrize("most_sent", [token_alignment.MOST_SENT, 0])
def test_alignment_odd_texts(spark, sides, most_sent):
    docs = table_of(spark, [(None if k == 3 else 7 if k > 12 else k, t, "s", "en", 0) for k, t in enumerate(TEXTS)])
    found = token_alignment.aligned_documents(docs, token_alignment.vocabulary_paths(), most_sent=most_sent).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == Counter(expected(sides, TEXTS))


def test_alignment_empty_table(spark, odd):
    paths = token_alignment.vocabulary_paths()
    assert token_alignment.aligned_documents(odd.where("false"), paths).count() == 0
    assert token_alignment.token_links(odd.where("false"), paths).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t  aab'sé漢🙂▁1<> 　")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_parts_of_a_text_encode_as_the_text(sides, text):
    known = token_alignment.Parts(sides)
    counts, digests, *_ = token_alignment._documents(known, [text])
    n_a, n_b, n_groups, digest, links = plain_alignment(sides, text)
    assert (tuple(counts[0].tolist()), digests[0]) == ((n_a, n_b, n_groups, len(links)), digest)


def test_relational_links_equal_the_arrays(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    paths = token_alignment.vocabulary_paths()
    links = token_alignment.token_links(docs, paths)
    by_row = links.groupBy("doc_id").agg(F.count("*").alias("n_links"), F.countDistinct("grp").alias("n_groups"), F.countDistinct("a_pos").alias("n_a"), F.countDistinct("b_pos").alias("n_b"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    arrays = token_alignment.alignments(docs, paths)
    assert sorted(map(tuple, by_row.select(names).collect())) == sorted(map(tuple, arrays.where("n_links > 0").select(names).collect()))
    pairs = token_alignment.corpus_pairs(arrays).select((F.shiftright("pair", 32)).alias("a"), (F.col("pair") % token_alignment.PAIR).alias("b"), "n")
    assert sorted(map(tuple, links.groupBy("a", "b").agg(F.countDistinct("row")).collect())) == sorted(map(tuple, pairs.collect()))
