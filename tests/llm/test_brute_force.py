"""The registered queries and the pipeline's stages against plain Python over the whole small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from entrack.llm import decontamination, line_dedup, packing, pii_surrogates, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GUARANTEED = line_dedup.LINE_WINDOW * (line_dedup.SPAN + line_dedup.WINDOW - 1) + 2 * (line_dedup.LINE_WINDOW - 1)


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def judge_cuts(texts: dict[int, str], removed: dict[int, list[tuple[int, int]]]) -> tuple[int, int, int]:
    """(removed words that no earlier text holds, repeated words that should go, how many of those went).

    Words are looked at in runs of 8; repeated words are those of windows of GUARANTEED words that an earlier
    document holds.
    """
    seen: set[tuple[str, ...]] = set()
    windows: set[int] = set()
    unfounded = due = done = 0
    for doc in sorted(texts):
        found = [(m.start(), m.end(), m.group()) for m in WORD.finditer(texts[doc] or "")]
        words = [w for _, _, w in found]
        gone = np.zeros(len(words), dtype=bool)
        for a, b in removed[doc]:
            inside = [i for i, (x, y, _) in enumerate(found) if a <= x and y <= b]
            gone[inside] = True
            founded = np.zeros(len(words), dtype=bool)  # two passages may meet, so single words are judged
            for i in inside[:-7]:
                here = tuple(words[i : i + 8])
                if here in seen or any(tuple(words[j : j + 8]) == here for j in range(i)):
                    founded[i : i + 8] = True
            unfounded += int((~founded[inside]).sum())
        repeated = np.zeros(len(words), dtype=bool)
        hashes = [hash(tuple(words[i : i + GUARANTEED])) for i in range(len(words) - GUARANTEED + 1)]
        for i, h in enumerate(hashes):
            if h in windows:
                repeated[i : i + GUARANTEED] = True
        windows.update(hashes)
        due += int(repeated.sum())
        done += int((repeated & gone).sum())
        seen.update(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return unfounded, due, done


def test_line_dedup_cuts_repeated_words_and_no_others(spark, small, documents):
    rows = queries.QUERIES["op1_line_dedup"](spark, small).collect()
    removed = {r.doc_id: [tuple(map(int, s.split(":"))) for s in r.removed] for r in rows}
    assert len(rows) == len(documents)
    unfounded, due, done = judge_cuts(documents, removed)
    assert unfounded == 0 and due > 500 and done >= 0.98 * due, (unfounded, due, done)
    for r in rows:
        text = documents[r.doc_id]
        kept = text if not removed[r.doc_id] else "".join(text[a:b] for a, b in zip([0, *[s[1] for s in removed[r.doc_id]]], [*[s[0] for s in removed[r.doc_id]], len(text)], strict=True))
        assert r.chars_left == len(kept)


def test_noisy_or_and_sentences_from_given_weights():
    model = toxicity.Model({"bad": 3.0, "awful": 2.5, "fine": -1.0, "aw*": 0.0, "hate*": 4.0}, -2.0)
    text = "All is fine here. What a bad awful day! I hated it.\nNothing else"
    total = 1.0
    marked = []
    for m in re.finditer(r"[^.!?\n]+(?:[.!?](?=\s)|\n|$)", text):
        words = set(re.findall(r"[^\W\d_]+", m.group().lower()))
        z = -2.0 + 3.0 * ("bad" in words) + 2.5 * ("awful" in words) - ("fine" in words) + 4.0 * any(w.startswith("hate") and len(w) > 4 for w in words)
        p = 1 / (1 + np.exp(-z))
        total *= 1 - p
        if p >= toxicity.OFFENDING:
            marked.append(m.group().strip())
    score, sentences, found = model.score(text)
    assert score == pytest.approx(1 - total) and sentences == 4
    assert [text[a:b].strip() for a, b, _ in found] == marked and len(marked) == 2


def test_surrogates_form_one_to_one_maps(spark, small, documents):
    rows = pii_surrogates.pseudonymised(spark.read.parquet(f"{small}/documents.parquet")).collect()
    chosen: dict[tuple[str, str], set[str]] = defaultdict(set)
    for r in rows:
        text, at, rest = documents[r.doc_id], 0, r.text
        found = pii_surrogates.mentions(text)
        assert [(s["start"], s["end"]) for s in r.spans] == [m[:2] for m in found]
        for s, (a, b, kind, entity) in zip(r.spans, found, strict=True):
            assert rest.startswith(text[at:a] + s["surrogate"])
            rest, at = rest[a - at + len(s["surrogate"]) :], b
            assert kind in ("given", "surname", "ip", "email") or re.sub(r"[0-9A-Za-z]", "x", s["surrogate"]) == re.sub(r"[0-9A-Za-z]", "x", text[a:b])
            form = re.sub(r"\W", "", s["surrogate"]).casefold() if kind in ("phone", "card", "ssn", "iban") else s["surrogate"].casefold()
            chosen[kind, entity].add(form[-10:] if kind == "phone" else form)
        assert rest == text[at:]
    assert len(chosen) > 10 and all(len(v) == 1 for v in chosen.values())
    by_kind = Counter((k, next(iter(v))) for (k, _), v in chosen.items())
    assert max(by_kind.values()) == 1
    real = {(k, e) for k, e in chosen}
    assert not [1 for (k, e), v in chosen.items() if (k, next(iter(v))) in real]


def test_packing_is_optimal_and_full(spark, small, documents):
    rows = queries.QUERIES["op4_packing"](spark, small).collect()
    lengths = {d: len(WORD.findall(t or "")) for d, t in documents.items()}
    assert {r.doc_id: r.length for r in rows} == lengths
    sizes = sorted(Counter(lengths.values()).items())
    best = {0: 0}
    for _ in range(packing.BUCKETS):
        best = {j: min([best[i] + sum(n * (sizes[j - 1][0] - length) for length, n in sizes[i:j]) for i in best if i < j] + ([best[j]] if j in best else [])) for j in range(len(sizes) + 1) if j or 0 in best and not best.get(j, 1) or any(i < j for i in best)}
        best[0] = 0
    assert sum(r.bucket_len - r.length for r in rows) == best[len(sizes)]
    batches: dict[tuple[int, int], list] = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch_id].append(r)
    for own in batches.values():
        assert len(own) == 1 or len(own) * own[0].bucket_len <= packing.BUDGET
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for bucket in {b for b, _ in batches}:
        counts = [len(v) for (b, _), v in sorted(batches.items()) if b == bucket]
        assert len(set(counts[:-1])) <= 1 and counts[-1] <= counts[0]


_UNIT = "|".join(sorted(decontamination.UNITS, key=lambda u: (-len(u), u)))
_SIGNS = "\x01\x02\x03"


def template(text: str) -> list[str]:
    """The template tokens by Python's own expressions (ASCII names are enough for these tables' items)."""
    import regex

    gap = r"[\x20\x09-\x0D]"
    named = regex.sub(rf"(^|[\p{{Ll}},;:.!?]{gap}+)\p{{Lu}}\p{{Ll}}+(?:{gap}\p{{Lu}}\p{{Ll}}+)*", "\\1\x03", text or "")
    measured = regex.sub(rf"(?i)[0-9]+(?:[.,:][0-9]+)*{gap}?(?:{_UNIT}|%|€|\$)($|[^\p{{L}}\p{{N}}])", " \x01 \x02 \\1", named)
    numbered = regex.sub(r"[0-9]+(?:[.,:][0-9]+)*", " \x01 ", measured)
    return regex.findall(rf"[\p{{L}}\p{{N}}{_SIGNS}]+", numbered.lower())


def test_leaks_equal_a_plain_search(spark, small, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    wanted = set()
    templates = {d: template(t) for d, t in documents.items()}
    places: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for d, w in templates.items():
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].add(d)
    for item, text in items.items():
        w = template(text)
        covered: dict[int, set[int]] = defaultdict(set)
        for i in range(len(w) - 7):
            window = tuple(w[i : i + 8])
            if sum(x not in "\x01\x02\x03" for x in window) >= decontamination.PLAIN:
                for d in places[window]:
                    covered[d] |= set(range(i, i + 8))
        wanted |= {(d, item) for d, at in covered.items() if len(at) >= decontamination.SHARE * len(w)}
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, small).collect()}
    # what the plain search finds more of are matches whose slots do not agree
    assert found <= wanted and len(found) >= 0.9 * len(wanted) > 0


def test_stages_drop_what_they_should(spark, small, documents):
    """Every stage on its own input: the rows that go are those that a plain look at its decision says."""
    import corpus_pipeline
    from entrack.llm import minhash_forest

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    from pyspark.sql import functions as F

    model = toxicity.train(docs, labels, F.lit(True))
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, small).collect()}
    assert kept == {d for d, t in documents.items() if model.score(t)[0] < toxicity.THRESHOLD}
    cut = {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, small).collect()}
    whole = {r.doc_id: (r.text, bool(r.removed_spans)) for r in line_dedup.deduplicated_lines(docs).collect()}
    assert cut == {d: t for d, (t, changed) in whole.items() if not changed or WORD.search(t)}
    sets = {}
    for d, t in documents.items():
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in documents}
    for _ in range(4):
        for a in documents:
            for b in documents:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert {r.doc_id for r in stages["near_duplicates"](spark, docs, small).collect()} == {d for d in documents if least[d] == d}
    assert minhash_forest.near_duplicates(docs).count() == len(documents)
    leaks = {r.doc_id for r in queries.QUERIES["op6_decontamination"](spark, small).collect()}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, small).collect()} == set(documents) - leaks
    assert {r.doc_id for r in stages["packing"](spark, docs, small).collect()} == set(documents)
