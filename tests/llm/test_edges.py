"""Planted cases, nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import numpy as np
import pytest

from entrack.llm import decontamination, line_dedup, minhash_forest, packing, pii_surrogates, secrets_scan, token_counts, topk_search, toxicity
from entrack.llm.lattice_lm import lattice_scores
from entrack.llm.lattice_lm import vocabulary_path as piece_path
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, key string, h int"
PASSAGE = " ".join(f"Section {chr(97 + k)}{chr(98 + k)} describes how the old mill worked before the flood and who rebuilt it." for k in range(8))


def prose(seed: int, n: int = 120) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 99991}{'.' if i % 9 == 8 else 'd' if i % 4 == 1 else 'x'}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "a", 1), (None, "a b c", None, None), (2, "", "b", 2), (3, " \t\n", None, 3), (4, "same text here", "c", 4), (4, "same text here", "c", 4), (5, "ß漢字🙂 Grüße", "d", 5), (6, "x" * 60_000, "e", 6), (7, "word " * 30_000, "f", 7)]
    return spark.createDataFrame(rows, SCHEMA)


def operators(docs, items, labels):
    held = F.lit(True)
    return {
        "line": lambda: line_dedup.deduplicated_lines(docs),
        "toxicity": lambda: toxicity.scored(docs, toxicity.train(docs, labels, held)),
        "surrogates": lambda: pii_surrogates.pseudonymised(docs),
        "packing": lambda: packing.pack(docs, packing.word_count(F.col("text"))),
        "lattice": lambda: lattice_scores(docs, None, piece_path()),
        "secrets": lambda: secrets_scan.secret_spans(docs),
        "forest": lambda: minhash_forest.near_duplicates(docs),
        "tokens": lambda: token_counts.prefix_token_counts(docs, token_counts.vocabulary_path(), 100),
    }


NAMES = ["line", "toxicity", "surrogates", "packing", "lattice", "secrets", "forest", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_keep_their_number(spark, odd, name):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert operators(odd, None, labels)[name]().count() == odd.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(spark, odd, name):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert operators(odd.where("false"), None, labels)[name]().count() == 0


def test_a_shared_passage_is_cut_from_the_later_document(spark):
    docs = spark.createDataFrame([(1, f"{prose(1)}\n{PASSAGE}\n{prose(2)}"), (2, f"{prose(3)}\n{PASSAGE}\n{prose(4)}"), (3, prose(5))], "doc_id long, text string")
    found = {r.doc_id: r for r in line_dedup.deduplicated_lines(docs).collect()}
    assert "old mill" in found[1].text and found[1].removed_spans == []
    assert found[2].text.count("old mill") == 0 and prose(3) in found[2].text and prose(4) in found[2].text
    assert found[3].text == prose(5)


def lines_of(text: str) -> line_dedup.Lines:
    data = np.frombuffer(text.encode(), np.uint8)
    return line_dedup.Lines(data, np.array([0, len(data)], np.int64))


def test_lines_hold_all_words_and_end_with_sentences():
    text = f"  {PASSAGE}\n\n{prose(6)} 漢字。文 \n"
    lines = lines_of(text)
    words = [text.encode()[a:b].decode() for a, b in zip(lines.words.starts, lines.words.ends, strict=True)]
    assert "".join(words) == "".join(text.split())
    starts = set(lines.starts.tolist())
    assert all(i + 1 in starts for i, w in enumerate(words[:-1]) if w[-1] in ".!?。")
    assert max(np.diff([*lines.starts, len(words)])) <= line_dedup.LINE_WINDOW + 1


def test_a_reparameterised_question_is_found(spark):
    item = "If the farmer sells 12 apples and 7 pears for 30 euros on every market day, how much money does the farmer earn in 4 weeks of the season?"
    other = item.replace("12", "19").replace("30", "55").replace("4 weeks", "6 weeks")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{prose(1)} {item} {prose(2)}"), (2, f"{prose(3)} {other} {prose(4)}"), (3, prose(5)), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontamination.leaked(docs, items).collect()}
    assert set(found) == {1, 2} and not found[1].reparameterised and found[2].reparameterised
    assert {r.doc_id for r in decontamination.decontaminated(docs, items).collect()} == {3, 4}
    assert decontamination.leaked(docs, items.where("false")).count() == 0


def test_surrogates_are_consistent_distinct_and_not_real(spark):
    texts = ["Call Mr John Miller at +1 415 555 0132 or mail j.miller@example.com.", "Mary Jones wrote to j.miller@example.com; call 415-555-0132.", "IP 10.1.2.3 and Mr John Miller"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in pii_surrogates.pseudonymised(docs, b"k").orderBy("doc_id").collect()]
    assert "Mr " in new[0] and not any(x in t for t in new for x in ("Miller", "415 555 0132", "415-555-0132", "j.miller@example.com", "10.1.2.3"))
    mails = {m for t in new[:2] for m in t.replace(";", " ").split() if "@" in m}
    assert len({m.strip(".") for m in mails}) == 1
    assert new == [r.text for r in pii_surrogates.pseudonymised(docs, b"k").orderBy("doc_id").collect()]
    assert new != [r.text for r in pii_surrogates.pseudonymised(docs, b"other").orderBy("doc_id").collect()]


def test_bounds_are_optimal_against_brute_force():
    from itertools import combinations

    bins = [(1, 5), (3, 2), (4, 7), (9, 1), (12, 3), (20, 2), (5000, 1)]

    def padding(tops):
        return sum(n * (next(t for t in tops if t >= length) - length) for length, n in bins)

    for buckets in range(1, 8):
        least = min(padding((*some, 5000)) for k in range(buckets) for some in combinations([b[0] for b in bins[:-1]], k))
        assert padding(packing.optimal_bounds(np.array(bins), buckets)) == least


def test_batches_hold_their_budget(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 300).alias("n"))
    packed = packing.pack(docs, F.col("n"), budget=1000).toPandas()
    sizes = packed.groupby(["bucket", "batch_id"]).agg(rows=("slot", "count"), width=("bucket_len", "max"), last=("slot", "max"))
    assert ((sizes["rows"] * sizes["width"] <= 1000) | (sizes["rows"] == 1)).all() and (sizes["last"] == sizes["rows"] - 1).all()


def test_prefix_counts_equal_the_library_at_every_prefix():
    import random

    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path()
    library, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    draw = random.Random(3)
    signs = list("abc 'stremvld.,!?123éßÀİΣσςЖжи한국어각가🙂\u0301\u0327\u0323\u1161\u11a8\u1100\xa0\u2003İﬁµΩ漢字\u064e\n\t")
    texts = ["Tokenization isn't hard, 12345 times!", "Straße—漢字 naïve", "a<|endoftext|>b <|startoftext|> <|end", "they'll we're I've it's 'll", "e\u0301" * 40, ""]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(1, 40))) for _ in range(150)]
    texts += ["".join(draw.choice("eaoxЖ\u0301\u0323") for _ in range(draw.randint(70, 140))) for _ in range(20)]
    for text in texts:
        counter.learn([text])
        steps = np.cumsum(np.frombuffer(counter.increments([text])[0], "<i2"))
        assert steps.tolist() == [len(library.encode(text[:n], add_special_tokens=False)) for n in range(1, len(text) + 1)], repr(text)
        for budget in (1, 5):
            assert token_counts.fitting_chars(counter.increments([text])[0], budget) == max([i + 1 for i, c in enumerate(steps.tolist()) if c <= budget], default=0)


@pytest.mark.parametrize("unit", ["Ж", "🙂", "e\u0301", "ab漢Ω"])
def test_long_runs_without_white_space_cost_their_length(unit):
    import time

    counter = token_counts.PrefixCounter(token_counts.vocabulary_path())
    counter.increments([unit * 10])
    took = []
    for n in (6_000, 60_000):
        began = time.process_time()
        counter.increments([unit * (n // len(unit))])
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_near_copies_are_linked_and_others_not(spark):
    base = prose(1, 300).split()
    near = [*base[:150], "changed", *base[151:]]
    docs = spark.createDataFrame([(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base).upper()), (7, prose(99, 300)), (8, None)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs).collect()}
    assert found == {5: 3, 3: 3, 9: 3, 7: 7, 8: 8}


def test_vectors_that_cannot_take_part(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.5, None]), (1, [1.0, float("nan")]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (2, [0.5, 0.5])]
    found = topk_search.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 2, 32768), (0, 2, 3, 32768)]


TONGUES = {
    "en": "about above across after again along among around before behind below between beyond during ever every first follow ground house island journey kitchen large market never often paper quiet river simple table under valley water yellow".split(),
    "fr": "avant après beaucoup chemin depuis encore fenêtre garçon heure image jamais livre maison nuage ombre parler quelque rouge souvent toujours usine vieux village chaque premier lumière montagne nouveau petit porte sœur temps arbre".split(),
    "de": "aber brücke dorf einmal feuer garten haus immer jahr kirche leben morgen nacht ofen platz quelle regen straße tür über vogel wald zeit zwischen anfang bruder schnell größe himmel mühle fenster abend straßen".split(),
    "es": "ahora bosque camino después entonces fuego grande hermano isla jardín luego mañana noche otoño pueblo quizás río siempre tarde último viento zapato árbol cuando donde mientras nunca piedra puerta sombra tierra verano cielo".split(),
    "ru": "вода город дорога зима книга лето мост небо окно поле река сад трава утро хлеб цветок школа яблоко берег ветер гора день звезда камень лес море ночь осень письмо работа снег туча улица".split(),
}


@pytest.mark.parametrize("tongue", TONGUES)
def test_every_repeated_passage_of_over_fifty_words_is_cut(spark, tongue):
    import random

    draw, words = random.Random(tongue), TONGUES[tongue]
    rows, passages = [], {}
    for k in range(60):
        # one sentence, once alone in its paragraph and once amid a line
        passages[k] = " ".join(draw.choice(words) for _ in range(51 + k % 10))
        sides = [" ".join(draw.choice(words) for _ in range(80)) for _ in range(4)]
        rows += [(k, f"{sides[0]}.\n{passages[k]}\n{sides[1]}."), (100 + k, f"{sides[2]} {passages[k]} {sides[3]}")]
    found = {r.doc_id: r.text for r in line_dedup.deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert [k for k in passages if found[k] != texts[k]] == []
    assert [k for k, p in passages.items() if len(found[100 + k]) > len(texts[100 + k]) - len(p)] == []


def test_borders_leave_no_window_empty():
    for text in (prose(7, 900), "one two three four five " * 90, PASSAGE):
        lines = lines_of(text)
        borders = lines.chunks()[0].tolist()
        assert borders[0] < line_dedup.WINDOW and max([b - a for a, b in zip(borders, borders[1:], strict=False)], default=0) <= line_dedup.WINDOW
        assert len(lines.starts) - borders[-1] < line_dedup.SPAN + line_dedup.WINDOW
    repeated = lines_of("word. " * 500)
    assert len(repeated.chunks()[0]) <= len(repeated.starts) / 4


def test_recall_of_links_by_similarity(spark):
    """Random pairs of texts with a known similarity: the share that is linked, by band from the bound up."""
    import random

    draw = random.Random(8)
    rows, wanted = [], {}
    for k in range(150):
        words = [f"w{draw.randrange(10**6)}" for _ in range(400)]
        changes = k % 12 + 1
        other = list(words)
        for at in range(changes):
            other[at * (400 // changes) + 3] = f"x{draw.randrange(10**6)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (words, other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        wanted[k] = len(a & b) / len(a | b)
    found = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), share=85).collect()}
    for low, high in ((0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [k for k, j in wanted.items() if low <= j < high]
        linked = [k for k in band if found[2 * k + 1] == 2 * k]
        assert len(band) > 10 and len(linked) >= 0.9 * len(band), (low, len(linked), len(band))
    assert not [k for k, j in wanted.items() if j < 0.85 and found[2 * k + 1] == 2 * k]


def test_a_random_secret_of_every_encoding_is_found(spark):
    import random

    draw, rows, wanted = random.Random(7), [], {}
    for name, _, alphabet in secrets_scan.ENCODINGS:
        for n in {"decimal": (22,), "hex": (22,), "lower": (64,), "upper": (64,)}.get(name, (32, 64)):  # longer digits and hex are base spans
            secret = "".join(draw.choice(alphabet) for _ in range(n))
            wanted[len(rows)] = (name, n)
            rows.append((len(rows), f"The value is {secret} here"))
    first = len(rows)
    words = [w for tongue in TONGUES.values() for w in tongue if w.isascii()]
    for k in range(300):
        joined = draw.choice(["-", "_", "/", ""]).join(draw.choice(words) for _ in range(6))
        rows.append((len(rows), f"see {joined.upper() if k % 3 == 0 else joined} there"))
    found = {r.doc_id: r.random for r in secrets_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [wanted[k] for k in wanted if len(found[k]) != 1] == []
    assert sum(bool(found[k]) for k in found if k >= first) <= 3


def test_later_and_coinciding_forms_of_an_item_are_found(spark):
    form = "If the farmer picks {} apples on each market day and works for {} days near the old river, how many apples does the farmer pick?"
    items = spark.createDataFrame([(1, form.format(2, 7)), (2, form.replace("farmer", "baker").format(2, 2))], "item_id long, text string")
    wrong, copy, changed = form.format(4, 4), form.format(2, 7), form.format(3, 5)
    rows = [(1, f"{wrong} {prose(1)} {copy}"), (2, f"{wrong} {prose(2)} {changed}"), (3, f"{prose(3)} {changed.replace('farmer', 'baker')}"), (4, wrong)]
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaked(spark.createDataFrame(rows, "doc_id long, text string"), items, share=0.9).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 2)}
    assert [found[k].reparameterised for k in sorted(found)] == [False, True, True]
    assert [found[k].coincidences for k in sorted(found)] == [0, 0, 1]


@pytest.mark.parametrize("number", ["+49 30 1234567", "+33 1 23 45 67 89", "+34 612 345 678", "06 12 34 56 78", "06.12.34.56.78", "030/1234567", "(030) 1234567", "0176 12345678", "+49 (0)30 1234567"])
def test_telephone_numbers_of_other_countries_are_replaced(number):
    text = f"Tel. {number}, bitte."
    assert [(text[a:b], kind) for a, b, kind, _ in pii_surrogates.mentions(text)] == [(number, "phone")]


@pytest.mark.parametrize("other", ["01.02.2024 10:30", "2024-01-02 03:04:05", "0.123456789", "01 02 03 04 05 06 07 08", "10.0.0.256"])
def test_dates_and_figures_are_no_telephone_numbers(other):
    assert not [m for m in pii_surrogates.mentions(f"am {other} hier") if m[2] == "phone"]


def test_people_keep_one_surrogate_in_every_form(spark):
    texts = ["Mr John Miller came; Miller said that JOHN MILLER left.", "MR JOHN SMITH and Smith", "Alice Brown met Brown", "Dr Alex Kim and Mr Alex Kim", "Miller is a trade here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii_surrogates.pseudonymised(docs, b"k").collect()}
    forms: dict[tuple[str, str], set[str]] = {}
    for k, r in rows.items():
        for s in r.spans:
            forms.setdefault((s["kind"], texts[k][s["start"] : s["end"]].casefold()), set()).add(s["surrogate"].casefold())
    assert all(len(v) == 1 for v in forms.values()) and len({next(iter(v)) for v in forms.values()}) == len(forms)
    assert set(forms) == {("given", "john"), ("surname", "miller"), ("surname", "smith"), ("given", "alice"), ("surname", "brown"), ("given", "alex"), ("surname", "kim")}
    assert [len(rows[k].spans) for k in range(5)] == [5, 3, 3, 4, 0]
    assert rows[0].spans[3]["surrogate"].isupper() and rows[4].text == texts[4]


def test_short_items_and_names_that_begin_sentences(spark):
    items = spark.createDataFrame([(1, "the"), (2, "Alice has 12 apples and gives 3 of them to every child in the yard."), (None, None)], "item_id long, text string")
    rows = [(1, "the old mill"), (2, "the"), (3, "Ronald has 12 apples and gives 3 of them to every child in the yard."), (None, None)]
    found = decontamination.leaked(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.reparameterised) for r in found] == [(3, 2, True)]


def test_long_runs_of_names_and_numbers_do_not_overflow_the_stack(spark):
    item = "if the farmer picks 12 apples on each market day near the old river, how many apples does he pick?"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    runs = ["Von " * 20_000, "1," * 20_000 + "1 kgx ", "Von " * 20_000 + "1:2." * 20_000 + "3 kg "]
    rows = [(k, f"x {run}. {item}") for k, run in enumerate(runs)] + [(3, f"x {runs[2]}")]
    found = decontamination.leaked(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_tokens, r.reparameterised) for r in found) == [(k, 1, found[0].item_tokens, False) for k in range(3)]


def test_numbers_and_units_at_the_ends_of_runs(spark):
    docs = spark.createDataFrame([("a 12.5kgx 1,2,3 kg b 3:4 in.5 kg.7 c 1..2 d 12 12.5% e",)], "text string")
    row = docs.select(decontamination.template(F.col("text")).alias("w"), decontamination.slot_values(F.col("text")).alias("v")).first()
    assert " ".join(row.w) == "a \x01 kgx \x01 \x02 b \x01 \x02 \x01 \x02 \x01 c \x01 \x01 d \x01 \x01 \x02 e"
    assert row.v.numbers == ["12.5", "1,2,3", "3:4", "5", "7", "1", "2", "12", "12.5"] and row.v.units == ["kg", "in", "kg", "%"]


def test_clashing_names_and_nulls_in_every_column(spark):
    """Extra columns with the names that operators use inside, and rows that are null throughout."""
    import corpus_pipeline

    names = "lang string, source string, n_chars long, cut_key long, cut_spans string, cut_done string, leak_id long, leak_key long, gone_id long, gone_key long, key string, h int, removed_spans string, _cut_key int"
    extra = (None, "s", 3, 1, "a", "b", 1, 2, 3, 4, "k", 5, "r", 6)
    rows = [(1, f"{prose(1)} {PASSAGE}", *extra), (2, f"{prose(2)} {PASSAGE}", *extra), (3, None, *extra), (None, None, *[None] * len(extra)), (4, "", *extra)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    cut = line_dedup.deduplicated_lines(docs.drop("removed_spans"))
    assert cut.columns == [*docs.drop("removed_spans").columns, "removed_spans"] and cut.count() == 5
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontamination.decontaminated(docs, items).collect()) == [0, 3, 4]
    assert corpus_pipeline.remove_near_duplicates(spark, docs, "").columns == docs.columns
    assert toxicity.without_toxic(docs, toxicity.Model({}, -50.0)).columns == docs.columns
    for empty in (docs.where("false"),):
        assert line_dedup.deduplicated_lines(empty.drop("removed_spans")).count() == 0
        assert decontamination.decontaminated(empty, items).count() == 0 and corpus_pipeline.remove_near_duplicates(spark, empty, "").count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, query_id long, score int")
    assert topk_search.exact_topk(vectors, F.col("id") % 50 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 9, 9), (0, [1.0], 8, 8), (1, [0.5], 7, 7)], vectors.schema)
    assert topk_search.exact_topk(twice, F.col("id") % 50 == 0).count() > 0
