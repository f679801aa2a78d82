"""Surrogates for personal data.

Entities are e-mail addresses, telephone numbers, IP addresses, payment cards, IBANs, social security numbers
and the names of people: after a title, or a known given name before another name, in usual writing or in
capitals; and, in a document that names a person so, every other mention of the given name or the surname alone.
Each is replaced by a surrogate drawn from HMAC-SHA256 under the caller's key: the same entity gets the same
surrogate everywhere and in whatever format it is written (phone digits, card digits and the two parts of a name
are entities of their own), and the surrogate keeps the type, the script, the gender, letter case, digits,
punctuation and valid check digits. A given name has one gender in the whole corpus: that of the list of names, else
that of the titles before it where they agree.

Distinct entities must keep distinct surrogates, and no surrogate may be a real entity of the corpus. Both
are checked over the table of all distinct entities; the losers draw again, round by round, until none is
left. Only redrawn entities, and names whose gender the corpus tells, are looked up when texts are rewritten.

Defined cases: null and empty texts are returned as they are; nulls elsewhere and extra columns change nothing;
repeated rows get the same result; overlapping matches go to the leftmost, then to the kind listed first; an
empty table gives an empty result; a kind with more entities than surrogates raises after ROUNDS rounds.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, table

KEY = b"surrogates"
ROUNDS = 20
#: Per-document lists of redrawn entities are broadcast up to so many rows; beyond, the join is a shuffle.
BROADCAST_ROWS = 300_000

#: Fixed: titles and given names by gender; any others are left alone.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña госпожа".split(),
    "n": "Dr Prof Doctor Doktor Professor".split(),
}
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kenneth Edward Brian Kevin "
        "Hans Peter Klaus Jürgen Wolfgang Dieter Stefan Andreas Pierre Jean Michel Jacques Luc François Luis Carlos José Javier Miguel Antonio Pablo Иван Сергей Дмитрий Алексей"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Alice Emma Olivia Sophia Margaret Nancy Betty Helen Ruth Laura Julia Anna Ursula Monika Petra "
        "Sabine Claudia Heike Marie Nathalie Isabelle Sophie Camille Claire Carmen Ana Lucía Pilar Marta Elena Мария Анна Ольга Елена Наталья"
    ).split(),
}
_GENDER = {w: g for g, names in GIVEN.items() for w in names}
_TITLE = {w: g for g, names in TITLES.items() for w in names}
_FOLDED = {w.casefold(): g for w, g in _GENDER.items()}
_GENDER |= {w.upper(): g for w, g in _GENDER.items()}
_TITLE |= {w.upper(): g for w, g in _TITLE.items()}
_NAME = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-ЯЁ][а-яё]+|[A-ZÀ-ÖØ-Þ]{2,}(?![a-zß-öø-ÿ])|[А-ЯЁ]{2,}(?![а-яё]))"
#: How titles and given names begin; other places are not tried.
_INITIAL = "(?=[" + "".join(sorted({w[0] for w in (*_TITLE, *_GENDER)})) + "])"
#: Telephone numbers in groups of any length: 8 to 15 digits after a plus, or 9 to 12 with a national 0, no dates.
_ABROAD = r"(?<![\w+])\+\d(?:(?:[ ./-]|[ ]?\(|\)[ ]?)?\d){7,14}(?!\w)"
_NATIONAL = r"(?<![\w+.,/:-])(?<!\d )(?!\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d))(?:" + "|".join(
    rf"(?:\(0[1-9]\d{{{k}}}\)[ ]?|0[1-9]\d{{{k}}}[ ./-])\d(?:[ .-]?\d){{{6 - k},{9 - k}}}(?!\w|[ .-]\d)" for k in range(4)
) + ")"
_PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4})(?!\w|\.\d)"),
    ("phone", r"(?<![\w+])(?<!\d[ .-])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{4}(?!\w|[ -]\d)|(?<!\w)\+\d{8,15}(?!\w)" + f"|{_ABROAD}|{_NATIONAL}"),
    ("titled", rf"(?<!\w){_INITIAL}(?P<title>{'|'.join(_TITLE)})\.?[ ](?P<first>{_NAME})(?:[ ](?P<last>{_NAME}))?"),
    ("named", rf"(?<!\w){_INITIAL}(?P<given>{'|'.join(_GENDER)})[ ](?P<family>{_NAME})"),
)
_FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS))
_SIGN = re.compile(r"[@0-9]")
_WORD = re.compile(r"\w+")
_CALLED = {*_TITLE, *_GENDER}
_BARE = re.compile(rf"(?<!\w){_NAME}(?!\w)")
KINDS = ("email", "iban", "ip", "ssn", "phone", "card", "given", "surname")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of every entity; an entity is its canonical form."""
    return [m[:4] for m in gendered_mentions(text)]


def gendered_mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """The same with the gender that a name's title tells: m, f or n."""
    out = _plain_mentions(text)
    people: dict[str, str] = {}
    for _, _, kind, entity, _ in out:
        if kind == "given" or (kind == "surname" and entity not in people):
            people[entity] = kind
    if not people:
        return out
    ends = iter([*out, (len(text) + 1, 0, "", "", "")])
    span, more = next(ends), []
    for m in _BARE.finditer(text):
        while span[1] <= m.start() and span[1]:
            span = next(ends)
        entity = m.group().casefold()
        if entity in people and m.end() <= span[0] and len(entity) > 2:
            more.append((m.start(), m.end(), people[entity], entity, "n"))
    return sorted([*out, *more]) if more else out


def _plain_mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    out = []
    if not _SIGN.search(text) and _CALLED.isdisjoint(_WORD.findall(text)):
        return out
    for m in _FIND.finditer(text):
        kind = next(k for k, _ in _PATTERNS if m.group(k) is not None)
        found = m.group()
        if kind in ("titled", "named"):
            gender = "n"
            if kind == "named":
                parts = [("given", "given"), ("surname", "family")]
            elif m["last"]:
                gender, parts = _TITLE[m["title"]], [("given", "first"), ("surname", "last")]
            else:
                parts = [("surname", "first")]
            out += [(m.start(group), m.end(group), role, m[group].casefold(), gender if role == "given" else "n") for role, group in parts]
            continue
        if kind == "email":
            entity = found.lower()
            trail = len(found) - len(found.rstrip("-"))
            if trail:
                continue
        elif kind in ("iban",):
            entity = found.replace(" ", "")
            if entity[2:4] != _iban_check(entity[:2], entity[4:]):
                continue
        elif kind == "ip":
            entity = ".".join(str(int(p)) for p in found.split("."))
        else:
            entity = re.sub(r"\D", "", found)
            if kind == "phone" and len(entity) == 11 and entity[0] == "1":
                entity = entity[1:]  # the same number with its country code
        out.append((m.start(), m.end(), kind, entity, "n"))
    return out


class Draw:
    """An endless stream of choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\x00{entity}\x00{attempt}".encode(), 0, 0
        self.pool = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            digest = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.block = int.from_bytes(digest, "big"), 256, self.block + 1
        self.pool, r = divmod(self.pool, n)
        self.left -= max(1, n.bit_length())
        return r

    def digits(self, like: str) -> str:
        return "".join(str(self.below(10)) for _ in like)

    def letters(self, like: str) -> str:
        """Letters for letters and digits for digits; everything else stays."""
        out = []
        for c in like:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                drawn = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(drawn.upper() if c.isupper() else drawn)
            else:
                out.append(c)
        return "".join(out)


_SYLLABLES = {
    "latin": ("ba be bo da de do fa fi ga go ha he ka ke la le li lo ma me mi mo na ne no pa po ra re ri ro sa se so ta te ti to va vi".split(), {"m": ["n", "s", "r"], "f": ["a", "ia", "na"], "n": ["e", "i"], "s": ["ner", "man", "son", "ski", "ez"]}),
    "cyrillic": ("ба бо ва ве го да де жа за зи ка ко ла ли ма ми на не па ро са си та ти".split(), {"m": ["н", "р"], "f": ["а", "ия"], "n": ["и"], "s": ["ов", "ин", "ский"]}),
}


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical form of the surrogate."""
    draw = Draw(key, kind, entity, attempt)
    if kind == "email":
        user, domain = entity.split("@", 1)
        labels = domain.split(".")
        place = Draw(key, "domain", domain, attempt)
        return draw.letters(user) + "@" + ".".join([*[place.letters(x) for x in labels[:-1]], labels[-1]])
    if kind == "iban":
        body = draw.letters(entity[4:])
        return entity[:2] + _iban_check(entity[:2], body) + body
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ssn":
        return f"{100 + draw.below(566):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "phone":
        return entity[0] + draw.digits(entity[1:])
    if kind == "card":
        body = entity[0] + draw.digits(entity[1:-1])
        good = next(d for d in "0123456789" if luhn(body + d))
        return body + (good if luhn(entity) else str((int(good) + 1 + draw.below(9)) % 10))
    syllables, endings = _SYLLABLES["cyrillic" if re.match("[а-яё]", entity) else "latin"]
    count = max(1, min(4, len(entity) // 3)) + attempt // 4
    return "".join(syllables[draw.below(len(syllables))] for _ in range(count)) + (e := endings[gender if kind != "surname" else "s"])[draw.below(len(e))]


def rendered(kind: str, mention: str, chosen: str) -> str:
    """The surrogate in the format of the mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter("1" * (sum(c.isalnum() for c in mention) - len(chosen)) + chosen)
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, chosen, strict=True))
    if kind == "ip":
        return chosen
    return chosen.upper() if mention.isupper() else chosen.capitalize()


def own_gender(kind: str, entity: str) -> str:
    """The gender that needs no corpus."""
    return _FOLDED.get(entity, "n") if kind == "given" else "n"


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct entities of a partition, with the genders that lists or titles tell."""
    seen: set[tuple[str, str, str]] = set()
    for batch in batches:
        fresh = set()
        for t in batch["text"]:
            if isinstance(t, str):
                for _, _, k, e, g in gendered_mentions(t):
                    fresh.add((k, e, own if (own := own_gender(k, e)) != "n" else g))
        fresh -= seen
        if fresh:
            yield pd.DataFrame(list(fresh), columns=["kind", "entity", "gender"])
        seen |= fresh
        if len(seen) > 200_000:
            seen.clear()


def _drawn(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(surrogate=[surrogate(key, k, e, a, g) for k, e, g, a in zip(b["kind"], b["entity"], b["gender"], b["attempt"], strict=True)])

    return run


#: Kinds whose surrogates are told apart by a shared space of forms.
def _space() -> Column:
    return F.col("kind")


def redrawn(docs: DataFrame, key: bytes, text: str, scratch: Scratch, draw: Callable | None = None) -> DataFrame:
    """(kind, entity, gender, attempt) of the entities that need looking up: redrawn ones and names of a gender the corpus tells."""
    draw = draw or _drawn(key)
    rows = docs.select(F.col(text).alias("text"))
    told = rows.mapInPandas(_entities, "kind string, entity string, gender string").groupBy("kind", "entity").agg(F.array_remove(F.collect_set("gender"), "n").alias("g"))
    entities = told.select("kind", "entity", F.when(F.size("g") == 1, F.get("g", F.lit(0))).otherwise("n").alias("gender"))
    entities = scratch.save(entities, "entities")
    schema = "kind string, entity string, gender string, attempt int, surrogate string"
    state = scratch.save(entities.withColumn("attempt", F.lit(0)).mapInPandas(draw, schema), "draw-0")
    real = entities.select(_space().alias("space"), F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    for k in range(1, ROUNDS + 1):
        spaced = state.withColumn("space", _space())
        # per taken form one owner: the entity drawn first, then the smallest
        owners = spaced.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "entity", "kind")).alias("owner"), F.count("*").alias("n"))
        checked = spaced.join(owners, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        own = (F.col("owner.entity") == F.col("entity")) & (F.col("owner.kind") == F.col("kind"))
        lost = (F.col("n") > 1) & ~own | F.col("real").isNotNull()
        marked = scratch.save(checked.select("kind", "entity", "gender", "attempt", "surrogate", lost.alias("lost")), f"marked-{k}")
        scratch.drop(f"draw-{k - 1}")
        if marked.where("lost").isEmpty():
            listed = F.col("entity").isin(*_FOLDED)
            return marked.where((F.col("attempt") > 0) | ((F.col("gender") != "n") & ~listed)).select("kind", "entity", "gender", "attempt")
        again = marked.where("lost").select("kind", "entity", "gender", F.lit(k).alias("attempt")).mapInPandas(draw, schema)
        state = scratch.save(marked.where("not lost").drop("lost").unionByName(again), f"draw-{k}")
    raise RuntimeError("surrogates keep colliding; the key space of a kind is exhausted")


def _rewritten(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, spans = [], []
            for text, again in zip(batch["text"], batch["again"], strict=True):
                known = {(a["kind"], a["entity"]): (a["attempt"], a["gender"]) for a in again} if again is not None else {}
                out, at, own = [], 0, []
                for a, b, kind, entity in mentions(text) if isinstance(text, str) else []:
                    new = rendered(kind, text[a:b], surrogate(key, kind, entity, *known.get((kind, entity), (0, own_gender(kind, entity)))))
                    out += [text[at:a], new]
                    at = b
                    own.append({"start": a, "end": b, "kind": kind, "surrogate": new})
                texts.append("".join([*out, text[at:]]) if own else text)
                spans.append(own)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "text": texts, "spans": spans})

    return run


def _ids_by_entity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, kind, e) for k, t in zip(batch["key"], batch["text"], strict=True) if isinstance(t, str) for kind, e in {x[2:] for x in mentions(t)}]
        yield pd.DataFrame(rows, columns=["key", "kind", "entity"])


def pseudonymised(docs: DataFrame, key: bytes = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every row: the rewritten text, and where in the old text what was replaced."""
    scratch = Scratch(docs.sparkSession, "surrogates")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    again = scratch.save(redrawn(docs, key, text, scratch), "redrawn")
    if again.isEmpty():
        marked = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,entity:string,gender:string,attempt:int>>"))
    else:
        keyed = rows.withColumn("key", F.xxhash64("text"))
        uses = keyed.select("key", "text").mapInPandas(_ids_by_entity, "key long, kind string, entity string").distinct()
        lists = uses.join(again, ["kind", "entity"]).groupBy("key").agg(F.collect_list(F.struct("kind", "entity", "gender", "attempt")).alias("again"))
        lists = scratch.save(lists, "lists")
        marked = keyed.join(F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists, "key", "left").select("doc_id", "text", "again")
    schema = "doc_id long, text string, spans array<struct<start:int,end:int,kind:string,surrogate:string>>"
    return marked.mapInPandas(_rewritten(key), schema)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_entities"),
        F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))).alias("spans"),
        "text",
    )
