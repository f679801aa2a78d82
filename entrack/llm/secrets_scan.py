"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions only.

Base spans come from three patterns. The method then looks at every other run of code-like characters: it
infers the encoding from the characters in use, and runs three tests against the null hypothesis of uniform
independent symbols of that alphabet: chi-squared uniformity, the number of runs above and below the middle
of the alphabet, and the lag-one serial correlation. A run counts as random when none of the tests rejects
uniformity after correction for three tests. As ordinary words could pass by chance when they are short,
each candidate also gets a p-value against ordinary text: how many times likelier its symbols are by the
frequencies of text (letters of one case or of both, few digits and signs) than by uniform draws from the
encoding's alphabet, which bounds the chance that text is as unlike text as that. It falls with the length for
alphabets of any size. The Benjamini-Hochberg
step-up over all candidates of a length band keeps the expected share of false discoveries below ``FDR``. The
step-up works on counts of p-values in fixed bins, so it needs no global sort.

Defined cases: null and empty texts have no spans; nulls elsewhere and extra columns change nothing; repeated
rows give repeated results; an empty table gives an empty result. Offsets count code points from 0, end
exclusive; spans are ordered by start, then assign, access, hex, random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, table

#: Fixed patterns of the base kinds, in the order they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
#: Candidates of the battery: runs of at least 20 code-like characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FDR, REJECT, BINS, BAND = 0.01, 0.001, 400, 16
#: Fixed: rounded frequencies of the letters a-z in English, French, German and Spanish text together, and the
#: shares of digits and signs among code-like characters of ordinary text; the smaller share of letters is capital.
LETTERS = (79, 16, 30, 43, 145, 15, 17, 32, 74, 4, 8, 43, 28, 76, 53, 21, 7, 67, 71, 66, 47, 12, 10, 3, 8, 7)
DIGITS, SIGNS, CAPITALS = 0.05, 0.02, 0.15
#: Fixed: encodings by the characters in use, smallest alphabet first.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"
KINDS = ("assign", "access", "hex", "random")


def _spans(text: Column, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: lengths of matches and of what stands between them, added up."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    walked = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["b"] + x["m"]).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["b"]).alias("start"), F.lit(kind).alias("kind"), (s["at"] + x["b"] + x["m"]).alias("end")))).alias("out"),
        ),
    )["out"]
    if least is None:
        return walked
    kept = F.filter(F.arrays_zip(walked.alias("s"), least.alias("v")), lambda x: F.length(x["v"]) >= LEAST_VALUE)
    return F.transform(kept, lambda x: x["s"])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns."""
    none = F.array().cast(_SPAN)
    low = F.lower(text)
    may = low.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        may = may | low.contains(word)
    assign = F.when(may, _spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none)
    return F.concat(assign, access, hexes)


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by a logistic approximation good to about 0.0002; bounded away from 0."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1.0 / (1.0 + F.exp(1.5976 * x + 0.070565992 * x * x * x))


def _text_weights(alphabet: str) -> Column:
    """For each symbol of an alphabet log10 of its frequency in text times the size of the alphabet."""
    cased = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
    weights = []
    for c in alphabet:
        if c.isalpha():
            share = (CAPITALS if c.isupper() else 1 - CAPITALS) if cased else 1.0
            frequency = (1 - DIGITS - SIGNS) * share * LETTERS[ord(c.lower()) - ord("a")] / sum(LETTERS)
        else:
            frequency = DIGITS / 10 if c.isdigit() else SIGNS / 4
        weights.append(F.lit(math.log10(len(alphabet) * frequency)))
    return F.array(*weights)


def _encoded(value: Column) -> Column:
    """The inferred encoding of a candidate, its alphabet with text weights and its characters without padding."""
    body = F.regexp_replace(value, "=+$", "")
    mixed = ENCODINGS[-2][2] + "-_"
    encoding, alphabet, weights = F.lit("mixed"), F.lit(mixed), _text_weights(mixed)
    for name, pattern, symbols in reversed(ENCODINGS):
        fits = body.rlike(pattern)
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(symbols)).otherwise(alphabet)
        weights = F.when(fits, _text_weights(symbols)).otherwise(weights)
    return F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), weights.alias("weights"), body.alias("body"))


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + f(v))


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, n, uniform_p and words_p to rows with the column ``value``.

    uniform_p is the least of the three tests' p-values, corrected for taking the least of three;
    words_p bounds the chance that ordinary text is as much likelier by uniform draws.
    """
    rows = candidates.withColumn("b", _encoded(F.col("value")))
    marks = F.filter(F.split(F.col("b.body"), ""), lambda c: c != "")
    rows = rows.withColumn("x", F.transform(marks, lambda c: (F.position(c, F.col("b.alphabet")) - 1).cast("double")))
    rows = rows.withColumn("n", F.size("x").cast("double")).withColumn("k", F.length("b.alphabet").cast("double"))
    x, n, k = F.col("x"), F.col("n"), F.col("k")

    squares = _total(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
    rows = rows.withColumn("chi2", k / n * squares - n).withColumn("mean", _total(x, lambda v: v) / n)
    rows = rows.withColumn("above", _total(x, lambda v: (v >= k / 2).cast("double"))).withColumn("spread", _total(x, lambda v: F.pow(v - F.col("mean"), F.lit(2.0))))
    after = F.slice(x, 2, F.greatest(F.lit(1), F.size(x) - 1))
    steps = F.zip_with(F.slice(x, 1, F.size(after)), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("runs", 1 + _total(steps, lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double")))
    rows = rows.withColumn("lag", _total(steps, lambda p: (p["a"] - F.col("mean")) * (p["b"] - F.col("mean"))))

    df = k - 1
    chi_z = (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    pairs = 2 * F.col("above") * (n - F.col("above"))
    variance = pairs * (pairs - n) / (n * n * (n - 1))
    runs_z = F.when(variance > 0, (F.col("runs") - 1 - pairs / n) / F.sqrt(variance)).otherwise(8.0)
    lag_z = F.when(F.col("spread") > 0, (F.col("lag") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(8.0)
    two_sided = [2 * _upper_tail(F.abs(z)) for z in (chi_z, runs_z, lag_z)]
    words = _total(x, lambda v: F.get(F.col("b.weights"), v.cast("int")))
    return rows.select(
        *candidates.columns,
        F.col("b.encoding").alias("encoding"),
        F.col("n").cast("int").alias("n"),
        F.least(F.lit(1.0), 3 * F.least(*two_sided)).alias("uniform_p"),
        F.pow(F.lit(10.0), F.greatest(F.lit(-300.0), F.least(F.lit(0.0), words))).alias("words_p"),
    )


def discoveries(tested: DataFrame) -> DataFrame:
    """The random-looking rows of ``tested`` that the step-up of their length band accepts."""
    rows = tested.withColumn("band", F.floor(F.log2(F.col("n") / 20) * 2)).withColumn(
        "bin", F.least(F.lit(BINS - 1), F.floor(-F.log10("words_p") * 25))
    )
    counts = rows.groupBy("band", "bin").agg(F.count("*").alias("m"))
    beyond = Window.partitionBy("band").orderBy(F.col("bin").desc())
    steps = counts.withColumn("found", F.sum("m").over(beyond)).withColumn("all", F.sum("m").over(Window.partitionBy("band")))
    accepted = steps.where(F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 25) <= FDR * F.col("found"))
    least = accepted.groupBy("band").agg(F.min("bin").alias("least"))  # a row for each half octave of length
    return rows.join(F.broadcast(least), "band").where((F.col("bin") >= F.col("least")) & (F.col("uniform_p") >= REJECT)).drop("band", "bin", "least")


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, random) of every row: arrays of struct(start, kind, end); kind indexes KINDS."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    may = F.col("text").rlike(CANDIDATE)
    rows = rows.select(
        "doc_id",
        base_spans(F.col("text")).alias("base"),
        F.when(may, _spans(F.col("text"), CANDIDATE, 3)).alias("runs"),
        F.when(may, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("values"),
    ).withColumn("row_id", F.monotonically_increasing_id())
    scanned = scratch.save(rows, "scanned")
    each = scanned.select("row_id", "base", F.explode(F.arrays_zip("runs", "values")).alias("c")).select(
        "row_id", "base", F.col("c.runs").alias("span"), F.col("c.values").alias("value")
    )
    each = each.where(~F.exists("base", lambda s: (s["start"] < F.col("span.end")) & (F.col("span.start") < s["end"]))).drop("base")
    tested = scratch.save(battery(each), "tested")
    found = discoveries(tested).groupBy("row_id").agg(F.collect_list("span").alias("random"))
    return scanned.join(found, "row_id", "left").select("doc_id", "base", F.coalesce("random", F.array().cast(_SPAN)).alias("random"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "random")).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
