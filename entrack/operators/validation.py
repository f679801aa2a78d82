"""Checks and choices on single rows: payload guards, labels, command codes, settings, sampling places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entrack.functions import text as X
from entrack.operators.lineage import cut
from entrack.operators.sequences import places

#: The largest whole number that a double holds exactly, and the limits of a report.
SAFE = 9007199254740991
LIMITS = {"name": 200, "others": 10, "field": 60, "image": 3_000_000, "url": 2000}


def safe_id(value: Column, least: int = 1) -> Column:
    """Whether a number is a whole one in the range that doubles hold exactly."""
    return F.coalesce((value == F.floor(value)) & value.between(least, SAFE), F.lit(False))


def parsed_pack(rows: DataFrame, least_rows: int) -> DataFrame:
    """(id, name, desc, extra) of the rows with a positive id and text in name and desc, the first of each id.

    ``rows``: pos, id (double), name, desc, extra. Fewer than ``least_rows`` are a broken answer: then no row is good.
    """
    good = rows.where(safe_id(F.col("id"))).withColumns({c: X.clean_lines(F.col(c)) for c in ("name", "desc", "extra")})
    good = good.where(F.col("name").isNotNull() & F.col("desc").isNotNull())
    firsts = good.groupBy(F.col("id").cast("long").alias("id")).agg(F.min_by(F.struct("name", "desc", "extra"), "pos").alias("t")).select("id", "t.*")
    enough = firsts.agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    return firsts.join(F.broadcast(enough), how="cross").drop("n")  # one row or none


def all_or_nothing(rows: DataFrame, group: list[str], valid: Column, most: int) -> DataFrame:
    """The rows of the groups whose rows are all valid and not more than ``most``."""
    w = Window.partitionBy(*group)
    ok = F.bool_and(F.coalesce(valid, F.lit(False))).over(w) & (F.count("*").over(w) <= most)
    return rows.withColumn("_ok", ok).where("_ok").drop("_ok")


def first_known(candidates: Column, known: Column, sentinel: int) -> Column:
    """The first candidate that is in the array of known entities and not the sentinel."""
    return F.get(F.filter(candidates, lambda c: (c != sentinel) & F.array_contains(known, c)), 0)


def display_id(item_id: Column, item_ids: Column) -> Column:
    """A synthetic item shows as its entity's first item, where the entity is known."""
    return F.when(X.is_synthetic(item_id), F.coalesce(F.get(item_ids, 0), item_id)).otherwise(item_id)


def prefix_group(value: Column, prefixes: list[tuple[str, str]], default: str) -> Column:
    """The group of the first prefix that fits."""
    found = F.lit(default)
    for prefix, group in reversed(prefixes):
        found = F.when(value.startswith(prefix), group).otherwise(found)
    return found


def answer_label(top: Column, truth: Column, sure: Column) -> Column:
    """How an answer stands to the truth; a null truth is no entity at all."""
    how = F.when(sure, "sure-").otherwise("unsure-")
    return F.when(top.isNull(), "nothing").when(truth.isNull(), F.concat(how, F.lit("noncard"))).otherwise(F.concat(how, F.when(top == truth, "right").otherwise("wrong")))


def decision_label(error: Column, candidates: Column, sure: Column, sentinel: Column, suggested: Column, badge: Column) -> Column:
    """One of eight decisions; a null ``candidates`` was not run."""
    return (
        F.when(candidates.isNull(), "not-run").when(error, "error").when(candidates == 0, "nothing")
        .when(sure, F.when(sentinel, "confident-back").otherwise("confident")).when(suggested, "suggested").when(badge, "badge")
        .otherwise(F.when(sentinel, "unsure-back").otherwise("unsure"))
    )


def command(code: Column, tags: list[str]) -> Column:
    """struct(kind, pick, id, tags, note) of a code like ``12=3 foil held``: a pick, an id, x or neg."""
    pattern = r"^(\d+)=(\S+)(?:\s+(.*))?$"
    what, rest = F.regexp_extract(code, pattern, 2), F.regexp_extract(code, pattern, 3)
    words = F.filter(F.split(rest, r"[\s,]+"), lambda w: w != "")
    known = F.array(*[F.lit(t) for t in tags])
    kind = F.when(~code.rlike(pattern), "bad").when(what == "x", "reject").when(what == "neg", "negative").when(what.startswith("id:"), "identified").when(what.rlike(r"^\d+$"), "candidate").otherwise("bad")
    named = kind.isin("identified", "candidate")
    reason = F.when(kind == "reject", F.when(rest == "", "rejected").otherwise(rest)).when(kind == "negative", F.when(rest == "", "non-card").otherwise(rest))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "candidate", F.try_to_number(what, F.lit("999999999"))).cast("long").alias("pick"),
        F.when(kind == "identified", F.substring(what, 4, 40).try_cast("long")).alias("id"),
        F.when(named, F.filter(words, lambda w: F.array_contains(known, w))).alias("tags"),
        F.when(named, F.array_join(F.filter(words, lambda w: ~F.array_contains(known, w)), " ")).otherwise(reason).alias("note"),
    )


def known_or(value: Column, known: list[str], default: str, renamed: dict[str, str] | None = None) -> Column:
    """A setting's value where it is a known one, after old names were replaced; else the default."""
    for old, new in (renamed or {}).items():
        value = F.when(value == old, new).otherwise(value)
    return F.when(value.isin(*known), value).otherwise(default)


def log_shape(log: Column, statuses: list[str]) -> Column:
    """Whether a parsed log (struct) has all its fields in their types, entries included."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    entry = lambda e: number(e["entity_id"]) & number(e["first"]) & number(e["last"]) & number(e["appearances"])
    ok = log["page"].isNotNull() & number(log["started"]) & log["status"].isin(*statuses) & log["entries"].isNotNull() & F.forall(log["entries"], entry)
    return F.coalesce(ok, F.lit(False))


def safe_url(url: Column) -> Column:
    """An http(s) address without credentials and not too long, else null."""
    fits = url.rlike(r"^(?i:https?)://[^/?#@\s]+(?:[/?#]\S*)?$") & (F.length(url) <= LIMITS["url"])
    return F.when(fits, url)


#: The first bytes of each image type, in hex, and where in the file they stand.
_SIGNS = {"png": [("89504E470D0A1A0A", 1)], "jpeg": [("FFD8FF", 1)], "webp": [("52494646", 1), ("57454250", 9)]}
#: The kinds of image that a data URL may name.
_IMAGE = r"^data:image/(png|jpeg|webp);base64,([A-Za-z0-9+/]+={0,2})$"


def image_fault(url: Column) -> Column:
    """What is wrong with an image's data URL, null where nothing is."""
    kind, body = F.regexp_extract(url, _IMAGE, 1), F.regexp_extract(url, _IMAGE, 2)
    data = F.try_to_binary(body, F.lit("base64"))
    signed = F.lit(False)
    for name, signs in _SIGNS.items():
        held = F.lit(True)
        for sign, at in signs:
            held = held & (F.hex(F.substring(data, at, len(sign) // 2)) == sign)
        signed = F.when(kind == name, held).otherwise(signed)
    return (
        F.when(url.isNull(), "image: not a data URL").when(~url.rlike(_IMAGE), "image: not a known data URL").when(F.length(body) * 3 / 4 > LIMITS["image"] + 3, "image: too large")
        .when(data.isNull(), "image: not base64").when(~F.coalesce(signed, F.lit(False)), F.concat(F.lit("image: not a "), F.upper(kind), F.lit(" file")))
    )


REPORT = "v int, kind string, shown struct<id:double,name:string,score:double>, others array<struct<id:double,name:string>>, userCard struct<id:double,name:string>, comment string, video struct<url:string,time:double>, app struct<version:string>, image string"


def report_fault(body: Column, kinds: list[str]) -> Column:
    """The first reason to reject a parsed report (struct of REPORT), null for a good one."""
    entity = lambda c: safe_id(c["id"], 0) & (F.coalesce(X.one_line(c["name"], LIMITS["name"]), F.lit("")) != "")
    none = F.coalesce(F.size(body["others"]), F.lit(0)) <= 0
    return (
        F.when(body.isNull() | ~F.coalesce(body["v"] == 1, F.lit(False)), "not a version 1 report")
        .when(~F.coalesce(body["kind"].isin(*kinds), F.lit(False)), "kind: unknown")
        .when(body["shown"].isNotNull() & ~entity(body["shown"]), "shown: not an entity")
        .when((body["kind"] != "no-match") & body["shown"].isNull(), F.concat(body["kind"], F.lit(": nothing shown")))
        .when(~none & F.exists(F.slice(body["others"], 1, LIMITS["others"]), lambda c: ~entity(c)), "others: not an entity")
        .when(body["userCard"].isNotNull() & ~entity(body["userCard"]), "userCard: not an entity")
        .when(body["video"].isNotNull() & safe_url(body["video"]["url"]).isNull(), "video: not an http(s) address")
        .when(body["app"].isNull(), "app: missing")
        .when(~F.coalesce(body["app"]["version"].rlike(r"^\d+(\.\d+){1,3}$"), F.lit(False)), "app.version: not a version number")
        .otherwise(image_fault(body["image"]))
    )


#: The longest comment, and the first second that is no time of a video.
MOST_COMMENT, NO_TIME = 500, 1e7


def report_fields(body: Column) -> Column:
    """What a good report says: the user's entity, the comment in clean lines and cut, the video's second as a whole number or null."""
    time = body["video"]["time"]
    return F.struct(
        body["userCard"]["id"].cast("long").alias("user_entity"), F.substring(X.clean_lines(body["comment"]), 1, MOST_COMMENT).alias("comment"),
        F.when((time >= 0) & (time < NO_TIME), F.floor(time)).alias("second"),
    )


def video_link(url: Column, seconds: Column) -> Column:
    """The canonical address of a video by its id, with the time; other addresses in code signs."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#]+)", 1)), r"^(www|m|music)\.", "")
    short = F.regexp_extract(url, r"^(?i:https?)://[^/?#]+/([^/?#]*)", 1)
    long = F.when(F.regexp_extract(url, r"^(?i:https?)://[^/?#]+(/[^?#]*)", 1) == "/watch", F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)).otherwise("")
    found = F.when(host == "youtu.be", short).when(host == "youtube.com", long).otherwise("")
    at = F.when(seconds.isNotNull(), F.concat(F.lit("&t="), seconds.cast("string"), F.lit("s"))).otherwise("")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "`", "%60"), r"\|", "%7C"), r"\\", "%5C")
    #: Fixed value: what a video id looks like.
    return F.when(found.rlike(r"^[A-Za-z0-9_-]{11}$"), F.concat(F.lit("https://www.youtube.com/watch?v="), found, at)).otherwise(F.concat(F.lit("`"), marked, F.lit("`")))


def spread_places(count: Column, n: int) -> Column:
    """Up to n of the places 0 .. count - 1, the ends included, evenly between; halves round up."""
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(max(n, 2) - 1)), lambda i: F.floor(i * (count - 1) / (max(n, 2) - 1) + 0.5).cast("int"))
    few = F.array().cast("array<int>") if n <= 0 else F.array(F.lit(0)) if n == 1 else F.array_distinct(spaced)
    return F.when(count <= n, every).otherwise(few)


def radical_inverse(i: Column, base: int, digits: int = 32) -> Column:
    """The digits of i in the base, mirrored behind the point."""
    start = F.struct(i.cast("long").alias("left"), F.lit(0.0).alias("out"), F.lit(1.0 / base).alias("f"))
    step = lambda s, _: F.struct(F.floor(s["left"] / base).alias("left"), (s["out"] + s["f"] * (s["left"] % base)).alias("out"), (s["f"] / base).alias("f"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step)["out"]


def _wrapped(x: Column) -> Column:
    """A product of two 32-bit values, kept to 32 bits."""
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2 ** 32 without leaving 64 bits."""
    high, low = F.shiftrightunsigned(a, 16), a.bitwiseAND(F.lit(0xFFFF))
    return _wrapped(F.shiftleft(_wrapped(high * b).bitwiseAND(F.lit(0xFFFF)), 16) + low * b)


def seeded_uniform(seed: Column, nth: Column) -> Column:
    """The nth (from 1) draw in [0, 1) of a 32-bit counter generator: each draw depends on seed and number only."""
    t = _wrapped(seed.cast("long") + _times(nth.cast("long"), F.lit(0x6D2B79F5)))
    t = _times(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR(_wrapped(t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def text_seed(text: Column) -> Column:
    """A 32-bit seed of a string: its characters' codes, xor and times a prime, in order (FNV-1a)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: _times(h.bitwiseXOR(c.cast("long")), F.lit(16777619).cast("long")))


def shuffled_sample(rows: DataFrame, order: str, k: int, seed: int) -> DataFrame:
    """The rows that a seeded shuffle of the whole table, by swaps from its end down, puts first, with their ``place`` from 0.

    ``order``: a numeric column that fixes the table's order. Swap i exchanges place i with place j <= i. Followed
    backwards, a row that ends at place q < k leaves it with the first later swap that draws q, for that swap's own place,
    and so on: a row only moves up. So each place needs its first later swap alone, a minimum by group, and only the k
    places are followed, in some log(n / k) joins; no list of all rows is held. The driver holds k numbers.
    """
    spark = rows.sparkSession
    counted = places(rows.withColumn("_all", F.lit(0)), ["_all"], order).drop("_all", "_c")
    n = rows.count()
    if not n or k < 1:
        return counted.where("false").withColumnRenamed("_n", "place")
    k = min(k, n)
    i = F.col("i")
    swaps = spark.range(1, n).select(F.col("id").alias("i")).withColumn("j", F.floor(seeded_uniform(F.lit(seed), F.lit(n) - i) * (i + 1)))
    held = list(range(k))
    for swap in sorted(swaps.where(i < k).collect()):  # k numbers
        held[swap.i], held[swap.j] = held[swap.j], held[swap.i]
    later = cut(swaps.where((i >= k) & (i > F.col("j"))).groupBy("j").agg(F.min("i").alias("i")))
    found = spark.createDataFrame([(place, j) for j, place in enumerate(held)], "place long, j long")
    while True:
        onward = later.join(F.broadcast(found), "j").select("place", "i")  # k rows go out, the swaps stay where they are
        moved = cut(found.join(F.broadcast(onward), "place", "left").select("place", F.coalesce("i", "j").alias("j"), F.col("i").isNotNull().alias("moved")))
        found = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return counted.join(F.broadcast(found.withColumnRenamed("j", "_n")), "_n").drop("_n")
