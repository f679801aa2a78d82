"""Tiered and fuzzy name search over a keyed name table (pos, id, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entrack.operators.lineage import cut


def similarity(query: Column, key: Column) -> Column:
    """1 - distance / longer length, never below 0; equal keys have 1."""
    longest = F.greatest(F.lit(1), F.length(query), F.length(key))
    return F.when(query == key, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(query, key) / longest), 9))


def length_bound(query: Column, key: Column) -> Column:
    """What the similarity cannot exceed, from the lengths alone."""
    longest = F.greatest(F.lit(1), F.length(query), F.length(key))
    return 1.0 - F.abs(F.length(query) - F.length(key)) / longest


#: With so many of a query's rarest bigrams a first set of keys is found, whose scores give the floor of its list.
SEEDS = 3


def _substrings(text: Column, size: int) -> Column:
    """All substrings of one length, in order; none where the text is shorter."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (size - 1))), lambda i: i + (size - 1) <= F.length(text))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def _probes(queries: DataFrame, index: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(query_id, size, gram, r): every gram of each query with its place from the rarest on, by size."""
    each = None
    for size in sizes:
        part = queries.select("query_id", F.lit(size).alias("size"), F.posexplode(_substrings(F.col("query"), size)).alias("at", "gram"))
        each = part if each is None else each.unionByName(part)
    counts = index.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
    order = Window.partitionBy("query_id", "size").orderBy(F.coalesce("held", F.lit(0)), "at")
    return each.join(counts, "gram", "left").select("query_id", "size", "gram", F.row_number().over(order).alias("r"))


def fuzzy_matches(queries: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, pos, score): the k most similar names of each query; ties by position.

    ``queries``: query_id, query; ``names``: pos, id, key. Exact, though a query meets only the keys that share its rare
    grams. The keys with its rarest bigrams, and the first k of all, give a score that the list's last reaches. A key with that
    score shares so many of the query's grams (an edit changes two bigrams or one letter at most) that it holds one
    of the rarest of them, as many as could be missing and one more; where bigrams promise nothing, letters do. Names
    that share a key are compared once.
    """
    queries = queries.where(F.length("query") > 0)
    keys = names.groupBy("key").agg(F.min("pos").alias("first")).where(F.length("key") > 0)
    index = keys.select("key", F.explode(F.array_distinct(F.concat(_substrings(F.col("key"), 1), _substrings(F.col("key"), 2)))).alias("gram"))
    probes = cut(_probes(queries, index, (1, 2)))
    first = names.orderBy("pos").limit(k).agg(F.collect_list("key").alias("keys")).first()["keys"]  # k names
    always = queries.select("query_id", F.explode(F.array(*[F.lit(x) for x in first]).cast("array<string>")).alias("key"))

    def scored(asked: DataFrame, floor: DataFrame | None) -> DataFrame:
        pairs = asked.join(index, "gram").select("query_id", "key").unionByName(always).distinct().join(queries, "query_id")
        if floor is not None:
            pairs = pairs.join(floor, "query_id").where(length_bound(F.col("query"), F.col("key")) >= F.col("floor") - 1e-9)
        return pairs.select("query_id", "key", similarity(F.col("query"), F.col("key")).alias("score"))

    seeds = scored(probes.where((F.col("size") == 2) & (F.col("r") <= SEEDS)).select("query_id", "gram"), None)
    nth = seeds.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc())))
    floor = cut(nth.where(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") == k, F.col("low")).otherwise(0.0).alias("floor")))
    n, f = F.length("query"), F.col("floor")
    pairs_kept, letters_kept = F.ceil(n * (2 * f - 1) - 1 - 1e-6), F.greatest(F.lit(1), F.ceil(n * f - 1e-6))
    reach = F.when(pairs_kept >= 1, F.struct(F.lit(2).alias("size"), (n - 1 - pairs_kept + 1).alias("upto"))).otherwise(F.struct(F.lit(1).alias("size"), (n - letters_kept + 1).alias("upto")))
    reaches = queries.join(floor, "query_id").select("query_id", reach.alias("reach")).select("query_id", "reach.*")
    asked = probes.join(reaches, ["query_id", "size"]).where(F.col("r") <= F.col("upto")).select("query_id", "gram").distinct()
    # no key beyond the k-th distinct score can reach the list
    close = scored(asked, floor).withColumn("step", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("step") <= k)
    return _listed(close.join(_first_names(names, k), "key"), [F.col("score").desc(), F.col("pos")], k)


def _first_names(names: DataFrame, k: int) -> DataFrame:
    """At most k names of each key, the first ones."""
    return names.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where(F.col("_n") <= k).drop("_n")


def _listed(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "pos", "score")


def prefix_tokens(query: Column, key: Column) -> Column:
    """Whether every query token begins a name token, taken greedily, each name token once."""
    state = F.aggregate(
        F.split(query, " "),
        F.struct(F.lit(True).alias("ok"), F.split(key, " ").alias("left")),
        lambda s, q: F.struct(
            (s["ok"] & F.exists(s["left"], lambda t: t.startswith(q))).alias("ok"),
            _without_first(s["left"], q).alias("left"),
        ),
    )
    return state["ok"]


def _without_first(tokens: Column, q: Column) -> Column:
    hits = F.transform(tokens, lambda t: t.startswith(q))
    at = F.array_position(hits, F.lit(True)).cast("int")
    return F.when(at == 0, tokens).otherwise(F.concat(F.slice(tokens, F.lit(1), at - 1), F.slice(tokens, at + 1, F.size(tokens))))


def _holding(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, query, key): keys that may hold the query, or the beginning of one of its tokens, by its rarest trigram.

    Keys are indexed with a space before them, so a token's beginning is a gram that begins with a space.
    """
    spaced = F.concat(F.lit(" "), F.col("key"))
    grams = F.array_distinct(F.concat(*[_substrings(spaced, size) for size in (1, 2, 3)]))
    query = F.col("query")
    inside = F.when(F.length(query) >= 3, _substrings(query, 3)).otherwise(F.array(query))
    begins = F.transform(F.split(query, " "), lambda t: F.concat(F.lit(" "), F.substring(t, 1, 2)))
    asked = queries.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("way"), inside.alias("grams")), F.struct(F.lit(2).alias("way"), begins.alias("grams")))).alias("w"))
    asked = asked.select("query_id", "w.way", F.explode("w.grams").alias("gram"))
    index = names.select("key").distinct().select("key", F.explode(grams).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = asked.join(counts, "gram", "left").groupBy("query_id", "way").agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), "gram")).alias("gram"))
    return rarest.select("query_id", "gram").distinct().join(index, "gram").select("query_id", "key").distinct().join(queries, "query_id")


def tiered_search(queries: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, pos, score): token beginnings (1), then substrings (0.8), then fuzzy fill.

    Inside the first two tiers the shorter name comes first, then the name, then its position. The fuzzy
    tier takes its k matches before those of the other tiers are left out, so a list may stay short.
    """
    queries = queries.where(F.length("query") > 0)
    tier = F.when(prefix_tokens(F.col("query"), F.col("key")), 0).when(F.col("key").contains(F.col("query")), 1)
    keys = _holding(queries, names).withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = keys.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.length("key"), "key"))).where(F.col("n") <= k).drop("n")
    order = Window.partitionBy("query_id").orderBy("tier", F.length("key"), "key", "pos")
    exact = best.join(_first_names(names, k), "key").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    exact = cut(exact.select("query_id", "id", "pos", "tier", "n", F.when(F.col("tier") == 0, 1.0).otherwise(0.8).alias("score")))
    fuzzy = fuzzy_matches(queries, names, k).select("query_id", "id", "pos", F.lit(2).alias("tier"), F.col("rank").alias("n"), "score")
    extra = fuzzy.join(exact.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    return _listed(exact.unionByName(extra), [F.col("tier"), F.col("n")], k)
