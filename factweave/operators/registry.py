"""Registries of entity and attribute keys (J13-J15, SNK7-SNK8, AG9, ST6)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import key_score, key_similarity
from .facts import spread
from .vectors import nearest_vectors  # noqa: F401


def link_new_keys(candidates: list[str], known: list[str], threshold: float) -> dict[str, str]:
    """candidate -> canonical key, in order of first appearance: a key that nothing resembles joins the known ones at
    once. Inherently sequential, so it runs over distinct keys only, on the driver; the earliest of equal scores
    in key order wins."""
    have, out = set(known), {}
    for key in candidates:
        if key in have or key in out:
            out.setdefault(key, key)
            continue
        best, score = None, 0.0
        for other in sorted(have):
            # The ratio cannot exceed twice the shorter length over the sum.
            if 200.0 * min(len(key), len(other)) / max(1, len(key) + len(other)) <= score:
                continue
            if (own := key_score(key, other)) > score:
                best, score = other, own
        out[key] = best if best is not None and score >= threshold else key
        have.add(out[key])
    return out


#: Ways to strike letters out of a key, for each length of the other key, up to which keys meet on what is left.
WAYS = 500


def _kept(n, m, threshold: float):
    """The letters that keys of n and m letters have in common, in order, if they score the threshold."""
    least = threshold * (n + m) / 200.0 - 1e-9
    return F.ceil(least) if isinstance(least, Column) else math.ceil(least)


def _forms(df: DataFrame, name: str) -> DataFrame:
    """(key as name, form, n): each key as written and with its words sorted, with the form's length."""
    words = F.filter(F.split("key", r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")
    both = F.array_distinct(F.array("key", F.array_join(F.array_sort(words), " ")))
    return spread(df.where("key is not null").select("key"), "key").distinct().select(F.col("key").alias(name), F.explode(both).alias("form")).withColumn("n", F.length("form"))


def _struck(forms: DataFrame, ways: dict[int, set[int]]) -> DataFrame:
    """forms as (name, n, left, gone): what is left of a form, hashed, when so many letters are struck out; ways: how many, by length."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    named = lambda texts, gone: F.transform(texts, lambda t: F.struct(F.xxhash64(t).alias("left"), F.lit(gone).alias("gone")))
    texts, out = F.array("form"), []
    for gone in range(max(map(max, ways.values()), default=-1) + 1):
        if gone:
            texts = F.array_distinct(F.flatten(F.transform(texts, without)))
        if own := [n for n, some in ways.items() if gone in some]:
            out.append(F.when(F.col("n").isin(own), named(texts, gone)))
    none = F.array().cast("array<struct<left:bigint,gone:int>>")
    return forms.select(forms.columns[0], "n", F.inline(F.concat(*[F.coalesce(x, none) for x in out]))).where(F.col("n").isin(list(ways)))


def _rare(mine: DataFrame, theirs: DataFrame, length: dict[int, int]) -> DataFrame:
    """mine as (name, n, gram): of each form the rarest of its bigrams, as many as length has for its own length."""
    def grams(df: DataFrame) -> DataFrame:
        pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.substr("form", i, F.lit(2)))
        numbered = F.transform("pairs", lambda g, i: F.concat(g, F.size(F.filter(F.slice("pairs", F.lit(1), i), lambda x: x == g)).cast("string")))
        return df.withColumn("pairs", pairs).select(df.columns[0], "form", "n", F.explode(numbered).alias("gram"))

    often = grams(mine).select("gram").unionByName(grams(theirs).select("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    by_rank = grams(mine).join(often, "gram").groupBy(mine.columns[0], "form", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("all"))
    upto = F.element_at(F.create_map(*[F.lit(x) for pair in length.items() for x in pair]), F.col("n"))
    return by_rank.select(mine.columns[0], "n", F.explode(F.slice("all", F.lit(1), upto)).alias("one")).select(mine.columns[0], "n", F.col("one.gram").alias("gram"))


def meeting_keys(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(key, other), once: all pairs of keys in left and right (column key) that may score the threshold, and few more.

    Keys of n and m letters score it if they have k = threshold * (n + m) / 200 letters in common, in order: then they
    are equal once n - k letters are struck out of the one and m - k out of the other. So they meet on what is left of
    them, however many keys share most of their letters. Where that would be more than WAYS texts for a key, they share
    k - 1 - (n - k) - (m - k) bigrams, and so one of the rarest of either key. If even that tells nothing, as with long
    keys and low thresholds, all keys of these lengths meet.
    """
    mine, theirs = _forms(left, "key"), _forms(right, "other")
    lengths = lambda df: [r["n"] for r in df.select("n").distinct().collect()]
    strike, rare, every = (({}, {}) for _ in range(3))
    for n, m in itertools.product(lengths(mine), lengths(theirs)):
        k = max(0, _kept(n, m, threshold))
        i, j = n - k, m - k
        if min(i, j) < 0:
            continue
        if max(math.comb(n, i), math.comb(m, j)) <= WAYS:
            strike[0].setdefault(n, set()).add(i)
            strike[1].setdefault(m, set()).add(j)
            continue
        many, (a, b) = (rare, (2 * i + j + 1, 2 * j + i + 1)) if k - 1 - i - j >= 1 else (every, (1, 1))
        many[0][n], many[1][m] = max(a, many[0].get(n, 0)), max(b, many[1].get(m, 0))
    pair = lambda df, **more: df.select(df.columns[0], *[F.col(c).alias(f"{df.columns[0]}_{c}") for c in ("n", *more)], *[c for c in df.columns[1:] if c not in ("n", *more)])
    k = _kept(F.col("key_n"), F.col("other_n"), threshold)
    fits = (k <= F.col("key_n")) & (k <= F.col("other_n"))
    met = []
    if strike[0]:
        a, b = pair(_struck(mine, strike[0]), gone=1), pair(_struck(theirs, strike[1]), gone=1)
        met.append(a.join(b, "left").where((F.col("key_gone") == F.col("key_n") - F.greatest(k, F.lit(0))) & (F.col("other_gone") == F.col("other_n") - F.greatest(k, F.lit(0)))))
    of = lambda df, those: df.where(F.col("n").isin(list(those)))
    if rare[0]:
        a, b = of(mine, rare[0]), of(theirs, rare[1])
        met.append(pair(_rare(a, b, rare[0])).join(pair(_rare(b, a, rare[1])), "gram").where(fits))
    if every[0]:
        met.append(pair(of(mine, every[0]).drop("form")).crossJoin(pair(of(theirs, every[1]).drop("form"))).where(fits))
    if not met:
        return mine.select("key", F.lit(None).cast("string").alias("other")).where("false")
    return reduce(DataFrame.unionByName, [df.select("key", "other") for df in met]).distinct()


def similar_keys(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(key, other, score) of the keys in left and right (column key) that score at least the threshold."""
    return meeting_keys(left, right, threshold).withColumn("score", key_similarity("key", "other")).where(F.col("score") >= threshold)


def best_links(candidates: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(key, canonical, score): each candidate's best known key at or over the threshold; equal keys first, ties by key."""
    exact = candidates.select("key").distinct().join(known.select("key").distinct(), "key").select("key", F.col("key").alias("canonical"), F.lit(100.0).alias("score"))
    rest = candidates.select("key").distinct().join(exact, "key", "left_anti")
    w = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    near = similar_keys(rest, known, threshold).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", F.col("other").alias("canonical"), "score")
    return exact.unionByName(near)


def link_in_order(fresh: DataFrame, known: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, canonical) for every key of fresh (key, first): what `link_new_keys` gives for the keys in order of (first, key).

    A key waits until all earlier keys that resemble it are decided; then it takes the best of the known keys and of
    the earlier keys that stand for themselves, or stands for itself. All keys that wait for nothing are decided in one
    round, so the rounds are as many as the longest chain of resemblances, not as the keys. keep writes a table and
    reads it back. First keys come once, the least of their places counts; null keys go.
    """
    own = keep(fresh.where("key is not null").groupBy("key").agg(F.min("first").alias("first")).join(known.select("key").distinct(), "key", "left_anti"))
    old = fresh.select("key").distinct().join(known.select("key").distinct(), "key").select("key", F.col("key").alias("canonical"))
    others = known.select("key").unionByName(own.select("key"))
    found = similar_keys(own, others, threshold).where("key <> other")
    found = found.join(own.withColumnRenamed("first", "at"), "key").join(own.select(F.col("key").alias("other"), F.col("first").alias("other_at")), "other", "left")
    edges = keep(found.where(F.col("other_at").isNull() | (F.struct("other_at", "other") < F.struct(F.col("at").alias("other_at"), F.col("key").alias("other")))).select("key", "other", "score", F.col("other_at").isNotNull().alias("waits")))
    stands = ~F.col("waits") | F.coalesce(F.col("stands") == F.col("other"), F.lit(False))
    decided = keep(own.join(edges, "key", "left_anti").select("key", F.col("key").alias("canonical")))
    while True:
        left = own.join(decided, "key", "left_anti").select("key")
        if left.isEmpty():
            return old.unionByName(decided)
        ahead = edges.join(left, "key", "left_semi").join(decided.select(F.col("key").alias("other"), F.col("canonical").alias("stands")), "other", "left")
        judged = ahead.groupBy("key").agg(
            F.max(F.col("waits") & F.col("stands").isNull()).alias("waiting"),
            F.max(F.when(stands, F.col("score"))).alias("score"),
        ).where("not waiting")
        best = ahead.where(stands).join(judged.select("key", "score"), ["key", "score"]).groupBy("key").agg(F.min("other").alias("canonical"))
        decided = keep(decided.unionByName(judged.join(best, "key", "left").select("key", F.coalesce("canonical", "key").alias("canonical"))))


def apply_links(facts: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """facts with the keys in column replaced by their canonical ones."""
    return facts.join(links.select(F.col("key").alias(column), "canonical"), column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def add_aliases(registry: DataFrame, links: DataFrame) -> DataFrame:
    """registry (key, aliases) with every linked key among its canonical key's aliases, sorted, once."""
    new = links.where("key <> canonical").groupBy(F.col("canonical").alias("key")).agg(F.array_sort(F.collect_set(F.col("key"))).alias("new"))
    none = F.array().cast("array<string>")
    return registry.join(new, "key", "left").select("key", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("new", none))).alias("aliases"))


def register(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """registry with the keys that it lacks, without aliases."""
    fresh = keys.select("key").distinct().join(registry, "key", "left_anti")
    return registry.unionByName(fresh.select("key", F.array().cast("array<string>").alias("aliases")))
