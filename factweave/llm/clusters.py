"""Connected groups of near-alike items from hash buckets, without listing all pairs of a bucket.

Items meet in buckets (one item in many). Candidates come in three rounds, each followed by verification
and by connected components, and each only between items that are not connected yet:

1. every item with the one bucket leader whose sketch is nearest to its own;
2. every item with the leaders of all its buckets (at once with the first, if items are in few buckets);
3. what is left: all pairs of a bucket that span two groups and whose sketches are near enough, each in the least
   bucket that both are in. With `within`, a bucket's items come to one place with what is needed to compare them, so
   that pairs are neither listed nor sent about, and items that an earlier pair has connected are compared no more. What belongs to
   an item is joined to it once, before it is dealt to its buckets.

Two items that share a bucket and pass `near` are compared, or are already connected by verified links;
so the groups are those of the full graph of such links, while large groups of copies fall together in
the first rounds and need no comparison of all with all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import discard, join_sized, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the group, for every id in edges (a, b).

    Alternates linking each node's larger neighbours to its least one and each node's smaller neighbours
    to its least one, until nothing changes; every round is written to the shared folder. A node with many
    neighbours is never gathered in one row: both steps are a minimum by key and a join.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        below = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(below, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")).select("e.a", "e.b")
        old, edges = edges, materialize(small.where("a < b").distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


#: Pairs of one bucket that are looked at side by side.
PAIRS = 1 << 16


def _bucket_links(ids: np.ndarray, root: np.ndarray, lead: int, key: int, keys: pa.ListArray, near: Callable, verify: Callable) -> list[tuple[int, int]]:
    """The links of one bucket's items between different groups; near(i, j) and verify(i, j) judge pairs of places."""
    _, group = np.unique(root, return_inverse=True)
    use = np.flatnonzero(ids != lead)
    use = use[np.argsort(group[use], kind="stable")]
    ends = np.searchsorted(group[use], group[use], side="right")  # where the next group begins
    links, known = [], {}

    def shared(at: int) -> set[int]:
        if at not in known:
            known[at] = set(keys[at].as_py())
        return known[at]

    def settle(x: np.ndarray, y: np.ndarray) -> None:
        """Compares these pairs, few at first, as each link may spare others."""
        nonlocal group
        step = 64
        while len(x):
            good = verify(x[:step], y[:step])
            for a, b in zip(x[:step][good].tolist(), y[:step][good].tolist()):
                links.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
                if group[a] != group[b]:
                    group[group == group[b]] = group[a]
            x, y = x[step:], y[step:]
            open_ = group[x] != group[y]
            x, y, step = x[open_], y[open_], min(2 * step, 4096)

    low, n = 0, len(use)
    while low < n:
        rows = max(1, PAIRS // n)
        block = np.arange(low, min(n, low + rows))
        low += rows
        many = n - ends[block]
        x = np.repeat(block, many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[block], many)
        x, y = use[x], use[y]
        for part in range(0, len(x), PAIRS):
            i, j = x[part : part + PAIRS], y[part : part + PAIRS]
            open_ = group[i] != group[j]
            i, j = i[open_], j[open_]
            if len(i):
                open_ = near(i, j)
                i, j = i[open_], j[open_]
            if len(i):
                open_ = np.fromiter((min(shared(a) & shared(b)) == key for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
                settle(i[open_], j[open_])
    return links


def linked_within(judges: Callable[[pa.RecordBatch], tuple[Callable, Callable]]) -> Callable:
    """A function for mapInArrow over members (key, id, root, lead, keys and more), sorted by key: the links (a, b) of
    every bucket. judges(members of one bucket) makes near(i, j) and verify(i, j) over arrays of places."""

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def done():
            rows = pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]
            ids, root = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            if len(ids) < 2:
                return []
            return _bucket_links(ids, root, rows.column(3)[0].as_py(), rows.column(0)[0].as_py(), rows.column(4), *judges(rows))

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if waiting and waiting[0].column(0)[0].as_py() != key[a]:
                    found += done()
                    waiting = []
                waiting.append(batch.slice(a, b - a))
            yield _edges(found)
        if waiting:
            yield _edges(done())

    return run


def by_bucket(members: DataFrame) -> DataFrame:
    """A row for every bucket of members (id, root, places and more), as linked_within reads them."""
    rest = [c for c in members.columns if c not in ("id", "root", "places")]
    rows = members.select(F.explode("places").alias("at"), "id", "root", F.col("places.key").alias("keys"), *rest)
    return rows.select("at.key", "id", "root", "at.lead", "keys", *rest).repartition("key").sortWithinPartitions("key")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def clusters(
    buckets: DataFrame,
    sketches: DataFrame,
    distance: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    near: int,
    verify: Callable[[DataFrame], DataFrame],
    prepare: Callable[[DataFrame], None] | None = None,
    nearest: bool = True,
    within: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(groups (id, root), links (a, b)) of the items in buckets (key, id); a row may stand there more than once.

    sketches (id, columns) is of a materialized table of all items; those of items that share a bucket are kept.
    distance(x, y) is the column that compares two sketches, x("s") being an item's sketch column s; pairs over near
    are no candidates. verify(pairs (a, b)) keeps the pairs that are truly alike; before its first call, prepare gets all ids (id) that
    may come in pairs. Without nearest the first two rounds are one. within(members (id, root, places: its
    buckets (key, lead) in order, sketch columns as id_s), a row for each item) gives the links of the third round, as linked_within does. (None, None) if no two items are.
    """
    sketch = [c for c in sketches.columns if c != "id"]
    width = 24 + 8 * len(sketch)

    def sketched(df: DataFrame, column: str) -> DataFrame:
        """df with the sketch of the item in column, as {column}_{sketch column}."""
        return join_sized(df, sketches.select(F.col("id").alias(column), *[F.col(c).alias(f"{column}_{c}") for c in sketch]), column, "inner", width)

    def far(x: str, y: str) -> Column:
        return distance(lambda c: F.col(f"{x}_{c}"), lambda c: F.col(f"{y}_{c}"))

    w = Window.partitionBy("key")
    shared = buckets.withColumn("lo", F.min("id").over(w)).withColumn("hi", F.max("id").over(w)).where("lo <> hi")
    shared = materialize(shared.select("key", "id").distinct(), "shared")
    lead = F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id")).over(w)
    met = buckets = materialize(shared.withColumn("n", F.count("*").over(w)).withColumn("lead", lead).select("key", "id", "n", F.col("lead.id").alias("lead")), "buckets")
    # Most items meet no other: the sketches of those that do are joined several times, those of all only once.
    some = materialize(shared.select("id").distinct(), "meeting")
    sketches = materialize(join_sized(sketches, some, "id", "left_semi", 16), "sketches")
    discard(shared, some)
    bare = materialize(met.where("id <> lead").select("id", "lead").distinct(), "star-pairs")
    star = materialize(sketched(sketched(bare, "id"), "lead").select("id", "lead", far("id", "lead").alias("far")).where(F.col("far") <= near), "star")
    # The pair of a bucket of two is a pair with the leader.
    met = met.where("n > 2")
    if prepare is not None:
        prepare(materialize(star.select("id").unionByName(star.select(F.col("lead").alias("id"))).unionByName(met.select("id")).distinct(), "to-compare"))
    first = star.groupBy("id").agg(F.min(F.struct("far", "lead")).alias("l")).select("id", F.col("l.lead").alias("lead"))

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    def apart(df: DataFrame, groups: DataFrame | None, x: str, y: str) -> DataFrame:
        """df's pairs between different groups."""
        if groups is None:
            return df
        for col in (x, y):
            df = join_sized(df, groups.select(F.col("id").alias(col), F.col("root").alias(f"{col}_root")), col, "left", 16)
        return df.where(F.coalesce(f"{x}_root", x) != F.coalesce(f"{y}_root", y))

    links, groups = None, None

    def add(cand: DataFrame, name: str) -> None:
        cand = materialize(cand, f"{name}-pairs")
        found = materialize(verify(cand).select("a", "b"), f"{name}-links")
        discard(cand)
        grow(found)

    def grow(found: DataFrame) -> None:
        nonlocal links, groups
        if found.isEmpty():
            return
        links = found if links is None else links.unionByName(found)
        base = found if groups is None else found.unionByName(groups.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
        old, groups = groups, materialize(components(base), "groups")
        discard(old)

    if nearest:
        add(pairs(first, "id", "lead"), "nearest")
        rest = star.join(first, ["id", "lead"], "left_anti")
        add(pairs(apart(rest, groups, "id", "lead"), "id", "lead"), "leaders")
    else:
        add(pairs(star, "id", "lead"), "leaders")

    # A bucket all of one group is done; so is a pair with the leader, which was compared above.
    own = met
    if groups is not None:
        own = join_sized(own, groups, "id", "left", 16).withColumn("root", F.coalesce("root", "id"))
    else:
        own = own.withColumn("root", F.col("id"))
    spread = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    own = materialize(own.join(spread, "key", "left_semi"), "spread-ids")
    held = own.groupBy("id").agg(F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("key", "lead"))).alias("places"))
    held = materialize(sketched(held, "id"), "held")
    if within is not None:
        grow(materialize(within(held).distinct(), "rest-links"))
    else:
        paired = by_bucket(held)
        x, y = (paired.select("key", *[F.col(c).alias(f"{p}_{c.removeprefix('id_')}") for c in paired.columns if c != "key"]) for p in ("x", "y"))
        met_here = F.array_min(F.array_intersect("x_keys", "y_keys")) == x["key"]
        cross = x.join(y, (x["key"] == y["key"]) & (F.col("x_id") < F.col("y_id")) & (F.col("x_root") != F.col("y_root")) & (F.col("x_id") != F.col("x_lead")) & (F.col("y_id") != F.col("y_lead")) & (far("x", "y") <= near) & met_here)
        add(cross.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), "rest")
    discard(bare, star, buckets, own, held, sketches)
    return groups, links
