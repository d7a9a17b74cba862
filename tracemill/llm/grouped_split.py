"""Splits that keep related records together.

Records are linked when they share a key (a source, a question, an author). The links are closed
transitively by a distributed union-find: every task reduces its own links to a local forest, the
forests are merged round by round, and whole groups are then handed, largest first, to the split that
is furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

#: Edges that one merging task may hold (about 200 bytes each in Python): the bound of the last round.
MERGE_EDGES = 1_000_000


def clean_key(c: Column) -> Column:
    """Keys are compared trimmed and in lower case; blank ones are null."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def local_forest(pairs: Iterator[tuple[str, str]]) -> dict[str, str]:
    """The forest of some links: each node with the smallest node of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: find(x) for x in list(parent)}


def _forest_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = local_forest((a, b) for pdf in batches for a, b in zip(pdf["u"], pdf["v"]))
    rows = [(x, r) for x, r in forest.items() if x != r]
    for i in range(0, len(rows), 50_000):
        yield pd.DataFrame(rows[i : i + 50_000], columns=["u", "v"])


def merge_forests(edges: DataFrame, merge_edges: int = MERGE_EDGES) -> DataFrame:
    """(u, v) links to (u, v) stars: every node that isn't the smallest of its group, with the smallest.

    While more than ``merge_edges`` links are left, a round moves every link to the smaller ends
    (large star, then small star: the count of rounds is logarithmic, no group is gathered anywhere) and
    the tasks reduce what they got to forests again. At or below the bound, one task merges the rest.
    """
    edges = cut_lineage(edges.select("u", "v").distinct())
    while (count := edges.count()) > merge_edges:
        before = count, edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").where("v != m").union(low.select("u", "m")).toDF("u", "v").where("u != v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = cut_lineage(small)
        if before == (edges.count(), edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]):
            return edges
    return edges.coalesce(1).mapInPandas(_forest_task, "u string, v string")


def linked_sources(rows: DataFrame, member: str = "source_id", hub: str = "question_id", merge_edges: int = MERGE_EDGES) -> DataFrame:
    """(first, other): the smallest member of each group of at least two, with each other one.

    Members belong together if rows of both carry the same hub, directly or through further members. Keys
    are compared and returned trimmed and in lower case; a null or blank key links nothing; repeated rows
    change nothing; an empty table gives no rows; other columns of ``rows`` are ignored.
    """
    pairs = rows.select(clean_key(F.col(member)).alias("member"), clean_key(F.col(hub)).alias("hub"))
    # hubs of one member link nothing; the ends of the others come from partial aggregates, so that a hub
    # of a third of all rows is one row here, and the join below may split its pairs
    pairs = pairs.where("member is not null and hub is not null").distinct()
    ends = pairs.groupBy("hub").agg(F.min("member").alias("v"), F.max("member").alias("high")).where("v < high")
    stars = pairs.join(ends, "hub").where("member > v").select(F.col("member").alias("u"), "v")
    stars = stars.mapInPandas(_forest_task, "u string, v string")
    merged = merge_forests(stars, merge_edges)
    return merged.select(F.col("v").alias("first"), F.col("u").alias("other"))


def _deal(sizes: list[tuple[int, int]], shares: Sequence[float]) -> list[tuple[int, int, list[int]]]:
    """For (size, number of groups), largest first: how many groups of it each split gets when each group
    goes to the split furthest below its target. Long runs of one size are dealt in blocks: the split
    with the largest lack takes groups until another one lacks more."""
    total = sum(s * n for s, n in sizes)
    lack = [share * total for share in shares]
    out = []
    for size, n in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        while n:
            best = max(range(len(lack)), key=lambda i: (lack[i], -i))
            rest = max((x for i, x in enumerate(lack) if i != best), default=lack[best])
            take = min(n, max(1, int((lack[best] - rest) // size)))
            got[best] += take
            lack[best] -= take * size
            n -= take
            if n > 4 * len(shares) and max(lack) - min(lack) <= size:  # level: the rest goes round
                each = n // len(shares)
                got = [g + each for g in got]
                lack = [x - each * size for x in lack]
                n -= each * len(shares)
        out.append((size, sum(got), got))
    return out


def assign_splits(
    rows: DataFrame,
    proportions: dict[str, float] | None = None,
    member: str = "source_id",
    hub: str = "question_id",
    merge_edges: int = MERGE_EDGES,
) -> DataFrame:
    """(member, group, rows, split) of every member: all members of a group land in the same split.

    Groups go, largest first, to the split furthest below its share of the rows; equal groups are told
    apart by a hash of their first member, so the result is the same in every run. The driver sees only
    the histogram of group sizes (at most the square root of twice the rows different sizes). Null and
    blank members are in no group and have no row here; an empty table gives none.
    """
    names, shares = zip(*(proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}).items())
    own = rows.select(clean_key(F.col(member)).alias("member")).where("member is not null").groupBy("member").agg(F.count("*").alias("rows"))
    links = linked_sources(rows, member, hub, merge_edges).select(F.col("other").alias("member"), F.col("first").alias("g"))
    members = cut_lineage(own.join(links, "member", "left").select("member", "rows", F.coalesce("g", "member").alias("group")))
    groups = members.groupBy("group").agg(F.sum("rows").alias("size"))
    groups = groups.withColumn("slot", F.pmod(F.xxhash64("group"), F.lit(4096)))
    # ranks inside a size, without a window over a whole size: slots are counted, then ranked inside
    slots = groups.groupBy("size", "slot").agg(F.count("*").alias("n"))
    w = Window.partitionBy("size").orderBy("slot")
    slots = slots.withColumn("skip", F.sum("n").over(w) - F.col("n"))
    sizes = [(r["size"], r["n"]) for r in slots.groupBy("size").agg(F.sum("n").alias("n")).collect()]
    quota = [(s, *[sum(g[: i + 1]) for i in range(len(names))]) for s, _, g in _deal(sizes, shares)]
    spark = rows.sparkSession
    ends = spark.createDataFrame(quota, "size long, " + ", ".join(f"e{i} long" for i in range(len(names))))
    ranked = groups.join(slots.select("size", "slot", "skip"), ["size", "slot"]).withColumn(
        "rank", F.col("skip") + F.row_number().over(Window.partitionBy("size", "slot").orderBy(F.xxhash64("group"), "group"))
    )
    split = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        split = F.when(F.col("rank") <= F.col(f"e{i}"), names[i]).otherwise(split)
    dealt = ranked.join(ends, "size").select("group", split.alias("split"))
    return members.join(dealt, "group").select("member", "group", "rows", "split")
