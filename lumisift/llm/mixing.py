"""Mixing overlapping sources to target weights by min-cost flow.

Documents that belong to the same set of sources are interchangeable for the quotas, so Spark sums
their sizes by membership pattern. Pattern capacity is then routed to source quotas by a min-cost flow in
which the r-th use of a document costs r: nothing is repeated while a fresh document can serve. Each group of
sources that patterns link is a flow of its own, in a task of its own, a source that overlaps no other too
(over patterns and sources only, never over documents). Spark then selects documents in seeded order.
Tables by source or pattern are written and joined; Spark broadcasts them only while their files are small.

Nulls and edges: a null or empty membership is a pattern that feeds no quota and is never taken; a
null member sorts last; a null or empty text has size 0 and takes 0; an empty table gives an empty
result; repeated rows are chosen alike, as one block; equal hashes of ids go by the id; texts of any length
are counted whole; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import smallest_reachable
from .shared import materialize, table

_BINS = 1024


def word_count(text: Column) -> Column:
    """Runs of bytes outside 0x20 and 0x09-0x0D; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(sources: DataFrame) -> DataFrame:
    """sources with `position`, counted from 0 in code point order of a column source, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialize(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per partition: this table grows with their number only.
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("part", before.alias("before")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.join(parts, "part").withColumn("position", place).drop("part", "before")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, target) from (source, n), one row each: by weight a share of the total, in code point order (null last).

    What lies above `most` times a source's n is reshared by weight until none is above: targets are the
    lesser of that and weight * level, and the level rises until nothing more is capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = materialize(in_order(sources.select("source", "n")).select("source", "n", weight.alias("weight")), "mix-weights")
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("n") * F.lit(most)
        got = weighed.agg(F.sum("n").alias("n"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.sum(F.when(full, F.col("n"))).alias("taken"), F.count_if(full).alias("capped")).first()
        if got["open"] is None or got["capped"] == capped:
            break
        capped = got["capped"]
        level = float((Fraction(share) * got["n"] - Fraction(most) * (got["taken"] or 0)) / got["open"])
    cap = F.col("n") * F.lit(float(most))
    return weighed.select("source", "n", F.when(F.lit(got["open"] is None), cap).otherwise(F.least(F.col("weight") * F.lit(level), cap)).alias("target"))


def route(capacity: dict[tuple, int], quota: dict[str | None, int], epochs: int = 2) -> dict[tuple, int]:
    """Units taken from each pattern: a min-cost flow in which the r-th use of a pattern's tokens costs r.

    Every source has its quota to send to patterns that hold it. As a unit's cost depends on the pattern's level
    of use alone, the cheapest flow is found level by level: patterns open for their first use and all that can
    flow does, then for the second, and so on. Within a level paths may take over another source's units where
    that source can be served elsewhere. Paths are found in layers (breadth first, then all shortest
    ones), so a level takes few passes over the patterns, not one search for each path.
    """
    patterns = [p for p in capacity if capacity[p] > 0 and p]
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    members = [sorted({number[s] for s in p}) for p in patterns]
    feeds: list[list[int]] = [[] for _ in sources]
    for j, own in enumerate(members):
        for i in own:
            feeds[i].append(j)
    left = [int(quota.get(s, 0)) for s in sources]
    flow: list[dict[int, int]] = [dict.fromkeys(own, 0) for own in members]
    used = [0] * len(patterns)
    for level in range(1, epochs + 1):
        open_to = [level * capacity[p] for p in patterns]
        while True:
            # Layers of sources (even) and patterns (odd) from the sources with units left.
            at_source, at_pattern, reached = [-1] * len(sources), [-1] * len(patterns), False
            wave = [i for i, n in enumerate(left) if n > 0]
            for i in wave:
                at_source[i] = 0
            depth = 0
            while wave and not reached:
                hit = []
                for i in wave:
                    for j in feeds[i]:
                        if at_pattern[j] < 0:
                            at_pattern[j] = depth + 1
                            hit.append(j)
                            reached = reached or used[j] < open_to[j]
                wave = []
                for j in hit if not reached else ():
                    for i, units in flow[j].items():
                        if units > 0 and at_source[i] < 0:
                            at_source[i] = depth + 2
                            wave.append(i)
                depth += 2
            if not reached:
                break
            _push(left, used, open_to, flow, feeds, at_source, at_pattern)
    return dict(zip(patterns, used, strict=True))


def _push(left: list[int], used: list[int], open_to: list[int], flow: list[dict[int, int]], feeds: list[list[int]], at_source: list[int], at_pattern: list[int]) -> None:
    """Send units along shortest paths of the layers until none is left; every edge that fails is tried once."""
    edges = [0] * len(feeds)
    takers: list[list[int] | None] = [None] * len(used)
    for start, n in enumerate(left):
        path: list[tuple[int, int]] = []  # (source, the pattern it sends to)
        i = start
        while n > 0 and left[start] > 0:
            found = None
            while edges[i] < len(feeds[i]):
                j = feeds[i][edges[i]]
                if at_pattern[j] == at_source[i] + 1:
                    if used[j] < open_to[j]:
                        found = (j, None)
                        break
                    if takers[j] is None:
                        takers[j] = [k for k in flow[j] if at_source[k] == at_pattern[j] + 1]
                    while takers[j] and flow[j][takers[j][-1]] <= 0:
                        takers[j].pop()
                    if takers[j]:
                        found = (j, takers[j][-1])
                        break
                edges[i] += 1
            if found is None:
                if not path:
                    break
                # A dead end: the way here is not tried again.
                i, j = path.pop()
                takers[j].pop()
                continue
            j, further = found
            path.append((i, j))
            if further is not None:
                i = further
                continue
            units = min(left[start], open_to[j] - used[j], *[flow[q][k] for (_, q), (k, _) in zip(path, path[1:], strict=False)])
            for a, q in path:
                flow[q][a] += units
            for (_, q), (k, _) in zip(path, path[1:], strict=False):
                flow[q][k] -= units
            used[j] += units
            left[start] -= units
            path, i = [], start


def planned(capacity: DataFrame, quota: DataFrame, epochs: int) -> DataFrame:
    """(_pattern, base, room): how often all of a pattern (_pattern, n) is used, and how many units more, for quotas (source, quota).

    Sources that patterns link are one flow, solved in a task of its own; a source that shares no pattern is
    a flow of one pattern. A task holds its group's patterns and sources: about 1 GB for a million patterns.
    """
    # Sources are nodes by their hash; a collision would only put two groups into one flow.
    first = F.xxhash64(F.get("_pattern", F.lit(0)))
    rows = capacity.filter(F.size("_pattern") > 0).withColumn("_first", first)
    shared = rows.filter(F.size("_pattern") > 1)
    named = lambda df, node: df.withColumn("label", node)
    asked = quota.withColumn("_first", F.xxhash64("source"))
    if shared.isEmpty():
        rows, asked = named(rows, F.col("_first")), named(asked, F.col("_first"))
    else:
        labels = smallest_reachable(shared.select(F.col("_first").alias("u"), F.explode("_pattern").alias("s")).select("u", F.xxhash64("s").alias("v")))
        rows, asked = (named(df.join(labels, F.col("_first") == F.col("node"), "left"), F.coalesce("label", "_first")) for df in (rows, asked))
    flows, quotas = rows.select("label", "_pattern", "n"), asked.select("label", "source", "quota")

    def solve(flows: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
        by_name = lambda p: [(s is None, s or "") for s in p]
        capacity = {tuple(p): int(n) for p, n in zip(flows["_pattern"], flows["n"], strict=True)}
        wanted = {None if pd.isna(s) else s: int(q) for s, q in zip(quotas["source"], quotas["quota"], strict=True)}
        used = route({p: capacity[p] for p in sorted(capacity, key=by_name)}, wanted, epochs)
        return pd.DataFrame({"_pattern": [list(p) for p in capacity], "n": list(capacity.values()), "used": [used.get(p, 0) for p in capacity]})

    every = flows.groupBy("label").cogroup(quotas.groupBy("label")).applyInPandas(solve, "_pattern array<string>, n long, used long")
    every = every.unionByName(capacity.filter(F.size("_pattern") == 0).select("_pattern", "n", F.lit(0).cast("long").alias("used")))
    some = F.col("n") > 0
    return materialize(every.select("_pattern", F.when(some, F.expr("used div n")).otherwise(0).alias("base"), F.when(some, F.expr("used % n")).otherwise(0).alias("room")), "mix-plan")


def _refine(rows: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """For each pattern with room, the hash bin in which the room runs out, and the room at that bin's start: (_pattern, m1, m2, room)."""
    at = rows.join(bounds, "_pattern")
    if level == 2:
        at = at.filter(F.col("_b1") == F.col("m1"))
    bins = at.groupBy("_pattern", "m1", "room", F.col(f"_b{level}").alias("bin")).agg(F.sum("_size").alias("n"))
    w = Window.partitionBy("_pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = bins.withColumn("run", F.sum("n").over(w)).filter(F.col("run") > F.col("room"))
    edge = edge.groupBy("_pattern").agg(F.min_by(F.struct("m1", "bin", (F.col("room") - F.col("run") + F.col("n")).alias("left")), "bin").alias("x"))
    first, second = (F.col("x.bin"), F.lit(-1).cast("long")) if level == 1 else (F.col("x.m1"), F.col("x.bin"))
    return materialize(edge.select("_pattern", first.alias("m1"), second.alias("m2"), F.col("x.left").alias("room")), "mix-bounds")


def mix(docs: DataFrame, quota: DataFrame | dict[str | None, int], *, counted: DataFrame | None = None, id_col: str = "doc_id", size_col: str = "size", member_col: str = "members", epochs: int = 2, seed: int = 17) -> DataFrame:
    """The columns of docs, members sorted, and taken: size times the number of uses of the document.

    quota: units by source, as (source, quota) or a dictionary; counted: the same rows with only the
    three named columns, where those are cheaper to read again than docs.

    All documents of a pattern are used as often as the pattern's flow goes into its size; what is
    left over goes to a prefix of the documents in the order of a seeded hash. The prefix is found
    from sums by hash bin, twice refined, so that no task sorts a whole pattern.
    """
    if isinstance(quota, dict):
        quota = docs.sparkSession.createDataFrame(list(quota.items()), "source string, quota long")

    def keyed(df: DataFrame, *more: Column) -> DataFrame:
        hashed = df.select(
            *more, F.col(id_col).alias("_id"), F.array_sort(F.array_distinct(F.coalesce(F.col(member_col), F.array().cast("array<string>")))).alias("_pattern"),
            F.col(size_col).cast("long").alias("_size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"))
        return hashed.withColumns({"_b1": F.pmod(F.shiftrightunsigned("_h", 10), F.lit(_BINS)), "_b2": F.pmod(F.shiftrightunsigned("_h", 30), F.lit(_BINS))})

    rows = keyed(counted if counted is not None else docs)
    capacity = materialize(rows.groupBy("_pattern").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")), "mix-capacity")
    plan = planned(capacity, quota, epochs)
    bounds = plan.filter("room > 0").select("_pattern", F.lit(-1).cast("long").alias("m1"), F.lit(-1).cast("long").alias("m2"), "room")
    for level in (1, 2):
        bounds = _refine(rows, bounds, level)
    marks = materialize(plan.select("_pattern", "base").join(bounds, "_pattern", "left").select("_pattern", "base", F.coalesce("m1", F.lit(-1)).alias("m1"), F.coalesce("m2", F.lit(-1)).alias("m2"), F.coalesce("room", F.lit(0)).alias("room")), "mix-marks")
    before = (F.col("_b1") < F.col("m1")) | ((F.col("_b1") == F.col("m1")) & (F.col("_b2") < F.col("m2")))
    edge = (F.col("_b1") == F.col("m1")) & (F.col("_b2") == F.col("m2"))
    # The last bin holds a millionth of a pattern; whole groups of equal ids are taken while they end nearer to the room left than they began.
    last = Window.partitionBy("_pattern").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.join(marks, "_pattern").filter(edge).groupBy("_pattern", "_h", "_id", "room").agg(F.sum("_size").alias("_n"))
    inside = inside.withColumn("_run", F.sum("_n").over(last)).filter(F.col("_run") - F.col("_n") / 2 <= F.col("room"))
    inside = materialize(inside.select(F.col("_pattern").alias("_p"), F.col("_h").alias("_g"), F.col("_id").alias("_i")), "mix-inside")
    same = (F.col("_pattern") == F.col("_p")) & (F.col("_h") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_i"))
    once = F.when(before | F.col("_p").isNotNull(), 1).otherwise(0)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    picked = keyed(docs, whole).join(marks, "_pattern").join(inside, same, "left")
    named = [F.col("_pattern").alias(c) if c == member_col else F.col("_size").alias(c) if c == size_col else F.col("_row")[c].alias(c) for c in docs.columns if c != "taken"]
    return picked.select(*named, (F.col("_size") * (F.col("base") + once)).alias("taken"))


def mix_documents(docs: DataFrame, *, keep: list[str] | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """Mix documents of one source each: the columns of docs (or those of `keep`), then size, source_size, target and taken.

    A document of null source belongs to the source null, which comes last. Columns named like the four are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    size, members = word_count(F.col("text")).alias("size"), F.array("source").alias("members")
    counted = materialize(docs.select("doc_id", "source", size, members), "mix-sizes")
    per = materialize(counted.groupBy("source").agg(F.sum("size").alias("n")), "mix-sources")
    facts = materialize(source_targets(per, weights, share, float(epochs)).select(F.col("source").alias("_source"), F.col("n").alias("source_size"), "target"), "mix-targets")
    quota = facts.select(F.col("_source").alias("source"), F.round("target").cast("long").alias("quota"))
    if set(keep) <= {"doc_id", "source"}:
        rows = counted.select(F.struct(*keep).alias("kept"), "doc_id", "source", "size", "members")
    else:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "doc_id", "source", size, members)
    mixed = mix(rows, quota, counted=counted.select("doc_id", "size", "members"), epochs=epochs, seed=seed)
    out = mixed.join(facts, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], *made)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken", "source")
