"""Ordered greedy linking of clusters by similar names, without pairs of records and without one task for a whole group.

In order of (surname's first record, earlier record, later record), two clusters whose names are similar become one unless
both hold an e-mail or both hold a phone. A guard only grows, so a pair once refused stays so, and of the pairs of two
clusters under two names only the first counts: a unit is a cluster under a name, at its first record there.

Units of one name and one guard are a class, in order. All of a class may link with all of a class of a similar name (or
of its own) whose guard has no bit in common, so a class offers its first units and nothing else has to be paired:

* A cluster without a guard bit takes its first open partner: nothing that comes earlier can touch it, and it changes no
  guard. All of them do so in one round, as in Borůvka's algorithm for spanning forests, so their number halves at least.
* Two clusters with guards link when each is the other's first open partner.
* Then the classes of these two, one with e-mails and one with phones, go on in step: their k-th units are each other's
  first partner once the earlier ones are gone, as long as no other class offers an earlier unit to either and the units
  are their cluster's only ones. These are linked at once, by rank.

Groups that names tie are packed into buckets of `BUCKET_UNITS`; a bucket is linked in one task by the same classes, with
heaps. Larger groups go through rounds of joins until what is still open fits in a bucket. How many rounds that takes is
bounded by the logarithm of the number of clusters without guards, and beyond that by the longest chain of classes in which
e-mails and phones alternate and each waits for the one before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import written
from .components import components

#: Units that one task links, at most but for one hash bucket's unevenness.
BUCKET_UNITS = 50_000
#: Guard bits.
EMAIL, PHONE = 1, 2
_PLACE_BITS = 33
_MERGED = "root long, cluster_id long"


def link_in_order(units: list[tuple[int, int, int, int, int]], similar: dict[int, list[int]]) -> dict[int, int]:
    """The least root of each root's cluster. units: root, name, block (of the name's surname), ord, guard; similar: the names like each name, itself included."""
    parent: dict[int, int] = {}
    guard: dict[int, int] = {}
    first: dict[int, dict[int, int]] = defaultdict(dict)  # of each root, its first record under each name
    block_of: dict[int, int] = {}
    queue: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # (name, guard) -> heap of (ord, root)
    for root, name, block, ord_, g in units:
        parent[root], guard[root], block_of[name] = root, g, block
        first[root][name] = min(ord_, first[root].get(name, ord_))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def head(k: tuple[int, int], but: int | None = None) -> tuple[int, int] | None:
        """ord and root of the first unit of a class, or of the first of another cluster."""
        q, held = queue[k], None
        while q:
            root = find(q[0][1])
            if guard[root] != k[1] or first[root].get(k[0]) != q[0][0]:
                heapq.heappop(q)  # moved to another class, or no longer its cluster's first
            elif root == but:
                held = heapq.heappop(q)  # one valid entry for a cluster, or equal ones
            else:
                break
        found = (q[0][0], find(q[0][1])) if q else None
        if held:
            heapq.heappush(q, held)
        return found

    def pair(k: tuple[int, int], m: tuple[int, int]) -> tuple[int, int, int, int, int] | None:
        """The first pair of two classes: block, earlier and later record, and the roots."""
        a, b = head(k), head(m)
        if not a or not b:
            return None
        if a[1] != b[1]:
            tries = [(a, b)]
        else:  # one cluster under both names: with the next of either
            tries = [(a, head(m, a[1])), (head(k, a[1]), b)]
        found = [(block_of[k[0]], min(x[0], y[0]), max(x[0], y[0]), x[1], y[1]) for x, y in tries if x and y]
        return min(found) if found else None

    heap: list[tuple] = []
    least: dict[tuple, tuple] = {}  # of each pair of classes, the entry in the heap that counts: no later than its first pair

    def offer(k: tuple[int, int], m: tuple[int, int]) -> None:
        k, m = min(k, m), max(k, m)
        if (p := pair(k, m)) and ((k, m) not in least or p[:3] < least[k, m]):
            least[k, m] = p[:3]
            heapq.heappush(heap, (p[:3], k, m))

    for root, names in first.items():
        for name, ord_ in names.items():
            queue[name, guard[root]].append((ord_, root))
    for q in queue.values():
        heapq.heapify(q)
    for k in list(queue):
        for name in similar.get(k[0], ()):
            for g in range(4):
                if not g & k[1] and k <= (name, g) and (name, g) in queue:
                    offer(k, (name, g))
    while heap:
        order, k, m = heapq.heappop(heap)
        if least.get((k, m)) != order:
            continue
        del least[k, m]
        p = pair(k, m)
        if p and p[:3] == order:
            x, y = min(p[3:]), max(p[3:])
            before, g = (guard[x], guard[y]), guard[x] | guard[y]
            moved = {n: o for r, old in ((x, before[0]), (y, before[1])) if old != g for n, o in first[r].items()}
            parent[y], guard[x] = x, g
            small, large = sorted((first.pop(x), first.pop(y)), key=len)
            for n, o in small.items():
                large[n] = min(o, large.get(n, o))
            first[x] = large
            for n in moved:
                heapq.heappush(queue[n, g], (large[n], x))  # perhaps once more
                for other in similar.get(n, ()):
                    for h in range(4):
                        if not g & h:
                            offer((n, g), (other, h))
        offer(k, m)
    return {r: find(r) for r in parent}


def _bucket(units: pd.DataFrame, similar: pd.DataFrame) -> pd.DataFrame:
    like: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(similar["name_a"].tolist(), similar["name_b"].tolist(), strict=True):
        like[a].append(b)
    rows = list(zip(*(units[c].tolist() for c in ("root", "name", "block", "ord", "guard")), strict=True))
    found = link_in_order(rows, like)
    return pd.DataFrame({"root": list(found), "cluster_id": list(found.values())}, dtype="int64")


def _in_tasks(units: DataFrame, similar: DataFrame, n: int) -> DataFrame:
    """root and cluster_id of units with a group (grp), and similar names with theirs."""
    bucket = F.pmod(F.xxhash64("grp"), F.lit(max(1, -(-n // BUCKET_UNITS)))).alias("bucket")
    a = units.select(bucket, "root", "name", "block", "ord", "guard").groupBy("bucket")
    b = similar.select(bucket, "name_a", "name_b").groupBy("bucket")
    return a.cogroup(b).applyInPandas(lambda u, s: _bucket(u, s), _MERGED)


def places(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows with place: 0, 1, 2 ... in each group, by a range partition, so that a group of any size spreads over tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    at = F.monotonically_increasing_id()
    ordered = written(rows.repartitionByRange(parts, *by, order).sortWithinPartitions(*by, order).withColumn("_at", at), "places")
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = ordered.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = ordered.withColumn("_part", part).join(sizes, [*by, "_part"])
    return joined.select(*(F.col(c) for c in rows.columns), (F.col("_start") + F.col("_at") - F.col("_first")).alias("place"))


def _offers(units: DataFrame, similar: DataFrame) -> DataFrame:
    """name, guard and offers: of each class that may link with them, and of similar names, the first two units in order."""
    rank = F.row_number().over(Window.partitionBy("name", "guard").orderBy("ord"))
    heads = units.withColumn("k", rank).filter("k <= 2").select(F.col("name").alias("name_b"), F.struct("ord", "root", F.col("name").alias("name"), "guard").alias("o"))
    mine = F.explode(F.array(*(F.lit(g) for g in range(4))))
    to = similar.select("name_a", "name_b").join(heads, "name_b").select(F.col("name_a").alias("name"), mine.alias("guard"), "o")
    return to.filter(F.col("guard").bitwiseAND(F.col("o.guard")) == 0).groupBy("name", "guard").agg(F.array_sort(F.collect_list("o")).alias("offers"))


def _other_class(o: Column, name: Column, guard: Column) -> Column:
    return (o["name"] != name) | (o["guard"] != guard)


def _round(units: DataFrame, similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """root and cluster_id of the clusters that a round links, and the units of those that have an open partner."""
    offers = written(_offers(units, similar), "offers")
    open_ = units.join(offers, ["name", "guard"]).withColumn("o", F.try_element_at(F.filter("offers", lambda o: o["root"] != F.col("root")), F.lit(1))).filter("o IS NOT NULL")
    lo, hi = F.least("ord", "o.ord"), F.greatest("ord", "o.ord")
    best = F.struct("block", lo.alias("lo"), hi.alias("hi"), F.col("o.root").alias("to"), "name", F.col("o.name").alias("other"))
    wish = written(open_.groupBy("root", "guard").agg(F.min(best).alias("w"), F.count(F.lit(1)).alias("names")), "wishes")
    taken = wish.filter("guard = 0").select(F.col("root").alias("a"), F.col("w.to").alias("b"))
    held = wish.filter("guard <> 0")
    back = held.select(F.col("root").alias("to"), F.col("w.to").alias("root"), F.col("w").alias("v"))
    mutual = held.withColumn("to", F.col("w.to")).join(back, ["to", "root"]).filter("w.lo = v.lo AND w.hi = v.hi")
    taken = taken.unionByName(mutual.filter("root < to").select(F.col("root").alias("a"), F.col("to").alias("b")))
    # classes whose first units are each other's first partner, from the side with e-mails
    lead = mutual.filter(F.col("guard") == EMAIL).select(F.col("w.name").alias("k"), F.col("w.other").alias("m"))
    lead = written(lead.withColumn("pair", F.monotonically_increasing_id()), "leading-classes")
    if not lead.isEmpty():
        taken = taken.unionByName(_in_step(units, wish, lead, offers))
    taken = written(taken, "links")
    merged = components(taken.select("a", "b")).select(F.col("node").alias("root"), F.col("component").alias("cluster_id"))
    # clusters without a wish, and that no wish took, are done: a guard only grows, so they will not have a partner later
    return merged, units.join(wish.select("root"), "root", "left_semi")


def _in_step(units: DataFrame, wish: DataFrame, lead: DataFrame, offers: DataFrame) -> DataFrame:
    """Pairs a, b of the k-th units of two leading classes."""
    sides = []
    for mine, its, g in (("k", "m", EMAIL), ("m", "k", PHONE)):
        of = offers.filter(F.col("guard") == g).select(F.col("name").alias(mine), "offers")
        rival = F.try_element_at(F.filter("offers", lambda o: _other_class(o, F.col(its), F.lit(EMAIL + PHONE - g))), F.lit(1))["ord"]
        sides.append(lead.join(of, mine).select("pair", F.col(mine).alias("name"), F.lit(g).alias("guard"), rival.alias("rival")))
    # a class's units stay before what a rival offers the other class
    limits = sides[0].join(sides[1].select("pair", F.col("rival").alias("its")), "pair").select("pair", "name", "guard", "its")
    limits = limits.unionByName(sides[1].join(sides[0].select("pair", F.col("rival").alias("its")), "pair").select("pair", "name", "guard", "its"))
    rows = units.join(wish.select("root", "names"), "root").join(limits, ["name", "guard"]).filter("its IS NULL OR ord < its")
    several = rows.filter("names > 1").groupBy("pair", "guard").agg(F.min("ord").alias("stop"))
    rows = rows.join(several, ["pair", "guard"], "left").filter("stop IS NULL OR ord < stop").select("pair", "guard", "root", "ord")
    ranked = written(places(rows, ["pair", "guard"], "ord"), "ranked")
    a, b = (ranked.filter(F.col("guard") == g).select("pair", "place", F.col("root").alias(side)) for g, side in ((EMAIL, "a"), (PHONE, "b")))
    return a.join(b, ["pair", "place"]).select("a", "b")


def name_ties(units: DataFrame, similar: DataFrame) -> DataFrame:
    """Edges a, b of names that are alike or that one root has: a root of one name, as most are, ties nothing."""
    several = units.groupBy("root").agg(F.min("name").alias("a"), F.max("name").alias("last")).filter("a <> last").select("root", "a")
    of_roots = units.join(several, "root").select("a", F.col("name").alias("b")).filter("a <> b")
    return of_roots.unionByName(similar.filter("name_a < name_b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))


def link(units: DataFrame, similar: DataFrame) -> DataFrame:
    """root and cluster_id (the least root of the cluster) of the units' roots that are linked, and of some that are not.

    units: root, name (a number), block, ord, guard, one row for each root and name; similar: name_a and name_b, both ways
    and each name with itself, of names of one block.
    """
    n = units.count()
    if n <= BUCKET_UNITS:
        return _in_tasks(units.withColumn("grp", F.lit(0)), similar.withColumn("grp", F.lit(0)), n)
    groups = written(components(name_ties(units, similar)).select("node", F.col("component").alias("grp")), "name-groups")
    of = lambda c: F.coalesce(F.col("grp"), F.col(c)).alias("grp")
    units = written(units.join(groups.withColumnRenamed("node", "name"), "name", "left").select(*units.columns, of("name")), "grouped-units")
    similar = written(similar.join(groups.withColumnRenamed("node", "name_a"), "name_a", "left").select("name_a", "name_b", of("name_a")), "grouped-names")
    sizes = units.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") > BUCKET_UNITS)
    sizes = written(sizes, "group-sizes")
    total = {r["large"]: r["n"] for r in sizes.groupBy("large").agg(F.sum("n").alias("n")).collect()}
    if not total.get(True):
        return _in_tasks(units, similar, total.get(False, 0))
    small, large = sizes.filter("NOT large").select("grp"), sizes.filter("large").select("grp")
    done = _in_tasks(units.join(small, "grp", "left_semi"), similar.join(small, "grp", "left_semi"), total.get(False, 0))
    return done.unionByName(_in_rounds(units.join(large, "grp", "left_semi"), similar.join(large, "grp", "left_semi")))


def _in_rounds(units: DataFrame, similar: DataFrame) -> DataFrame:
    start = units = written(units, "open-units")
    grp = units.select("name", "grp").distinct()
    label = start.select("root", F.col("root").alias("cluster_id")).distinct()
    while True:
        n = units.count()
        if n <= BUCKET_UNITS:
            break
        merged, open_ = _round(units, similar)
        merged = written(merged, "merged")
        label = written(_relabelled(label, merged), "labels")
        moved = open_.join(merged, "root", "left").withColumn("root", F.coalesce("cluster_id", "root")).drop("cluster_id")
        whole = moved.groupBy("root").agg(F.bit_or("guard").alias("guard"))
        units = written(moved.groupBy("root", "name", "block").agg(F.min("ord").alias("ord")).join(whole, "root"), "open-units")
    if n:
        last = _in_tasks(units.join(grp, "name").withColumn("grp", F.lit(0)), similar.withColumn("grp", F.lit(0)), n)
        label = _relabelled(label, written(last, "merged"))
    return label


def _relabelled(label: DataFrame, merged: DataFrame) -> DataFrame:
    to = merged.select(F.col("root").alias("cluster_id"), F.col("cluster_id").alias("to"))
    return label.join(to, "cluster_id", "left").select("root", F.coalesce("to", "cluster_id").alias("cluster_id"))
