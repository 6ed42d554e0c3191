"""Which records are the same person: exact keys first, then guarded fuzzy names within surnames.

Exact keys are a bipartite graph of records and keys, reduced to one edge a record and key (to the key's first record),
and resolved by distributed components. Similar names are found once for each surname, among its distinct names; which
clusters they link, in order and under the guard, is told by `linking` from the clusters of each name, not from pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import surname_key, token_sort_ratio, words
from ..model import FusionConfig
from ..plans.storage import written
from . import linking
from .components import components


def exact_keys(values: DataFrame) -> DataFrame:
    """record_ord and key of every value that identifies: e-mails, phones, and GitHub and LinkedIn addresses, none malformed."""
    good = values.filter(~F.col("malformed"))
    link = F.col("v_link")
    key = F.when(F.col("field").isin("emails", "phones"), F.concat(F.substring("field", 1, 1), F.lit(":"), F.col("v_str"))).when((F.col("field") == "links") & link["kind"].isin("github", "linkedin"), F.concat(link["kind"], F.lit(":"), link["url"]))
    return good.select("record_ord", key.alias("key")).filter("key IS NOT NULL").distinct()


def key_edges(keyed: DataFrame) -> DataFrame:
    """a (the key's least record) and b (each other record that has the key), from record_ord and key."""
    first = keyed.groupBy("key").agg(F.min("record_ord").alias("a"), F.max("record_ord").alias("last")).filter("a <> last")
    return keyed.join(first.select("key", "a"), "key").select("a", F.col("record_ord").alias("b")).filter("a <> b")


def exact_components(keyed: DataFrame) -> DataFrame:
    """record_ord and root (the least record_ord reachable) of the records that share a key (record_ord, key)."""
    return components(key_edges(keyed)).select(F.col("node").alias("record_ord"), F.col("component").alias("root"))


#: Letters of a q-gram of names.
Q = 2


def _prefix_grams(names: DataFrame, threshold: float) -> DataFrame:
    """names with gram: those q-grams of the sorted words, rarest of the surname first, of which two names that reach the similarity share one.

    With d letters put in or left out between them, names of l letters or more share all but q d of their q-grams (each
    numbered by its occurrence, ends marked), so one of the first q d + 1; d follows from the lengths that the threshold allows.
    """
    text = F.concat(F.lit("^"), F.array_join(F.array_sort(words(F.col("name"))), " "), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - Q + 1), lambda i: F.col("text").substr(i, F.lit(Q)))
    numbered = F.transform(F.col("grams"), lambda g, i: F.concat(g, F.size(F.filter(F.slice("grams", F.lit(1), i), lambda h: h == g)).cast("string")))
    each = names.withColumn("text", text).withColumn("grams", grams).select("*", F.explode(numbered).alias("gram")).drop("grams")
    often = each.groupBy("surname", "gram").agg(F.count(F.lit(1)).alias("often"))
    n = F.length("text") - 2  # letters of the name, and of the longest that the threshold allows beside it
    longest = F.floor(n * (200 - threshold) / threshold)
    wanted = (Q * F.floor((n + longest) * (1 - threshold / 100) + 1e-9) + 1).cast("int")
    key = [c for c in names.columns]
    ranked = each.join(often, ["surname", "gram"]).groupBy(*key, "text").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("g"))
    # a gram of one name meets nothing
    return ranked.select(*key, F.explode(F.slice("g", F.lit(1), wanted)).alias("g")).filter("g.often > 1").select(*key, F.col("g.gram").alias("gram"))


#: Surnames of up to so many names have all their pairs compared, at most half as many a name.
FEW_NAMES = 8
#: Pairs of names that one task compares.
TASK_PAIRS = 10_000


def similar_names(distinct: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different names (surname, name_a < name_b) of one surname that reach the similarity, of a table of distinct names.

    Names of a surname that has few meet each other; others meet by the rarest of their q-grams. A pair is compared once.
    """
    sizes = distinct.groupBy("surname").agg(F.count(F.lit(1)).alias("names"))
    # written: what is compared is decided by a join of few names or of many grams, and the comparison must stay behind distinct()
    sized = written(distinct.join(sizes.filter("names > 1"), "surname").select("surname", "name", "names"), "sized-surnames")
    few = sized.filter(F.col("names") <= FEW_NAMES).select("surname", "name")
    grams = _prefix_grams(sized.filter(F.col("names") > FEW_NAMES).select("surname", "name"), threshold)
    la, lb = F.length("name_a"), F.length("name_b")
    bound = F.lit(200.0) * F.least(la, lb) >= F.lit(threshold) * (la + lb)  # no more can be common than the shorter has

    def met(rows: DataFrame, by: list[str]) -> DataFrame:
        a, b = (rows.select(*by, F.col("name").alias(f"name_{side}")) for side in "ab")
        return a.join(b, by).filter((F.col("name_a") < F.col("name_b")) & bound).select("surname", "name_a", "name_b")

    near = written(met(few, ["surname"]).unionByName(met(grams, ["surname", "gram"]).distinct()), "near-names")
    # a pair is few bytes and much work: the table is dealt by rows, as a scan of it is cut by bytes alone
    dealt = near.repartition(max(1, -(-near.count() // TASK_PAIRS)))
    alike = (token_sort_ratio(F.col("name_a"), F.col("name_b")) >= threshold).alias("alike")
    # written with the verdict: a filter would move below the repartition, and the pairs are read both ways
    return written(dealt.select("*", alike), "compared-names").filter("alike").drop("alike")


def name_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs of units (root, surname, name, ord) of one surname, different names and different roots whose names reach the similarity."""
    near = similar_names(written(names.select("surname", "name").distinct(), "surname-names"), threshold)
    both = near.unionByName(near.select("surname", F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b")))
    a, b = (names.select("surname", *(F.col(c).alias(f"{c}_{side}") for c in ("root", "name", "ord"))) for side in "ab")
    pairs = both.join(a, ["surname", "name_a"]).join(b, ["surname", "name_b"])
    return pairs.filter((F.col("ord_a") < F.col("ord_b")) & (F.col("root_a") != F.col("root_b")))


def linked_names(units: DataFrame, threshold: float) -> DataFrame:
    """root and cluster_id of the roots that similar names link. units: root, surname, name, ord (the root's first record of that name) and guard (bits of `linking`)."""
    numbers = units.groupBy("surname", "name").agg(F.min("ord").alias("number"), F.count(F.lit(1)).alias("n"))
    numbers = written(numbers, "surname-names")
    blocks = numbers.groupBy("surname").agg(F.min("number").alias("block"))
    near = similar_names(numbers.select("surname", "name"), threshold)
    a, b = (numbers.select("surname", F.col("name").alias(f"name_{side}"), F.col("number").alias(side)) for side in "ab")
    pairs = near.join(a, ["surname", "name_a"]).join(b, ["surname", "name_b"]).select("a", "b")
    pairs = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "name-numbers")
    # a name that one root has alone, and that no other name is like, links nothing
    some = numbers.join(pairs.select(F.col("a").alias("number")).distinct().withColumn("like", F.lit(True)), "number", "left").filter("like OR n > 1")
    some = some.join(blocks, "surname").select("surname", "name", "number", "block")
    similar = pairs.unionByName(some.select(F.col("number").alias("a"), F.col("number").alias("b"))).toDF("name_a", "name_b")
    rows = units.join(some, ["surname", "name"]).select("root", F.col("number").alias("name"), "block", "ord", "guard")
    return linking.link(rows, similar)


def guards(values: DataFrame) -> DataFrame:
    """record_ord and guard: the bits of the record's e-mails and phones that are not malformed."""
    strong = values.filter(~F.col("malformed") & F.col("field").isin("emails", "phones"))
    bit = F.when(F.col("field") == "emails", linking.EMAIL).otherwise(linking.PHONE)
    return strong.groupBy("record_ord").agg(F.bit_or(bit).alias("guard"))


def first_names(values: DataFrame) -> DataFrame:
    """record_ord, surname and name of the records that have a surname."""
    names = values.filter((F.col("field") == "full_name") & (F.col("pos") == 0)).select("record_ord", F.col("v_str").alias("name"))
    return names.select("record_ord", surname_key(F.col("name")).alias("surname"), "name").filter("surname IS NOT NULL")


def units(names: DataFrame, records: DataFrame) -> DataFrame:
    """The units of `linked_names`, from record_ord, surname, name and from record_ord, root, guard (null: none)."""
    held = records.groupBy("root").agg(F.bit_or("guard").alias("guard"))
    named = names.join(records.select("record_ord", "root"), "record_ord")
    return named.groupBy("root", "surname", "name").agg(F.min("record_ord").alias("ord")).join(held, "root").fillna(0, ["guard"])


def resolve(raw: DataFrame, values: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """record_ord and cluster_id (the least record_ord of the cluster) of every record."""
    records = raw.select("record_ord").distinct()
    roots = written(exact_components(exact_keys(values)), "roots")
    records = records.join(roots, "record_ord", "left").join(guards(values), "record_ord", "left")
    records = written(records.withColumn("root", F.coalesce("root", "record_ord")), "records")
    linked = linked_names(written(units(first_names(values), records), "units"), config.fuzzy_threshold)
    return records.join(linked, "root", "left").select("record_ord", F.coalesce("cluster_id", "root").alias("cluster_id"))
