"""Operators between artifacts and within their sequences: pairs, nearest names, gaps, look-ahead and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import power_of_two


def size_pairs(df: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """Pairs of a group whose sizes add up to a power of two.

    For each size the complements to the powers of two above it are known numbers, so the pairs come from an
    equi-join on (group, size) and not from all pairs of a group.
    """
    one = df.select(F.col(group).alias("g"), F.col(key).alias("a"), F.col(size).cast("long").alias("size_a")).filter("size_a > 0")
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.pow(F.lit(2), k).cast("long")), lambda p: (p > F.col("size_a")) & (p <= 4 * F.col("size_a")))
    one = one.withColumn("whole", F.explode(powers)).withColumn("size_b", F.col("whole") - F.col("size_a")).filter("size_b <= size_a")
    two = df.select(F.col(group).alias("g"), F.col(key).alias("b"), F.col(size).cast("long").alias("size_b"))
    return one.join(two, ["g", "size_b"]).filter((F.col("size_a") > F.col("size_b")) | (F.col("a") < F.col("b"))).select("g", "a", "b", "size_a", "size_b", "whole")


def equal_size_pairs(df: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """Neighbours, by key, among a group's rows of one size: candidates for the halves of an interleaved image."""
    w = Window.partitionBy(group, size).orderBy(key)
    return df.select(F.col(group).alias("g"), F.col(size).alias("size"), F.col(key).alias("a"), F.lead(key).over(w).alias("b")).filter("b is not null")


def common_length(a: Column, b: Column) -> Column:
    """The letters that two texts share from the beginning; null if one is."""
    n = F.least(F.length(a), F.length(b))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(n > 0, shared).otherwise(0))


def around(asks: DataFrame, there: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``asks`` with ``before`` and ``after``: the ``value`` of the nearest row of ``there`` at ``at`` or before it, and of the nearest behind it,
    of those that are alike in ``by``; null where there is none.

    Both are sorted together, once each way, so rows are never paired, and a task streams over narrow rows.
    """
    rows = asks.unionByName(there.select(*by, at, F.col(value).alias("_v")), allowMissingColumns=True)
    window = lambda *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last("_v", ignorenulls=True).over(window(F.col(at), F.col("_v").isNull())))
    rows = rows.withColumn("after", F.last("_v", ignorenulls=True).over(window(F.col(at).desc(), F.col("_v").isNotNull())))
    return rows.filter("_v is null").drop("_v")


def _by_letter(df: DataFrame, group: str, name: str, alias: str) -> DataFrame:
    """(g, p, alias), distinct: the names of each group and their first letters."""
    rows = df.select(F.col(group).alias("g"), F.col(name).alias(alias)).filter(F.col("g").isNotNull() & F.col(alias).isNotNull())
    return rows.distinct().withColumn("p", F.substring(alias, 1, 1))


def closest_name(bases: DataFrame, candidates: DataFrame, group: str, base: str, name: str) -> DataFrame:
    """For each base the candidate of its group with the longest common prefix; ties go to the first by name.

    What shares most letters with a base stands next to it among the sorted names of its first letter, and the first
    that shares as many stands next to these letters, so names are neither paired nor taken apart.
    """
    left, right = _by_letter(bases, group, base, "base"), _by_letter(candidates, group, name, "name")
    there = right.select("g", "p", F.col("name").alias("at"), "name")
    near = around(left.withColumn("at", F.col("base")), there, ["g", "p"], "at", "name").filter("before is not null or after is not null")
    near = near.select("g", "p", "base", F.greatest(common_length(F.col("base"), F.col("before")), common_length(F.col("base"), F.col("after"))).alias("shared"))
    first = around(near.withColumn("at", F.expr("left(base, shared)")), there, ["g", "p"], "at", "name")
    return first.select("g", "base", F.when(F.col("before") == F.col("at"), F.col("before")).otherwise(F.col("after")).alias("name"), "shared")


def closest_prefix(bases: DataFrame, candidates: DataFrame, group: str, base: str, name: str) -> DataFrame:
    """(g, base, name): the candidate that is found by shortening the base letter by letter until just one begins with what is left.

    A group's only candidate is taken as it is. Where the letters never leave just one, the candidate whose leading
    number is nearest to the base's is taken, of those that share the first letter, and then the first by the rest of its
    name. Among sorted names just one is left if a neighbour of the base shares more letters with it than the other
    neighbour and than the name behind; numbers are looked up among sorted numbers. So a group's rows are never paired.
    """
    left, right = _by_letter(bases, group, base, "base"), _by_letter(candidates, group, name, "name")
    only = right.groupBy("g").agg(F.count(F.lit(1)).alias("all"), F.min("name").alias("one"))
    left = left.join(only, "g")
    w = Window.partitionBy("g", "p").orderBy("name")
    there = right.select("g", "p", F.col("name").alias("at"), F.struct("name", F.lag("name").over(w).alias("further_before"), F.lead("name").over(w).alias("further_after")).alias("v"))
    near = around(left.filter("all > 1").select("g", "p", "base", F.col("base").alias("at")), there, ["g", "p"], "at", "v").filter("before is not null or after is not null")
    length = lambda c: F.coalesce(common_length(F.col("base"), F.col(c)), F.lit(-1))
    near = near.select("g", "p", "base", F.col("before.name").alias("b"), F.col("after.name").alias("a"), length("before.name").alias("nb"), length("after.name").alias("na"), length("before.further_before").alias("fb"), length("after.further_after").alias("fa"))
    # Where both names before share as many letters as the nearest, or both neighbours do, more than one is left.
    near = near.withColumn("name", F.when((F.col("nb") > F.col("na")) & (F.col("nb") > F.col("fb")), F.col("b")).when((F.col("na") > F.col("nb")) & (F.col("na") > F.col("fa")), F.col("a")))
    rest = near.filter("name is null").select("g", "p", "base")
    # Of names that share a first letter all begin with a number or none does.
    digits = F.regexp_extract("name", "^[0-9]+", 0)
    number = F.when(digits != "", digits.cast("decimal(38,0)")).otherwise(F.lit(0)).cast("decimal(38,0)")
    key = F.struct(F.expr("substring(name, length(digits) + 1)").alias("rest"), "name")
    there = right.withColumn("digits", digits).withColumn("at", number).groupBy("g", "p", "at").agg(F.min(key).alias("m")).select("g", "p", "at", F.struct("at", "m").alias("v"))
    asked = F.coalesce(F.regexp_extract("base", "^[0-9]+", 0).try_cast("decimal(38,0)"), F.lit(0)).cast("decimal(38,0)")
    close = around(rest.withColumn("at", asked), there, ["g", "p"], "at", "v")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("at")).alias("d"), F.col(c)["m"].alias("m")))
    close = close.select("g", "base", F.least(far("before"), far("after"))["m"]["name"].alias("name"))
    out = left.filter("all = 1").select("g", "base", F.col("one").alias("name")).unionByName(near.filter("name is not null").select("g", "base", "name"))
    return out.unionByName(close)


def common_prefixes(df: DataFrame, group: str, words: str) -> DataFrame:
    """(g, prefix, rest): names, as arrays of words, below the first words that they share with a neighbour in order.

    Names are sorted without regard to case; one that shares words with the next opens a group of those words, which
    the following ones join as long as they begin with them all; a name that shares none stands alone, with no rest.
    """

    def fold(names: Column) -> Column:
        lower = lambda x: F.transform(x, lambda w: F.lower(w))
        shared = lambda a, b: F.coalesce(F.array_position(F.zip_with(lower(a), lower(b), lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1, F.lit(0))
        shared_all = lambda a, b: F.when(F.size(a) == 0, 0).otherwise(F.when(shared(a, b) < 0, F.least(F.size(a), F.size(b))).otherwise(shared(a, b)))
        empty = F.array().cast("array<string>")
        start = F.struct(empty.alias("open"), F.array().cast("array<struct<prefix:string,rest:string>>").alias("out"))

        def step(state: Column, pair: Column) -> Column:
            name, after = pair["name"], pair["after"]
            joins = (F.size(state["open"]) > 0) & (F.slice(lower(name), F.lit(1), F.greatest(F.size(state["open"]), F.lit(1))) == lower(state["open"]))
            k = F.when(after.isNull(), 0).otherwise(shared_all(name, after)).cast("int")
            opened = F.when(joins, state["open"]).when(k > 0, F.slice(name, F.lit(1), F.greatest(k, F.lit(1)))).otherwise(empty)
            row = F.struct(
                F.when(F.size(opened) > 0, F.array_join(opened, " ")).otherwise(F.array_join(name, " ")).alias("prefix"),
                F.when(F.size(opened) > 0, F.array_join(F.slice(name, F.size(opened) + 1, F.greatest(F.size(name), F.lit(1))), " ")).otherwise("").alias("rest"),
            )
            return F.struct(opened.alias("open"), F.concat(state["out"], F.array(row)).alias("out"))

        pairs = F.transform(names, lambda x, i: F.struct(x.alias("name"), F.get(names, i + 1).alias("after")))
        return F.aggregate(pairs, start, step)["out"]

    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.transform(F.col(words), lambda w: F.lower(w)).alias("k"), F.col(words).alias("w")))), lambda x: x["w"])
    per = df.groupBy(F.col(group).alias("g")).agg(ordered.alias("names"))
    return per.select("g", F.explode(fold(F.col("names"))).alias("x")).select("g", "x.prefix", "x.rest")


def gaps(intervals: DataFrame, group: str, begin: str, end: str, whole: Column) -> DataFrame:
    """The parts of [0, whole) that no interval of the group covers."""
    rows = intervals.select(F.col(group).alias("g"), F.col(begin).alias("b"), F.col(end).alias("e"), whole.alias("w"))
    edge = rows.groupBy("g", "w").agg(F.lit(1)).select("g", F.col("w").alias("b"), F.col("w").alias("e"), "w")
    before = F.max("e").over(Window.partitionBy("g").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1))
    return rows.union(edge).withColumn("from", F.coalesce(before, F.lit(0))).filter(F.col("b") > F.col("from")).select("g", "from", F.col("b").alias("to"))


def after_match(lines: DataFrame, group: str, place: str, line: str, pattern: str) -> DataFrame:
    """Lines that come right after one where the pattern is found."""
    before = F.lag(line).over(Window.partitionBy(group).orderBy(place))
    return lines.withColumn("_before", before).filter(F.col("_before").rlike(pattern)).drop("_before")


def offsets_in_ranges(points: DataFrame, ranges: DataFrame, point: str, begin: str, end: str, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with the ranges [begin, end) of the same ``keys`` they fall into: both are cut into cells of ``width`` and meet
    key by key and cell by cell."""
    left = points.withColumn("_cell", F.floor(F.col(point) / width))
    right = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    return left.join(right, [*keys, "_cell"]).filter((F.col(point) >= F.col(begin)) & (F.col(point) < F.col(end))).drop("_cell")


def blank_repeats(df: DataFrame, group: list[str], order: list[str], value: str, mark: str = "↖") -> DataFrame:
    """``value`` with a mark where it repeats the row before, within a group."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(value, F.when(F.col(value) == before, F.lit(mark)).otherwise(F.col(value)))


def largest(df: DataFrame, group: str, size: str, name: str) -> DataFrame:
    """The largest row of each group; of equal ones the last by name."""
    w = Window.partitionBy(group).orderBy(F.col(size).desc(), F.col(name).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ancestors(path: Column) -> Column:
    """The folders of a path, the nearest last."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def whole_images(df: DataFrame, size: str) -> DataFrame:
    return df.filter(power_of_two(F.col(size)))


def metadata_lines(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``[key] value`` lines of each group, distinct and sorted, as one text."""
    line = F.concat(F.lit("["), F.col(key), F.lit("] "), F.col(value).cast("string"))
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("metadata"))


def grouped_names(df: DataFrame, group: str, category: str, name: str) -> DataFrame:
    """``name (category, category)`` lines of each group, sorted."""
    per = df.groupBy(group, name).agg(F.array_join(F.array_sort(F.collect_set(category)), ", ").alias("_c"))
    line = F.concat(F.col(name), F.lit(" ("), F.col("_c"), F.lit(")"))
    return per.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("names"))


def nearest_after(asks: DataFrame, places: DataFrame, group: str, at: str, place: str) -> DataFrame:
    """``asks`` with ``next``: the first of the group's ``places`` at ``at`` or behind it; rows without one are left out.

    Both are sorted together, so a group's rows are never paired.
    """
    both = asks.withColumn("_at", F.col(at).cast("long")).withColumn("_place", F.lit(None).cast("long"))
    there = places.select(group, F.col(place).cast("long").alias("_at"), F.col(place).cast("long").alias("_place"))
    rows = both.unionByName(there, allowMissingColumns=True)
    # From the end on, as a window that looks ahead begins anew for each row; of equal ones those who ask come last.
    order = Window.partitionBy(group).orderBy(F.col("_at").desc(), F.col("_place").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last("_place", ignorenulls=True).over(order))
    return rows.filter("_place is null and next is not null").drop("_at", "_place")


def follow(starts: DataFrame, links: DataFrame, group: str, folder: str) -> DataFrame:
    """(group, start, node, step): all that each of ``starts`` (group, start, node) reaches over ``links`` (group, node, next), itself
    at step 0.

    Each node has one link at most, to one behind it. Steps are doubled: in round k the links are those of 2**k steps, so a
    chain of n records takes log n rounds, each a join of written tables.
    """
    spark, k = starts.sparkSession, 0

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}-{k}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}-{k}")

    reached, links = write(starts.select(group, "start", "node", F.lit(0).cast("long").alias("step")), "reached"), write(links.filter("next > node").select(group, "node", "next"), "links")
    while True:
        new = reached.join(links, [group, "node"]).select(group, "start", F.col("next").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        if new.isEmpty():
            return reached
        k += 1
        reached = write(reached.unionByName(new), "reached")
        further = links.select(group, F.col("node").alias("from"), F.col("next").alias("node"))
        links = write(further.join(links, [group, "node"]).select(group, F.col("from").alias("node"), "next"), "links")


def overlaid(ranges: DataFrame, group: str, begin: str, end: str, rank: str, source: str) -> DataFrame:
    """(group, begin, end, source, offset): the disjoint pieces of ranges [begin, end) that lie over each other, each of the range
    of the highest ``rank`` there (of equal ones the greater source); ``offset`` is the piece's place in its range.

    The ranges' edges cut them into elementary pieces, which meet the ranges over them; pieces of one range that touch are
    one again.
    """
    r = ranges.filter(F.col(begin) < F.col(end)).select(group, F.col(begin).cast("long").alias("b"), F.col(end).cast("long").alias("e"), F.col(rank).alias("r"), F.col(source).alias("s"))
    edges = r.select(group, F.explode(F.array("b", "e")).alias("from")).distinct()
    pieces = edges.withColumn("to", F.lead("from").over(Window.partitionBy(group).orderBy("from"))).filter("to is not null")
    span = ranges.agg(F.max(F.col(end) - F.col(begin))).first()[0] or 1
    over = offsets_in_ranges(pieces, r, "from", "b", "e", max(1, int(span)), (group,))
    top = over.groupBy(group, "from", "to").agg(F.max(F.struct("r", "s", "b")).alias("t"))
    order = Window.partitionBy(group).orderBy("from")
    same = (F.lag("t").over(order) == F.col("t")) & (F.lag("to").over(order) == F.col("from"))
    runs = top.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order))
    out = runs.groupBy(group, "run", "t").agg(F.min("from").alias("begin"), F.max("to").alias("end"))
    return out.select(group, "begin", "end", F.col("t.s").alias("source"), (F.col("begin") - F.col("t.b")).alias("offset"))
