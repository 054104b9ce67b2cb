"""Relational operators: priority joins, upserts, paired outcomes, regions and bounded selections.

Every function maps DataFrames to a DataFrame and collects nothing. Where order decides, the
caller names a total order, so results never depend on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import Rounds


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order; rows with a null key stay, each alone."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.where(known).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return kept.unionByName(df.where(~known))


def latest_by(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Last value of columns per key in one pre-aggregated pass, without sorting a group."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("__v")).select(key, *(F.col(f"__v.{v}") for v in values))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_either(old: DataFrame, new: DataFrame, first: str, second: str) -> DataFrame:
    """As upsert, where either of two keys matches; blank keys never do. Two equi-joins, no theta join."""
    out = old
    for key in (first, second):
        keys = new.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
        out = out.join(keys, key, "left_anti").select(*old.columns)
    return out.unionByName(new)


def key_bridge(df: DataFrame, value: str, *keys: str, order: str | None = None) -> DataFrame:
    """(key, value) for each non-blank key of a row, each pair once; with `order`, of the rows that share a key the last one's value.

    Null and empty keys lead nowhere; ties in the order go to the larger value."""
    each = df.select(F.explode(F.array_distinct(F.array_compact(F.array(*(F.col(k).cast("string") for k in keys))))).alias("key"), F.col(value), *([F.col(order).alias("__order")] if order else [])).where(F.col("key") != "")
    return each.groupBy("key").agg(F.max(F.struct("__order", value))[value].alias(value)) if order else each.distinct()


def coalesce_join(left: DataFrame, key: str, *sides: DataFrame, value: str) -> DataFrame:
    """The first side's value that is there."""
    out = left
    for i, side in enumerate(sides):
        out = out.join(side.select(key, F.col(value).alias(f"__{i}")), key, "left")
    return out.withColumn(value, F.coalesce(*(F.col(f"__{i}") for i in range(len(sides))))).drop(*(f"__{i}" for i in range(len(sides))))


def contingency(ids: DataFrame, a: DataFrame, b: DataFrame, key: str, outcome: str) -> DataFrame:
    """Four cells over all ids; a missing outcome is a failure."""
    both = ids.join(a.select(key, F.col(outcome).alias("a")), key, "left").join(b.select(key, F.col(outcome).alias("b")), key, "left").fillna(0, ["a", "b"])
    return both.agg(*(F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(name) for name, x, y in (("both", 1, 1), ("only_a", 1, 0), ("only_b", 0, 1), ("neither", 0, 0))))


def venn_regions(sets: dict[str, DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """(region, n): which of the named sets hold each id, in one aggregation over tagged rows."""
    tagged = ids.select(key, F.lit(0).alias("m"))
    for i, s in enumerate(sets.values()):
        tagged = tagged.unionByName(s.select(key, F.lit(1 << i).alias("m")))
    masks = tagged.groupBy(key).agg(F.bit_or("m").alias("m"))
    names = F.array_join(F.array_compact(F.array(*(F.when(F.col("m").bitwiseAND(1 << i) > 0, F.lit(n)) for i, n in enumerate(sets)))), "+")
    return masks.groupBy(F.when(F.col("m") == 0, "none").otherwise(names).alias("region")).agg(F.count(F.lit(1)).alias("n"))


def chronological_split(df: DataFrame, repo: str, *order: str, share: float = 0.3) -> DataFrame:
    """Adds role: of n rows of a group the first max(1, floor(n * share)), but at most n - 1, are memory; a single row is evaluation."""
    w = Window.partitionBy(repo)
    n, rn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    cut = F.least(n - 1, F.greatest(F.lit(1), F.floor(n * F.lit(share))))
    return df.withColumn("role", F.when((n > 1) & (rn <= cut), "memory").otherwise("evaluation"))


def later_memory(evals: DataFrame, memory: DataFrame, repo: str, ts: str) -> DataFrame:
    """Evaluation rows with the number of memory rows of their group that are later, by ranks instead of a range join.

    Both sides are sorted once per group; what is later is the group's total less a running count."""
    rows = evals.withColumn("__e", F.lit(1)).unionByName(memory.withColumn("__e", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(repo)
    upto = F.sum(1 - F.col("__e")).over(w.orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(1 - F.col("__e")).over(w)
    return rows.withColumn("n_later", total - upto).where("__e = 1").drop("__e")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def budget_prefix(df: DataFrame, group: str, size: str, budget: int, *order: str) -> DataFrame:
    """Rows of each group as long as their running size keeps within the budget; stops at the first overflow."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def newest_suffix(df: DataFrame, group: str, size: str, rows: int, bytes_: int, *newest_first: Column) -> DataFrame:
    """The newest rows of each group under both caps; the newest is kept even if it alone is over."""
    w = Window.partitionBy(group).orderBy(*newest_first)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("__rn", F.row_number().over(w)).withColumn("__used", F.sum(size).over(run))
    return out.where((F.col("__rn") == 1) | ((F.col("__rn") <= rows) & (F.col("__used") <= bytes_))).drop("__rn", "__used")


def monotone(df: DataFrame, group: str, t: str, *order: str) -> DataFrame:
    """t' = max(t, previous t' + 1), unrolled: the row number plus the running maximum of t less the row number."""
    w = Window.partitionBy(group).orderBy(t, *order)
    rn = F.row_number().over(w)
    return df.withColumn("__rn", rn).withColumn("monotone", F.col("__rn") + F.max(F.col(t) - F.col("__rn")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__rn")


def keyset_page(df: DataFrame, key: str, anchor, size: int, ascending: bool = True, inclusive: bool = False) -> DataFrame:
    """The next `size` rows beyond an anchor, with has_more on each: a top-k, not an offset scan."""
    c = F.col(key)
    if anchor is not None:
        df = df.where({(True, True): c >= anchor, (True, False): c > anchor, (False, True): c <= anchor, (False, False): c < anchor}[ascending, inclusive])
    order = c.asc() if ascending else c.desc()
    page = df.orderBy(order).limit(size + 1)
    w = Window.orderBy(order)  # over size + 1 rows
    numbered = page.withColumn("__rn", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    return numbered.where(F.col("__rn") <= size).drop("__rn")


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The upper of two middles for an even count: element n / 2 of the sorted values. Equal values are counted first, so a group's rows are not sorted one by one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(group)
    upto = F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    mid = counts.withColumn("__upto", upto).withColumn("__at", F.floor(F.sum("__c").over(w) / 2) + 1)
    return mid.where((F.col("__upto") >= F.col("__at")) & (F.col("__upto") - F.col("__c") < F.col("__at"))).select(group, F.col(value).alias("upper_median"))


def sessions(df: DataFrame, group: str, start: Column, *order: str) -> DataFrame:
    """Adds session: how many start rows a group had so far; rows before the first have 0."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("session", F.sum(F.when(start, 1).otherwise(0)).over(w))


def frozen_upsert(changes: DataFrame, key: str, seq: str, status: str, terminal: tuple[str, ...]) -> DataFrame:
    """One row per key: first sequence number, and the status of the first terminal change or else of the last change."""
    done = F.col(status).isin(*terminal)
    return changes.groupBy(key).agg(
        F.min(seq).alias("first_seq"),
        F.coalesce(F.min_by(F.when(done, F.col(status)), F.when(done, F.col(seq))), F.max_by(status, seq)).alias(status),
        F.coalesce(F.min(F.when(done, F.col(seq))), F.max(seq)).alias("last_seq"),
    )


def rollup_total(df: DataFrame, group: str, *aggs: Column, label: str = "TOTAL") -> DataFrame:
    return df.rollup(group).agg(F.grouping(group).alias("__g"), *aggs).withColumn(group, F.when(F.col("__g") == 1, label).otherwise(F.col(group).cast("string"))).drop("__g")


def quality_flags(df: DataFrame, **rules: Column) -> DataFrame:
    """Adds reasons: the names of all rules that hold."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))


def fixed_batches(df: DataFrame, group: str, size: int, *order: str) -> DataFrame:
    """Adds batch: consecutive slices of `size` rows in each group's order, from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


def recurring(df: DataFrame, pattern: str, issue: str) -> DataFrame:
    """(pattern, frequency) of patterns that enough issues show: at least 3 and 30 % of all, or 2 and 40 % below five issues.

    Repeats within an issue go before the count, so a frequent pattern is pre-aggregated."""
    pairs = df.select(pattern, issue).distinct()
    total = df.agg(F.count_distinct(issue).alias("total"))  # one row
    few = F.col("total") < 5
    counted = pairs.groupBy(pattern).agg(F.count(issue).alias("frequency")).join(F.broadcast(total))
    enough = (F.col("frequency") >= F.when(few, 2).otherwise(3)) & (F.col("frequency") * 100 >= F.col("total") * F.when(few, 40).otherwise(30))
    return counted.where(enough).select(pattern, "frequency")


def global_rank(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds each row's place from 1 in a total order over all rows, without gathering them in one task.

    Rows are dealt to partitions by ranges of the order and written once, as another run could
    draw other ranges; a place is the row's own in its range and the sizes of the ranges before."""
    rounds = Rounds(df.sparkSession)
    dealt = rounds.keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    placed = dealt.join(F.broadcast(before), "__part").withColumn(name, F.coalesce("__before", F.lit(0)) + F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return rounds.result(placed.drop("__part", "__before"))


def quota_sample(df: DataFrame, group: str, order: str, first: int, more_groups: int | None, target: int) -> DataFrame:
    """One row of each of the `first` largest groups, then up to two more of each group in the same order until `target` rows.

    Groups go by size, then by their first row; `more_groups` limits those that give more."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    by_size = Window.orderBy(F.col("n").desc(), "seen")  # one row a group
    ranked = sizes.withColumn("r", F.row_number().over(by_size)).withColumn("one", (F.col("r") <= min(first, target)).cast("int"))
    wanted = F.when(F.col("r") <= (more_groups if more_groups is not None else F.col("r")), F.least(F.lit(2), F.col("n") - F.col("one"))).otherwise(0)
    spent = ranked.withColumn("want", wanted).withColumn("ones", F.sum("one").over(Window.partitionBy())).withColumn("before", F.coalesce(F.sum("want").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    quota = spent.select(group, "r", (F.col("one") + F.greatest(F.lit(0), F.least("want", F.lit(target) - F.col("ones") - F.col("before")))).alias("quota"))
    rows = df.join(quota.where("quota > 0"), group)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("k <= quota").drop("quota")


def next_fit(items: Column, limit: int) -> Column:
    """array<array<pos>> of items (tokens, pos) in their own order: the largest first into a chunk while it keeps within the limit.

    One that alone is over gets its own chunk; if all fit into one, the items are halved in their own order."""
    kind = "array<struct<tokens:bigint,open:boolean,places:array<int>>>"
    ordered = F.array_sort(items, lambda a, b: F.when(a["tokens"] > b["tokens"], -1).when(a["tokens"] < b["tokens"], 1).when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))

    def step(acc: Column, x: Column) -> Column:
        cur, over = F.try_element_at(acc, F.lit(-1)), x["tokens"] > limit
        new = F.array(F.struct(x["tokens"].alias("tokens"), (~over).alias("open"), F.array(x["pos"]).alias("places")))
        grown = F.array(F.struct((cur["tokens"] + x["tokens"]).alias("tokens"), F.lit(True).alias("open"), F.concat(cur["places"], F.array(x["pos"])).alias("places")))
        fits = F.coalesce(cur["open"] & ~over & (cur["tokens"] + x["tokens"] <= limit), F.lit(False))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.concat(acc, new)).cast(kind)

    chunks = F.transform(F.aggregate(ordered, F.array().cast(kind), step), lambda c: c["places"])
    places, half = F.transform(items, lambda x: x["pos"]), F.floor(F.size(items) / 2).cast("int")
    halves = F.array(F.slice(places, F.lit(1), half), F.slice(places, half + 1, F.size(items)))
    return F.when((F.size(chunks) == 1) & (F.size(items) > 1), halves).otherwise(chunks)


def tiered_budget(df: DataFrame, group: str, level: str, size: str, budget: int, enough: int, *order: str) -> DataFrame:
    """All of level 1; of level 2 what 60 % of the rest holds, of level 3 what is left then, if that is `enough`; level 1 alone if it is over 80 % of the budget.

    A level that does not fit whole is cut at its first row that does not."""
    own = Window.partitionBy(group, level).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(group)
    total = lambda k: F.coalesce(F.sum(F.when(F.col(level) == k, F.col(size))).over(whole), F.lit(0))
    t = df.withColumn("__used", F.sum(size).over(own)).withColumn("__s1", total(1)).withColumn("__s2", total(2))
    share = (F.lit(budget) - F.col("__s1")) * F.lit(0.6)
    small = F.col("__s1") <= budget * 0.8
    second = (F.col(level) == 2) & small & ((F.col("__s2") <= share) | (F.col("__used") <= F.floor(share)))
    t = t.withColumn("__second", second)
    room = F.lit(budget) - F.col("__s1") - F.coalesce(F.sum(F.when(F.col("__second"), F.col(size))).over(whole), F.lit(0))
    third = (F.col(level) == 3) & small & (F.col("__room") >= enough) & (F.col("__used") <= F.col("__room"))
    return t.withColumn("__room", room).where((F.col(level) == 1) | F.col("__second") | third).drop("__used", "__s1", "__s2", "__second", "__room")


def newest_within(df: DataFrame, group: str, newest: str, size: str, rows: int, bytes_: int) -> DataFrame:
    """Each group's newest rows within both caps, cut at the first that passes one. At most `rows` of a group leave a partition for the final cut."""
    slim = top_k(df, [group], rows, F.col(newest).desc()).drop("rank")  # taken in every partition before the shuffle, too
    w = Window.partitionBy(group).orderBy(F.col(newest).desc())
    out = slim.withColumn("__k", F.row_number().over(w)).withColumn("__used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.where((F.col("__k") <= rows) & (F.col("__used") <= bytes_)).drop("__k", "__used")



def three_sides(sides: dict[str, DataFrame], key: str, group: str, outcome: str) -> DataFrame:
    """One row an id of any of three sides: each side's outcome or `not_run`, how many succeeded, the category, and for partial success who solved it and who failed.

    Sides are unique by key; they are joined in full, outer."""
    out = None
    for name, side in sides.items():
        own = side.select(key, F.col(group).alias(f"__g_{name}"), F.col(outcome).alias(f"{name}_status"))
        out = own if out is None else out.join(own, key, "full")
    a, b, c = (F.coalesce(F.col(f"{n}_status") == "success", F.lit(False)) for n in sides)
    n = a.cast("int") + b.cast("int") + c.cast("int")
    category = (
        F.when(a & b & c, "All 3 Solved").when(a & b, "Fwd+Back Only (Bidir MISSED)").when(a & c, "Fwd+Bidir Only (Back MISSED)").when(b & c, "Back+Bidir Only (Fwd MISSED)")
        .when(a, "ONLY Forward").when(b, "ONLY Backward").when(c, "ONLY Bidirectional").otherwise("All Failed")
    )
    listed = lambda yes: F.array_join(F.array_compact(F.array(*(F.when(x == F.lit(yes), F.lit(name.capitalize())) for x, name in zip((a, b, c), sides, strict=True)))), " + ")
    partial = (n > 0) & (n < 3)
    return out.select(
        key, F.coalesce(*(F.col(f"__g_{x}") for x in sides), F.lit("")).alias(group), *(F.coalesce(f"{x}_status", F.lit("not_run")).alias(f"{x}_status") for x in sides), n.alias("success_count"), category.alias("category"),
        F.when(partial, listed(True)).alias("solved_by"), F.when(partial, listed(False)).alias("failed_in"),
    )


def prefix_lookup(asked: DataFrame, entries: DataFrame, key: str, entry_key: str, order: str, least: int) -> DataFrame:
    """Adds the columns of the entry with the asked key, else of the first entry (by `order`) where one key is a beginning of the other; nulls on a miss.

    Keys of `least` letters or more meet by these letters, so no key is compared with all entries;
    shorter ones are not looked up by their beginning. Blank keys miss."""
    columns = [c for c in entries.columns if c not in (entry_key, order)]
    start = lambda c: F.substring(c, 1, least)
    q = asked.withColumn("__start", start(key)).withColumn("__row", F.monotonically_increasing_id())
    e = entries.withColumn("__start", start(entry_key))
    near = q.select("__row", "__start", key).where(F.length(key) >= least).join(e, "__start").where(F.startswith(entry_key, F.col(key)) | F.startswith(key, F.col(entry_key)))
    best = near.groupBy("__row").agg(F.min_by(F.struct(*columns), F.struct(F.col(entry_key) != F.col(key), F.col(order))).alias("__e"))
    return q.join(best, "__row", "left").select(*asked.columns, *(F.col(f"__e.{c}").alias(c) for c in columns))


def suffix_within(df: DataFrame, order: str, size: str, most: int, target: int) -> DataFrame:
    """All rows if they keep within `most` in all; else the newest ones within `target`, the very newest always."""
    total = df.agg(F.sum(size).alias("__total"))  # one row
    ranked = global_rank(df, "__k", order)
    last = ranked.agg(F.max("__k").alias("__last"))
    # sizes of a thousand rows at a time, so that running sums need no single task over all rows
    block = F.floor(F.col("__k") / 1000)
    blocks = ranked.groupBy(block.alias("__b")).agg(F.sum(size).alias("__sum"))
    later = blocks.select("__b", F.coalesce(F.sum("__sum").over(Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__later"))
    within = F.sum(size).over(Window.partitionBy("__b").orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    used = ranked.withColumn("__b", block).join(later, "__b").withColumn("__used", F.col("__later") + within).join(F.broadcast(total)).join(F.broadcast(last))
    return used.where((F.col("__total") <= most) | (F.col("__used") <= target) | (F.col("__k") == F.col("__last"))).select(*df.columns)


def fill_by(df: DataFrame, column: str, source: str, compute, kind) -> DataFrame:
    """Fills a column where it is null by a function over batches of another column; the other rows do not reach Python."""
    filled = df.where(F.col(column).isNull()).withColumn(column, F.pandas_udf(compute, kind)(F.col(source)))
    return df.where(F.col(column).isNotNull()).unionByName(filled)


def map_groups(df: DataFrame, group: str, order: list[str], rows_of, schema: str) -> DataFrame:
    """Rows that `rows_of` makes of each group's rows (a list of tuples in the frame's columns, in order), group by group.

    Groups lie one after another in sorted partitions and are cut from Arrow batches, so many small
    groups cost no batch each. One group must fit a task. Arrays are lists, nulls None."""
    names = [f.split()[0] for f in schema.split(", ")]
    at = df.columns.index(group)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if held and row[at] != held[-1][at]:
                    yield from rows_of(held)
                    held = []
                held.append(row)
        if held:
            yield from rows_of(held)

    def arrow(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        kind, part = to_arrow_schema(out), []
        for row in run(batches):
            part.append(dict(zip(names, row, strict=True)))
            if len(part) == 10_000:
                yield pa.RecordBatch.from_pylist(part, schema=kind)
                part = []
        yield pa.RecordBatch.from_pylist(part, schema=kind)

    out = StructType.fromDDL(schema)
    return df.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInArrow(arrow, out)
