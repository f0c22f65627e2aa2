"""Mixing sources to target weights (operator 5): pivotal dependent rounding, DataFrame operations only.

A source's target divided by its size gives each of its documents an expected number of copies; the
whole part is certain, the fraction is rounded. Documents meet in blocks of about `block` rows of one
source: two fractions in words trade mass at random, with chances that keep both expectations, until
one of them is whole; the other goes on to the next. What a block leaves over, one document at most,
meets other blocks' leftovers on the next level of a reduction tree with fan-in `block`. Words are
conserved in each trade; the one document left at the root goes to the nearer side, so a source's
taken words miss its target by at most half a document.

A hot source has many blocks, so no task gets a whole source. Blocks are dealt by hash, and chances
come from hashes of row keys, level and seed: reruns agree on any cluster.

Defined results: texts of any length are counted whole; null text has size 0; other columns are carried, whatever their names; null source is a source, last in order; documents of size 0
are taken 0 times in words; rows that repeat id, source and size are dealt as so many single rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    # Words are borders between white space and the rest; counting borders needs no array of words.
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of sizes(source, size): source, source_size, target.

    Targets are share * total by weight with a ceiling of most * source_size; what is over the ceiling goes
    to the others by weight. The rate per unit of weight rises until no source is above its ceiling; each
    step is one aggregate over sources that gives one row.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # Rank by code point without one task for all sources: sort by range, count by partition, add offsets.
    ranged = common.stored(by_source.select("source", "source_size").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = ranged.withColumn("place", place).join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    nth = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.select("source", "source_size", F.get(nth, ((F.col("place") + F.col("before")) % len(weights)).cast("int")).alias("weight"))
    weighted = common.stored(weighted, "mix-weights")
    total = weighted.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    goal = share * (total["t"] or 0)
    rate, last = (goal / total["w"] if total["w"] else 0.0), -1
    while True:
        over = F.col("weight") * rate > most * F.col("source_size")
        r = weighted.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        if not r["n"] or r["n"] == last or not r["free"]:
            break
        rate, last = (goal - most * r["full"]) / r["free"], r["n"]
    return weighted.select("source", "source_size", F.least(F.col("weight") * rate, most * F.col("source_size")).alias("target"))


def _unit(*columns: Column | str) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def _trade(items: Column, level: int, seed: int) -> Column:
    """Fold an array of struct(key, idx, size, part): the carried item meets each next one.

    Masses are words (size * part). With a + b < 1 document's worth the smaller vanishes or the larger
    does; else one of them fills up. State: carried item and the array of settled ones.
    """

    def step(state: Column, item: Column) -> Column:
        a, b = state["carry"], item
        wa, wb = a["size"].cast("double"), b["size"].cast("double")
        # Move d words: up to a's room and b's stock one way, or b's room and a's stock the other way.
        up = F.least(wa * (1 - a["part"]), wb * b["part"])  # words that a can gain from b
        down = F.least(wa * a["part"], wb * (1 - b["part"]))  # words that a can lose to b
        chance = F.when(up + down > 0, down / (up + down)).otherwise(F.lit(0.0))
        draw = _unit(a["key"], a["idx"], b["key"], b["idx"], F.lit(level), F.lit(seed))
        moved = F.when(draw < chance, up).otherwise(-down)

        def clean(x: Column) -> Column:
            return F.when(x < 1e-9, F.lit(0.0)).when(x > 1 - 1e-9, F.lit(1.0)).otherwise(x)

        a2 = a.withField("part", clean(F.when(wa > 0, a["part"] + moved / wa).otherwise(0.0)))
        b2 = b.withField("part", clean(F.when(wb > 0, b["part"] - moved / wb).otherwise(0.0)))
        done = (a2["part"] == 0) | (a2["part"] == 1)
        return F.struct(F.when(done, b2).otherwise(a2).alias("carry"), F.concat(state["settled"], F.array(F.when(done, a2).otherwise(b2))).alias("settled"))

    start = F.struct(F.get(items, F.lit(0)).alias("carry"), F.slice(items, 1, 0).alias("settled"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def plan_copies(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 11) -> DataFrame:
    """Of sizes(doc_id, source, size): one row each with source_size, target, copies and taken."""
    spark = sizes.sparkSession
    sizes = common.stored(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    each = sizes.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("idx"))
    targets = common.stored(source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most), "mix-targets")
    counts = each.groupBy("source").agg(F.count("*").alias("rows"))
    facts = targets.join(counts, targets["source"].eqNullSafe(counts["source"])).select(targets["*"], "rows")
    most_rows = facts.agg(F.max("rows")).first()[0] or 0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = each.join(facts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = base.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("int")).withColumn("part", F.col("expected") - F.floor("expected"))
    base = base.withColumn("part", F.when(F.col("part") > 1 - 1e-9, F.lit(0.0)).otherwise(F.col("part"))).withColumn("whole", F.when(F.col("expected") - F.floor("expected") > 1 - 1e-9, F.col("whole") + 1).otherwise(F.col("whole")))
    base = base.withColumn("key", F.xxhash64("doc_id", "source", "size"))
    out = ["doc_id", "idx", "source", "size", "source_size", "target", "whole", "part"]
    settled = [base.filter((F.col("part") == 0) | (F.col("size") == 0)).withColumn("part", F.lit(0.0)).select(*out)]
    rest = base.filter((F.col("part") > 0) & (F.col("size") > 0))
    levels = max(1, math.ceil(math.log(max(most_rows, 2), block)))
    for level in range(levels):
        wide = F.greatest(F.lit(1), F.ceil(F.col("rows") / float(block ** (level + 1)))).cast("long")
        if level == levels - 1:
            wide = F.lit(1).cast("long")
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("key", "idx", F.lit(seed)), wide))
        item = F.struct("key", "idx", "size", "part", "doc_id")
        groups = dealt.groupBy("source", "source_size", "target", "rows", "whole", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
        folded = common.stored(groups.select("source", "source_size", "target", "rows", "whole", _trade(F.col("items"), level, seed).alias("state")), f"mix-level{level}")
        settled.append(folded.select("source", "source_size", "target", "whole", F.explode("state.settled").alias("i")).select("i.doc_id", "i.idx", "source", "i.size", "source_size", "target", "whole", "i.part"))
        rest = folded.select("source", "source_size", "target", "rows", "whole", "state.carry.*")
    # One document a source is left: to the nearer side, so that at most half of it is missed; a draw decides a tie.
    draw = F.when(F.abs(F.col("part") - 0.5) < 1e-9, _unit("key", "idx", F.lit(seed), F.lit("last"))).otherwise(0.5)
    last = rest.withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0))
    plan = last.select(*out)
    for s in settled:
        plan = plan.unionByName(s.select(*out))
    copies = (F.col("whole") + F.col("part").cast("int")).cast("long")
    return plan.select("doc_id", "idx", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that the mix takes, with their columns and `copies` (how often each is taken; `mix_copies` where docs has such a column, and so on)."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("copies", *("mix_" * k + "copies" for k in range(1, len(taken) + 2))) if n not in taken)
    plan = plan_copies(document_sizes(docs), **options).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list(F.struct("idx", "copies"))).alias("plan"))
    plan = common.stored(plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "plan"), "mix-plan")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_src"), word_count(F.col("text")).alias("_size"))
    meets = own["_id"].eqNullSafe(plan["_d"]) & own["_src"].eqNullSafe(plan["_s"]) & (own["_size"] == plan["_n"])
    found = own.join(common.small_side(plan), meets)
    single = found.filter(F.size("plan") == 1).filter(F.get("plan", F.lit(0))["idx"] == 1)
    repeats = sizes_repeat(plan)
    if not repeats:
        return single.select("row.*", F.get("plan", F.lit(0))["copies"].alias(name))
    nth = F.row_number().over(Window.partitionBy("_d", "_s", "_n").orderBy(F.xxhash64("row.text")))
    many = found.withColumn("_nth", nth).select("row", F.expr("filter(plan, p -> p.idx = _nth)[0].copies").alias("_copies")).filter("_copies > 0")
    return many.select("row.*", F.col("_copies").alias(name))


def sizes_repeat(plan: DataFrame) -> bool:
    """Whether any rows share id, source and size (they then need telling apart by number)."""
    return bool(plan.filter((F.size("plan") > 1) | (F.get("plan", F.lit(0))["idx"] > 1)).limit(1).count())


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return plan_copies(document_sizes(docs)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
