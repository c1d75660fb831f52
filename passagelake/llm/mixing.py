"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document's expected copies are certain whole copies
plus a fraction, its inclusion probability p for one more copy. All documents get a random number
u, a hash of seed and document id; documents are ranked by the random odds u/(1-u) divided by the
inclusion odds p/(1-p), and the lowest ranks are taken as long as they fit into the source's
remaining words; the rest is closed by the one later document whose size is nearest to it. That is
a sample of fixed size, counted in words, with unequal probabilities.

Within a source the expected copies fall with the document's size class (a power of two words)
like 2**(-damping * class), so that very long documents do not crowd out the others, and are
scaled so that the expected words equal the target, none above max_copies.

Results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order. Rows with equal source, size and doc_id tie and are taken alike. An empty table gives an
empty result; if no document has a word all targets are 0. The same rows give the same result on
every run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import arrow_column, arrow_map, count_words, forget, written
from passagelake.llm.ranking import dense_rank, running_sums

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0
DAMPING = 0.25
SEED = 20240229


def sizes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and size: words of the whole text."""
    return arrow_map(docs, keep, [text], lambda x: {"size": pa.array(count_words(x[text]))}, [T.StructField("size", T.LongType())])


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size) with target: the total shared by weight, none above max_copies times its size.

    The common level c starts with all sources; sources whose weight times c is over their bound
    get the bound, and the rest is shared anew until no more sources reach theirs. Each round is
    one aggregate over one row for each source.
    """
    ranked = dense_rank(by_source, ["source"], "sources").withColumnRenamed("source", "ranked_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = written(by_source.join(ranked, by_source["source"].eqNullSafe(ranked["ranked_source"])).select("source", "source_size", weight.alias("weight")), "targets")
    bound = F.col("source_size") * float(max_copies)
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, at_bound = 0.0, -1
    while True:
        full = F.col("weight") * level > bound
        got = known.agg(F.sum(F.when(full, bound)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if got[2] == at_bound or not got[1]:
            break
        at_bound, level = got[2], max(0.0, total - (got[0] or 0.0)) / got[1]
    return known.select("source", "source_size", F.least(F.col("weight") * F.lit(level), bound).alias("target"))


def size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(F.lit(-1)).cast("int")


def relative(kind: Column, damping: float) -> Column:
    """Expected copies of a size class, before scaling."""
    return F.pow(F.lit(2.0), -F.lit(float(damping)) * kind)


def odds_rank(doc_id: Column, copies: Column, seed: int) -> Column:
    """Log of (u / (1 - u)) / (p / (1 - p)); null where p is 0, as no further copy can be taken."""
    drawn = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = copies - F.floor(copies)
    return F.when(p > 0, F.log(u / (1 - u)) - F.log(p / (1 - p)))


def plan(sized: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, damping: float = DAMPING, seed: int = SEED) -> DataFrame:
    """One row for each source: source_size, target, scale of the expected copies, the last (odds, doc_id) that is taken, and the closing one.

    sized: doc_id, source, size.
    """
    classes = written(sized.groupBy("source", size_class(F.col("size")).alias("kind")).agg(F.sum("size").alias("class_size")), "classes")
    by_source = written(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), "sizes")
    goal = targets(by_source, weights, max_copies).withColumnRenamed("source", "goal_source")
    # Classes in falling order of expected copies: with the first j at the bound, the rest are scaled to fill the target.
    joined = classes.filter("kind >= 0").join(goal, classes["source"].eqNullSafe(goal["goal_source"]))
    early = W.partitionBy("source").orderBy("kind")
    joined = joined.withColumn("rel", relative(F.col("kind"), damping))
    joined = joined.withColumn("bounded", F.coalesce(F.sum("class_size").over(early.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = joined.withColumn("open", F.sum(F.col("class_size") * F.col("rel")).over(early.rowsBetween(0, W.unboundedFollowing)))
    joined = joined.withColumn("scale", F.greatest(F.lit(0.0), F.col("target") - max_copies * F.col("bounded")) / F.col("open"))
    valid = F.col("scale") * F.col("rel") <= max_copies * (1 + 1e-12)
    scales = joined.groupBy("source").agg(F.min_by("scale", F.when(valid, F.col("kind"))).alias("scale")).withColumnRenamed("source", "scaled_source")
    scaled = written(goal.join(scales, goal["goal_source"].eqNullSafe(scales["scaled_source"]), "left").select(F.col("goal_source").alias("plan_source"), "source_size", "target", F.coalesce("scale", F.lit(1e300)).alias("scale")), "scales")

    drawn = with_copies(sized, scaled, max_copies, damping, seed).filter("size > 0")
    certain = drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain")).withColumnRenamed("source", "certain_source")
    sampled = running_sums(drawn.filter("odds is not null").select("doc_id", "source", "size", "odds"), [F.col("odds"), F.col("doc_id").asc_nulls_last()], "size", "source", "order")
    room = scaled.join(certain, scaled["plan_source"].eqNullSafe(certain["certain_source"])).select(F.col("plan_source").alias("room_source"), (F.col("target") - F.col("certain")).alias("room"))
    ranked = sampled.join(room, sampled["source"].eqNullSafe(room["room_source"]))
    fits = F.col("before") + F.col("size") <= F.col("room")
    mine = F.struct("odds", F.col("doc_id").isNull().alias("no_id"), "doc_id")
    cut = ranked.groupBy("source").agg(F.max(F.when(fits, mine)).alias("last"), (F.first("room") - F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0))).alias("gap"))
    cut = written(cut.withColumnRenamed("source", "last_source"), "cut")
    # What is left is closed by the one later document whose size is nearest, if that is nearer than none.
    rest = sampled.join(cut, sampled["source"].eqNullSafe(cut["last_source"])).filter(F.col("last").isNull() | (mine > F.col("last")))
    off = F.abs(F.col("size") - F.col("gap"))
    closing = rest.filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), mine.alias("mine"))).alias("best")).select(F.col("source").alias("closing_source"), F.col("best.mine").alias("closing"))
    out = scaled.join(cut, scaled["plan_source"].eqNullSafe(cut["last_source"]), "left")
    out = written(out.join(closing, out["plan_source"].eqNullSafe(closing["closing_source"]), "left").drop("last_source", "closing_source", "gap"), "plan")
    for x in (classes, by_source, scaled, sampled, cut):
        forget(x)
    return out


def with_copies(sized: DataFrame, plans: DataFrame, max_copies: float, damping: float, seed: int) -> DataFrame:
    """sized joined with its source's plan: whole (certain copies) and odds (rank for one more)."""
    joined = sized.join(plans, sized["source"].eqNullSafe(plans["plan_source"]), "left")
    copies = F.least(F.lit(float(max_copies)), F.col("scale") * relative(size_class(F.col("size")), damping))
    copies = F.when(F.abs(copies - F.round(copies)) < 1e-12, F.round(copies)).otherwise(copies)
    return joined.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long")).withColumn("odds", odds_rank(F.col("doc_id"), F.col("copies"), seed))


def draw(sized: DataFrame, plans: DataFrame, *, max_copies: float = MAX_COPIES, damping: float = DAMPING, seed: int = SEED) -> DataFrame:
    """sized (any columns, with doc_id, source, size) with source_size, target and n_copies by the plan."""
    names = [c for c in sized.columns if c not in ("source_size", "target", "n_copies")]
    x = with_copies(sized, plans, max_copies, damping, seed)
    mine = F.struct(F.col("odds"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    taken = F.coalesce(mine <= F.col("last"), F.lit(False)) | F.coalesce(mine == F.col("closing"), F.lit(False))
    more = (F.col("odds").isNotNull() & taken).cast("long")
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("whole"), F.lit(0)) + more).otherwise(0).cast("long")
    return x.select(*[sized[c] for c in names], plans["source_size"].cast("long").alias("source_size"), plans["target"].alias("target"), copies.alias("n_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents as the mix takes them: a row for each copy, with the columns of docs."""
    narrow = written(sizes(docs, ["doc_id", "source"]), "sized")
    plans = plan(narrow, **options)
    forget(narrow)
    size = arrow_column(lambda t: pa.array(count_words(t)), "long")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size("text").alias("size"))
    drawn = draw(whole, plans, **{k: v for k, v in options.items() if k != "weights"}).filter("n_copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("row.*")
