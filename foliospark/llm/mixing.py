"""Mixing sources to target weights by entropy balancing, on DataFrame operations only.

Among all rates 0 <= r <= 3 that give every source its target of words, the one closest to
one copy a document (smallest sum of r log r - r) is r = min(3, exp(lambda_s * size)).  The
convex dual has one multiplier per source; each Newton step needs, per source, the sums of
size * r and size^2 * r.  Documents of one source and size have one rate, so the sums run
over the counts per (source, size), aggregated once with map-side combining.  The multipliers
stay in a table with a row a source; all sources take their steps in the same few jobs, each
inside a shrinking bracket, so a step that overshoots is replaced by the bracket's middle.

Rates are rounded inside groups of some hundred documents of a source, dealt by hash: the
largest document first, each takes the number of copies that brings the group's words
nearest to its running total, so what is left over is about half of a smallest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh, own_columns, stored

WORD = r"[^\x20\x09-\x0D]+"
#: weights of the sources in order, repeating
WEIGHTS = (1, 2, 3)
#: most copies of a document, and most words of a source in terms of its size
MOST = 3
#: documents rounded together, on average
GROUP = 256
TOLERANCE = 1e-7


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, the words of the text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n): one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share all words.  Where a
    share is over ``most`` times the source's size the target stops there, and the excess is
    shared again.  With sources ordered by size per weight, those that stop come first, and
    the level of the rest follows from running sums.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # one small row for each source
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    sources = sources.withColumn("bound", (most * F.col("source_size")).cast("double"))
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / F.sum("weight").over(rest))
    # the first source whose bound is above the level sets it for all from there on
    fits = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct((F.col("bound") / F.col("weight")).alias("at"), "level"))
    sources = sources.withColumn("first", F.min(fits).over(whole))
    share = F.col("first.level") * F.col("weight")
    target = F.when(F.col("first").isNull() | (share > F.col("bound")), F.col("bound")).otherwise(share)
    return sources.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def _rate(step, x, most):
    return F.least(F.lit(float(most)), F.exp(step * x))


def multipliers(sizes: DataFrame, targets: DataFrame, most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, step, scale): the rate of a document is min(most, exp(step * size / scale)).

    ``sizes`` is (source, size, n).  ``step`` is null where every document takes ``most``.
    """
    rows = sizes.filter("size > 0").join(targets, sizes["source"].eqNullSafe(targets["source"])).select(targets["source"], "size", "n", "source_size", "target")
    scale = rows.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    rows = rows.join(scale.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = stored(rows.withColumn("x", F.col("size") / F.col("scale")), "sizes")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = rows.groupBy("source").agg(
        F.first("scale").alias("scale"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.min("x").alias("least")
    )
    # at high every size has rate ``most``; at low nothing is left
    state = state.select(
        "source",
        "scale",
        "target",
        full.alias("full"),
        F.lit(0.0).alias("step"),
        (F.lit(-800.0) / F.col("least")).alias("low"),
        (F.lit(2.0) / F.col("least")).alias("high"),
        full.alias("done"),
    )
    state = stored(state, "dual")
    while state.filter(~F.col("done")).limit(1).count():
        state = stored(_newton(rows, state, most, tolerance), "dual")
    return state.select("source", F.when(~F.col("full"), F.col("step")).alias("step"), "scale")


def _newton(rows, state, most, tolerance):
    """One step of every source that is not done."""
    now = state.select(F.col("source").alias("s"), "step", "low", "high", "done", "full")
    both = rows.join(now.filter("not done"), F.col("source").eqNullSafe(F.col("s")))
    rate = _rate(F.col("step"), F.col("x"), most)
    words = F.col("n") * F.col("size") * rate
    sums = both.groupBy("s").agg(F.sum(words).alias("got"), F.sum(F.when(rate < most, words * F.col("x")).otherwise(0.0)).alias("slope"))
    joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    miss = F.col("got") - F.col("target")
    close = F.abs(miss) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
    low = F.when(miss < 0, F.col("step")).otherwise(F.col("low"))
    high = F.when(miss > 0, F.col("step")).otherwise(F.col("high"))
    joined = joined.withColumn("low", F.when(F.col("done"), F.col("low")).otherwise(low))
    joined = joined.withColumn("high", F.when(F.col("done"), F.col("high")).otherwise(high))
    newton = F.col("step") - F.try_divide(miss, F.col("slope"))
    inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
    moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    tight = F.col("high") - F.col("low") <= 1e-13 * F.abs(F.col("high"))
    joined = joined.withColumn("step", F.when(F.col("done") | close, F.col("step")).otherwise(moved))
    joined = joined.withColumn("done", F.col("done") | F.coalesce(close, F.lit(True)) | tight)
    return joined.select("source", "scale", "target", "full", "step", "low", "high", "done")


def _rounded(members):
    """Copies of the members (size, m, rate, …) of one group, largest first; m rows share a size.

    The running sum of rate * words minus the words taken so far is carried along.
    """
    zero = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("copies"))

    def step(acc, one):
        words = (one["size"] * one["m"]).cast("double")
        owed = acc["owed"] + one["rate"] * words
        copies = F.when(words > 0, F.least(F.greatest(F.round(owed / words), F.lit(0.0)), F.lit(float(MOST)))).otherwise(F.round(one["rate"]))
        return F.struct((owed - copies * words).alias("owed"), F.concat(acc["copies"], F.array(copies.cast("int"))).alias("copies"))

    return F.aggregate(members, zero, step)["copies"]


def copies_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """(doc_id, source, size, m, source_size, target, copies): one row for the m rows that agree in the first three.

    The rate of each is rounded to ``copies``, 0 to 3.  Texts without words have no size and
    take one copy.
    """
    rows = sized(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")))
    rows = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "sized")
    sizes = stored(rows.groupBy("source", "size").agg(F.sum("m").alias("n")), "counts")
    targets = stored(source_targets(sizes, weights), "targets")
    dual = multipliers(sizes, targets).withColumnRenamed("source", "d")
    held = sizes.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("docs"))
    per_source = targets.join(dual, F.col("source").eqNullSafe(F.col("d")), "left").drop("d")
    per_source = per_source.join(held, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    groups = F.ceil(F.col("docs") / GROUP)
    tilted = F.coalesce(_rate(F.col("step") / F.col("scale"), F.col("size"), MOST), F.lit(float(MOST)))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(tilted)
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.select("*", F.pmod(F.xxhash64("doc_id", "size"), groups).alias("grp"), rate.alias("rate"))
    member = F.struct((-F.col("size")).alias("by"), F.xxhash64("doc_id").alias("tie"), "doc_id", "size", "m", "rate")
    packed = rows.groupBy("source", "grp", "source_size", "target").agg(F.array_sort(F.collect_list(member)).alias("members"))
    packed = packed.withColumn("copies", _rounded(F.col("members")))
    flat = packed.select("source", "source_size", "target", F.explode(F.arrays_zip("members", "copies")).alias("one"))
    of = lambda name: F.col(f"one.members.{name}").alias(name)
    return flat.select(of("doc_id"), "source", of("size"), of("m"), "source_size", "target", F.col("one.copies").alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of ``docs``.

    ``taken`` is copies * size.  Null sources are one source, last in order.  Rows that agree
    in id, source and size get the same number of copies.  The result depends on the rows
    only, not on their order or partitions.  Other columns are not looked at.
    """
    flat = copies_of(docs, id_col, text_col, source_col, weights)
    flat = flat.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("row", "m")
    return flat.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as its number of copies; columns unchanged."""
    words, key, source, size, many, copy = fresh(docs.columns, "_words", "_key", "_source", "_size", "_many", "_copy")
    own = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    copies = copies_of(docs, id_col, text_col, source_col, weights).filter("copies > 0")
    copies = copies.select(*[F.col(c).alias(n) for c, n in (("doc_id", key), ("source", source), ("size", size), ("copies", many))])
    rows = docs.withColumn(words, own)
    same = F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).cast("string").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    rows = rows.join(copies, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many))))
    return rows.select(*own_columns(docs))
