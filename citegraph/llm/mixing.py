"""Operator 9: mixing sources to target weights by temperature.

A source with token share ``p`` gets the weight ``p**a / sum(p**a)``.  The exponent is
bisected: first for the largest `a` whose weights reach the target entropy (as a share of the
entropy of equal weights), then, if some source would be repeated more often than allowed, for the
smallest `a` that keeps within the limit.  The budget of a source is its weight
times the total budget; by default that is the smallest with which every source is passed once, so that no
document is lost.

A budget is realised as passes (epochs) over the source: whole passes, then a part of one.  Documents lie
in `BLOCKS` blocks by a hash of their id; the last pass takes whole blocks in the order of a permutation
drawn for source and pass, and of the block where the budget ends its documents in
hash order as long as they fit.  All draws are MD5 hashes, so the result is the same on every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import short_batches, stored

#: blocks of a source
BLOCKS = 4096
#: halvings of the exponent's interval
STEPS = 48
#: defaults of the mix
TARGET_ENTROPY, MAX_REPEATS, SEED = 0.97, 2.0, "mix"
#: exponents tried in one pass over the sources' totals; each pass halves the interval so many times
SECTIONS_LOG2 = 6


def n_words(text: Column) -> Column:
    """Words of a whole text (runs of other characters than ASCII white space); 0 if null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def _bisect(totals: DataFrame, good: Column, at_least: bool) -> float:
    """The end of [0, 1] nearest to the last exponent for which `good` (a condition on the columns a, entropy,
    most and least) holds: the largest such exponent if `at_least` holds below it, else the smallest.  Each
    pass over the totals tries 2**`SECTIONS_LOG2` - 1 inner points and keeps one section."""
    parts = 1 << SECTIONS_LOG2
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // SECTIONS_LOG2):
        step = (hi - lo) / parts
        points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo + i * step).alias("a")) for i in range(1, parts)]))
        tried = totals.select("p", points.alias("x")).select("x.i", "x.a", "p", F.pow("p", "x.a").alias("w"))
        sums = tried.groupBy("i", "a").agg(
            (F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("entropy"),
            (F.max(F.col("w") / F.col("p"))).alias("most"),
            (F.min(F.col("w") / F.col("p"))).alias("least"),
            F.sum("w").alias("total"),
        )
        held = [r.i for r in sums.where(good).select("i").collect()]  # at most `parts` rows
        if at_least:
            i = max(held, default=0)
            lo, hi = lo + i * step, lo + (i + 1) * step
        else:
            i = min(held, default=parts)
            lo, hi = lo + (i - 1) * step, lo + i * step
    return lo if at_least else hi


def source_budgets(sizes: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, epochs) from rows of (source, tokens); sources without tokens get weight 0 and
    one pass.  `budget` is in tokens."""
    sums = stored(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    whole = sums.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("k")).first()
    if not whole.t:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    totals = sums.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(whole.t)))

    def repeats_ok(most: str = "most") -> Column:
        if budget is None:
            return F.col("most") <= F.lit(max_repeats) * F.col("least")
        return F.lit(budget / whole.t) * F.col("most") <= F.lit(max_repeats) * F.col("total")

    a = _bisect(totals, F.col("entropy") >= F.lit(target_entropy * math.log(whole.k)), at_least=True) if whole.k > 1 else 1.0
    fits = _bisect(totals, repeats_ok(), at_least=False) if whole.k > 1 else 1.0
    a = round(max(a, fits), 10)
    weighed = totals.withColumn("w", F.pow("p", F.lit(a)))
    s = weighed.agg(F.sum("w").alias("total"), F.min(F.col("w") / F.col("p")).alias("least")).first()
    scale = 1 / s.least if budget is None else budget / whole.t / s.total
    out = weighed.select("source", "tokens", (F.col("w") / F.lit(s.total)).alias("weight"), (F.col("w") / F.col("p") * F.lit(scale)).alias("epochs"))
    return out.union(sums.where("coalesce(tokens, 0) = 0").select("source", F.lit(0).cast("long"), F.lit(0.0), F.lit(1.0)))


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None, seed: str = SEED,
) -> DataFrame:
    """The columns of `docs` with _epoch (1, 2, ...), _block and _tokens (which replace columns of these names): one
    row per pass in which a document is used.

    A null source is a source of its own.  Documents without words cost nothing and their source's passes hold
    them like any other; a source of such documents only is passed once.  Repeated rows, and rows with one id, lie
    in one block and are taken in the order of their length, then of their texts' hashes.  Rows with a null id are told apart
    by their texts.  An empty table gives no rows.
    The limits bind sources, not documents: with the default budget every document is used in the first pass.
    """
    short_batches(docs.sparkSession)
    text_mark = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    id_text, name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text|"), text_mark)), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_text.alias("id"), name.alias("source"),
        text_mark.alias("mark"), n_words(F.col(text_col).cast("string")).alias("n_tokens"), F.substring(_md5(seed, id_text), 1, 3).alias("block"),
    )
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens")), "blocks")  # at most `BLOCKS` rows a source
    plan = source_budgets(blocks, target_entropy, max_repeats, budget)
    plan = plan.select("source", "tokens", F.floor(F.col("epochs") + 1e-9).alias("full"), "epochs")
    plan = plan.withColumn("left", F.greatest(F.floor((F.col("epochs") - F.col("full")) * F.col("tokens") + 1e-6), F.lit(0)))
    draw = _md5(seed, F.col("source"), (F.col("full") + 1).cast("string"), F.col("block")).alias("draw")
    w = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = blocks.join(plan.where("left > 0"), "source").withColumn("draw", draw).withColumn("upto", F.sum("n_tokens").over(w))
    # where the last pass ends: the first block in its order that does not fit any more
    cut = drawn.where("upto > left").groupBy("source").agg(F.min(F.struct("draw", (F.col("left") - F.col("upto") + F.col("n_tokens")).alias("room"))).alias("c"))
    plan = stored(plan.join(cut, "source", "left").select("source", "full", F.col("c.draw").alias("last"), "c.room"), "plan")

    ready = rows.join(plan, "source").withColumn("draw", draw)
    by_doc = Window.partitionBy("source").orderBy(_md5(seed, (F.col("full") + 1).cast("string"), F.col("id")), "n_tokens", "mark")
    edge = ready.where("draw = last").withColumn("upto", F.sum("n_tokens").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("times", F.col("full") + (F.col("upto") <= F.col("room")).cast("int")).drop("upto")
    rest = ready.where("not (draw <=> last)").withColumn("times", F.col("full") + F.coalesce(F.col("draw") < F.col("last"), F.lit(False)).cast("int"))
    used = rest.unionByName(edge).where("times > 0")
    out = used.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_epoch"), F.col("block").alias("_block"), F.col("n_tokens").alias("_tokens"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("_epoch", "_block", "_tokens")], "_epoch", "_block", "_tokens")
