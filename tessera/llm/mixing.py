"""Operator 1: mixing sources to target weights by entropy balancing.

Each source has a token target. Rates nearest to one copy of each document (in bounded
relative entropy, between 0 and `cap` copies) that meet the target have the exponentially
tilted form cap * sigmoid(lambda * size / mean size), so the convex dual has one lambda a
source. Newton steps solve it for all sources at once: every iteration is one grouped sum
over the (source, size) histogram, which is pre-aggregated from all documents; sums are
decimal, so reruns agree to the last bit. Steps that leave the known bracket bisect it.

Rates are rounded into copies with error feedback: documents of a source fall in bins by
size class and a hash of the id, bins are walked from large documents to small ones, and
each bin takes the copies that bring the running total nearest to the running target, so
the error that remains is of the order of the smallest documents. A bin table has at most
256 rows a size class and source; no document-level sort or gathering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import own_prefix, sized
from tessera.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BINS = 256
UNIT = 1_000_000  # rates are whole millionths, so that their sums are exact


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(df: DataFrame, order: Column) -> DataFrame:
    """df, checkpointed, with `place`: its rows' numbers in the order, from 0. Rows are sorted in ranges; only the ranges' sizes meet in one task."""
    df = checkpoint(df.orderBy(order).withColumn("place", F.monotonically_increasing_id()))  # the range's number above 33 bits of the row's
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"))
    return df.withColumn("part", part).withColumn("row", row).join(F.broadcast(sizes), "part").withColumn("place", F.col("before") + F.col("row")).drop("part", "row", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size) rows.

    Sources in code point order, null last, have the weights in turn, repeating. They share
    `share` times all sizes; a target over `cap` times its source's size stops there and the
    excess goes to the others by weight, round after round until none is above. A round is
    three sums over the table, which has a row a source; however many there are, no task holds all.
    """
    if share > cap:
        raise ValueError("share must not be over cap: no such targets exist")
    s = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = checkpoint(s.select("source", "source_size", "n_docs", weight.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("top")))
    every = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None  # targets are level * weight where that is under the cap
    while True:
        stopped = F.lit(False) if full is None else F.col("top") <= F.lit(level) * F.col("w")
        n, held, w = s.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("top")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("w")))).first()
        if n == full or not w:
            break
        full, level = n, (share * every - held) / w
    target = F.col("top") if not w else F.least("top", F.lit(level) * F.col("w"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.lit(cap) / (F.lit(1.0) + F.exp(F.greatest(F.least(-lam * size / mean, F.lit(60.0)), F.lit(-60.0))))


def solve(hist: DataFrame, goal: DataFrame, cap: float = 2.0, tolerance: float = 1e-7, most_steps: int = 40) -> DataFrame:
    """goal with the dual solution lam a source (null where no source has tokens).

    hist: (source, size, n) with size over 0. Targets at the cap have no finite solution;
    lam is then the bracket's end, where every rate is at the cap.
    """
    mean = F.col("source_size") / F.col("n_pos")
    n_pos = hist.groupBy("source").agg(F.sum("n").alias("n_pos"))
    state = goal.join(n_pos, goal["source"].eqNullSafe(n_pos["source"])).select(goal["source"], "source_size", "target", mean.alias("mean"))
    edge = F.col("mean") * 60.0  # the least size is 1: every rate is 0 or the cap there
    state = state.withColumn("end", F.col("target") >= F.col("source_size") * F.lit(cap))
    state = checkpoint(state.withColumns({"lo": -edge, "hi": edge, "lam": F.when(F.col("end"), edge).otherwise(F.lit(0.0))}))
    exact = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")
    for _ in range(most_steps):
        r = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        tokens = F.col("n") * F.col("size") * r
        slope = tokens * (F.lit(1.0) - r / F.lit(cap)) * F.col("size") / F.col("mean")
        h, st = hist.alias("h"), sized(state).alias("st")
        sums = h.join(st, F.col("h.source").eqNullSafe(F.col("st.source"))).groupBy("st.source", "source_size", "target", "mean", "end", "lo", "hi", "lam").agg(exact(tokens).alias("have"), exact(slope).alias("slope"))
        g = F.col("have") - F.col("target")
        lo, hi = F.when(g <= 0, F.col("lam")).otherwise(F.col("lo")), F.when(g >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(g, F.col("slope"))
        nxt = F.when(step.isNotNull() & (step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        done = F.col("end") | (F.abs(g) <= F.lit(tolerance) * F.greatest("target", F.lit(1.0)))
        state = checkpoint(sums.select("source", "source_size", "target", "mean", "end", lo.alias("lo"), hi.alias("hi"), F.when(done, F.col("lam")).otherwise(nxt).alias("lam"), done.alias("done")))
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", "lam")


def _cls(size: Column) -> Column:
    """The size class: the bits of the size."""
    return F.length(F.bin(size))


def _bin(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BINS)).cast("int")


def _copies(walk: Column, target: Column, cap: int) -> Column:
    """The copies for each bin of an ordered array of structs (big, h, sz, want), as the best of three walks."""

    def go(first: float) -> Column:
        def step(acc, b):
            want = acc["want"] + b["want"]
            need = (want - acc["took"] * F.lit(float(UNIT))) / (b["sz"] * F.lit(float(UNIT)))
            # only for bins that are a large part of the target the walks differ: rounded to nearest, down or up
            lean = F.when(b["sz"] * F.lit(4.0) > acc["target"], F.lit(first)).otherwise(F.lit(0.5))
            k = F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(need + lean).cast("int")))
            return F.struct(acc["target"].alias("target"), want.alias("want"), (acc["took"] + k * b["sz"]).alias("took"), F.concat(acc["ks"], F.array(k)).alias("ks"))

        zero = F.struct(target.alias("target"), F.lit(0.0).alias("want"), F.lit(0).cast("long").alias("took"), F.array().cast("array<int>").alias("ks"))
        return F.aggregate(walk, zero, step, lambda a: F.struct(F.abs(a["took"] - a["target"]).alias("off"), a["ks"].alias("ks")))

    return F.array_min(F.array(go(0.5), go(0.0), go(0.999)))["ks"]


def plan(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """For (key, source, size) rows: (source, source_size, target, mean, lam) and (source, cls, h, copies)."""
    goal = checkpoint(targets(sizes, weights, share, cap))
    hist = checkpoint(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    dual = solve(hist, goal, cap)
    s, d = sizes.where("size > 0").alias("s"), sized(dual).alias("d")
    per_doc = s.join(d, F.col("s.source").eqNullSafe(F.col("d.source"))).select("s.source", "target", "size", _cls(F.col("size")).alias("cls"), _bin(F.col("key")).alias("h"), F.round(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap) * UNIT).cast("long").alias("rate"))
    bins = per_doc.groupBy("source", "target", "cls", "h").agg(F.sum("size").alias("sz"), F.sum(F.col("size").cast("decimal(20,0)") * F.col("rate")).cast("double").alias("want"))
    walk = bins.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("cls")).alias("big"), "h", "sz", "want"))).alias("walk"))
    chosen = walk.select("source", F.explode(F.arrays_zip(F.col("walk"), _copies(F.col("walk"), F.col("target"), cap).alias("k"))).alias("z"))
    copies = checkpoint(chosen.select("source", (-F.col("z.walk.big")).alias("cls"), F.col("z.walk.h").alias("h"), F.col("z.k").alias("copies")))
    every = goal.alias("g").join(dual.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")), "left").select("g.source", "g.source_size", "g.target", "d.mean", "d.lam")
    return checkpoint(every), copies


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, columns: list[str] | None = None) -> DataFrame:
    """docs (or only the named columns of it) with size, source_size, target, rate, copies and taken.

    size: words between ASCII blanks (null text: 0). copies: whole copies of the document the
    mix takes, from 0 to cap; taken = copies * size. Rows of size 0 have rate and copies 0. A
    null source is a source of its own, in last place. Rows that share a doc_id share a bin
    only, so repeated rows count each. Clashing columns of docs are replaced. No rows in, no
    rows out.
    """
    p = own_prefix(docs.columns)
    base = docs.select(F.xxhash64(F.col("doc_id")).alias(f"{p}key"), F.col("source").alias(f"{p}source"), n_words(F.col("text")).alias(f"{p}size"), *[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    if columns is not None:
        base = checkpoint(base)
        sizes = base
    else:  # the text stays where it is: sizes are kept beside it, and taken again when the copies are known
        sizes = checkpoint(base.select(f"{p}key", f"{p}source", f"{p}size"))
    sizes = sizes.select(F.col(f"{p}key").alias("key"), F.col(f"{p}source").alias("source"), F.col(f"{p}size").alias("size"))
    goal, copies = plan(sizes, weights, share, cap)
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in base.columns if not c.startswith(p) and c.lower() not in new]
    b, g, c = base.alias("b"), sized(goal).alias("g"), sized(copies).alias("c")
    on = F.col(f"b.{p}source").eqNullSafe(F.col("c.source")) & (_cls(F.col(f"b.{p}size")) == F.col("c.cls")) & (_bin(F.col(f"b.{p}key")) == F.col("c.h")) & (F.col(f"b.{p}size") > 0)
    out = b.join(g, F.col(f"b.{p}source").eqNullSafe(F.col("g.source"))).join(c, on, "left")
    n = F.coalesce(F.col("c.copies"), F.lit(0))
    rate = F.when(F.col(f"b.{p}size") > 0, _rate(F.col("g.lam"), F.col(f"b.{p}size"), F.col("g.mean"), cap)).otherwise(0.0)
    return out.select(*[F.col(f"b.`{k}`") for k in kept], F.col(f"b.{p}size").alias("size"), F.col("g.source_size").alias("source_size"), F.col("g.target").alias("target"), rate.alias("rate"), n.alias("copies"), (n * F.col(f"b.{p}size")).alias("taken"))
