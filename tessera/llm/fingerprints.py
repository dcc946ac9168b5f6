"""Operator 5: document fingerprints from closed syncmers, in DataFrame functions only.

Words are hashed; a k-mer of K words is an anchor if the least of its inner S-word hashes
stands first or last in it. Whether a k-mer is one depends on its own words only, so equal
passages have equal anchors wherever they stand. All anchors are kept with their positions:
texts are compared by the share of anchors that both have and by how many stand at one
displacement. Beside them, the fingerprint is a short key of the SKETCH smallest distinct
32-bit anchor hashes (all, if there are fewer), so likeness between two fingerprints is the
usual bottom-sketch estimate of that share; with fewer anchors than SKETCH it is exact. A
text of fewer than K words has one anchor, all its words; one without words has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from tessera.llm.common import sized
from tessera.session import checkpoint, store

K, S = 5, 2
SKETCH = 128
#: Bits of a position beside a 32-bit hash.
POS = 31
#: Documents that a bucket is to have, and how many times as many it may have before it is cut again.
BUCKET_ROWS, HOT = 1_000, 8
LEAST_ID = -(1 << 63)
#: Adjacent blocks of ids, as a power of two, whose buckets are put in order together.
GROUP_BITS = 12


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: an array with, for each K-word place of the text, its 32-bit anchor hash, or null if it is no anchor."""
    w, h, s = f"__{out}_w", f"__{out}_h", f"__{out}_s"
    n = F.size(h)
    df = df.withColumn(w, F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(s, F.transform(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col(h), i + 1))))

    def anchor(x, i):
        edge = F.least(F.get(F.col(s), i), F.get(F.col(s), i + K - S))
        inner = F.least(*[F.get(F.col(s), i + j) for j in range(1, K - S)])
        return F.when(edge <= inner, F.shiftrightunsigned(F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, K)]), 32))

    many = F.transform(F.slice(h, 1, F.greatest(n - (K - 1), F.lit(0))), anchor)
    few = F.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 32))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(n >= K, many).otherwise(few)).drop(w, h, s)


def hashes(keys: Column) -> Column:
    """The distinct anchor hashes of placed anchors."""
    return F.array_distinct(F.transform(keys, lambda x: F.shiftright(x, POS)))


def sketch(distinct: Column) -> Column:
    return F.slice(F.sort_array(distinct), 1, SKETCH)


def as_text(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches: the share of the smallest SKETCH of their union that both have; two empty ones are equal."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def placed(anchors: Column) -> Column:
    """The anchors with their positions as single numbers, the hash above POS bits of position."""
    return F.array_compact(F.transform(anchors, lambda x, i: F.shiftleft(x, POS).bitwiseOR(i.cast("long"))))


def share(a: Column, b: Column) -> Column:
    """Of two texts' distinct anchor hashes: those that both have as a share of all; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_displacement(df: DataFrame, a: str, b: str, shift: str, aligned: str) -> DataFrame:
    """df with the displacement from a to b of most anchors that both have, and the number of anchors shared at it.

    a and b hold placed anchors. The displacement is the commonest between first occurrences
    (of several the shortest, then the one to the right); null if no anchor is shared. At it all anchors count.
    """
    c, d, e = f"__{shift}_c", f"__{shift}_d", f"__{shift}_e"
    side = lambda k, bit: F.transform(k, lambda x: F.shiftleft(F.shiftright(x, POS), 32).bitwiseOR(x.bitwiseAND(F.lit((1 << POS) - 1))).bitwiseOR(F.lit(bit << POS)))
    df = df.withColumn(c, F.sort_array(F.concat(side(F.col(a), 0), side(F.col(b), 1))))
    # the first of each hash and side; then a's is followed by b's
    df = df.withColumn(c, F.filter(c, lambda x, i: (i == 0) | (F.shiftright(x, POS) != F.shiftright(F.get(F.col(c), i - 1), POS))))
    pos = lambda x: x.bitwiseAND(F.lit((1 << POS) - 1))

    def moved(x, i):
        other = F.get(F.col(c), i + 1)
        return F.when(F.shiftright(x, 32) == F.shiftright(other, 32), pos(other) - pos(x))

    df = df.withColumn(d, F.sort_array(F.array_compact(F.transform(c, moved))))
    last = lambda x, i: F.when(~x.eqNullSafe(F.get(F.col(d), i + 1)), F.struct(i.alias("i"), x.alias("x")))
    df = df.withColumn(e, F.array_compact(F.transform(d, last)))  # the ends of runs of one displacement
    run = lambda y, j: F.struct((y["i"] - F.coalesce(F.get(F.col(e), j - 1)["i"], F.lit(-1))).alias("n"), (-F.abs(y["x"])).alias("near"), y["x"].alias("x"))
    df = df.withColumn(shift, F.array_max(F.transform(e, run))["x"]).drop(c, d, e)
    met = F.size(F.array_intersect(F.transform(a, lambda x: x + F.col(shift)), F.col(b)))
    return df.withColumn(aligned, F.when(F.col(shift).isNull(), F.lit(0)).otherwise(met))


def _bits(n: Column) -> Column:
    return F.length(F.bin(n))


def _cut(rows: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, id, text, th, u) rows with `bucket`, an array of numbers in the order of (id, th, u), and how often hot ones were cut.

    A bucket is a block of adjacent ids. Those that hold too many rows are cut by finer blocks
    of ids, by the texts' hashes where all ids are equal, and by row where the texts are too.
    """
    n, lo, hi = rows.where("doc_id IS NOT NULL").agg(F.count("*"), F.min("id"), F.max("id")).first()
    shift = max(0, ((hi - lo + 1) // max(1, n // BUCKET_ROWS)).bit_length() - 1) if n else 0
    rows, rounds, stored = rows.withColumn("bucket", F.array(F.shiftright("id", min(shift, 63)))), 0, False
    hot = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT * BUCKET_ROWS).select("bucket"))
    while not hot.isEmpty():
        rounds += 1
        span = lambda c: F.min(c).bitwiseXOR(F.max(c)).alias(f"{c}_span")
        inner = rows.join(sized(hot), "bucket").groupBy("bucket").agg(F.count("*").alias("n"), span("id"), span("th"), span("u"))
        by = F.when(F.col("id_span") != 0, "id").when(F.col("th_span") != 0, "th").otherwise("u")
        spread = F.when(F.col("id_span") != 0, F.col("id_span")).when(F.col("th_span") != 0, F.col("th_span")).otherwise(F.col("u_span"))
        parts = _bits(F.floor(F.col("n") / BUCKET_ROWS).cast("long"))  # cut at the first bit that differs, so each round cuts
        rule = checkpoint(inner.select("bucket", by.alias("by"), F.greatest(_bits(spread) - parts, F.lit(0)).cast("int").alias("shift")))
        if not stored and not rule.where("by = 'u'").isEmpty():
            rows, stored = store(rows), True  # u must stay as it is from here on, also where an executor is lost
        finer = F.expr("shiftright(CASE by WHEN 'id' THEN id WHEN 'th' THEN th ELSE u END, shift)")
        rows = rows.join(sized(rule), "bucket", "left").withColumn("bucket", F.when(F.col("by").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.array(finer)))).drop("by", "shift")
        hot = checkpoint(rows.where(F.size("bucket") > rounds).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT * BUCKET_ROWS).select("bucket"))
    return rows, rounds


def _with_taker(tops: DataFrame) -> DataFrame:
    """tops with `taker`: the next bucket in order, of the last one the first. Buckets are put in order group by group, then the groups."""
    tops = tops.withColumn("g", F.shiftright(F.get("bucket", F.lit(0)), GROUP_BITS))
    firsts = tops.groupBy("g").agg(F.min("bucket").alias("lo"))
    up = Window.orderBy("g")
    firsts = firsts.select("g", F.coalesce(F.lead("lo").over(up), F.first("lo").over(up)).alias("next"))
    return tops.join(sized(checkpoint(firsts)), "g").withColumn("taker", F.coalesce(F.lead("bucket").over(Window.partitionBy("g").orderBy("bucket")), "next")).drop("g", "next")


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, id, text, th, bucket, copy): rows dealt into buckets of adjacent ids.

    Within a bucket, by copy and then id, th and u descending, each row of copy 0 is followed by the next
    document in descending id: the first rows of the next lower bucket are there again, as
    copy 1 (of the highest bucket for the lowest). Only ids are looked at to cut the buckets,
    and hashes of texts where many rows share an id.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, so that next documents are defined; it is {kind.simpleString()}")
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text")).withColumn("u", F.xxhash64(F.monotonically_increasing_id()))
    base, rounds = _cut(base)
    # of a bucket's rows the first goes to the one before it; rows that share its id go along, unless those may be many
    key = F.struct("id", "th", "u") if rounds else F.col("id")
    tops = checkpoint(_with_taker(base.groupBy("bucket").agg(F.max(key).alias("top"))))
    own = F.struct("bucket", F.lit(0).alias("copy"))
    places = F.when(key == F.col("top"), F.array(own, F.struct(F.col("taker").alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = base.join(sized(tops), "bucket").withColumn("p", F.explode(places))
    return dealt.select("doc_id", "id", "text", "th", "u", F.col("p.bucket").alias("bucket"), F.col("p.copy").alias("copy"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row of docs each: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id, anchors, and for `edited` and `next` share_, shift_ and aligned_.

    anchors: all of the text's, array of (pos, anchor) in order. share_: the part of all
    anchors that both texts have; shift_ and aligned_: their displacement and the anchors
    shared at it, as of with_displacement(). fingerprint and near_ are the short key and its
    estimate of share_.

    A null text is empty: no characters, no anchors, fingerprint "". Ids in descending order,
    null last; rows of one id in descending order of their texts' hashes, so equal rows are each
    other's next. A single row is its own next. The edited text has the first characters of
    the next document for its own last half. Empty tables stay empty; other columns aren't
    looked at. Ids must be whole numbers; others raise a TypeError.
    """
    dealt = with_next(docs).repartitionByRange("bucket")  # the one shuffle of the texts; anchors are taken after it. Ranges, as hashes of so few buckets are uneven
    dealt = with_anchors(dealt, "text", "a").withColumn("ka", placed(F.col("a"))).drop("a")
    w = Window.partitionBy("bucket").orderBy("copy", F.col("id").desc(), F.col("th").desc(), F.col("u").desc())
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = dealt.select("doc_id", "copy", "text", "ka", F.lead("text").over(w).alias("nt"), F.lead("ka").over(w).alias("kn"), F.lead("doc_id").over(w).alias("next_id")).where("copy = 0")
    df = df.select("doc_id", "next_id", "ka", "kn", n.cast("long").alias("n_chars"), F.concat(F.left(F.col("text"), n - half), F.left(F.col("nt"), half)).alias("edited"))
    df = with_anchors(df, "edited", "e").withColumn("ke", placed(F.col("e"))).drop("e")
    for k, d, sk in (("ka", "da", "sk"), ("kn", "dn", "nsk"), ("ke", "de", "esk")):
        df = df.withColumn(d, hashes(F.col(k))).withColumn(sk, sketch(F.col(d)))
    df = with_displacement(df, "ka", "ke", "shift_edited", "aligned_edited")
    df = with_displacement(df, "ka", "kn", "shift_next", "aligned_next")
    every = F.transform("ka", lambda x: F.struct(x.bitwiseAND(F.lit((1 << POS) - 1)).cast("int").alias("pos"), F.shiftright(x, POS).alias("anchor")))
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("esk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("esk")).alias("near_edited"), likeness(F.col("sk"), F.col("nsk")).alias("near_next"), "next_id", every.alias("anchors"),
        share(F.col("da"), F.col("de")).alias("share_edited"), "shift_edited", "aligned_edited", share(F.col("da"), F.col("dn")).alias("share_next"), "shift_next", "aligned_next",
    )


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, anchor): each anchor with its first word's number, for matching by position."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_anchors(base, "text", "a").select("id", F.posexplode("a").alias("pos", "anchor")).where("anchor IS NOT NULL")


def shared_passages(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """(left_id, right_id, shift, n): anchors that two documents share at one displacement, `least` of them or more.

    left is a stated query set, right is matched against it by an equi-join on the anchor.
    """
    a = anchors(left).select(F.col("id").alias("left_id"), F.col("pos").alias("p"), "anchor")
    b = anchors(right).select(F.col("id").alias("right_id"), F.col("pos").alias("q"), "anchor")
    return a.join(b, "anchor").where("left_id <> right_id").groupBy("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
