"""Hybrid retrieval: BM25 by postings, cosine by blocked products, top-k a source and overall.

The index is two tables: postings (source_key, chunk_no, term, tf, dl) and, a row a source
and term, the statistics. Queries are a table of any number of rows; a single question is
the one-row case.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.vectors import similarities
from tessera.session import small, store

K1, B, EPSILON = 1.5, 0.75, 0.25
WEIGHT, THRESHOLD, PER_SOURCE, OVERALL, PENALTY = 0.2, 0.35, 4, 12, 0.4
LEAST_CHARS = 40
#: 64-bit words of a set's parity bitmap.
BITMAP = 4


def chunk_text(section: Column, title: Column, part: Column, content: Column) -> Column:
    """`section (part): title`, a blank line, the content; missing parts left out."""
    s, t, p = (T.strip(F.coalesce(c, F.lit(""))) for c in (section, title, part))
    head = F.concat(s, F.when(p != "", F.concat(F.lit(" ("), p, F.lit(")"))).otherwise(""), F.when(t != "", F.concat(F.lit(": "), t)).otherwise(""))
    return F.when(F.regexp_replace(head, "^[: ]+|[: ]+$", "") != "", F.concat(head, F.lit("\n\n"), content)).otherwise(content)


def chunk_type(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("[VISUAL DESCRIPTION]")), "visual").when(F.contains(text, F.lit("[TABLE]")), "table").otherwise("text")


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Processed chunks of LEAST_CHARS characters or more, with their index text and type."""
    content = T.strip(F.coalesce("content", F.lit("")))
    out = chunks.where(F.length(content) >= LEAST_CHARS).withColumn("text", chunk_text(F.col("section"), F.col("section_title"), F.col("part"), content))
    return out.withColumn("chunk_type", chunk_type(F.col("text")))


def postings(chunks: DataFrame) -> DataFrame:
    """(source_key, chunk_no, term, tf, dl) of (source_key, chunk_no, text)."""
    t = chunks.select("source_key", "chunk_no", T.tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    return t.select("source_key", "chunk_no", "dl", F.explode("t").alias("term")).groupBy("source_key", "chunk_no", "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(chunks: DataFrame, posts: DataFrame) -> DataFrame:
    """(source_key, term, df, n_chunks, avgdl, idf): Okapi idf, negative ones raised to EPSILON times the source's mean."""
    words = posts.groupBy("source_key").agg(F.sum("tf").alias("words"))  # so that texts are cut into words only once
    size = chunks.groupBy("source_key").agg(F.count("*").alias("n_chunks")).join(words, "source_key").withColumn("avgdl", F.col("words") / F.col("n_chunks")).drop("words")
    return weigh_terms(posts.groupBy("source_key", "term").agg(F.count("*").alias("df")), size)


def weigh_terms(df: DataFrame, size: DataFrame) -> DataFrame:
    """df (source_key, term, df) with (n_chunks, avgdl) of its source, from size, and idf."""
    df = df.join(size, "source_key")
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.groupBy("source_key").agg(F.avg(raw).alias("mean"))
    return df.join(mean, "source_key").select("source_key", "term", "df", "n_chunks", "avgdl", F.when(raw < 0, EPSILON * F.col("mean")).otherwise(raw).alias("idf"))


def bm25(queries: DataFrame, chunks: DataFrame, posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, source_key, chunk_no, bm25) where a query word occurs; repeated words count again.

    Postings of query words get their part of a score and go to their chunk's partition, a row
    a chunk and word; they meet the queries, and are summed up, only there.
    """
    posts = store(postings(chunks)) if posts is None else posts  # read twice below
    stats = term_stats(chunks, posts) if stats is None else stats
    q = store(queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    asked_for = small(store(q.select("term").distinct()))
    weights = small(store(stats.join(asked_for, "term", "left_semi").select("source_key", "term", "avgdl", "idf")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = posts.join(asked_for, "term", "left_semi").join(weights, ["source_key", "term"]).select("source_key", "chunk_no", "term", part.alias("part"))
    hit = parts.repartition("source_key", "chunk_no").join(small(q), "term")
    return hit.groupBy("query_id", "source_key", "chunk_no").agg(F.sum(F.col("qtf") * F.col("part")).alias("bm25"))


#: Chunks of a cell of a source's postings, and of a block, which has one upper bound a term.
CELL, BLOCK = 4096, 8


def impacts(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(source_key, cell, term, chunks, parts): posting lists of up to CELL chunks each with every chunk's part of a BM25 score, sorted by chunk.

    A source's chunks are dealt over cells by hash, so a source of any size is many lists.
    """
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    cell = F.pmod(F.xxhash64("chunk_no"), F.ceil(F.col("n_chunks") / CELL)).cast("int")
    df = posts.join(stats.select("source_key", "term", "n_chunks", "avgdl", "idf"), ["source_key", "term"]).select("source_key", cell.alias("cell"), "term", "chunk_no", part.alias("part"))
    rows = F.array_sort(F.collect_list(F.struct("chunk_no", "part")))
    return df.groupBy("source_key", "cell", "term").agg(rows.alias("r")).select("source_key", "cell", "term", F.col("r.chunk_no").alias("chunks"), F.col("r.part").alias("parts"))


class Postings:
    """The lists of a cell over its chunks' places, with the greatest part of each block."""

    def __init__(self, lists: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.chunks = np.unique(np.concatenate([c for c, _ in lists.values()]))
        self.blocks = -(-len(self.chunks) // BLOCK)
        self.of = {}
        for term, (chunks, parts) in lists.items():
            at = np.searchsorted(self.chunks, chunks)
            most = np.zeros(self.blocks)
            np.maximum.at(most, at // BLOCK, parts)
            self.of[term] = (at, parts, most)

    def best(self, terms: list[tuple[str, int]], k: int, digits: int = 6) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(chunks, scores) of the k best by (rounded score, chunk), the postings scored, and all postings of the terms.

        Lists are taken from the one that can give most. A posting is scored only if its chunk,
        with what it has so far and what its block can still get, may reach the k-th best so
        far; parts below zero are taken first, so that what is had never falls again.
        """
        mine = [(at, n * part, n * most) for t, n in terms if t in self.of for at, part, most in [self.of[t]]]
        below = [x for x in mine if x[1].min() < 0]
        above = sorted((x for x in mine if x[1].min() >= 0), key=lambda x: -x[2].max())
        have, seen = np.zeros(len(self.chunks)), np.zeros(len(self.chunks), bool)
        scored = 0
        for at, part, _ in below:
            have[at] += part
            seen[at] = True
            scored += len(at)
        rest = np.zeros((len(above) + 1, self.blocks))
        if above:
            rest[:-1] = np.cumsum([x[2] for x in above][::-1], axis=0)[::-1]
        floor, whole, at_least = -np.inf, np.zeros(len(self.chunks), bool), 1
        for i, (at, part, _) in enumerate(above):
            hope = (have[at] + rest[i][at // BLOCK] >= floor - 2e-6) & ~whole[at]
            at = at[hope]
            have[at] += part[hope]
            seen[at] = True
            scored += len(at)
            if i + 1 >= at_least and seen.sum() >= k:  # ever more seldom: the most hopeful chunks are scored whole, which raises the floor
                at_least *= 2
                open_ = np.flatnonzero(seen & ~whole)
                if len(open_):
                    hopeful = have[open_] + rest[i + 1][open_ // BLOCK]
                    top = open_[np.argpartition(hopeful, -min(k, len(open_)))[-k:]]
                    for later, more, _ in above[i + 1 :]:
                        j = np.minimum(np.searchsorted(later, top), len(later) - 1)
                        hit = later[j] == top
                        have[top[hit]] += more[j[hit]]
                        scored += int(hit.sum())
                    whole[top] = True
                known = have[seen]
                floor = max(floor, np.partition(known, -k)[-k])
        at = np.flatnonzero(seen)
        order = np.lexsort((self.chunks[at], -np.floor(have[at] * 10**digits + 0.5)))[:k]
        return self.chunks[at[order]], have[at[order]], scored, sum(len(x[0]) for x in mine)


def bm25_best(queries: DataFrame, chunks: DataFrame, k: int, posts: DataFrame | None = None, stats: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """(query_id, source_key, chunk_no, bm25): for each query at least the k best chunks of each source, at most k a cell; rank them to cut.

    A cell's lists come first in a sorted stream, then the queries, so a task holds one cell,
    whose size is bounded, and no query set is gathered. chunk_no and query_id are whole
    numbers. counted: instead (scored, matched) postings a task.
    """
    posts = store(postings(chunks)) if posts is None else posts  # read twice below
    stats = store(term_stats(chunks, posts)) if stats is None else stats
    words = store(queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n")))
    asked_for = small(store(words.select("term").distinct()))
    lists = impacts(posts.join(asked_for, "term", "left_semi"), stats)
    cells = stats.groupBy("source_key").agg(F.ceil(F.max("n_chunks") / CELL).cast("int").alias("cells")).select("source_key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    asked = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("t"))
    asked = cells.join(asked)  # the stated query set against all cells
    none = lambda kind: F.lit(None).cast(kind)
    stream = lists.select("source_key", "cell", F.lit(0).alias("tag"), none("long").alias("query_id"), F.array("term").alias("terms"), F.col("chunks").cast("array<long>").alias("nos"), "parts")
    stream = stream.unionByName(asked.select("source_key", "cell", F.lit(1).alias("tag"), F.col("query_id").cast("long").alias("query_id"), F.col("t.term").alias("terms"), F.col("t.n").alias("nos"), none("array<double>").alias("parts")))
    stream = stream.repartition("source_key", "cell").sortWithinPartitions("source_key", "cell", "tag", "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, built = None, {}, None
        done = matched = 0
        for batch in batches:
            source, cell, tag, query, terms = (batch.column(i).to_pylist() for i in range(5))
            nos, parts = batch.column(5), batch.column(6)
            out = []
            for i in range(len(batch)):
                if (source[i], cell[i]) != now:
                    now, lists, built = (source[i], cell[i]), {}, None
                if tag[i] == 0:
                    lists[terms[i][0]] = (np.asarray(nos[i].values), np.asarray(parts[i].values))
                    continue
                if built is None:
                    if not lists:
                        continue
                    built = Postings(lists)
                found, score, n, every = built.best(list(zip(terms[i], nos[i].as_py())), k)
                done, matched = done + n, matched + every
                out += [(query[i], source[i], int(c), float(s)) for c, s in zip(found, score)]
            if not counted:
                cols = list(zip(*out)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema.field(0).type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["query_id", "source_key", "chunk_no", "bm25"])
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([matched], pa.int64())], ["scored", "matched"])

    return stream.mapInArrow(run, "scored long, matched long" if counted else "query_id long, source_key string, chunk_no long, bm25 double")


def _top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def hybrid(queries: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD, weight: float = WEIGHT, boosts: DataFrame | None = None) -> DataFrame:
    """(query_id, source_key, chunk_no, digest, score) of candidates at the threshold or over it; digest: of the text, which is left where it is.

    queries: (query_id, text, lang, embedding), a stated set, whose vectors are gathered.
    score = (1-w) cosine + w bm25 / the source's best; w is 0 for Malay queries; chunks on
    companies by guarantee count PENALTY for queries that don't mention them. Rows whose
    cosine can't reach the threshold even with the best BM25 are dropped where they are read.
    boosts: (query_hash, section_parent, delta) adds to chunks of that section; off by default.
    """
    vectors = [(r.query_id, r.embedding) for r in queries.select("query_id", "embedding").where("embedding IS NOT NULL").collect()]
    most_boost = 0.0 if boosts is None else max(0.0, boosts.agg(F.max("delta")).first()[0] or 0.0)
    floor = (threshold - weight - most_boost) / (1 - weight)
    keep = ["source_key", "chunk_no", "digest", "clbg"] + (["section"] if boosts is not None else [])
    rows = chunks.withColumns({"digest": F.unhex(F.md5(F.col("text").cast("binary"))), "clbg": T.mentions_clbg(F.col("text"))})
    near = similarities(vectors, rows, floor - 1e-9, keep)
    words = bm25(queries, chunks)
    best = small(store(words.groupBy("query_id", "source_key").agg(F.max("bm25").alias("best"))))
    words = words.join(best, ["query_id", "source_key"])
    lexical = F.coalesce(F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(F.col("bm25")), F.lit(0.0))
    q = queries.select("query_id", F.when(F.col("lang") == "ms", 0.0).otherwise(weight).alias("w"), T.mentions_clbg(F.col("text")).alias("asks"), T.query_hash(F.col("text")).alias("query_hash"))
    df = near.join(words, ["query_id", "source_key", "chunk_no"], "left").join(q, "query_id")
    score = (1 - F.col("w")) * F.col("cosine") + F.col("w") * lexical
    score = F.when(~F.col("asks") & F.col("clbg"), score * PENALTY).otherwise(score)
    if boosts is not None:
        b = boosts.select("query_hash", T.normal_section(F.col("section_parent")).alias("sec"), "delta")
        df = df.withColumn("sec", T.normal_section(F.col("section"))).join(b, ["query_hash", "sec"], "left")
        score = score + F.coalesce("delta", F.lit(0.0))
    return df.withColumn("score", score).where(F.col("score") >= threshold).select("query_id", "source_key", "chunk_no", "digest", "score")


def prune_sources(queries: DataFrame, sources: DataFrame, selected: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """(query_id, source_key): enabled sources that a query may search. A source with acts is left out for another act's query."""
    s = sources.where("enabled")
    if selected is not None:
        s = s.where(F.col("key").isin(selected))
    if categories:
        s = s.where(F.col("category").isin(categories))
    q = queries.select("query_id", T.detect_act(F.col("text")).alias("act"))
    fits = F.col("act").isNull() | (F.size("relates_to_acts") <= 0) | F.array_contains("relates_to_acts", F.col("act"))
    return q.join(small(s.select("key", "relates_to_acts")), fits).select("query_id", F.col("key").alias("source_key"))


def search(queries: DataFrame, chunks: DataFrame, allowed: DataFrame | None = None, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(query_id, rank, source_key, chunk_no, score, text): PER_SOURCE best of each source, equal texts once, OVERALL best.

    Ties: higher score, then source, then chunk number.
    """
    hits = hybrid(queries, chunks, threshold, **options)
    if allowed is not None:
        hits = hits.join(allowed, ["query_id", "source_key"], "left_semi")
    order = [F.desc("score"), "source_key", "chunk_no"]
    hits = _top(hits, ["query_id", "source_key"], order, PER_SOURCE, "in_source")
    hits = _top(hits, ["query_id", "digest"], order, 1, "copy")
    best = store(_top(hits, ["query_id"], order, OVERALL).select("query_id", "rank", "source_key", "chunk_no", "score"))
    return small(best).join(chunks.select("source_key", "chunk_no", "text"), ["source_key", "chunk_no"]).select("query_id", "rank", "source_key", "chunk_no", "score", "text")


def summary(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, citations, categories_hit, found): source names and categories in order of first appearance."""
    r = ranked.join(sources.select(F.col("key").alias("source_key"), "name", "category"), "source_key")
    first = lambda c: F.transform(F.array_sort(F.collect_set(F.struct("at", c))), lambda x: x[c])
    once = lambda c: r.groupBy("query_id", c).agg(F.min("rank").alias("at")).groupBy("query_id").agg(first(c).alias(c))
    return once("name").join(once("category"), "query_id").select("query_id", F.col("name").alias("citations"), F.col("category").alias("categories_hit"), F.lit(True).alias("found"))


def section_frequency(ranked: DataFrame) -> DataFrame:
    """(query_id, parent, child, chunks): how many of a query's chunks mention each section."""
    refs = ranked.select("query_id", F.explode(T.section_refs(F.col("text"))).alias("r"))
    return refs.groupBy("query_id", "r.parent", "r.child").agg(F.count("*").alias("chunks"))


def dedupe_exact(docs: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Of rows with equal text the first in order, with digest and copies.

    The grouped minimum, a row a text, is stored and meets the rows on what it chose, the
    digest and the order, so the copies of one text are dealt out by their order.
    """
    d = docs.withColumn("digest", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    first = store(d.groupBy("digest").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies")))
    first = first.select("digest", "copies", *[F.col(f"first.{c}").alias(c) for c in order])
    on = d["digest"] == first["digest"]
    for c in order:
        on = on & d[c].eqNullSafe(first[c])
    return d.join(first, on).select(*[d[c] for c in d.columns], first["copies"])


#: Tokens before one of a prefix that go with it, and the most tokens of a cell of pairs, a set counted for each of its pairs.
BEFORE, PAIRED = 4, 1 << 23
#: Tokens from which on a set has a second, longer bitmap, as the first would be full.
WIDE = 512
#: Bytes of text whose tokens get codes together (one text has its own, if it is longer), and of prefix rows that are handed on together.
CODED, HANDED_ON = 1 << 24, 1 << 24
CODE = np.dtype(np.int32)
#: Bits for the band of a set's size beside a token's number, one more than the bands need.
BANDS = 13
#: The bytes of tokens.
TOKEN = np.zeros(256, bool)
TOKEN[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, jaccard): pairs of classes of equal token sets, by their smallest keys, whose overlap is over `least`.

    A prefix-filtered set join: tokens are numbered from rare to frequent, and two sets over
    the bound share one of their first |s| - ceil(least |s|) + 1 tokens. A pair counts at the
    first token that it shares: with what may still follow, this must suffice for the overlap,
    and a prefix token brings those before it, so that a pair's later meetings are known and
    dropped where they occur. Of the smaller set, still fewer tokens do; and sets meet by token
    and band of sizes, each of 1 / least, the smaller ones in their own band and the next, so
    that few meet whose sizes rule them out. Sets whose parity bitmaps, which grow with them, differ in more
    bits than they may have tokens of their own are no pair. Only then are the sets compared,
    in cells of pairs to which a set goes once. Rows of equal sets are one class, never paired.

    Texts become sets of codes where they are read, some megabytes of text at a time, with a
    row for each code and its token: these meet the tokens' numbers, and then the sets of their
    codes, so no row a text and token is made or shuffled. Sets are the bytes of their numbers:
    each row of a list costs Spark a pass over its batch's lists when it hands them to Python.
    """
    lower = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).cast("binary").alias("t"), F.monotonically_increasing_id().alias("row")).where("k IS NOT NULL AND t IS NOT NULL")
    kind = lower.schema["k"].dataType.simpleString()
    coded = store(lower.mapInArrow(_coded, f"k {kind}, row long, digest binary, batch long, codes binary, code int, term string"))
    sets, terms = coded.where("code IS NULL").select("k", "row", "digest", "batch", "codes"), coded.where("code IS NOT NULL").select("batch", "code", "term")
    first = store(sets.groupBy("digest").agg(F.min(F.struct("k", "row")).alias("x"), F.count("*").alias("rows")).where("rows > 1").select("digest", "x.row"))
    copies = store(sets.select("digest", "row").join(small(first.withColumnRenamed("row", "kept")), "digest").where("row <> kept").select("row"))
    classes = sets.join(small(copies), "row", "left_anti").select("batch", "k", "codes")  # the sets themselves stay where they are
    counts = _by_batch(classes.select("batch", "codes"), terms).mapInArrow(_counted, "term string, df long")
    # a token of one set only is shared with none: it counts by its absence
    number = _numbers(counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 1"))
    no = number.schema["no"].dataType.simpleString()
    stream = _by_batch(terms.join(number, "term").drop("term"), classes)
    width = np.dtype(np.int32 if no == "int" else np.int64)
    numbered = store(stream.mapInArrow(lambda batches: _numbered(batches, width), f"k {kind}, n int, s binary"))
    # own tokens come first in the order, as they are the rarest
    bits = [f"b{i}" for i in range(BITMAP)]
    row = f"k {kind}, n int, own int, {' long, '.join(bits)} long, wide array<long>, at int, place long, before array<{no}>"
    a, b = (numbered.mapInArrow(lambda batches, smaller=smaller: _prefixes(batches, least, width, smaller), row).alias("a" if smaller else "b") for smaller in (True, False))
    need = least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-9
    size = (F.col("b.n") * least <= F.col("a.n")) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.k") < F.col("b.k"))))
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    most = (1 - least) / (1 + least) * (F.col("a.n") + F.col("b.n")) + 1e-9 - F.col("a.own") - F.col("b.own")
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in bits), F.lit(0))
    words = F.least(F.size("a.wide"), F.size("b.wide"))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda c: F.when(F.size(c) == words, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), xor))
    wide = F.aggregate(F.zip_with(folded("a.wide"), folded("b.wide"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    size = size & (1 + left >= need) & ((words > 0) | (apart <= most)) & ~F.arrays_overlap("a.before", "b.before") & ((words == 0) | (wide <= most))
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & size)
    met = met.select(F.shiftright("a.place", BANDS).cast(no).alias("no"), *[of("a.k", "b.k").alias(c) for of, c in ((F.least, "a"), (F.greatest, "b"))], (F.col("a.n") + F.col("b.n")).alias("weight"))
    pairs = store(met)
    return _compared(pairs, numbered, least, width)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased texts (k, t, row) as sets (k, row, digest, batch, codes), and rows (batch, code, term) for the codes of a batch, in the order of its tokens.

    A digest is that of the sorted tokens; texts without a token are left out.
    """
    names = ["k", "row", "digest", "batch", "codes", "code", "term"]
    for batch in batches:
        ends = np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: len(batch) + 1].astype(np.int64) if len(batch) else np.zeros(1, int)
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CODED, "right")) - 1)
            rows = batch.slice(begin, end - begin)
            n, codes, terms = _codes(rows.column(1), ends[begin : end + 1] - ends[begin])
            begin, has = end, np.flatnonzero(n)
            if not len(has):
                continue
            stop, own = np.cumsum(n[has]), rows.column(2)[0].as_py()
            spaced = pc.binary_join_element_wise(terms, "", " ").take(pa.array(codes))
            _, off, data = spaced.buffers()
            cut = np.frombuffer(off, np.int32)[np.concatenate(([0], stop))].tolist()
            view = memoryview(data)
            digests = pa.array([blake2b(view[x:y], digest_size=16).digest() for x, y in zip(cut, cut[1:])], pa.binary())
            kept, null = rows.take(pa.array(has)), lambda count, kind: pa.nulls(count, kind)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), digests, pa.array(np.full(len(has), own)), _packed(codes.astype(np.int32), stop), null(len(has), pa.int32()), null(len(has), pa.string())], names)
            many = len(terms)
            yield pa.RecordBatch.from_arrays([null(many, kept.column(0).type), null(many, pa.int64()), null(many, pa.binary()), pa.array(np.full(many, own)), null(many, pa.binary()), pa.array(np.arange(many), pa.int32()), terms], names)


def _packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A row of bytes for the numbers up to each end."""
    cut = (np.concatenate(([0], ends)) * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(numbers))])


def _unpacked(rows: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each has."""
    n = np.asarray(pc.binary_length(rows)).astype(np.int64) // width.itemsize
    _, off, data = rows.buffers()
    start = int(np.frombuffer(off, np.int32)[rows.offset]) if len(rows) else 0
    return np.frombuffer(data, np.uint8)[start : start + int(n.sum()) * width.itemsize].copy().view(width) if n.any() else np.zeros(0, width), n


def _codes(texts: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many tokens each text's set has, the codes of all sets, sorted in each, and the tokens by code, sorted."""
    _, off, data = texts.buffers()
    start = int(np.frombuffer(off, np.int32)[texts.offset])
    raw = np.frombuffer(data, np.uint8)[start : start + ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    inside = TOKEN[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    begins[edges] = inside[edges]  # a token ends with its text
    kept = raw[inside]
    cut = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(kept)]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    terms = coded.dictionary.take(order)
    rank = np.empty(len(terms), np.int64)
    rank[np.asarray(order)] = np.arange(len(terms))
    per_row = np.diff(np.searchsorted(np.flatnonzero(begins), ends))
    row = np.repeat(np.arange(len(per_row)), per_row)
    both = np.sort(row * len(terms) + rank[np.asarray(coded.indices)])
    both = both[np.flatnonzero(np.diff(both, prepend=-1))]
    row, codes = np.divmod(both, max(len(terms), 1))
    return np.bincount(row, minlength=len(per_row)), codes, terms


def _by_batch(first: DataFrame, then: DataFrame) -> DataFrame:
    """Rows of two tables by batch, in each those of the first before those of the other: at is twice the batch, and one more in the other."""
    rows = [df.withColumn("at", F.shiftleft("batch", 1) + i).drop("batch") for i, df in enumerate((first, then))]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).repartition(F.shiftright("at", 1)).sortWithinPartitions("at")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Of a stream by batch, rows of one batch and one table that came together: (batch, 0 or 1, rows)."""
    for batch in batches:
        at = np.asarray(batch.column("at"))
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
        for x, y in zip(edges, edges[1:]):
            if x < y:
                yield *divmod(int(at[x]), 2), batch.slice(x, y - x)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a batch's sets (codes) each of its tokens (code, term) is: (term, df)."""
    last = None
    for own, after, rows in _runs(batches):
        if own != last:
            last, df = own, np.zeros(0, np.int64)
        code = np.asarray(rows.column("code")) if after else _unpacked(rows.column("codes"), CODE)[0]
        if len(df) <= code.max():
            df = np.pad(df, (0, max(len(df), int(code.max()) + 1 - len(df))))
        if after:
            kept = np.flatnonzero(df[code])
            yield pa.RecordBatch.from_arrays([rows.column("term").take(pa.array(kept)), pa.array(df[code[kept]])], ["term", "df"])
        else:
            df += np.bincount(code, minlength=len(df))


def _numbered(batches: Iterator[pa.RecordBatch], width: np.dtype) -> Iterator[pa.RecordBatch]:
    """Sets (k, n, s), s: sorted numbers, of batches that have first the numbers (code, no) of their codes, then sets (k, codes)."""
    last = None
    for own, after, rows in _runs(batches):
        if own != last:
            last, number = own, np.full(0, -1)
        code, n = _unpacked(rows.column("codes"), CODE) if after else (np.asarray(rows.column("code")), None)
        if len(number) <= code.max():
            number = np.pad(number, (0, max(len(number), int(code.max()) + 1 - len(number))), constant_values=-1)
        if not after:
            number[code] = np.asarray(rows.column("no"))
            continue
        no, row = number[code], np.repeat(np.arange(len(n)), n)
        row, no = row[no >= 0], no[no >= 0]
        no = no[np.lexsort((no, row))]
        s = _packed(no.astype(width), np.cumsum(np.bincount(row, minlength=len(n))))
        yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array(n, pa.int32()), s], ["k", "n", "s"])


def _prefixes(batches: Iterator[pa.RecordBatch], least: float, width: np.dtype, smaller: bool) -> Iterator[pa.RecordBatch]:
    """A row a token of the prefix of a set (k, n, s): the set's size, own tokens and bitmaps, where the token stands, its number with the band of sizes, and those before it.

    smaller: of the smaller set of a pair, whose prefix is shorter, in its own band and the next.
    The bitmaps have the parity of how many tokens fall on a bit: the first BITMAP words, the
    wide one 2**i / 64 words from 2**i tokens on (WIDE at least). A wide bitmap of half the
    words is the exclusive or of the halves.
    """
    for batch in batches:
        if not len(batch):
            continue
        n, (s, long) = np.asarray(batch.column(1)).astype(np.int64), _unpacked(batch.column(2), width)
        row, begin = np.repeat(np.arange(len(n)), long), np.cumsum(long) - long
        h = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        narrow = _parities(row, (h >> np.uint64(20)).astype(np.int64), np.full(len(n), BITMAP)).reshape(-1, BITMAP)
        narrow = np.where((n * least >= WIDE)[:, None], 0, narrow)  # all that these may meet are wide
        words = np.where(n >= WIDE, 1 << np.maximum(np.log2(np.maximum(n, 1)).astype(np.int64) - 6, 0), 0)
        has = words[row] > 0
        wide = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(words))), pa.int32()), pa.array(_parities(row[has], (h[has] >> np.uint64(20)).astype(np.int64), words)))
        own = n - long
        shared = np.ceil(n * (2 * least / (1 + least)) - 1e-9) if smaller else np.ceil(n * least)
        take = np.clip(n - shared.astype(np.int64) + 1 - own, 0, long)
        band = np.minimum(np.log(np.maximum(n, 1)) / max(-np.log(least) * (1 + 1e-9), 1e-3), (1 << BANDS - 1) - 1).astype(np.int64)
        of = np.repeat(np.arange(len(n)), take)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take)
        weight = np.cumsum(8 * (12 + words[of]))
        edges = [0, *np.flatnonzero(np.diff(weight // HANDED_ON)) + 1, len(of)]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            r, i = of[x:y], nth[x:y]
            at, back = begin[r] + i, np.minimum(i, BEFORE)
            stop = np.cumsum(back)
            earlier = np.arange(stop[-1]) - np.repeat(stop - at, back)  # of a token: at - back up to at
            sets = pa.array(r)
            before = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop)), pa.int32()), pa.array(s[earlier]))
            about = [batch.column(0).take(sets), pa.array(n[r], pa.int32()), pa.array(own[r], pa.int32()), *(pa.array(narrow[r, c]) for c in range(BITMAP)), wide.take(sets), pa.array(own[r] + i + 1, pa.int32())]
            for further in range(1 + smaller):
                place = (s[at].astype(np.int64) << BANDS) + band[r] + further
                yield pa.RecordBatch.from_arrays([*about, pa.array(place), before], ["k", "n", "own", *(f"b{c}" for c in range(BITMAP)), "wide", "at", "place", "before"])


def _parities(row: np.ndarray, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bitmaps of so many 64-bit words a row, one after the other: whether an odd number of a row's hashes fall on a bit."""
    ends = np.cumsum(words)
    at = (ends - words)[row] * 64 + h % (64 * words[row])
    odd = np.bincount(at, minlength=ends[-1] * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _numbers(terms: DataFrame) -> DataFrame:
    """(term, no) of (term, df): numbers without gaps in the order of (df, term), ints where they suffice."""
    kept = store(terms.orderBy("df", "term").select("term", F.monotonically_increasing_id().alias("id")))
    rows = kept.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    ends = np.cumsum([r.n for r in rows]) if rows else np.zeros(1, int)
    base = F.create_map(*[F.lit(x) for r, end in zip(rows, ends) for x in (r.part, int(end) - r.n)]) if rows else F.create_map(F.lit(0), F.lit(0))
    no = F.element_at(base, F.shiftright("id", 33)) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.select("term", no.cast("int" if ends[-1] < 1 << 31 else "long").alias("no"))


def _compared(pairs: DataFrame, sets: DataFrame, least: float, width: np.dtype) -> DataFrame:
    """(a, b, jaccard) over `least` of pairs (no, a, b, weight) at their first shared token no, which count once; sets: (k, n, s).

    A set's label is the least key that it is paired with, so the sets of a family have few,
    and pairs with the same two labels are a cell, or many by hashes of a and b if they weigh
    more than PAIRED. A set goes to its cells, not to its pairs: a cell's sets come first in a
    sorted stream, then its pairs.
    """
    labels = small(store(pairs.groupBy("b").agg(F.min("a").alias("label"))))
    of = lambda c: labels.select(F.col("b").alias(c), F.col("label").alias(f"l{c}"))
    labelled = pairs.join(of("a"), "a", "left").join(of("b"), "b").withColumn("cell", F.xxhash64(F.coalesce("la", "a"), "lb"))
    heavy = labelled.groupBy("cell").agg(F.sum("weight").alias("w")).where(F.col("w") > PAIRED).select("cell", F.ceil(F.sqrt(F.col("w") / PAIRED)).alias("parts"))
    deal = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.col("parts")), F.lit(0)).cast("int")
    dealt = labelled.join(small(store(heavy)), "cell", "left").select("cell", deal("a").alias("i"), deal("b").alias("j"), "a", "b", "no")
    cell = ["cell", "i", "j"]
    held = dealt.select(*cell, F.explode(F.array("a", "b")).alias("k")).distinct().join(sets, "k")
    stream = held.select(*cell, F.lit(0).alias("tag"), F.col("k").alias("a"), F.col("k").alias("b"), "n", "s")
    stream = stream.unionByName(dealt.select(*cell, F.lit(1).alias("tag"), "a", "b", "no"), allowMissingColumns=True)
    stream = stream.repartition(*cell).sortWithinPartitions(*cell, "tag", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # the sets of the cell that the batch before ended in
        for batch in batches:
            if not len(batch):
                continue
            cells = np.stack([np.asarray(batch.column(c)) for c in range(3)])
            place = np.concatenate(([0], np.cumsum((cells[:, 1:] != cells[:, :-1]).any(0))))
            pair = np.asarray(batch.column(3)) == 1
            rows, at = batch.select(["a", "n", "s"]).filter(pa.array(~pair)), place[~pair]
            if held is not None and last == tuple(cells[:, 0]):
                rows, at = pa.concat_batches([held, rows]), np.concatenate((np.zeros(len(held), int), at))
            if pair.any():
                asked = batch.select(["a", "b", "no"]).filter(pa.array(pair))
                jaccard = jaccards(rows, at, asked, place[pair], width)
                kept = pa.array(np.flatnonzero(jaccard > least))
                yield pa.RecordBatch.from_arrays([asked.column(0).take(kept), asked.column(1).take(kept), pa.array(jaccard).take(kept)], ["a", "b", "jaccard"])
            begin = np.searchsorted(at, place[-1])
            held, last = rows.slice(begin), tuple(cells[:, -1])

    return stream.mapInArrow(run, StructType().add("a", sets.schema["k"].dataType).add("b", sets.schema["k"].dataType).add("jaccard", "double"))


def jaccards(rows: pa.RecordBatch, at: np.ndarray, pairs: pa.RecordBatch, place: np.ndarray, width: np.dtype) -> np.ndarray:
    """The Jaccard overlap of each pair (a, b, first) of a place, 0 if a number below its first one is shared.

    rows: (key, size, bytes of sorted numbers), at: their places. Pairs with one a stand together.
    """
    keys = rows.column(0).unique()
    code = lambda column, of: of * len(keys) + np.asarray(pc.index_in(column, keys))
    known = code(rows.column(0), at)
    order = np.argsort(known)
    ia, ib = (order[np.searchsorted(known, code(pairs.column(c), place), sorter=order)] for c in range(2))
    n, (s, long) = np.asarray(rows.column(1)), _unpacked(rows.column(2), width)
    begin = np.cumsum(long) - long
    numbers, flat = np.unique(s, return_inverse=True)
    below = np.searchsorted(numbers, np.asarray(pairs.column(2)))
    mark, out = np.zeros(len(numbers), bool), np.zeros(len(ia))
    edges = [0, *(np.flatnonzero(ia[1:] != ia[:-1]) + 1), len(ia)]
    for x, y in zip(edges, edges[1:]):
        mine = flat[begin[ia[x]] : begin[ia[x]] + long[ia[x]]]
        mark[mine] = True
        b = ib[x:y]
        start = np.cumsum(long[b]) - long[b]
        theirs = flat[np.arange(long[b].sum()) + np.repeat(begin[b] - start, long[b])]
        hit = mark[theirs]
        both = np.add.reduceat(hit, start, dtype=np.int64)
        early = np.add.reduceat(hit & (theirs < np.repeat(below[x:y], long[b])), start, dtype=np.int64)
        mark[mine] = False
        out[x:y] = np.where(early == 0, both / (n[ia[x]] + n[b] - both), 0)
    return out


# ---- embedding cache and index lifecycle ----


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose digest is in the cache."""
    return requests.join(cache.select("digest"), "digest", "left_semi")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("digest"), "digest", "left_anti")


def embed(texts: DataFrame, cache: DataFrame, embedder, most_chars: int = 2000) -> DataFrame:
    """(id, digest, embedding): cached vectors, and new ones from the embedder for what the cache lacks; blank texts have none."""
    asked = texts.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.left(F.col("text"), F.lit(most_chars))).withColumn("digest", F.md5(F.col("text").cast("binary")))
    new = cache_misses(asked, cache).select("digest", "text").dropDuplicates(["digest"])

    def run(batches):
        for pdf in batches:
            yield pdf[["digest"]].assign(embedding=[None if v is None else [float(x) for x in v] for v in embedder.embed(pdf["text"].tolist())])

    made = new.mapInPandas(run, "digest string, embedding array<float>").where("embedding IS NOT NULL")
    return asked.join(cache.select("digest", "embedding").unionByName(made), "digest").select("id", "digest", "embedding")


def index_status(sources: DataFrame, indexed: DataFrame, processed: DataFrame, loaded: DataFrame | None = None, version: int = 3) -> DataFrame:
    """(key, status): ready (loaded), cached (an index of this version), not_indexed (chunks only), needs_preprocess."""
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    s = sources.where("enabled").select("key").join(flag(indexed.where(F.col("version") == version), "cached"), "key", "left").join(flag(processed, "done"), "key", "left")
    s = s.join(flag(loaded, "loaded"), "key", "left") if loaded is not None else s.withColumn("loaded", F.lit(None).cast("boolean"))
    return s.select("key", F.when(F.col("loaded"), "ready").when(F.col("cached"), "cached").when(F.col("done"), "not_indexed").otherwise("needs_preprocess").alias("status"))


def sound(indexed: DataFrame, version: int = 3) -> DataFrame:
    """(key, state) of indexes (key, version, n_chunks, n_vectors, n_terms): sound, stale (another version), without_terms or torn (chunks and vectors differ); all but sound ones are built again."""
    state = F.when(~F.col("version").eqNullSafe(F.lit(version)), "stale").when(F.coalesce("n_terms", F.lit(0)) == 0, "without_terms").when(~F.col("n_vectors").eqNullSafe(F.col("n_chunks")), "torn").otherwise("sound")
    return indexed.select("key", state.alias("state"))


def build_index(chunks: DataFrame, path: str, version: int = 3) -> None:
    """Write chunks, postings and statistics below path, partitioned by source; a rebuild replaces its sources only."""
    posts = postings(chunks)
    for name, df in (("chunks", chunks), ("postings", posts), ("stats", term_stats(chunks, posts))):
        df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(f"{path}/{name}")


def load_index(spark, path: str, version: int = 3) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").where(F.col("version") == version) for n in ("chunks", "postings", "stats")}
