"""User memory: detection, suppression of repeats, ranking, expiry, history budgets."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.functions.vectors import dot
from tessera.session import small, store

LEAST_CHARS, TTL_DAYS, MOST_LONG, MOST_MID, INJECTED, LEAST_SCORE, MOST_CHARS = 10, 7, 50, 20, 3, 0.55, 500
STREAK, TURNS, BUDGET = 3, 6, 2400
RULE = "─" * 40


def detect(messages: DataFrame) -> DataFrame:
    """(user, ts, pos, memory_type, tier, content, memory_id, expires_at) of messages (user, ts, text) that state a preference, instruction or correction."""
    text = T.strip(F.col("text"))
    kinds = [F.when(text.rlike("(?iU)" + p), F.struct(F.lit(i).alias("pos"), F.lit(k).alias("memory_type"), F.lit("longterm").alias("tier"), F.concat(F.lit(lead), T.strip(F.regexp_extract(text, "(?iU)" + p, 0))).alias("content"))) for i, (p, k, lead) in enumerate(C.MEMORY_PATTERNS)]
    kinds.append(F.when(text.rlike("(?iU)" + C.CORRECTION), F.struct(F.lit(len(kinds)).alias("pos"), F.lit("correction").alias("memory_type"), F.lit("midterm").alias("tier"), F.concat(F.lit("User correction: "), F.left(text, F.lit(200))).alias("content"))))
    df = messages.where(F.length(text) >= LEAST_CHARS).select("user", "ts", F.explode(F.array_compact(F.array(*kinds))).alias("m")).select("user", "ts", "m.*")
    return df.withColumns({"memory_id": memory_id(F.col("content"), F.col("ts")), "expires_at": F.when(F.col("tier") == "midterm", F.col("ts") + F.expr(f"INTERVAL {TTL_DAYS} DAYS"))})


def memory_id(content: Column, ts: Column) -> Column:
    return F.left(F.md5(F.concat(content, ts.cast("string")).cast("binary")), F.lit(12))


class Held:
    """One user's memories as they stand: the newest of each tier up to its cap, by token, so that a new one meets only those it shares a token with."""

    def __init__(self, caps: dict[str, int]):
        self.caps, self.tiers, self.of, self.size, self.next = caps, {}, {}, {}, 0

    def repeats(self, words: set[str], least: float) -> bool:
        shared = Counter(i for w in words for i in self.of.get(w, ()))
        return any(n > least * (len(words) + self.size[i] - n) for i, n in shared.items())

    def add(self, words: set[str], tier: str, ends) -> None:
        for w in words:
            self.of.setdefault(w, set()).add(self.next)
        self.size[self.next] = len(words)
        held = self.tiers.setdefault(tier, deque())
        held.append((self.next, words, ends))
        self.next += 1
        if len(held) > self.caps.get(tier, MOST_LONG):
            self._drop(held.popleft())

    def expire(self, now) -> None:
        for tier, held in self.tiers.items():
            gone = [r for r in held if r[2] is not None and r[2] < now]
            if gone:
                self.tiers[tier] = deque(r for r in held if r[2] is None or r[2] >= now)
                for r in gone:
                    self._drop(r)

    def _drop(self, record: tuple) -> None:
        i, words, _ = record
        del self.size[i]
        for w in words:
            self.of[w].discard(i)
            if not self.of[w]:
                del self.of[w]


def suppress_repeats(records: DataFrame, least: float = 0.8, most_long: int = MOST_LONG, most_mid: int = MOST_MID) -> DataFrame:
    """Records of a user, in (ts, pos) order, without those whose words overlap one that is held then by more than `least`.

    Held are the newest most_long long-term and most_mid mid-term ones that have not ended
    when a record comes in, so what was held long ago may be stored again. What is held
    depends on what was, so a user's records are walked in order: sorted within partitions,
    batch by batch, with the held ones of one user in memory and bounded work a record.
    records: (user, ts, pos, content) and, if they have them, tier and expires_at; equal times
    and places are told apart by content. A record without a word is never a repeat.
    """
    tier = F.col("tier") if "tier" in records.columns else F.lit("longterm")
    ends = F.col("expires_at") if "expires_at" in records.columns else F.lit(None).cast("timestamp")
    df = records.withColumns({"words_": F.array_distinct(T.tokens(F.col("content"))), "tier_": tier, "at_": F.unix_micros(F.col("ts").cast("timestamp")), "ends_": F.unix_micros(ends.cast("timestamp"))})
    caps = {"longterm": most_long, "midterm": most_mid}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held = object(), Held(caps)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            keep = []
            for u, words, t, at, end in zip(column("user"), column("words_"), column("tier_"), column("at_"), column("ends_")):
                if u != user:
                    user, held = u, Held(caps)
                held.expire(at)
                w = set(words or ())
                keep.append(not w or not held.repeats(w, least))
                if keep[-1]:
                    held.add(w, t, end)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition("user").sortWithinPartitions("user", "ts", "pos", "content").mapInArrow(run, df.schema).drop("words_", "tier_", "at_", "ends_")


def alive(records: DataFrame, now: Column) -> DataFrame:
    return records.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


#: Memories of a cell, as many as a task holds at a time.
CELL = 1 << 15


class Words:
    """The memories of a cell by word, as lists of their places."""

    def __init__(self, words: pa.ListArray):
        self.n = len(words)
        place = np.repeat(np.arange(self.n, dtype=np.int32), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        self.places = place[np.argsort(codes, kind="stable")]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(self.words)))))

    def best(self, queries: pa.ListArray, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of up to `most` memories a query whose score is `least` or more, by score, then place."""
        size = pc.list_value_length(queries).to_numpy(zero_copy_only=False)
        begin = np.concatenate(([0], np.cumsum(size)))
        codes = pc.fill_null(pc.index_in(queries.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, n in enumerate(size):
            scores = np.arange(n + 1) / max(n, 1) * 0.4
            enough = np.flatnonzero(scores >= least)
            if not len(enough):
                continue
            lists = [self.places[self.begin[c] : self.begin[c + 1]] for c in codes[begin[i] : begin[i + 1]] if c >= 0]
            shared = np.bincount(np.concatenate(lists), minlength=self.n) if lists else np.zeros(self.n, np.int64)
            at = np.flatnonzero(shared >= enough[0])
            at = at[np.argsort(-shared[at], kind="stable")[:most]]
            out.append((np.full(len(at), i), at, scores[shared[at]]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _overlaps(records: DataFrame, queries: DataFrame, least: float, most: int) -> DataFrame:
    """(query_id, tier_, seq, memory_id, score): at least the `most` memories of a query's user whose words it shares most, at most so many a cell.

    A user's memories are dealt over cells by hash. A cell's memories come first in a sorted
    stream, then its user's queries, so a task holds one cell, whose size is bounded, and a
    query meets the lists of its own words instead of every memory.
    """
    words = lambda c: F.coalesce(F.array_distinct(T.tokens(F.col(c))), F.array().cast("array<string>"))
    cells = small(store(records.where("user IS NOT NULL").groupBy("user").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))))
    own = records.join(cells, "user").select("user", F.pmod(F.xxhash64("memory_id", "seq"), F.col("cells")).cast("int").alias("cell"), F.lit(0).alias("tag"), "tier_", "seq", "memory_id", words("content").alias("words"))
    asked = queries.join(cells, "user").select("user", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(1).alias("tag"), "query_id", words("q").alias("words"))
    stream = own.unionByName(asked, allowMissingColumns=True).select("user", "cell", "tag", "words", "query_id", "tier_", "seq", "memory_id")
    stream = stream.repartition("user", "cell").sortWithinPartitions("user", "cell", "tag", "tier_", "seq")
    schema = StructType([stream.schema[c] for c in ("query_id", "tier_", "seq", "memory_id")]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built, rows = None, [], None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            edge = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            for a, b in zip(edge, edge[1:]):
                part = batch.slice(a, b - a)
                if keys[a][:2] != now:
                    now, held, built = keys[a][:2], [], None
                if keys[a][2] == 0:
                    held.append(part)
                    continue
                if built is None:
                    if not held:
                        continue
                    rows = pa.Table.from_batches(held)
                    built = Words(pa.concat_arrays(rows.column("words").chunks))
                    rows, held = rows.select(["tier_", "seq", "memory_id"]), []
                query, place, score = built.best(part.column(3), least, most)
                found = rows.take(pa.array(place))
                yield from pa.table([part.column(4).take(pa.array(query)), *found.columns, pa.array(score)], names=schema.names).to_batches()

    return stream.mapInArrow(run, schema)


def rank(records: DataFrame, queries: DataFrame, least: float = LEAST_SCORE, most: int = INJECTED) -> DataFrame:
    """(query_id, rank, memory_id, score): a user's memories nearest to a query; without a query vector the first ones, long-term before mid-term.

    records: (user, memory_id, tier, seq, content, embedding); queries: (query_id, user, text, embedding).
    Memories without a vector count by the share of the query's words that they have.
    """
    q = queries.select("query_id", "user", F.col("text").alias("q"), F.col("embedding").alias("qv"))
    r = records.withColumn("tier_", F.when(F.col("tier") == "longterm", 0).otherwise(1))
    asked, columns = q.where("qv IS NOT NULL"), ["query_id", "tier_", "seq", "memory_id", "score"]
    first = r.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy("tier_", "seq"))).where(F.col("n") <= most)
    first = first.join(q.where("qv IS NULL"), "user").withColumn("score", F.lit(None).cast("double")).select(columns)
    near = r.where("embedding IS NOT NULL").join(asked, "user").withColumn("score", dot(F.col("embedding"), F.col("qv")))
    near = near.where(F.col("score").isNull() | (F.col("score") >= least)).select(columns)
    df = _overlaps(r.where("embedding IS NULL"), asked, least, most).unionByName(near).unionByName(first)
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "tier_", "seq")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", "memory_id", "score")


def memory_block(chosen: DataFrame) -> DataFrame:
    """(query_id, block) of (query_id, rank, memory_type, content): the labelled lines of a prompt, bounded."""
    label = F.coalesce(*[F.when(F.col("memory_type") == k, F.lit(v)) for k, v in C.MEMORY_LABELS], F.lit("Note"))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  "), label, F.lit(": "), "content").alias("line"))))
    block = F.concat(F.lit(C.MEMORY_HEAD + "-" * 40 + "\n"), F.array_join(rows["line"], "\n"), F.lit("\n" + "-" * 40 + "\n\n"))
    return chosen.groupBy("query_id").agg(block.alias("block")).withColumn("block", F.when(F.length("block") > MOST_CHARS, F.concat(F.left(F.col("block"), F.lit(MOST_CHARS)), F.lit("\n[memory truncated]\n\n"))).otherwise(F.col("block")))


def session_summary(evicted: DataFrame) -> DataFrame:
    """(user, ts, content, expires_at) of evicted turns (user, ts, query): their topic, for TTL_DAYS."""
    return evicted.select("user", "ts", F.concat(F.lit("Recent session topics: "), F.left(F.col("query"), F.lit(80))).alias("content"), (F.col("ts") + F.expr(f"INTERVAL {TTL_DAYS} DAYS")).alias("expires_at"))


def topics(names: Column) -> Column:
    return F.concat(F.lit("Recent session topics: "), F.array_join(F.slice(names, 1, 8), ", "))


def tier_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("tier").agg(F.count("*").alias("n"))


def clear_tier(records: DataFrame, tier: str) -> DataFrame:
    return records.where(F.col("tier") != tier)


def streaks(messages: DataFrame, values: list[str] | None = None, length: int = STREAK, by: str = "user", value: str = "lang", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The rows at which a user's run of one value becomes `length` long, for the given values only (all, if none are given)."""
    w = Window.partitionBy(by).orderBy(*order)
    df = messages.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    df = df.withColumn("__run", F.sum("__new").over(w))
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy(by, "__run").orderBy(*order))).where(F.col("__at") == length)
    return (df.where(F.col(value).isin(values)) if values else df).drop("__new", "__run", "__at")


def history_block(turns: DataFrame, most_turns: int = TURNS, budget: int = BUDGET) -> DataFrame:
    """(session, block, kept) of (session, turn, query, response): the latest turns that fit, the newest with its answer, older ones as summaries.

    The newest turn always stays; older ones stay while the whole block, its frame included, is within the budget.
    """
    last = Window.partitionBy("session").orderBy(F.desc("turn"))
    up = Window.partitionBy("session").orderBy("turn")
    df = turns.withColumn("back", F.row_number().over(last)).where(F.col("back") <= most_turns).withColumn("no", F.row_number().over(up))
    said = F.when(F.col("back") == 1, F.concat(F.left(F.col("response"), F.lit(500)), F.lit("…"))).otherwise(T.compress_turn(F.col("response")))
    df = df.withColumn("line", F.concat(F.lit("[Turn "), F.col("no").cast("string"), F.lit("]\nUser: "), "query", F.lit("\nAssistant: "), said))
    frame = len(C.HISTORY_HEAD) + 2 * (len(RULE) + 1) + 2
    size = F.sum(F.length("line") + 2).over(last) - 2 + frame
    df = df.withColumn("size", size).where((F.col("back") == 1) | (F.col("size") <= budget))
    rows = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return df.groupBy("session").agg(F.concat(F.lit(C.HISTORY_HEAD + RULE + "\n"), F.array_join(rows["line"], "\n\n"), F.lit("\n" + RULE + "\n\n")).alias("block"), F.count("*").alias("kept"))


def conversation_text(messages: DataFrame) -> DataFrame:
    """(session, text) of (session, seq, query, response): a conversation as text to take away."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("User: "), "query", F.lit("\nAssistant: "), "response").alias("line"))))
    return messages.groupBy("session").agg(F.array_join(rows["line"], "\n\n").alias("text"))


def accepted_hits(hits: DataFrame, limit: int = 20, window: int = 60, by: str = "user", ts: str = "ts", order: str = "seq") -> DataFrame:
    """hits with accepted: fewer than `limit` accepted ones of the user in the `window` seconds before; refused ones don't count.

    What is accepted depends on what was, so a user's hits are walked in order: sorted within
    partitions, batch by batch. Only the accepted times of one window are held, however many
    hits a user has; one user's hits are one task's, as each depends on the one before.
    """
    schema = StructType([*hits.schema.fields, StructField("accepted", BooleanType())])
    at, who = hits.columns.index(ts), hits.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held = object(), deque()
        for batch in batches:
            out = []
            times = batch.column(at).cast(pa.timestamp("us", batch.column(at).type.tz)).cast(pa.int64()).to_pylist()
            for u, t in zip(batch.column(who).to_pylist(), times):
                if u != user:
                    user, held = u, deque()
                while held and t - held[0] >= window * 1_000_000:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "accepted"])

    return hits.repartition(by).sortWithinPartitions(by, ts, order).mapInArrow(run, schema)
