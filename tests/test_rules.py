"""Rules as a table against the column expression and against plain matching."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import rules


def test_acts_as_by_expression(spark):
    rnd = random.Random(8)
    words = "the Company act 777 registered address llp partner director agm secretary limited liability partnership sole proprietorship , . of and".split()
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(14))), "x") for i in range(400)] + [(900, None, "y"), (901, "", "z"), (902, "registered  address", "")]
    df = spark.createDataFrame(texts, "id int, text string, phrase string")
    want = {r.id: r.act for r in df.select("id", T.detect_act(F.col("text")).alias("act")).collect() if r.act}
    assert {r.id: r.label for r in rules.labels(df, rules.act_rules(spark), ["id"]).collect()} == want and len(set(want.values())) == 3


def test_thousands_of_phrases(spark):
    rnd = random.Random(9)
    pool = [f"wört{i}" for i in range(60)]
    phrases = [(" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 3))), f"l{i % 9}", i % 50 == 0, i) for i in range(5_000)]
    phrases += [(None, "n", True, 0), ("", "e", True, 0), ("!", "p", True, 0), phrases[0]]
    texts = [(i, rnd.choice([" ", ", "]).join(rnd.choice(pool) for _ in range(rnd.randrange(9)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(phrases, "phrase string, label string, strong boolean, place long")
    got = {(r.id, r.phrase, r.label, r.strong, r.place) for r in rules.found(df, table, ["id"]).collect()}
    first = {}
    for p, label, strong, place in phrases:
        if p and p != "!":
            first[p, label, strong] = min(place, first.get((p, label, strong), place))
    assert got == {(i, *key, place) for i, t in texts for key, place in first.items() if re.search(rf"\b{re.escape(key[0])}\b", t)}
    plan = rules.found(df, table, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") < 20  # doesn't grow with the phrases
    assert rules.found(df, table.limit(0), ["id"]).count() == 0 and rules.labels(df.limit(0), table, ["id"]).count() == 0
