"""Filter interaction audit by a walk of the permutation trie.

Every order of the filters is a path of a trie, and what is left after a prefix depends on its set of filters alone. So
the walk goes depth first over sets: each set's survivors are a persisted DataFrame, made once from those of the prefix
that reached it first; one aggregate over it counts what each further filter really removes. The orders are then read
off those counts.
"""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import forget, hot_limit, read, remove, shared_dir, spread_join, stored

#: White space between words.
_BLANKS = "[\\x20\\x09-\\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of one text, which nothing but the text decides.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 3 % capitals. D: holds a markup character.
    """
    words = F.array_remove(F.split(text, _BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One small stored row per document: `part`, whether it fails each of A to E, and its labels `good` and `toxic`.

    E: some smaller doc_id, anywhere in the table, has the same text; a null doc_id comes after all others. Null texts
    are empty. A document is good or toxic if any of its labels says so. Texts don't travel: copies meet by their digest.
    """
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"), *(c.alias(name) for name, c in text_filters(text).items()))
    facts = stored(facts, "audit-facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    found = spread_join(facts, first, "digest", F.col("n") > hot_limit(facts.count()), ["doc_id"])
    found = found.withColumn("E", F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    flag = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    out = stored(found.join(said, "doc_id", "left").select("part", "A", "B", "C", "D", "E", known("good"), known("toxic")), "audit-verdicts")
    forget(facts)
    return out


def walk(rows: DataFrame, filters: list[str], root: str) -> None:
    """Writes to `root`, for each part and set of filters, how many rows are left and what each further filter removes.

    rows(part, one boolean per filter that says whether a row fails it, good, toxic). Depth first, so that no more than
    one DataFrame a level is persisted at a time; each set is visited once, whatever the orders that lead to it.
    """
    seen: set[str] = set()
    # The same aggregate for every set, so that its compiled code serves all: filters that were applied remove nothing.
    lost = [F.struct(F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in filters]
    counts = (F.count(F.lit(1)).alias("kept"), F.map_from_arrays(F.array(*map(F.lit, filters)), F.array(*lost)).alias("edges"))

    def visit(state: str, survivors: DataFrame) -> None:
        seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy("part").agg(*counts).write.parquet(f"{root}/state=_{state}")
        for f in filters:
            below = "".join(sorted({*state, f}))
            if below not in seen:
                visit(below, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit("", rows)


def orders_of(states: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the counts that walk() wrote.

    `kept` and `removed` are of this step; `redundant` are the rows that fail its filter and went earlier;
    `unique_fails` fail no other filter; `good_lost` and `toxic_lost` are the removed rows with that label; `shapley` is
    what the filter removes, summed over all orders.
    """
    n = len(filters)
    spark = states.sparkSession
    states = states.select("part", F.expr("substring(state, 2)").alias("state"), "kept", "edges")
    edges = states.select("part", "state", F.explode("edges").alias("filter", "lost")).select("part", "state", "filter", "lost.*")
    # Of so many orders a set of filters is just what comes before another one.
    ways = F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)), F.lit(0))[F.length("state")]
    alone = F.when(F.length("state") == n - 1, F.col("removed")).otherwise(0)
    totals = edges.groupBy("part", "filter").agg(F.sum(ways * F.col("removed")).alias("shapley"), F.sum(F.when(F.col("state") == "", F.col("removed"))).alias("fails"), F.sum(alone).alias("unique_fails"))
    joined = lambda some: "".join(sorted(some))
    steps = [("".join(o), k + 1, o[k], joined(o[:k]), joined(o[: k + 1])) for o in itertools.permutations(filters) for k in range(n)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter string, before string, after string")  # n * n! rows
    rows = totals.join(F.broadcast(plan), "filter")
    rows = rows.join(edges.withColumnRenamed("state", "before"), ["part", "before", "filter"], "left")
    rows = rows.join(states.select("part", F.col("state").alias("after"), "kept"), ["part", "after"], "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    removed = F.coalesce("removed", F.lit(0))
    return rows.select("part", "filter_order", "step", number("kept"), number("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails", number("good_lost"), number("toxic_lost"), "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over docs(doc_id, text, lang) with labels(doc_id, quality, toxic).

    Null texts are empty, a null language is the part named by the empty string. Texts of any length are read whole.
    Repeated rows count as often as they occur, and rows that share a doc_id aren't copies of each other; of repeated
    labels any counts. Tables without rows give none; extra columns, whatever their names, are ignored.
    """
    rows = verdicts(docs, labels)
    root = f"{shared_dir(docs.sparkSession)}/shutterlake-audit-{uuid.uuid4().hex}"
    walk(rows, list("ABCDE"), root)
    out = stored(orders_of(docs.sparkSession.read.parquet(root), list("ABCDE")), "audit")
    remove(docs.sparkSession, root)
    forget(rows)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: what each filter removes at each step of all 120 orders, per language of documents."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = """
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (
    SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), v AS (
    SELECT part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
           100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
           coalesce(doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL, false) AS fe,
           coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
    FROM d LEFT JOIN l USING (doc_id)
), m AS (
    SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END)
           || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
           count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY ALL
), f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
    SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS x, substr(filter_order, 1, k - 1) AS earlier FROM o, range(1, 6) r(k)
), per AS (
    SELECT part, filter_order, step, x,
           coalesce(sum(n) FILTER (translate(fails, x || earlier, '') = fails), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, earlier, '') <> fails), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (contains(fails, x) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (contains(fails, x) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS toxic_lost
    FROM m, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM per
"""
