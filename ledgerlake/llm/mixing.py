"""Mixing sources by temperature (SQL functions only).

The token shares p of the sources are raised to an exponent a and normalised. a is found by bisection: the
largest a in [0, 1] at which the entropy of the weights still reaches `target_entropy` (as a share of the
logarithm of the number of sources), but no smaller than what the repetition limit allows. The middles of LEVELS halvings are
looked up in one aggregation over the sources, so 5 rounds halve the interval 30 times, and the
driver sees a few numbers, however many sources there are.

The budget is such that the largest source is read exactly once; source i is then read
r_i = (p_max / p_i)^(1 - a) times, 1 at least, so no document is lost. The weights are realised in
epochs: every epoch puts the documents of a source in another order (a permutation keyed by md5 of
doc_id, epoch and seed) that is cut into blocks of about BLOCK_ROWS documents; whole epochs are taken whole, and the last
is taken in permuted order up to the budgeted tokens. A document's place in an epoch, and the tokens up to it, are prefix sums over the
totals of super-blocks, of the blocks in one, and within a block, so that a source with a third of all rows isn't sorted or summed in one task.

Defined results: a null source is a source of its own; tokens are white-space separated words, at least 1
for every document, so null and empty texts count as 1; rows with one doc_id and source are one document, with the tokens of all; extra columns stay,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, fresh, table, written

LEVELS, ROUNDS = 6, 5
GRID = 1 << LEVELS
#: Documents in a block of a permutation, on average.
BLOCK_ROWS = 1024
#: Blocks in a super-block.
BLOCKS = 1024
#: Digits of the md5 that blocks are cut by.
DIGITS = 7


def n_tokens(text: str):
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), WHITE[1:], " " * 5)
    return F.greatest(F.size(F.array_remove(F.split(spaced, " "), "")).cast("long"), F.lit(1).cast("long"))


def exponent(stats: DataFrame, target_entropy: float, max_repeats: float) -> float:
    """The exponent for stats(source, tokens), by bisection: a round halves the interval LEVELS times, by the entropies at all middles that it can come to."""
    total, largest, smallest, n = stats.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n or n == 1 or largest == smallest:
        return 1.0
    # p_max / p_i is at most largest / smallest, and r = (p_max / p_i)^(1 - a) <= max_repeats
    floor = max(0.0, 1.0 - math.log(max_repeats) / math.log(largest / smallest)) if max_repeats > 1 else 1.0
    goal, lo, width = target_entropy * math.log(n), 0, 1 << (LEVELS * ROUNDS)
    relative = F.log(F.col("tokens").cast("double") / F.lit(float(largest)))
    for _ in range(ROUNDS):
        step = width // GRID
        a = [F.struct(F.lit(k).alias("k"), F.lit((lo + k * step) / (1 << 30)).alias("a")) for k in range(1, GRID)]
        rows = (
            stats.select(relative.alias("x"), F.explode(F.array(*a)).alias("t"))
            .select("t.k", F.exp(F.col("t.a") * F.col("x")).alias("w"), (F.col("t.a") * F.col("x")).alias("l"))
            .groupBy("k")
            .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("l")).alias("wl"))
            .select("k", (F.log("w") - F.col("wl") / F.col("w")).alias("entropy"))
            .collect()
        )
        entropy = {r["k"]: r["entropy"] for r in rows}
        left, right = 0, GRID  # entropy falls as a grows: it reaches the goal at left, and not at right
        while right - left > 1:
            middle = (left + right) // 2
            left, right = (middle, right) if entropy[middle] >= goal else (left, middle)
        lo, width = lo + left * step, step
    return max(lo / (1 << 30), floor)


def _reads(docs: DataFrame, source: str, doc_id: str, text: str, target_entropy: float, max_repeats: float, seed: int) -> DataFrame:
    """s, d, tokens, epoch, place, of: each document of a source as often as the mixture reads it, with its place in the epoch's permutation of `of` documents."""
    facts = written(
        docs.select(F.col(source).alias("s"), F.col(doc_id).alias("d"), n_tokens(text).alias("tokens")).groupBy("s", "d").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")),
        "mix-facts",
    )
    stats = written(facts.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"), F.count("*").alias("of")), "mix-sources")
    a = exponent(stats, target_entropy, max_repeats)
    largest = float(stats.agg(F.max("tokens")).first()[0] or 1)
    plan = stats.select(
        F.col("s").alias("ps"), "tokens", "of",
        F.exp(F.lit(1.0 - a) * (F.lit(math.log(largest)) - F.log(F.col("tokens").cast("double")))).alias("r"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long").alias("blocks"),
    ).select("ps", "of", F.floor("r").alias("whole"), F.floor((F.col("r") - F.floor("r")) * F.col("tokens")).alias("budget"), "blocks")
    d = facts.join(plan, facts["s"].eqNullSafe(plan["ps"])).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    key = F.md5(F.concat(F.coalesce(F.col("d").cast("string"), F.lit("")), F.lit(":"), F.col("epoch").cast("string"), F.lit(f":{seed}")))
    spot = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("long")
    d = d.select("s", "d", "tokens", "of", "whole", "budget", "epoch", key.alias("key"), "blocks").withColumn("block", F.floor(spot * F.col("blocks") / F.lit(16**DIGITS)))
    # prefix sums over super-blocks, over the blocks in each, and within a block
    upto = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = d.groupBy("s", "epoch", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).withColumn("super", F.floor(F.col("block") / BLOCKS))
    supers = blocks.groupBy("s", "epoch", "super").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    supers = supers.select(F.col("s").alias("us"), F.col("epoch").alias("ue"), F.col("super").alias("uu"), upto("t", "s", "epoch", "super").alias("ut"), upto("n", "s", "epoch", "super").alias("un"))
    blocks = blocks.join(supers, blocks["s"].eqNullSafe(supers["us"]) & (blocks["epoch"] == supers["ue"]) & (blocks["super"] == supers["uu"]))
    blocks = blocks.select(
        F.col("s").alias("bs"), F.col("epoch").alias("be"), F.col("block").alias("bb"),
        (F.col("ut") + upto("t", "s", "epoch", "super", "block")).alias("before"), (F.col("un") + upto("n", "s", "epoch", "super", "block")).alias("rank"),
    )
    d = d.join(blocks, d["s"].eqNullSafe(blocks["bs"]) & (d["epoch"] == blocks["be"]) & (d["block"] == blocks["bb"]))
    within = Window.partitionBy("s", "epoch", "block").orderBy("key")
    d = d.withColumns({"total": F.col("before") + F.sum("tokens").over(within), "place": F.col("rank") + F.row_number().over(within) - 1})
    return d.filter("epoch < whole OR total <= budget").select("s", "d", "tokens", "epoch", "place", "of")


def _joined(docs: DataFrame, found: DataFrame, source: str, doc_id: str, prefix: str) -> DataFrame:
    found = found.select(*[F.col(c).alias(prefix + c) for c in found.columns])
    on = F.col(source).eqNullSafe(F.col(f"{prefix}s")) & F.col(doc_id).eqNullSafe(F.col(f"{prefix}d"))
    return docs.join(found, on, "left").drop(f"{prefix}s", f"{prefix}d")


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", target_entropy: float = 0.95, max_repeats: float = 2.0, seed: int = 0, prefix: str = "_") -> DataFrame:
    """docs with three columns, named with the prefix: tokens; copies, how many times the mixture reads the document; and places, its places in the epochs
    that read it, in order."""
    if taken := {c.lower() for c in docs.columns} & {prefix + x for x in ("tokens", "copies", "places")}:
        raise ValueError(f"docs have columns {sorted(taken)}")
    r = _reads(docs, source, doc_id, text, target_entropy, max_repeats, seed)
    # a document is read at most max_repeats + 1 times
    chosen = r.groupBy("s", "d", "tokens").agg(F.count("*").alias("copies"), F.transform(F.array_sort(F.collect_list(F.struct("epoch", "place"))), lambda x: x["place"]).alias("places"))
    mark = fresh(docs)
    back = _joined(docs, chosen, source, doc_id, mark)
    return back.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(mark + c).alias(prefix + c) for c in ("tokens", "copies", "places")])


def repeated(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", target_entropy: float = 0.95, max_repeats: float = 2.0, seed: int = 0) -> DataFrame:
    """docs as the mixture reads them, with the columns of docs. The join that repeats the rows deals them by the hash of source and doc_id, so every partition
    has its share of every source (where the reads are so few that Spark broadcasts them, rows stay in the partitions of docs); within a partition, epochs follow each other, and in an epoch rows stand in the order of their places, as shares
    of their source's documents, which interleaves the sources by their weights."""
    mark = fresh(docs)
    r = _joined(docs, _reads(docs, source, doc_id, text, target_entropy, max_repeats, seed), source, doc_id, mark)
    r = r.withColumn(f"{mark}at", (F.col(f"{mark}place") + 0.5) / F.col(f"{mark}of")).sortWithinPartitions(f"{mark}epoch", f"{mark}at", doc_id)
    return r.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"), F.array_join(F.col("_places").cast("array<string>"), ",").alias("places")
    )


def _grid(k: int) -> str:
    """SQL of one round, from b{k-1}(lo, width) to b{k}."""
    return f"""
t{k} AS (SELECT lo + j * (width // {GRID}) AS v, width // {GRID} AS step FROM b{k - 1}, range(0, {GRID}) AS r(j)),
w{k} AS (SELECT v, step, exp(v / 1073741824.0 * x) AS w, v / 1073741824.0 * x AS l FROM t{k}, x),
e{k} AS (SELECT v, step, ln(sum(w)) - sum(w * l) / sum(w) AS entropy FROM w{k} GROUP BY v, step),
b{k} AS (SELECT coalesce(max(v) FILTER (WHERE entropy >= (SELECT 0.95 * ln(n) FROM tot)), min(v)) AS lo, any_value(step) AS width FROM e{k}),"""


OP9_SQL = rf"""
WITH f AS (
  SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS n_tokens FROM documents),
st AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_rows FROM f GROUP BY source),
tot AS (SELECT max(tokens) AS largest, min(tokens) AS smallest, count(*) AS n FROM st),
x AS (SELECT ln(tokens::DOUBLE / largest) AS x FROM st, tot),
b0 AS (SELECT 0::BIGINT AS lo, 1073741824::BIGINT AS width),{"".join(_grid(k + 1) for k in range(ROUNDS))}
a AS (SELECT CASE WHEN n <= 1 OR largest = smallest THEN 1.0
        ELSE greatest(lo / 1073741824.0, 1.0 - ln(2.0) / ln(largest::DOUBLE / smallest)) END AS a FROM b{ROUNDS}, tot),
r AS (SELECT source, tokens, n_rows, exp((1.0 - a) * (ln(largest::DOUBLE) - ln(tokens::DOUBLE))) AS r FROM st, tot, a),
p AS (SELECT source, floor(r)::BIGINT AS w, floor((r - floor(r)) * tokens)::BIGINT AS budget,
        greatest(1, ceil(n_rows / {BLOCK_ROWS}.0))::BIGINT AS blocks FROM r),
k AS (SELECT f.doc_id, f.source, n_tokens, w, budget, e AS epoch, md5(coalesce(doc_id::VARCHAR, '') || ':' || e || ':0') AS key
      FROM (SELECT p.*, unnest(range(0, w + 1)) AS e FROM p) AS p JOIN f ON f.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY key) - 1 AS place, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key) AS upto FROM k)
SELECT doc_id, source, n_tokens, count(*)::BIGINT AS copies, string_agg(place::VARCHAR, ',' ORDER BY epoch) AS places
FROM q WHERE epoch < w OR upto <= budget GROUP BY doc_id, source, n_tokens
"""

QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": OP9_SQL}
