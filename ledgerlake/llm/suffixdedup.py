"""Exact substring dedup with suffix arrays.

Every 50-byte window of a document is known by its minimizer (the least hash of its 24-byte strings), so equal windows have
equal keys wherever they are, and the windows of a document fall into runs with one key, each a string of 50 to 113 bytes.

1. Runs: keys that two documents hold are found by an aggregation over all documents; all other runs are done.
2. Strings: the runs with shared keys are cut from the texts, and equal strings are folded to the least doc_id.
3. Suffix arrays: strings are dealt to shards by key, so windows that may be equal meet in one shard. Each shard's suffix array is built
   in linear time by grouping (jvm.py); neighbours with common prefixes of 50 bytes or more give each window's least doc_id.
   A key with over SHARD_STRINGS different strings would make one array too long for a task; its windows are aggregated one by one
   instead, which gives the same least doc_id.
4. Removal: a window goes from a document if its least doc_id is smaller; overlapping windows join to spans.

Places are kept for each document; where a doc_id, or null, has several texts, for each text (by its md5), as places in one text mean nothing in
another.

Defined results: null texts are empty; texts under 50 bytes lose nothing; rows with one doc_id count as one document, so
they keep what they share with each other, whatever their texts; a null doc_id comes before all others; extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jvm
from .common import dropped, fresh, release, table, written

WINDOW = 50
#: Strings in a shard on average, and at most under one key.
MEAN_STRINGS, SHARD_STRINGS = 8192, 32_768
_FIRST = -(1 << 63)


def _print(s: str):
    """Stands for a string, together with its key, in joins that need not move it: 128 bits of two hash functions."""
    return F.xxhash64(s).alias("p")


def losses(strings: DataFrame, shard_strings: int = SHARD_STRINGS) -> DataFrame:
    """strings(key, s, lo, hi): each s once, with the least and the greatest doc that hold it. Of those that lose bytes in any document: key, s, lo, and
    lost, the spans of s that a document before lo holds; what else holds s loses all of it."""
    sizes = strings.groupBy("key").agg(F.count("*").alias("n"))
    total = strings.count()
    large = sizes.filter(F.col("n") > shard_strings).select("key")
    shards = max(1, total // MEAN_STRINGS)
    common = strings.join(large, "key", "left_anti")
    by_shard = common.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).agg(F.collect_list(F.struct("s", "lo", "hi", "key")).alias("rows"))
    arrays = by_shard.select(F.explode(F.call_udf("ll_least", "rows")).alias("r")).select("r.*")
    if not large.limit(1).count():
        return arrays
    rest = strings.join(large, "key", "left_semi").select("key", "s", "lo", "hi")
    windows = rest.select("key", "s", "lo", "hi", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("s") - WINDOW), lambda k: F.substring(F.col("s"), k + 1, F.lit(WINDOW)))).alias("k", "w"))
    low = windows.groupBy("w").agg(F.min("lo").alias("low"))
    span = F.struct(F.col("k").alias("begin"), (F.col("k") + WINDOW).alias("stop"))
    back = windows.join(low, "w").groupBy("key", "s", "lo", "hi").agg(F.collect_list(F.when(F.col("low") < F.col("lo"), span)).alias("lost"))
    return arrays.unionByName(back.filter("lo < hi OR size(lost) > 0").select("key", "s", "lo", F.when(F.size("lost") > 0, F.col("lost")).alias("lost")))


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_strings: int = SHARD_STRINGS, out: str = "_cut") -> DataFrame:
    """docs with the column `out`: n_bytes, n_removed, n_spans, kept (binary) and spans."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {out}")
    spark, mark = docs.sparkSession, fresh(docs)
    jvm.register(spark)
    given, which = F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)), F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    several = docs.select(given.alias("doc"), which.alias("which")).groupBy("doc").agg(F.min("which").alias("lo"), F.max("which").alias("hi")).filter("lo < hi")
    row = {"doc": given} | ({"which": which} if several.limit(1).count() else {})
    own = list(row)
    texts = docs.select(*[c.alias(k) for k, c in row.items()], F.col(text).cast("binary").alias("b"))
    runs = texts.select(*own, F.explode(F.call_udf("ll_anchors", "b")).alias("r"))
    shared = runs.groupBy(F.col("r.key").alias("key")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key")
    shared = written(shared, "suffix-keys")
    release(spark)
    flat = runs.select(*own, F.col("r.key").alias("key"), (F.col("r.first").cast("long") * 128 + F.col("r.n")).alias("at"))
    of_doc = flat.join(shared, "key").groupBy(*own).agg(F.collect_set(F.struct("key", "at")).alias("runs"))
    unpacked = F.transform("runs", lambda r: F.struct(r["key"].alias("key"), F.shiftright(r["at"], 7).cast("int").alias("first"), r["at"].bitwiseAND(127).cast("int").alias("n")))
    of_doc = written(of_doc.select(*own, unpacked.alias("runs")), "suffix-runs")
    dropped(shared)
    release(spark)
    cut = texts.join(of_doc.hint("shuffle_hash"), own).select(*own, F.explode(F.call_udf("ll_strings", "b", "runs")).alias("r"))
    places = written(cut.select(*own, "r.key", "r.first", "r.s", _print("r.s"), F.length("r.s").alias("size")), "suffix-strings")
    dropped(of_doc)
    release(spark)
    folded = written(places.groupBy("key", "s").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")), "suffix-folded")
    release(spark)
    light = written(places.select(*own, "key", "first", "size", "p"), "suffix-places")
    dropped(places)
    release(spark)
    lost = written(losses(folded, shard_strings).select("key", _print("s"), "lo", "lost"), "suffix-lost")
    dropped(folded)
    release(spark)
    whole = F.array(F.struct(F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("stop")))
    some = F.transform("lost", lambda x: F.struct((F.col("first") + x["begin"]).alias("begin"), (F.col("first") + x["stop"]).alias("stop")))
    hit = light.join(lost, ["key", "p"]).filter("lo < doc OR lost IS NOT NULL")
    spans = hit.select(*own, F.explode(F.when(F.col("lo") < F.col("doc"), whole).otherwise(some)).alias("span")).groupBy(*[F.col(k).alias(mark + k) for k in own]).agg(F.collect_list("span").alias(f"{mark}spans"))
    spans = written(spans, "suffix-spans")
    dropped(light, lost)
    release(spark)
    back = docs.join(spans.hint("shuffle_hash"), [c == F.col(mark + k) for k, c in row.items()], "left")
    return back.select(*[F.col(f"`{c}`") for c in docs.columns], F.call_udf("ll_without", F.col(text).cast("binary"), F.col(f"{mark}spans")).alias(out))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of their text. Cuts may fall inside a character; what is left of it is replaced by U+FFFD."""
    out = f"{fresh(docs)}cut"
    d = removed(docs, doc_id, text, out=out)
    return d.select(*[F.when(F.col(text).isNotNull(), F.make_valid_utf8(F.col(f"{out}.kept").cast("string"))).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i FROM w JOIN m ON w.s = m.s WHERE low < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS first FROM f),
h AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS z FROM h GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM r
      UNION ALL SELECT doc_id, max(z) + 1, NULL FROM r GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(hex(CASE WHEN x <= coalesce(y, octet_length(b)) THEN array_slice(b, x, coalesce(y, octet_length(b))) ELSE ''::BLOB END), '' ORDER BY x) AS kept
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, hex(b)))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

QUERIES = {"op1_suffix": op1_suffix}
ORACLES = {"op1_suffix": OP1_SQL}
