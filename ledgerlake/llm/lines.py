"""Line dedup over levelled sorted runs of line hashes (SQL functions only).

A run is a table (key, n_docs) in the shared folder, sorted by key and bucketed by it, so that runs are merged without a shuffle. A key of which a run
has counted min_docs documents is closed in it. A batch of documents is reduced to the number of its documents that hold each
key, merge-anti-joined with every run of every level (what is closed needs no more counting), and written as a run of level 0 of its own.
Where a level has two runs they are compacted: a merge join adds their counts, and the result is a run of the next level. The last
compactions leave one run, whose closed keys are the common lines; one more pass takes them out of the documents.

Keys are the 128 bits of md5 of the stripped, lower-cased line. Counts are combined map-side before any
shuffle, so one line in a third of all documents is one row from each task. In the last pass the lines with at least 1 of HOT of all counts, at most HOT
of them, are found by a broadcast, and only the others by a shuffle.

Defined results: every row is a document of its own, repeated rows too; a null or empty text is
one empty line; an empty key is shorter than min_chars = 1 and always stays; extra columns are kept
by `deduplicated`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, dropped, fresh, shared_path, table, written

#: One in so many of all counts makes a line hot, so there are at most as many hot lines.
HOT = 10_000


def line_key(line: Column, min_chars: int) -> Column:
    """In hexadecimal digits; null for lines that are too short to count."""
    k = ascii_lower(F.btrim(line, F.lit(WHITE)))
    return F.when(F.length(k) >= min_chars, F.md5(k))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


class LineRuns:
    """The runs of one corpus. `add` takes the batches one by one; `common` gives the keys that are in at least min_docs documents."""

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _stored(self, run: DataFrame, level: int) -> DataFrame:
        name, path = f"ledgerlake_lines_{uuid.uuid4().hex}", shared_path(self.spark, f"lines-run{level}")
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
        back = self.spark.table(name)
        back._written_at, back._name = path, name
        return back

    def _freed(self, *runs: DataFrame) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r._name}")
        dropped(*runs)

    def add(self, keys: DataFrame) -> None:
        """keys: a row (key) for each document of the batch that holds it."""
        run = keys.groupBy("key").agg(F.count("*").alias("n_docs"))
        for r in [r for level in self.levels for r in level]:
            run = run.join(r.filter(F.col("n_docs") >= self.min_docs).select("key").hint("merge"), "key", "left_anti")
        self._put(0, self._stored(run, 0))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        if not self.levels[level]:
            self.levels[level] = [run]
            return
        earlier = self.levels[level].pop()
        self._put(level + 1, self._compacted(earlier, run, level + 1))

    def _compacted(self, a: DataFrame, b: DataFrame, level: int) -> DataFrame:
        count = lambda r: F.coalesce(r["n_docs"], F.lit(0))
        both = a.hint("merge").join(b, a["key"] == b["key"], "full_outer")
        merged = self._stored(both.select(F.coalesce(a["key"], b["key"]).alias("key"), (count(a) + count(b)).alias("n_docs")), level)
        self._freed(a, b)
        return merged

    def common(self) -> DataFrame:
        """key, n_docs (those that were counted) of the closed keys, once all runs are one."""
        left = [r for level in self.levels for r in level]
        while len(left) > 1:
            left.append(self._compacted(left.pop(), left.pop(), len(self.levels)))
        self.levels = [left]
        if not left:
            return self.spark.createDataFrame([], "key binary, n_docs long")
        return left[0].filter(F.col("n_docs") >= self.min_docs)

    def close(self) -> None:
        self._freed(*[r for level in self.levels for r in level])
        self.levels = []


def common_keys(docs: DataFrame, text: str, min_docs: int, min_chars: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """The keys of the hot common lines, at most HOT, and those of the others. The keys are written once, apart for each batch, and each batch is then
    added by itself."""
    spark = docs.sparkSession
    keys = docs.select(
        F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).cast("int").alias("batch"),
        F.explode(F.array_distinct(F.transform(_lines(text), lambda x: line_key(x, min_chars)))).alias("key"),
    ).filter("key is not null")
    keys = written(keys.withColumn("key", F.unhex("key")), "line-keys", "batch")
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).select("key"))
    dropped(keys)
    common = runs.common()
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    hot = written(common.filter(F.col("n_docs") * HOT >= total).select("key"), "lines-hot")
    rest = written(common.filter(F.col("n_docs") * HOT < total).select("key"), "lines-common")
    runs.close()
    return hot, rest


def line_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 4, prefix: str = "_") -> DataFrame:
    """docs with two columns, named with the prefix: lines (all lines) and kept (the places of the lines that stay, from 0)."""
    if taken := {c.lower() for c in docs.columns} & {f"{prefix}lines", f"{prefix}kept"}:
        raise ValueError(f"docs have columns {sorted(taken)}")
    hot, rest = common_keys(docs, text, min_docs, min_chars, batches)
    places = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("at"),
        F.posexplode(F.transform(_lines(text), lambda x: line_key(x, min_chars))).alias("i", "hex"),
    ).filter("hex is not null")
    places = places.select("id", "at", "i", F.unhex("hex").alias("key")).join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "key", "left")
    # what is known already gets a key that meets nothing, each its own, so that no key has many rows
    places = places.withColumn("key", F.when(F.col("is_hot"), F.concat_ws(":", "id", "at", "i").cast("binary")).otherwise(F.col("key")))
    found = places.join(rest.withColumn("is_common", F.lit(True)), "key", "left").filter("is_hot OR is_common")
    mark = fresh(docs)
    out = found.groupBy(F.col("id").alias(f"{mark}id"), F.col("at").alias(f"{mark}at")).agg(F.collect_set("i").alias(f"{mark}out"))
    on = F.col(doc_id).eqNullSafe(F.col(f"{mark}id")) & (F.xxhash64(F.col(text)) == F.col(f"{mark}at"))
    # a hash table of the few places: the texts are shuffled once, but not sorted
    d = docs.join(out.hint("shuffle_hash"), on, "left").withColumn(f"{mark}lines", _lines(text))
    whole = F.sequence(F.lit(0), F.size(f"{mark}lines") - 1)
    stay = F.when(F.col(f"{mark}out").isNull(), whole).otherwise(F.array_except(whole, F.col(f"{mark}out")))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{mark}lines").alias(f"{prefix}lines"), stay.alias(f"{prefix}kept"))


def _kept_text(prefix: str = "_") -> Column:
    return F.array_join(F.transform(f"{prefix}kept", lambda i: F.element_at(f"{prefix}lines", i + 1)), "\n")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw) -> DataFrame:
    """docs with the common lines taken out of their text."""
    mark = fresh(docs)
    v = line_verdicts(docs, text, doc_id, prefix=mark, **kw)
    return v.select(*[_kept_text(mark).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = line_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    return v.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(_kept_text(), 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""

QUERIES = {"op3_lines": op3_lines}
ORACLES = {"op3_lines": OP3_SQL}
