"""Quality rules as a ledger of failure bits (SQL functions only).

Every rule is evaluated once for each document. The ledger, a table in the shared folder, stores a bit for each failed rule, and the
integer measurements that the rules were judged on. A policy is a named, versioned mask over the bits,
so that a changed policy costs a bitwise `and` over the stored ledger, not another pass over the texts; ablations come
from the counts of bit patterns. Policies, queries and the pipeline's stage read the ledger back.

Defined results: a null text has no words and no lines with a word, so it fails `few_words`; extra
columns are ignored by `ledger` and kept by `annotated` and `apply_policy`, whatever their names; repeated rows give repeated rows; a null
doc_id stays null; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, fresh, table, written

SYMBOLS = "#*$%&|<>"

#: Each rule: its name and the SQL condition on the measurements (in braces) under which a document
#: fails. The bit of a rule is its place in this tuple, so rules are only ever added at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "{n_words} < 50"),
    ("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"),
    ("symbols", "10 * {n_symbols} > 5 * {n_words}"),
    ("repeated_lines", "100 * {n_dup_lines} > 60 * {n_lines}"),
    ("short_words", "{word_chars} < 2 * {n_words}"),
    ("long_words", "{word_chars} > 30 * {n_words}"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """The rules that a version enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(name for name, _ in RULES))


def _word_hashes(text: Column) -> Column:
    spaced = F.translate(text, WHITE[1:], " " * 5)
    return F.transform(F.array_remove(F.split(spaced, " "), ""), lambda w: F.xxhash64(w))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measurements. Windows of three words are compared by 64-bit hashes within a document."""
    held = {m: f"{prefix}{m}" for m in MEASURES}
    t = F.coalesce(F.col(text), F.lit(""))
    h, w, r, at = (f"{prefix}__{x}" for x in ("h", "w", "r", "at"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    pair = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    d = docs.withColumn(h, _word_hashes(t))
    n3 = F.greatest(F.size(h) - 2, F.lit(0))
    two = F.zip_with(F.slice(h, F.lit(1), n3), F.slice(h, F.lit(2), n3), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice(h, F.lit(3), n3), lambda a, b: F.xxhash64(a, b))
    # windows in the order of their hash, with their place
    d = d.withColumn(w, F.array_sort(F.transform(three, lambda x, i: F.struct(x.alias("k"), i.alias("i")))))
    n = F.size(w)
    # both places of every two neighbours with one hash
    same = F.filter(
        F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), pair),
        lambda p: p["x"]["k"] == p["y"]["k"],
    )
    d = d.withColumn(r, same)
    both = F.concat(F.transform(r, lambda p: p["x"]["i"]), F.transform(r, lambda p: p["y"]["i"]))
    d = d.withColumn(at, F.array_sort(F.array_distinct(both)))
    m = F.size(at)
    gaps = F.zip_with(
        F.slice(at, F.lit(1), F.greatest(m - 1, F.lit(0))),
        F.slice(at, F.lit(2), F.greatest(m - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(3)),
    )
    covered = F.aggregate(gaps, F.when(m > 0, F.lit(3)).otherwise(F.lit(0)).cast("long"), lambda s, g: s + g)
    length = lambda drop: F.length(F.translate(t, drop, ""))
    d = d.withColumn(f"{prefix}__l", lines)
    d = d.withColumns(
        {
            held["n_words"]: F.size(h).cast("long"),
            held["word_chars"]: length(WHITE).cast("long"),
            held["n_symbols"]: (F.length(t) - length(SYMBOLS)).cast("long"),
            held["n_lines"]: F.size(f"{prefix}__l").cast("long"),
            held["n_dup_lines"]: (F.size(f"{prefix}__l") - F.size(F.array_distinct(f"{prefix}__l"))).cast("long"),
            held["n_repeat_words"]: covered,
        }
    )
    return d.drop(h, w, r, at, f"{prefix}__l")


def _bits(prefix: str = "") -> Column:
    names = {m: f"{prefix}{m}" for m in MEASURES}
    failed = [F.when(F.expr(cond.format(**names)), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, cond) in enumerate(RULES)]
    return sum(failed, F.lit(0).cast("long"))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored ledger, one row for each document: doc_id, the measurements and failure_bits."""
    d = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return written(d.select("doc_id", *MEASURES, _bits().alias("failure_bits")), "quality-ledger")


def annotated(docs: DataFrame, text: str = "text", prefix: str = "_q") -> DataFrame:
    """docs, stored with their ledger entries beside them: the measurements and failure_bits, with the prefix."""
    d = measured(docs, text, prefix)
    return written(d.withColumn(f"{prefix}failure_bits", _bits(prefix)), "quality-rows")


def passes(bits: Column | str, policy: Policy = STANDARD) -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(led: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many fail nothing else, which
    are those that dropping the rule would bring back. The counts of patterns are aggregated first, so
    the ledger is shuffled as at most 2^rules rows from each task."""
    patterns = led.groupBy(F.col("failure_bits").bitwiseAND(F.lit(policy.mask)).alias("pattern")).agg(F.count("*").alias("n"))
    names = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if (1 << k) & policy.mask]
    per = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in names])).alias("p")
    return (
        patterns.select("pattern", "n", per)
        .groupBy(F.col("p.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("pattern").bitwiseAND(F.col("p.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("pattern") == F.col("p.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
        .withColumn("policy", F.lit(policy.version))
    )


def apply_policy(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that the policy keeps."""
    prefix = fresh(docs, "_q")
    rows = annotated(docs, text, prefix)
    return rows.filter(passes(f"{prefix}failure_bits", policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    base = ~passes("failure_bits", BASE)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes("failure_bits", STANDARD)).alias("kept"), "failure_bits",
    )


OP6_SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM c, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN r ON a.doc_id IS NOT DISTINCT FROM r.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END)::BIGINT AS failure_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
       failure_bits = 0 AS kept, failure_bits FROM b
"""

def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the standard and of the base policy rejects, from one stored ledger."""
    led = ledger(table(spark, sf_dir, "documents"))
    return ablations(led, STANDARD).unionByName(ablations(led, BASE)).select("policy", "rule", "n_failed", "n_only")


def _ablations_sql(policy: Policy) -> str:
    rows = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if name in policy.rules]
    return " UNION ALL ".join(
        f"SELECT '{policy.version}' AS policy, '{name}' AS rule, (count(*) FILTER (WHERE failure_bits & {bit} <> 0))::BIGINT AS n_failed,"
        f" (count(*) FILTER (WHERE failure_bits & {policy.mask} = {bit}))::BIGINT AS n_only FROM led"
        for name, bit in rows
    )


ABLATIONS_SQL = f"WITH led AS ({OP6_SQL.strip()}) {_ablations_sql(STANDARD)} UNION ALL {_ablations_sql(BASE)}"

QUERIES = {"op6_quality": op6_quality, "quality_ablations": quality_ablations}
ORACLES = {"op6_quality": OP6_SQL, "quality_ablations": ABLATIONS_SQL}
