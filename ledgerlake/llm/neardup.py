"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Each document's set of shingles (five words) is hashed once. It keeps n_shingles, a 128-bit print of the whole
   set, its SKETCH lowest hashes and, of those, the KEYS lowest whole. Documents with the same set are folded
   to the one with the least doc_id.
2. Inverted lists: of its KEYS lowest values, a document goes into the lists of the LISTS lowest that another
   document has too. A document of which fewer than a quarter of the keys are shared has no partner, but for a chance of
   under 1e-7 at a similarity of 0.75. Two documents
   with a similarity of 0.75 share no list with a chance of 0.25^12 = 6e-8.
3. Lists are cut into blocks of at most about BLOCK documents, and every pair of blocks is looked at by itself, so a list
   of any length is spread over tasks. A pair is looked at in one list only, that of the least value that both
   have. The sketch of the union estimates the similarity; pairs within five standard errors of 0.75 go on. Pairs of sets
   that the sketches hold whole are decided at once, and of the links among them only a spanning forest goes on.
4. The whole sets decide. Each document is first held against its likeliest partner; components are formed, and then all
   other pairs that would join two components are decided, so no link between components is left out, and pairs
   inside a component cost nothing.
5. Components of all links, by star steps (components.py).

Defined results: null or empty texts, and texts without words, have the empty set, are linked with nothing and are kept; with
fewer than five words the whole sequence is one shingle; rows with one doc_id are one node, which has the links of all
its texts; a row whose doc_id is null
can't be named by a link: its component is null, and it is kept; extra columns stay where rows are kept;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import fresh, input_bytes, map_arrow, release, table, written
from .components import components

SHINGLE, PERCENT = 5, 75
SKETCH, KEYS, LISTS, BLOCK = 256, 24, 12, 512
#: Up to so many ids (8 bytes each) are broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Fills sketches of fewer values.
_NONE = np.iinfo(np.int32).max
_FILL = np.iinfo(np.int64).max


def shingle_sets(col: pa.Array):
    """The set of each text, in order, as an ascending array of hashes."""
    buf, at = scan.column_bytes(col)
    for lo, hi in scan.groups(at, 1 << 20):
        part, to = scan.LOWER[buf[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        start, end, owner = scan.words(part, to, scan.SPACED)
        h = scan.span_hashes(part, start, end)
        n = scan.counts_in(owner, hi - lo)
        first = np.concatenate([[0], np.cumsum(n)])
        fives = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            fives = scan.mix(fives + h[j : len(h) - SHINGLE + 1 + j] + np.uint64(j + 1)) if len(fives) else fives
        fives = fives.view(np.int64)
        for k in range(hi - lo):
            a, m = first[k], n[k]
            if m >= SHINGLE:
                yield np.unique(fives[a : a + m - SHINGLE + 1])
            elif m:
                x = np.uint64(m) << np.uint64(32)
                for w in h[a : a + m]:
                    x = scan.mix(np.array([x ^ w]))[0]
                yield np.array([x], np.uint64).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


FACTS = "doc_id long, n_shingles long, p1 long, p2 long, keys array<long>, sketch binary"


def _facts(batches):
    for b in batches:
        n, p1, p2, keys, sketch = [], [], [], [], []
        for s in shingle_sets(b.column(1)):
            p = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            n.append(len(s))
            p1.append(p[0])
            p2.append(p[1])
            keys.append(s[:KEYS])
            sketch.append(s.astype("<i8").tobytes() if len(s) <= SKETCH else (s[:SKETCH] >> 32).astype("<i4").tobytes())
        arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "p1", "p2", "keys", "sketch"])


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(shingle_sets(b.column(1))), pa.list_(pa.int64()))], ["doc", "shingles"])


def _estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of padded sketches: the similarity by the sketch of the union, and from where on a pair goes on."""
    top = np.full(len(a), _NONE, np.int64)
    for s, n in ((a, na), (b, nb)):
        top = np.where(n > SKETCH, np.minimum(top, s[:, -1]), top)
    x = np.sort(np.concatenate([a, b], axis=1), axis=1)
    inside = (x <= top[:, None]) & (x != _NONE)
    twice = inside[:, 1:] & (x[:, 1:] == x[:, :-1])
    shared, seen = twice.sum(1), inside.sum(1)
    union = np.maximum(seen - shared, 1)
    whole = np.maximum((na + nb) / 1.75, union)
    error = np.sqrt(0.1875 / union * (1 - union / whole))
    return shared / union, np.maximum(PERCENT / 100 - 5 * error - 1e-9, 0.3)


def _pairs_of(lo: int, cut: int, hi: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows lo..hi: within one block, or of a row before cut with a row after it."""
    if same:
        i, j = np.triu_indices(hi - lo, 1)
        return i + lo, j + lo
    return np.repeat(np.arange(lo, cut), hi - cut), np.tile(np.arange(cut, hi), cut - lo)


class Forest:
    """Sets of documents that pairs have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def joins(self, a: int, b: int) -> bool:
        """Whether the pair joins two sets; they are one from now on."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _evaluated(doc, n, value, keys, sketch, whole_of, sets, label, forest: Forest, i, j) -> pa.RecordBatch:
    """The pairs (i, j) of rows that go on. Where both sketches are whole sets (rows whole_of of sets) they are decided here: of such pairs only
    those go on that are links and join what others in this list have not, so a group of n documents gives n - 1 of them. label: the forest's set of
    each row, as of the pairs before these."""
    k = (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (doc[i] != doc[j])
    k &= (label[i] != label[j]) | (n[i] > SKETCH) | (n[j] > SKETCH)  # what is joined already needs no look
    i, j = i[k], j[k]
    x = np.sort(np.concatenate([keys[i], keys[j]], axis=1), axis=1)
    earlier = ((x[:, 1:] == x[:, :-1]) & (x[:, 1:] < value[i][:, None])).any(1)
    i, j = i[~earlier], j[~earlier]
    est, least = _estimate(sketch[i], sketch[j], n[i], n[j])
    ok = est >= least
    whole = np.flatnonzero(ok & (n[i] <= SKETCH) & (n[j] <= SKETCH))
    if len(whole):
        x = np.sort(np.concatenate([sets[whole_of[i[whole]]], sets[whole_of[j[whole]]]], axis=1), axis=1)
        both = ((x[:, 1:] == x[:, :-1]) & (x[:, 1:] != _FILL)).sum(1)
        link = 100 * both >= PERCENT * (n[i[whole]] + n[j[whole]] - both)
        ok[whole] = [y and forest.joins(a, b) for y, a, b in zip(link.tolist(), doc[i[whole]].tolist(), doc[j[whole]].tolist())]
        if ok[whole].any():
            label[:] = [forest.find(d) for d in doc.tolist()]
    i, j = i[ok], j[ok]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j])), pa.array(est[ok])], ["a", "b", "est"])


def _candidates(batches):
    """Rows (value, bi, bj, side, doc, n, keys, sketch), sorted by value, bi, bj and side, as pairs of documents."""
    held: pa.Table | None = None

    def flush(t: pa.Table):
        doc, n, value = (t.column(c).to_numpy() for c in ("doc", "n", "value"))
        bi, bj, side = (t.column(c).to_numpy() for c in ("bi", "bj", "side"))
        keys = np.full((len(doc), LISTS), np.iinfo(np.int64).max)
        for r, k in enumerate(t.column("keys").to_pylist()):
            keys[r, : len(k)] = k
        # padding must not look like a shared key: every row gets its own
        pad = keys == np.iinfo(np.int64).max
        keys = np.where(pad, np.iinfo(np.int64).max - np.arange(len(doc))[:, None] - 1, keys)
        sketch = np.full((len(doc), SKETCH), _NONE, np.int32)
        whole_of = np.cumsum(n <= SKETCH) - 1
        sets = np.full((int((n <= SKETCH).sum()), SKETCH), _FILL)
        for r, s in enumerate(t.column("sketch").to_pylist()):
            if n[r] <= SKETCH:
                got = np.frombuffer(s, "<i8")
                sets[whole_of[r], : len(got)] = got
                sketch[r, : len(got)] = got >> 32
            else:
                sketch[r] = np.frombuffer(s, "<i4")
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        begin = np.append(np.flatnonzero(new), len(doc))
        some, m, forest, label = [], 0, Forest(), doc.copy()
        for lo, hi in zip(begin[:-1], begin[1:]):
            if hi - lo < 2:
                continue
            same = bi[lo] == bj[lo]
            cut = lo + int(np.searchsorted(side[lo:hi], 1))
            i, j = _pairs_of(lo, cut, hi, same)
            for x in range(0, len(i), 1 << 14):
                some.append((i[x : x + (1 << 14)], j[x : x + (1 << 14)]))
                m += len(some[-1][0])
                if m >= 1 << 13:
                    yield _evaluated(doc, n, value, keys, sketch, whole_of, sets, label, forest, *map(np.concatenate, zip(*some)))
                    some, m = [], 0
        if some:
            yield _evaluated(doc, n, value, keys, sketch, whole_of, sets, label, forest, *map(np.concatenate, zip(*some)))

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        value, bi, bj = (t.column(c).to_numpy() for c in ("value", "bi", "bj"))
        last = len(value) - 1
        k = last
        while k > 0 and (value[k - 1], bi[k - 1], bj[k - 1]) == (value[last], bi[last], bj[last]):
            k -= 1
        if k:
            yield from flush(t.slice(0, k))
        held = t.slice(k)
    if held is not None and len(held):
        yield from flush(held)


def candidate_pairs(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, est: pairs of folded documents that the sketches can't tell to be below the limit."""
    mine = facts.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = mine.select("doc_id", "n_shingles", "keys").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    value = keys.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("keys").alias("value"))
    shared = value.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    of_doc = (
        value.join(shared, "value")
        .groupBy("doc", "n")
        .agg(F.sort_array(F.collect_list(F.struct("value", "df"))).alias("lists"))
        .filter(F.size("lists") >= F.greatest(F.lit(1), F.floor(F.least("n", F.lit(KEYS)) / 4)))
        .withColumn("lists", F.slice("lists", 1, LISTS))
    )
    of_doc = written(of_doc, "near-lists")
    release(facts.sparkSession)
    sketches = mine.select(F.col("doc_id").alias("doc"), "sketch").join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
    rows = of_doc.join(sketches, "doc").select("doc", "n", F.col("lists.value").alias("keys"), "sketch", F.explode("lists").alias("l"))
    blocks = F.ceil(F.col("l.df") / BLOCK).cast("int")
    rows = rows.select("doc", "n", "keys", "sketch", F.col("l.value").alias("value"), blocks.alias("nb"), F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("mine"))
    rows = rows.select("doc", "n", "keys", "sketch", "value", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.select(
        "value", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "doc", "n", "keys", "sketch",
    )
    parts = max(12, input_bytes(facts) // (4 << 20))
    dealt = rows.repartition(parts, "value", "bi", "bj").sortWithinPartitions("value", "bi", "bj", "side")
    return written(map_arrow(dealt, _candidates, "a long, b long, est double"), "near-pairs")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    x = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    both = x.select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.filter(F.lit(100).cast("long") * F.col("i") >= F.lit(PERCENT) * (F.col("sum") - F.col("i"))).select("a", "b")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = written(map_arrow(docs, _facts, FACTS), "near-facts")
    several = facts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("p1") < F.max("p1")).alias("several")).filter("several")
    if not several.limit(1).count():
        return _clusters(docs, facts)
    # texts get ids of their own; what they link then links the doc_ids
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    renamed = docs.withColumn("doc_id", own)
    found = _clusters(renamed, written(map_arrow(renamed, _facts, FACTS), "near-facts")).filter("doc_id IS NOT NULL").distinct()
    found = written(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), own.alias("doc_id")).distinct().join(found, "doc_id").select("id", "component_id"), "near-texts")
    least = found.groupBy("component_id").agg(F.min("id").alias("v"))
    named = components(found.join(least, "component_id").select(F.col("id").alias("u"), "v").filter("u <> v").distinct())
    return facts.select("doc_id", "n_shingles").join(named.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _clusters(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """The same where rows of one doc_id have one set; facts are those of docs."""
    spark = docs.sparkSession
    print_ = ["p1", "p2", "n_shingles"]
    reps = written(facts.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*print_).agg(F.min("doc_id").alias("rep")), "near-reps")
    pairs = candidate_pairs(facts, reps)
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = written(map_arrow(docs.join(some, "doc_id", "left_semi").select("doc_id", "text"), _sets, "doc long, shingles array<long>").dropDuplicates(["doc"]), "near-sets")
    release(spark)
    # first each document with its likeliest partner
    sides = pairs.select(F.col("a").alias("x"), F.struct("est", (-F.col("b")).alias("m")).alias("p")).unionByName(pairs.select(F.col("b").alias("x"), F.struct("est", (-F.col("a")).alias("m")).alias("p")))
    best = sides.groupBy("x").agg(F.max("p").alias("p")).select(F.least("x", -F.col("p.m")).alias("a"), F.greatest("x", -F.col("p.m")).alias("b")).distinct()
    links = written(confirmed(best, sets), "near-links")
    parts = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    release(spark)
    # then all pairs that are still in two components
    at = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    open_ = pairs.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    open_ = open_.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    more = written(confirmed(open_, sets), "near-links")
    parts = components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    release(spark)
    named = reps.join(parts, reps["rep"] == parts["node"], "left").select(*print_, F.coalesce("component", "rep").alias("component"))
    of_row = facts.select("doc_id", *print_).join(named, print_, "left")
    return of_row.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(table(spark, sf_dir, "documents"))
    return c.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that stay: one document of each component, the one with the least doc_id."""
    mark = fresh(docs)
    gone = clusters(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[mark], "left_anti")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""

QUERIES = {"op5_neardup": op5_neardup}
ORACLES = {"op5_neardup": OP5_SQL}
