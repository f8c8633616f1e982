"""Benchmark decontamination with suffix arrays over the training texts.

The training documents are cut into shards of bounded size. The words of a shard become numbers of the test
set's vocabulary (0 for all others, and between documents), and the shard's suffix array holds, in order, all
suffixes that begin with two words that stand next to each other somewhere in the test set (or with the only word of an item of one word):
no other suffix can be the answer to a search for a window. Every test suffix is binary-searched in every shard,
which gives its longest verbatim match and where that is. A window is hit where the longest match of a suffix that it begins is
as long as the window or longer; around that match stand all its occurrences.

The test set goes to the executors in blocks of at most BLOCK_WORDS words (or of one longer item), which the driver reads one after another; if
there are more blocks, the documents pass through one search after another, each adding its hits to those that it is given. After every PASSES
searches the documents are written and those blocks are freed, so the driver and the executors hold at most PASSES blocks.

Defined results: words are of letters, digits and all characters beyond ASCII, lower-cased in A-Z; null and empty texts have no
words and hit nothing; items without words have no windows, items with a null item_id count for hits, but aren't listed; repeated rows
are searched as rows of their own; extra columns stay where rows are kept; empty tables give no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import dropped, fresh, map_arrow, table, written

WINDOW = 10
#: Words of the test set in a block: 16 MB of numbers and hashes.
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 1 << 22
PASSES = 4
#: Words by which suffixes are ordered; longer matches are followed word by word.
DEPTH = 16


@dataclass
class TestBlock:
    """words: the sorted hashes of the vocabulary; text: items as numbers from 1, each followed by a 0 and more at the end;
    suffix, room: where each suffix begins, and its length; of: its item; window: for suffixes that begin a window, its length, else 0."""

    words: np.ndarray
    text: np.ndarray
    suffix: np.ndarray
    room: np.ndarray
    of: np.ndarray
    window: np.ndarray
    ids: list
    __test__ = False


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the text of each."""
    buf, at = scan.column_bytes(col)
    hashes, owners = [], []
    for lo, hi in scan.groups(at, 1 << 20):
        part, to = scan.LOWER[buf[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        start, end, owner = scan.words(part, to, scan.LETTERS)
        hashes.append(scan.span_hashes(part, start, end))
        owners.append(owner + lo)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def test_block(ids: list, texts: list[str], size: int = WINDOW) -> TestBlock:
    h, owner = word_hashes(pa.array(texts, pa.string()))
    words, number = np.unique(h, return_inverse=True)
    n = np.bincount(owner, minlength=len(texts))[: len(texts)] if len(texts) else np.zeros(0, np.int64)
    text = np.zeros(len(h) + len(texts) + DEPTH + 1, np.uint32)
    suffix = np.arange(len(h)) + owner
    text[suffix] = number + 1
    ends = np.cumsum(n) + np.arange(len(texts))
    room = ends[owner] - suffix if len(h) else np.zeros(0, np.int64)
    first = room == n[owner]
    window = np.where(room >= size, size, np.where(first, room, 0))
    return TestBlock(words, text, suffix, room, owner, window, ids)


def _keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first DEPTH numbers from each place, as strings of bytes that sort as the numbers do."""
    out = np.empty((len(at), DEPTH), ">u4")
    for j in range(DEPTH):
        out[:, j] = text[at + j]
    return out


def _as_bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(f"S{4 * keys.shape[1]}").ravel()


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The length of the common prefix of a from each i and b from each j, up to most."""
    n, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
    while len(live):
        x, y = i[live] + n[live], j[live] + n[live]
        same = (x < len(a)) & (y < len(b))
        same[same] = a[x[same]] == b[y[same]]
        live = live[same]
        n[live] += 1
        live = live[n[live] < most[live]]
    return n


class Searcher:
    """What binary search in a shard needs of a test block, worked out once for each worker."""

    def __init__(self, test: TestBlock):
        self.test, self.v = test, len(test.words) + 1
        t, s = test.text.astype(np.int64), test.suffix
        two = s[test.room >= 2]
        self.pairs = np.unique(t[two] * self.v + t[two + 1])
        self.single = np.unique(t[s[(test.window == 1)]])
        keys = _keys(test.text, s) if len(s) else np.zeros((0, DEPTH), ">u4")
        for j in range(DEPTH):  # what is after an item's end isn't part of its suffixes
            keys[test.room <= j, j] = 0
        self.keys = _as_bytes(keys)
        w = np.flatnonzero(test.window)
        depth = max(DEPTH, int(test.window.max(initial=0)))
        whole = np.zeros((len(w), depth), ">u4")  # all words of each window, also those beyond DEPTH
        for j in range(depth):
            on = test.window[w] > j
            whole[on, j] = test.text[s[w[on]] + j]
        _, one, which = np.unique(_as_bytes(whole), return_index=True, return_inverse=True) if len(w) else (w, w, w)
        low, high = whole[one, :DEPTH], whole[one, :DEPTH].copy()
        self.length, self.at = test.window[w][one], w[one]  # a suffix that begins with each distinct window
        high[np.arange(DEPTH)[None, :] >= self.length[:, None]] = 0xFFFFFFFF
        self.low, self.high = _as_bytes(low), _as_bytes(high)
        order = np.argsort(which, kind="stable")  # the items of each distinct window
        self.items, self.first = test.of[w][order], np.searchsorted(which[order], np.arange(len(low) + 1))

    def suffix_array(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the shard's suffixes in order, and their keys. text ends with DEPTH zeros."""
        t = text.astype(np.int64)
        here = np.flatnonzero(t[:-1])
        code = t[here] * self.v + t[here + 1]
        ok = np.zeros(len(here), bool)
        for known, values in ((self.pairs, code), (self.single, t[here])):
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                ok |= known[at] == values
        here = here[ok]
        keys = _as_bytes(_keys(text, here)) if len(here) else np.zeros(0, f"S{4 * DEPTH}")
        order = np.argsort(keys, kind="stable")
        return here[order], keys[order]

    def windows(self, text: np.ndarray, sa: np.ndarray, keys: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence of a window: its place and the number of the window; best: the longest match of each test suffix."""
        found = np.flatnonzero(best[self.at] >= self.length)
        lo, hi = np.searchsorted(keys, self.low[found], "left"), np.searchsorted(keys, self.high[found], "right")
        n = np.maximum(hi - lo, 0)
        which = np.repeat(found, n)
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, ok = sa[at], np.ones(len(at), bool)
        more = np.flatnonzero(self.length[which] > DEPTH)
        size = self.length[which[more]]
        ok[more] = _common(self.test.text, self.test.suffix[self.at[which[more]]], text, place[more], size) == size
        return place[ok], which[ok]

    def longest(self, text: np.ndarray, sa: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix the length of its longest match in the shard, and where one is."""
        t, s = self.test, self.test.suffix
        best, where = np.zeros(len(s), np.int64), np.full(len(s), -1)
        at = np.searchsorted(keys, self.keys, "left")
        # the neighbours of the place where the suffix would stand; equal keys can differ beyond DEPTH
        right = np.searchsorted(keys, self.keys, "right")
        for near in (at - 1, at):
            ok = np.flatnonzero((near >= 0) & (near < len(sa)))
            n = _common(t.text, s[ok], text, sa[near[ok]], t.room[ok])
            more = n > best[ok]
            best[ok[more]], where[ok[more]] = n[more], sa[near[ok[more]]]
        for k in np.flatnonzero((right - at > 1) & (best < t.room)):
            same = sa[at[k] : right[k]]
            n = _common(t.text, np.full(len(same), s[k]), text, same, np.full(len(same), t.room[k]))
            if n.max() > best[k]:
                best[k], where[k] = n.max(), same[n.argmax()]
        return best, where


def _shards(col: pa.Array, test: TestBlock):
    """For each shard: its first text, its words as numbers, the place where each text begins, and the number of words of each text."""
    buf, at = scan.column_bytes(col)
    for lo, hi in scan.groups(at, SHARD_BYTES):
        h, owner = word_hashes(col.slice(lo, hi - lo))
        number = np.zeros(len(h), np.uint32)
        if len(test.words):
            place = np.minimum(np.searchsorted(test.words, h), len(test.words) - 1)
            number = np.where(test.words[place] == h, place + 1, 0).astype(np.uint32)
        n = np.bincount(owner, minlength=hi - lo)[: hi - lo]
        text = np.zeros(len(h) + (hi - lo) + DEPTH + 1, np.uint32)
        text[np.arange(len(h)) + owner] = number
        yield lo, text, np.concatenate([[0], np.cumsum(n + 1)]), n


def _searcher(test: TestBlock, kept: dict = {}) -> Searcher:  # noqa: B006
    if kept.get("of") is not test:
        kept.update(of=test, searcher=Searcher(test))
    return kept["searcher"]


def hits_in(col: pa.Array, test: TestBlock, spans: list | None = None) -> tuple[np.ndarray, list, list]:
    """For each text: its words, the maximal runs of words that are hit (flat pairs of start and end), and its items.
    spans: runs that are known already."""
    s = _searcher(test)
    n_words, runs, items = [], [], []
    for lo, text, begin, n in _shards(col, test):
        sa, keys = s.suffix_array(text)
        best, _ = s.longest(text, sa, keys)
        place, which = s.windows(text, sa, keys, best)
        step = np.zeros(len(text) + 1, np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + s.length[which], -1)
        doc = np.searchsorted(begin, place, "right") - 1
        if spans is not None:
            for k in range(len(n)):
                for a, b in zip(spans[lo + k][::2], spans[lo + k][1::2]):
                    step[begin[k] + a] += 1
                    step[begin[k] + b] -= 1
        hit = np.concatenate([[False], np.cumsum(step) > 0])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        of = np.searchsorted(begin, edge[::2], "right") - 1
        pairs = (edge.reshape(-1, 2) - begin[of][:, None]) if len(edge) else np.zeros((0, 2), np.int64)
        upto = np.searchsorted(of, np.arange(len(n) + 1))
        runs += [pairs[a:b].ravel() for a, b in zip(upto[:-1], upto[1:])]
        both = np.unique(np.stack([doc, which]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
        m = s.first[both[1] + 1] - s.first[both[1]]
        d = np.repeat(both[0], m)
        it = s.items[np.repeat(s.first[both[1]] - np.cumsum(m) + m, m) + np.arange(m.sum())] if len(m) else np.zeros(0, np.int64)
        di = np.unique(np.stack([d, it]), axis=1) if len(d) else np.zeros((2, 0), np.int64)
        upto = np.searchsorted(di[0], np.arange(len(n) + 1))
        items += [[test.ids[x] for x in di[1][a:b]] for a, b in zip(upto[:-1], upto[1:])]
        n_words.append(n)
    return (np.concatenate(n_words) if n_words else np.zeros(0, np.int64)), runs, items


def test_blocks(benchmark: DataFrame, size: int = WINDOW):
    """The test set in blocks of bounded size, one empty block at least; one item is never in two."""
    ids, texts, n, found = [], [], 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"] or "")
        n += len(texts[-1]) // 2 + 1  # words are at least a character and a space
        if n >= BLOCK_WORDS:
            yield test_block(ids, texts, size)
            ids, texts, n, found = [], [], 0, True
    if ids or not found:
        yield test_block(ids, texts, size)


ADDED = ("words", "spans", "items")


def _freed(done: list, df: DataFrame, tag: str) -> DataFrame:
    """df written, and what it was made from let go: broadcasts, and a table written before."""
    back = written(df, tag)
    for x in done:
        dropped(x) if isinstance(x, DataFrame) else x.destroy()
    done[:] = [back]
    return back


def searched(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, prefix: str = "_") -> DataFrame:
    """docs with three columns, named with the prefix: words (number of words), spans (hit runs of words) and items (the items whose windows occur).
    Nothing is shuffled."""
    added = [prefix + x for x in ADDED]
    if taken := {c.lower() for c in docs.columns} & set(added):
        raise ValueError(f"docs have columns {sorted(taken)}")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = docs.withColumns({c: F.lit(None).cast(t) for c, t in zip(added, ("long", "array<long>", f"array<{kind}>"))})
    schema, sc, done = out.schema, docs.sparkSession.sparkContext, []
    for number, block in enumerate(test_blocks(benchmark, size)):
        if number and number % PASSES == 0:
            out = _freed(done, out, "decontam-searched")
        sent = sc.broadcast(block)
        done.append(sent)

        def search(batches, sent=sent):
            for b in batches:
                k = [b.schema.get_field_index(x) for x in ("text", *added)]
                known, before = b.column(k[2]), b.column(k[3])
                spans = None if known.null_count == len(known) else [x or [] for x in known.to_pylist()]
                n, runs, items = hits_in(b.column(k[0]), sent.value, spans)
                if before.null_count < len(before):
                    items = [sorted({*x, *(y or [])}, key=lambda v: (v is None, v)) for x, y in zip(items, before.to_pylist())]
                arrays = list(b.columns)
                arrays[k[1]] = pa.array(n, pa.int64())
                arrays[k[2]] = pa.array(runs, pa.list_(pa.int64()))
                arrays[k[3]] = pa.array(items, b.schema.field(k[3]).type)
                yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

        out = map_arrow(out, search, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, with the columns of docs."""
    prefix = fresh(docs)
    return searched(docs, benchmark, size, prefix).filter(F.size(f"{prefix}spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, size: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every test suffix in every shard, of `least` words or more: item_id, item_word, doc_id, doc_word, n_words."""
    ids, items = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    sc, found, done = docs.sparkSession.sparkContext, None, []
    for number, block in enumerate(test_blocks(benchmark, size)):
        if number and number % PASSES == 0:
            found = _freed(done, found, "decontam-matches")
        sent = sc.broadcast(block)
        done.append(sent)

        def search(batches, sent=sent):
            test = sent.value
            s = _searcher(test)
            start = np.concatenate([[True], test.of[1:] != test.of[:-1]]) if len(test.of) else np.zeros(0, bool)
            base = test.suffix[start][np.cumsum(start) - 1] if len(test.of) else test.suffix
            for b in batches:
                for lo, text, begin, _ in _shards(b.column(1), test):
                    best, where = s.longest(text, *s.suffix_array(text))
                    k = np.flatnonzero(best >= least)
                    doc = np.searchsorted(begin, where[k], "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([test.ids[x] for x in test.of[k]], pa.from_numpy_dtype(np.int64) if items == "bigint" else None),
                            pa.array((test.suffix - base)[k]), b.column(0).slice(lo).take(pa.array(doc)),
                            pa.array(where[k] - begin[doc]), pa.array(best[k]),
                        ],
                        ["item_id", "item_word", "doc_id", "doc_word", "n_words"],
                    )

        some = map_arrow(docs.select("doc_id", "text"), search, f"item_id {items}, item_word long, doc_id {ids}, doc_word long, n_words long")
        found = some if found is None else found.unionByName(some)
    return found


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = searched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["s"] + a["sign"] * x).alias("s"), (-a["sign"]).alias("sign")), lambda a: a["s"])
    names = F.array_sort(F.transform(F.filter("_items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    return d.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM t),
p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
o AS (SELECT p.doc_id, p.i, t.m, t.item_id FROM p JOIN t ON p.m = t.m AND p.k = t.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM o) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS x
      FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s.x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

QUERIES = {"op8_decontam": op8_decontam}
ORACLES = {"op8_decontam": OP8_SQL}
