"""Language-model scores: a causal self-attention model over subword ids, and a unigram base over words.

Texts are lower-cased in A-Z and parted into words by white space. Subwords are the greedy longest matches among all pieces of a
public vocabulary (which holds every single byte), with a mark on the last of each word; a document ends with a token of its own.

One pass over the texts writes, in the shared folder, each document's ids, each batch's words with their postings, and its
subword counts. From these: the counts of all words and subwords in all training documents, and the model (attention.py), which
gives the probability of each next subword. Subwords that no training document has share the probability that smoothing leaves them.

Training goes in rounds, each of which has its share of every document's windows; the rounds together have every window once.
In a round every task begins with the same parameters and walks over its windows; the tasks' parameters are then averaged, and their counts
summed. Tasks have TASK_TOKENS or more, so `score` depends on how the documents are dealt to files and tasks; for the same deal it
is the same. Windows of overlapping context score each token once.

Postings are cut to at most CHUNK places, so a word in all documents is many rows, which a skewed join splits.

Defined results: null and empty texts have the end only; rows are documents of their own, repeated ones too; a null doc_id is scored and is a
training document (its crc32 is null); extra columns are ignored; an empty table gives an empty table. Without training
documents all counts are 0 and the model is uniform over subwords.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, scan
from .common import map_arrow, release, shared_path, table, written
from .counts import Automaton, _letter_bytes

#: The mark of a word's last subword, beside the piece's number; the piece that stands for a document's end.
LAST, END, CODES = 1 << 16, (1 << 16) - 1, 1 << 17
CHUNK, GROUP_BYTES, GROUP_ROWS = 4096, 8 << 20, 1 << 16
#: Each round's windows, by the remainder of their number.
ROUNDS = ((0, 1), (1, 4), (4, 16), (16, 32))
TASK_TOKENS, BLOB = 8_000_000, 1 << 13
BATCH = attention.Trainer.BATCH
PARTS = "doc_id long, held boolean, block long, idx int, n_words long, ids binary, ends binary, hash long, cnt long, postings binary"
_loaded: dict[str, tuple[Automaton, np.ndarray]] = {}


def subwords(path: str) -> tuple[Automaton, np.ndarray]:
    """The automaton, and the number of each node's piece. One for each worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of, end = _letter_bytes(), model.get("end_of_word_suffix") or ""
        bare = {p.removesuffix(end) if end else p for p in model["vocab"]}
        found = sorted({bytes(of[c] for c in p) for p in bare if p and all(c in of for c in p)} | {bytes([b]) for b in range(256)})
        if len(found) > END:
            raise ValueError(f"{path} has over {END} pieces")
        auto = Automaton(found, found)
        number = np.zeros(len(auto.fail), np.int64)
        for k, p in enumerate(found):
            number[auto.node(p, 0)] = number[auto.node(p, 1)] = k
        _loaded[path] = auto, number
    return _loaded[path]


def pieces_of(path: str) -> int:
    return int(subwords(path)[1].max()) + 1


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word among the distinct ones, where each of these is first, and an order that brings equal words together."""
    back = pa.array(h).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    first = np.empty(int(back.max(initial=-1)) + 1, np.int64)
    first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
    order = np.argsort((back & 0xFFFF).astype(np.uint16), kind="stable")
    if len(first) > 1 << 16:
        order = order[np.argsort((back >> 16).astype(np.uint16)[order], kind="stable")]
    return back, first, order


def codes_of(auto: Automaton, number: np.ndarray, buf, start, end, first, back):
    """The codes of all words one after another, and how many each has; distinct words are looked at once."""
    nodes, n = auto.segments(buf, start[first], end[first])
    flat = number[nodes]
    stop = np.cumsum(n)
    flat[stop[n > 0] - 1] += LAST
    m = n[back]
    return flat[np.repeat((stop - n)[back] - np.cumsum(m) + m, m) + np.arange(m.sum())], m


def _binaries(at: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def frames(codes: np.ndarray, size: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Documents' codes as binary columns: pieces as little-endian integers of two bytes, and the marks as bits."""
    stop = np.cumsum(size)
    room = -(-size // 8)
    bits = np.zeros(int(8 * room.sum()), bool)
    bits[np.arange(len(codes)) + np.repeat(8 * (np.cumsum(room) - room) - (stop - size), size)] = codes >= LAST
    return _binaries(np.concatenate([[0], 2 * stop]), (codes & 0xFFFF).astype("<u2")), _binaries(np.concatenate([[0], np.cumsum(room)]), np.packbits(bits))


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def documents(ids: pa.Array, ends: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The way back from `frames`: all codes, and where each document begins."""
    pieces, at = _bytes(ids)
    bits, _ = _bytes(ends)
    at = at // 2
    size = np.diff(at)
    room = -(-size // 8)
    flag = np.unpackbits(bits)[np.arange(at[-1]) + np.repeat(8 * (np.cumsum(room) - room) - at[:-1], size)]
    return pieces.view("<u2") + (flag.astype(np.int32) << 16), at


def _parts(vocabulary: str):
    def parts(batches):
        from pyspark import TaskContext

        auto, number = subwords(vocabulary)
        block = TaskContext.get().partitionId() << 24
        counts = np.zeros(CODES, np.int64)
        for b in batches:
            buf, at = scan.column_bytes(b.column("text"))
            held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in scan.groups(at, GROUP_BYTES, GROUP_ROWS):
                part, to = scan.LOWER[buf[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
                start, end, owner = scan.words(part, to, scan.SPACED)
                h = scan.span_hashes(part, start, end).view(np.int64)
                back, first, order = distinct(h)
                n, train = scan.counts_in(owner, hi - lo), ~held[lo:hi]
                codes, m = codes_of(auto, number, part, start, end, first, back)
                size = np.bincount(owner, m, hi - lo).astype(np.int64) + 1
                stop = np.cumsum(size)
                whole = np.full(stop[-1], END + LAST, np.int32)
                is_end = np.zeros(stop[-1], bool)
                is_end[stop - 1] = True
                whole[~is_end] = codes
                counts += np.bincount(whole[np.repeat(train, size)], minlength=CODES)
                ids, ends = frames(whole, size)
                yield _rows(hi - lo, kind=1, doc_id=b.column("doc_id").slice(lo, hi - lo), held=held[lo:hi], block=np.full(hi - lo, block), idx=np.arange(hi - lo, dtype=np.int32), n_words=n, ids=ids, ends=ends)
                # postings: the documents of each word, cut to chunks
                ws, ds = back[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]])) if len(ws) else np.zeros(0, np.int64)
                run = np.arange(len(ws)) - np.repeat(new, np.diff(np.append(new, len(ws))))
                cut = np.flatnonzero(run % CHUNK == 0)
                upto = np.append(cut, len(ws))
                in_train = np.concatenate([[0], np.cumsum(train[ds])])
                yield _rows(len(cut), kind=0, block=np.full(len(cut), block), hash=h[first[ws[cut]]], cnt=in_train[upto[1:]] - in_train[upto[:-1]], postings=_binaries(2 * upto, ds.astype("<u2")))
                block += 1
        k = np.flatnonzero(counts)
        yield _rows(len(k), kind=2, hash=k, cnt=counts[k])

    return parts


_FIELDS = [("doc_id", pa.int64()), ("held", pa.bool_()), ("block", pa.int64()), ("idx", pa.int32()), ("n_words", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("hash", pa.int64()), ("cnt", pa.int64()), ("postings", pa.binary()), ("kind", pa.int32())]


def _rows(n: int, kind: int, **cols) -> pa.RecordBatch:
    cols["kind"] = np.full(n, kind, np.int32)
    arrays = [(pa.array(cols[c], t) if not isinstance(cols[c], pa.Array) else cols[c]) if c in cols else pa.nulls(n, t) for c, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in _FIELDS])


class Vocabulary:
    """The codes that training documents have, as rows; `prior` is their frequency, and in a last row that of each other code."""

    def __init__(self, counts: np.ndarray, possible: int):
        seen = np.flatnonzero(counts)
        self.row = np.full(CODES, len(seen), np.int32)
        self.row[seen] = np.arange(len(seen))
        self.prior = np.append(counts[seen] + 1.0, 1.0) / (counts.sum() + possible)
        self.last = np.append(seen >= LAST, False)


def _deal(col_ids: pa.Array, col_ends: pa.Array, vocabulary: Vocabulary, most: int):
    """Groups of documents: the first and the last, and their windows."""
    codes, at = documents(col_ids, col_ends)
    for lo, hi in scan.groups(at, most):
        yield lo, hi, *attention.padded(vocabulary.row[codes[at[lo] : at[hi]]], np.diff(at[lo : hi + 1]))


def _trainer(sent, turn: int):
    first, stop = ROUNDS[turn]
    period, rate = ROUNDS[-1][1], 1 - 0.9 * first / ROUNDS[-1][1]

    def train(batches):
        p, vocabulary = sent.value
        t = attention.Trainer(p, vocabulary.prior, turn == 0)
        for b in batches:
            idx = b.column("idx").to_numpy()
            for lo, _, rows, start, doc in _deal(b.column("ids"), b.column("ends"), vocabulary, 1 << 18):
                begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                number = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
                turn_of = (number + idx[lo + doc]) % period
                k = start[(turn_of >= first) & (turn_of < stop)]
                for s in range(0, len(k), t.BATCH):
                    t.step(rows[k[s : s + t.BATCH]], rate)
        if t.seen:
            flat = t.packed()
            for c in range(0, len(flat), BLOB):
                yield pa.RecordBatch.from_arrays([pa.array([c // BLOB]), pa.array([flat[c : c + BLOB].tobytes()], pa.binary())], ["c", "v"])

    return train


def _added(batches):
    """Rows (c, v) of one partition, which has all rows of its c: the sums of the vectors, which go on as they came."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, v in zip(b.column("c").to_pylist(), b.column("v")):
            got = np.frombuffer(v.as_buffer(), np.float32)
            if c in sums:
                sums[c] += got
            else:
                sums[c] = got.astype(np.float64)
    for c, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["c", "v"])


def trained(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> attention.Params:
    """docs(idx, ids, ends) of the training documents, and how many tokens they have. The driver sees one model at a time, whose size the vocabulary bounds."""
    p = attention.fresh(vocabulary.prior, vocabulary.last)
    tasks = max(1, tokens // TASK_TOKENS)
    for turn in range(len(ROUNDS)):
        sent = docs.sparkSession.sparkContext.broadcast((p, vocabulary))
        deltas = map_arrow(docs.select("idx", "ids", "ends").coalesce(tasks), _trainer(sent, turn), "c long, v binary")
        rows = map_arrow(deltas.repartition(64, "c"), _added, "c long, v binary").collect()
        if not rows:
            break
        total = np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(rows, key=lambda r: r["c"])])
        p = attention.unpacked(total, p, 1e5 if turn + 1 < len(ROUNDS) else float("inf"))
        sent.destroy()
        del deltas, rows
        release(docs.sparkSession)
    return p


def scored(p: attention.Params, theta: np.ndarray, vocabulary: Vocabulary, ids: pa.Array, ends: pa.Array) -> np.ndarray:
    """log10 probability of each document."""
    out = np.zeros(len(ids))
    for lo, hi, rows, start, doc in _deal(ids, ends, vocabulary, 1 << 17):
        for s in range(0, len(start), BATCH):
            got = attention.log_probs(p, theta, rows[start[s : s + BATCH]]).sum(1, dtype=np.float64)
            out[lo:hi] += np.bincount(doc[s : s + BATCH], got, hi - lo)
    return out / np.log(10)


def _scorer(sent):
    def score(batches):
        p, vocabulary = sent.value
        theta = attention.parts(p["counts"], vocabulary.prior)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("idx"), pa.array(scored(p, theta, vocabulary, b.column("ids"), b.column("ends")))], ["block", "idx", "score"])

    return score


def _sums(batches):
    """Rows (block, postings, c) to what each batch adds to its documents: block, idx, lg, known."""
    for b in batches:
        col = b.column("postings").cast(pa.large_binary())
        if not len(col):
            continue
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        idx = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u2").astype(np.int64)
        n = np.diff(at) // 2
        c = b.column("c").to_numpy(zero_copy_only=False)
        blocks, which = np.unique(b.column("block").to_numpy(), return_inverse=True)
        key = np.repeat(which << 16, n) + idx
        keys, back = np.unique(key, return_inverse=True)
        lg, known = np.bincount(back, np.repeat(np.log10(c + 1.0), n), len(keys)), np.bincount(back, np.repeat(c > 0, n), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(blocks[keys >> 16]), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(lg), pa.array(known)], ["block", "idx", "lg", "known"])


def scores(docs: DataFrame, vocabulary: str, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs(doc_id, text); held_out: a condition on doc_id."""
    spark = docs.sparkSession
    path = shared_path(spark, "lm")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    map_arrow(given, _parts(vocabulary), f"{PARTS}, kind int").write.partitionBy("kind").option("compression", "zstd").parquet(path)
    part = lambda k: spark.read.schema(f"{PARTS}, kind int").parquet(path).filter(F.col("kind") == k)
    texts = part(1)
    # all counts of the training documents
    words = written(part(0).groupBy("hash").agg(F.sum("cnt").alias("c")), "lm-words")
    n_words, v_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    ends = texts.filter("not held").count()
    total, distinct = n_words + ends, v_words + (ends > 0)
    code_counts = np.zeros(CODES, np.int64)
    for r in part(2).groupBy("hash").agg(F.sum("cnt").alias("n")).collect():  # at most CODES rows
        code_counts[r["hash"]] = r["n"]
    release(spark)
    codes = Vocabulary(code_counts, 2 * pieces_of(vocabulary) + 1)
    sent = spark.sparkContext.broadcast((trained(texts.filter("not held"), codes, int(code_counts.sum())), codes))
    lm = written(map_arrow(texts.select("block", "idx", "ids", "ends"), _scorer(sent), "block long, idx int, score double"), "lm-scores")
    sums = map_arrow(part(0).select("hash", "block", "postings").join(words, "hash").select("block", "postings", "c"), _sums, "block long, idx int, lg double, known long")
    sums = sums.groupBy("block", "idx").agg(F.sum("lg").alias("lg"), F.sum("known").alias("known"))
    per = texts.select("doc_id", "held", "block", "idx", "n_words").join(sums, ["block", "idx"], "left").join(lm, ["block", "idx"])
    n = F.col("n_words") + 1
    base = F.coalesce("lg", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0))) - n * F.lit(float(np.log10(total + distinct + 1.0)))
    return per.select(
        "doc_id", F.col("held").alias("held_out"), n.alias("n_tokens"), (F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return scores(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), held)


QUERIES = {"op7_lm": op7_lm}
ORACLES: dict[str, str] = {}
