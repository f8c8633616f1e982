"""Token ids of whole documents, in files of separately compressed documents.

Tokenizing: a tokenizer that drops white space, as its file says (`words_apart`), gives the same ids for the words between it as for the whole
text, so each distinct word that a worker meets goes through the tokenizers library once, many at a time, and the
ids of the texts are put together by array operations. Other tokenizers encode whole texts.

Files: a Parquet table of blocks in ascending order of doc_id, which any store that Spark reads can hold. A block has
`part` and `seq` (its place), first_doc and last_doc, the SHA-256 of the dictionary, the lists doc_ids, n_tokens and
offsets, and `payload`: for each document a zstandard frame of its own, made with the shared dictionary,
over the ids as little-endian integers of 2 bytes (4 if the vocabulary has over 65,536 ids). A document is
read by its offset, without the rest of its block. The dictionary is a table of one row next to the blocks
and is trained on slices of at most SAMPLE_BYTES bytes, from anywhere in the ids of at most 2 * SAMPLE_DOCS documents, so its making doesn't grow with the
input and neither do results depend on it. The index has the token count before each part and block.

Defined results: null and empty texts have the end id only; repeated doc_ids are documents of their own, next to each
other; null doc_ids come first; extra columns are ignored; an empty table gives an empty table of blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan
from .common import input_bytes, map_arrow, shared_path, table

SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 1024, 8192, 1 << 16, 3
BLOCK_BYTES = 1 << 20
#: Words whose ids a worker keeps.
KNOWN = 1 << 20
BLOCKS = "part int, seq int, first_doc long, last_doc long, dict_sha256 string, width int, doc_ids array<long>, n_tokens array<int>, offsets array<long>, payload binary"
_MARK = ""
_loaded: dict[str, Encoder] = {}


#: Alternatives of a split by a regular expression that can't match white space: contractions, letters or digits, and what is neither these nor white space.
_NO_SPACE = re.compile(r"'[a-z]+|\[(\\p\{[LN]\})+\]\+?|\[\^\\s(\\p\{[LN]\})*\]\+?")


def words_apart(path: str) -> bool:
    """Whether the file says that white space parts words and is dropped: no step of its normalizer reaches over white space (composed letters never contain
    it), its first split keeps only what can't contain any, and no added token does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    normal = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} for n in steps(spec["normalizer"], "normalizers"))
    first, *rest = [*steps(spec["pre_tokenizer"], "pretokenizers"), {}]
    split = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and all(map(_NO_SPACE.fullmatch, first["pattern"].get("Regex", " ").split("|")))
    plain = all(r.get("type", "ByteLevel") == "ByteLevel" and not r.get("add_prefix_space") and not r.get("use_regex") for r in rest)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return normal and split and plain and added


class Encoder:
    """A tokenizer file with ids for batches of texts."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), end_id
        self._forget()
        self.width = 2 if max(self.tok.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.mark = np.array(mark) if mark and words_apart(path) and ids(f"a {_MARK} b") == ids("a") + mark + ids("b") else None

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        flat, size, m = [], [], self.mark
        for lo in range(0, len(texts), 4096):
            some = texts[lo : lo + 4096]
            joined = f" {_MARK} ".join(some)
            if joined.count(_MARK) != len(some) - 1:
                each = self._each(some)
                flat += each
                size += map(len, each)
                continue
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            k = len(m)
            hit = ids[: len(ids) - k + 1] == m[0] if len(ids) >= k else np.zeros(0, bool)
            for j in range(1, k):
                hit &= ids[j : len(ids) - k + 1 + j] == m[j]
            ends = np.flatnonzero(hit)
            if len(ends) != len(some) - 1:
                each = self._each(some)
                flat += each
                size += map(len, each)
                continue
            begins = np.concatenate([[0], ends + k])
            size += list(np.concatenate([ends, [len(ids)]]) - begins)
            keep = np.ones(len(ids), bool)
            for j in range(k):
                keep[ends + j] = False
            flat.append(ids[keep])
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), np.array(size, np.int64)

    def of_words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in self.flat, and how many there are. Words that this worker has
        met are known by their hash; when over KNOWN are, it begins anew."""
        h, at, back = np.unique(scan.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN:
            self._forget()
        place = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != h[inside]
        if new.any():
            k = at[new]
            flat, size = self.distinct([bytes(buf[a:b]).decode() for a, b in zip(start[k].tolist(), end[k].tolist())])
            ends = len(self.flat) + np.cumsum(size)
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            order = np.searchsorted(self.known, h[new])
            self.known = np.insert(self.known, order, h[new])
            self.first = np.insert(self.first, order, ends - size)
            self.size = np.insert(self.size, order, size)
            place = np.searchsorted(self.known, h)
        return self.first[place][back], self.size[place][back]

    def _forget(self) -> None:
        self.known, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For ranges of texts: the first text, all ids with the end id after each text, and the offsets of the texts in them."""
        buf, at = scan.column_bytes(col)
        for lo, hi in scan.groups(at, 1 << 22):
            part, to = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            if self.mark is None:
                each = self._each([bytes(part[a:b]).decode() for a, b in zip(to[:-1], to[1:])])
                sizes = np.array([len(x) for x in each], np.int64)
                ids = np.concatenate(each)
            else:
                start, end, owner = scan.words(part, to, scan.SPACED)
                first, sizes_of = self.of_words(part, start, end)
                ends = np.cumsum(sizes_of)
                ids = self.flat[np.repeat(first - ends + sizes_of, sizes_of) + np.arange(ends[-1] if len(ends) else 0)]
                sizes = np.bincount(owner, sizes_of, hi - lo).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
            out = np.empty(offsets[-1], np.int64)
            is_end = np.zeros(offsets[-1], bool)
            is_end[offsets[1:] - 1] = True
            out[is_end], out[~is_end] = self.end, ids
            yield lo, out, offsets


def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker."""
    key = f"{path}:{end_id}"
    if key not in _loaded:
        _loaded[key] = Encoder(path, end_id)
    return _loaded[key]


def _serial(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _slice(b: bytes, width: int) -> bytes:
    """SAMPLE_BYTES of b, from a place that its checksum gives."""
    at = zlib.crc32(b) % (max(0, len(b) - SAMPLE_BYTES) // width + 1) * width
    return b[at : at + SAMPLE_BYTES]


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A zstandard dictionary from a bounded sample of documents; empty if there are too few for one."""
    import zstandard

    n = docs.count()
    every = max(1, n // SAMPLE_DOCS)

    def sample(batches):
        for b in batches:
            e = encoder(path, end_id)
            out = [_slice(_serial(ids[a:z], e.width), e.width) for _, ids, to in e.encode(b.column(0)) for a, z in zip(to[:-1], to[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.coalesce("text", F.lit("")).alias("text")).limit(2 * SAMPLE_DOCS)
    samples = [bytes(r[0]) for r in map_arrow(some, sample, "ids binary").collect()]
    if sum(map(len, samples)) < 8 * DICT_BYTES or len(samples) < 64:
        return b"".join(samples)[:DICT_BYTES]
    return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()


def _dict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> None:
    """docs(doc_id, text) as token files under the folder `out`: blocks, dictionary and index."""
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer, end_id)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")

    def blocks(batches):
        import zstandard
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        e = encoder(tokenizer, end_id)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(data), write_content_size=True)
        ids, sizes, frames, total = [], [], [], 0

        def block():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            row = [part, seq, ids[0], ids[-1], sha, e.width, ids, sizes, offsets.tolist(), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for lo, flat, to in e.encode(b.column("text")):
                for k in range(len(to) - 1):
                    frame = press.compress(_serial(flat[to[k] : to[k + 1]], e.width))
                    if frames and total + len(frame) > BLOCK_BYTES:
                        yield block()
                        seq, total = seq + 1, 0
                        ids, sizes, frames = [], [], []
                    ids.append(keys[lo + k])
                    sizes.append(int(to[k + 1] - to[k]))
                    frames.append(frame)
                    total += len(frame)
        if frames:
            yield block()

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
    names = ["part", "seq", "first_doc", "last_doc", "dict_sha256", "width", "doc_ids", "n_tokens", "offsets", "payload"]
    parts = max(1, input_bytes(docs) // (8 << 20))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    map_arrow(ordered, blocks, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    # tokens before each part (few rows), and before each block of it
    have = spark.read.schema(BLOCKS).parquet(f"{out}/blocks").select("part", "seq", "first_doc", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    sums = have.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    index = have.withColumn("of_block", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "part")
    index.select("part", "seq", "first_doc", (F.col("of_part") + F.col("of_block")).alias("start")).write.parquet(f"{out}/index")


def _opened(spark: SparkSession, out: str) -> bytes:
    data = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    return data


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, ids from the files. With doc_ids, only blocks that can hold them are read, and only their frames opened."""
    data = _opened(spark, out)
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    if doc_ids is not None:
        hit = F.lit(False)
        for i in doc_ids:
            hit = hit | ((F.col("first_doc").isNull() | (F.col("first_doc") <= i)) & (F.col("last_doc") >= i))
        blocks = blocks.filter(hit)
    index = spark.read.parquet(f"{out}/index").select("part", "seq", "start")
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches):
        for ids, starts, arrays in _frames(batches, data, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([a.tolist() for a in arrays], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return map_arrow(blocks.join(index, ["part", "seq"]), read, "doc_id long, start long, ids array<int>")


def _frames(batches, data: bytes, wanted: set | None = None):
    import zstandard

    sha = hashlib.sha256(data).hexdigest()
    press = zstandard.ZstdDecompressor(dict_data=_dict(data))
    for b in batches:
        for row in b.to_pylist():
            if row["dict_sha256"] != sha:
                raise ValueError(f"block {row['part']}/{row['seq']} was written with another dictionary: {row['dict_sha256']}")
            starts = row["start"] + np.concatenate([[0], np.cumsum(row["n_tokens"])])
            take = [k for k, i in enumerate(row["doc_ids"]) if wanted is None or i in wanted]
            whole, to = memoryview(row["payload"]), row["offsets"]
            arrays = [np.frombuffer(press.decompress(whole[to[k] : to[k + 1]]), f"<u{row['width']}") for k in take]
            yield [row["doc_ids"][k] for k in take], [int(starts[k]) for k in take], arrays


def digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read back from the files."""
    data = _opened(spark, out)

    def read(batches):
        for ids, starts, arrays in _frames(batches, data):
            crc = [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    index = spark.read.parquet(f"{out}/index").select("part", "seq", "start")
    return map_arrow(spark.read.schema(BLOCKS).parquet(f"{out}/blocks").join(index, ["part", "seq"]), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    out = shared_path(spark, "tokens")
    write_tokens(docs, out, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id)
    return digests(spark, out)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_tokens": op2_tokens}
ORACLES: dict[str, str] = {}
