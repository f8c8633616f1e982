"""Token counts by a linear longest-match automaton, without building pieces.

The vocabulary is a trie over bytes. Each node has a failure link and the number of tokens that are popped when it
is followed (both worked out once, in order of depth), so a word's greedy longest-match length is found by one walk
over its bytes, however the pieces overlap. All distinct words of a batch walk the automaton in step, one
byte at a time, as array operations; a word that has ended leaves the walk. Words of over LONG bytes walk by themselves.

Vocabularies: a tokenizers file (.json), whose pieces may stand anywhere in a word (word-end marks are dropped and
byte-level letters are turned into their bytes), or a word-piece list (.txt), one piece in a line, where
`##` begins pieces that continue a word. A word that no sequence of pieces covers counts as one token and
as unknown.

Defined results: words are parted by white space, and A-Z are lower-cased if `lower`; null and empty texts have no
words; repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import scan
from .common import map_arrow, table

#: Bytes from which on a word walks by itself: few words are as long, and in step each byte of the longest costs a round.
LONG = 4096
_loaded: dict[str, Automaton] = {}


def _letter_bytes() -> dict[str, int]:
    """The byte for each letter of the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that can begin a word, and pieces that can continue one."""
    if path.endswith(".txt"):
        with open(path, encoding="utf-8") as f:
            rows = [x.rstrip("\n") for x in f]
        return [x.encode() for x in rows if x and not x.startswith("##")], [x[2:].encode() for x in rows if x.startswith("##") and len(x) > 2]
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of, end = _letter_bytes(), model.get("end_of_word_suffix") or ""
    found = set()
    for piece in model["vocab"]:
        bare = piece.removesuffix(end) if end else piece
        if bare and all(c in of for c in bare):
            found.add(bytes(of[c] for c in bare))
    return sorted(found), sorted(found)


class Automaton:
    """begin and go on: the pieces for the start and for the rest of a word. Node 0 is the root of the first, node 1 of the second."""

    def __init__(self, begin: list[bytes], go_on: list[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        order: list[tuple[int, int, int]] = []  # node, parent, byte
        depth = [0, 0]
        for root, words in ((0, begin), (1, go_on)):
            for w in words:
                v = root
                for c in w:
                    nxt = child[v].get(c)
                    if nxt is None:
                        nxt = child[v][c] = len(child)
                        child.append({})
                        ends.append(False)
                        depth.append(depth[v] + 1)
                        order.append((nxt, v, c))
                    v = nxt
                ends[v] = True
        n = len(child)
        fail: list[int] = [-1] * n
        popped: list[tuple[int, ...]] = [()] * n  # the nodes of the tokens
        for v, u, c in sorted(order, key=lambda x: depth[x[0]]):
            if ends[v]:
                fail[v], popped[v] = 1, (v,)
                continue
            z, k = fail[u], popped[u]
            while z >= 0 and c not in child[z]:
                k += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = child[z][c], k
        edges = [(v * 256 + c, x) for v in range(n) for c, x in child[v].items()]
        self._hash(np.array([k for k, _ in edges], np.int64), np.array([x for _, x in edges], np.int64))
        self.fail, self.popped = np.array(fail), np.array([len(x) for x in popped])
        self.pops = np.array([x for p in popped for x in p] or [0])
        self.first_pop = np.cumsum(self.popped) - self.popped
        self.child = child

    def node(self, piece: bytes, root: int = 1) -> int:
        for c in piece:
            root = self.child[root][c]
        return root

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Edges in a table of open addresses, half of them free."""
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.key, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.key[at] < 0
            self.key[at[free]] = keys[left[free]]  # of several with one address the last has it
            placed = self.key[at] == keys[left]
            self.to[at[placed]] = to[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = node * 256 + byte
        at = self._slot(key)
        have = self.key[at]
        ok = have == key
        left = np.flatnonzero(~ok & (have >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            have = self.key[at[left]]
            ok[left] = have == key[left]
            left = left[~ok[left] & (have >= 0)]
        return self.to[at], ok

    def segments(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trie nodes of the pieces of all words, one word after another, and how many each word has (0 where no pieces cover it)."""
        falls: list[tuple[np.ndarray, np.ndarray]] = []
        count = self.lengths(buf, start, end, falls)
        if not falls:
            return np.zeros(0, np.int64), np.maximum(count, 0)
        who, node = (np.concatenate(x) for x in zip(*falls))
        order = np.argsort(who, kind="stable")
        order = order[count[who[order]] >= 0]
        node = node[order]
        n = self.popped[node]
        return self.pops[np.repeat(self.first_pop[node] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.maximum(count, 0)

    def lengths(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, falls: list | None = None) -> np.ndarray:
        """Tokens of each word, -1 where no pieces cover it. falls: gets the words and nodes of each step along failure links."""
        size = end - start
        long = np.flatnonzero(size > LONG)
        walked = [self._walk(bytes(buf[start[k] : end[k]])) for k in long.tolist()]
        size = np.where(size > LONG, 0, size)
        order = np.argsort(-size, kind="stable")
        left = np.sort(size)[::-1]
        node, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        dead = np.zeros(len(start), bool)

        def fall(who: np.ndarray) -> np.ndarray:
            """Follow the failure links of some; those that have one."""
            f = self.fail[node[who]]
            dead[who[f < 0]] = True
            who, f = who[f >= 0], f[f >= 0]
            count[who] += self.popped[node[who]]
            if falls is not None:
                falls.append((who, node[who]))
            node[who] = f
            return who

        for i in range(int(left[0]) if len(left) else 0):
            live = order[: np.searchsorted(-left, -i)]  # words of over i bytes
            live = live[~dead[live]]
            while len(live):
                nxt, ok = self._step(node[live], buf[start[live] + i].astype(np.int64))
                node[live[ok]] = nxt[ok]
                live = fall(live[~ok])
        rest = np.flatnonzero(~dead & (node > 1))
        while len(rest):
            rest = fall(rest)
            rest = rest[node[rest] > 1]
        for k, (n, nodes) in zip(long.tolist(), walked):
            count[k] = n
            if falls is not None and nodes:
                falls.append((np.full(len(nodes), k), np.array(nodes)))
        return np.where(dead, -1, count)

    def _walk(self, word: bytes) -> tuple[int, list[int]]:
        """The same for one word, byte by byte."""
        node, count, nodes = 0, 0, []

        def fall() -> bool:
            nonlocal node, count
            f = int(self.fail[node])
            if f >= 0:
                count += int(self.popped[node])
                nodes.append(node)
                node = f
            return f >= 0

        for c in word:
            while (nxt := self.child[node].get(c)) is None:
                if not fall():
                    return -1, nodes
            node = nxt
        while node > 1:
            if not fall():
                return -1, nodes
        return count, nodes


def automaton(path: str) -> Automaton:
    """One for each worker."""
    if path not in _loaded:
        _loaded[path] = Automaton(*pieces(path))
    return _loaded[path]


def count_batch(auto: Automaton, col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, tokens and unknown words of each text."""
    buf, at = scan.column_bytes(col)
    out = np.zeros((3, len(at) - 1), np.int64)
    for lo, hi in scan.groups(at, 1 << 22):
        part, to = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        part = scan.LOWER[part] if lower else part
        start, end, owner = scan.words(part, to, scan.SPACED)
        _, first, back = np.unique(scan.span_hashes(part, start, end), return_index=True, return_inverse=True)
        n = auto.lengths(part, start[first], end[first])[back]
        out[0, lo:hi] = scan.counts_in(owner, hi - lo)
        out[1, lo:hi] = np.bincount(owner, np.abs(n), hi - lo)
        out[2, lo:hi] = np.bincount(owner, n < 0, hi - lo)
    return out[0], out[1], out[2]


def token_counts(docs: DataFrame, vocabulary: str, lower: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of docs(doc_id, text). Nothing is shuffled."""

    def count(batches):
        auto = automaton(vocabulary)
        for b in batches:
            cols = count_batch(auto, b.column(1), lower)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), count, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_counts": op10_counts}
ORACLES: dict[str, str] = {}
