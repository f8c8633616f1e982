"""Plain forms of the operators, for small inputs. Rows are (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = " \t\n\x0b\x0c\r"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def substrings(rows, size=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if least[b[k : k + size]] < i:
                gone[k : k + size] = [True] * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), sha(kept)))
    return out


def lines(rows, min_docs=10):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not key(x) or n[key(x)] < min_docs]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def chat(rows):
    """rows: conv_id, turn, role, text."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return out


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near(rows):
    sets, up = defaultdict(set), {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, t in rows:
        if i is not None:
            sets[i].add(shingles(t))
    flat = [(i, s) for i, every in sets.items() for s in every if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            n = len(a & b)
            if 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [(i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows]


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w, ln = WORD.findall(t), [x for x in t.split("\n") if x.strip(WHITE)]
        n = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for d in range(3)}
        sym, chars = sum(c in "#*$%&|<>" for c in t), sum(map(len, w))
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        bad = base or 10 * sym > 5 * len(w) or 100 * (len(ln) - len(set(ln))) > 60 * len(ln) or chars < 2 * len(w) or chars > 30 * len(w)
        out.append((i, len(w), chars, sym, len(ln) - len(set(ln)), len(hit), base, not bad))
    return out


def unigrams(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    n = Counter(x for i, w in words if not held(i) for x in w)
    total = sum(n.values())
    import math

    return [(i, held(i), len(w), sum(n[x] > 0 for x in w), total, sum(math.log10((n[x] + 1) / (total + len(n) + 1)) for x in w)) for i, w in words]


def leaks(rows, items, size=10):
    windows = []
    for i, t in items:
        w = LETTERS.findall((t or "").translate(LOWER))
        m = min(size, len(w))
        windows += [(i, tuple(w[k : k + m])) for k in range(len(w) - m + 1) if m]
    out = []
    for i, t in rows:
        w = LETTERS.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out
