"""Each operator against its plain form: usual rows, null and empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import attention, chat, counts, decontam, lines, lm, mixing, neardup, quality, registry, suffixdedup, tokens

from . import brute

VOCAB = public_tokenizers.path("word_bpe_49k.json")
CLASH = ["key", "doc", "p", "s", "_lines", "_kept", "_tokens", "n_words", "_qn_words", "_words", "_spans", "_items", "_cut", "value", "_s", "_gone", "lang", "source", "_id", "_copies", "_cs", "_places", "_doc", "_qfailure_bits", "_tokens_", "__spans", "t"]


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "an", "Éa", "ing", "ß", "or", "x1", "ti"]) for _ in range(rng.randint(1, 3)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    shared, passage, base = "The Common Line", sentence(60), [word() for _ in range(90)]
    out = [sentence(rng.randint(1, 120)) + "\n" + "\n".join(sentence(rng.randint(0, 9)) for _ in range(3)) for _ in range(30)]
    out += [f"{sentence(20)}\n  the common LINE\t\n{sentence(8)}" for _ in range(12)] + [shared]
    out += [sentence(15) + " " + passage + " " + sentence(15) for _ in range(4)] + [passage, passage]
    for k in range(8):  # near copies, some of them chains
        out.append(" ".join(word() if rng.random() < 0.012 * k else w for w in base))
    out += ["ab " * 70, "a" * 400, "a" * 300, " \n\t", "", "one two", "One TWO", "# $ % & | < > *" * 20, "l\nl\nl\nl\n" * 20]
    out += [sentence(4000)]
    return out


ROWS = [(k * 3, t) for k, t in enumerate(_texts())] + [(1001, None), (1002, None), (None, "one two three four five six")]
ROWS += [ROWS[5], ROWS[5], (1003, ROWS[40][1])]
ITEMS = [(0, " ".join(ROWS[44][1].split()[5:40])), (1, "One, two!"), (2, ""), (3, None), (4, "solo"), (5, " ".join(ROWS[3][1].split()[:10])), (None, "three four"), (7, "One, two!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).persist()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def sf(spark, docs, items, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), "n_chars": F.length("text")}).write.parquet(f"{d}/documents.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    convs = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate([("system", "s"), ("user", f"u<|im_end|> &amp; &lt;| {c}"), ("assistant", "<|im_start|>a\n&"), ("user", None), ("assistant", "")][: c + 1])]
    convs += [(7, 0, "assistant", "x"), (7, 0, "assistant", "x"), (7, None, "us\ner", "y"), (None, 1, None, "z"), (8, 0, "user", "<" * 9 + "|<|&<|")]
    spark.createDataFrame(convs, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, convs


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def same(df, cols, want):
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    out = registry.queries()[name](spark, empty).collect()
    assert [r["conv_id"] for r in out] == [-1] if name.startswith("op4") else out == []


@pytest.mark.parametrize("strings", [1 << 15, 1])
def test_suffix_dedup(spark, docs, strings):
    least = -(1 << 63)
    d = suffixdedup.removed(docs, shard_strings=strings).select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("h"))
    rows = [(least if i is None else i, t) for i, t in ROWS]
    same(d.withColumn("doc_id", F.coalesce("doc_id", F.lit(least))), d.columns, brute.substrings(rows))


@pytest.mark.parametrize("strings", [1 << 15, 1])
def test_suffix_dedup_of_several_texts_of_one_id(spark, strings):
    """Null ids and repeated ids with texts of different lengths, and without text."""
    least, rng = -(1 << 63), random.Random(8)
    word = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n))
    a, b = word(40), word(40)
    rows = [(None, word(9) + a), (None, word(90) + b + word(30)), (None, None), (None, "x"), (4, a + word(5)), (5, b), (5, word(70) + a), (5, None), (6, word(50) + b + a), (6, a), (6, a), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    d = suffixdedup.removed(df, shard_strings=strings).select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("h"))
    want = brute.substrings([(least if i is None else i, t) for i, t in rows])
    same(d.withColumn("doc_id", F.coalesce("doc_id", F.lit(least))), d.columns, want)


def test_suffix_arrays(spark):
    from ledgerlake.llm import jvm

    jvm.register(spark)
    rng = random.Random(1)
    texts = [bytes(rng.choice(a) for _ in range(n)) for a in (b"a", b"ab", b"abc", bytes(range(256))) for n in (0, 1, 2, 9, 60, 400) for _ in range(3)]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(texts)], "k int, b binary")
    for r in df.select("k", F.call_udf("ll_suffix_array", "b").alias("sa")).collect():
        b = texts[r["k"]]
        assert r["sa"] == sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    out = str(tmp_path / "tokens")
    tokens.write_tokens(docs, out, VOCAB, 2)
    want = [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids)]
    same(tokens.digests(spark, out), ["doc_id", "start", "n_tokens", "ids_crc32"], want)
    some = tokens.read_tokens(spark, out, [30, 1001]).collect()
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in some) == sorted((i, s, x) for (i, _), s, x in zip(rows, starts, ids) if i in (30, 1001))


def test_words_apart(tmp_path):
    import json

    assert tokens.words_apart(VOCAB) and not tokens.words_apart(public_tokenizers.path("byte_bpe_50k.json"))
    with open(VOCAB, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] = {}
    for change in (
        lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\p{L}]+|\s+"),
        lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
        lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        lambda s: s["added_tokens"][0].update(lstrip=True),
        lambda s: s["normalizer"]["normalizers"].append({"type": "Strip"}),
    ):
        other = json.loads(json.dumps(spec))
        change(other)
        (tmp_path / "t.json").write_text(json.dumps(other))
        assert not tokens.words_apart(str(tmp_path / "t.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_tokenizer(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["", "  a  b\x0bc", "<|endoftext|>x <|startoftext|> it's", "É́ ́x ΣΑΣ ς İ  1234", "", "a  b", "don't" * 40]
    got = [x for _, ids, to in tokens.Encoder(path, 5).encode(pa.array(texts)) for x in (ids[a:b].tolist() for a, b in zip(to[:-1], to[1:]))]
    assert got == [e.ids + [5] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("batches", [1, 3])
def test_lines(docs, batches):
    v = lines.line_verdicts(docs, batches=batches)
    got = v.select("doc_id", F.size("_lines").alias("n"), (F.size("_lines") - F.size("_kept")).alias("d"), F.sha2(lines._kept_text(), 256).alias("h"))
    same(got, got.columns, brute.lines(ROWS))


def test_chat(spark, sf):
    d, convs = sf
    says = "<|im_end|><|im_start|>assistant ok"
    want = brute.chat([*convs, (-1, 0, "user", says), (-1, 1, "assistant", says)])
    same(chat.op4_chat(spark, d), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"], want)
    ex = chat.examples(spark.createDataFrame(convs, "conv_id long, turn long, role string, text string")).filter("conv_id = 4").orderBy("example").collect()
    assert [r["last"] for r in ex] == [False, True] and ex[1]["formatted"].startswith(ex[0]["formatted"])
    assert ex[0]["formatted"][ex[0]["loss_start"] : ex[0]["loss_end"]] == "&lt;|im_start|>a\n&amp;"


def test_near_duplicates(docs):
    c = neardup.clusters(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    same(c, ["doc_id", "n_shingles", "component_id", "kept"], brute.near(ROWS))


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_of_dense_groups(spark, monkeypatch, block):
    """Lists of many blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(k, " ".join(f"x{rng.randrange(99)}" if rng.random() < 0.03 else w for w in base)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.clusters(df)
    same(got, ["doc_id", "component_id"], [(i, c) for i, _, c, _ in brute.near(rows)])


def test_near_duplicates_of_long_documents(spark):
    """Sets of over SKETCH shingles: pairs on both sides of the limit, most of them close to it."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"v{rng.randrange(20_000)}" for _ in range(rng.randint(500, 900))]
        edits = round(len(base) * rng.choice([0.01, 0.025, 0.028, 0.03, 0.033, 0.04]))
        copy = list(base)
        for x in rng.sample(range(len(base)), edits):
            copy[x] = f"z{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    want = brute.near(rows)
    linked = sum(not x[-1] for x in want)
    assert 15 < linked < 55
    same(neardup.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), ["doc_id", "n_shingles", "component_id"], [w[:3] for w in want])


def test_near_duplicates_of_several_texts_of_one_id(spark):
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(500)}" for _ in range(40)]
    a, b, c = text(), text(), text()
    near_a = [*a[:38], "x", "y"]
    rows = [(9, a), (9, b), (4, near_a), (4, []), (7, [*b, "z"]), (3, c), (None, a), (5, text()), (5, text()), (6, []), (2, c[:30])]
    rows = [(i, " ".join(w) if w else None) for i, w in rows]
    c = neardup.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    same(c, ["doc_id", "n_shingles", "component_id", "kept"], brute.near(rows))


def test_line_runs_close_keys_and_merge(spark, monkeypatch):
    """Seven batches: levels of runs, keys closed before the last batch, counts that only the merged runs reach."""
    from collections import Counter

    rng = random.Random(9)
    runs, total = lines.LineRuns(spark, 4), Counter()
    for _ in range(7):
        batch = [k for k in range(30) for _ in range(rng.choice([0, 0, 1, 1, 5]) if k < 20 else k == 25)]
        total.update(batch)
        runs.add(spark.createDataFrame([(bytearray([k]),) for k in batch], "key binary"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {r["key"][0] for r in runs.common().collect()} == {k for k, n in total.items() if n >= 4}
    runs.close()


@pytest.mark.parametrize("hot", [10_000, 3, 1])
def test_hot_lines(docs, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    test_lines(docs, 3)


def test_quality(docs):
    led = quality.ledger(docs)
    got = led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("failure_bits", quality.BASE)).alias("b"), quality.passes("failure_bits").alias("k"))
    same(got, got.columns, brute.quality(ROWS))
    assert quality.passes("failure_bits", quality.Policy("none", ())) is not None
    ab = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(led).collect()}
    bits = [r[0] for r in led.select("failure_bits").collect()]
    assert ab == {n: (sum(b >> k & 1 for b in bits), bits.count(1 << k)) for k, (n, _) in enumerate(quality.RULES)}


def test_lm_counts(spark, sf):
    got = lm.op7_lm(spark, sf[0]).collect()
    want = brute.unigrams(ROWS)
    key = lambda r: (repr(r[0]), *r[1:])
    pairs = list(zip(sorted(got, key=lambda r: key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]))), sorted(want, key=lambda w: key((*w[:4], w[5])))))
    for r, w in pairs:
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:5] and r["base_score"] == pytest.approx(w[5], rel=1e-9)
    assert len(got) == len(want) and all(r["score"] < 0 for r in got)


def _tiny_vocabulary(n=11):
    counts = np.zeros(lm.CODES, np.int64)
    counts[: n - 1] = np.arange(1, n)
    counts[lm.LAST + 3] = 5
    return lm.Vocabulary(counts, 100)


def _tiny_model(seed=0):
    v, rng = _tiny_vocabulary(), np.random.default_rng(seed)
    p = attention.fresh(v.prior, v.last)
    p = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) if k != "counts" else x for k, x in p.items()}
    return v, p, attention.parts(p["counts"], v.prior)


def _plain_score(p, theta, row, codes):
    """One document's log10 probability, token by token and place by place."""
    def link(x):
        bits = min(max(float(attention._SCALE) * x + float(attention._ONE), float(attention._LOW)), float(attention._HIGH))
        e = int(bits) >> 23
        return 2.0 ** (e - 127) * (1 + (int(bits) - (e << 23)) / (1 << 23))

    f = {k: x.astype(float) for k, x in p.items()}
    h, begin = attention.HEAD, len(theta)
    ids = [int(row[c]) for c in codes]
    at = lambda k: f["embed"][ids[k] if k >= 0 else begin]
    total = 0.0
    for t, y in enumerate(ids):
        first = t // attention.TARGETS * attention.TARGETS - attention.BEFORE - 1  # of the window
        q = at(t - 1) @ f["qkv"][:, :h]
        keys = range(first, t)
        w = [link(q @ (at(k) @ f["qkv"][:, h : 2 * h]) + f["near"][t - 1 - k]) for k in keys]
        mixed = sum(x * (at(k) @ f["qkv"][:, 2 * h :]) for x, k in zip(w, keys)) / sum(w)
        z = [link(x) for x in (at(t - 1) + mixed @ f["o"]) @ f["u"] + f["b"]]
        total += np.log10(sum(a * b for a, b in zip(z, theta[y].astype(float))) / sum(z))
    return total


def test_lm_scores_are_those_of_a_plain_forward():
    v, p, theta = _tiny_model()
    rng = np.random.default_rng(2)
    docs = [rng.choice([0, 1, 2, 5, 9, lm.LAST + 3, 77, lm.LAST + 9], n) for n in (1, 2, 24, 25, 70)]
    ids, ends = lm.frames(np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]))
    codes, at = lm.documents(ids, ends)
    assert [codes[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [d.tolist() for d in docs]
    got = lm.scored(p, theta, v, ids, ends)
    assert got.tolist() == pytest.approx([_plain_score(p, theta, v.row, d) for d in docs], rel=1e-5)


def test_lm_scores_of_the_query_are_the_models(spark, monkeypatch):
    """What Spark writes for each document is the plain score of its codes."""
    kept = {}

    def fixed(docs, vocabulary, tokens):
        p = attention.fresh(vocabulary.prior, vocabulary.last)
        kept.update(p=p, v=vocabulary)
        return p

    monkeypatch.setattr(lm, "trained", fixed)
    texts = ["The the of", "", None, "x" * 40 + " of of The"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.scores(df, VOCAB, F.col("doc_id") == 3).collect()}
    auto, number = lm.subwords(VOCAB)
    theta = attention.parts(kept["p"]["counts"], kept["v"].prior)
    for k, t in enumerate(texts):
        codes = []
        for w in brute.WORD.findall((t or "").translate(brute.LOWER)):
            b = np.frombuffer(w.encode(), np.uint8)
            nodes, _ = auto.segments(b, np.array([0]), np.array([len(b)]))
            codes += number[nodes].tolist()
            codes[-1] += lm.LAST
        assert got[k] == pytest.approx(_plain_score(kept["p"], theta, kept["v"].row, [*codes, lm.END + lm.LAST]), rel=1e-5)


def test_lm_probabilities_sum_to_one():
    v, p, theta = _tiny_model()
    unseen = 100 - (len(theta) - 1)
    assert np.allclose(theta[:-1].sum(0) + unseen * theta[-1], 1, atol=1e-5)
    rng = np.random.default_rng(0)
    row = rng.integers(0, len(theta), (1, attention.SPAN + 1)).astype(np.int32)
    total = 0.0
    for y in range(len(theta)):
        row[0, -1] = y
        total += np.exp(attention.log_probs(p, theta, row)[0, -1]) * (1 if y < len(theta) - 1 else unseen)
    assert total == pytest.approx(1, abs=1e-5)


def test_lm_trains_on_every_window_once():
    assert sorted(k for lo, hi in lm.ROUNDS for k in range(lo, hi)) == list(range(lm.ROUNDS[-1][1]))
    v, p, _ = _tiny_model()
    sizes = [1, 5, 24, 25, 900, 3000]
    ids, ends = lm.frames(np.arange(sum(sizes), dtype=np.int32) % 9, np.array(sizes))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes), dtype=np.int32)), ids, ends], ["idx", "ids", "ends"])

    class Sent:
        value = (p, v)

    seen = 0
    for turn in range(len(lm.ROUNDS)):
        out = list(lm._added(lm._trainer(Sent, turn)([batch])))
        seen += sum(np.frombuffer(b.column("v")[0].as_py(), np.float32)[0] for b in out if b.column("c")[0].as_py() == 0)
    assert seen == sum(sizes)


def test_lm_rounds_average_tasks():
    v, p, _ = _tiny_model()
    rows, start, _ = attention.padded(np.arange(600, dtype=np.int32) % 9, np.array([600]))
    tasks = []
    for k in range(2):
        t = attention.Trainer(p, v.prior, False)
        t.step(rows[start[k::2]], 1.0)
        tasks.append(t)
    new = attention.unpacked(sum(t.packed() for t in tasks), p, float("inf"))
    assert np.allclose(new["u"], sum(t.p["u"] * t.seen for t in tasks) / 600, atol=1e-5)
    assert np.allclose(new["embed"][10], p["embed"][10])  # of a token that no task has seen
    assert np.allclose(new["counts"], sum(t.p["counts"] for t in tasks), rtol=1e-4)


def test_lm_learns():
    """A text of one repeated pattern is predicted far better than by its tokens' frequencies."""
    v, _, _ = _tiny_model()
    p = attention.fresh(v.prior, v.last)
    rows, start, _ = attention.padded(np.tile(np.arange(8, dtype=np.int32), 3000), np.array([24_000]))
    t = attention.Trainer(p, v.prior, True)
    for s in range(0, len(start), 64):
        t.step(rows[start[s : s + 64]], 1.0)
    got = attention.log_probs(t.p, attention.parts(t.p["counts"], v.prior), rows[start[:50]]).mean()
    assert got > -1.2 > np.log(1 / 8)


def test_lm_gradients_and_causality(monkeypatch):
    """Against finite differences, with the exact exponential in place of the linear pieces."""
    monkeypatch.setattr(attention, "_exp", lambda bits: np.exp((np.clip(bits, attention._LOW, attention._HIGH).astype(np.float64) - attention._ONE) / attention._SCALE).astype(np.float32))
    v, p, theta = _tiny_model(4)
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 10, (3, attention.SPAN + 1)).astype(np.int32)
    rows[1, 20:] = -1
    loss = lambda: -attention.log_probs(p, theta, rows).sum(dtype=np.float64)
    d, (key, g, _), _, n = attention.gradients(p, theta, rows)
    assert n == (rows[:, attention.BEFORE + 1 :] >= 0).sum()
    d["embed"] = np.zeros_like(p["embed"])
    d["embed"][key] = g
    for k in d:
        at = np.unravel_index(np.abs(d[k]).argmax(), d[k].shape)
        was, e = p[k][at], np.float32(2e-2)
        p[k][at] = was + e
        up = loss()
        p[k][at] = was - e
        down = loss()
        p[k][at] = was
        assert d[k][at] == pytest.approx((up - down) / (2 * float(e)), rel=0.08, abs=0.05), k
    before = attention.log_probs(p, theta, rows)
    rows[:, 25:] = 1
    assert np.allclose(attention.log_probs(p, theta, rows)[0, :16], before[0, :16])


def test_windows_have_each_token_once():
    sizes = np.array([5, 0, 16, 1, 48, 49])
    rows, start, doc = attention.padded(np.arange(sizes.sum(), dtype=np.int32), sizes)
    targets = rows[start][:, attention.BEFORE + 1 :]
    assert sorted(targets[targets >= 0].tolist()) == list(range(sizes.sum()))
    before = rows[start][:, attention.BEFORE : -1]
    first = np.cumsum(sizes) - sizes
    ok = targets >= 0
    assert (before[ok] == np.where(np.isin(targets[ok], first), -1, targets[ok] - 1)).all() and (np.diff(doc) >= 0).all()


def test_decontamination(docs, items):
    d = decontam.searched(docs, items)
    names = F.array_sort(F.transform(F.filter("_items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    got = [(r["doc_id"], r["_words"], sum(b - a for a, b in zip(r["_spans"][::2], r["_spans"][1::2])), len(r["n"]), brute.sha(",".join(r["n"])), bool(r["_spans"])) for r in d.withColumn("n", names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.leaks(ROWS, ITEMS)))


def test_decontamination_in_blocks(docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 3)
    assert len(list(decontam.test_blocks(items))) > 3
    test_decontamination(docs, items)


@pytest.mark.parametrize("size", [1, 10, 16, 17, 25])
def test_decontamination_by_windows_of_any_size(size):
    """Texts and items that share 16 words and more before they differ."""
    w = [f"w{k}" for k in range(60)]
    items = [(0, " ".join(w[:40])), (1, " ".join([*w[:18], "other", *w[19:40]])), (2, " ".join(w[:20])), (3, "")]
    rows = [(k, " ".join([*w[a:b], "end", *w[c:d]])) for k, (a, b, c, d) in enumerate([(0, 16, 30, 50), (0, 17, 0, 40), (0, 18, 5, 30), (3, 28, 0, 24), (0, 20, 0, 0), (50, 60, 0, 3)])]
    rows.append((9, items[1][1]))
    n, runs, found = decontam.hits_in(pa.array([t for _, t in rows]), decontam.test_block([i for i, _ in items], [t for _, t in items], size))
    got = [(i, int(m), int(sum(b - a for a, b in zip(r[::2], r[1::2]))), len(x), brute.sha(",".join(sorted(map(str, x)))), len(r) > 0) for (i, _), m, r, x in zip(rows, n, runs, found)]
    assert got == brute.leaks(rows, items, size)


def test_hits_come_from_the_longest_matches_of_all_suffixes(monkeypatch):
    longest, seen = decontam.Searcher.longest, []

    def spy(self, *shard):
        seen.append(longest(self, *shard))
        return seen[-1]

    monkeypatch.setattr(decontam.Searcher, "longest", spy)
    test = decontam.test_block([0, 1], [" ".join(f"w{k}" for k in range(30)), "solo"])
    _, runs, _ = decontam.hits_in(pa.array(["x " + " ".join(f"w{k}" for k in range(5, 25)), "w1 w2 w3 solo"]), test)
    assert [r.tolist() for r in runs] == [[1, 21], [3, 4]]
    best, where = seen[0]
    assert best[:31].tolist() == [0, 3, 2, 0, 0, *range(20, 1, -1), 0, 0, 0, 0, 0, 0, 1] and where[5] == 1


def test_longest_matches(docs, items):
    got = decontam.matches(docs, items).filter("item_id = 0 AND item_word = 0").orderBy(F.desc("n_words")).first()
    w = brute.LETTERS.findall(ROWS[44][1].translate(brute.LOWER))
    item = brute.LETTERS.findall(ITEMS[0][1].translate(brute.LOWER))
    assert got["n_words"] == len(item) and (got["doc_id"] != ROWS[44][0] or w[got["doc_word"] : got["doc_word"] + len(item)] == item)


def _greedy(w, begin, go_on):
    n = at = 0
    while at < len(w):
        known = begin if at == 0 else go_on
        k = next((k for k in range(len(w) - at, 0, -1) if w[at : at + k] in known), 0)
        if not k:
            return 1, 1
        at, n = at + k, n + 1
    return n, 0


def test_token_counts(docs):
    begin, go_on = map(set, counts.pieces(VOCAB))
    want = []
    for i, t in ROWS:
        w = [x.encode() for x in brute.WORD.findall((t or "").translate(brute.LOWER))]
        g = [_greedy(x, begin, go_on) if len(x) < 300 else (counts.Automaton([b"a" * k for k in range(1, 20) if b"a" * k in begin], [b"a" * k for k in range(1, 20) if b"a" * k in go_on]).lengths(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0], 0) for x in w]
        want.append((i, len(w), int(sum(a for a, _ in g)), sum(b for _, b in g)))
    same(counts.token_counts(docs, VOCAB), ["doc_id", "n_words", "n_tokens", "n_unknown"], want)


@pytest.mark.parametrize("seed", range(4))
def test_word_pieces_with_unknown_words(seed, tmp_path):
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    begin, go_on = {piece() for _ in range(9)}, {piece() for _ in range(7)}
    (tmp_path / "v.txt").write_text("\n".join([*begin, *("##" + x for x in go_on)]))
    auto = counts.Automaton(*counts.pieces(str(tmp_path / "v.txt")))
    words = ["".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    n, t, u = counts.count_batch(auto, pa.array(words))
    assert list(zip(t, u)) == [_greedy(w, begin, go_on) for w in words] and (n == 1).all()


@pytest.mark.parametrize("seed", range(3))
def test_long_words_walk_as_others_do(seed, monkeypatch):
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))).encode()
    begin, go_on = sorted({piece() for _ in range(9)}), sorted({piece() for _ in range(7)} | ({b"a", b"b", b"c"} if seed else set()))
    auto = counts.Automaton(begin, go_on)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))).encode() for _ in range(80)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    together = auto.lengths(buf, start, end), *auto.segments(buf, start, end)
    monkeypatch.setattr(counts, "LONG", 20)
    apart = auto.lengths(buf, start, end), *auto.segments(buf, start, end)
    assert all((a == b).all() for a, b in zip(together, apart))
    assert (together[0] > 1).any() if seed else (together[0] < 0).any()  # covered words, and words that no pieces cover


def _plain_mixture(rows, exponent, seed=0):
    """rows: doc_id, source, text. For each document its copies and its places in the epochs that read it."""
    import hashlib
    from collections import defaultdict

    tokens = defaultdict(lambda: defaultdict(int))
    for i, s, t in rows:
        tokens[s][i] += max(len(brute.WORD.findall(t or "")), 1)
    top = max(sum(d.values()) for d in tokens.values())
    out = {}
    for s, d in tokens.items():
        total = sum(d.values())
        r = float(np.exp((1.0 - exponent) * (np.log(top) - np.log(total))))
        places = defaultdict(list)
        for e in range(int(r) + 1):
            order = sorted(d, key=lambda i: hashlib.md5(f"{'' if i is None else i}:{e}:{seed}".encode()).hexdigest())
            read = 0
            for place, i in enumerate(order):
                read += d[i]
                if e < int(r) or read <= int((r - int(r)) * total):
                    places[i].append(place)
        out |= {(i, s): (d[i], len(places[i]), places[i]) for i in d}
    return out


@pytest.mark.parametrize("blocks,supers", [(1024, 1024), (5, 2)])
def test_mixing(docs, monkeypatch, blocks, supers):
    """Budgets, copies and the place in every epoch's permutation, with one block and with many."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(mixing, "BLOCKS", supers)
    source = lambda i: "a" if i is not None and i % 9 == 0 else "b" if i is not None and i % 2 == 0 else None
    d = docs.withColumn("source", F.when(F.col("doc_id") % 9 == 0, "a").when(F.col("doc_id") % 2 == 0, "b"))
    m = mixing.mixed(d, max_repeats=4.0).select("doc_id", "source", "_tokens", "_copies", "_places").collect()
    rows = [(i, source(i), t) for i, t in ROWS]
    stats = {}
    for i, s, t in rows:
        stats[s] = stats.get(s, 0) + max(len(brute.WORD.findall(t or "")), 1)
    a = mixing.exponent(d.sparkSession.createDataFrame([(s, n) for s, n in stats.items()], "source string, tokens long"), 0.95, 4.0)
    want = _plain_mixture(rows, a)
    assert len(m) == len(ROWS) and {len(r["_places"]) for r in m} - {1}
    assert all((r["_tokens"], r["_copies"], r["_places"]) == want[r["doc_id"], r["source"]] for r in m)
    again = mixing.repeated(d, max_repeats=4.0)
    assert again.columns == d.columns and again.count() == sum(r["_copies"] for r in m)


def test_exponent(spark):
    s = lambda *n: spark.createDataFrame([(str(k), x) for k, x in enumerate(n)], "source string, tokens long")
    assert mixing.exponent(s(100), 0.9, 2) == mixing.exponent(s(5, 5), 0.9, 2) == 1.0
    a = mixing.exponent(s(1000, 10, 10), 0.9, 1e9)
    w = np.array([1000.0, 10, 10]) ** a
    p = w / w.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.9 * np.log(3), abs=1e-6)
    assert (1000 / 10) ** (1 - mixing.exponent(s(1000, 10), 0.99, 2)) == pytest.approx(2)


def test_clashing_columns_stay(docs, items):
    d = docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    outs = [quality.apply_policy(d), lines.deduplicated(d), neardup.kept(d), decontam.clean(d, items), mixing.repeated(d), suffixdedup.deduplicated(d)]
    for out in outs:
        assert out.columns == d.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH)
    for call in (lambda: decontam.searched(d, items), lambda: lines.line_verdicts(d), lambda: mixing.mixed(d), lambda: suffixdedup.removed(d)):
        with pytest.raises(ValueError, match="column"):
            call()


def test_written_tables_are_cleared(spark):
    import os

    from ledgerlake.llm import common

    df = common.written(spark.range(3).toDF("x"), "some")
    path = df._written_at.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    kept, common._made[spark.sparkContext.applicationId] = common._made[spark.sparkContext.applicationId], {df._written_at}
    common.clear(spark)
    assert not os.path.exists(path) and not common._made[spark.sparkContext.applicationId]
    common._made[spark.sparkContext.applicationId] = kept - {df._written_at}


def test_shared_folder_must_be_named_on_a_cluster():
    from ledgerlake.sources.storage import shared_dir

    class Conf:
        def get(self, _):
            return None

    class Session:
        class sparkContext:
            master, applicationId, getConf = "spark://host:7077", "x", staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_pipeline(spark, sf):
    d, _ = sf
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    good = [r for r, q in zip(docs, brute.quality([r[:2] for r in docs])) if q[-1]]
    good = [r for r, n in zip(good, brute.near([r[:2] for r in good])) if n[-1]]
    good = [r for r, x in zip(good, brute.leaks([r[:2] for r in good], ITEMS)) if not x[-1]]
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in good} and len(good) > 5
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert re.match("quality", corpus_pipeline.STAGES[0][0]) and len(corpus_pipeline.STAGES) == 5
