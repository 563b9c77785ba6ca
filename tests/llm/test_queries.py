"""The registered queries on a small folder of tables, against slow plain-Python versions of what they compute."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import features, fingerprint, language, quality
from casegraph.llm.queries import QUERIES
from tests.llm.test_llm import brute_hits, brute_near, brute_substrings, corpus, sentence

M = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def span(word):
    h = 0
    for k, c in enumerate(word):
        h = (h + (c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) & M
    return mix((h + len(word)) & M)


def word(w):
    """Eight bytes at a time through the finaliser; longer words by BLAKE2b."""
    if len(w) > 64:
        return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = (len(w) * 0x9E3779B97F4A7C15) & M
    for k in range(0, len(w), 8):
        h = mix(h ^ int.from_bytes(w[k : k + 8], "little"))
    return h


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return [w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def rows_of(seed=3):
    rng = random.Random(seed)
    rows = corpus(seed)
    rows += [(300 + k, sentence(rng, 60) if k % 2 else " ".join([sentence(rng, 1)] * 50)) for k in range(60)]
    item = sentence(rng, 20)
    rows += [(400, f"{sentence(rng, 12)} {item} {sentence(rng, 12)}"), (401, f"line one is long enough\nline two is long enough\n{item}"), (402, "line one is long enough\nline twо is long enough")]
    return rows, [(1, item), (2, "only three words"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with columns that clash with the operators' own, and the other tables."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows, items = rows_of()
    docs = spark.createDataFrame([(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("found", "_text", "key", "part", "head", "rest", "score", "size", "t_source", "hits"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(len(set(words(t))) > 10), 0) for i, t in rows if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/x", ""), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(k, [0.1 * k, 0.5]) for k in range(5)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def collected(spark, d, name):
    return {r[0]: r for r in QUERIES[name](spark, d).collect()}


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def buckets_of(text, bits):
    shift = 64 - bits
    h = [span(w.encode()) for w in words(text)]
    out = [((x * 3) & M) >> shift for x in h]
    out += [(0x5A5A5A5A5A5A5A5A if a == b else mix((a * 31 + b) & M)) >> shift for a, b in zip(h, h[1:])]
    return out + ngrams_of(text or "", (2, 3, 4), bits)


def ngrams_of(text, sizes, bits):
    out = []
    for n in sizes:
        for j in range(len(text) - n + 1):
            h = ord(text[j]) + (n << 40)
            for k in range(1, n):
                h = (h * 0x9E3779B97F4A7C15 + ord(text[j + k])) & M
            out.append(((h * 0xD6E8FEB86659FD93) & M) >> (64 - bits))
    return out


def test_op2_scores_by_hand(spark, tables):
    docs, marks = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = quality.fit(docs, marks)
    got = collected(spark, tables, "op2_quality")
    rows = dict(rows_of()[0])
    assert set(got) == set(rows)
    for i in [0, 1, 5, 40, 60, 70, 71, 72, 74, 76, 300, 301, 400]:
        b = buckets_of(rows[i], quality.BITS)
        z = (sum(float(model.table[x]) for x in b) / len(b) if b else 0) + model.bias
        want = 1 / (1 + math.exp(-z))
        assert (got[i]["held_out"], got[i]["predicted"]) == (is_held(i), int(got[i]["score"] >= 0.7)) and got[i]["score"] == pytest.approx(want, abs=1e-6)


def test_op2_trains_as_a_plain_loop_does():
    """The same steps one weight at a time: gradient of the softmax loss through the mean of the vectors."""
    rng, bits, dim, epochs, rate = random.Random(1), 5, 3, 2, 0.5
    docs = []
    for k in range(12):
        u = sorted(rng.sample(range(32), 6))
        docs.append((np.array(u, np.int32), np.array([rng.randint(1, 3) for _ in u], np.float32), k % 2))
    got = quality.train(docs, bits, dim, epochs, rate, seed=5)
    r = np.random.default_rng(5)
    v = r.uniform(-1 / dim, 1 / dim, (32, dim)).astype(np.float32).astype(float).tolist()
    out, bias, steps, k = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], epochs * len(docs), 0
    for _ in range(epochs):
        for d in r.permutation(len(docs)).tolist():
            u, c, label = docs[d]
            share, lr = [x / sum(c) for x in c], rate * (1 - k / steps)
            hidden = [sum(s * v[b][j] for s, b in zip(share, u)) for j in range(dim)]
            z = [sum(hidden[j] * out[j][y] for j in range(dim)) + bias[y] for y in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            g = [x / sum(e) - (y == label) for y, x in enumerate(e)]
            back = [sum(out[j][y] * g[y] for y in (0, 1)) for j in range(dim)]
            for y in (0, 1):
                bias[y] -= lr * g[y] * 0.1
                for j in range(dim):
                    out[j][y] -= lr * hidden[j] * g[y]
            for s, b in zip(share, u):
                for j in range(dim):
                    v[b][j] -= lr * math.sqrt(len(u)) * s * back[j]
            k += 1
    want = [sum(v[b][j] * (out[j][1] - out[j][0]) for j in range(dim)) for b in range(32)]
    assert got.table == pytest.approx(want, abs=1e-4) and got.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_op6_predicts_by_hand(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language.fit(docs)
    got = collected(spark, tables, "op6_language")
    rows = dict(rows_of()[0])
    seen = {i: t for i, t in rows.items() if not is_held(i) and i % 3 != 2 and t is not None}
    df = np.zeros(1 << language.BITS)
    lowered = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in t)
    for t in seen.values():
        df[sorted(set(ngrams_of(lowered(t), (1, 2, 3), language.BITS)))] += 1
    idf = np.log((1 + len(seen)) / (1 + df)) + 1
    assert model.idf == pytest.approx(idf, rel=1e-5)
    for i in [0, 1, 40, 60, 70, 71, 72, 74, 76, 300]:
        b = ngrams_of(lowered(rows[i] or ""), (1, 2, 3), language.BITS)
        x = np.zeros(1 << language.BITS)
        for k in b:
            x[k] += 1
        x = np.log1p(x) * idf
        z = (x / max(1e-9, np.sqrt((x * x).sum())) @ model.weights + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        has = any(c.isalpha() for c in rows[i] or "")
        assert got[i]["held_out"] == is_held(i) and got[i]["lang_pred"] == (model.languages[int(p.argmax())] if has else "und")
        assert got[i]["score"] == pytest.approx(p.max() if has else 0.0, abs=1e-4)


def test_op6_trains_as_a_plain_loop_does():
    """Follow the regularised leader one weight at a time, with both penalties."""
    rng, size, alpha, beta, l1, l2, epochs = random.Random(2), 16, 0.5, 1.0, 0.01, 0.001, 2
    rows, idf = [], np.linspace(1, 2, size)
    for k in range(20):
        u = sorted(rng.sample(range(size), 5))
        rows.append((np.array(u), np.array([rng.randint(1, 4) for _ in u], np.float32), "xyz"[k % 3]))
    got = language.train(rows, idf, alpha, beta, l1, l2, epochs, seed=3)
    x = []
    for u, c, v in rows:
        t = [math.log1p(a) * idf[b] for a, b in zip(c, u)]
        n = math.sqrt(sum(a * a for a in t))
        x.append((u.tolist(), [a / n for a in t], "xyz".index(v)))
    fit = [d for k, d in enumerate(x) if k % 5]
    z, n = [[0.0] * 3 for _ in range(size + 1)], [[0.0] * 3 for _ in range(size + 1)]  # the last row is the bias

    def w(b, y):
        penalty = l1 if b < size else 0.0
        a = z[b][y]
        return 0.0 if abs(a) <= penalty else -(a - math.copysign(penalty, a)) / ((beta + math.sqrt(n[b][y])) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for d in order.permutation(len(fit)).tolist():
            u, value, label = fit[d]
            u, value = [*u, size], [*value, 1.0]
            s = [sum(a * w(b, y) for a, b in zip(value, u)) for y in range(3)]
            e = [math.exp(a - max(s)) for a in s]
            for y in range(3):
                err = e[y] / sum(e) - (y == label)
                for a, b in zip(value, u):
                    g = a * err
                    sigma = (math.sqrt(n[b][y] + g * g) - math.sqrt(n[b][y])) / alpha
                    old = w(b, y)
                    z[b][y] += g - sigma * old
                    n[b][y] += g * g
    assert got.languages == ["x", "y", "z"]
    assert got.weights == pytest.approx(np.array([[w(b, y) for y in range(3)] for b in range(size)]), abs=1e-4)
    assert got.bias == pytest.approx([w(size, y) for y in range(3)], abs=1e-4)


def test_op4_and_op10_and_op7(spark, tables):
    rows, items = rows_of()
    got = collected(spark, tables, "op4_substring_dedup")
    for i, (n, gone, spans, kept) in brute_substrings(rows).items():
        assert tuple(got[i])[1:] == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    got = collected(spark, tables, "op10_near_dedup")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n, c, c == i) for i, (n, c) in brute_near(rows, 3, 85, 100).items()}
    got = collected(spark, tables, "op7_decontamination")
    for i, (n, hit, who, bad) in brute_hits(rows, [x for x in items if x[1]]).items():
        assert tuple(got[i])[1:] == (n, hit, len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bad)


def signature(t):
    h = [word(w.encode()) for w in words(low(t))]
    sets = [h[j : j + 5] for j in range(max(1, len(h) - 4))] if h else []
    out = [0xFFFFFFFF] * fingerprint.PERMUTATIONS
    for s in sets:
        x = len(s)
        for p in s:
            x = mix((x * 0xD6E8FEB86659FD93 + p) & M)
        out = [min(v, ((x * int(a) + int(b)) & M) >> 32) for v, a, b in zip(out, fingerprint._A, fingerprint._B)]
    return out


def test_op8_by_hand(spark, tables):
    got = collected(spark, tables, "op8_fingerprints")
    texts = sorted((i, t or "") for i, t in rows_of()[0])
    shingles = {i: {tuple(words(low(t))[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} if words(t) else set() for i, t in texts}
    for k, (i, t) in enumerate(texts):
        if len(t) > 2000:
            continue
        after = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, following = signature(t), signature(edited), signature(after[:3000]) if len(after) <= 3000 else None
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in changed)
        assert r["near_edited"] == pytest.approx(sum(a == b for a, b in zip(own, changed)) / 128)
        if following:
            assert r["near_next"] == pytest.approx(sum(a == b for a, b in zip(own, following)) / 128)
    alike = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    ids = [i for i, _ in texts if shingles[i]]
    cls = {i: min(j for j in ids if shingles[j] == shingles[i]) for i in ids}
    assert {i: r["class_id"] for i, r in got.items()} == {i: cls.get(i) for i, _ in texts}
    with_partner = {i for i in ids if any(cls[j] < cls[i] and alike(i, j) >= 0.8 for j in ids)}
    linked = {i for i in ids if got[i]["near_id"] is not None}
    assert all(alike(i, got[i]["near_id"]) == pytest.approx(got[i]["near_jaccard"]) and got[i]["near_jaccard"] >= 0.8 for i in linked)
    assert linked <= with_partner and len(linked) >= 0.9 * len(with_partner) and len(with_partner) > 5


def test_every_query_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == int(name == "op9_chat_formatting")


def test_a_sample_has_rows_of_any_length_and_every_label(spark):
    rows = [(i, "w " * (60_000 if i % 2 else 3), f"l{i % 300}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}

    def train(taken):
        return {"n": len(taken), "labels": len({v for _, _, v in taken}), "longest": max(float(c.sum()) for _, c, _ in taken)}

    got = features.learn(docs, None, "lang", language.tally, train, "n long, labels long, longest double", n=300)
    held = {v for i, _, v in rows if not is_held(i)}
    assert got["labels"] == got["n"] == len(held) > 200 and got["longest"] > 60_000 and seen == {}


def test_long_texts(spark):
    """A long line with a near copy, a long turn, long documents: in bounded work."""
    from casegraph.llm import chat, decontaminate, line_dedup, near_dedup

    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghij ") for _ in range(2_000_000))
    k = 1_234_567
    docs = spark.createDataFrame([(1, line), (2, line[:k] + "X" + line[k + 1 :]), (3, line[:k] + line[k + 1 :]), (4, line[: k - 9] + "XX" + line[k - 7 :])], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1}
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(9, line[k - 200 : k + 200])], "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in got.select("doc_id", "items").collect()} == {i: [9] for i in (1, 2, 3, 4)}
    model = quality.Model(np.ones(1 << quality.BITS), 0.0)
    assert [round(r["score"], 4) for r in quality.classify(docs.where("doc_id = 1"), model).collect()] == [0.7311]
    turn = ("plain text, no marks " * 500_000 + "a\\b </turn>: ### ") * 5  # 50 million characters
    made = chat.render_turn("assistant", turn)
    role, text, (a, b), end = chat.parse_turn(made)
    assert (role, text == turn, end) == ("assistant", True, len(made)) and chat.unescape(made[a:b]) == turn


def test_short_lines_are_judged_where_asked(spark):
    from casegraph.llm import line_dedup

    docs = spark.createDataFrame([(1, "abc\nx\nlonger line of text"), (2, "abd\nx\nab\nlonger line of texts\n\nabcde"), (3, "a" * 15), (4, "a" * 16), (5, "a" * 17)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, 1).collect()}
    assert got == {1: "abc\nx\nlonger line of text", 2: "\nabcde", 3: "a" * 15, 4: "", 5: ""}


def test_near_dedup_of_groups_apart_from_their_hub(spark, monkeypatch):
    """Families of copies that are linked among themselves but not with what they were all made from."""
    from casegraph.llm import near_dedup

    monkeypatch.setattr(near_dedup, "LONG", 6)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(160)]
    texts = [list(base)]
    for f in range(9):
        own = list(base)
        for j in rng.sample(range(160), 12):
            own[j] = f"f{f}x{j}"
        for c in range(7):
            w = list(own)
            w[rng.randrange(160)] = f"f{f}c{c}"
            texts.append(w if c % 3 else w[: -rng.randrange(1, 6)])
    texts += [base[: 160 - 5 * k] for k in range(1, 16)]  # cuts, each like the next
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    for width, num, den in ((3, 85, 100), (5, 80, 100)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, (num, den)).collect()}
        assert got == brute_near(rows, width, num, den)


def test_rows_that_share_a_doc_id_and_differ(spark):
    from casegraph.llm import near_dedup

    docs = spark.createDataFrame([(1, "b c d e f g"), (1, "a c d e f g"), (2, "a c d e f g"), (3, "b c d e f g")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_frequent_anchors_give_windows(spark, monkeypatch):
    from casegraph.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 3000)
    rng = random.Random(6)
    mark = "a common phrase of many words that stands everywhere in this"
    rows = [(k, f"{sentence(rng, 8)} {mark}{' ' if k % 3 else ''}{sentence(rng, 8)}") for k in range(60)] + [(70, None), (71, ""), (72, mark)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_substrings(rows)
    for hot in (0, 5, 10**6):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(df).collect()} == want
