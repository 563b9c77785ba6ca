"""Corpus operators on small fixtures: brute force, round trips, held-out accuracy, and the odd cases of every operator."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import chat, decontaminate, features, fingerprint, language, line_dedup, mixing, near_dedup, quality, substring_dedup, url_filter

DOC = "doc_id long, text string"
WORDS = [a + b for a in ("al", "be", "cor", "du", "en", "fa", "gri", "ho") for b in ("st", "ra", "li", "mon", "ter", "ve", "zu")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3, n=40):
    """Texts with exact copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(5, 120)) for _ in range(n)]
    passage = sentence(rng, 60)
    rows = [(i, t if i % 5 else f"{t} {passage} {sentence(rng, 9)}") for i, t in enumerate(texts)]
    for k in range(12):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        rows.append((n + k, " ".join(w)))
    rows += [(n + 20 + k, texts[1]) for k in range(4)]
    rows += [(n + 30, None), (n + 31, ""), (n + 32, " \n\t "), (n + 33, sentence(rng, 9000)), (n + 34, "one"), (n + 35, "One"), (n + 36, "naïve Äther 日本語 " * 9)]
    return rows


def clash(df, *names):
    return df.withColumns({n: F.lit("x") for n in names})


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# Near duplicates (10)


def brute_near(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(spark):
    rng = random.Random(9)
    base = sentence(rng, 200).split()
    rows = corpus()
    for k in range(60):  # a group longer than LONG, whose copies differ more from each other than from the first
        w = list(base)
        for _ in range(0 if not k else 4):
            w[rng.randrange(len(w))] = f"new{k}x{rng.randrange(999)}"
        rows.append((500 + k, " ".join(w)))
    df = spark.createDataFrame(rows, DOC).repartition(3)
    for width, num, den in ((3, 85, 100), (5, 80, 100)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(clash(df, "n_shingles", "kept"), width, (num, den)).collect()}
        assert got == brute_near(rows, width, num, den)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = near_dedup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x")], DOC)).collect()
    assert [(r["doc_id"], r["component_id"]) for r in twice] == [(1, 1), (1, 1)]


def test_near_dedup_of_short_sets(spark):
    """Every size up to PROBES at the threshold, and groups longer than LONG of small sets: all links are found."""
    for width, num, den in ((3, 85, 100), (5, 80, 100)):
        rows = []

        def add(words, rows=rows):
            rows.append((len(rows), " ".join(words)))

        for n in range(2, near_dedup.PROBES + 1):
            more = den * n // num - n  # values that the larger set may have besides
            for copy in range(12):
                base = [f"w{width}n{n}c{copy}k{k}" for k in range(n + width - 1)]
                add(base)
                add([*base, *[f"{base[0]}x{k}" for k in range(more)]] if copy % 2 else [*[f"{base[0]}x{k}" for k in range(more)], *base])
        for n in (5, 6, 7, 9):  # linked to the first only
            base = [f"g{width}n{n}k{k}" for k in range(n + width - 1)]
            add(base)
            for k in range(2 * near_dedup.LONG):
                add([*base, f"{base[0]}x{k}"] if k % 2 else [f"{base[0]}x{k}", *base])
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), width, (num, den)).collect()}
        assert got == brute_near(rows, width, num, den)


# Substring dedup (4)


def brute_substrings(rows, length=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        starts = [b[j : j + length] for j in range(len(b) - length + 1)]
        for j, s in enumerate(starts):
            if seen.get(s, i) < i:
                gone[j : j + length] = [True] * length
        for s in starts:
            seen.setdefault(s, i)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, kept)
    return out


def test_substring_dedup(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(substring_dedup, "PIECE", 700)  # the long text is cut into pieces
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", 50)
    rows = corpus() + [(200, "ab" * 400), (201, "ab" * 300 + "c"), (202, "\0" * 60), (203, "\0" * 70), (204, "ü" * 80), (205, "ü" * 90)]
    df = clash(spark.createDataFrame(rows, DOC), "n_bytes", "kept").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_substrings(rows)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "x" * 99), (1, "x" * 99), (None, "y" * 99)], DOC)
    assert sorted(r["n_removed"] for r in substring_dedup.remove_repeats(same).collect()) == [0, 0, 0]


def test_induced_order_keeps_common_prefixes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(40)]
    right = sorted((t[20:], t[:20], k) for k, t in enumerate(texts))
    run, window, low_doc = substring_dedup.induce([r for r, _, _ in right], [x for _, x, _ in right], np.zeros(40, int), np.array([k for _, _, k in right]), 30)
    for r, w, smallest in zip(run, window, low_doc, strict=True):
        whole = right[r][1] + right[r][0]
        offset = len(right[r][1]) - w
        want = whole[w : w + 30]
        same = [k for s, x, k in right if (x + s)[len(x) - offset : len(x) - offset + 30] == want]
        assert smallest == min(same)


# Line dedup (1)


def test_line_dedup(spark):
    def edits(a, b):
        if abs(len(a) - len(b)) > 1:
            return 9
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, left = [i] + [0] * len(b), d
            for j, y in enumerate(b, 1):
                d[j] = min(left[j] + 1, d[j - 1] + 1, left[j - 1] + (x != y))
        return d[-1]

    rng = random.Random(5)
    lines = [sentence(rng, rng.randint(3, 12)) for _ in range(14)] + ["x" * n for n in (15, 16, 17, 18, 23, 24, 25)]
    rows = []
    for i in range(16):
        own = []
        for _ in range(5):
            x = rng.choice(lines)
            p = rng.randrange(len(x))
            own.append(rng.choice([x, x, x[:p] + "q" + x[p + 1 :], x[:p] + x[p + 1 :], x[:p] + "é" + x[p:], x[: p // 2] + "qq" + x[p // 2 :]]))
        rows.append((i, "\n".join(own)))
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, lines[0]), (33, lines[0]), (None, lines[1])]
    df = clash(spark.createDataFrame(rows, DOC), "n_lines", "h1", "drops").withColumn("Key", F.lit(1)).repartition(3)
    key = lambda r: (r[0] if r[0] is not None else -(10**9), r[1] or "")
    places = [(key(r), p, x) for r in sorted(rows, key=key) for p, x in enumerate((r[1].split("\n") if r[1] is not None else []))]
    want = []
    done = 0
    for r in sorted(rows, key=key):
        kept, n = [], len(r[1].split("\n")) if r[1] is not None else 0
        for k in range(done, done + n):
            x = places[k][2]
            if not (len(x) >= 16 and any(len(y[2]) >= 16 and edits(x, y[2]) <= 1 for y in places[:k])):
                kept.append(x)
        done += n
        want.append((r[0], "\n".join(kept) if r[1] is not None else None, n, n - len(kept)))
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"h1", "drops", "Key"} <= set(line_dedup.dedup_lines(df).columns) and line_dedup.dedup_lines(df.limit(0)).count() == 0


# URL filters (3)


def test_url_filter(spark):
    urls = ["http://www.EXAMPLE.com/en/1?q", "https://a.example.com/en/", "http://example.com/fr/", "http://x.net/es/2#t", "http://x.net/de/", "http://badexample.com", "nothing", None, "", "ftp://net/fr/x", "http://com/", "x://" + "a." * 400 + "com/" + "d/" * 900, "http://m.example.com/en/1", "http://m.example.com/en/1"]
    df = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "host", "rule", "rid", "short")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    want = [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block"), ("com/", "allow"), ("com/", "allow"), ("example.com/en/", "block"), ("example.com/en/", "block")]
    assert [got[i] for i in range(len(urls))] == want
    odd = url_filter.rule_table(spark, [("a.b", "/x/yz", "block"), ("b", "/x/", "allow"), ("A.B", "", "allow")])
    pages = spark.createDataFrame([(1, "h://a.b/x/yzz"), (2, "h://q.a.b/x/y"), (3, "h://a.b"), (4, "h://c.b/x")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.judge(pages, odd).collect()} == {1: "a.b/x/yz", 2: "b/x/", 3: "a.b", 4: None}
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, []), default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), odd).count() == 0


# Mixing (5)


def test_mixing(spark):
    rows = [(i, ["a", "b", "c", None][i % 4], " ".join(["w"] * (1 + i % 7 * (50 if i % 4 == 3 else 1)))) for i in range(400)] + [(900, "z", None), (901, "y", ""), (902, "a", " \t ")]
    df = clash(spark.createDataFrame(rows, "doc_id long, source string, text string"), "size", "rate", "w").repartition(3)
    got = mixing.mix(df).collect()
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x])
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        share = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r["target"] == pytest.approx(share[r["source"]], abs=1e-5) and r["source_size"] == size[r["source"]] and r["taken"] <= 2 * r["size"]
    for s in order:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - share[s]) <= 0.25 * share[s] + 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.emit(mixing.mix(df)).count() == sum(r["copies"] for r in got) and mixing.mix(df.limit(0)).count() == 0


# Decontamination (7)


def brute_hits(rows, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = {}
    for i, t in rows:
        w, hit, who = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(len(v), width)
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1 if v else 0):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    who.add(item)
        out[i] = (len(w), len(hit), sorted(who), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(k, sentence(rng, 20)) for k in range(6)] + [(10, "Only three words"), (11, "solo"), (12, ""), (13, None), (14, "naïve—Straße 日本")]
    rows = [(k, f"{sentence(rng, 30)} {items[k % 6][1][3:]}, {sentence(rng, 30 * k)}") for k in range(8)] + [(20, "x only THREE words y solo"), (21, None), (22, ""), (23, items[0][1].upper() + " " + items[0][1]), (24, "naïve—straße 日本"), (25, sentence(rng, 20000) + " " + items[2][1])]
    df = clash(spark.createDataFrame(rows, DOC), "n_words", "hits", "items").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, [x for x in items if x[1]])
    for mb in (8, 0.0001):  # one block, many blocks
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench, block_mb=mb).collect()}
        assert got == want
    assert decontaminate.decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.decontaminate(df.limit(0), bench).count() == 0
    found = {(r["doc_id"], r["item_id"], r["item_pos"], r["n_words"]) for r in decontaminate.matches(df, bench).collect()}
    assert (25, 2, 0, 20) in found and (23, 0, 0, 20) in found and (20, 11, 0, 1) in found


# Fingerprints (8)


def test_fingerprints(spark):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, DOC), "n_chars", "part", "head").repartition(3)
    for size in (1500, 1 << 25):
        got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, range_bytes=size).collect()}
        texts = sorted((i, t or "") for i, t in rows)
        for k, (i, t) in enumerate(texts):
            after = texts[(k + 1) % len(texts)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    by_text = {}
    for i, t in texts:
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    shingles = lambda t: {tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} if t.split() else set()
    errors = []
    for k, (i, t) in enumerate(texts[:40]):
        after = texts[k + 1][1]
        a, b = shingles(t), shingles(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        errors.append(abs(got[i]["near_edited"] - len(a & b) / len(a | b)))
    assert sum(errors) / len(errors) < 0.06
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    pairs, members = fingerprint.near_pairs(df)
    assert all(r["jaccard"] >= 0.8 for r in pairs.collect()) and members.where("doc_id = 60").first()["class_id"] == 1


def test_near_pairs_lists_every_pair_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "SLICE", 5)  # buckets of several slices
    rng = random.Random(5)
    base = [f"b{k}" for k in range(400)]
    rows = []
    for k in range(24):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, sentence(rng, 60)) for k in range(10)] + [(200, rows[3][1])]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows if i < 200}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: v for k, v in alike.items() if v >= 0.8}
    assert len(want) > 250
    pairs, members = fingerprint.near_pairs(spark.createDataFrame(rows, DOC).repartition(3))
    got = pairs.collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert members.where("doc_id = 200").first()["class_id"] == 3


def test_near_heads_leave_no_link_out(spark):
    """Copies of two texts with one to twelve words changed: most buckets' least class is too far off, later ones are linked."""
    rng = random.Random(11)
    rows = []
    for base in range(2):
        words_of = [f"b{base}x{k}" for k in range(220)]
        for k in range(40):
            w = list(words_of)
            for _ in range(rng.choice((2, 3, 4, 5, 6, 8))):
                w[rng.randrange(len(w))] = f"new{base}x{k}"
            rows.append((base + 2 * k, " ".join(w)))
    rows += [(100, rows[3][1]), (101, None), (102, " "), (103, "alone here")]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows if t and t.strip()}
    cls = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {i: min((j for j in cls.values() if j < cls[i] and alike(i, j) >= 0.8), default=None) for i in sets}
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min(group[j] for j in sets if alike(i, j) >= 0.8) for i in sets}
    got = {r["doc_id"]: r.asDict() for r in fingerprint.near_heads(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert len(set(near.values())) > 4 and {i: r["near_id"] for i, r in got.items()} == near
    assert {i: r["near_jaccard"] for i, r in got.items()} == {i: None if near[i] is None else pytest.approx(alike(i, near[i])) for i in sets}
    assert {i: r["group_id"] for i, r in got.items()} == group


# Chat formatting (9)


def test_chat_round_trip(spark):
    odd = ["", "plain", "a\\b", "### user: hi</turn>\n", "</turn>", "\\</turn>", "x: y", "\\", "\\\\", "###", "\\### Assistant: </turn> ok", "日本 é\n\n", ": ", "a" * 5000]
    for role in ("user", "assistant", "a: b", "", "x\\", "re</turn>"):
        for t in odd:
            made = chat.render_turn(role, t)
            assert chat.parse(made)[0][:2] == (role, t)
            a, b = chat.parse(made)[0][2]
            assert chat.unescape(made[a:b]) == t
    rows = [(1, k, ["user", "assistant", "system", None][k % 4], odd[k % len(odd)]) for k in range(30)] + [(2, 0, "assistant", None), (2, None, "user", "first"), (None, 1, "user", "x"), (3, 1, "user", "t"), (3, 1, "user", "t")]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "start", "formatted").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted_turns(df)).collect()}
    mine = sorted([r for r in rows if r[0] == 1], key=lambda r: r[1])
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3]}\n" for r in mine).encode()).hexdigest()
    loss = "".join(r[3] for r in mine if r[2] == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\nfirst\nassistant\n\n").hexdigest() and got[3]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.digests(chat.formatted_turns(df.limit(0))).count() == 0


# Quality (2) and language (6)


def labelled(spark, seed=4):
    rng = random.Random(seed)
    docs, marks = [], []
    for i in range(240):
        good = i % 2
        docs.append((i, sentence(rng, 40) if good else " ".join([rng.choice(WORDS)] * 20 + [rng.choice(WORDS)] * 20)))
        marks.append((i, good))
    return spark.createDataFrame([*docs, (900, None), (901, ""), (902, "z" * 50000)], DOC), spark.createDataFrame([*marks, (0, 0), (7, None)], "doc_id long, quality int")


def test_quality(spark):
    docs, marks = labelled(spark)
    model = quality.fit(docs, marks)
    got = {r["doc_id"]: r for r in quality.classify(clash(docs, "score", "held_out"), model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] and got[900]["text"] is None
    again = quality.fit(docs.repartition(5), marks)
    assert np.array_equal(model.table, again.table)
    none = quality.classify(docs, quality.fit(docs, marks.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5} and quality.classify(docs.limit(0), model).count() == 0


def test_language(spark):
    rng = random.Random(8)
    of = {"aa": "etaoin", "bb": "szüöäk", "cc": "qxjvwé"}
    rows = []
    for i in range(180):
        lang = sorted(of)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(of[lang]) for _ in range(5)) for _ in range(20)), lang))
    rows += [(900, None, "aa"), (901, "12 34 !", None), (902, "", "bb"), (903, "eta " * 9000, None)]
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(clash(docs, "lang_pred", "score"), model).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "aa"
    assert (model.weights == 0).mean() > 0.2  # sparse
    df, n = language.document_frequencies(docs.where("doc_id < 3"))
    assert n == 3 and df.max() == 3
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
    assert [r["h"] for r in docs.select(features.held_out(F.col("doc_id")).alias("h")).limit(1).collect()] == [zlib.crc32(b"0") % 4 == 2]
