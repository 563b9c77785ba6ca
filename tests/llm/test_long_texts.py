"""Words that polynomial hashes confuse, passages repeated without end, and texts over the size of a part."""

from __future__ import annotations

import numpy as np
import pytest

from casegraph.llm import decontaminate, fingerprint, language, near_dedup, quality
from casegraph.llm import features as ft
from casegraph.llm import text as tx

DOC = "doc_id long, text string"


def thue_morse(n):
    """The word of n letters and its complement: equal under every polynomial modulo 2**64 with an odd base, from 1024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words_are_apart(spark, n):
    one, other = thue_morse(n)
    docs = spark.createDataFrame([(1, one), (2, other)], DOC)
    assert sorted((r["doc_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()) == [(1, True), (2, True)]
    bench = spark.createDataFrame([(9, one)], "item_id long, text string")
    assert sorted((r["doc_id"], r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()) == [(1, [9]), (2, [])]
    prints = {r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert len(prints) == 2


def test_word_hashes_tell_words_apart():
    words = [w.encode() for k in range(1, 70) for w in ("a" * k, "a" * (k - 1) + "b", "b" + "a" * (k - 1), thue_morse(k)[0], thue_morse(k)[1])]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    h = tx.word_hashes(data, end - np.array([len(w) for w in words]), end)
    assert len(set(h.tolist())) == len(set(words))
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip(words, h.tolist()))


def test_repeats_are_not_multiplied():
    """1000 equal words in an item against 400,000 in a text: hits, not hits times places."""
    import tracemalloc

    block = decontaminate.TestBlock([(7, " ".join(["na"] * 1000)), (8, " ".join(["na"] * 13)), (9, "batman")], 13)
    text = np.frombuffer((" ".join(["na"] * 400_000) + " batman").encode(), np.uint8)
    tracemalloc.start()
    counts, pos, window = block.search(text, np.array([0, len(text)]))
    runs, items = block.cover(counts, pos, window)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 500e6
    assert counts.tolist() == [400_001] and runs.tolist() == [[0, 0, 400_001]] and items.tolist() == [[0, 7], [0, 8], [0, 9]]
    found = block.matches(counts, pos, window)
    assert (found[:, 1] == 7).sum() < 500 and (found[found[:, 1] == 7][:-1, 4] == 1000).all()


def test_und_has_no_letter(spark):
    texts = ["½ ² Ⅷ 12", "٣٤ 四", "_ -", "é", "1a"]
    assert [language.has_letter(t) for t in texts] == [False, True, False, True, True]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["hello there", "good morning", *texts])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()}
    assert got[2] == got[4] == "und" and got[5] != "und"


def test_long_texts_count_as_if_uncut(monkeypatch):
    """Nine megabytes in parts, with words and characters across every cut: the same counts as in one piece."""
    rng = np.random.default_rng(3)
    words = ["größer", "日本語", "a", "of", "x" * 300, "\n", "naïve"] + [f"w{k}" for k in range(50)]
    text = " ".join(words[k] for k in rng.integers(0, len(words), 1_000_000)).encode()
    data = np.frombuffer(text, np.uint8)
    assert len(data) > 9e6
    at = np.array([0, len(data)])
    got = quality.tally(data), language.tally(data)
    monkeypatch.setattr(tx, "PIECE_BYTES", 1 << 40)
    for (u, c), (v, d) in zip(got, (quality.tally(data), language.tally(data))):
        assert np.array_equal(u, v) and np.array_equal(c, d)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.1)
    whole = model.score(data, at)
    monkeypatch.setattr(tx, "PIECE_BYTES", 1 << 16)
    assert np.allclose(model.score(data, at), whole, rtol=1e-9)


def test_small_parts_lose_nothing(monkeypatch):
    text = "ab  çd日 e\tfgh ijklmnop q" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(data)])
    want = [quality.tally(data), language.tally(data)]
    for limit in (1, 2, 3, 5, 8):
        monkeypatch.setattr(tx, "PIECE_BYTES", limit)
        for (u, c), (v, d) in zip([quality.tally(data), language.tally(data)], want):
            assert np.array_equal(u, v) and np.array_equal(c, d), limit
    assert ft.char_ngrams(np.arange(5, dtype=np.uint32), np.array([0, 5]), 3, 8, 4)[0].tolist() == [0]
