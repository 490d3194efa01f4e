import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import leakage, words

WORD = re.compile(rb"[A-Za-z0-9]+")


def test_words_are_those_of_a_plain_scan():
    rng = random.Random(8)
    alphabet = ["a", "Z", "9", " ", "\n", "é", "K", "-", "_", " ", "word", "0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"", b"abc", b"abc", b"ABC def"]
    old = words._BLOCK
    try:
        for block in (old, 16):
            words._BLOCK = block
            got = words.words_of(pa.array(texts, pa.binary()).slice(3))
            want = [(i, w.lower()) for i, t in enumerate(texts[3:]) for w in WORD.findall(t)]
            assert got.text.tolist() == [i for i, _ in want] and got.counts.sum() == len(want)
            seen = {}
            for h, (_, w) in zip(got.hashes.tolist(), want, strict=True):
                assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)
    finally:
        words._BLOCK = old


def _texts(rng, n, size, vocabulary=400):
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(size)) for _ in range(n)]


def _brute(docs, items, window=20):
    grams = lambda t: {tuple(w[i : i + window]) for w in [[x.lower() for x in WORD.findall(t.encode())]] for i in range(len(w) - window + 1)}
    held = {i: grams(t) for i, t in items if i is not None and t is not None}
    return {(d, i) for d, t in docs if d is not None and t is not None for g in [grams(t)] for i, h in held.items() if g & h}


def _case():
    rng = random.Random(6)
    items = list(enumerate(_texts(rng, 30, 60))) + [(30, None), (None, "x"), (31, ""), (32, "too short")]
    docs = []
    for d in range(150):
        text = _texts(rng, 1, rng.randrange(10, 80))[0].split()
        for item in rng.sample(range(30), rng.randrange(3)):
            own, n, at = items[item][1].split(), rng.choice([19, 20, 21, 40]), rng.randrange(20)
            text[len(text) // 2 : len(text) // 2] = own[at : at + n]
        docs.append((d, rng.choice([", ", "\n# ", " "]).join(text).upper() if d % 2 else "; ".join(text)))
    docs += [(900, None), (None, "x"), (901, ""), (902, "a b"), (903, "é " * 50), docs[3], (904, " ".join([items[5][1]] * 3 + ["pad"] * 300_000))]
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = _case()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = _brute(docs, items)
    for size in (16_000_000, 500):
        got = [tuple(r) for r in leakage.leaks(d, i, index_bytes=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 80


def test_leaks_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "a " * 30)], "item_id bigint, text string")
    assert leakage.leaks(d, i).count() == 0
    assert leakage.leaks(spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string"), i.limit(0)).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y or x < 0))
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(-1, 6, (400, 12))
    b = a.copy()
    for r in b:
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, 12)
            if rng.random() < 0.5:
                r[at] = rng.integers(0, 6)
            else:
                r[at:-1] = r[at + 1 :]
    for most in (1, 2, 3):
        assert leakage.within_edits(a, b, most).tolist() == [_distance(x, y) <= most for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_recall_of_edited_passages():
    rng = random.Random(12)
    for edits in (1, 2):
        items = [(i, t.encode()) for i, t in enumerate(_texts(rng, 200, 20, 5000))]
        docs = []
        for _, text in items:
            w = text.decode().split()
            for _ in range(edits):
                at = rng.randrange(1, 19)
                w[at] = f"w{rng.randrange(5000)}"
            docs.append(" ".join(w).encode())
        index = leakage.Index(items, leakage.Settings(edits=edits))
        place, item = index.search(pa.array(docs, pa.binary()))
        found = {(p, i) for p, i in zip(place.tolist(), item.tolist(), strict=True)}
        recall = sum((i, i) in found for i in range(200)) / 200
        assert recall >= 0.95, (edits, recall)


def test_dropped_and_inserted_words_cost_one_edit():
    rng = random.Random(13)
    for edits in (1, 2):
        items = [(i, t.encode()) for i, t in enumerate(_texts(rng, 200, 20, 5000))]
        for kind in ("drop", "insert"):
            for tail in ("", " x1 x2 x3"):  # the passage may end its text
                docs = []
                for _, text in items:
                    w = text.decode().split()
                    for _ in range(edits):
                        at = rng.randrange(1, len(w) - 1)
                        w[at : at + (kind == "drop")] = [] if kind == "drop" else ["y0"]
                    docs.append((" ".join(w) + tail).encode())
                place, item = leakage.Index(items, leakage.Settings(edits=edits)).search(pa.array(docs, pa.binary()))
                found = set(zip(place.tolist(), item.tolist(), strict=True))
                assert sum((i, i) in found for i in range(200)) >= 190, (edits, kind, tail)


def test_a_word_put_in_after_every_twelfth(spark):
    w = _texts(random.Random(14), 1, 60, 5000)[0].split()
    doc = " ".join(x + " y0" * (i % 12 == 0) for i, x in enumerate(w, 1))
    d, i = spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(2, " ".join(w))], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.leaks(d, i, leakage.Settings(edits=1)).collect()] == [(1, 2)]


def test_free_end_of_the_banded_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, (400, 12))
    for most in (1, 2):
        b = np.concatenate([a, rng.integers(-1, 6, (400, most))], axis=1)
        for r in b:
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, 12)
                if rng.random() < 0.5:
                    r[at:-1] = r[at + 1 :]
                else:
                    r[at + 1 :] = r[at:-1].copy()
                    r[at] = -1
        want = [min(_distance(x, y[:j]) for j in range(12 - most, 12 + most + 1)) <= most for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert leakage.within_edits(a, b, most, free_end=True).tolist() == want and 0 < sum(want) < 400


def test_near_leaks_of_many_items_are_those_of_few(spark):
    rng = random.Random(21)
    docs, items = _case()
    for k, (item, text) in enumerate(items[:30]):
        w = text.split()[rng.randrange(20) :][:20]
        w[3:4] = [] if k % 3 == 0 else ["y0"] if k % 3 == 1 else [w[3], "y1"]
        docs.append((2000 + item, " ".join(w)))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    settings = leakage.Settings(edits=1)
    one, two = ({tuple(r) for r in leakage.leaks(d, i, settings, index_bytes=size).collect()} for size in (16_000_000, 10))
    assert one == two and len([x for x in one if x == (x[1] + 2000, x[1])]) >= 29


def test_equal_windows_are_held_against_each_other_once():
    zeros = lambda n: ("0, " * n).encode()
    began = time.perf_counter()
    for edits in (0, 1):
        index = leakage.Index([(7, zeros(2000)), (8, b"one " * 40), (9, zeros(30))], leakage.Settings(edits=edits))
        place, item = index.search(pa.array([zeros(8000), b"one"], pa.binary()))
        assert sorted(zip(place.tolist(), item.tolist(), strict=True)) == [(0, 7), (0, 9)]
    assert time.perf_counter() - began < 5


def test_a_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError, match="repetitions"):
        leakage.repetitions_for(leakage.Settings(edits=5, samples=40))
