"""Tensored MinHash against brute force, and the statistics it relies on."""

import random

import numpy as np
import pytest
from test_dedup_and_joins import brute_components, documents, odd_rows, shingles

from corpusradar.llm import minhash_tensor
from corpusradar.llm.minhash_tensor import Bands
from corpusradar.llm.ngram_join import Alike


def answer(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def edited_copies(seed, n):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(draw.randrange(0, 14)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    return rows + [(1000 + i, " ".join(f"x{draw.randrange(300)}" for _ in range(draw.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("block", [8, 2048])
def test_near_copies_of_odd_rows_and_a_large_group_of_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_tensor, "LIST_NODES", block)
    monkeypatch.setattr(minhash_tensor, "WORTH", 1 if block == 8 else 10)  # one round of centres, then pair by pair
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(i + 100, t) for i, t in edited_copies(4, 120)]
    df = documents(spark, [(i, t, None, None, "clash", "clash") for i, t in rows]).repartition(5)
    assert answer(minhash_tensor.near_duplicates(df, rule=Alike(2, 80, 100))) == brute_components(rows, 2, 80, 100)


def test_near_copies_of_nothing_null_ids_and_string_ids(spark):
    assert minhash_tensor.near_duplicates(documents(spark, [])).count() == 0
    only = minhash_tensor.near_duplicates(documents(spark, [(1, None, None, None, None, None)])).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(None, text), (5, text + " b"), (None, "quite another text"), (None, "")]
    got = {tuple(r) for r in minhash_tensor.near_duplicates(documents(spark, [(i, t, None, None, None, None) for i, t in rows])).collect()}
    assert got == {(None, 56, 5, False), (5, 57, 5, True), (None, 1, None, True), (None, 0, None, True)}
    df = spark.createDataFrame([("b", text), ("a", text + " c"), ("c", "z")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash_tensor.near_duplicates(df).collect()} == {
        ("a", "a", True), ("b", "a", False), ("c", "c", True)}


def test_near_copies_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    sets = {}
    for i, (_, text) in enumerate(rows):
        sets.setdefault(shingles(text, 2), []).append(i)
    # brute force over distinct sets whose sizes can link
    keys = sorted((s for s in sets if s), key=len)
    top = list(range(len(keys)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for b, y in enumerate(keys):
        for a in range(b - 1, -1, -1):
            if 100 * len(keys[a]) < 80 * len(y):
                break
            both = len(keys[a] & y)
            if 100 * both >= 80 * (len(keys[a]) + len(y) - both):
                top[find(a)] = find(b)
    least = {}
    for k, s in enumerate(keys):
        least[find(k)] = min([least.get(find(k), 1 << 60), *[rows[i][0] for i in sets[s]]])
    want = [(rows[i][0], len(s), least[find(k)]) for k, s in enumerate(keys) for i in sets[s]]
    want += [(rows[i][0], 0, rows[i][0]) for i in sets.get(frozenset(), [])]
    assert answer(minhash_tensor.query(spark, folder)) == sorted(want)


def test_minhashes_agree_as_often_as_sets_are_alike():
    draw, bands = np.random.default_rng(1), Bands()
    agree, keys = [], 0
    for _ in range(200):
        pool = draw.integers(0, 1 << 64, 120, np.uint64, endpoint=False)
        a, b = np.sort(pool[:108]), np.sort(pool[12:])  # 96 of 120 shared: 0.8
        least = minhash_tensor.minhashes(np.concatenate([a, b]), np.array([0, len(a)]), bands)
        agree.append((least[0] == least[1]).sum())
        x, y = minhash_tensor.band_hashes(least, bands).reshape(2, 2, bands.m)
        keys += (x[0] == y[0]).any() and (x[1] == y[1]).any()
    mean, sd = np.mean(agree) / bands.hashes, np.std(agree)
    assert abs(mean - 0.8) < 0.01 and 2.9 < sd < 5 and keys == 200  # binomial: sd 3.9
    assert bands.missed(0.8) < 2.2e-5 and bands.missed(0.9) < 1e-8 and 45 < bands.least_agreement(0.8) < 60


def test_a_key_is_made_of_a_band_of_each_collection(spark):
    bands = Bands(h=2, m=3)
    least = minhash_tensor.minhashes(np.arange(1, 9, dtype=np.uint64), np.array([0]), bands)
    one = minhash_tensor.band_hashes(least, bands).astype("<u8").tobytes()
    nodes = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(one))], "node long, bands binary")
    keys = minhash_tensor.table_keys(nodes, bands).collect()
    assert len(keys) == 18 and len({r.key for r in keys}) == 9
