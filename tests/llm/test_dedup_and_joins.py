"""Exact copies, near copies and components against brute force; packing against a plain search."""

import hashlib
import random
import re

import pytest

from corpusradar.llm import exact_dedup, ngram_join, packing
from corpusradar.llm.components import components

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, node string")


def odd_rows():
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = ["Same TEXT here now ok", "same text here now ok", "", None, "É é", "é é", long_text, long_text + " end", "one two", "one two", "A\tb\n c d e",
             "a b c d e"]
    return [(i, t, None, "s", "clash", "clash") for i, t in enumerate(texts)] + [(0, "Same TEXT here now ok", None, None, None, None),
                                                                               (3, "another text of the same id", "en", "s", "x", "y")]


def shingles(text, size):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute_components(rows, size, num, den):
    sets = [shingles(text, size) for _, text in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_copies(spark, keep):
    rows = odd_rows()
    got = exact_dedup.exact_duplicates(documents(spark, rows).repartition(5), keep=keep, runs=8, fan_in=2).collect()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(doc_id)
    pick = max if keep == "largest" else min
    want = sorted((i, pick(ids), len(ids), i == pick(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(map(tuple, got)) == want


def test_exact_copies_of_nothing_and_null_ids(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    rows = [(None, "a", None, None, None, None), (4, "A", None, None, None, None), (None, "b", None, None, None, None)]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(documents(spark, rows)).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}


def test_a_hot_text_stays_small_in_every_round(spark):
    rows = [(i, "hot" if i % 3 else f"cold {i}", None, None, None, None) for i in range(3000)]
    prints = exact_dedup.fingerprints(documents(spark, rows).repartition(16))
    merged = exact_dedup.merge_runs(prints, runs=16, fan_in=2).collect()
    assert len(merged) == 1001 and max(r.group_size for r in merged) == 2000


def test_dropping_exact_copies_keeps_columns(spark):
    df = documents(spark, odd_rows())
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4, 5, 6, 7, 9, 10, 11]


def edited(words, draw, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"n{draw.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_near_copies(spark, size, num):
    draw = random.Random(size)
    rows = []
    for group in range(6):
        base = [f"g{group}w{draw.randrange(400)}" for _ in range(draw.randrange(20, 120))]
        rows += [(len(rows) + i, edited(base, draw, draw.randrange(4))) for i in range(25)]
    line = "this very common line is found in a great many of the documents here"
    rows += [(len(rows) + i, line + " " + " ".join(f"u{i}x{j}" for j in range(draw.randrange(6)))) for i in range(30)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "one", "ONE", "one two", " \t\n", "one two"])]
    rows += [rows[0], (rows[0][0], "the same id with a text of its own and more"), (rows[3][0], rows[8][1])]
    df = documents(spark, [(i, t, None, None, "c", "c") for i, t in rows])
    got = ngram_join.near_duplicates(df, rule=ngram_join.Alike(size, num, 100, bucket_bits=10)).collect()
    want = {}
    for doc_id, n, least in brute_components(rows, size, num, 100):
        want.setdefault((doc_id, n), set()).add(least)
    assert len(got) == len(rows) and all(r.component_id in want[r.doc_id, r.n_shingles] for r in got)
    merged = brute_components(rows, size, num, 100)
    assert sorted(map(tuple, got)) == merged


@pytest.mark.parametrize("block", [5, 128])
def test_every_link_of_a_near_copy_group(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    monkeypatch.setattr(ngram_join, "LIST_PART", block)
    draw = random.Random(9)
    base = [f"w{draw.randrange(900)}" for _ in range(120)]
    rows = [(i, edited(base, draw, draw.randrange(3))) for i in range(60)]
    rows += [(100 + i, " ".join(base[:len(base) - 4 * i])) for i in range(20)]  # a chain over several size bands
    rows += [(200 + i, t) for i, t in enumerate(["", None, "one two", "ONE two", "one", "lone words of no other text"])] + [(3, rows[8][1]), (None, rows[9][1])]
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t, 4), []).append(i)
    sets.pop(frozenset())
    distinct = [(min(i for i in ids if i is not None), s) for s, ids in sets.items()]
    want = sorted((*sorted([(a, len(x)), (b, len(y))]), len(x & y)) for k, (a, x) in enumerate(distinct) for b, y in distinct[:k]
                  if 100 * len(x & y) >= 85 * len(x | y) and x & y)
    got = ngram_join.near_links(documents(spark, [(i, t, None, None, None, None) for i, t in rows]), rule=ngram_join.Alike(4, 85, 100)).collect()
    assert len(want) > 200 and sorted((*sorted([(r.id_a, r.n_a), (r.id_b, r.n_b)]), r.shared) for r in got) == want
    assert all(r.print_a < r.print_b for r in got) and ngram_join.near_links(documents(spark, [])).count() == 0


def test_near_copies_of_nothing(spark):
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0
    assert ngram_join.near_duplicates(documents(spark, [(1, None, None, None, None, None)])).collect()[0].component_id == 1


def test_near_copies_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, ngram_join.query(spark, SF).collect())) == brute_components(rows, 4, 85, 100)


def test_string_ids_and_prefix_bounds(spark):
    df = spark.createDataFrame([("b", "a b c d e f g h"), ("a", "A B c d e f g h"), ("c", "z")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    rule = ngram_join.Alike(4, 85, 100)
    assert [rule.prefix(n) for n in (1, 6, 7, 20, 100)] == [1, 1, 2, 4, 16]
    assert rule.overlap(100, 100) == 92 and rule.overlap(20, 20) == 19


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bins(pieces, capacity):
    bins = []
    where = []
    for length, source, cluster in pieces:
        fitting = [(capacity - b[0], k) for k, b in enumerate(bins) if capacity - b[0] >= length
                   and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        if fitting:
            k = min(fitting)[1]
        else:
            bins.append([0, set(), set()])
            k = len(bins) - 1
        where.append((k, bins[k][0]))
        bins[k][0] += length
        bins[k][1].add(source)
        bins[k][2].add(cluster)
    return where


def test_packing_finds_the_tightest_compatible_bin(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(0, 60), draw.choice(["hot", "hot", "a", "b", "c", None]), draw.choice([None, i, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, length long, source string, cluster long")
    got = {r.id: (r.bin, r.offset) for r in packing.packed(df, capacity=60, rows_per_shard=1000).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = brute_bins([r[1:] for r in order], 60)
    assert got == {r[0]: (f"0-{b}", o) for r, (b, o) in zip(order, want, strict=True)}


def test_packing_keeps_every_word_of_every_row(spark):
    rows = [(1, 1000, "s", 5), (2, None, None, None), (3, 0, "s", 5), (4, 128, "t", 1), (4, 128, "t", 1), (None, 70, "s", None), (5, 64, "u", 9)]
    df = spark.createDataFrame(rows, "id long, length long, source string, cluster long")
    got = packing.packed(df, capacity=64, rows_per_shard=2).collect()
    for doc_id, n, *_ in rows:
        mine = [r for r in got if r.id == doc_id]
        assert sum(r.length for r in mine) == (n or 0) * sum(1 for r in rows if r[0] == doc_id)
    filled = {}
    for r in got:
        filled.setdefault(r.bin, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 64
    assert packing.packed(df.where("id = 99")).count() == 0


def test_packing_of_the_table_respects_conflicts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins = {}
    for r in packing.query(spark, SF).collect():
        bins.setdefault(r.bin, []).append(r)
    for members in bins.values():
        assert sum(r.length for r in members) <= 2048
        assert len({docs[r.doc_id].source for r in members}) == len(members)
    total = sum(len(WORD.findall(d.text or "")) for d in docs.values())
    assert sum(r.length for members in bins.values() for r in members) == total


def test_dropping_near_copies_tells_rows_apart_by_text(spark):
    words = [f"a{i}" for i in range(60)]
    a, near = " ".join(words), " ".join([*words, "b"])
    keep = lambda rows: sorted(((r.doc_id, r.text) for r in ngram_join.drop_near(documents(spark, [(*r, None, None, None, None) for r in rows])).collect()), key=str)
    assert keep([(1, a), (None, near), (None, "B only"), (None, "C only"), (None, ""), (None, None)]) == sorted(
        [(1, a), (None, "B only"), (None, "C only"), (None, ""), (None, None)], key=str)
    assert keep([(1, a), (2, near), (2, "B only")]) == [(1, a), (2, "B only")]
    assert len(keep([(None, a), (None, near), (None, near + " c")])) == 1
    assert keep([]) == []


def test_a_chain_compares_few_pairs(spark, monkeypatch):
    """Only neighbours of a chain link; no more than the candidates of the prefix lists are compared."""
    rows = [(i, " ".join(f"w{k}" for k in range(2 * i, 2 * i + 40))) for i in range(400)]
    df = documents(spark, [(*r, None, None, None, None) for r in rows])
    seen = []
    whole = ngram_join.candidate_pairs
    monkeypatch.setattr(ngram_join, "candidate_pairs", lambda *a: seen.append(whole(*a)) or seen[0])
    got = ngram_join.near_links(df, rule=ngram_join.Alike(4, 85, 100)).collect()
    assert {(r.id_a, r.id_b) if r.id_a < r.id_b else (r.id_b, r.id_a) for r in got} == {(i, i + 1) for i in range(399)} and len(got) == 399
    assert seen[0].count() < 400 * 25


def test_links_of_the_table_and_of_string_ids(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t, 4), []).append(i)
    sets.pop(frozenset(), None)
    distinct = [(min(ids), s) for s, ids in sets.items()]
    want = {frozenset((a, b)): len(x & y) for k, (a, x) in enumerate(distinct) for b, y in distinct[:k] if x & y and 100 * len(x & y) >= 85 * len(x | y)}
    assert {frozenset((r.id_a, r.id_b)): r.shared for r in ngram_join.links_query(spark, SF).collect()} == want
    df = spark.createDataFrame([("b", "a b c d e f g h i j"), ("a", "A B c d e f g h i j k"), ("c", "z")], "doc_id string, text string")
    assert [sorted((r.id_a, r.id_b)) for r in ngram_join.near_links(df).collect()] == [["a", "b"]]
