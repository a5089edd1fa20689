"""Held-out accuracy of the models, personal data against plain expressions, and the pipeline against its parts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpusradar.llm import language_id, pii, quality
from test_dedup_and_joins import FOLD, brute_components

SF = "/root/testdata/sf0.01"


# ---- quality ---------------------------------------------------------------------------------------------------------

def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.query(spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_quality_of_odd_rows(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("alpha beta gamma delta".split()) for _ in range(20)) if i % 2 else "!!! ### " * 10) for i in range(200)]
    rows += [(900, None), (901, ""), (901, ""), (902, "alpha " * 50_000)]
    df = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 1), (5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(df, quality.fit(df, labels)).collect()}
    assert all((got[i].score > 0.5) == bool(i % 2) for i in range(200)) and got[900].score == got[901].score
    none = quality.fit(df, labels.where("quality > 5"))
    assert {r.score for r in quality.scored(df, none).collect()} == {0.5}
    assert quality.scored(df.where("doc_id < 0"), quality.fit(df.where("doc_id < 0"), labels)).count() == 0


def test_word_vectors_add_up_over_partitions(spark):
    texts = spark.createDataFrame([(f"the cat {i % 7} sat. THE cat, the the mat",) for i in range(50)], "text string")
    s = quality.Settings(vocabulary_bits=8, dimensions=8)
    assert np.array_equal(quality.word_vectors(texts.coalesce(1), s), quality.word_vectors(texts.repartition(7), s))
    vectors, text = quality.index_vectors(s), b"one two three"
    ids, _ = quality.tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 8)
    single = quality.word_vectors(spark.createDataFrame([(text.decode(),)], "text string"), s)
    raw = np.zeros((256, 8))
    for i, a in enumerate(ids):
        for j, b in enumerate(ids):
            if i != j and abs(i - j) <= 2:
                raw[a] += vectors[b]
    unit = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    want = unit[ids] - unit[ids].mean(0)
    assert np.allclose(single[ids], want, atol=1e-6)


# ---- language --------------------------------------------------------------------------------------------------------

def test_language_of_documents_and_pages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language_id.query(spark, SF).collect()
    assert len(got) == 1000 and np.mean([r.language == lang[r.doc_id] for r in got]) >= 0.99 and sum(r.accepted for r in got) >= 995
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    said = {r.page_id: r.html.split('lang="')[1][:2] for r in pages.collect()}
    got = language_id.pages_query(spark, SF).collect()
    assert len(got) == len(said) and np.mean([r.language == said[r.page_id] for r in got]) >= 0.97


def test_evidence_is_fused(spark):
    en, de = "the house of the friend is there and that is what they say", "das haus des freundes ist dort und das ist was sie sagen"
    rows = [(i, en, "en", "a") for i in range(40)] + [(100 + i, de, "de-AT", "b") for i in range(40)]
    rows += [(200, de, "en", "b"), (201, "zzz", None, "b"), (202, "zzz", "en", "a"), (203, None, "de", "b"), (204, "12 !", None, None), (200, de, "en", "b"),
             (None, en, "?", "a")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, source string, language string, confidence double")
    got = {}
    for r in language_id.identified(language_id.document_evidence(df)).collect():
        got.setdefault(r.id, []).append((r.language, r.accepted))
    assert len(got[200]) == 2 and got[200][0] == ("de", True) and got[201] == [("de", True)] and got[202] == [("en", True)]
    assert got[203] == [("de", False)] and not got[204][0][1] and got[None] == [("en", True)]
    kept = language_id.drop_rejected(df)
    assert kept.columns == df.columns and {203, 204}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == 85
    silent = df.withColumn("lang", df["lang"].substr(9, 1))
    assert {r.accepted for r in language_id.identified(language_id.document_evidence(silent)).collect()} == {False}
    assert language_id.identified(language_id.document_evidence(df.where("doc_id < 0"))).count() == 0


def test_a_rare_language_is_found_whatever_the_others_have(spark):
    en, fi = "the house of the friend is there and that is what they say", "talo on siellä ja ystävän sanat ovat mitä he sanovat"
    rows = spark.range(6000).selectExpr("id AS doc_id", f"'{en}' AS text", "'en' AS lang", "'a' AS source").union(
        spark.createDataFrame([(10_000 + i, fi, "fi" if i < 5 else None, "b") for i in range(8)], "doc_id long, text string, lang string, source string"))
    got = {r.id: (r.language, r.accepted) for r in language_id.identified(language_id.document_evidence(rows)).collect()}
    assert len(got) == 6008 and all(got[10_000 + i] == ("fi", True) for i in range(8)) and got[0] == ("en", True)


def test_short_texts_and_repeated_ids_are_judged_by_row(spark):
    en = "the house of the friend is there and that is what they say"
    rows = [(i, en, "en", "a") for i in range(60)] + [(100, "OK", "en", "a"), (101, "I", "en", "a"), (102, "12", "en", "a"), (103, "é", "en", "a")]
    rows += [(None, en, "en", "a"), (None, "...", "en", "a"), (7, "", "en", "a")]
    rows += [(104, "the house of the friend and what they say " * 40_000, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language_id.drop_rejected(df).collect()
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in got), key=str) == sorted(
        ((i, (t or "")[:9]) for i, t, *_ in rows if any(c.isalpha() for c in t)), key=str)


# ---- personal data ---------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_base_entities_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) | {""}


def base_of(spark, texts):
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, kind string, id string")
    rows = pii.extracted(df).where("base").collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r.id, pii.KINDS.index(r.kind), r.start)):
        got[r.id].append(f"{r.kind}:{r.start}:{r.end}")
    return got


def test_base_entities_of_random_and_long_texts(spark):
    draw = random.Random(11)
    alphabets = ["ab.@-_ 1", "0123456789.", "0123456789 -", "+()- .0123456789", "a@b.c ", "é𝄞a@b.c1 +5-"]
    texts = ["".join(draw.choice(a) for _ in range(draw.randrange(1, 70))) for a in alphabets for _ in range(60)]
    texts += ["a@b.c@d.e.f", "x@y.z_q@r.st", "1.2.3.4.5.6.7.8", "300.1.1.1", "0000000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (017) 555-7713.", "", None, "7" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "a.b@" + "c." * 20_000, "+1" + " " * 30_000]
    assert base_of(spark, texts) == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_contexts_discover_what_expressions_miss(spark):
    draw = random.Random(2)
    rows = [f"call our office at +1 (555) {100 + i}-{2000 + i} today or write {draw.random()}" for i in range(12)]
    rows += ["call our office at 555-8899-12 today or never", "the figure 5558899123 is large", "call our office at 555-8899-12 today or never"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    more = {(r.id, r.kind, rows[r.id][r.start:r.end]) for r in pii.extracted(df).where("NOT base").collect()}
    assert {(12, "phone", "555-8899-12"), (14, "phone", "555-8899-12")} <= more and not any(i == 13 for i, *_ in more)
    strict = pii.extracted(df, settings=pii.Bootstrap(min_seeds=100)).where("NOT base")
    assert strict.count() == 0


def test_words_cut_at_the_border_of_the_context_make_no_pattern(spark):
    long = "z" * 76
    rows = [(1, f"prefix{long} no 12", "0123456789", "next word"), (2, "no 12 ", "0123456789", " " + long + "cutword tail")]
    table = spark.createDataFrame([(i, b[-80:], a[:80]) for i, b, _, a in rows], "id int, before string, after string")
    got = {r.id: r.p for r in table.select("id", pii._patterns().alias("p")).collect()}
    assert got[1] == ["no 12 _", "12 _ word"] and got[2] == ["no 12 _"]


def test_contexts_discover_identifiers_with_blanks(spark):
    rows = [f"call our office at +1 (555) {100 + i}-{2000 + i} today or write {i}" for i in range(12)]
    rows += [f"please charge my card 4111 1111 1111 {n} for this" for n in (1111, 1129, 1137, 1145, 1152, 1160)]
    spaced = {"(017) 555-7713": "phone", "017 555 7713": "phone", "(017) 555 77 13": "phone", "4111 1111 1111 1112": "card"}
    lines = {v: f"é in 2019 call our office at {v} today" if k == "phone" else f"5 please charge my card {v} for this" for v, k in spaced.items()}
    rows += lines.values()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    more = {(r.kind, rows[r.id][r.start:r.end]) for r in pii.extracted(df).where("NOT base").collect()}
    assert {(k, v) for v, k in spaced.items()} <= more
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert [clean[18 + i] for i in range(3)] == ["é in 2019 call our office at [PHONE] today"] * 3
    assert clean[21] == "5 please charge my card [CARD] for this"


def test_redaction_and_repeated_rows(spark):
    rows = [(1, "é a@b.co, b@c.de x", "x", 3), (1, "é a@b.co, b@c.de x", "y", 3), (1, "other 10.0.0.1", "z", 3), (None, "w@x.yz", None, None),
            (2, None, None, None), (3, "clean text 5", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int")
    got = pii.redacted(df)
    assert got.columns == df.columns and sorted([r.text or "" for r in got.collect()]) == sorted(
        ["é [EMAIL], [EMAIL] x"] * 2 + ["other [IP]", "[EMAIL]", "", "clean text 5"])
    assert pii.extracted(df.where("doc_id = 77")).count() == 0


# ---- pipeline --------------------------------------------------------------------------------------------------------

def test_stages_keep_columns_and_do_their_part(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    state, kept = docs, set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.stored(stage(spark, state, folder), "test")
        assert state.columns == docs.columns and dict(state.dtypes) == dict(docs.dtypes)
        now = {r.doc_id: r for r in state.collect()}
        if name == "exact_dedup":
            best = {}
            for i in kept:
                best[rows[i].translate(FOLD)] = max(i, best.get(rows[i].translate(FOLD), i))
            assert set(now) == set(best.values())
        elif name == "near_dedup":
            assert set(now) == {least for _, _, least in brute_components([(i, rows[i]) for i in kept], 5, 80, 100)}
        elif name == "pii":
            assert set(now) == kept and not any(plain_spans(r.text) for r in now.values())
            assert all(r.n_chars == len(r.text) and (r.text == rows[i] or plain_spans(rows[i])) for i, r in now.items())
        else:
            assert set(now) == kept  # clean documents of known languages all stay
        kept = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, state, folder).collect()
    assert {r.doc_id for r in packed} == kept


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "bin", "offset"] and got.count() > 100


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, stage):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, empty, "").count() == 0
