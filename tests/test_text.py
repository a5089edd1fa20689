from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions import dialog as D
from corpusradar.operators import chunking as K
from corpusradar.sources import ingest as I

LONG = "This paragraph has quite enough plain words to be kept as a chunk of text."


def blocks(spark, rows):
    return spark.createDataFrame([(1, p, i, t, k) for i, (p, t, k) in enumerate(rows)],
                                 "paper_id long, page int, block_no int, text string, kind string")


def test_sections_noise_and_overlap(spark):
    rows = [
        (1, LONG, "text"), (1, "Introduction", "text"),  # a header below 20 characters is noise: dropped unseen
        (1, "2 Related Work and Context\nbody of a header block goes with it", "text"),
        (1, "First " + LONG, "text"), (1, "Figure 3: a caption that is long enough", "text"), (2, "1) Second item, where $a+b$ is math and long", "text"),
        (2, "c1 | c2\n------------------------------\n1 | 2", "table"), (2, "12 34 56", "text"), (3, "References and Further Reading", "text"), (3, "Ref " + LONG, "text"),
    ]
    c = {r["chunk_id"]: r for r in K.chunk_records(blocks(spark, rows)).collect()}
    assert set(c) == {"1_p1_b0", "1_p1_b1", "1_p1_b2", "1_p2_t0", "1_p2_b4"}
    assert c["1_p1_b0"]["section"] == "Abstract" and c["1_p1_b0"]["section_order"] == 0
    assert c["1_p1_b1"]["section"] == "2 Related Work and Context" and c["1_p1_b1"]["raw_text"] == "First " + LONG
    assert c["1_p1_b2"]["type"] == "caption" and " [...] " not in c["1_p1_b2"]["raw_text"]
    last = c["1_p2_b4"]
    assert last["raw_text"] == "Figure 3: a caption that is long enough [...] 1) Second item, where $a+b$ is math and long"
    assert last["text"].startswith("[2 Related Work and Context | Page 2 | MATH | LIST]\n") and last["type"] == "math"
    assert c["1_p2_t0"]["text"].startswith("[2 Related Work and Context | Page 2 | TABLE]\n")
    summaries = {r["section"]: r for r in K.section_summaries(K.chunk_records(blocks(spark, rows))).collect()}
    assert summaries["2 Related Work and Context"]["chunk_id"] == "1_sum_2_related_work_and_context"
    assert summaries["2 Related Work and Context"]["has_math"]
    stats = K.index_stats(K.chunk_records(blocks(spark, rows)), K.section_summaries(K.chunk_records(blocks(spark, rows))), blocks(spark, rows)).first()
    assert (stats["sections"], stats["pages"], stats["chunks"], stats["tables"], stats["captions"], stats["summaries"]) == (2, 3, 7, 1, 1, 2)


def test_summary_stops_at_the_word_limit(spark):
    rows = [(1, " ".join(f"w{i}x{j}" for j in range(30)) + " plain words", "text") for i in range(5)]
    got = K.section_summaries(K.chunk_records(blocks(spark, rows)), 50).first()
    assert len(got["clean_text"].split()) == 50


def test_replace_partition_is_idempotent(spark):
    index = K.build_index(blocks(spark, [(1, LONG, "text"), (1, "More " + LONG, "text")]))
    again = K.build_index(blocks(spark, [(1, LONG, "text"), (1, "More " + LONG, "text")]), index)
    assert sorted(map(str, index.collect())) == sorted(map(str, again.collect()))


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("v")).first()["v"]


def test_intents(spark):
    deep = D.deep_intent(F.col("t"))
    for text, want in [("implement a retrieval module", "implement"), ("explain the loss function", "formula"), ("derive the proof", "math"),
                       ("benchmark results", "results"), ("A vs B", "compare"), ("explain it", "explain"), ("who wrote it", "short"), ("hm", "discuss"),
                       ("code the theorem", "math")]:
        assert one(spark, text, deep) == want, text
    glob = D.global_intent(F.col("t"))
    for text, want in [("latest best papers", "latest"), ("learn and deploy", "learning"), ("deploy vs build", "practical"), ("a versus b", "compare"),
                       ("suggest one", "recommend"), ("hm", "factual")]:
        assert one(spark, text, glob) == want, text
    assert one(spark, "Write me a poem", D.off_topic(F.col("t"))) and not one(spark, "poem analysis", D.off_topic(F.col("t")))


def test_decomposition(spark):
    subs = one(spark, "implement the attention index", D.decompose_query(F.col("t"), F.lit("implement")))
    assert len(subs) == 7 and subs[0] == "implement the attention index" and subs[5].endswith("value projection")
    assert len(one(spark, "the system", D.decompose_query(F.col("t"), F.lit("discuss")))) == 3
    assert len(one(spark, "x", D.decompose_query(F.col("t"), F.lit("math")))) == 3
    assert one(spark, "x", D.decompose_query(F.col("t"), F.lit("short"))) == ["x"]
    assert one(spark, "x", D.sub_query_budget(F.lit(20), F.lit(7))) == 5 and one(spark, "x", D.sub_query_budget(F.lit(20), F.lit(1))) == 20
    assert one(spark, "x", D.chunk_budget(F.lit("implement"))) == 20 and one(spark, "x", D.chunk_budget(F.lit("?"))) == 10


def test_code_blocks_and_citations(spark):
    segments = one(spark, "a ```python\nx = 1\n``` b ```\ny```", D.code_blocks(F.col("t")))
    assert [tuple(s) for s in segments] == [("text", None, "a "), ("code", "python", "x = 1"), ("text", None, " b "), ("code", "text", "y")]
    cites = one(spark, "[[section:Method]] and [[page:07]]", D.inline_citations(F.col("t")))
    assert [tuple(c) for c in cites] == [("page", "7"), ("section", "Method")]


def test_confidence_note(spark):
    note = D.confidence_note(F.col("t"), F.lit("gradient descent converges"))
    assert one(spark, "gradient methods", note) == "gradient methods"
    assert one(spark, "bananas grow slowly outdoors", note).endswith(C.CAVEAT)
    assert one(spark, "it is so", note) == "it is so"


def test_ingest_columns(spark):
    assert one(spark, "see HTTPS://GitHub.com/a-b/c.d). more", I.extract_repo_link(F.col("t"))) == "HTTPS://GitHub.com/a-b/c.d"
    assert one(spark, None, I.extract_repo_link(F.col("t"))) is None
    assert tuple(one(spark, "https://github.com/o/r/tree/main/", I.parse_repo(F.col("t")))) == ("o", "r")
    assert one(spark, "https://github.com/o", I.parse_repo(F.col("t"))) is None
    assert one(spark, "http://x.org/abs/2401.12345v2", I.base_id(F.col("t"))) == "2401.12345"
    rows = F.array(F.array(F.lit(" a "), F.lit(None).cast("string")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, "x", I.table_chunk_text(rows)) == "a | \n" + "-" * 30 + "\n1 | 2"


def test_html_blocks(spark):
    html = "<html><script>var t='</p>';</script><h1>T &amp; x</h1><p>one<br>two<p>three</p><li>i</li><table><tr><td>a</td><td>b</td></tr></table>"
    got = I.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_no").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("heading", "T & x"), ("text", "one two"), ("text", "three"), ("text", "i"), ("table", "a | b |")]


def test_bulk_infer_marks_failures(spark):
    def make():
        def model(texts, attempt):
            if texts.str.contains("boom").any():
                raise RuntimeError("down")
            return texts.where(texts.str.len() < 3 * attempt, "bad")
        return model
    df = spark.createDataFrame([(1, "ok"), (2, "long"), (3, "too long text")], "id long, t string").coalesce(1)
    got = {r["id"]: (r["output"], r["attempts"], r["error"]) for r in I.bulk_infer(df, "id", "t", make, lambda s: s != "bad").collect()}
    assert got == {1: ("ok", 1, None), 2: ("long", 2, None), 3: (None, 2, "invalid output")}
    bad = I.bulk_infer(df.withColumn("t", F.lit("boom")), "id", "t", make, lambda s: s != "bad").collect()
    assert all(r["output"] is None and r["error"] == "down" and r["attempts"] == 2 for r in bad)


def test_search_tokens_are_those_of_unicode_word_boundaries(spark):
    import re

    from corpusradar.functions.text import search_tokens

    texts = ["café naïve-bayes -foo-- über straße x_1 -- a-b", "état-major 日本go go日本 x² a², b—c-d_e-", "_a_ -a- __ é_a ab́cd ٣4 a٣", "", "Ab-é cd-", "--ab--cd--"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(search_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [re.findall(r"\b[a-zA-Z0-9_\-]{2,}\b", t.lower()) for t in texts]


def test_character_references(spark):
    from corpusradar.functions.text import decode_entities

    cases = {"a &lt;b&gt; &amp;lt; &quot;x&quot; &#39;&nbsp;.": 'a <b> &lt; "x" \' .', "caf&eacute; &#8217;s &#x1F600; &Eacute;": "caf\u00e9 \u2019s \U0001f600 \u00c9",
             "R&D; &unknown; & &#0; &#xD800; &#9999999; &; &amp;eacute;": "R&D; &unknown; & \ufffd \ufffd \ufffd &; &eacute;", "": "", "&": "&"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", decode_entities(F.col("t")).alias("got")).collect())
