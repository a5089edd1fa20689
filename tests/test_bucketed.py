"""Updates in place: touched buckets only, counts, and calls repeated after a driver died."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusradar.sources import bucketed as B

PAPERS = "paper_id string, title string, abstract string, domain string, overall_score double, latency_score double, is_analyzed boolean, is_embedded boolean"


def make(spark, folder, schema=PAPERS, key="paper_id", buckets=8):
    return B.BucketedTable(spark, str(folder), key, StructType.fromDDL(schema), buckets)


@pytest.fixture
def papers(spark, tmp_path):
    rows = [(f"2401.{i:05d}", f"title {i}", f"text of paper {i}", "old", None, None, False, i % 4 == 0) for i in range(80)]
    rows += [(None, "no id", "kept", "old", None, None, False, True), ("twice", "a", "x", "old", None, None, False, True),
             ("twice", "b", "y", "old", None, None, False, True)]
    return make(spark, tmp_path / "papers").create(spark.createDataFrame(rows, PAPERS))


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table.data) for f in names
            if f.endswith(".parquet")}


def content(table):
    return sorted(map(str, table.read().collect()))


def results(spark, ids):
    return spark.createDataFrame([(i, "cs", 7.5, 3.0) for i in ids], "paper_id string, domain string, overall_score double, latency double")


def test_only_touched_buckets_are_rewritten(spark, papers):
    before = files(papers)
    counts = B.save_analysis(papers, results(spark, ["2401.00007", "unknown", None]), "r1")
    assert counts["updated"] == 1 and counts["inserted"] == 0
    touched = {r[0] for r in results(spark, ["2401.00007", "unknown"]).select(papers.bucket()).collect()}
    after = files(papers)
    for name in set(before) | set(after):
        bucket = int(name.split("_bucket=")[1].split("/")[0])
        assert (before.get(name) == after.get(name)) == (bucket not in touched)
    row = papers.read().where("paper_id = '2401.00007'").first()
    assert row.is_analyzed and row.domain == "cs" and row.latency_score == 3.0 and row.title == "title 7"
    assert papers.read().count() == 83 and papers.read().where("is_analyzed").count() == 1


def test_read_of_buckets_is_pruned(papers):
    plan = papers.read([1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_repeated_ids(spark, papers):
    twice = results(spark, ["twice", "2401.00001"]).unionByName(results(spark, ["2401.00001"]).withColumn("domain", F.lit("math")))
    assert B.save_analysis(papers, twice, "r1")["updated"] == 3  # both stored rows of one id, one row of the other
    assert papers.read().where("paper_id = '2401.00001'").count() == 1
    assert papers.read().where("paper_id = 'twice' AND is_analyzed").count() == 2


def test_same_run_is_applied_once(spark, papers):
    first = papers.merge("r1", spark.createDataFrame([("new", "t")], "paper_id string, title string"))
    was = content(papers)
    again = papers.merge("r1", spark.createDataFrame([("new", "other")], "paper_id string, title string"))
    assert first == again and first["inserted"] == 1 and content(papers) == was


@pytest.mark.parametrize("lost", ["before the overwrite", "within the overwrite", "before the receipt"])
def test_driver_dies_and_calls_again(spark, papers, tmp_path, monkeypatch, lost):
    change = results(spark, [f"2401.{i:05d}" for i in range(40)])
    twin = make(spark, tmp_path / "twin").create(papers.read())
    want = B.save_analysis(twin, change, "r1")
    apply = B.BucketedTable._apply

    def dies(self, run, stage):
        if lost != "before the overwrite":
            apply(self, run, stage)
            self._drop(f"{self.folder}/runs/{run}")
        if lost == "within the overwrite":
            self._drop(f"{self.data}/" + sorted(d for d in os.listdir(self.data) if d.startswith("_bucket="))[0])
        raise RuntimeError("lost")

    monkeypatch.setattr(B.BucketedTable, "_apply", dies)
    with pytest.raises(RuntimeError):
        B.save_analysis(papers, change, "r1")
    monkeypatch.setattr(B.BucketedTable, "_apply", apply)
    if lost == "before the receipt":  # another update comes first and carries the staged one out
        papers.merge("r2", spark.createDataFrame([("2401.00001", "later")], "paper_id string, title string"))
        twin.merge("r2", spark.createDataFrame([("2401.00001", "later")], "paper_id string, title string"))
    assert B.save_analysis(papers, change, "r1") == want
    assert content(papers) == content(twin) and os.listdir(f"{papers.folder}/stage") == []


def test_unfinished_stage_is_forgotten(spark, papers):
    was = content(papers)
    os.makedirs(f"{papers.folder}/stage/broken/_bucket=0")
    papers.finish()
    assert content(papers) == was and os.listdir(f"{papers.folder}/stage") == []


def test_empty_table_and_empty_update(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    assert table.read().count() == 0
    none = spark.createDataFrame([], "paper_id string, title string")
    assert table.merge("r0", none) == {"inserted": 0, "updated": 0, "kept": 0, "removed": 0}
    assert table.merge("r1", spark.createDataFrame([("a", "t")], "paper_id string, title string"))["inserted"] == 1
    assert [r.title for r in table.read().collect()] == ["t"]
    with pytest.raises(ValueError):
        table.create(none)
    with pytest.raises(ValueError):
        table.merge("../r", none)


def test_embedding_flips_flags_and_counts(spark, papers, tmp_path, monkeypatch):
    vectors = make(spark, tmp_path / "vectors", "paper_id string, embedding array<double>")
    merge = B.BucketedTable.merge

    def dies(self, run, rows, insert=True):
        if self.folder == papers.folder:
            raise RuntimeError("lost")
        return merge(self, run, rows, insert)

    monkeypatch.setattr(B.BucketedTable, "merge", dies)
    with pytest.raises(RuntimeError):  # vectors are stored, flags are not
        B.embed_stored(papers, vectors, "e1")
    monkeypatch.setattr(B.BucketedTable, "merge", merge)
    assert vectors.read().count() == 60
    assert B.embed_stored(papers, vectors, "e1") == 60
    assert papers.read().where("is_embedded").count() == 83 and vectors.read().count() == 60
    assert B.embed_stored(papers, vectors, "e2") == 0
    assert all(len(r.embedding) == 128 for r in vectors.read().collect())


def test_chunks_are_replaced(spark, tmp_path):
    schema = "chunk_id string, paper_id long, raw_text string"
    old = spark.createDataFrame([(f"{p}_{i}", p, f"old {i}") for p in range(20) for i in range(p % 5 + 1)], schema)
    table = make(spark, tmp_path / "chunks", schema).create(old)
    new = spark.createDataFrame([("3_0", 3, "new"), ("99_0", 99, "new"), ("x", None, "no paper")], schema)
    counts = B.save_chunks(table, new, "c1")
    assert counts["removed"] == 4 and counts["inserted"] == 2
    got = {(r.chunk_id, r.raw_text) for r in table.read().collect()}
    want = {(r.chunk_id, r.raw_text) for r in old.collect() if r.paper_id != 3} | {("3_0", "new"), ("99_0", "new")}
    assert got == want


def test_metadata_leaves_vectors(spark, tmp_path):
    table = make(spark, tmp_path / "v", "paper_id long, embedding array<double>, title string, action string")
    table.create(spark.createDataFrame([(i, [float(i)], "old") for i in range(10)], "paper_id long, embedding array<double>, title string"))
    counts = B.save_metadata(table, spark.createDataFrame([(4, "n" * 600), (77, "x")], "paper_id long, title string"), "m1")
    assert counts["updated"] == 1
    rows = {r.paper_id: r for r in table.read().collect()}
    assert len(rows) == 10 and len(rows[4].title) == 500 and rows[4].embedding == [4.0] and rows[4].action == "" and rows[5].action is None


def test_turns(spark, tmp_path):
    table = make(spark, tmp_path / "h", "conv_id long, title string, message_count long, last_used timestamp", "conv_id")
    table.create(spark.createDataFrame([(1, "first", 2), (2, "second", 3)], "conv_id long, title string, message_count long"))
    incoming = spark.createDataFrame([(2, 6, "more"), (5, 0, "hello"), (None, 1, "lost")], "conv_id long, history_count long, message string")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    for _ in range(2):
        counts = B.save_turns(table, incoming, now, "t1")
    assert counts["updated"] == 1 and counts["inserted"] == 1
    assert {(r.conv_id, r.title, r.message_count) for r in table.read().collect()} == {(1, "first", 2), (2, "second", 4), (5, "hello", 1)}
