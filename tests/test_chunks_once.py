"""Chunks and section summaries from one pass, against the two separate ways."""

import random

import pytest

from corpusradar.operators import chunking as K


def blocks(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        head = rng.random() < 0.2
        text = rng.choice(["Introduction", "Methods", "Results", "References"]) if head else " ".join(
            rng.choice(["alpha", "beta", "$x$", "gamma.", "delta\n"]) for _ in range(rng.choice([3, 30, 200, 900])))
        rows.append((rng.randint(1, 4), i // 10 + 1, i, rng.choice(["text", "text", "text", "table"]) if not head else "text", text))
    return spark.createDataFrame(rows, "paper_id int, page int, block_no int, kind string, text string")


OPTIONS = dict(pattern=r"^(Introduction|Methods|Results|References)$", min_chars=5)


def lines(df):
    return sorted(str(r.asDict()) for r in df.select(*K.CHUNK_COLUMNS).collect())


@pytest.mark.parametrize("seed, n, limit", [(1, 120, 500), (2, 60, 7), (3, 0, 500)])
def test_one_pass_equals_two(spark, seed, n, limit):
    chunks = K.chunk_records(blocks(spark, seed, n), **OPTIONS)
    both = K.chunks_with_summaries(chunks, limit)
    assert lines(both) == lines(chunks.select(K.CHUNK_COLUMNS).unionByName(K.section_summaries(chunks, limit)))


def test_text_is_exchanged_once(spark, tmp_path):
    blocks(spark, 1, 200).write.parquet(str(tmp_path / "b"))
    index = K.build_index(spark.read.parquet(str(tmp_path / "b")), **OPTIONS)
    plan = index._jdf.queryExecution().sparkPlan().toString() + index._jdf.queryExecution().executedPlan().toString()
    executed = index._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange ") == 1 and plan.count("FileScan") == 2  # one scan in each of the two plans
