"""Keyword search: BM25, word overlap, query expansion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import search_tokens, word_set, words
from corpusradar.operators.kbest import _Best
from corpusradar.session import broadcast_if_small, cut_lineage, release

GRID = 1 << 21  # scores worked on at a time
MOST_QUERIES = 2048  # of a scope: up to so many have a place in the array of every text; beyond, texts and questions are joined by term
MOST_ASKED = 1_000_000  # terms of questions that every task may hold


def postings(corpus: DataFrame, id_col: str, *scope: str, asked: DataFrame | None = None) -> DataFrame:
    """``(scope, id_col, dl, term, tf)``, of all terms or of those in ``asked(scope, term)``, which then are picked before any exchange."""
    cut = corpus.select(*scope, id_col, search_tokens(F.col("text")).alias("_tokens"))
    if asked is None:  # one exchange on the text's id serves counting here and scoring later
        cut = cut.repartition(id_col)
    # The length is a column before the explode; beside it, it would be worked out again for every token. The outer form
    # keeps Spark from deriving a "has tokens" filter, which would cut every text once more below the exchange.
    rows = cut.select(*scope, id_col, F.size("_tokens").alias("dl"), "_tokens").select(
        *scope, id_col, "dl", F.explode_outer("_tokens").alias("term")).where("term IS NOT NULL")
    if asked is not None:
        rows = rows.join(asked, [*scope, "term"], "left_semi")
    return rows.groupBy(id_col, *scope, "dl", "term").agg(F.count("*").alias("tf"))


def document_frequencies(post: DataFrame, *scope: str) -> DataFrame:
    return post.groupBy(*scope, "term").agg(F.count("*").alias("df"))


def bm25_index(corpus: DataFrame, id_col: str = "paper_id", scope: str | None = None,
               asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (of the ``asked`` terms), document frequencies and ``(n, avgdl)``, per ``scope`` if given.

    The average length counts white-space words while a document's own length counts tokens.
    """
    keys = [scope] if scope else []
    post = postings(corpus, id_col, *keys, asked=asked)
    df = document_frequencies(post, *keys)
    stats = corpus.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("text")))).alias("avgdl"))
    return post, df, stats


def bm25_score(queries: DataFrame, corpus: DataFrame, id_col: str = "paper_id", scope: str | None = None,
               k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, id_col, score)`` for every text that shares a token with the query; repeated query tokens count again.

    With ``scope`` (a column of both sides) each scope is a corpus of its own. Up to ``MOST_QUERIES`` questions per scope, of ``MOST_ASKED``
    terms, go to the texts, whose postings of asked terms then cross the network once, packed and dealt by text, and are summed as arrays;
    otherwise both sides are joined.
    """
    return _scores(queries, corpus, id_col, scope, k1, b)


def _scores(queries: DataFrame, corpus: DataFrame, id_col: str, scope: str | None, k1: float = 1.5, b: float = 0.75,
            k: int | None = None) -> DataFrame:
    """The scores of all texts; with ``k`` it may leave out what is not among a question's k best, or has no score above 0."""
    keys = [scope] if scope else []
    asked = queries.select("query_id", *keys, F.explode(search_tokens(F.col("query"))).alias("term")).groupBy(
        "query_id", *keys, "term").agg(F.count("*").alias("qtf"))
    asked = cut_lineage(asked)
    questions = asked.select("query_id", *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if questions > MOST_QUERIES or asked.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        return _joined(asked, corpus, id_col, scope, k1, b)
    table = _Asked(asked.toArrow(), scope)
    shared = corpus.sparkSession.sparkContext.broadcast(table)
    kinds = {c: corpus.schema[c].dataType.simpleString() for c in (id_col, *keys)}
    cut = corpus.select(id_col, *keys, search_tokens(F.col("text")).alias("_tokens"))
    packed = cut.mapInArrow(_pack_postings(shared), ", ".join(f"`{c}` {kinds[c]}" for c in kinds) + ", dl int, _post binary")
    # Rows of one id and length are one text, as in ``postings``; the sort brings the texts of one id together.
    post = cut_lineage(packed.repartition(id_col).groupBy(id_col, *keys, "dl").agg(F.collect_list("_post").alias("_posts")).sortWithinPartitions(id_col))
    release(post.sparkSession)
    found = post.select("_posts").mapInArrow(_frequencies(shared), "pair int, df bigint").groupBy("pair").agg(F.sum("df").alias("df")).toArrow()
    stats = corpus.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("text")))).alias("avgdl"))
    if keys:
        stats = stats.join(broadcast_if_small(asked.select(*keys).distinct()), keys, "left_semi")
    weighted = corpus.sparkSession.sparkContext.broadcast(table.weighted(found, stats.toArrow(), scope))
    return post.select(F.col(id_col).alias("id"), "dl", "_posts").mapInArrow(
        _summed_posts(weighted, k, k1, b, id_col), f"`{id_col}` {kinds[id_col]}, query_id {queries.schema['query_id'].dataType.simpleString()}, score double")


def _joined(asked: DataFrame, corpus: DataFrame, id_col: str, scope: str | None, k1: float, b: float) -> DataFrame:
    """The scores by joins of postings and questions, for questions too many to go to the texts."""
    keys = [scope] if scope else []
    small = asked.limit(100_001).count() <= 100_000
    terms = asked.select(*keys, "term").distinct()
    post, _, stats = bm25_index(corpus, id_col, scope, F.broadcast(terms) if small else terms)
    post = cut_lineage(post)  # frequencies and scores both start from it, and it holds asked terms only
    release(post.sparkSession)
    df = document_frequencies(post, *keys)
    matched = df.join(F.broadcast(asked) if small else asked, [*keys, "term"])
    if keys:
        matched = matched.join(broadcast_if_small(stats), keys)
    else:
        matched = matched.select("*", stats.select("n").scalar().alias("n"), stats.select("avgdl").scalar().alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = matched.select("query_id", *keys, "term", (F.col("qtf") * idf).alias("weight"), "avgdl")
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return post.join(weights, [*keys, "term"]).groupBy(id_col, "query_id").agg(F.round(F.sum(F.col("weight") * share), 6).alias("score"))


class _Asked:
    """Asked terms, numbered by scope and term (``pair``), and the questions that ask them."""

    def __init__(self, table: pa.Table, scope: str | None):
        table = table.filter(pc.is_valid(table[scope])) if scope else table  # as in a join
        terms = _one(table["term"]).dictionary_encode()
        scopes = _one(table[scope]).dictionary_encode() if scope else None
        names = _one(table["query_id"]).dictionary_encode("encode")
        self.terms, self.scopes, self.names = terms.dictionary, scopes.dictionary if scope else None, names.dictionary
        of = _codes(terms) + (len(self.terms) * _codes(scopes) if scope else 0)
        order = np.argsort(of, kind="stable")
        self.key, self.first = np.unique(of[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.query, self.qtf = _codes(names)[order], table["qtf"].to_numpy()[order].astype("float64")

    def weighted(self, found: pa.Table, stats: pa.Table, scope: str | None) -> tuple:
        """``(first, query, weight, avgdl, names)``: rows ``first[pair]`` to ``first[pair + 1]`` ask a pair; ``avgdl`` by pair."""
        df, n, avgdl = np.zeros(len(self.key)), np.zeros(len(self.key)), np.full(len(self.key), np.nan)
        df[found["pair"].to_numpy()] = found["df"].to_numpy()
        at = pc.index_in(_one(stats[scope]), self.scopes).to_numpy(zero_copy_only=False) if scope else np.zeros(len(stats))
        for row, where in enumerate(at):
            mine = slice(*np.searchsorted(self.key, [where * len(self.terms), (where + 1) * len(self.terms)])) if scope else slice(None)
            n[mine], avgdl[mine] = stats["n"][row].as_py(), stats["avgdl"][row].as_py() or np.nan
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        return self.first, self.query, self.qtf * np.repeat(idf, np.diff(self.first)), avgdl, self.names


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks else pa.array([], column.type)


def _codes(named: pa.DictionaryArray) -> np.ndarray:
    return named.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pack_postings(shared, rows: int = 1024):
    """Rows ``id[, scope], tokens`` to ``id[, scope], dl, _post``: the pairs asked of the text and how often it has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                lists = batch.column(batch.num_columns - 1)
                dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.index_in(lists.flatten(), asked.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(dl)), dl)
                if asked.scopes is not None:
                    place = pc.index_in(batch.column(1), asked.scopes, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    code = np.where((code < 0) | (place[row] < 0), -1, code + len(asked.terms) * place[row])
                pair = np.searchsorted(asked.key, code)
                hit = np.flatnonzero((code >= 0) & (pair < len(asked.key)))
                hit = hit[asked.key[pair[hit]] == code[hit]]
                cell, tf = np.unique(row[hit] * len(asked.key) + pair[hit], return_counts=True)
                if not len(cell):
                    continue
                row, pair = np.divmod(cell, len(asked.key))
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                posts = [_pack(pair[s:e], tf[s:e]) for s, e in zip(starts.tolist(), np.append(starts[1:], len(row)).tolist())]
                which = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(which) for c in batch.columns[:-1]), pa.array(dl[row[starts]], pa.int32()), pa.array(posts, pa.binary())],
                    names=[*batch.schema.names[:-1], "dl", "_post"])

    return run


def _pack(pair: np.ndarray, tf: np.ndarray) -> bytes:
    """Ascending pairs by their steps, and counts; bytes of one place value side by side, compressed."""
    numbers = np.concatenate([np.diff(pair, prepend=0), tf]).astype("<u4")
    return zlib.compress(np.ascontiguousarray(numbers.view("u1").reshape(-1, 4).T).tobytes(), 1)


def _unpack(posts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts of a text; the rows of one text are counted together."""
    parts = []
    for post in posts:
        planes = np.frombuffer(zlib.decompress(post), "u1").reshape(4, -1)
        numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        parts.append((np.cumsum(numbers[: len(numbers) // 2]), numbers[len(numbers) // 2:]))
    if len(parts) == 1:
        return parts[0]
    pair, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pair, np.bincount(at, np.concatenate([t for _, t in parts])).astype(np.int64)


def _frequencies(shared):
    """The number of texts of a task that have a pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value.key), np.int64)
        for batch in batches:
            for posts in batch.column(0).to_pylist():
                df[_unpack(posts)[0]] += 1
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(df[has])], names=["pair", "df"])

    return run


def _summed_posts(shared, k: int | None, k1: float, b: float, id_col: str):
    """Rows ``id, dl, _posts`` sorted by id to ``id, query_id, score``; rows of one id may go on in the next batch."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        begin, query, weight, avgdl, names = shared.value
        many = np.diff(begin)
        for batch in batches:
            rows, work, at, dl = [], 0, 0, batch.column(1).to_numpy()
            for i, posts in enumerate(batch.column(2).to_pylist()):
                pair, tf = _unpack(posts)
                rows.append((np.full(len(pair), i - at), pair, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[i] / avgdl[pair]))))
                work += max(len(names), int(many[pair].sum()))
                if work >= GRID or i == batch.num_rows - 1:
                    row, pair, share = map(np.concatenate, zip(*rows))
                    times = many[pair]
                    flat = np.repeat(begin[pair] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    yield batch.column(0).slice(at, i + 1 - at), np.repeat(row, times), query[flat], np.repeat(share, times) * weight[flat]
                    rows, work, at = [], 0, i + 1

    return lambda batches: _united(parts(batches), shared.value[-1], k, id_col)


def _summed(post: DataFrame, table: pa.Table, k: int | None, id_col: str):
    """Rows ``id, _code, _share`` sorted by id to ``id, query_id, score``; rows of one id may go on in the next batch."""
    table = table.combine_chunks().sort_by("_code")
    asked = (table["query_id"].combine_chunks() if len(table) else pa.array([], table.schema.field("query_id").type)).dictionary_encode("encode")
    shared = post.sparkSession.sparkContext.broadcast((
        table["_code"].to_numpy(), asked.indices.to_numpy(zero_copy_only=False).astype(np.int64), table["weight"].to_numpy(), asked.dictionary))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        code, query, weight, names = shared.value
        for batch in batches:
            first = np.searchsorted(code, batch.column(1).to_numpy())
            many = np.searchsorted(code, batch.column(1).to_numpy(), side="right") - first
            work, at = np.cumsum(np.maximum(many, len(names))), 0  # a row may begin a text, which has a sum per question
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + GRID, side="right")))
                start, times = first[at:end], many[at:end]
                flat = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())
                share = np.repeat(batch.column(2).to_numpy()[at:end], times)
                yield batch.column(0).slice(at, end - at), np.repeat(np.arange(end - at), times), query[flat], share * weight[flat]
                at = end

    return lambda batches: _united(parts(batches), shared.value[-1], k, id_col)


def _united(parts: Iterator[tuple], names: pa.Array, k: int | None, id_col: str) -> Iterator[pa.RecordBatch]:
    """Scores from ``(ids, row, question, value)``: ids in order, values that count for a row of these and a question."""
    n, every = len(names), np.arange(len(names))
    dense = n <= MOST_QUERIES  # else most sums would stay 0: the questions of other scopes
    best = _Best(n, k, -5e-7, "at_start") if k else None
    open_id, open_sums = None, (np.zeros(0, np.int64), np.zeros(0))  # the last id and its sums so far: questions and values

    def done(ids: pa.Array, text: np.ndarray, query: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        score = np.round(sums, 6)
        if best and dense:
            grid = np.zeros((len(ids), n))
            grid[text, query] = -score
            best.offer(every, grid, ids)
        elif best:
            best.offer_rows(query, -score, ids, text)
        else:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), names.take(pa.array(query)), pa.array(score)], names=[id_col, "query_id", "score"])

    for ids, row, query, value in parts:
        named = ids.dictionary_encode()
        same = named.indices.fill_null(len(named.dictionary)).to_numpy(zero_copy_only=False)
        text = np.cumsum(np.append(False, same[1:] != same[:-1]))
        heads = ids.take(pa.array(np.flatnonzero(np.append(True, text[1:] != text[:-1]))))
        key = text[row] * n + query
        if open_id is not None:
            if heads[0].as_py() == open_id[0].as_py():
                key, value = np.append(open_sums[0], key), np.append(open_sums[1], value)
            else:
                yield from done(open_id, np.zeros(len(open_sums[0]), np.int64), *open_sums)
        if dense:
            sums = np.bincount(key, value, len(heads) * n)
            key = np.flatnonzero(sums > 0)
            sums = sums[key]
        else:
            key, at = np.unique(key, return_inverse=True)
            sums = np.bincount(at, value, len(key))
        text, query = np.divmod(key, n)
        last = int(np.searchsorted(text, len(heads) - 1))
        yield from done(heads.slice(0, len(heads) - 1), text[:last], query[:last], sums[:last])
        open_id, open_sums = heads.slice(len(heads) - 1), (query[last:], sums[last:])
    if open_id is not None:
        yield from done(open_id, np.zeros(len(open_sums[0]), np.int64), *open_sums)
    rows = best.cut() if best else None
    if rows is not None:
        yield from pa.table({id_col: rows["id"], "query_id": names.take(rows["q"].combine_chunks()), "score": pa.array(-rows["distance"].to_numpy())}).to_batches()


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "paper_id", scope: str | None = None) -> DataFrame:
    """The k best ``(id_col, query_id, score, rank)`` per question; stored, so that the postings need not be."""
    scored = _scores(queries, corpus, id_col, scope, k=k)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    best = cut_lineage(scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0)))
    release(best.sparkSession)
    return best


def keyword_overlap_topk(queries: DataFrame, papers: DataFrame, n: int = 8, stop_words: Sequence[str] = C.KEYWORD_STOP_WORDS) -> DataFrame:
    """Shared distinct words, those of the title three times; score per query word, and a distance made from it."""
    keep = lambda col: F.filter(word_set(col, 3), lambda w: ~w.isin(list(stop_words)))
    asked = queries.select("query_id", keep(F.col("query")).alias("_q")).select(
        "query_id", F.size("_q").alias("_size"), F.explode("_q").alias("term"))
    pairs = lambda col, weight: F.transform(keep(col), lambda w: F.struct(w.alias("term"), F.lit(weight).alias("w")))
    doc = F.concat("title", F.lit(". "), "abstract")
    terms = papers.select("paper_id", "title", "abstract").repartition("paper_id").select(
        "paper_id", F.explode_outer(F.concat(pairs(F.col("title"), 3), pairs(doc, 1))).alias("t")).select(
        "paper_id", "t.term", "t.w").where("term IS NOT NULL")
    hits = terms.join(broadcast_if_small(asked), "term").groupBy("paper_id", "query_id").agg(
        (F.sum("w") / F.first("_size")).alias("_raw"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "paper_id")
    scored = hits.select("query_id", "paper_id", F.round("_raw", 6).alias("score"),
                         F.round(1 - F.least(F.col("_raw") / 5, F.lit(1.0)), 6).alias("distance"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("source", F.lit("bm25"))


def expand_query(query: Column, expansions: Mapping[str, str] = C.EXPANSIONS) -> Column:
    """Append the synonyms of every trigger found in the query, in table order."""
    low = F.lower(query)
    extra = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in expansions.items()]))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


def named_entities(query: Column) -> Column:
    """Sorted distinct CamelCase and all-capitals words; a word is a full run of letters, digits and underscores."""
    runs = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(runs, lambda w: w.rlike("^(?:[A-Z][a-z]+(?:[A-Z][a-z]+)+|[A-Z]{2,})$"))))
