"""Catalog queries."""

from pyspark.sql import functions as F

from corpusradar.operators import catalog as K
from corpusradar.registry import query


@query("list_papers", """
SELECT * FROM (SELECT 'en' AS call, paper_id, title FROM catalog WHERE domain = 'src3' AND repo_url IS NOT NULL AND is_analyzed
               ORDER BY ingested_at DESC, paper_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'page2', paper_id, title FROM catalog ORDER BY ingested_at DESC, paper_id LIMIT 20 OFFSET 20)
UNION ALL SELECT * FROM (SELECT 'skip', paper_id, title FROM catalog WHERE action = 'Skip' ORDER BY ingested_at DESC, paper_id LIMIT 20)
""", "catalog")
def _(t):
    p = t.catalog
    calls = {
        "en": K.list_papers(p, domain="src3", has_repo=True, analyzed_only=True),
        "page2": K.list_papers(p, offset=20, has_repo=False),
        "skip": K.list_papers(p, action="Skip"),
    }
    parts = [df.select(F.lit(n).alias("call"), "paper_id", "title") for n, df in calls.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("get_paper", """
SELECT paper_id, title, action, overall_score, domain, stack_fit, summary, repo_url, CAST(NULL AS VARCHAR) AS hype_reason
FROM catalog WHERE paper_id IN (SELECT doc_id FROM labels)""", "catalog")
def _(t):
    found = K.get_papers(t.catalog, t.labels.select(F.col("doc_id").alias("paper_id")))
    return K.brief(found).select("paper_id", "title", "action", "overall_score", "domain", "stack_fit", "summary", "repo_url",
                                 "hype_reason")


@query("hidden_gems", """
SELECT paper_id, title, overall_score, hype_score FROM catalog WHERE is_analyzed AND overall_score >= 7 AND hype_score <= 4
ORDER BY overall_score DESC, paper_id LIMIT 10""", "catalog")
def _(t):
    return K.hidden_gems(t.catalog).select("paper_id", "title", "overall_score", "hype_score")


@query("analyzed", """
SELECT * FROM (SELECT 'best' AS call, paper_id, overall_score FROM catalog WHERE is_analyzed ORDER BY overall_score DESC, paper_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'recent', paper_id, overall_score FROM catalog WHERE is_analyzed
  AND ingested_at >= (SELECT max(ingested_at) FROM catalog) - INTERVAL '2' HOUR ORDER BY overall_score DESC, paper_id LIMIT 50)
""", "catalog")
def _(t):
    best, recent = K.analyzed(t.catalog), K.analyzed(t.catalog, recent=True)
    cols = ["paper_id", "overall_score"]
    return best.select(F.lit("best").alias("call"), *cols).unionByName(recent.select(F.lit("recent").alias("call"), *cols))


@query("health_counts", """
SELECT count(*) AS papers, count(*) FILTER (is_analyzed) AS analyzed, count(*) FILTER (lang = 'en') AS indexed FROM catalog""",
       "catalog")
def _(t):
    return K.health_counts(t.catalog, F.col("lang") == "en")


@query("paper_view", """
SELECT paper_id, title, array_to_string(categories, ',') AS categories, CAST(epoch(published_at) AS BIGINT) AS published, repo_url, domain,
       overall_score, hype_score, action, cluster_theme, n_chars AS columns_full, abstract, summary, stack_fit, has_code
FROM (SELECT * REPLACE (0 AS n_chars) FROM catalog)""", "catalog")
def _(t):
    short, full = K.paper_view(t.catalog), K.paper_view(t.catalog, full=True)
    dropped = sorted(set(full.columns) - set(short.columns))
    assert dropped == ["abstract", "has_code", "stack_fit", "summary"], dropped
    return full.select(
        "paper_id", "title", F.array_join("categories", ",").alias("categories"),
        F.unix_timestamp("published_at").alias("published"), "repo_url", "domain", "overall_score", "hype_score", "action",
        "cluster_theme", F.lit(0).alias("columns_full"), *["abstract", "summary", "stack_fit", "has_code"])


@query("merge_catalog", """
SELECT paper_id, title, a.paper_id IS NOT NULL AS has_analysis, coalesce(a.domain, p.lang) AS domain, a.overall_score, a.hype_score
FROM papers p FULL OUTER JOIN analysis a USING (paper_id)""", "papers analysis")
def _(t):
    papers = t.papers.select("paper_id", "title", F.col("lang").alias("domain"))
    merged = K.merge_catalog(papers, t.analysis)
    return merged.select("paper_id", "title", F.coalesce("is_analyzed", F.lit(False)).alias("has_analysis"), "domain",
                         "overall_score", "hype_score")


@query("tab_filter", """
SELECT 'adopt' AS tab, paper_id FROM catalog WHERE contains(lower(action), 'adopt')
UNION ALL SELECT 'experiment', paper_id FROM catalog WHERE contains(lower(action), 'experiment')
UNION ALL SELECT 'watch', paper_id FROM catalog WHERE action = 'Watch'
UNION ALL SELECT 'gems', paper_id FROM catalog WHERE paper_id IN (SELECT paper_id FROM catalog
   WHERE is_analyzed AND overall_score >= 7 AND hype_score <= 4 ORDER BY overall_score DESC, paper_id LIMIT 20)
UNION ALL SELECT 'stack', paper_id FROM catalog WHERE contains(stack_fit, 'src1 ') OR contains(stack_fit, '/ de')
UNION ALL SELECT 'new', paper_id FROM catalog WHERE is_analyzed IS NULL""", "catalog")
def _(t):
    p = t.catalog
    gems = K.hidden_gems(p, 20)
    out = None
    for kind in ("adopt", "experiment", "watch", "gems", "stack", "new"):
        part = K.tab_filter(p, kind, gems, ["SRC1 ", "/ de"]).select(F.lit(kind).alias("tab"), "paper_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("stack_match", """
SELECT paper_id, stack_fit FROM catalog WHERE contains(stack_fit, 'src7') OR contains(stack_fit, 'fr')""", "catalog")
def _(t):
    return K.stack_match(t.catalog, ["src7", "FR"]).select("paper_id", "stack_fit")


@query("daily_digest", """
SELECT count(*) AS papers, count(*) FILTER (contains(lower(action), 'adopt')) AS adopt,
       count(*) FILTER (contains(lower(action), 'experiment')) AS experiment, count(*) FILTER (action = 'Watch') AS watch,
       count(*) FILTER (hype_score >= 7 AND overall_score < 5) AS overhyped,
       round(avg(coalesce(overall_score, 0)), 1) AS mean_score FROM catalog""", "catalog")
def _(t):
    return K.daily_digest(t.catalog)


@query("substring_search", """
SELECT paper_id FROM catalog WHERE contains(lower(title), 'ther') OR contains(lower(abstract), 'ther') OR contains(lower(summary), 'ther')
""", "catalog")
def _(t):
    return K.substring_search(t.catalog, "THER").select("paper_id")
