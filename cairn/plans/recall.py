"""Recall queries: keyword legs, vector legs, fusion; every evaluation text asks all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import rank, vectors
from cairn.sources import table

K = 6


def _docs(s, d, how=text.tokens) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "lang", "source", how(F.col("text")).alias("tokens"))


def _asked(s, d, how=text.tokens) -> DataFrame:
    return table(s, d, "eval_items").where("text is not null").select(F.col("item_id").alias("query"), how(F.col("text")).alias("tokens"))


def _shape(df: DataFrame) -> DataFrame:
    names = {"query": "item_id", "doc": "doc_id"}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def keyword(s, d, k=K, **how):
    return rank.bm25(_docs(s, d), _asked(s, d), k, **how)


def keyword_words(s, d, k=K):
    return rank.bm25(_docs(s, d, text.word_tokens), _asked(s, d, text.word_tokens), k, k1=1.2, query_set=False)


def keyword_typed(s, d):
    return rank.bm25(_docs(s, d).where("lang = 'en'"), _asked(s, d), K)


def keyword_fields(s, d):
    docs = table(s, d, "memories").select(
        F.col("mem_id").alias("doc"), F.concat(F.flatten(F.array_repeat(text.tokens(F.col("name")), 3)), F.flatten(F.array_repeat(text.tokens(F.col("description")), 2)), text.tokens(F.col("body"))).alias("tokens")
    )
    return rank.bm25(docs, _asked(s, d), K)


def sparse(s, d, k=K):
    return rank.top(rank.sparse_cosine(_docs(s, d), _asked(s, d)), k)


def legs(s, d):
    keep = ["query", "doc", "rank"]
    out = keyword(s, d, 2 * K).select(F.lit("keyword").alias("leg"), *keep)
    out = out.unionByName(keyword_words(s, d, 2 * K).select(F.lit("words").alias("leg"), *keep))
    return out.unionByName(sparse(s, d, 2 * K).select(F.lit("vector").alias("leg"), *keep))


def fused(s, d, weights=None, drop=None):
    rows = legs(s, d)
    if drop:
        rows = rows.where(F.col("leg") != drop)
    return rank.top(rank.fuse(rows, weights=weights), K)


def hybrid(s, d):
    """Fused recall, joined with the documents it names."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source", "lang", "kind")
    return fused(s, d).join(docs, "doc")


def agreement(s, d):
    return rank.agreement(keyword(s, d), sparse(s, d))


def doc_frequency(s, d):
    each = _docs(s, d).select(F.explode(F.array_distinct("tokens")).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(s, d):
    return _docs(s, d).agg(F.count("*").alias("n"), F.round(F.avg(F.size("tokens")), 6).alias("avgdl"))


def _vectors(s, d, scope=False):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label").cast("string") if scope else F.lit("all")).alias("scope"), F.col("embedding").alias("vector"))


def _probe(df: DataFrame) -> DataFrame:
    return df.where("id % 20 = 0")


def vector_topk(s, d, scope=False):
    v = _vectors(s, d, scope)
    return vectors.search(v, _probe(v), k=K).select(F.col("query").alias("query_id"), F.col("vec").alias("vec_id"), "rank", "score")


def vector_pairs(s, d):
    v = _vectors(s, d)
    return vectors.duplicates(vectors.search(v, v, least=0.4))


def vector_knn_pairs(s, d):
    v = _vectors(s, d)
    return vectors.duplicates(vectors.search(v, v, k=5).where("score >= 0.4"))


def best_match(s, d):
    v = _vectors(s, d)
    return vectors.search(v, _probe(v), k=1).select(F.col("query").alias("vec_id"), F.col("vec").alias("best_id"), "score")


def vector_stats(s, d):
    v = table(s, d, "index_points").select(F.col("point_id").alias("id"), F.col("space").alias("scope"), "vector")
    return vectors.stats(v, 64).select(F.col("scope").alias("space"), "n", "unusable")


# -- SQL ---------------------------------------------------------------------------------------------------------------
_TOK = "flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-_./:][a-z0-9]+)*'), lambda t: CASE WHEN regexp_matches(t, '[-_./:]') THEN list_concat([t], list_filter(regexp_split_to_array(t, '[-_./:]'), lambda p: p <> '')) ELSE [t] END))"
_WORDS = r"list_transform(list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_-]+'), lambda t: strlen(t) > 1), lambda t: lower(t))"


def _bm25_sql(tok: str, k1: float, distinct_q: bool, where: str = "", docs: str = "") -> str:
    docs = docs or f"SELECT doc_id AS doc, {tok.format(x='text')} AS tokens FROM documents WHERE text IS NOT NULL {where}"
    terms = "SELECT DISTINCT query, unnest(tokens) AS term, 1 AS times FROM asked" if distinct_q else "SELECT query, term, count(*) AS times FROM (SELECT query, unnest(tokens) AS term FROM asked) GROUP BY ALL"
    return f"""
docs AS ({docs}),
asked AS (SELECT item_id AS query, {tok.format(x='text')} AS tokens FROM eval_items WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS m FROM docs),
tf AS (SELECT doc, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc, len(tokens) AS l, unnest(tokens) AS term FROM docs) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
terms AS ({terms}),
sc AS (SELECT query, doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (0.25 + 0.75 * l / m))), 9) AS score
       FROM terms JOIN tf USING (term) JOIN df USING (term), st GROUP BY query, doc),
top AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""


def _out(body: str, k: int = K) -> str:
    return f"WITH {body} SELECT query AS item_id, doc AS doc_id, score, rank FROM top WHERE rank <= {k}"


_SPARSE = f"""
sdocs AS (SELECT doc_id AS doc, {_TOK.format(x='text')} AS tokens FROM documents WHERE text IS NOT NULL),
stf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(tokens) AS term FROM sdocs) GROUP BY ALL),
sdf AS (SELECT term, ln(1 + (SELECT count(*) FROM sdocs) / count(*)) AS idf FROM stf GROUP BY term),
sw AS (SELECT doc, term, tf * idf AS w FROM stf JOIN sdf USING (term)),
sq AS (SELECT query, term, count(*) * any_value(idf) AS q FROM (SELECT item_id AS query, unnest({_TOK.format(x='text')}) AS term FROM eval_items WHERE text IS NOT NULL) JOIN sdf USING (term) GROUP BY ALL),
ssc AS (SELECT query, doc, round(sum(w * q) / (any_value(norm) * any_value(length)), 9) AS score FROM sw JOIN sq USING (term)
        JOIN (SELECT doc, sqrt(sum(w * w)) AS norm FROM sw GROUP BY doc) USING (doc) JOIN (SELECT query, sqrt(sum(q * q)) AS length FROM sq GROUP BY query) USING (query) GROUP BY query, doc),
stop AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ssc)"""


def _legs_sql(drop: str = "") -> str:
    p = _nested(_bm25_sql(_TOK, 1.5, True), "p")
    w = _nested(_bm25_sql(_WORDS, 1.2, False), "w")
    parts = {"keyword": "SELECT 'keyword' AS leg, query, doc, rank FROM p WHERE rank <= 12", "words": "SELECT 'words', query, doc, rank FROM w WHERE rank <= 12", "vector": "SELECT 'vector', query, doc, rank FROM stop WHERE rank <= 12"}
    return f"WITH {p}, {w}, {_SPARSE}, legs AS ({' UNION ALL '.join(v for k, v in parts.items() if k != drop)})"


def _nested(body: str, name: str) -> str:
    return f"{name} AS (WITH {body} SELECT * FROM top)"


def _fused_sql(weight: str = "1.0", drop: str = "", more: str = "SELECT query AS item_id, doc AS doc_id, score, sources, rank FROM f WHERE rank <= 6") -> str:
    return f"""{_legs_sql(drop)}, f0 AS (SELECT query, doc, round(sum({weight} / (60 + rank)), 9) AS score, array_to_string(list_sort(list(leg)), ',') AS sources FROM legs GROUP BY query, doc),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f0) {more}"""


#: Searches ask with a stated query set; pairs ask with all vectors.
_PROBE = "WHERE q.vec_id % 20 = 0"
_COS = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id {on} {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"""


def queries() -> dict:
    return {
        "bm25_topk": lambda s, d: _shape(keyword(s, d)),
        "bm25_words_topk": lambda s, d: _shape(keyword_words(s, d)),
        "bm25_typed_topk": lambda s, d: _shape(keyword_typed(s, d)),
        "bm25_weighted_fields": lambda s, d: _shape(keyword_fields(s, d)).withColumnRenamed("doc_id", "mem_id"),
        "doc_frequency": doc_frequency,
        "corpus_stats": corpus_stats,
        "sparse_cosine_topk": lambda s, d: _shape(sparse(s, d)),
        "rrf_fuse": lambda s, d: _shape(fused(s, d)),
        "rrf_weighted": lambda s, d: _shape(fused(s, d, weights={"vector": 2.0, "words": 0.5})),
        "rrf_missing_leg": lambda s, d: _shape(fused(s, d, drop="vector")),
        "hybrid_recall": lambda s, d: _shape(hybrid(s, d)),
        "recall_agreement": lambda s, d: agreement(s, d).withColumnRenamed("query", "item_id"),
        "vector_topk": vector_topk,
        "vector_topk_filtered": lambda s, d: vector_topk(s, d, True),
        "vector_dup_pairs": vector_pairs,
        "vector_knn_pairs": vector_knn_pairs,
        "best_match": best_match,
        "vector_stats": vector_stats,
    }


def oracle_sql() -> dict:
    fields = f"SELECT mem_id AS doc, list_concat(list_concat(flatten([n, n, n]), flatten([e, e])), b) AS tokens FROM (SELECT mem_id, {_TOK.format(x="coalesce(name, '')")} AS n, {_TOK.format(x="coalesce(description, '')")} AS e, {_TOK.format(x="coalesce(body, '')")} AS b FROM memories)"
    return {
        "bm25_topk": _out(_bm25_sql(_TOK, 1.5, True)),
        "bm25_words_topk": _out(_bm25_sql(_WORDS, 1.2, False)),
        "bm25_typed_topk": _out(_bm25_sql(_TOK, 1.5, True, "AND lang = 'en'")),
        "bm25_weighted_fields": _out(_bm25_sql(_TOK, 1.5, True, docs=fields)).replace("doc AS doc_id", "doc AS mem_id"),
        "doc_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format(x='text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term",
        "corpus_stats": f"SELECT count(*) AS n, round(avg(len({_TOK.format(x='text')})), 6) AS avgdl FROM documents WHERE text IS NOT NULL",
        "sparse_cosine_topk": f"WITH {_SPARSE} SELECT query AS item_id, doc AS doc_id, score, rank FROM stop WHERE rank <= 6",
        "rrf_fuse": _fused_sql(),
        "rrf_weighted": _fused_sql("CASE leg WHEN 'vector' THEN 2.0 WHEN 'words' THEN 0.5 ELSE 1.0 END"),
        "rrf_missing_leg": _fused_sql(drop="vector"),
        "hybrid_recall": _fused_sql(more="SELECT query AS item_id, doc AS doc_id, score, sources, rank, source, lang, kind FROM f JOIN documents ON doc_id = doc WHERE rank <= 6"),
        "recall_agreement": f"""WITH {_nested(_bm25_sql(_TOK, 1.5, True), 'p')}, {_SPARSE},
b AS (SELECT coalesce(x.query, y.query) AS query, coalesce(x.rank, y.rank) AS rank, x.doc AS a, y.doc AS b FROM (SELECT * FROM p WHERE rank <= 6) x FULL JOIN (SELECT * FROM stop WHERE rank <= 6) y ON x.query = y.query AND x.rank = y.rank)
SELECT query AS item_id, round(CASE WHEN count(a) = 0 THEN 0.0 ELSE coalesce(min(CASE WHEN a IS NULL OR b IS NULL OR a <> b THEN rank END) - 1, count(a)) / count(a) END, 6) AS agreement FROM b GROUP BY query""",
        "vector_topk": _COS.format(on="", where=_PROBE) + " SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 6",
        "vector_topk_filtered": _COS.format(on="AND q.label = v.label", where=_PROBE) + " SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 6",
        "vector_dup_pairs": _COS.format(on="", where="") + " SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, max(score) AS score FROM r WHERE score >= 0.4 GROUP BY ALL",
        "vector_knn_pairs": _COS.format(on="", where="") + " SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, max(score) AS score FROM r WHERE rank <= 5 AND score >= 0.4 GROUP BY ALL",
        "best_match": _COS.format(on="", where=_PROBE) + " SELECT query_id AS vec_id, vec_id AS best_id, score FROM r WHERE rank = 1",
        "vector_stats": "SELECT space, count(*) AS n, count(*) FILTER (WHERE vector IS NULL OR len(vector) <> 64) AS unusable FROM index_points GROUP BY space",
    }
