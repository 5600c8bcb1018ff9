"""BM25, cosine, fused and hybrid retrieval.

Corpus: ``documents``; queries: all ``benchmark`` texts.  Vector search asks
for the neighbours of every row of ``embeddings`` among all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import normalise
from ..config import RetrievalConfig, SizeLimits
from ..operators.blocks import block_search
from ..operators.cells import CellCodes, calibrated, coded, nearest_coded, picked, read_coded, train, write_coded
from ..operators.embed import HashedEncoder, embed
from ..operators.fusion import fuse
from ..operators.lexical import corpus_statistics, idf, query_terms, read_corpus, term_statistics
from ..operators.nearest import (
    PlaneCells, assign_cells, nearest, nearest_approximate, nearest_post_filtered, recall_at_k, train_cells,
)
from ..operators.rerank import query_scores
from ..plans.index import Index, build_index, index_of, open_index
from ..plans.retrieve import candidate_list, hybrid_hits, retrieve, semantic_list
from ..session import materialise, scratch_path
from ..sources.store import IndexStore
from .tables import table, tokens_of

K = 10
DIM = 384
PLANES, PROBES = 4, 3
CELLS, CELL_PROBES = 16, 12
#: Coded cells: share of the cells that a query probes, and of the vectors that it scores exactly.
CODED_PROBES, CODED_RESCORE = 0.85, 0.1
RECALL, SCORED = 0.9, 0.25


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("meta_lang"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    return index_of(corpus(spark, sf_dir), HashedEncoder(DIM))


def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = materialise(term_statistics(corpus(spark, sf_dir)), "terms")
    stats = read_corpus(corpus_statistics(terms))
    return terms.filter(F.col("term").isNotNull()).select("term", "df", F.round(idf(F.col("df"), stats), 6).alias("idf"))


def bm25_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = materialise(term_statistics(corpus(spark, sf_dir)), "terms")
    return corpus_statistics(terms).select(
        "n_docs", "total_length", "n_terms", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf")
    )


def bm25_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_terms(questions(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search(corpus(spark, sf_dir), questions(spark, sf_dir), K)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(vectors(spark, sf_dir), vector_queries(spark, sf_dir), K)


def cosine_topk_by_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the plan for queries that do not fit into every task: blocks around pivots, pairs pruned by their bounds."""
    return nearest(vectors(spark, sf_dir), vector_queries(spark, sf_dir), K, limits=SizeLimits(broadcast_bytes=0, block_rows=128))


def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(vectors(spark, sf_dir), vector_queries(spark, sf_dir), K, where={"label": 3})


def cosine_topk_post_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_post_filtered(vectors(spark, sf_dir), vector_queries(spark, sf_dir), K, {"label": 3})


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = normalise(vectors(spark, sf_dir), "embedding")
    return unit.select("doc_id", F.posexplode("embedding").alias("dim", "v")).select(
        "doc_id", "dim", (F.round("v", 6) + F.lit(0.0)).alias("value")
    )


def cosine_plane_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = PlaneCells(64, PLANES)
    stored = materialise(assign_cells(vectors(spark, sf_dir), cells), "cells")
    return nearest_approximate(stored, vector_queries(spark, sf_dir), K, cells, probes=PROBES)


def cosine_centroid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained cells with the share of the exact hits they find."""
    base, asked = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    cells = train_cells(base, CELLS)
    stored = materialise(assign_cells(base, cells), "cells")
    found = nearest_approximate(stored, asked, K, cells, probes=CELL_PROBES)
    return recall_at_k(found, nearest(base, asked, K))


def _stored_cells(spark: SparkSession, rows: DataFrame, codes: CellCodes) -> tuple[DataFrame, CellCodes]:
    path = scratch_path(spark, "coded")
    write_coded(coded(rows, codes), path, codes)
    return read_coded(spark, path)


def coded_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cells with codes picked by rule: hits, the share of vectors scored for them, and their recall."""
    base, asked = vectors(spark, sf_dir).select("doc_id", "embedding"), vector_queries(spark, sf_dir)
    n = base.count()
    rows, codes = _stored_cells(spark, base, picked(base, n))
    found = materialise(nearest_coded(
        rows, asked, codes, K, probes=max(1, round(CODED_PROBES * codes.cells)), rescore=round(CODED_RESCORE * n)), "found")
    recall = recall_at_k(found, nearest(base, asked, K))
    return found.join(recall, "query_id").select(
        "query_id", "rank", "doc_id", "score", F.round(F.col("scored") / n, 6).alias("scored_share"), "recall")


def coded_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained cells and codes, probes and rescoring calibrated: whether recall and the share of scored vectors are what they should be."""
    base, asked = vectors(spark, sf_dir).select("doc_id", "embedding"), vector_queries(spark, sf_dir)
    n = base.count()
    rows, codes = _stored_cells(spark, base, train(base, n))
    probes, rescore = calibrated(rows, codes, K)
    found = materialise(nearest_coded(rows, asked, codes, K, probes=probes, rescore=rescore), "found")
    scored = found.filter("rank = 1").agg(F.count(F.lit(1)).alias("queries"), (F.avg("scored") / n <= SCORED).alias("scored_within"))
    recall = recall_at_k(found, nearest(base, asked, K)).agg((F.avg("recall") >= RECALL).alias("recall_reached"))
    return scored.join(recall)


def approximate_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index with cells in two batches: how many questions have their list, and whether enough of the exact lists is in them."""
    path, encoder = scratch_path(spark, "index"), HashedEncoder(DIM)
    records = materialise(company_records(spark, sf_dir), "records")
    for n in range(2):
        build_index(records.filter(F.col("startup_id") % 2 == n), path, encoder=encoder, id_col="startup_id", batch=f"part{n}", cells=True)
    index = open_index(spark, path, encoder)
    asked = questions(spark, sf_dir)
    found = semantic_list(asked, index, K, cfg=RetrievalConfig(approximate=True))
    recall = recall_at_k(found, semantic_list(asked, index, K))
    return recall.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= RECALL).alias("recall_reached"))


def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = embed(corpus(spark, sf_dir).select("doc_id", "text"), HashedEncoder(DIM))
    return (
        embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).filter(F.col("v") != 0)
        .select("doc_id", "bucket", F.round(F.col("v").cast("double"), 6).alias("value"))
    )


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = HashedEncoder(DIM)
    docs = embed(corpus(spark, sf_dir).select("doc_id", "text"), encoder).select("doc_id", "embedding")
    return nearest(docs, embed(questions(spark, sf_dir), encoder).select("query_id", "embedding"), K)


def fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_list(questions(spark, sf_dir), document_index(spark, sf_dir))


def fused_equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vector lists of the same query, one restricted to a label."""
    plain = cosine_topk(spark, sf_dir)
    return fuse([plain, cosine_topk_filtered(spark, sf_dir)], top_k=K)


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hybrid_hits(questions(spark, sf_dir), document_index(spark, sf_dir))
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "rerank_score")


def hybrid_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hybrid_hits(questions(spark, sf_dir), document_index(spark, sf_dir), where={"lang": "en"})
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "rerank_score")


def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flagged company records, the text as the description."""
    return corpus(spark, sf_dir).selectExpr(
        "doc_id AS startup_id", "doc_id AS ordinal", "'' AS name", "'' AS industry", "'' AS tags", "meta_lang AS country",
        "CAST(NULL AS INT) AS founded_year", "text AS description", "'given' AS source", "false AS is_suspicious",
    )


def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid hits out of an index that was written to disk and opened again."""
    path = scratch_path(spark, "index")
    build_index(company_records(spark, sf_dir), path, encoder=HashedEncoder(DIM), id_col="startup_id", reset=True)
    index = open_index(spark, path, HashedEncoder(DIM))
    hits = hybrid_hits(questions(spark, sf_dir), index)
    return hits.select("query_id", "rank", "doc_id", "rerank_score")


def merged_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits out of an index that came in five overlapping batches, four of which were merged, one of them repeated."""
    path, encoder = scratch_path(spark, "index"), HashedEncoder(DIM)
    records, store = materialise(company_records(spark, sf_dir), "records"), IndexStore(spark, path)
    for n in range(5):
        part = records.filter((F.col("startup_id") % 5 == n) | (F.col("startup_id") % 7 == 0))
        build_index(part, path, encoder=encoder, id_col="startup_id", batch=f"part{n}")
    store.compact()
    build_index(records.filter("startup_id % 5 = 1"), path, encoder=encoder, id_col="startup_id", batch="part1")
    hits = hybrid_hits(questions(spark, sf_dir), open_index(spark, path, encoder))
    return hits.select("query_id", "rank", "doc_id", "rerank_score")


def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = retrieve(questions(spark, sf_dir), document_index(spark, sf_dir))
    return result.select("query_id", "n_docs", "best_score", "mean_score", "confidence")


def hit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_scores(hybrid_hits(questions(spark, sf_dir), document_index(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_terms, bm25_corpus, bm25_query_terms, cosine_topk, cosine_topk_by_pivots, cosine_topk_filtered, cosine_topk_post_filtered,
    unit_vectors, cosine_plane_cells, cosine_centroid_cells, coded_cells_topk, coded_cells_recall,
    approximate_index_recall, embedded_documents, semantic_topk, fused_topk,
    fused_equal_weights, hybrid_topk, hybrid_topk_filtered, stored_index_topk, merged_index_topk, retrieval_confidence, hit_scores,
)}


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def _bm25(documents: str = "documents", k: int = 20, allowed: str = "true") -> str:
    """BM25 list of every benchmark text; ``allowed`` filters hits, not statistics."""
    return f"""
toks AS (SELECT doc_id, lang, unnest({tokens_of('text')}) AS term FROM {documents}),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, len({tokens_of('text')}) AS dl FROM {documents}),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
rawidf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, st),
avgidf AS (SELECT avg(r) AS a FROM rawidf),
idfs AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * a ELSE r END AS idf FROM rawidf, avgidf),
qtoks AS (SELECT item_id AS query_id, unnest({tokens_of('text')}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qtoks GROUP BY ALL),
bmscore AS (SELECT query_id, tf.doc_id,
    sum(qtf * idf * (tf::DOUBLE * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS s
  FROM qt JOIN idfs USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st WHERE {allowed} GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(s, 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank
  FROM bmscore WHERE s > 0 QUALIFY rank <= {k})"""


def _cosine(condition: str = "true", k: int = K) -> str:
    return f"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
cosine AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label,
    round(CASE WHEN q.n = 0 OR d.n = 0 THEN 0 ELSE list_dot_product(q.v, d.v) / q.n / d.n END, 6) + 0 AS score
  FROM u q, u d WHERE {condition}),
top AS (SELECT query_id, doc_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosine QUALIFY rank <= {k})"""


def _hashed(name: str, source: str, key: str) -> str:
    """Unit vectors in float precision, one row per non-zero bucket."""
    return f"""
{name}_tok AS (SELECT {key}, md5(unnest({tokens_of('text')})) AS h FROM {source}),
{name}_cnt AS (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} AS bucket,
    sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS w FROM {name}_tok GROUP BY ALL),
{name}_vec AS (SELECT {key}, bucket,
    (w / sqrt(sum(w * w) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM {name}_cnt WHERE w <> 0),
{name}_norm AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_vec GROUP BY ALL)"""


def _semantic(k: int = 20, allowed: str = "true") -> str:
    return f"""
{_hashed('d', 'documents', 'doc_id')}, {_hashed('q', 'benchmark', 'item_id')},
dots AS (SELECT item_id AS query_id, doc_id, sum(q.v * d.v) AS s FROM q_vec q JOIN d_vec d USING (bucket) GROUP BY ALL),
semscore AS (SELECT b.item_id AS query_id, x.doc_id, coalesce(round(s / qn.n / dn.n, 6), 0) + 0 AS score
  FROM benchmark b CROSS JOIN documents x LEFT JOIN dots ON dots.query_id = b.item_id AND dots.doc_id = x.doc_id
  LEFT JOIN q_norm qn ON qn.item_id = b.item_id LEFT JOIN d_norm dn ON dn.doc_id = x.doc_id WHERE {allowed}),
sem AS (SELECT query_id, doc_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM semscore QUALIFY rank <= {k})"""


_FUSED = """
entries AS (SELECT query_id, doc_id, 0 AS list_id, rank, 1.0::DOUBLE / (60 + rank) AS part FROM sem
  UNION ALL SELECT query_id, doc_id, 1, rank, 0.4::DOUBLE / (60 + rank) FROM bm),
merged AS (SELECT query_id, doc_id, round(sum(part), 9) AS score, min(list_id * 100000 + rank) AS seen
  FROM entries GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM merged QUALIFY rank <= 20)"""


_RERANKED = f"""
qw AS (SELECT query_id, term, ln(1 + n / (1 + coalesce(df, 0))) AS weight
  FROM (SELECT DISTINCT query_id, term FROM qt) LEFT JOIN dfs USING (term), st),
qsum AS (SELECT query_id, sum(weight) AS total FROM qw GROUP BY 1),
pairs AS (SELECT fused.*, count(*) OVER (PARTITION BY query_id) > 5 AS needed FROM fused),
found AS (SELECT p.query_id, p.doc_id, sum(weight) AS f
  FROM pairs p JOIN qw USING (query_id) JOIN tf ON tf.doc_id = p.doc_id AND tf.term = qw.term GROUP BY ALL),
scored AS (SELECT p.query_id, p.doc_id, p.score, p.rank AS before_rank,
    CASE WHEN needed THEN coalesce(round(f / total, 6), 0) END AS rerank_score
  FROM pairs p LEFT JOIN found USING (query_id, doc_id) LEFT JOIN qsum USING (query_id)),
hits AS (SELECT query_id, doc_id, round(score, 6) AS score, rerank_score,
    row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, before_rank) AS rank
  FROM scored QUALIFY rank <= 5)"""


def hybrid_ctes(allowed: str = "true") -> str:
    """Everything up to the final ``hits``."""
    return ", ".join([
        _bm25(allowed=allowed.format(d="tf")), _semantic(allowed=allowed.format(d="x")), _FUSED, _RERANKED
    ])


_CONFIDENCE = """
, s AS (SELECT query_id, coalesce(max(rerank_score), 1.0) AS best_score,
    round(coalesce(avg(rerank_score), 1.0), 6) AS mean_score, count(*) AS n_docs FROM hits GROUP BY 1)"""

# A stored company document holds the text on its last line, behind a label.
_STORED = """(SELECT doc_id, lang, concat_ws(chr(10), CASE WHEN lang <> '' THEN 'Country: ' || lang END,
  'Description: ' || regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) AS text FROM documents)"""

_PLANES = f"""
planes AS (SELECT p, list(CASE WHEN ('0x' || substr(md5(p::VARCHAR || ':' || d::VARCHAR), 1, 1))::BIGINT % 2 = 0
    THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS plane FROM range({PLANES}) t(p), range(64) s(d) GROUP BY p),
margins AS (SELECT vec_id, p, round(list_dot_product(v, plane) / n, 9) AS m FROM u, planes),
own AS (SELECT vec_id, sum(CASE WHEN m >= 0 THEN 1 << p ELSE 0 END)::BIGINT AS cell FROM margins GROUP BY 1),
flips AS (SELECT vec_id, p FROM margins
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(m), p) <= {PROBES - 1}),
probed AS (SELECT vec_id, cell FROM own UNION ALL
  SELECT vec_id, xor(cell, (1 << p)::BIGINT) FROM own JOIN flips USING (vec_id)),
near AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM cosine JOIN own ON own.vec_id = doc_id JOIN probed ON probed.vec_id = query_id AND probed.cell = own.cell
  QUALIFY rank <= {K})"""

_CODED = f"""
counted AS (SELECT count(*) AS n, CAST(round(sqrt(count(*))) AS BIGINT) AS cells FROM u),
x AS (SELECT vec_id, list_transform(v, lambda a: CASE WHEN n = 0 THEN a ELSE a / n END) AS x FROM u),
cent AS (SELECT cell, list_transform(x, lambda a: round(a, 6)) AS c FROM (
    SELECT x, row_number() OVER (ORDER BY md5('cell:' || vec_id), vec_id) - 1 AS cell FROM x), counted WHERE cell < cells),
close AS (SELECT vec_id, x, cell, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(x, c) - list_dot_product(c, c) / 2, 9) DESC, cell) AS place FROM x, cent),
celled AS (SELECT vec_id, cell, c, list_transform(list_zip(x, c), lambda p: p[1] - p[2]) AS r FROM close WHERE place = 1),
groups AS (SELECT CAST(unnest(range(16)) AS BIGINT) AS g),
entries AS (SELECT g, entry, list_transform(r[4 * g + 1:4 * g + 4], lambda a: round(a, 6)) AS e
  FROM (SELECT r, row_number() OVER (ORDER BY md5('code:' || vec_id), vec_id) - 1 AS entry FROM celled), groups WHERE entry < 256),
coding AS (SELECT vec_id, g, arg_min(e, [apart, entry]) AS e FROM (
    SELECT vec_id, g, entry, e, round(list_dot_product(e, e) - 2 * list_dot_product(p, e) + list_dot_product(p, p), 9) AS apart
    FROM (SELECT vec_id, g, r[4 * g + 1:4 * g + 4] AS p FROM celled, groups) JOIN entries USING (g)) GROUP BY ALL),
approx AS (SELECT vec_id, cell, list_transform(list_zip(c, h), lambda p: p[1] + p[2]) AS y
  FROM celled JOIN (SELECT vec_id, flatten(list(e ORDER BY g)) AS h FROM coding GROUP BY 1) USING (vec_id)),
looked AS (SELECT vec_id AS query_id, x AS q, cell FROM close, counted WHERE place <= greatest(1, round({CODED_PROBES} * cells))),
survivors AS (SELECT query_id, a.vec_id AS doc_id FROM looked JOIN approx a USING (cell), counted
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, y), 9) DESC, a.vec_id) <= greatest({K}, round({CODED_RESCORE} * n))),
coded AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
    count(*) OVER (PARTITION BY query_id) AS scored FROM cosine JOIN survivors USING (query_id, doc_id)),
found AS (SELECT coded.*, round(scored / n, 6) AS scored_share FROM coded, counted WHERE rank <= {K}),
hit AS (SELECT query_id, round(count(found.doc_id) / count(*), 6) AS recall FROM top LEFT JOIN found USING (query_id, doc_id) GROUP BY 1)"""

_STORED_HITS = f"""WITH stored AS {_STORED}, {hybrid_ctes().replace('FROM documents', 'FROM stored').replace(
        'CROSS JOIN documents x', 'CROSS JOIN stored x')}
SELECT query_id, rank::INTEGER AS rank, doc_id, rerank_score FROM hits"""

ORACLES = {
    "bm25_topk": f"WITH {_bm25(k=K)} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM bm",
    "bm25_terms": f"WITH {_bm25()} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "bm25_corpus": f"""WITH {_bm25()} SELECT (SELECT n FROM st)::BIGINT AS n_docs, (SELECT sum(dl) FROM dl)::BIGINT AS total_length,
  (SELECT count(*) FROM dfs) AS n_terms, (SELECT round(avgdl, 6) FROM st) AS avgdl, (SELECT round(a, 6) FROM avgidf) AS avg_idf""",
    "bm25_query_terms": f"WITH {_bm25()} SELECT query_id, term, qtf FROM qt",
    "cosine_topk": f"WITH {_cosine()} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM top",
    "cosine_topk_by_pivots": f"WITH {_cosine()} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM top",
    "cosine_topk_filtered": f"WITH {_cosine('d.label = 3')} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM top",
    "cosine_topk_post_filtered": f"""WITH {_cosine(k=3 * K)}, kept AS (SELECT query_id, doc_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place
  FROM top WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3) QUALIFY place <= {K})
SELECT query_id, doc_id, score, place::INTEGER AS rank FROM kept""",
    "unit_vectors": f"""WITH {_cosine()} SELECT vec_id AS doc_id, i::INTEGER AS dim, round(v[i + 1] / n, 6) + 0 AS value
  FROM u, range(64) t(i)""",
    "cosine_plane_cells": f"WITH {_cosine()}, {_PLANES} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM near",
    "coded_cells_topk": f"""WITH {_cosine()}, {_CODED}
SELECT query_id, rank::INTEGER AS rank, doc_id, score, scored_share, recall FROM found JOIN hit USING (query_id)""",
    "coded_cells_recall": "SELECT count(*) AS queries, true AS scored_within, true AS recall_reached FROM embeddings",
    "approximate_index_recall": "SELECT count(*) AS queries, true AS recall_reached FROM benchmark",
    "embedded_documents": f"""WITH {_hashed('d', 'documents', 'doc_id')}
SELECT doc_id, bucket::INTEGER AS bucket, round(v, 6) AS value FROM d_vec""",
    "semantic_topk": f"WITH {_semantic(k=K)} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM sem",
    "fused_topk": f"WITH {_bm25()}, {_semantic()}, {_FUSED} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM fused",
    "fused_equal_weights": f"""WITH {_cosine()},
other AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM cosine WHERE label = 3 QUALIFY rank <= {K}),
entries AS (SELECT query_id, doc_id, 0 AS list_id, rank FROM top UNION ALL SELECT query_id, doc_id, 1, rank FROM other),
merged AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(list_id * 100000 + rank) AS seen
  FROM entries GROUP BY ALL)
SELECT query_id, doc_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen)::INTEGER AS rank
FROM merged QUALIFY rank <= {K}""",
    "hybrid_topk": f"WITH {hybrid_ctes()} SELECT query_id, rank::INTEGER AS rank, doc_id, score, rerank_score FROM hits",
    "hybrid_topk_filtered": f"""WITH {hybrid_ctes("{d}.lang = 'en'")}
SELECT query_id, rank::INTEGER AS rank, doc_id, score, rerank_score FROM hits""",
    "stored_index_topk": _STORED_HITS,
    "merged_index_topk": _STORED_HITS,
    "retrieval_confidence": f"""WITH {hybrid_ctes()} {_CONFIDENCE}
SELECT b.item_id AS query_id, coalesce(n_docs, 0)::INTEGER AS n_docs, coalesce(best_score, 1.0) AS best_score,
  coalesce(mean_score, 1.0) AS mean_score,
  CASE WHEN n_docs IS NULL THEN 'none' WHEN best_score < 0.02 THEN 'none' WHEN best_score < 0.1 THEN 'low' ELSE 'high' END
  AS confidence FROM benchmark b LEFT JOIN s ON s.query_id = b.item_id""",
    "hit_scores": f"WITH {hybrid_ctes()} {_CONFIDENCE} SELECT query_id, best_score, mean_score, n_docs FROM s",
}
