"""SQL twins of the newer operators, run by DuckDB over the same tables."""

from __future__ import annotations


def crc32_of(c: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    x = f"CASE WHEN k % 8 = 0 THEN xor(acc, ascii(substr({c}, k // 8 + 1, 1))) ELSE acc END"
    step = f"CASE WHEN ({x}) % 2 = 1 THEN xor(({x}) >> 1, 3988292384) ELSE ({x}) >> 1 END"
    return f"xor(list_reduce(range(0, 8 * length({c})), lambda acc, k: {step}, 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    fields = (f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


# Trees level by level, then every leaf folded up along its siblings.
MANIFEST = f"""
WITH RECURSIVE given AS (
  SELECT *, row_number() OVER () AS id, CASE WHEN {crc32_of('CAST(doc_id AS VARCHAR)')} % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now_text
  FROM documents
), leaves AS (
  SELECT id, doc_id, coalesce('1' || source, '0') AS tree, {_leaf('text')} AS leaf, {_leaf('now_text')} AS now FROM given
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), nodes(level, tree, idx, h) AS (
  SELECT 0, tree, idx, leaf FROM placed
  UNION ALL
  SELECT level + 1, tree, idx // 16, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY level, tree, idx // 16
), runs AS (
  SELECT level, tree, idx // 16 AS run, list(h ORDER BY idx) AS members
  FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM nodes) WHERE n > 1 GROUP BY level, tree, idx // 16
), folds(level, id, tree, idx, now, others) AS (
  SELECT 0, id, tree, idx, now, '' FROM placed
  UNION ALL
  SELECT f.level + 1, id, f.tree, idx // 16,
    sha256(array_to_string(members[:idx % 16], '') || now || array_to_string(members[idx % 16 + 2:], '')),
    others || array_to_string(members[:idx % 16], '') || array_to_string(members[idx % 16 + 2:], '')
  FROM folds f JOIN runs r ON r.level = f.level AND r.tree = f.tree AND r.run = f.idx // 16
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx
  FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1)
), tops(level, idx, h) AS (
  SELECT 0, idx, subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, idx // 16
), top_runs AS (
  SELECT level, idx // 16 AS run, list(h ORDER BY idx) AS members
  FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM tops) WHERE n > 1 GROUP BY level, idx // 16
), folded(level, id, subroot, idx, now, others) AS (
  SELECT 0, id, subroot, s.idx, now, others
  FROM (SELECT * FROM folds QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1) JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.level + 1, id, subroot, idx // 16,
    sha256(array_to_string(members[:idx % 16], '') || now || array_to_string(members[idx % 16 + 2:], '')),
    others || array_to_string(members[:idx % 16], '') || array_to_string(members[idx % 16 + 2:], '')
  FROM folded f JOIN top_runs r ON r.level = f.level AND r.run = f.idx // 16
), root AS (SELECT h AS root FROM tops ORDER BY level DESC LIMIT 1)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, f.now AS folded_root, f.now = root AS verified
FROM (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1) f JOIN leaves USING (id), root
"""

# Every term of every item against all documents, in 64-bit integers.
RANKED = """
WITH terms AS (
  SELECT doc_id, n_row, unnest(words) AS term, len(words) AS n
  FROM (SELECT doc_id, row_number() OVER () AS n_row, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents)
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), totals AS (SELECT count(DISTINCT n_row) AS docs, count(*) AS length FROM terms),
postings AS (SELECT n_row, doc_id, term, n, count(*) AS tf FROM terms GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scored AS (
  SELECT item_id, n_row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

_WORD = "[^\\x20\\x09-\\x0D]+"

# Every window of 20 words, the first occurrence of each sequence, and the words that later ones cover.
SUBSTRINGS = f"""
WITH texts AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
spots AS (SELECT n, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
spans AS (SELECT n, i, word, size, md5(string_agg(word, ' ') OVER (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS span FROM spots),
judged AS (SELECT n, i, word, i + 19 <= size AND row_number() OVER (PARTITION BY span, i + 19 <= size ORDER BY n, i) > 1 AS again FROM spans),
marked AS (SELECT n, i, word, bool_or(again) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
counted AS (SELECT n, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counted USING (n)
"""

# Sets of shingles, all pairs that share one, and components by walking links.
JACCARD = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 2], ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) AS i FROM texts)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)
), reached(doc_id, other) AS (SELECT u, v FROM links UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other),
least_of AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

# All pairs of a label by cosine in double precision; every link found is an audited recall of 1.
NEAR_VECTORS = """
WITH RECURSIVE given AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), fit AS (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM given
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reached(vec_id, other) AS (SELECT u, v FROM links UNION SELECT r.vec_id, l.v FROM reached r JOIN links l ON l.u = r.other),
least_of AS (SELECT vec_id, min(other) AS other FROM reached GROUP BY 1),
degrees AS (SELECT u AS vec_id, count(DISTINCT v) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
  least(vec_id, coalesce(other, vec_id)) = vec_id AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings LEFT JOIN degrees USING (vec_id) LEFT JOIN least_of USING (vec_id)
"""
