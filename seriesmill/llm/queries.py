"""The registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, cover_tree, decontaminate, language_id, language_model, license_scan, line_dedup, ngram_jaccard, packing, phrase_fingerprint, prefix_trie, quality, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int, value: int, column: str = "doc_id") -> Column:
    """crc32 of the id's digits, modulo ``modulus``, is ``value``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus == value


def tokenizer_path() -> str:
    """The public tokenizer that packing uses; installed with Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4, 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"), remainder(4, 2))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3, 1))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_texts(table(spark, sf_dir, "documents"), ~remainder(5, 1))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_toxicity, op2_language_id, op3_line_dedup, op4_cover_tree_topk, op5_decontamination, op6_ngram_jaccard, op7_quality, op8_license_scan, op9_lm_scoring, op10_packing, op11_phrase_collocations, op12_prefix_trie, op13_phrase_fingerprint)
    return {f.__name__: f for f in found}


_LINES = """
WITH line AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) - 1 AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), lines_ AS (
  SELECT *, doc_id * 1000000 + pos AS ord FROM line WHERE line <> ''
), t AS (
  SELECT line, length(line) AS n, min(ord) AS f0, count(*) AS times FROM lines_ GROUP BY line
), v AS (
  SELECT line, n, f0, unnest(range(1, n + 1)) AS i FROM t WHERE n >= 20
), k AS (
  SELECT *, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS h FROM v
), near AS (
  SELECT a.line, b.f0 FROM k a JOIN k b ON a.h = b.h AND a.i = b.i AND a.n = b.n AND a.line <> b.line
  UNION
  SELECT a.line, b.f0 FROM k a JOIN t b ON a.h = hash(b.line) AND a.n = b.n + 1
  UNION
  SELECT b.line, a.f0 FROM k a JOIN t b ON a.h = hash(b.line) AND a.n = b.n + 1
), owner AS (
  SELECT t.line, least(min(t.f0), coalesce(min(near.f0), min(t.f0))) AS owner FROM t LEFT JOIN near USING (line) GROUP BY t.line
), gone AS (
  SELECT lines_.doc_id, lines_.pos FROM lines_ JOIN owner USING (line) WHERE owner.owner < lines_.ord
)"""

OP3_SQL = (
    _LINES
    + """, kept AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY pos) AS kept
  FROM line LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)"""
)

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)"""


OP11_SQL = r"""
WITH low AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), piece AS (
  SELECT lang, unnest(string_split(regexp_replace(text, '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS piece FROM low
), w AS (
  SELECT lang, list_filter(string_split(regexp_replace(piece, '[\x20\x09]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM piece
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
gram AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, m
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS t(m))
), f AS (SELECT lang, p, m, count(*) AS f FROM gram GROUP BY lang, p, m HAVING count(*) >= 100),
cand AS (SELECT lang, p, m, f AS a, string_split(p, ' ') AS w FROM f WHERE m > 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS p, max(a) AS over
  FROM (SELECT lang, w, m, a, k, unnest(range(1, m - k + 2)) AS i FROM cand, (VALUES (2), (3), (4)) AS t(k) WHERE k < m)
  GROUP BY 1, 2
), kept AS (
  SELECT cand.* FROM cand LEFT JOIN inner_ USING (lang, p) WHERE over IS NULL OR 100 * over < 100 * a
), cut AS (
  SELECT kept.lang, kept.p, kept.w, kept.a, unnest(range(1, m)) AS k FROM kept
), scored AS (
  SELECT cut.lang, cut.p, cut.a, cut.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN total ON total.lang = cut.lang
  JOIN f x ON x.lang = cut.lang AND x.p = array_to_string(cut.w[1:k], ' ')
  JOIN f y ON y.lang = cut.lang AND y.p = array_to_string(cut.w[k + 1:], ' ')
), low_cut AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM low_cut QUALIFY rank <= 2000"""


OP12_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), bytes_ AS (
  SELECT c, list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS b, n FROM (SELECT c, count(*) AS n FROM own GROUP BY c)
), conv AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(b, lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 9 AS h
  FROM bytes_
), sized AS (SELECT conv.*, least(conv.h, coalesce(b.n, 0)) AS taken FROM conv LEFT JOIN conv b ON b.c = conv.base),
turns AS (
  SELECT s.c, own.i AS d, role, text FROM sized s JOIN own ON own.c = s.base AND own.i <= s.h
  UNION ALL
  SELECT s.c, own.i - s.h + s.taken, role, text FROM sized s JOIN own ON own.c = s.c AND own.i > s.h
), prefix AS (
  SELECT c, d, strlen(text) AS bytes, list(md5(role) || md5(text)) OVER (PARTITION BY c ORDER BY d) AS k FROM turns
  UNION ALL
  SELECT c, 0, 0, [] FROM conv
), last_ AS (SELECT c, max(d) AS d FROM prefix GROUP BY c),
node AS (
  SELECT md5(array_to_string(k, '')) AS k, md5(array_to_string(k[:prefix.d - 1], '')) AS p, prefix.d, min(prefix.c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN last_.d = prefix.d THEN prefix.c::VARCHAR END, ',' ORDER BY prefix.c), '')) AS ends_sha256
  FROM prefix JOIN last_ USING (c) GROUP BY 1, 2, 3
), child AS (SELECT p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON child.p = node.k AND child.d = node.d),
below AS (
  SELECT p.c, p.d, md5(array_to_string(p.k, '')) AS k,
    sum(CASE WHEN w.conv_id = p.c AND n_children = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p.c ORDER BY p.d DESC) AS leaves,
    sum(CASE WHEN w.conv_id = p.c THEN (n_convs - 1) * w.bytes ELSE 0 END) OVER (PARTITION BY p.c ORDER BY p.d DESC) AS saved
  FROM prefix p JOIN whole w ON w.d = p.d AND w.k = md5(array_to_string(p.k, ''))
), total AS (SELECT k, d, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY k, d)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN total ON total.k = w.k AND total.d = w.d LEFT JOIN whole up ON w.d > 0 AND up.k = w.p AND up.d = w.d - 1"""


def _op8_sql() -> str:
    gap = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(string_split(regexp_replace({low}, {gap}, ' ', 'g'), ' '), lambda x: x <> '')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({i}, {sorted(set(t.split()))!r}, '{label}', {len(t.split())})" for i, (t, label) in enumerate(license_scan.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
p(pw, label) AS (VALUES {phrases}),
place AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(pw) + 1), lambda i: w[i + 1] = pw[1] AND w[i + 1:i + len(pw)] = pw)) AS i FROM d, p
),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY doc_id),
t(id, tw, label, size) AS (VALUES {templates}),
tv AS (SELECT id, label, size, len(tw) AS n, unnest(tw) AS w FROM t),
v AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS w FROM d),
st AS (SELECT doc_id, pos, w, id, label, size, n FROM v JOIN tv USING (w)),
hit AS (
  SELECT s.doc_id, s.id, s.label, s.size, s.n, s.pos, count(DISTINCT x.w) / s.n::DOUBLE AS score
  FROM st s JOIN st x ON x.doc_id = s.doc_id AND x.id = s.id AND x.pos >= s.pos AND x.pos < s.pos + s.size
  GROUP BY s.doc_id, s.id, s.label, s.size, s.n, s.pos HAVING 100 * count(DISTINCT x.w) >= {license_scan.PERCENT} * s.n
),
kept AS (
  SELECT * FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM hit g WHERE g.doc_id = h.doc_id AND g.pos < h.pos + h.size AND h.pos < g.pos + g.size AND (g.score, g.n, -g.pos, g.label, g.size) > (h.score, h.n, -h.pos, h.label, h.size)
  )
),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score, count(*) AS n_blocks FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_cover_tree_topk": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_license_scan": _op8_sql(), "op11_phrase_collocations": OP11_SQL, "op12_prefix_trie": OP12_SQL}
