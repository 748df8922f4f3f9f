"""Embedding similarity: on the given vectors, and on the keys of the profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.functions.embed import HASH_BASE, HASH_MODULUS, NgramEmbedder, normalized
from runtime_insights.operators import semantic as M
from runtime_insights.plans.base import register
from runtime_insights.plans.profile_queries import LEARNING
from runtime_insights.plans.runtime_events import runtime_events, table
from runtime_insights.plans.twins import CUT, PATHS, RT_EVENTS, with_tables

# The given vectors are far apart; at 0.40 some have neighbours with the same label.
THRESHOLD = 0.40

_PAIRS = f"""
WITH pairs AS (
  SELECT a.vec_id AS q, b.vec_id AS c FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD})"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("block"), F.col("vec_id").cast("string").alias("key"),
        F.col("vec_id").alias("turn"), F.col("embedding").alias("vector"),
    )


@register("semantic_match", _PAIRS + """
SELECT vec_id, EXISTS (SELECT 1 FROM pairs WHERE q = vec_id) AS matched FROM embeddings""")
def semantic_match(spark, folder):
    """Has any other vector of the same label a cosine at or over the threshold?"""
    rows = _vectors(spark, folder)
    found = M.any_match(rows.drop("turn"), rows, THRESHOLD, skip_same=True)
    return found.select(F.col("key").cast("bigint").alias("vec_id"), "matched")


@register("semantic_key", _PAIRS + """
SELECT vec_id, coalesce((SELECT min(c) FROM pairs WHERE q = vec_id), vec_id) AS match
FROM embeddings""")
def semantic_key(spark, folder):
    rows = _vectors(spark, folder)
    found = M.match_key(rows.drop("turn"), rows, THRESHOLD, skip_same=True)
    return found.select(
        F.col("key").cast("bigint").alias("vec_id"), F.col("match").cast("bigint").alias("match")
    )


@register("semantic_semi", _PAIRS + """
SELECT DISTINCT q AS vec_id FROM pairs""")
def semantic_semi(spark, folder):
    rows = _vectors(spark, folder)
    found = M.semi_match(rows.drop("turn"), rows, THRESHOLD, skip_same=True)
    return found.select(F.col("key").cast("bigint").alias("vec_id"))


@register("semantic_leaders", f"""
WITH RECURSIVE near AS (
  SELECT a.vec_id AS q, list(b.vec_id) AS cs FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id > b.vec_id
  WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD}
  GROUP BY a.vec_id),
ranked AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r,
    coalesce(cs, []) AS cs
  FROM embeddings LEFT JOIN near ON q = vec_id),
walk AS (
  SELECT label, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ls,
    CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS leader
  FROM (SELECT DISTINCT label FROM embeddings)
  UNION ALL
  SELECT label, r, CASE WHEN hit IS NULL THEN list_append(ls, vec_id) ELSE ls END, vec_id,
    coalesce(hit, vec_id)
  FROM (SELECT w.label, k.r, w.ls, k.vec_id,
          list_filter(w.ls, lambda x: list_contains(k.cs, x))[1] AS hit
        FROM walk w JOIN ranked k ON k.label = w.label AND k.r = w.r + 1))
SELECT vec_id, leader FROM walk WHERE r > 0""")
def semantic_leaders(spark, folder):
    """Greedy clusters of the vectors of each label in order of their id."""
    rows = _vectors(spark, folder)
    found = M.leaders(rows, THRESHOLD)
    return found.select(
        F.col("key").cast("bigint").alias("vec_id"), F.col("leader").cast("bigint").alias("leader")
    )


@register("normalize_vectors", """
SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS length, round(u[1], 6) AS first
FROM (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9))
        AS u
      FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS v
            FROM embeddings))""")
def normalize_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3 + 1)
    unit = rows.select("vec_id", normalized(scaled).alias("u"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return unit.select(
        "vec_id", F.round(length, 6).alias("length"), F.round(F.col("u")[0], 6).alias("first")
    )


# ------------------------------------------------- profiles and detection by similarity

EMBEDDER = NgramEmbedder()


def _gram_places(n: int) -> str:
    """The n-grams of ``codes`` as places in the vector."""
    value = str(n)
    for i in range(n):
        value = f"({value} * {HASH_BASE} + codes[i + {i}]) % {HASH_MODULUS}"
    return f"list_transform(range(1, len(codes) - {n - 2}), lambda i: {value} % {EMBEDDER.size})"


_SIMILAR = f"""
texts AS (
  SELECT DISTINCT unnest([evt_type, proc_name] || attrs) AS t FROM listed),
coded AS (
  SELECT t, list_transform(range(0, length(t) + 2), lambda i: unicode(substr(' ' || t || ' ', i::INTEGER + 1, 1)))::BIGINT[]
    AS codes FROM texts WHERE trim(t) <> ''),
placed AS (SELECT t, {" || ".join(_gram_places(n) for n in EMBEDDER.lengths)} AS places FROM coded),
counted AS (
  SELECT t, list_transform(range(0, {EMBEDDER.size}), lambda b: len(list_filter(places, lambda x: x = b))::DOUBLE) AS v
  FROM placed),
embedded AS (
  SELECT t, list_transform(v, lambda x: (x / greatest(sqrt(list_dot_product(v, v)), 1e-9))::FLOAT)::DOUBLE[] AS v
  FROM counted),
near AS (
  SELECT a.t AS key, list(b.t) AS alike FROM embedded a JOIN embedded b
    ON a.t <> b.t AND list_dot_product(a.v, b.v) >= {S.SIMILARITY_THRESHOLD} GROUP BY a.t)"""


def _walk(number: int, parent: str) -> str:
    """Leaders of the keys of each parent, taken in the order of their first occurrence."""
    return f"""
ranked{number} AS (
  SELECT k.*, row_number() OVER (PARTITION BY {parent} ORDER BY turn) AS r, coalesce(alike, []) AS alike
  FROM keys{number} k LEFT JOIN near USING (key)),
walk{number} AS (
  SELECT {parent}, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS leaders, CAST(NULL AS VARCHAR) AS key,
    CAST(NULL AS VARCHAR) AS leader
  FROM (SELECT DISTINCT {parent} FROM keys{number})
  UNION ALL
  SELECT {parent}, r, CASE WHEN hit IS NULL THEN list_append(leaders, key) ELSE leaders END, key, coalesce(hit, key)
  FROM (SELECT k.*, w.leaders, list_filter(w.leaders, lambda x: list_contains(k.alike, x))[1] AS hit
        FROM walk{number} w JOIN ranked{number} k USING ({parent}) WHERE k.r = w.r + 1)),
rep{number} AS (
  SELECT {parent}, key, leader, turn FROM walk{number} JOIN keys{number} USING ({parent}, key))"""


def _match(number: int, parent: str, asked: str) -> str:
    """What each key that occurs stands for after learning; no row where nothing is known."""
    return f"""
late{number} AS ({asked}),
known{number} AS (
  SELECT k.* FROM rep{number} k JOIN cut USING (container_name)
  WHERE c IS NOT NULL AND (turn[1], turn[2]) <= (c[1], c[2])),
match{number} AS (
  SELECT {parent}, key, leader AS match FROM late{number} JOIN known{number} USING ({parent}, key)
  UNION ALL
  SELECT {parent}, l.key, arg_min(k.key, k.turn)
  FROM (SELECT * FROM late{number} ANTI JOIN known{number} USING ({parent}, key)) l JOIN near USING (key)
  JOIN (SELECT * FROM known{number} WHERE key = leader) k USING ({parent})
  WHERE list_contains(alike, k.key) GROUP BY {parent}, l.key)"""


_P1 = "container_name, branch"
_P2 = _P1 + ", operation"
_P3 = _P2 + ", process"

_LEADERS = f"""
keys1 AS (
  SELECT container_name, category AS branch, evt_type AS key, min((ts, seq)) AS turn FROM listed GROUP BY ALL),
{_walk(1, _P1).strip()},
listed2 AS (
  SELECT l.*, l.category AS branch, leader AS operation FROM listed l JOIN rep1 k
    ON k.container_name = l.container_name AND k.branch = l.category AND k.key = l.evt_type),
keys2 AS (SELECT {_P2}, proc_name AS key, min((ts, seq)) AS turn FROM listed2 GROUP BY ALL),
{_walk(2, _P2).strip()},
listed3 AS (
  SELECT l.*, leader AS process FROM listed2 l JOIN rep2 k
    ON k.container_name = l.container_name AND k.branch = l.branch AND k.operation = l.operation
    AND k.key = l.proc_name),
leaves3 AS (
  SELECT {_P3}, seq, ts, unnest(attrs) AS key, generate_subscripts(attrs, 1) - 1 AS pos FROM listed3),
keys3 AS (SELECT {_P3}, key, min((ts, seq, pos)) AS turn FROM leaves3 GROUP BY ALL),
{_walk(3, _P3).strip()},
mapped AS (SELECT l.*, leader AS leaf FROM leaves3 l JOIN rep3 USING ({_P3}, key)),
first_keys AS (
  SELECT container_name, min((ts, seq)) AS f FROM listed3 GROUP BY {_P2}
  UNION ALL SELECT container_name, min((ts, seq)) FROM listed3 GROUP BY {_P3}
  UNION ALL SELECT container_name, min((ts, seq)) FROM mapped GROUP BY {_P3}, leaf),
novel AS (SELECT DISTINCT container_name, f[2] AS seq FROM first_keys)"""

# The moment itself is the same as without similarity, from these first occurrences.
_CUT = CUT[CUT.index("clocked AS"):]

_MATCHED = f"""
{_match(1, _P1, "SELECT container_name, branch, key FROM keys1").strip()},
events2 AS (
  SELECT l.container_name, l.seq, l.ts, l.category AS branch, l.evt_type, l.proc_name, l.attrs, l.rule,
    l.priority, l.source, match AS operation
  FROM listed l JOIN cut ON cut.container_name = l.container_name AND (l.ts, l.seq) > c
  LEFT JOIN match1 m ON m.container_name = l.container_name AND m.branch = l.category AND m.key = l.evt_type),
{_match(2, _P2, f"SELECT DISTINCT {_P2}, proc_name AS key FROM events2 WHERE operation IS NOT NULL").strip()},
events3 AS (
  SELECT e.*, match AS process FROM events2 e LEFT JOIN match2 m
    ON m.container_name = e.container_name AND m.branch = e.branch AND m.operation = e.operation AND m.key = e.proc_name),
leaves AS (
  SELECT {_P3}, seq, unnest(attrs) AS key, generate_subscripts(attrs, 1) - 1 AS pos FROM events3 WHERE process IS NOT NULL),
{_match(3, _P3, f"SELECT DISTINCT {_P3}, key FROM leaves").strip()},
missed AS (
  SELECT container_name, seq, min((pos, key)) AS h FROM leaves ANTI JOIN match3 USING ({_P3}, key)
  GROUP BY container_name, seq)"""


def _semantic_twin(*parts: str, select: str) -> str:
    return with_tables(
        "RECURSIVE " + RT_EVENTS.strip(), PATHS, _SIMILAR, _LEADERS, _CUT, *parts, select=select,
        gap=LEARNING.quiet_gap_ms, warmup=LEARNING.warmup_ms,
    )


@register("detect_semantic", _semantic_twin(_MATCHED, select="""
SELECT e.container_name, e.seq, e.ts, e.branch, e.evt_type, e.proc_name, e.rule, e.priority, e.source,
  CAST(CASE WHEN operation IS NULL THEN 1 WHEN process IS NULL THEN 2 ELSE 3 END AS INTEGER) AS level,
  CASE WHEN operation IS NULL THEN e.evt_type WHEN process IS NULL THEN e.proc_name ELSE h[2] END AS missing_key,
  'detect' AS phase
FROM events3 e LEFT JOIN missed USING (container_name, seq)
WHERE operation IS NULL OR process IS NULL OR h IS NOT NULL"""))
def detect_semantic(spark, folder):
    return M.detect_semantic(runtime_events(spark, folder), EMBEDDER, LEARNING)


@register("semantic_leaf_counts", _semantic_twin(select="""
SELECT m.container_name, branch, operation AS evt_type, process AS proc_name, leaf AS attr, count(*) AS events_count
FROM mapped m JOIN cut ON cut.container_name = m.container_name AND (c IS NULL OR (m.ts, m.seq) <= c) GROUP BY ALL"""))
def semantic_leaf_counts(spark, folder):
    profile = M.SemanticProfile(runtime_events(spark, folder), EMBEDDER, LEARNING)
    return profile.leaf_counts()
