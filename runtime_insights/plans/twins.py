"""Shared pieces of the DuckDB twins of the registered queries."""

from __future__ import annotations

RT_EVENTS = r"""
rt0 AS (
  SELECT event_id AS seq, ts, event_type AS kind, user_id, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
rt1 AS (
  SELECT seq, ts, k, value,
    'c' || (user_id % 10) AS container_name,
    'p' || ((user_id // 10) % 5) AS proc_name,
    CASE kind WHEN 'click' THEN 'process' WHEN 'signup' THEN 'PROC' WHEN 'purchase' THEN 'net'
              WHEN 'view' THEN 'file' ELSE 'custom' END AS rule,
    CASE kind WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'execve' ELSE 'clone' END
              WHEN 'signup' THEN 'prctl'
              WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'connect' ELSE 'shutdown' END
              WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'openat' ELSE 'close' END
              ELSE CASE k % 4 WHEN 0 THEN 'fork' WHEN 1 THEN 'bind' WHEN 2 THEN 'read'
                              ELSE 'mmap' END END AS evt_type,
    CASE WHEN value >= 100 THEN 'Critical' WHEN value >= 35 THEN 'Warning' ELSE 'Debug' END
      AS priority,
    'syscall' AS source,
    'run --a' || (k % 20) || ' -b' || (k % 3) AS cmdline,
    CASE WHEN kind = 'view' THEN 'file' WHEN kind = 'purchase' THEN 'ipv4'
         WHEN kind = 'error' THEN CASE WHEN k % 4 = 2 THEN 'file' ELSE 'ipv4' END
         ELSE '' END AS fd_type,
    CASE WHEN kind = 'purchase' THEN CASE WHEN k % 17 = 0 THEN '' WHEN k % 13 = 0 THEN '0.0.0.0:80'
              ELSE '10.0.0.1:5000->10.0.0.' || (k % 10) || ':443' END
         WHEN kind = 'view' OR (kind = 'error' AND k % 4 = 2)
              THEN '/d' || (k % 4) || '/f' || (k % 25) ELSE '' END AS fd_name,
    CASE WHEN kind = 'view' OR (kind = 'error' AND k % 4 = 2)
         THEN '/d' || (k % 4) ELSE '' END AS fd_directory
  FROM rt0),
rt AS (
  SELECT *, CASE
    WHEN lower(rule) IN ('process', 'proc') THEN 'process'
    WHEN lower(rule) IN ('network', 'net') THEN 'network'
    WHEN lower(rule) = 'file' THEN 'file'
    WHEN evt_type IN ('execve', 'clone', 'fork', 'vfork') THEN 'process'
    WHEN evt_type IN ('connect', 'accept', 'send', 'recv', 'sendto', 'recvfrom') THEN 'network'
    WHEN evt_type IN ('open', 'openat', 'close', 'read', 'write', 'unlink', 'unlinkat') THEN 'file'
    ELSE 'unknown' END AS category
  FROM rt1)"""

# Attribute lists of each known event, then one row per attribute.
PATHS = r"""
listed AS (
  SELECT *, CASE category
    WHEN 'process' THEN regexp_extract_all(cmdline, '-{1,2}[^\s-]+')
    WHEN 'network' THEN CASE WHEN fd_name = '' THEN []::VARCHAR[]
         WHEN fd_name LIKE '%->%' THEN [split_part(fd_name, '->', 2) || ':' || fd_type]
         ELSE ['::' || fd_type] END
    ELSE list_filter([fd_directory, fd_name], lambda x: x <> '') END AS attrs
  FROM rt WHERE category <> 'unknown'),
leaf_rows AS (
  SELECT container_name, seq, ts, category AS branch, evt_type, proc_name,
         unnest(attrs) AS attr, generate_subscripts(attrs, 1) - 1 AS pos
  FROM listed)"""

# First occurrences and the end of learning per container (gap and warm-up in ms).
CUT = r"""
first_op AS (
  SELECT container_name, category AS branch, evt_type, min((ts, seq)) AS f
  FROM listed GROUP BY ALL),
first_proc AS (
  SELECT container_name, category AS branch, evt_type, proc_name, min((ts, seq)) AS f
  FROM listed GROUP BY ALL),
first_leaf AS (
  SELECT container_name, branch, evt_type, proc_name, attr, min((ts, seq)) AS f,
         min((ts, seq, pos)) AS fp
  FROM leaf_rows GROUP BY ALL),
novel AS (
  SELECT DISTINCT container_name, f[2] AS seq FROM
   (SELECT container_name, f FROM first_op UNION ALL SELECT container_name, f FROM first_proc
    UNION ALL SELECT container_name, f FROM first_leaf)),
clocked AS (
  SELECT l.container_name, l.ts, l.seq, epoch_us(l.ts) // 1000 AS ms,
         NOT (l.category = 'network' AND l.fd_name = '') AS closes,
         min(epoch_us(l.ts) // 1000) OVER (PARTITION BY l.container_name) AS start_ms,
         max(CASE WHEN n.seq IS NOT NULL THEN epoch_us(l.ts) // 1000 END) OVER (
           PARTITION BY l.container_name ORDER BY l.ts, l.seq ROWS UNBOUNDED PRECEDING) AS last_ms
  FROM listed l LEFT JOIN novel n ON n.container_name = l.container_name AND n.seq = l.seq),
cut AS (
  SELECT container_name, min(ts) AS start_ts,
         min((ts, seq)) FILTER (closes AND ms - start_ms >= {warmup} AND ms - last_ms > {gap}) AS c
  FROM clocked GROUP BY container_name)"""


def with_tables(*parts: str, select: str, **values: object) -> str:
    text = "WITH " + ",".join(p.strip() for p in parts)
    for name, value in values.items():
        text = text.replace("{" + name + "}", str(value))
    return text + "\n" + select.strip()


LEARNED = r"""
learned AS (SELECT l.* FROM listed l JOIN cut USING (container_name)
  WHERE c IS NULL OR (l.ts, l.seq) <= c),
learned_leaves AS (SELECT r.* FROM leaf_rows r JOIN cut USING (container_name)
  WHERE c IS NULL OR (r.ts, r.seq) <= c)"""

NODES = r"""
leaf_nodes AS (
  SELECT container_name, branch, evt_type, proc_name, attr, count(*) AS events_count,
    CASE branch WHEN 'process' THEN 'cmd_argument' WHEN 'network' THEN 'network_attribute'
      ELSE CASE arg_min(pos, (ts, seq, pos)) WHEN 0 THEN 'directory_path' ELSE 'file_name' END END
      AS node_type,
    min((ts, seq, pos)) AS fp, min((ts, seq)) AS f, max(ts) AS last_updated
  FROM learned_leaves GROUP BY container_name, branch, evt_type, proc_name, attr),
proc_nodes AS (
  SELECT container_name, category AS branch, evt_type, proc_name, sum(len(attrs)) AS subtree_events,
    min((ts, seq)) AS f, max(ts) AS last_updated
  FROM learned GROUP BY ALL),
nodes AS (
  SELECT container_name, 4 AS level, branch, evt_type, proc_name, attr, node_type, events_count,
    events_count AS subtree_events, f, last_updated FROM leaf_nodes
  UNION ALL
  SELECT container_name, 3, branch, evt_type, proc_name, NULL, 'process_name', 0,
    subtree_events, f, last_updated FROM proc_nodes
  UNION ALL
  SELECT container_name, 2, branch, evt_type, NULL, NULL, branch || '_operation', 0,
    sum(subtree_events), min(f), max(last_updated) FROM proc_nodes
  GROUP BY container_name, branch, evt_type
  UNION ALL
  SELECT d.container_name, 1, b, NULL, NULL, NULL, 'branch', 0, coalesce(sum(subtree_events), 0),
    min(f), max(last_updated)
  FROM (SELECT DISTINCT container_name FROM proc_nodes) d
  CROSS JOIN (VALUES ('process'), ('network'), ('file')) v(b)
  LEFT JOIN proc_nodes p ON p.container_name = d.container_name AND p.branch = b
  GROUP BY d.container_name, b
  UNION ALL
  SELECT container_name, 0, NULL, NULL, NULL, NULL, 'root', 0, sum(subtree_events), min(f),
    max(last_updated) FROM proc_nodes GROUP BY container_name)"""

ALERTS = r"""
late_leaf AS (SELECT fl.* FROM first_leaf fl JOIN cut USING (container_name) WHERE fl.f > c),
leaf_hit AS (
  SELECT r.container_name, r.seq, min((r.pos, r.attr)) AS h
  FROM leaf_rows r JOIN late_leaf USING (container_name, branch, evt_type, proc_name, attr)
  GROUP BY ALL),
alerts AS (
  SELECT l.container_name, l.seq, l.ts, l.category AS branch, l.evt_type, l.proc_name, l.rule,
    l.priority, l.source,
    CAST(CASE WHEN o.f > c THEN 1 WHEN p.f > c THEN 2 ELSE 3 END AS INTEGER) AS level,
    CASE WHEN o.f > c THEN l.evt_type WHEN p.f > c THEN l.proc_name ELSE h[2] END AS missing_key,
    'detect' AS phase
  FROM listed l JOIN cut ON cut.container_name = l.container_name
  JOIN first_op o ON o.container_name = l.container_name AND o.branch = l.category
    AND o.evt_type = l.evt_type
  JOIN first_proc p ON p.container_name = l.container_name AND p.branch = l.category
    AND p.evt_type = l.evt_type AND p.proc_name = l.proc_name
  LEFT JOIN leaf_hit h ON h.container_name = l.container_name AND h.seq = l.seq
  WHERE o.f > c OR p.f > c OR h.h IS NOT NULL)"""
