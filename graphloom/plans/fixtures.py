"""Graphs projected from the driver's tables.

One SQL text per table, with the few functions that differ between dialects filled in, so that Spark and the oracle see
the same graph:

* activity: nodes (user, event type) in weekly snapshots, edges between a user's consecutive events of a week;
* containment: ecosystem > region > nation > customer > order > line, with parts and suppliers beside them;
* trade: nations, an edge from the supplier's to the customer's;
* commits: (hour, user, event type) of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"day": "datediff(CAST(ts AS DATE), DATE '2024-01-01')", "sha": "sha2(%s, 256)", "ms": "CAST(unix_timestamp(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) * 1000", "hour": "date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH')"}
DUCK = {"day": "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))", "sha": "sha256(%s)", "ms": "CAST(epoch_ms(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT)", "hour": "strftime(date_trunc('hour', ts), '%Y-%m-%d %H')"}

TEXT = {
    "ev": """
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, CAST(floor(%(day)s / 7) AS INT) AS week, %(day)s AS day,
    'user::' || user_id || '::' || event_type AS id, 'w' || CAST(floor(%(day)s / 7) AS INT) AS snapshot_id
  FROM @events""",
    "an": """
  SELECT id, snapshot_id,
    %(sha_fp)s AS fingerprint,
    CASE event_type WHEN 'purchase' THEN 'STRUCTURE' WHEN 'error' THEN 'INFRA' ELSE 'BEHAVIOR' END AS canonical_kind,
    CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 4 ELSE 6 END AS canonical_rank,
    CASE event_type WHEN 'purchase' THEN 'class' WHEN 'error' THEN 'infra' ELSE 'function' END AS semantic_kind,
    event_type || '_' || user_id AS name, 'user/' || user_id AS file,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 21 WHEN 'purchase' THEN 41 WHEN 'signup' THEN 61 ELSE 81 END AS line_start,
    CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 40 WHEN 'purchase' THEN 60 WHEN 'signup' THEN 80 ELSE 100 END AS line_end,
    'user::' || user_id AS parent_id, 'repository::activity' AS root_id, 'ns::' || (user_id %% 10) AS namespace_id,
    'user::' || user_id AS unit_id, 'user::' || user_id || '::purchase' AS structure_id,
    CAST(count(*) AS INT) AS complexity,
    round(CAST(sum(value) AS DOUBLE) / count(*) / 500.0e0, 9) AS risk,
    round(CAST(sum(value) AS DOUBLE) / 10000.0e0, 9) AS gravity,
    event_type = 'signup' AS is_entry_point, CASE WHEN event_type = 'error' THEN 'private' ELSE 'public' END AS visibility,
    event_type IN ('view', 'purchase') AS is_exported, event_type = 'click' AS is_async, event_type = 'error' AS is_static,
    CASE WHEN event_type = 'view' THEN 'void' END AS returns,
    CAST(7 * (max(week) + 1) - min(day) AS INT) AS tenure_days, CAST(count(DISTINCT ts) AS INT) AS churn,
    round(CAST(count(DISTINCT day) AS DOUBLE) / 7.0e0, 9) AS entropy, 'author' || (user_id %% 7) AS primary_author,
    CAST(count(DISTINCT day) AS INT) AS author_count, user_id %% 11 = 0 AS is_test
  FROM ev GROUP BY id, snapshot_id, user_id, event_type""",
    "ae": """
  SELECT type || '::' || source_id || '->' || target_id AS id, snapshot_id, source_id, target_id,
    CASE WHEN type = 'IMPORTS' THEN 'dependency' ELSE 'structural' END AS category, type,
    CAST(count(*) AS DOUBLE) AS weight, 1.0e0 / (1.0e0 + count(*)) AS confidence
  FROM (
    SELECT snapshot_id, id AS source_id, lead(id) OVER (PARTITION BY snapshot_id, user_id ORDER BY ts, event_id) AS target_id,
      CASE event_type WHEN 'click' THEN 'CALLS' WHEN 'view' THEN 'IMPORTS' WHEN 'purchase' THEN 'CONSTRUCTS' WHEN 'signup' THEN 'EXTENDS' ELSE 'ACCESSES' END AS type
    FROM ev
  ) AS steps WHERE target_id IS NOT NULL GROUP BY snapshot_id, source_id, target_id, type""",
    "asn": """
  SELECT snapshot_id AS id, %(ms)s + CAST(min(week) AS BIGINT) * 604800000 AS ts FROM ev GROUP BY snapshot_id""",
    "cn": """
  SELECT 'ecosystem::global' AS id, 'g1' AS snapshot_id, 'ECOSYSTEM' AS canonical_kind, 0 AS canonical_rank, 'ecosystem' AS semantic_kind, 'global' AS name, CAST(NULL AS STRING) AS file,
    CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS namespace_id, CAST(NULL AS STRING) AS unit_id, CAST(NULL AS STRING) AS structure_id, 0.0e0 AS risk, 0.0e0 AS gravity, 1 AS complexity, FALSE AS is_entry_point, 'public' AS visibility
  UNION ALL SELECT 'repository::' || r_regionkey, 'g1', 'REPOSITORY', 1, 'repository', r_name, NULL, 'ecosystem::global', NULL, NULL, NULL, 0.0e0, 0.0e0, 1, FALSE, 'public' FROM @region
  UNION ALL SELECT 'directory::' || n_nationkey, 'g1', 'NAMESPACE', 2, 'namespace', n_name, NULL, 'repository::' || n_regionkey, NULL, NULL, NULL, 0.0e0, 0.0e0, 1, FALSE, 'public' FROM @nation
  UNION ALL SELECT 'customer::' || c_custkey, 'g1', 'UNIT', 3, 'unit', c_name, 'customer/' || c_custkey, 'directory::' || c_nationkey, 'directory::' || c_nationkey, 'customer::' || c_custkey, NULL, round((c_acctbal + 1000.0e0) / 12000.0e0, 9), 0.0e0, 1, FALSE, 'public' FROM @customer
  UNION ALL SELECT 'order::' || o_orderkey, 'g1', 'STRUCTURE', 5, 'class', 'order_' || o_orderkey, 'customer/' || o_custkey, 'customer::' || o_custkey, 'directory::' || c_nationkey, 'customer::' || o_custkey, 'order::' || o_orderkey, round(o_totalprice / 600000.0e0, 9), round(o_totalprice / 1000000.0e0, 9), CAST(o_orderkey %% 30 AS INT) + 1, o_orderstatus = 'O', 'public' FROM @orders JOIN @customer ON o_custkey = c_custkey
  UNION ALL SELECT 'line::' || l_orderkey || '::' || l_linenumber || '::' || l_partkey || '::' || l_suppkey, 'g1', 'BEHAVIOR', 6, 'method', 'line_' || l_linenumber, 'customer/' || o_custkey, 'order::' || l_orderkey, 'directory::' || c_nationkey, 'customer::' || o_custkey, 'order::' || l_orderkey, round(l_discount * 5.0e0, 9), round(l_extendedprice / 1000000.0e0, 9), CAST(l_quantity AS INT), FALSE, CASE l_returnflag WHEN 'R' THEN 'private' WHEN 'A' THEN 'protected' ELSE 'public' END FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey
  UNION ALL SELECT 'part::' || p_partkey, 'g1', 'ATOM', 7, 'variable', p_name, NULL, NULL, NULL, NULL, NULL, round(p_retailprice / 3000.0e0, 9), 0.0e0, p_size, FALSE, 'public' FROM @part
  UNION ALL SELECT 'supplier::' || s_suppkey, 'g1', 'INFRA', 4, 'infra', s_name, NULL, 'directory::' || s_nationkey, 'directory::' || s_nationkey, NULL, NULL, round((s_acctbal + 1000.0e0) / 12000.0e0, 9), 0.0e0, 1, FALSE, 'public' FROM @supplier""",
    "ce": """
  SELECT 'm::' || id AS id, 'g1' AS snapshot_id, id AS source_id, parent_id AS target_id, 'MEMBER_OF' AS type, 1.0e0 AS weight FROM cn WHERE parent_id IS NOT NULL
  UNION ALL SELECT 'c::' || l_orderkey || '::' || l_linenumber || '::' || l_partkey || '::' || l_suppkey, 'g1', 'line::' || l_orderkey || '::' || l_linenumber || '::' || l_partkey || '::' || l_suppkey, 'part::' || l_partkey, 'CALLS', l_quantity FROM @lineitem
  UNION ALL SELECT 'd::' || l_orderkey || '::' || l_linenumber || '::' || l_partkey || '::' || l_suppkey, 'g1', 'line::' || l_orderkey || '::' || l_linenumber || '::' || l_partkey || '::' || l_suppkey, 'supplier::' || l_suppkey, 'DEPENDS_ON', 1.0e0 FROM @lineitem""",
    "te": """
  SELECT 't::' || s_nationkey || '->' || c_nationkey AS id, 'g3' AS snapshot_id, 'nation::' || s_nationkey AS source_id, 'nation::' || c_nationkey AS target_id, 'CALLS' AS type, CAST(count(*) AS DOUBLE) AS weight
  FROM @lineitem JOIN @supplier ON l_suppkey = s_suppkey JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey GROUP BY s_nationkey, c_nationkey""",
    "co": """
  SELECT %(hour)s AS hash, 'user/' || user_id AS path, event_type AS author, ts FROM @events""",
}

#: What each text reads, besides tables.
NEEDS = {"an": ("ev",), "ae": ("ev",), "asn": ("ev",), "ce": ("cn",)}


def _text(name: str, dialect: dict[str, str]) -> str:
    fill = dialect | {"sha_fp": dialect["sha"] % "'user/' || user_id || '|' || event_type || '|' || CAST(count(*) AS INT)"}
    return TEXT[name] % fill


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the texts as a DataFrame; only the tables that it reads are opened."""
    text, inner = _text(name, SPARK), []
    for need in NEEDS.get(name, ()):
        inner.append(f"{need} AS ({_text(need, SPARK)})")
    text = f"WITH {', '.join(inner)} {text}" if inner else text
    import re

    tables = dict.fromkeys(re.findall(r"@(\w+)", text))
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def prefix(*names: str) -> str:
    """The same as leading common table expressions of a DuckDB statement."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*NEEDS.get(n, ()), n) if x not in wanted]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({_text(n, DUCK).replace('@', '').replace('CAST(NULL AS STRING)', 'CAST(NULL AS VARCHAR)')})" for n in wanted)
