"""Schemas of the property graph. A node's key is (snapshot_id, id): a node exists once in every snapshot that has it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "STRINGS": T.ArrayType(T.StringType()), "PROPERTIES": T.MapType(T.StringType(), T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """``name TYPE, ...`` as a schema; unlike the library's parser this needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in spec.split(","))])


NODES = _struct("""
    id STRING, snapshot_id STRING, fingerprint STRING, canonical_kind STRING, canonical_rank INT, semantic_kind STRING,
    name STRING, file STRING, line_start INT, line_end INT, parent_id STRING, root_id STRING, namespace_id STRING,
    unit_id STRING, structure_id STRING, layer_path STRING, depth INT, risk DOUBLE, gravity DOUBLE, complexity INT,
    is_entry_point BOOLEAN, visibility STRING, is_exported BOOLEAN, is_async BOOLEAN, is_static BOOLEAN, returns STRING,
    tenure_days INT, churn INT, entropy DOUBLE, primary_author STRING, author_count INT, debt_markers STRINGS,
    is_test BOOLEAN, anomaly STRING, attrs PROPERTIES
""")

EDGES = _struct("""
    id STRING, snapshot_id STRING, source_id STRING, target_id STRING, category STRING, type STRING, weight DOUBLE,
    confidence DOUBLE, line INT, properties PROPERTIES
""")

SNAPSHOTS = _struct("id STRING, ts BIGINT, commit_hash STRING, node_count BIGINT, edge_count BIGINT, metadata STRING")
RULES = _struct("id STRING, type STRING, matchPath STRING, matchLabel STRING, target STRING, max INT")
COMMITS = _struct("hash STRING, path STRING, author STRING, ts TIMESTAMP")
BLAME = _struct("path STRING, line INT, author STRING, ts BIGINT")
FILES = _struct("path STRING, source STRING")

# Values that a write fills in where they are null.
NODE_DEFAULTS = {"name": "unknown", "canonical_kind": "STRUCTURE", "canonical_rank": 0, "line_start": 0, "line_end": 0, "depth": 0, "risk": 0.0, "gravity": 0.0, "complexity": 1, "is_entry_point": False, "visibility": "public"}
EDGE_DEFAULTS = {"weight": 1.0, "confidence": 1.0}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones null, others dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def normal_nodes(df: DataFrame) -> DataFrame:
    """Nodes as a write stores them: ids and pointers in lower case, defaults in place of nulls."""
    out = conform(df, NODES).fillna(NODE_DEFAULTS)
    low = ("id", "file", "parent_id", "root_id", "namespace_id", "unit_id", "structure_id", "semantic_kind")
    return out.withColumns({c: F.lower(c) for c in low})


def normal_edges(df: DataFrame) -> DataFrame:
    out = conform(df, EDGES).fillna(EDGE_DEFAULTS)
    out = out.withColumns({c: F.lower(c) for c in ("source_id", "target_id")})
    return out.withColumn("category", F.when(F.col("type") == "IMPORTS", "dependency").otherwise("structural"))
