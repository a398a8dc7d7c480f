"""Structural kinds, their ranks and the fixed vocabularies of the analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine kinds in the order of their ranks, 0 to 8.
KINDS = ("ECOSYSTEM", "REPOSITORY", "NAMESPACE", "UNIT", "INFRA", "STRUCTURE", "BEHAVIOR", "ATOM", "DATA")
RANKS = {kind: rank for rank, kind in enumerate(KINDS)}

# Language kinds of each structural kind; any other is an ATOM.
LANGUAGE_KINDS = {
    "ECOSYSTEM": ("external_dependency",),
    "REPOSITORY": ("repository", "project", "repo"),
    "NAMESPACE": ("module", "package", "namespace"),
    "UNIT": ("file", "unit"),
    "STRUCTURE": ("class", "interface", "type", "struct", "enum", "generic", "heritage"),
    "BEHAVIOR": ("function", "method", "constructor"),
    "ATOM": ("variable", "property", "const", "field", "export"),
    "DATA": ("parameter", "argument", "literal"),
    "INFRA": ("route", "controller", "infra", "macro"),
}

# Edge types.
EDGE_TYPES = (
    "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "ACCESSES", "MEMBER_OF", "DEPENDS_ON", "FROM_IMAGE", "VIRTUAL_LINK",
    "CONSTRUCTS", "TYPE_REFERENCE", "CONTAINS", "HAS_METHOD", "HAS_PROPERTY", "PULSES_TO", "DEFINES", "ALIASES",
)

# Names and files that mark entry points.
ENTRY_NAMES = ("main", "app", "run", "start", "cli", "index", "handler", "server", "cmd", "entry")
ENTRY_FILES = ("main.py", "app.py", "index.ts", "server.ts", "cli.ts", "main.go", "main.rs")

# Endings of names that make a symbol infrastructure.
INFRA_SUFFIXES = ("Service", "Router", "Controller", "Registry", "Store", "Runner", "Manager", "Engine", "Writer", "Reporter", "Provider", "Client")

# Which nodes the ranking takes part in.
ANCHOR_KINDS = ("STRUCTURE", "FUNCTION", "BEHAVIOR", "INFRA")
ANCHOR_LABELS = ("module", "unit")


def canonical_kind(language_kind: Column) -> Column:
    """The structural kind of a language kind, ATOM if unknown, null if null."""
    low = F.lower(language_kind)
    out = F.when(language_kind.isNull(), F.lit(None).cast("string"))
    for kind, names in LANGUAGE_KINDS.items():
        out = out.when(low.isin(*names), F.lit(kind))
    return out.otherwise(F.lit("ATOM"))


def canonical_rank(kind: Column) -> Column:
    """0 to 8, null for other kinds; DIRECTORY ranks like NAMESPACE."""
    out = F.when(kind == "DIRECTORY", F.lit(RANKS["NAMESPACE"]))
    for name, rank in RANKS.items():
        out = out.when(kind == name, F.lit(rank))
    return out


def is_infra_name(name: Column) -> Column:
    return name.rlike(f"({'|'.join(INFRA_SUFFIXES)})$")


def edge_category(edge_type: Column) -> Column:
    return F.when(edge_type == "IMPORTS", "dependency").otherwise("structural")
