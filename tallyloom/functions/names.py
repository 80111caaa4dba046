"""Identifiers parsed out of resource names and built for sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed session-id lengths: ids of at least 33 characters are cut at 100, shorter ones are
# padded with a digest and cut at 64.
SESSION_MIN, SESSION_MAX, SESSION_PADDED = 33, 100, 64

# Resource-path markers and their cost category, in the order they are tried.
RESOURCE_CATEGORIES = (
    ("training-job/", "sagemaker_training"),
    ("endpoint", "sagemaker_inference"),
    ("runtime/", "agentcore_runtime"),
)


def run_id_from_resource(resource: Column, prefixes: Sequence[str]) -> Column:
    """Run id inside a job or endpoint name, null when no prefix fits.

    Prefixes are tried in order. One trailing pool tag (letter and digits) goes, then one
    trailing number, and never the last remaining token.
    """
    name = F.regexp_extract(resource, r"([^/]*)$", 1)
    rest = F.coalesce(*[F.when(name.startswith(p), F.substr(name, F.lit(len(p) + 1))) for p in prefixes])
    rest = F.regexp_replace(rest, r"(?s)^(.*)-\p{L}[0-9]+$", "$1")
    rest = F.regexp_replace(rest, r"(?s)^(.*)-[0-9]+$", "$1")
    return F.when(rest != "", rest)


def resource_category(resource: Column) -> Column:
    out = F.lit("support")
    for marker, category in reversed(RESOURCE_CATEGORIES):
        out = F.when(F.contains(resource, F.lit(marker)), category).otherwise(out)
    return out


def session_id(run: Column, stage: Column, task: Column) -> Column:
    base = F.concat_ws("-", run, stage, task)
    padded = F.concat(base, F.lit("-"), F.sha2(base, 256))
    return F.when(F.length(base) >= SESSION_MIN, F.substring(base, 1, SESSION_MAX)).otherwise(
        F.substring(padded, 1, SESSION_PADDED)
    )
