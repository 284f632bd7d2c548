"""Every query of the engine's own operators with its DuckDB SQL."""

from __future__ import annotations

from . import annotation_queries, graph_queries, interval_queries, model_file_queries, report_queries, score_queries, sequence_queries, signal_queries, source_queries, splice_graph_queries, training_queries, transcript_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
