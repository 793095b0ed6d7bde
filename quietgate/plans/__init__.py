"""Named queries over the driver tables, grouped by the job they belong to."""

from __future__ import annotations


def all_catalogs():
    from . import (
        corpus_queries,
        evaluation_queries,
        ingest_queries,
        policy_queries,
        report_queries,
        request_queries,
        scan_queries,
        store_queries,
        stream_queries,
    )

    modules = [
        scan_queries, request_queries, report_queries, policy_queries, ingest_queries,
        corpus_queries, evaluation_queries, store_queries, stream_queries,
    ]
    catalogs = [m.CATALOG for m in modules]
    names = [n for c in catalogs for n in c.queries]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"query registered twice: {', '.join(repeated)}")
    return catalogs
