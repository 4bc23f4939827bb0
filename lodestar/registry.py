"""All registered queries of the library and their SQL, merged from the families."""

from __future__ import annotations

from .fixtures import with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under `name`, with the SQL that gives the same rows."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(" ".join(sql.split()))
        return f

    return put


from .queries import billing, business, density, events, geo, governance, landcover, learning, networks, overlays, pipelines, rasters, relational, search, sources, spatial, stateful, streams, text_ml, vectortiles  # noqa: E402,F401
