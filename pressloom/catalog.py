"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from pressloom.plans import audits as _audits  # noqa: F401  (registers its queries)
from pressloom.plans import collection as _collection  # noqa: F401  (registers its queries)
from pressloom.plans import integrity as _integrity  # noqa: F401  (registers its queries)
from pressloom.plans import markup as _markup  # noqa: F401  (registers its queries)
from pressloom.plans import queries as _news
from pressloom.plans import serving as _serving  # noqa: F401  (registers its queries)
from pressloom.plans import storage as _storage  # noqa: F401  (registers its queries)


def queries() -> dict:
    return dict(_news.QUERIES)


def oracle_sql() -> dict:
    return dict(_news.ORACLES)
