"""All registered queries of the library's own operators."""

from __future__ import annotations

import importlib
import pkgutil

from stridecast import plans
from stridecast.plans.registry import QUERIES, SQL

for _m in pkgutil.iter_modules(plans.__path__):
    if _m.name.endswith("_queries"):
        importlib.import_module(f"stridecast.plans.{_m.name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
