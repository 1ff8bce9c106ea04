"""SQL for DuckDB that states, independently of the Spark code, what each query must return."""

from . import quality, metrics, kpi, customers, insight


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for part in (metrics, kpi, quality, customers, insight):
        merged.update(part.SQL)
    return merged
