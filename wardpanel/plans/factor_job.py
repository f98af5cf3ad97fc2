"""Batch computation of many panel factors."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from wardpanel.operators import panel as p
from wardpanel.sources.tables import cached_store, store_key


def factor_job(
    panel: DataFrame, factors: Mapping[str, Callable[[], p.Factor]], folder: str | None = None, panel_key: str = "", max_rows: int | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """(factor table, problems by name).

    All factors share one pass over the panel.  Factors that cannot be built are reported and skipped.  With a folder the
    table is stored under the hash of the factor expressions and read back the next time.
    """
    good, bad = p.drop_missing_factors(factors)
    if not good:
        raise ValueError(f"no factor could be built: {bad}")
    make = lambda: p.evaluate(panel, good, max_rows=max_rows)
    if folder is None:
        return make(), bad
    key = store_key(panel_key, [f"{n}={f.key}" for n, f in good.items()], "factors")
    write = lambda df, path: df.write.mode("overwrite").parquet(path)
    return cached_store(panel.sparkSession, folder, key, make, write), bad
