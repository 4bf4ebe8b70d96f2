"""Tenant scope: every read of a tenant's rows goes through :func:`scoped`, which fails closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("product_id", "tenant_id")


def scoped(df: DataFrame, product: str | None, tenant: str | None) -> DataFrame:
    """Rows of one product and tenant; no rows at all if either is missing."""
    if not product or not tenant:
        return df.where(F.lit(False))
    return df.where((F.col("product_id") == product) & (F.col("tenant_id") == tenant))
