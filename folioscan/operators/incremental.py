"""Keyed maintenance of a set of tables: upsert, delete, referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids(*tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct non-blank keys of the tables."""
    out = None
    for t in tables:
        k = t.select(F.trim(F.col(key).cast("string")).alias(key))
        out = k if out is None else out.unionByName(k)
    return out.where(f"{key} <> ''").distinct()


def new_ids(incoming: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    return ids(incoming, key=key).join(ids(existing, key=key), key, "left_anti")


def keep_ids(table: DataFrame, chosen: DataFrame, keep: bool = True, key: str = "doc_id") -> DataFrame:
    """Rows whose key (as trimmed text) is chosen, or is not."""
    names = ids(chosen, key=key).withColumnRenamed(key, "__chosen")
    return table.join(names, F.trim(F.col(key).cast("string")) == F.col("__chosen"), "left_semi" if keep else "left_anti")


def upsert(existing: dict[str, DataFrame], incoming: dict[str, DataFrame], force: bool = False, key: str = "doc_id") -> dict[str, DataFrame]:
    """Tables with the incoming rows of active keys in place of the existing ones.

    Active keys are the incoming ones that no existing table has, or all incoming ones with `force`.
    """
    arriving = ids(*incoming.values(), key=key)
    active = arriving if force else arriving.join(ids(*existing.values(), key=key), key, "left_anti")
    return {name: keep_ids(existing[name], active, False, key).unionByName(keep_ids(incoming[name], active, True, key)) if name in incoming else existing[name] for name in existing}


def delete(tables: dict[str, DataFrame], requested: DataFrame, key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the requested keys, the requested keys that any table had)."""
    wanted = ids(requested, key=key)
    known = wanted.join(ids(*tables.values(), key=key), key, "left_semi")
    return {name: keep_ids(t, wanted, False, key) for name, t in tables.items()}, known


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent; empty in a consistent set of tables."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n), for manifests."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out
