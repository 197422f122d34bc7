"""Questions to a stored set of tables: what a scope needs is read, and nothing else.

The scope of references has a corpus of its own: no papers, sections, parents or constraints, and BM25 alone.  Any other
scope is the main one.  A set from before papers and sections is upgraded first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from folioscan.functions import vocabulary as V
from folioscan.plans import flow, ingest
from folioscan.plans.analysis import Settings
from folioscan.sources.tables import Snapshots


@dataclass(frozen=True)
class Resources:
    scope: str
    chunks: DataFrame
    papers: DataFrame
    sections: DataFrame | None
    parents: DataFrame | None
    constraints: bool
    mode: str | None


def scope_of(name: str | None) -> str:
    return "references" if (name or "").strip().lower() in V.REFERENCE_SCOPES else "main"


def load(snapshots: Snapshots, scope: str | None = None, settings: ingest.IngestSettings | None = None) -> Resources:
    """The current set's tables of a scope; a set that can't answer is an error that says what is missing."""
    name = scope_of(scope)
    if name == "main":
        ingest.upgrade(snapshots, settings)
    m = snapshots.manifest() or {"tables": {}}
    needed = ("references",) if name == "references" else ("chunks", "parents", "papers", "sections", "catalog")
    found = snapshots.load_of(m, [k for k in needed if k in m["tables"]])
    reasons = ingest.readiness(found, name)
    if reasons:
        raise ValueError(ingest.readiness_message(reasons, name))
    if name == "references":
        none = snapshots.spark.createDataFrame([], "doc_id string, summary string")
        return Resources(name, found["references"], none, None, None, False, "bm25")
    return Resources(name, found["chunks"], found["papers"], found["sections"], found["parents"], True, None)


def ask(queries: DataFrame, snapshots: Snapshots, scope: str | None = None, settings: Settings | None = None, current_year: int | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, **how) -> dict[str, DataFrame]:
    """`flow.ask` over the current set of a scope."""
    r = load(snapshots, scope)
    s = settings or Settings()
    s = replace(s, mode=r.mode) if r.mode else s
    own = None if r.mode == "bm25" else vectors
    return flow.ask(queries, r.chunks, r.papers, s, own, r.parents, r.sections, current_year if r.constraints else None, scope="references" if r.scope == "references" else None, **how)
