"""Changes of a set of tables and of an outside index together, which a crash can't leave half done.

A journal says how far a change has come: its tables are staged, then the outside index is written, then the tables are
made current.  Whoever finds a journal finishes the change from there.  An outside index is told by a callback on the driver
(`remote`, for small changes that come with their ids), or by the executors through the feed of changed rows (`writer`).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from folioscan.sources import feed
from folioscan.sources.tables import Snapshots

NAME = "sync.json"
#: What an outside index is told: the operation, the tables of the change, and the ids to replace or delete.
Remote = Callable[[str, dict[str, DataFrame], list[str]], None]


class Journal:
    def __init__(self, snapshots: Snapshots):
        self.snapshots, self.files = snapshots, snapshots.files

    def pending(self) -> bool:
        return NAME in self.files.names()

    def load(self) -> dict | None:
        """The open change; one that can't be read counts as of unknown status, and holds nothing that could be finished."""
        return (self.files.read(NAME) or {"status": "unknown"}) if self.pending() else None

    def save(self, entry: dict) -> None:
        self.files.delete(NAME)
        self.files.write(NAME, entry)

    def clear(self) -> None:
        self.files.delete(NAME)

    def execute(self, operation: str, tables: dict[str, DataFrame], ids: list[str], remote: Remote | None = None, writer: feed.Writer | None = None, keys: dict[str, str] | None = None, **facts) -> str:
        """Stage `tables` as the new set, tell the outside index, make them current.

        `ids` is a batch's list of documents for `remote`.  With `writer`, changes of the tables in `keys` (with their key
        columns) are found against the current set, stored, and told part by part.
        """
        if operation not in ("upsert", "delete"):
            raise ValueError(f"no such operation: {operation}")
        entry = {"operation": operation, "status": "remote_pending", "ids": ids, "staged": self.snapshots.stage(tables), "facts": facts, "created_at": datetime.now(UTC).isoformat()}
        if writer is not None:
            changed = feed.dealt(feed.changes(self.snapshots.load(), self.snapshots.staged(entry["staged"]), keys or {}))
            entry["feed"] = self.snapshots.stage({"feed": changed}, by={"feed": "part"})
        self.save(entry)
        self._tell(entry, remote, writer)
        self.save(entry | {"status": "local_pending"})
        return self._finish(entry)

    def recover(self, remote: Remote | None = None, writer: feed.Writer | None = None) -> str | None:
        """Finish an interrupted change; its status, or None where there is none."""
        entry = self.load()
        if entry is None:
            return None
        status = str(entry.get("status") or "unknown").strip().lower()
        if "staged" in entry:
            if status != "local_pending":
                self._tell(entry, remote, writer)
            self._finish(entry)
        else:
            self.clear()
        return status

    def _tell(self, entry: dict, remote: Remote | None, writer: feed.Writer | None) -> None:
        if "feed" in entry:
            if writer is None:
                raise ValueError("a change whose feed is open needs its writer")
            feed.tell(self.snapshots.staged(entry["feed"])["feed"], writer, f"{self.snapshots.folder}/{entry['feed']['snapshot']}/told")
        if remote is not None:
            remote(entry["operation"], self.snapshots.staged(entry["staged"]), [str(x) for x in entry["ids"] if str(x).strip()])

    def _finish(self, entry: dict) -> str:
        name = self.snapshots.publish(entry["staged"], **entry["facts"])
        self.clear()
        if "feed" in entry:
            self.files.delete(entry["feed"]["snapshot"])
        return name
