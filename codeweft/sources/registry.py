"""Named graphs of a session."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import PurePath
from threading import RLock

from ..model import Graph


@dataclass
class Entry:
    graph_id: str
    graph: Graph
    source: str
    loaded_at: datetime = field(default_factory=lambda: datetime.now(UTC))


class Registry:
    """The newest graph is the default; dropping the default leaves none. Ids don't differ by case alone."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}
        self._default: str | None = None
        self._lock = RLock()

    @staticmethod
    def id_of(source: str) -> str:
        stem = PurePath(source).stem
        return (stem[: -len(".graph")] if stem.lower().endswith(".graph") else stem) or "graph"

    def add(self, graph: Graph, source: str, graph_id: str | None = None) -> str:
        """Under the given id, replacing what it held; else under the file's name, with -2 and so on if another file has it."""
        with self._lock:
            name = base = graph_id or self.id_of(source)
            n = 1
            while graph_id is None and name.lower() in self._entries and self._entries[name.lower()].source != source:
                n += 1
                name = f"{base}-{n}"
            self._entries[name.lower()] = Entry(name, graph, source)
            self._default = name.lower()
            return name

    def require(self, graph_id: str | None = None) -> Graph:
        with self._lock:
            key = graph_id.lower() if graph_id else self._default
            if key is None or key not in self._entries:
                raise LookupError(f"no graph {graph_id or '(default)'}; loaded: {', '.join(e.graph_id for e in self._entries.values()) or 'none'}")
            return self._entries[key].graph

    def list(self) -> list[Entry]:
        with self._lock:
            return sorted(self._entries.values(), key=lambda e: e.graph_id.lower())

    def remove(self, graph_id: str) -> bool:
        with self._lock:
            gone = self._entries.pop(graph_id.lower(), None) is not None
            if gone and self._default == graph_id.lower():
                self._default = None
            return gone
