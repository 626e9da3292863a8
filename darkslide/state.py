"""What a user has asked for: the query, format, folder and order of a search, and how far its results are loaded."""

from __future__ import annotations

from dataclasses import dataclass

from darkslide.plans.search import DEFAULT_ORDER, ORDERS

PAGE = 10


@dataclass
class SearchState:
    """Each setter tells whether it changed anything: a search is only run again if it did."""

    query: str = ""
    ext: str = ""
    folder: str = ""
    sort: str = ""
    selected: int = 0
    loaded: int = 0
    total: int = 0

    def _set(self, **new: str) -> bool:
        changed = {k: v for k, v in new.items() if getattr(self, k) != v}
        for k, v in changed.items():
            setattr(self, k, v)
        if changed:
            self.loaded = 0
        return bool(changed)

    def set_query(self, query: str) -> bool:
        return self._set(query=query.strip())

    def set_ext(self, ext: str) -> bool:
        return self._set(ext=ext.lower().lstrip("."))

    def set_sort(self, name: str) -> bool:
        return self._set(sort=name if name in ORDERS else DEFAULT_ORDER)

    def browse(self, folder: str) -> bool:
        """Shows a folder without any query; the folder that is shown already is left again."""
        return self._set(query="", folder="" if folder == self.folder else folder)

    def found(self, total: int) -> int:
        """Takes up the number of results and gives the selection: what was selected if it still exists, else the first."""
        self.total = total
        self.selected = self.selected if self.selected < total else 0
        return self.selected

    def next_page(self, size: int = PAGE) -> tuple[int, int] | None:
        """(offset, limit) of the next page, or None once everything is loaded."""
        return None if self.loaded >= self.total else (self.loaded, min(size, self.total - self.loaded))

    def took(self, rows: int) -> None:
        self.loaded += rows
