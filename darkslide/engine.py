"""One object over a catalogue, its stored index and its registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from darkslide.operators import registry as folders
from darkslide.operators.catalog import Catalog, delete_below
from darkslide.operators.ingest import IMAGES, Built, build_index, index_of, searchable
from darkslide.plans import search as plans
from darkslide.plans.index import TABLES, Stored
from darkslide.plans.tree import folder_tree
from darkslide.sources.tables import written
from darkslide.state import SearchState

REGISTRY = (
    "id bigint, path string, display_name string, enabled boolean, recursive boolean, status string, "
    "image_count bigint, last_scanned_at double, error_message string"
)


@dataclass
class Context:
    """What a search shows: a page of results, how many there are in all, and the formats among them."""

    results: DataFrame
    total: int
    facets: DataFrame


class Engine:
    """Search and upkeep of a catalogue. Pictures in disabled folders are never found."""

    def __init__(self, spark: SparkSession, root: str, extractor: Callable[[str], dict[str, str]]) -> None:
        self.spark, self.extractor = spark, extractor
        self.catalog = Catalog(spark, root)
        self.queue: list[tuple[int, bool]] = []
        self._tree: tuple[str | None, DataFrame] | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, extractor: Callable[[str], dict[str, str]]) -> Engine:
        """Opens a catalogue and scans the folders that were waiting when it was closed."""
        engine = cls(spark, root, extractor)
        for row in folders.pending(engine.registry).collect():
            engine.enqueue(row["id"])
        engine.run_queue()
        return engine

    @property
    def images(self) -> DataFrame:
        found = self.catalog.read("images")
        return found if found is not None else self.spark.createDataFrame([], IMAGES)

    @property
    def index(self) -> DataFrame | Stored:
        """The stored index; the texts, to be scanned, of a catalogue that has none."""
        kept = [self.catalog.read(t) for t in TABLES]
        if all(t is not None for t in kept):
            return Stored(*kept)
        found = self.catalog.read("index")
        return found if found is not None else index_of(self.images)

    @property
    def registry(self) -> DataFrame:
        found = self.catalog.read("registry")
        return found if found is not None else self.spark.createDataFrame([], REGISTRY)

    @property
    def visible(self) -> DataFrame:
        """The pictures outside the disabled folders."""
        return folders.outside_disabled(self.images, self.registry)

    def search(self, query: str = "", **wanted) -> DataFrame:
        return plans.search(self.visible, self.index, plans.Request(query=query, **wanted))

    def count(self, query: str = "", **wanted) -> int:
        return plans.count(self.visible, self.index, plans.Request(query=query, **wanted)).first()["n"]

    def facets(self, query: str = "", **wanted) -> DataFrame:
        return plans.facets(self.visible, self.index, plans.Request(query=query, **wanted))

    def context(self, state: SearchState, limit: int | None = None) -> Context:
        """Results, total and formats for what was asked for."""
        wanted = {"ext": state.ext, "folder": state.folder}
        total = self.count(state.query, **wanted)
        state.found(total)
        results = self.search(state.query, sort=state.sort, limit=limit, offset=state.loaded if limit else 0, **wanted)
        return Context(results, total, self.facets(state.query, **wanted))

    def tree(self) -> DataFrame:
        """The tree of folders, kept until the pictures change."""
        version = self.catalog.current()[1].get("images")
        if self._tree is None or self._tree[0] != version:
            self._tree = (version, written(folder_tree(self.images).orderBy("path"), "tree"))
        return self._tree[1]

    def add_folder(self, path: str, display_name: str = "", recursive: bool = True) -> None:
        self.catalog.commit(registry=folders.add(self.registry, path, display_name, recursive))

    def enable(self, number: int, on: bool) -> None:
        self.catalog.commit(registry=folders.set_enabled(self.registry, number, on))

    def remove_folder(self, number: int) -> None:
        """Unregisters a folder and forgets the pictures below it."""
        row = folders.by_id(self.registry, number).first()
        if row is None:
            return
        images = written(delete_below(self.images, row["path"]), "kept")
        self.catalog.commit(registry=folders.remove(self.registry, number), **searchable(images))

    def enqueue(self, number: int, force: bool = False) -> None:
        """Puts a folder at the end of the queue, unless the same request waits already; a folder that isn't being scanned
        is marked as queued."""
        row = folders.by_id(self.registry, number).first()
        waiting = folders.next_in_queue(self.queue, (number, force))
        if row is not None and len(waiting) > len(self.queue) and row["status"] != "scanning":
            self.catalog.commit(registry=folders.update_status(self.registry, number, "queued"))
        self.queue = waiting

    def run_queue(self) -> list[Built]:
        """Scans what waits, first come first served; folders that were removed in the meantime are passed over."""
        out = []
        while self.queue:
            number, force = self.queue.pop(0)
            built = self.scan(number, force)
            if built is not None:
                out.append(built)
        return out

    def scan(self, number: int, force: bool = False, **options) -> Built | None:
        """Scans a registered folder now; None if there is no such folder. `options` are those of `build_index`."""
        row = folders.by_id(self.registry, number).first()
        if row is None:
            return None
        self.catalog.commit(registry=folders.update_status(self.registry, number, "scanning"))
        try:
            built = build_index(self.spark, self.catalog, [row["path"]], self.extractor, force, **options)
        except Exception as error:
            failed = folders.update_status(self.registry, number, "error", error_message=str(error)[:500])
            self.catalog.commit(registry=failed)
            raise
        done = folders.update_status(self.registry, number, "indexed", image_count=built.indexed)
        self.catalog.commit(registry=done)
        return built

    def reset(self) -> None:
        self.catalog.clear()
