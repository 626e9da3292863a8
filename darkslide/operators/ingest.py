"""Building the catalogue incrementally: scan, compare, extract what changed, merge, delete what is gone."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.entries import tag_map
from darkslide.functions.text import metadata_text
from darkslide.operators import export
from darkslide.operators.catalog import Catalog, changes, delete_missing, force_wipe, last_by_path, upsert
from darkslide.plans import index as inverted
from darkslide.sources.scan import extract, scan_folders
from darkslide.sources.tables import written

IMAGES = "id bigint, path string, filename string, mtime double, size bigint, metadata_json string"


@dataclass
class Built:
    indexed: int
    errors: int


def index_of(images: DataFrame) -> DataFrame:
    """The table that is searched: the text of a picture is its keys and values, then its metadata as JSON."""
    text = metadata_text(F.coalesce(tag_map(F.col("metadata_json")), F.create_map().cast("map<string,string>")))
    return images.select("id", "path", "filename", text.alias("metadata_text"))


def searchable(images: DataFrame) -> dict[str, DataFrame]:
    """The tables of a catalogue that hold or follow from its pictures: themselves, their texts, and the stored index."""
    texts = index_of(images)
    made = inverted.build(texts)
    return {"images": images, "index": texts, **{t: getattr(made, t) for t in inverted.TABLES}}


class _Progress:
    """Tells how many files are done while a job runs: the extractors count them, and a thread reads the counter."""

    def __init__(self, spark: SparkSession, done: int, total: int, tell: Callable[[int, int], None] | None) -> None:
        self.counter, self.told, self.start, self.total, self.tell = spark.sparkContext.accumulator(0), 0, done, total, tell
        self.over = threading.Event()

    def counted(self, extractor: Callable[[str], dict[str, str]]) -> Callable[[str], dict[str, str]]:
        counter = self.counter

        def run(path: str) -> dict[str, str]:
            counter.add(1)
            return extractor(path)

        return run

    def _report(self, upto: int) -> None:
        while self.told < min(upto, self.total):
            self.told += 1
            self.tell(self.told, self.total)

    def __enter__(self) -> _Progress:
        if self.tell:
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()
        return self

    def _watch(self) -> None:
        while not self.over.wait(0.2):
            self._report(self.start + self.counter.value)

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.over.set()
        if self.tell:
            self.thread.join()
            if kind is None:
                self._report(self.total)


def build_index(
    spark: SparkSession,
    catalog: Catalog,
    roots: list[str],
    extractor: Callable[[str], dict[str, str]],
    force: bool = False,
    patterns: list[str] | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    keep_on_empty_scan: bool = True,
    on_progress: Callable[[int, int], None] | None = None,
    workers: int | None = None,
    json_path: str | None = None,
) -> Built:
    """One run over the roots. Files with an equal stamp aren't extracted again; files that couldn't be read lose their
    row; rows below the roots whose file is gone are deleted, others stay. A scan that finds nothing leaves the
    catalogue alone, unless `keep_on_empty_scan` is off or it was forced. A cancelled run deletes nothing, but what it
    extracted stays. `on_progress` is told (done, of all) once for each file, as tasks end; `workers` is how many files are
    extracted at once, all cores if it is None; `json_path` gets the catalogue as JSON after a run that wasn't cancelled."""
    stored = catalog.read("images")
    images = stored if stored is not None else spark.createDataFrame([], IMAGES)
    if force:
        images = force_wipe(images, roots)
    scan = written(
        last_by_path(scan_folders(spark, roots, patterns), [F.col("mtime").desc(), F.col("size").desc()]), "scan"
    )
    if keep_on_empty_scan and not scan.limit(1).count():
        if force and stored is not None:
            catalog.commit(**searchable(images))
        return Built(0, 0)
    compared = written(changes(scan, images), "compared")
    total = compared.count()
    fresh = compared.where("status <> 'unchanged'")
    if workers:
        fresh = fresh.repartition(workers)
    with _Progress(spark, compared.where("status = 'unchanged'").count(), total, on_progress) as progress:
        done = written(extract(fresh, progress.counted(extractor)), "extracted")
    errors = done.where("status = 'error'").count()
    stopped = cancelled()
    merged = upsert(images, done.where("status <> 'error'").drop("status").withColumn("id", F.lit(None).cast("bigint")))
    if not stopped:
        kept = scan.join(done.where("status = 'error'").select("path"), "path", "left_anti").select("path")
        merged = delete_missing(merged, kept, roots)
    merged = written(merged.select("id", "path", "filename", "mtime", "size", "metadata_json"), "merged")
    catalog.commit(**searchable(merged))
    if json_path and not stopped:
        export.write_json(merged, json_path)
    return Built(total - errors, errors)
