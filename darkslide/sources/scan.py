"""Scanning folders: which files are pictures, and the stamps of files below roots."""

from __future__ import annotations

import fnmatch
import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.text import ascii_lower

# Extensions of pictures, and patterns of names that are never scanned.
STANDARD = ["jpg", "jpeg", "tif", "tiff", "png", "bmp", "gif", "webp"]
RAW = ["cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "pef", "raf", "rwl", "srw"]
BLACKLIST = [".*", "Thumbs.db", "desktop.ini", "@eaDir", ".DS_Store"]
BATCH = 10_000  # rows of a scan that leave a task together
TIMEOUT = 30  # seconds that reading one file may take
WITH_INFO = {".png", ".gif", ".bmp", ".webp"}  # extensions of which the decoder's own notes are read too
SCAN = "path string, filename string, mtime double, size bigint"


def is_picture(filename: Column) -> Column:
    """Whether a name has the extension of a picture. A name that is only an extension has none."""
    suffix = F.regexp_extract(filename, r"[^.].*(\.[^.]+)$", 1)
    return ascii_lower(F.substring(suffix, 2, 100)).isin(STANDARD + RAW)


def is_dotfile(filename: Column) -> Column:
    return filename.startswith(".")


def blacklisted(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches any part of the path."""
    rules = [fnmatch.translate(p).replace(r"\z", r"\Z") for p in patterns]
    regex = "|".join(f"(?:{r})" for r in rules)
    if not regex:
        return F.lit(False)
    return F.exists(F.split(F.translate(path, "\\", "/"), "/"), lambda part: (part != "") & part.rlike(f"^{regex}"))


def scan_folders(
    spark: SparkSession,
    roots: list[str],
    patterns: list[str] | None = None,
    skip_dotfiles: bool = True,
    recursive: bool = True,
) -> DataFrame:
    """(path, filename, mtime, size) of the pictures below the roots; missing roots give none, and a file whose stamp can't
    be read has null for both parts of it. The folders right below the roots are tasks of their own, where they are
    mounted, and rows leave a task in batches; times keep the precision of the file system."""
    rules = BLACKLIST if patterns is None else patterns

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "filename", "mtime", "size"])

    def wanted(name: str) -> bool:
        return recursive and not any(fnmatch.fnmatchcase(name, p) for p in rules)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for top, below in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for folder, folders, files in os.walk(top):
                    folders[:] = [f for f in folders if below and wanted(f)]
                    for name in files:
                        path = os.path.join(folder, name)
                        try:
                            seen = os.stat(path)
                            rows.append((path, name, seen.st_mtime, seen.st_size))
                        except OSError:
                            rows.append((path, name, None, None))
                        if len(rows) >= BATCH:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each root without what lies deeper, and each folder right below it with all of it."""
        for batch in batches:
            made = []
            for root in batch.column(0).to_pylist():
                made.append((root, False))
                try:
                    inner = sorted(os.scandir(root), key=lambda x: x.name)
                except OSError:
                    continue
                made += [(x.path, True) for x in inner if x.is_dir(follow_symlinks=False) and wanted(x.name)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.bool_())], names=["top", "below"]
            )

    roots_ = spark.createDataFrame([(r,) for r in roots], "root string").repartition(max(1, len(roots)), "root")
    listed = roots_.mapInArrow(tops, "top string, below boolean")
    listed = listed.repartition(max(len(roots), spark.sparkContext.defaultParallelism), "top")
    found = listed.mapInArrow(walk, SCAN).where(is_picture(F.col("filename")) & ~blacklisted(F.col("path"), rules))
    return found.where(~is_dotfile(F.col("filename"))) if skip_dotfiles else found


def flatten_groups(document: dict) -> dict[str, str]:
    """group:key to value from a tool's answer of groups; values become text as Python writes them."""
    out: dict[str, str] = {}
    for key, value in document.items():
        if isinstance(value, dict):
            out.update({f"{key}:{k}": str(v) for k, v in value.items()})
        else:
            out[str(key)] = str(value)
    return out


def decoder_notes(path: str) -> dict[str, str]:
    """What the picture decoder knows of a file, if there is a decoder and it can read it."""
    try:
        from PIL import Image

        with Image.open(path) as picture:
            return {f"PIL:{k}": str(v) for k, v in (picture.info or {}).items()}
    except Exception:  # noqa: BLE001
        return {}


def tool_extractor(
    command: tuple[str, ...] = ("exiftool", "-json", "-g1", "-n"),
    timeout: float = TIMEOUT,
    notes: Callable[[str], dict[str, str]] = decoder_notes,
) -> Callable[[str], dict[str, str]]:
    """An extractor that runs an external tool on a file and flattens its JSON answer, a list of one object of groups.
    A tool that is missing, fails, answers nothing or takes too long gives no entries; of some formats the decoder's
    notes are added."""

    def run(path: str) -> dict[str, str]:
        found: dict[str, str] = {}
        try:
            tool = shutil.which(command[0]) or command[0]
            said = subprocess.run([tool, *command[1:], path], capture_output=True, timeout=timeout, start_new_session=True)
            answer = json.loads(said.stdout.decode("utf-8", "replace")) if said.stdout else []
            if answer and isinstance(answer, list):
                found = flatten_groups(answer[0])
        except (OSError, ValueError, subprocess.SubprocessError, AttributeError):
            pass
        if os.path.splitext(path)[1].lower() in WITH_INFO:
            found |= notes(path)
        return found

    return run


def extract(scan: DataFrame, extractor: Callable[[str], dict[str, str]]) -> DataFrame:
    """`scan` plus metadata_json and status, by calling `extractor` on each path where the rows are. What it raises, and
    a stamp that couldn't be read, makes the status error; the row is kept so that it can be counted."""
    kinds = dict(scan.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, states = [], []
            stamps = zip(batch.column("mtime").to_pylist(), batch.column("size").to_pylist(), strict=True)
            for path, (mtime, size) in zip(batch.column("path").to_pylist(), stamps, strict=True):
                try:
                    if mtime is None or size is None:
                        raise OSError("no stamp")
                    found = {str(k): str(v) for k, v in extractor(path).items()}
                    texts.append(json.dumps(found, ensure_ascii=False))
                    states.append("indexed")
                except Exception:  # noqa: BLE001
                    texts.append("{}")
                    states.append("error")
            kept = batch.drop_columns(["status"]) if "status" in batch.schema.names else batch
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(texts, pa.string()), pa.array(states, pa.string())],
                names=[*kept.schema.names, "metadata_json", "status"],
            )

    columns = [c for c in scan.columns if c != "status"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", metadata_json string, status string"
    return scan.mapInArrow(work, schema)
