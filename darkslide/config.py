"""Settings: flags of the environment, names of catalogues, numbers of workers and addresses of files."""

from __future__ import annotations

import os
import posixpath
from urllib.parse import quote

# Words that mean yes and no.
YES, NO = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
MOST_WORKERS = 16


def env_flag(name: str, default: bool) -> bool:
    """A flag of the environment; anything but a word for yes or no is the default."""
    said = os.environ.get(name, "").strip().lower()
    return said in YES or (default and said not in NO)


def catalog_root(name: str, base: str) -> str:
    """Where the catalogue called `name` lies: a bare name below `base`, without the ending that may have been typed; an
    absolute path, an address or a path with folders as it is."""
    if "/" in name or "\\" in name:
        return name
    return posixpath.join(base, posixpath.splitext(name)[0])


def clamped(workers: int, cores: int | None = None) -> int:
    """A number of workers between 1 and the cores, 16 at most."""
    return max(1, min(workers, cores or os.cpu_count() or 1, MOST_WORKERS))


def file_uri(path: str) -> str:
    """The address of a file for previews; backslashes of drives become slashes."""
    plain = path.replace("\\", "/")
    return "file://" + ("" if plain.startswith("/") else "/") + quote(plain, safe="/:")
