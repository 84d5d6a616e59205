"""Source repositories as a Spark data source.

Spark's file readers skip names that begin with an underscore or a dot, which code is full of; this reader does
not. The driver lists paths; files are dealt to tasks by their sizes, so one deep directory is read by many tasks::

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("name", "shop").load("/src/shop")
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Directories that hold no source, and suffixes of binary files.
SKIPPED_DIRS = (".git", "node_modules", ".venv", "venv", "dist", "build", "coverage", ".pytest_cache", ".mypy_cache")
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".bz2", ".7z", ".so", ".dll", ".dylib", ".exe", ".bin", ".class", ".jar", ".pyc",
)

SCHEMA = "repo string, path string, size long, mtime long, sha256 string, text string, truncated boolean, skip_reason string"


def parse_spec(spec: str) -> tuple[str, str]:
    """``name=path`` at the first equals sign; both must be there."""
    name, eq, path = (s.strip() for s in spec.partition("="))
    if not (name and eq and path):
        raise ValueError(f"expected name=path, got {spec!r}")
    return name, path


#: How much of files is read for what, and how many ranked files.
PROFILES = {
    "discovery": {"maxFileBytes": 250_000, "maxReadBytes": 24_000, "maxReadChars": 12_000, "maxLines": 220, "top": 5},
    "routes": {"maxFileBytes": 2_000_000, "maxReadBytes": 2_000_000, "maxReadChars": 2_000_000, "maxLines": 100_000, "top": 80},
    "flow": {"maxFileBytes": 180_000, "maxReadBytes": 6_000, "maxReadChars": 3_500, "maxLines": 90, "top": 2},
}
#: Files and bytes of a task, about.
TASK_FILES, TASK_BYTES = 2_000, 64 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


class RepositoryReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        self.name = options.get("name", os.path.basename(self.root))
        limits = PROFILES[options.get("profile", "routes")]
        limit = lambda k: int(options.get(k, limits[k]))
        self.skipped = tuple(filter(None, options.get("skipDirs", ",".join(SKIPPED_DIRS)).split(",")))
        self.max_file, self.max_read, self.max_chars, self.max_lines = map(limit, ("maxFileBytes", "maxReadBytes", "maxReadChars", "maxLines"))
        self.max_files = int(options.get("maxFiles", 0))
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.name}: no directory {self.root}")

    def _paths(self) -> Iterator[tuple[str, int]]:
        """Paths below the root in order, with sizes; binary ones by their suffix are left out."""
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.skipped)
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.splitext(name)[1].lower() not in BINARY_SUFFIXES:
                    try:
                        yield full, os.stat(full).st_size
                    except OSError:
                        continue

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for n, (path, bytes_) in enumerate(self._paths()):
            if self.max_files and n >= self.max_files:
                break
            held.append(path)
            size += min(bytes_, self.max_file)
            if len(held) >= TASK_FILES or size >= TASK_BYTES:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            row = self._file(path)
            if row:
                yield row

    def _file(self, full: str) -> tuple | None:
        path = os.path.relpath(full, self.root).replace(os.sep, "/")
        try:
            stat = os.stat(full)
            with open(full, "rb") as f:
                head = f.read(1024)
                if b"\0" in head:
                    return None
                known = (self.name, path, stat.st_size, stat.st_mtime_ns)
                if stat.st_size > self.max_file:
                    digest = hashlib.sha256(head)
                    while block := f.read(1 << 16):
                        digest.update(block)
                    return (*known, digest.hexdigest(), None, False, "too_large")
                data = head + f.read()
        except OSError:
            return None  # what cannot be read counts as binary
        text = data[: self.max_read].decode("utf-8", "replace")
        lines = text.splitlines(keepends=True)
        shown = "".join(lines[: self.max_lines])
        short = len(data) > self.max_read or len(lines) > self.max_lines or len(shown) > self.max_chars
        return (*known, hashlib.sha256(data).hexdigest(), shown[: self.max_chars], short, None)


class RepositorySource(DataSource):
    """Text files of a repository, each once, as :data:`SCHEMA`. Binary and unreadable files are left out; too large ones have no text."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RepositoryReader(self.options)


def read_repositories(spark, specs: list[str], **options):
    """All files of the repositories ``name=path``; ``options``: of the source, such as ``profile`` or ``maxFiles``."""
    spark.dataSource.register(RepositorySource)
    out = None
    for name, path in map(parse_spec, specs):
        df = spark.read.format("repository").options(**options).option("name", name).load(path)
        out = df if out is None else out.unionByName(df)
    return out


def read_ranked(spark, specs: list[str], profile: str = "discovery"):
    """The files of each repository that rank highest, as many and as much of them as the profile says, with ``score`` and ``rank``."""
    from routeloom.operators.files import rank_files, sense  # the operators work without this source

    files = read_repositories(spark, specs, profile=profile)
    known = files.select("repo", "path")
    return rank_files(known, sense(known), PROFILES[profile]["top"]).join(files, ["repo", "path"])
