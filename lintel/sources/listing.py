"""Listings of folders as a Spark data source, in batch and as a stream of new files."""

from collections.abc import Iterator

from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Files of one page of a stream's listing.
PAGE_FILES = 1000


class Prefix(InputPartition):
    """One page of a listing: what lies directly in the folder, or all below one of its subfolders."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class Page(InputPartition):
    """One page of new files: (path, length, modified at)."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def _row(path: str, length: int, ns: int) -> tuple:
    import datetime as dt

    return path, length, dt.datetime.fromtimestamp(ns // 1000 / 1e6, dt.UTC)


class _Lister:
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.scheme = self.folder.split(":", 1)[0] + "://" if "://" in self.folder else "file:" if self.folder.startswith("file:") else ""

    def entries(self, path: str, deep: bool) -> tuple[list[FileInfo], list[FileInfo]]:
        """The files with the suffix and the folders below a path, in order of their paths."""
        uri = self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:")
        system, root = FileSystem.from_uri(uri)
        found = system.get_file_info(FileSelector(f"{root}/{path}".rstrip("/"), recursive=deep, allow_not_found=True))
        found.sort(key=lambda f: f.path)
        return [f for f in found if f.type == FileType.File and f.path.endswith(self.suffix)], [f for f in found if f.type == FileType.Directory]

    def shown(self, f: FileInfo) -> tuple[str, int, int]:
        return self.scheme + f.path if "://" not in f.path else f.path, f.size, f.mtime_ns or 0


class ListingReader(_Lister, DataSourceReader):
    def partitions(self) -> list[Prefix]:
        """The top level first, then each subfolder: the driver lists one level, tasks list the rest."""
        return [Prefix("", False), *(Prefix(f.base_name, True) for f in self.entries("", False)[1])]

    def read(self, partition: Prefix) -> Iterator[tuple]:
        for f in self.entries(partition.path, partition.deep)[0]:
            yield _row(*self.shown(f))


class ListingStreamReader(_Lister, DataSourceStreamReader):
    """New files by (time, path): each comes in once, also after a restart, as the offset is the last file that came in.

    A file that appears with an older time than that is not new and does not come in.
    """

    def _after(self, offset: dict, upto: dict | None = None) -> list[tuple[str, int, int]]:
        key = lambda f: (f[2], f[0])
        files = sorted(map(self.shown, self.entries("", True)[0]), key=key)
        bounds = (offset["at"], offset["path"]), (upto["at"], upto["path"]) if upto else None
        return [f for f in files if key(f) > bounds[0] and (bounds[1] is None or key(f) <= bounds[1])]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._after(self.initialOffset())
        return {"at": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Page]:
        files = self._after(start, end)
        return [Page(files[k : k + PAGE_FILES]) for k in range(0, len(files), PAGE_FILES)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for f in partition.files:
            yield _row(*f)

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    """Path, length and modificationTime of the files below a folder (path), of one suffix if it is given.

    Any file system that a URI names and pyarrow reaches; no content is read.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, length long, modificationTime timestamp"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStreamReader:  # noqa: N802
        return ListingStreamReader(self.options)
