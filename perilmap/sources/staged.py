"""Files that appear only when their job commits: tasks write aside, the driver moves the committed ones."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of an address, local paths included."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri if uri.startswith('/') else '/' + uri}")


def files_of(uri: str, ending: str) -> list[str]:
    """The files at an address, a folder's in order of name; hidden ones and those of running jobs are left out."""
    store, path = filesystem(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(ending) and f.base_name[0] not in "._")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: names within the job's own folder."""

    names: tuple[str, ...]


class Staging:
    """A job's own folder under the target. A lost or repeated attempt's files stay in it and go with it."""

    def __init__(self, uri: str, ending: str, overwrite: bool):
        self.uri, self.ending, self.overwrite = uri, ending, overwrite
        self.job = uuid.uuid4().hex
        # Made here, on the driver: a task that outlives an abort finds no folder and can't leave a file.
        store, _, aside = self.folder()
        store.create_dir(aside, recursive=True)

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        store, path = filesystem(self.uri)
        return store, path, f"{path}/_temporary-{self.job}"

    def new_file(self, attempt: str, k: int) -> tuple[str, object]:
        """(name, open stream) of an attempt's next file."""
        store, _, aside = self.folder()
        name = f"part-{attempt}-{k:03d}{self.ending}"
        return name, store.open_output_stream(f"{aside}/{name}", compression=None)

    def commit(self, messages: list[Written | None]) -> None:
        store, path, aside = self.folder()
        before = files_of(self.uri, self.ending) if self.overwrite else []
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{aside}/{name}", f"{path}/{name}")
        for old in before:
            store.delete_file(old)
        self._clear()

    def _clear(self) -> None:
        store, _, aside = self.folder()
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)

    abort = _clear
