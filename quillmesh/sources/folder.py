"""A folder that the driver and executors share, on any file system that Arrow reaches: small whole files, moved into place."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


class Folder:
    """Files of a folder given by URI or path. A file is made under a hidden name and then moved, so nobody reads half of one."""

    def __init__(self, root: str):
        self.root = root

    def _at(self) -> tuple[fs.FileSystem, str]:
        root = re.sub(r"^file:/(?!/)", "file:///", self.root)  # a local URI may have one slash or three
        return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))

    def write(self, name: str, data: bytes) -> None:
        """Replace a file as a whole."""
        where, base = self._at()
        above, _, last = f"{base}/{name}".rpartition("/")
        made = f"{above}/_{last}.{uuid.uuid4().hex}"
        where.create_dir(above, recursive=True)
        with where.open_output_stream(made, compression=None) as f:
            f.write(data)
        where.move(made, f"{base}/{name}")

    def read(self, name: str) -> bytes | None:
        """A file's bytes; None where there is none."""
        where, base = self._at()
        try:
            with where.open_input_stream(f"{base}/{name}", compression=None) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def names(self, name: str) -> list[str]:
        """The files of a folder inside, but for hidden ones; none if it is not there."""
        where, base = self._at()
        found = where.get_file_info(fs.FileSelector(f"{base}/{name}", allow_not_found=True))
        return [x.base_name for x in found if x.type == fs.FileType.File and x.base_name[0] not in "_."]

    def exists(self, name: str) -> bool:
        where, base = self._at()
        return where.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound

    def delete(self, name: str) -> None:
        """Delete a file or folder, if it is there; the whole folder, if no name is given."""
        where, base = self._at()
        at = f"{base}/{name}" if name else base
        kind = where.get_file_info(at).type
        if kind == fs.FileType.Directory:
            where.delete_dir(at)
        elif kind != fs.FileType.NotFound:
            where.delete_file(at)

    def make(self, name: str) -> None:
        """A folder inside, if it is not there."""
        where, base = self._at()
        where.create_dir(f"{base}/{name}", recursive=True)

    def move(self, name: str, to: str) -> None:
        """Move a file or folder within."""
        where, base = self._at()
        where.create_dir(f"{base}/{to}".rpartition("/")[0], recursive=True)
        where.move(f"{base}/{name}", f"{base}/{to}")


def replace_all(files: list[tuple[Folder, str, bytes]]) -> None:
    """Replace files in this order, or none: if one cannot be, those before it get their old bytes back, or go if they are new.

    The last file is the one that says that all are there: after a crash in between, whoever reads it redoes the rest.
    """
    done: list[tuple[Folder, str, bytes | None]] = []
    try:
        for folder, name, data in files:
            before = folder.read(name)
            folder.write(name, data)
            done.append((folder, name, before))
    except BaseException:
        for folder, name, before in reversed(done):
            if before is None:
                folder.delete(name)
            else:
                folder.write(name, before)
        raise
