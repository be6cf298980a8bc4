"""Byte-range access to local and remote files, and file types."""

from __future__ import annotations

import gzip
import hashlib
import io
import time
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import IO

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = (".warc.gz", ".warc", ".cdx.gz", ".cdx", ".cdxj.gz", ".cdxj", ".har", ".wacz", ".json")


def _system(path: str):  # noqa: ANN202
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _View:
    """A stretch of an open file as a file of its own."""

    def __init__(self, f, start: int, size: int) -> None:  # noqa: ANN001
        self.f, self.start, self.size, self.at = f, start, size, 0

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        if n <= 0:
            return b""
        self.f.seek(self.start + self.at)
        data = self.f.read(n)
        self.at += len(data)
        return data

    def close(self) -> None:
        self.f.close()

    def __enter__(self) -> _View:
        return self

    def __exit__(self, *_) -> None:  # noqa: ANN002
        self.close()


def open_file(path: str):  # noqa: ANN201
    """A seekable file on whatever file system the path names; ``a.zip#!/b`` is a member of an archive.

    Members that are stored as they are, as archives keep WARC files, are read in place.
    """
    outer, mark, member = path.rpartition("#!/")
    if not mark:
        system, at = _system(path)
        return system.open_input_file(at)
    f = open_file(outer)
    with zipfile.ZipFile(f) as z:
        entry = z.getinfo(member)
        if entry.compress_type == zipfile.ZIP_STORED:
            f.seek(entry.header_offset)
            head = f.read(30)
            start = entry.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
            return _View(f, start, entry.file_size)
        data = z.read(member)
    f.close()
    return io.BytesIO(data)


def file_size(path: str) -> int:
    with open_file(path) as f:
        return f.seek(0, 2)


def create_file(path: str):  # noqa: ANN201
    system, at = _system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at, compression=None, buffer_size=1 << 20)


def move_file(path: str, to: str) -> None:
    system, at = _system(path)
    system.move(at, _system(to)[1])


def remove_folder(path: str) -> None:
    system, at = _system(path)
    system.delete_dir(at)


#: Reads that fail are tried again: so often, and each time so many seconds later than before.
TRIES, WAIT = 20, 2.0


def retried(read, tries: int = TRIES, wait: float = WAIT, first: float = 1.0):  # noqa: ANN001, ANN201
    """What ``read()`` gives; failing reads are repeated, ever later (SC23). The last error is raised."""
    for k in range(tries):
        try:
            return read()
        except FileNotFoundError:
            raise
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(first + k * wait)
    raise ValueError("no tries")


def read_range(path: str, start: int = 0, length: int = -1) -> bytes:
    def read() -> bytes:
        with open_file(path) as f:
            f.seek(start)
            return f.read(length) if length >= 0 else f.read()

    return retried(read)


def read_members(paths: Iterable[str]) -> Iterator[bytes]:
    """The whole of each path. An archive stays open, its directory read once, for all paths in a row that lie in it."""
    held: dict[str, zipfile.ZipFile] = {}

    def close() -> None:
        for z in held.values():
            z.close()
            z.under.close()
        held.clear()

    def read(outer: str, member: str) -> bytes:
        try:
            if outer not in held:
                close()
                f = open_file(outer)
                held[outer] = zipfile.ZipFile(f)
                held[outer].under = f
            return held[outer].read(member)
        except OSError:
            close()
            raise

    try:
        for p in paths:
            outer, mark, member = p.rpartition("#!/")
            yield retried(lambda: read(outer, member)) if mark else read_range(p)  # noqa: B023
    finally:
        close()


def expand(path: str) -> list[str]:
    """Files under a path, or the path itself."""
    if "#!/" in path:
        return [path]
    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
        return sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file)
    return [path]


def known_extension(name: str) -> str | None:
    """The archive extension that a name ends with, query and fragment aside (SC24)."""
    bare = name.split("#")[0].split("?")[0].lower()
    return next((e for e in EXTENSIONS if bare.endswith(e)), None)


def file_kind(content: Column) -> Column:
    """zip, warc, gzip or text by the first bytes."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head.startswith("504B0304"), "zip").when(head == "574152432F", "warc").when(head.startswith("1F8B08"), "gzip").otherwise("text")


def zip_entries(path: str) -> list[dict]:
    """The central directory of an archive (SC13); ZIP64 included."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        return [
            {
                "filename": i.filename, "deflate": i.compress_type == zipfile.ZIP_DEFLATED, "uncompressed_size": i.file_size,
                "compressed_size": i.compress_size, "local_entry_offset": i.header_offset,
            }
            for i in z.infolist()
            if not i.is_dir()
        ]


def read_member(path: str, name: str, start: int = 0, length: int = -1, unzip: bool = False) -> bytes:
    """Bytes of a member, from ``start``; with ``unzip`` the member's own gzip undone (SC14)."""
    with open_file(path) as f, zipfile.ZipFile(f) as z, z.open(name) as m:
        if start:
            m.seek(start)
        data = m.read(length) if length >= 0 else m.read()
    return gzip.decompress(data) if unzip and data[:2] == b"\x1f\x8b" else data


@contextmanager
def open_member(path: str, name: str) -> Iterator[IO[bytes]]:
    """A member as a stream."""
    with open_file(path) as f, zipfile.ZipFile(f) as z, z.open(name) as m:
        yield m


def member_digest(path: str, name: str) -> str:
    """SHA-256 of a member, read a block at a time."""

    def read() -> str:
        told = hashlib.sha256()
        with open_member(path, name) as m:
            while data := m.read(1 << 20):
                told.update(data)
        return told.hexdigest()

    return retried(read)


def text_lines(path: str, name: str, most: int = 10_000, size: int = 8 << 20) -> Iterator[list[str]]:
    """Lines of a text member, gzipped or not, in lists of ``most`` lines or about ``size`` letters."""
    with open_member(path, name) as m:
        raw = gzip.open(m) if m.peek(2)[:2] == b"\x1f\x8b" else m
        held, n = [], 0
        for line in io.TextIOWrapper(raw, "utf-8", "replace"):
            held.append(line.rstrip("\n"))
            n += len(line)
            if len(held) >= most or n >= size:
                yield held
                held, n = [], 0
        if held:
            yield held
