"""What runs inside copy tasks: listing a directory and copying a file with Arrow file systems.

Imports nothing of this package, and is sent to the executors by value, so that they need not have it installed.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs

ROWS_PER_BATCH = 10000
STREAM_BUFFER = 16 * 1024 * 1024
HEADER_BUFFER = 64 * 1024
# Fixed value: the largest object that S3 copies in one request.
S3_COPY_LIMIT = 5 * 1024**3


def open_filesystem(uri: str, options: dict) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow file system and inner path for a URI as Hadoop writes it."""
    kind, rest = uri.split(":", 1)
    if kind == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if kind in ("s3", "s3a", "s3n"):
        return arrow_fs.S3FileSystem(**options), rest.lstrip("/")
    authority = re.match(r"//[^/]*", rest).group(0)
    return arrow_fs.FileSystem.from_uri(f"{kind}:{authority}/")[0], rest[len(authority):]


def children(
    directory: str, options: dict, wanted: Callable[[str], bool] = lambda name: True
) -> Iterator[tuple[str, int, float | None, bool]]:
    """Name, length, time of change (seconds) and whether a directory, of the direct children with a wanted name.

    A local directory is read as a stream, and only wanted names are looked up; a file that goes meanwhile is left out.
    """
    filesystem, inner = open_filesystem(directory, options)
    if isinstance(filesystem, arrow_fs.LocalFileSystem):
        with os.scandir(inner) as found:
            for entry in found:
                if wanted(entry.name):
                    try:
                        state, folder = entry.stat(), entry.is_dir()
                    except FileNotFoundError:
                        continue
                    yield entry.name, 0 if folder else state.st_size, state.st_mtime, folder
        return
    for info in filesystem.get_file_info(arrow_fs.FileSelector(inner)):
        if wanted(info.base_name):
            folder = info.type == arrow_fs.FileType.Directory
            yield info.base_name, info.size or 0, None if info.mtime is None else info.mtime.timestamp(), folder


def list_children(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    """Direct children of each directory, in pages: path, path relative to the root, length, whether a directory.

    ``part`` of ``parts`` of a directory are the names whose checksum leaves that remainder.
    """
    for batch in batches:
        for row in batch.to_pylist():
            directory, relative, part, parts = row["path"].rstrip("/"), row["relative"], row["part"], row["parts"]
            entries = children(row["path"], options, lambda name: zlib.crc32(os.fsencode(name)) % parts == part)
            while page := list(itertools.islice(entries, ROWS_PER_BATCH)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{directory}/{name}" for name, *_ in page], pa.string()),
                        pa.array([f"{relative}{name}" for name, *_ in page], pa.string()),
                        pa.array([length for _, length, _, _ in page], pa.int64()),
                        pa.array([folder for *_, folder in page], pa.bool_()),
                    ],
                    names=["path", "relative", "length", "is_directory"],
                )


def first_line(filesystem: arrow_fs.FileSystem, path: str) -> bytes | None:
    """The first line of a file that is not blank, without its end; None where there is none."""
    rest = b""
    with filesystem.open_input_stream(path) as stream:
        while chunk := stream.read(HEADER_BUFFER):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                if line.strip():
                    return line.rstrip(b"\r")
    return rest.rstrip(b"\r") if rest.strip() else None


def header_lines(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    """path and header of each file, or of the first part that has one in a folder of parts."""
    for batch in batches:
        headers = []
        for path, folder in zip(batch["path"].to_pylist(), batch["is_directory"].to_pylist()):
            filesystem, inner = open_filesystem(path, options)
            parts = [inner]
            if folder:
                names = (name for name, _, _, nested in children(path, options) if name.startswith("part-") and not nested)
                parts = [f"{inner}/{name}" for name in sorted(names)]
            found = next((line for line in (first_line(filesystem, part) for part in parts) if line is not None), None)
            headers.append(None if found is None else found.decode("utf-8-sig", "replace"))
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(headers, pa.string())], names=["path", "header"])


def copy_files(
    batches: Iterator[pa.RecordBatch], scratch: str, source_options: dict, target_options: dict
) -> Iterator[pa.RecordBatch]:
    """Copy each file of a plan and give back where it is now."""
    for batch in batches:
        for source, target, length in zip(*(batch[name].to_pylist() for name in ("source", "target", "length"))):
            copy_file(source, target, length, scratch, source_options, target_options)
        yield batch.select(["target", "length"])


def copy_file(
    source: str, target: str, length: int, scratch: str, source_options: dict, target_options: dict
) -> None:
    """Copy one file. It grows in the scratch folder, next to its target, and gets its name when it is whole."""
    source_fs, source_path = open_filesystem(source, source_options)
    target_fs, target_path = open_filesystem(target, target_options)
    if isinstance(target_fs, arrow_fs.S3FileSystem):
        # An object appears whole or not at all, so it needs no partial name.
        transfer_bytes(source_fs, source_path, target_fs, target_path, length > S3_COPY_LIMIT)
    else:
        partial = f"{open_filesystem(scratch, target_options)[1]}/{uuid.uuid4().hex}"
        target_fs.create_dir(partial.rsplit("/", 1)[0], recursive=True)
        target_fs.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
        transfer_bytes(source_fs, source_path, target_fs, partial)
        target_fs.move(partial, target_path)
    written = target_fs.get_file_info(target_path).size
    if written != length:
        raise OSError(f"{target} has {written} bytes instead of {length}")


def transfer_bytes(
    source_fs: arrow_fs.FileSystem, source: str, target_fs: arrow_fs.FileSystem, target: str, streamed: bool = False
) -> None:
    """Copy inside the file system where it is one and the same, else as a stream of bounded size."""
    if not streamed:
        arrow_fs.copy_files(source, target, source_fs, target_fs)
        return
    with source_fs.open_input_stream(source) as reading, target_fs.open_output_stream(target) as writing:
        while chunk := reading.read(STREAM_BUFFER):
            writing.write(chunk)
