"""Where results go that are files of their own."""

from __future__ import annotations


def save(path: str, content: bytes) -> None:
    """Writes a file from whichever task runs: a path with a scheme (``hdfs://…``, ``s3://…``) through its file
    system, any other on a folder that all executors share. A task that runs again writes the same file."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    with system.open_output_stream(at) as f:
        f.write(content)
