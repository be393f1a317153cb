"""Files of a log that are created whole, and only if they are not there.

That is the compare-and-set which all writers of a store rely on, so a store is refused on file
systems that can't give it:

- local and mounted folders: a draft is written and linked to its name; a link never replaces;
- HDFS, viewfs and ABFS: a draft is renamed; these refuse to rename onto a file that exists;
- GCS: an object that is created without overwriting appears whole, or the request fails.

For any other store (S3 without conditional writes among them) the caller gives `put`, a function
of (path, text) that tells whether it created the file, such as one over a database or a lock.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from loghelm.schema import RefusedError

RENAMED = ("hdfs", "viewfs", "abfs", "abfss")
CREATED = ("gs",)


class Files:
    """The small files of a store, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str, put: Callable[[str, str], bool] | None = None):
        self._jvm, self.root, self._put = spark._jvm, root.rstrip("/"), put
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.scheme = self.fs.getScheme()
        if put is None and self.scheme != "file" and self.scheme not in RENAMED + CREATED:
            raise RefusedError("unsupported_store", f"{self.scheme} has no creation without overwriting; give `put`")

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def local(self, name: str) -> str:
        return unquote(urlparse(self.fs.makeQualified(self.path(name)).toUri().toString()).path)

    def read(self, name: str) -> str | None:
        """The text of a file, None if it isn't there."""
        path = self.path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        out = self.fs.create(self.path(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Creates the file with this text; False, and no change, if it is there already."""
        if self._put is not None:
            return self._put(f"{self.root}/{name}", text)
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
        if self.scheme == "file":
            at = self.local(draft)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(at, self.local(name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(at)
        if self.scheme in CREATED:
            if self.fs.exists(self.path(name)):
                return False
            try:
                self.write(name, text)
                return True
            except Exception:
                if self.fs.exists(self.path(name)):
                    return False
                raise
        self.write(draft, text)
        if not self.fs.exists(self.path(name)) and self.fs.rename(self.path(draft), self.path(name)):
            return True
        self.fs.delete(self.path(draft), False)
        if not self.fs.exists(self.path(name)):
            raise RefusedError("unsupported_store", f"{name} could not be created")
        return False

    def names(self, folder: str) -> list[tuple[str, bool, int, int]]:
        """(name, is a folder, bytes, milliseconds of its last change) of what is in a folder."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.path(folder))]

    def size(self, folder: str) -> int:
        return sum(n for name, is_dir, n, _ in self.names(folder) if not is_dir and name.endswith(".parquet"))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
