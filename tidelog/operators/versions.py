"""Numbered versions of a small description, of which each number can be put in place once: what writers of a table agree on."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


class Versions:
    """Descriptions ({"n": number, ...}) as files under ``root``/heads.

    ``publish`` is atomic where the file system links or renames without replacing (local disks, HDFS); object stores need a committer of their own.
    """

    def __init__(self, spark: SparkSession, root: str, kept: int = 2) -> None:
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def files(self):
        return self.path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self, *names: str) -> None:
        files = self.files()
        for name in names:
            files.delete(self.path(name), True)

    def _name(self, n: int) -> str:
        return f"{self.root}/heads/{n:012d}.json"

    def numbers(self) -> list[int]:
        files, folder = self.files(), self.path(f"{self.root}/heads")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(x[:12]) for x in names if x.endswith(".json") and x[:12].isdigit())

    def newest(self, below: int | None = None) -> dict | None:
        """The newest description, or the newest one of those before ``below``."""
        for _ in range(20):
            numbers = [n for n in self.numbers() if below is None or n < below]
            if not numbers:
                return None
            files, place = self.files(), self.path(self._name(numbers[-1]))
            try:
                stream = files.open(place)
            except Exception:
                if files.exists(place):
                    raise
                continue  # deleted since it was listed, so there is a newer one
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        raise Conflict(f"{self.root}: versions come and go too fast to be read")

    def publish(self, head: dict) -> None:
        files = self.files()
        draft, place = self.path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self.path(self._name(head["n"]))
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(head).encode()))
        stream.close()
        files.mkdirs(place.getParent())
        try:
            if files.getScheme() == "file":
                os.link(draft.toUri().getPath(), place.toUri().getPath())
            elif files.exists(place) or not files.rename(draft, place):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"another writer has put version {head['n']} in place") from None
        finally:
            files.delete(draft, False)
        for n in self.numbers():
            if n <= head["n"] - self.kept:
                files.delete(self.path(self._name(n)), False)
