"""A streaming source that follows growing log files through rotation.

The offset of a path is a journal of every file that is or was the path's: the current one and the ones it was renamed to, known by their
inodes, with the end of the last complete line read of each and a checksum of its first bytes. Entries stay as long as their files do, so any number
of rotations between two triggers is caught up on, the oldest file first, also where lines are still written to a file after it was renamed. Files with the path's name
that are there when it is first followed count as read; every one that turns up later is read from its start. A file that shrank, or that
begins otherwise than before, was truncated in place and is read from its start. Lines still being written wait for their end; a rotated
file's last line has ended when nothing was written for ``SETTLED`` seconds.

A rotated file that was compressed (``.gz``, ``.bz2``, ``.xz``) or copied since is told by the checksum of its first bytes and read on from where the
first one was read to; one that was never seen before is read whole. A compressed one counts only when its plain file is gone, as it is being written until then.

The format of the first line that fits one is part of a path's offset, so it is kept over triggers, restarts and rotation; lines carry it as
``first_format`` (NULL before that line), and their place in all that was read of the path as ``place``. A path that is added to a stream that runs already
begins like all others, with the trigger after the one that first sees it.

Files are opened by path where the tasks run: on a cluster the folder must be mounted everywhere, as with any ``file://`` source.
``maxBytesPerTrigger`` bounds what a trigger takes in of all files (0: everything; a compressed file is taken whole). A source isn't told after a restart where reading
stands when it says what is new, so ``journal`` names a file on the driver's machine that holds the newest planned offset. Without it the first trigger after a restart has no
bound, places begin anew, and the first format is looked for again in the files that are there; what is read is exact either way.
"""

from __future__ import annotations

import bz2
import gzip
import json
import logging
import lzma
import os
import re
import time
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidelog.functions.formats import LINE

SETTLED = 5.0
#: Bytes of a file's start that tell it from another one.
FACE = 1024
#: The end of a compressed file, which does not grow.
WHOLE = -1
#: What a compressed file counts in places, as its length is not known before it is read.
_GULP = 1 << 40
_CHUNK = 1 << 16
_OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
_UNREADABLE = (".zst", ".lz4", ".Z", ".zip")
_LINE = re.compile(LINE)
_log = logging.getLogger(__name__)


class ByteRange(InputPartition):
    def __init__(self, path: str, shown: str, start: int, end: int, first_format: str | None, place: int) -> None:
        self.path, self.shown, self.start, self.end, self.first_format, self.place = path, shown, start, end, first_format, place


def is_packed(path: str) -> bool:
    return path.endswith(tuple(_OPENERS))


def opened(path: str):
    return _OPENERS[os.path.splitext(path)[1]](path, "rb") if is_packed(path) else open(path, "rb")


def face(path: str, n: int) -> int:
    """A checksum of the first n bytes."""
    with opened(path) as f:
        return zlib.crc32(f.read(n))


def complete_end(path: str, start: int = 0) -> int:
    """The place after the last line end at or after ``start``, ``start`` if there is none."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - _CHUNK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def format_of(line: str) -> str | None:
    """The format's name, as ``functions.formats.capture`` gives it."""
    m = _LINE.match(line)
    if not m:
        return None
    nginx, host, end, times = m[3] == "-", m[1] is not None, m[11] is not None, m[14] is not None
    if host:
        return "vhost" if end and not times else None
    if times:
        return "nginx_custom" if nginx else None
    return ("nginx" if nginx else "combined") if end else "common"


def _journal(offset: dict) -> dict:
    """An offset as it is written now; earlier ones had the files only."""
    return {p: {"files": x, "format": None, "read": 0} if isinstance(x, list) else x for p, x in offset.items()}


class TailReader(DataSourceStreamReader):
    """Offsets are {path: {"files": [[inode, end, bytes in the checksum, checksum], ...], "format": name, "read": bytes}}, the current file last."""

    def __init__(self, paths: list[str], start_from: int | dict[str, int], most_bytes: int, per_trigger: int = 0, journal: str = "") -> None:
        self.paths, self.start_from, self.most_bytes, self.per_trigger, self.journal = paths, start_from, most_bytes, per_trigger, journal
        self.last: dict[str, dict] | None = self._remembered()

    def _remembered(self) -> dict[str, dict] | None:
        try:
            with open(self.journal, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def _remember(self, offset: dict) -> None:
        if self.journal:
            os.makedirs(os.path.dirname(self.journal) or ".", exist_ok=True)
            with open(self.journal + ".new", "w", encoding="utf-8") as f:
                json.dump(offset, f)
            os.replace(self.journal + ".new", self.journal)

    @staticmethod
    def _entry(path: str, end: int) -> list:
        n = min(FACE, end) if end != WHOLE else FACE
        return [os.stat(path).st_ino, end, n, face(path, n)]

    def _first(self, path: str) -> dict:
        """Where a path begins: rotated files count as read."""
        entries, start_from = [], self.start_from.get(path, 0) if isinstance(self.start_from, dict) else self.start_from
        for full in self._files(path).values():
            where = WHOLE if is_packed(full) else os.path.getsize(full)
            if full == path:
                where = 0
                if start_from < 0:
                    where = complete_end(path)
                elif start_from > 0:
                    with open(path, "rb") as f:
                        for _ in range(max(1, start_from - 1)):
                            f.readline()
                        where = f.tell()
            entries.append(self._entry(full, where))
        return {"files": entries, "format": None, "read": 0}

    def initialOffset(self) -> dict:
        self.last = {path: self._first(path) for path in self.paths}
        return {"files": json.dumps(self.last)}

    @staticmethod
    def _files(path: str) -> dict[int, str]:
        """The path's own file and those that it may have been renamed to, by inode, the oldest first."""
        folder, name = os.path.split(path)
        folder = folder or "."
        found = []
        for other in os.listdir(folder) if os.path.isdir(folder) else ():
            full = path if other == name else os.path.join(folder, other)
            if not (other == name or other.startswith(name) and other[len(name)] in ".-_"):
                continue
            if other.endswith(_UNREADABLE):
                _log.warning("%s: cannot be read, its lines are not followed", full)
                continue
            try:
                stat = os.stat(full)
            except FileNotFoundError:
                continue
            if os.path.isfile(full):
                found.append((other == name, stat.st_mtime_ns, stat.st_ino, full))
        return {inode: full for _, _, inode, full in sorted(found)}

    @staticmethod
    def _origin(full: str, before: list, files: dict[int, str]) -> list | None:
        """The entry of a file that is there no more and began like this one, which is its compressed form or its copy."""
        faces: dict[int, int] = {}
        # The longest checksum decides, as short ones fit many files.
        for entry in sorted((e for e in before if e[1] != WHOLE and e[2]), key=lambda e: -e[2]):
            inode, _, n, check = entry
            if inode in files and not is_packed(files[inode]) and face(files[inode], n) == check:
                continue
            if n not in faces:
                faces[n] = face(full, n)
            if faces[n] == check:
                return entry
        return None

    def _now(self, path: str, before: list) -> list:
        """The path's entries up to its last complete lines, with where reading goes on in each."""
        files, had, found = self._files(path), {e[0]: e for e in before}, set()
        out = []
        for inode, full in files.items():
            known = had.get(inode)
            if is_packed(full):
                if known is not None and known[1] == WHOLE:
                    out.append((known, WHOLE))
                elif not os.path.exists(os.path.splitext(full)[0]):
                    entry = self._entry(full, WHOLE)
                    out.append((entry, self._start(path, full, before, files, entry)))
            else:
                settled = full != path and time.time() - os.stat(full).st_mtime > SETTLED
                entry = self._entry(full, os.path.getsize(full) if settled else complete_end(full))
                out.append((entry, self._start(path, full, before, files, entry)))
            if known is None and full != path and (origin := self._origin(full, before, files)):
                found.add(origin[0])
        if before and before[-1][0] not in found | set(files):
            _log.warning("%s: the file that was current is gone, lines written to it since the last trigger are lost", path)
        return out

    def _start(self, path: str, full: str, before: list, files: dict[int, str], entry: list) -> int:
        """Where reading goes on: where it ended in the file or in the one it was made from, or at the start of a new one."""
        known = next((e for e in before if e[0] == entry[0]), None)
        if known is not None and (known[1] == WHOLE) != (entry[1] == WHOLE):
            known = None
        if known is not None and known[1] != WHOLE and (entry[1] < known[1] or known[2] and face(full, known[2]) != known[3]):
            known = None
        if known is None and full != path:
            known = self._origin(full, before, files)
        return known[1] if known is not None else 0

    def latestOffset(self) -> dict:
        before = _journal(self.last or {})
        room = self.per_trigger if self.per_trigger and self.last is not None else None
        out = {}
        for path in self.paths:
            had = before.get(path)
            if had is None:
                # Followed since now (or after a restart without a journal, where the offset that reading starts at knows better).
                if self.last is not None:
                    out[path] = self._first(path)
                    continue
                had = {"files": [], "format": None, "read": 0}
            entries = self._now(path, had["files"])
            if room is not None:
                entries, room = self._bounded(path, had["files"], entries, room)
            read = had["read"] + sum(_GULP if end == WHOLE and start != WHOLE else max(0, end - start) for (_, end, _, _), start in entries)
            out[path] = {"files": [e for e, _ in entries], "format": had["format"] or self._first_format(path, entries), "read": read}
        self.last = out
        return {"files": json.dumps(out)}

    def _first_format(self, path: str, entries: list) -> str | None:
        """The format of the first new line that fits one."""
        files = self._files(path)
        for (inode, end, _, _), start in entries:
            if end == start or inode not in files:
                continue
            with opened(files[inode]) as f:
                f.seek(start)
                while (end == WHOLE or f.tell() < end) and (line := f.readline()):
                    if found := format_of(line.decode("utf-8", "replace").strip()):
                        return found
        return None

    def _bounded(self, path: str, before: list, entries: list, room: int) -> tuple[list, int]:
        """As many of the new bytes as there is room for, cut at a line's end, one line at least."""
        files, had, out = self._files(path), {e[0]: e for e in before}, []
        for (inode, end, n, check), start in entries:
            if end == start:
                out.append(([inode, end, n, check], start))
                continue
            if room <= 0:
                # Stays as it was, and is known to be unread if it is new.
                if inode in had:
                    out.append((had[inode], had[inode][1]))
                elif end != WHOLE:
                    out.append(([inode, 0, 0, 0], 0))
                continue
            if end != WHOLE and end - start > room:
                with open(files[inode], "rb") as f:
                    f.seek(start + max(0, room - 1))
                    f.readline()
                    end = min(end, f.tell())
                out.append((self._entry(files[inode], end), start))
                room = 0
                continue
            room -= os.path.getsize(files[inode]) if end == WHOLE else end - start
            out.append(([inode, end, n, check], start))
        # A compressed file that there is no room for leaves the entry of its plain file, by which it is known.
        held = {e[0] for e, _ in out}
        waiting = [(e, e[1]) for e in before if e[0] not in held and e[0] not in files and e[1] != WHOLE] if room <= 0 else []
        return waiting + out, room

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = _journal(json.loads(start["files"])), _journal(json.loads(end["files"]))
        out: list[InputPartition] = []
        for path, now in after.items():
            if path not in before:
                continue
            had, place, first_format = before[path]["files"], before[path]["read"], before[path]["format"] or now["format"]
            files, known = self._files(path), {e[0]: e for e in had}
            for entry in now["files"]:
                inode, stop = entry[0], entry[1]
                full = files.get(inode)
                if full is None:
                    was = known.get(inode)
                    if stop > (was[1] if was else 0):
                        raise FileNotFoundError(f"{path}: a file with {stop - (was[1] if was else 0)} bytes to read is gone")
                    continue
                at = self._start(path, full, had, files, entry)
                if stop == WHOLE and at != WHOLE:
                    out.append(ByteRange(full, path, at, WHOLE, first_format, place))
                    place += _GULP
                elif stop > at and not is_packed(full):
                    out += self._split(full, path, at, stop, first_format, place)
                    place += stop - at
        self.last = after
        self._remember(after)
        return out

    def _split(self, path: str, shown: str, start: int, end: int, first_format: str | None, place: int) -> list[InputPartition]:
        out = []
        while start < end:
            stop = end
            if end - start > self.most_bytes:
                with open(path, "rb") as f:
                    f.seek(start + self.most_bytes)
                    f.readline()
                    stop = min(end, f.tell())
            out.append(ByteRange(path, shown, start, stop, first_format, place))
            place += stop - start
            start = stop
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple[str, str, str | None, int]]:
        with opened(partition.path) as f:
            f.seek(partition.start)
            at = partition.start
            while (partition.end == WHOLE or at < partition.end) and (line := f.readline()):
                yield line.decode("utf-8", "replace").strip(), partition.shown, partition.first_format, partition.place + at - partition.start
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("access_log_tail").option("paths", json list).load()``"""

    @classmethod
    def name(cls) -> str:
        return "access_log_tail"

    def schema(self) -> str:
        return "value string, file string, first_format string, place bigint"

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(json.loads(o["paths"]), json.loads(o.get("startFrom", "0")), int(o.get("maxPartitionBytes", 32 << 20)), int(o.get("maxBytesPerTrigger", 0)), o.get("journal", ""))
