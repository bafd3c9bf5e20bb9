"""A drive of folders behind a paged client, as a Python data source: read, streamed, written.

The client is made where it is used, by a factory named in the options as ``module:function`` or
``module:function:argument``.  It has

- ``list(folder, token)``, which returns (files, next token), and ``get(id)``, which raises KeyError for a file that isn't there;
- for streams ``head()``, the log of changes' newest token and the time, ``changes(token)``, which returns (changes after
  it, next token), null at the end, and ``meta(id)``;
- for writes ``create(folder, name, bytes)``, ``folder(parent, name)``, ``move(id, folder, name)`` and ``delete(id)``
  (a folder with all in it).

A file is a dict with id, name, mimeType, size, modifiedTime and parents; a change one with token, id and removed.
"""

from __future__ import annotations

import datetime
import importlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

FOLDER = "application/vnd.google-apps.folder"
_SCHEMA = "cle string, taille bigint, date_modification timestamp, type_mime string, content binary"


def load(name: str):
    """The client of the factory ``module:function``, with its argument if there is one."""
    module, function, *argument = name.split(":", 2)
    return getattr(importlib.import_module(module), function)(*argument)


def pages(client, folder: str) -> Iterator[dict]:
    token = None
    while True:
        files, token = client.list(folder, token)
        yield from (f for f in files if f.get("id") and f.get("name"))
        if not token:
            return


def walk(client, folder: str, path: str) -> Iterator[tuple[dict, str]]:
    """(file, path) of all files below a folder."""
    waiting = [(folder, path)]
    while waiting:
        at, base = waiting.pop()
        for f in pages(client, at):
            place = f"{base}/{f['name']}" if base else f["name"]
            if f.get("mimeType") == FOLDER:
                waiting.append((f["id"], place))
            else:
                yield f, place


def read(client, key: str) -> bytes:
    """The bytes of the file with a key of a listing: the id before the first colon."""
    try:
        return client.get(key.split(":", 1)[0])
    except KeyError as e:
        raise FileNotFoundError(key) from e


def row(client, f: dict, path: str) -> tuple:
    when = f.get("modifiedTime")
    seen = datetime.datetime.fromisoformat(when) if when else datetime.datetime.fromtimestamp(0, datetime.timezone.utc)
    return f"{f['id']}:{path}", int(f.get("size") or 0), seen, f.get("mimeType"), read(client, f["id"])


@dataclass
class _Folder(InputPartition):
    folder: str
    path: str
    deep: bool
    until: str | None = None


@dataclass
class _Changes(InputPartition):
    """A page of changes, after ``token``; no more than ``most`` of them."""

    token: str
    most: int


class DriveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.root = options["client"], options["dossier"]

    def partitions(self, until: str | None = None) -> list[InputPartition]:
        """The root's own files, and each folder in it with all that is below."""
        inner = [_Folder(f["id"], f["name"], True, until) for f in pages(load(self.client), self.root) if f.get("mimeType") == FOLDER and not f["name"].startswith(STAGING)]
        return [_Folder(self.root, "", False, until), *inner]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        client = load(self.client)
        if partition.deep:
            found = walk(client, partition.folder, partition.path)
        else:
            found = ((f, f["name"]) for f in pages(client, partition.folder) if f.get("mimeType") != FOLDER)
        for f, path in found:
            if partition.until is None or (f.get("modifiedTime") or "") <= partition.until:
                yield row(client, f, path)


class DriveStreamReader(DataSourceStreamReader):
    """All files there are, then what changes: offsets are tokens of the drive's log of changes.

    The first batch walks the folders, up to the time of its end offset (what changes later comes with the log); each other
    one reads the log between two tokens, a partition a page, so the driver holds a token a page.  A file that changed
    several times in a page is one row.  Files that are removed, and those not below the root, give no row.  A batch that
    was committed is never read again; one that wasn't is planned again from the same offsets.
    """

    def __init__(self, options: dict):
        self.files = DriveReader(options)

    def initialOffset(self) -> dict:
        return {"jeton": "", "vu": ""}

    def latestOffset(self) -> dict:
        token, seen = load(self.files.client).head()
        return {"jeton": token, "vu": seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["jeton"] == end["jeton"]:
            return []
        if not start["jeton"]:
            return self.files.partitions(end["vu"])
        client, out, token = load(self.files.client), [], start["jeton"]
        while token is not None and token != end["jeton"]:
            changes, following = client.changes(token)
            tokens = [c["token"] for c in changes]
            most = tokens.index(end["jeton"]) + 1 if end["jeton"] in tokens else len(changes)
            if most:
                out.append(_Changes(token, most))
            token = None if end["jeton"] in tokens else following
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Folder):
            yield from self.files.read(partition)
            return
        client, paths = load(self.files.client), {self.files.root: ""}
        changes = client.changes(partition.token)[0][: partition.most]
        last = {c["id"]: c for c in changes}
        for c in last.values():
            f = None if c.get("removed") else client.meta(c["id"])
            if f and f.get("mimeType") != FOLDER and (place := self._place(client, f, paths)) is not None:
                try:
                    yield row(client, f, place)
                except FileNotFoundError:
                    pass  # removed since: a later change says so

    @staticmethod
    def _place(client, f: dict, paths: dict[str, str | None]) -> str | None:
        """Path below the root, null for a file elsewhere or in a writer's folder."""
        names, chain, at = [f["name"]], [], next(iter(f.get("parents") or []), None)
        while at is not None and at not in paths:
            folder = client.meta(at) or {}
            chain.append((at, len(names)))
            names.append(folder.get("name", ""))
            at = None if folder.get("name", "").startswith(STAGING) else next(iter(folder.get("parents") or []), None)
        base = paths.get(at) if at is not None else None
        for folder, k in chain:
            paths[folder] = None if base is None else "/".join(x for x in (base, *reversed(names[k:])) if x)
        return None if base is None else "/".join(x for x in (base, *reversed(names)) if x)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


#: Start of the names of a writer's own folders; readers pass over them.
STAGING = ".privlake-"


@dataclass
class Written(WriterCommitMessage):
    """What a task has put into its staging folder: (id, path)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class DriveWriter(DataSourceWriter):
    """Rows (cle, content) as files below the root, all or none.

    A task puts its files into a staging folder of its own attempt and reports their ids.  Committing moves them to
    their paths, by id, and then removes every staging folder of the job, those of attempts that failed or were
    doubled too.  Aborting removes the folders and whatever a broken commit has moved.  The driver handles ids and
    paths; bytes go from the tasks to the drive.  A path that leaves the root is refused in the task, so the job aborts.
    """

    def __init__(self, options: dict):
        self.client, self.root, self.job = options["client"], options["dossier"], uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        client, out, folder = load(self.client), Written(), None
        for r in iterator:
            parts = [p for p in r["cle"].split("/") if p not in ("", ".")]
            if ".." in parts or not parts:
                raise ValueError(f"key leaves the root: {r['cle']}")
            if folder is None:
                t = TaskContext.get()
                folder = client.folder(self.root, f"{STAGING}{self.job}-{t.partitionId() if t else 0}-{t.taskAttemptId() if t else 0}")
            out.files.append((client.create(folder, parts[-1], bytes(r["content"] or b"")), "/".join(parts)))
        return out

    def _clear(self, client) -> None:
        for f in list(pages(client, self.root)):
            if f["name"].startswith(f"{STAGING}{self.job}-"):
                client.delete(f["id"])

    def commit(self, messages: list[Written | None]) -> None:
        client = load(self.client)
        folders = {"": self.root}

        def folder(path: str) -> str:
            if path not in folders:
                base, _, name = path.rpartition("/")
                above = folder(base)
                there = next((f["id"] for f in pages(client, above) if f["name"] == name and f.get("mimeType") == FOLDER), None)
                folders[path] = there or client.folder(above, name)
            return folders[path]

        for m in messages:
            for key, path in m.files if m else []:
                base, _, name = path.rpartition("/")
                client.move(key, folder(base), name)
        self._clear(client)

    def abort(self, messages: list[Written | None]) -> None:
        client = load(self.client)
        self._clear(client)
        for m in messages:
            for key, _ in m.files if m else []:
                try:
                    client.delete(key)
                except KeyError:
                    pass  # gone with its folder


class DriveSource(DataSource):
    """Files below the folder ``dossier`` by key ``id:path``: the id stays when a file is renamed."""

    @classmethod
    def name(cls) -> str:
        return "privlake_drive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DriveReader:
        return DriveReader(self.options)

    def streamReader(self, schema) -> DriveStreamReader:
        return DriveStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DriveWriter:
        if overwrite:
            raise ValueError("a drive is only appended to")
        return DriveWriter(self.options)
