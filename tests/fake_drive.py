"""A drive in memory, two entries a page."""

FOLDER = "application/vnd.google-apps.folder"
TREE = {
    "racine": [("1", "a.txt", "text/plain", b"un"), ("d1", "dossier", FOLDER, None), ("2", "b.csv", "text/csv", b"deux"), ("d2", "vide", FOLDER, None), (None, "sans id", "text/plain", b"")],
    "d1": [("3", "c.txt", "text/plain", "été".encode()), ("d3", "plus bas", FOLDER, None)],
    "d2": [],
    "d3": [("4", "d.txt", None, b"quatre"), ("5", "e.txt", "text/plain", b""), ("6", "f.txt", "text/plain", b"six")],
}


class Client:
    def list(self, folder, token):
        at = int(token or 0)
        rows = TREE[folder][at : at + 2]
        files = [{"id": i, "name": n, "mimeType": m, "size": None if b is None else str(len(b)), "modifiedTime": "2024-01-02T03:04:05+00:00"} for i, n, m, b in rows]
        return files, str(at + 2) if at + 2 < len(TREE[folder]) else None

    def get(self, key):
        for rows in TREE.values():
            for i, _, m, b in rows:
                if i == key and m != FOLDER:
                    return b
        raise KeyError(key)


def client():
    return Client()


class Stored:
    """A drive in a folder of this machine, which tasks share: two changes or entries a page."""

    def __init__(self, base):
        self.base = base

    def _all(self):
        import json
        import os

        out = {}
        for name in sorted(os.listdir(f"{self.base}/log")):
            with open(f"{self.base}/log/{name}") as f:
                out[name] = json.load(f)
        return out

    def _say(self, entry):
        """Append to the log; two writers take different numbers."""
        import datetime
        import json
        import os

        n = len(os.listdir(f"{self.base}/log"))
        entry["modifiedTime"] = datetime.datetime.now(datetime.timezone.utc).isoformat()
        with open(tmp := f"{self.base}/{os.getpid()}-{id(entry)}", "w") as f:
            json.dump(entry, f)
        while True:
            try:
                os.link(tmp, f"{self.base}/log/{n:08d}")
                break
            except FileExistsError:
                n += 1
        os.remove(tmp)

    def _now(self):
        state = {}
        for e in self._all().values():
            if e.get("removed"):
                state.pop(e["id"], None)
            else:
                state[e["id"]] = e
        return state

    def meta(self, key):
        return self._now().get(key)

    def list(self, folder, token):
        at, rows = int(token or 0), [e for e in self._now().values() if e["parents"] == [folder]]
        return rows[at : at + 2], str(at + 2) if at + 2 < len(rows) else None

    def get(self, key):
        with open(f"{self.base}/reads", "a") as f:
            f.write(key + "\n")
        if key not in self._now():
            raise KeyError(key)
        with open(f"{self.base}/data/{key}", "rb") as f:
            return f.read()

    def head(self):
        log = self._all()
        last = max(log, default="")
        return last, max((e["modifiedTime"] for e in log.values()), default="")

    def changes(self, token):
        rows = [{"token": n, "id": e["id"], "removed": e.get("removed", False)} for n, e in self._all().items() if n > token]
        return rows[:2], rows[1]["token"] if len(rows) > 2 else None

    def create(self, folder, name, data, key=None):
        import uuid

        key = key or uuid.uuid4().hex
        with open(f"{self.base}/data/{key}", "wb") as f:
            f.write(data)
        self._say({"id": key, "name": name, "mimeType": "text/plain", "size": str(len(data)), "parents": [folder]})
        return key

    def folder(self, parent, name):
        import uuid

        key = uuid.uuid4().hex
        self._say({"id": key, "name": name, "mimeType": FOLDER, "parents": [parent]})
        return key

    def move(self, key, folder, name):
        if name == "refuse.txt":
            raise OSError("the drive refuses this name")
        self._say(self._now()[key] | {"parents": [folder], "name": name})

    def delete(self, key):
        now = self._now()
        if key not in now:
            raise KeyError(key)
        for e in now.values():
            if e["parents"] == [key]:
                self.delete(e["id"])
        self._say({"id": key, "removed": True})


def stored(base):
    import os

    os.makedirs(f"{base}/log", exist_ok=True)
    os.makedirs(f"{base}/data", exist_ok=True)
    return Stored(base)
