"""Streams: the retry machine against a fold, a drive that is read across restarts, and written all or not at all."""

import datetime as dt
import random
from collections import Counter

import pytest

from privlake.sources import drive, files
from privlake.streaming import retries

EVENTS = "document_id string, evenement string, instant timestamp"


@pytest.fixture(scope="module")
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, retries.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def test_a_stream_of_outcomes_gives_what_a_fold_gives(stateful, tmp_path):
    spark, r, start = stateful, random.Random(6), dt.datetime(2024, 1, 1)
    kinds = ["tache", "tache", "echec", "echec", "reussi", "autre"]
    events = sorted(((f"d{r.randrange(12)}", r.choice(kinds), start + dt.timedelta(milliseconds=r.randrange(120_000))) for _ in range(500)), key=lambda e: e[2])
    events += [(None, "tache", start), ("d1", "tache", None)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(0, len(events), 170):
        spark.createDataFrame(events[k : k + 170], EVENTS).coalesce(1).write.mode("append").parquet(source)
        # a query of its own for each part: the state, its timers and the place in the stream outlive it
        q = retries.transitions(spark.readStream.schema(EVENTS).parquet(source), "1 second").writeStream.format("parquet")
        q.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    until = max(e[2] for e in events if e[2]) - dt.timedelta(seconds=1)
    log = spark.read.schema(retries.TRANSITIONS).parquet(out)
    plain = retries.fold(spark.createDataFrame(events, EVENTS), until.replace(tzinfo=dt.timezone.utc))
    got, want = (Counter(map(tuple, d.collect())) for d in (log, plain))
    assert got == want and {e for _, e, _, _ in want} == {"en_file", "attend", "reprise", "abandonne", "termine"}
    assert sorted(map(tuple, retries.waiting(log).collect())) == sorted(map(tuple, retries.waiting(plain).collect()))


@pytest.mark.parametrize(("events", "want"), [
    ([("tache", 0), ("tache", 1), ("echec", 2), ("echec", 3), ("reussi", 8)], ["en_file 0 0", "attend 1 7", "reprise 1 7", "termine 1 8"]),
    ([("tache", 0), ("echec", 0), ("echec", 5), ("echec", 14), ("echec", 15)], ["en_file 0 0", "attend 1 5", "reprise 1 5", "attend 2 15", "reprise 2 15", "abandonne 3 15"]),
    ([("echec", 0), ("reussi", 1)], []),
    ([("tache", 0), ("echec", 1), ("tache", 30)], ["en_file 0 0", "attend 1 6", "reprise 1 6"]),
])
def test_transitions(events, want):
    state, out = None, []
    for event, second in events:
        state, more = retries.step(state, event, second * 1_000_000)
        out += more
    assert [f"{e} {n} {t // 1_000_000}" for e, n, t in out] == want


def filled(tmp_path):
    client = drive.load(f"tests.fake_drive:stored:{tmp_path}/drive")
    client.create("racine", "a.txt", b"un", "a")
    inner = client.folder("racine", "dossier")
    client.create(inner, "b.txt", b"deux", "b")
    client.create("ailleurs", "c.txt", b"trois", "c")
    return client, inner, {"client": f"tests.fake_drive:stored:{tmp_path}/drive", "dossier": "racine"}


def reads(tmp_path):
    return Counter((tmp_path / "drive" / "reads").read_text().split())


def test_a_drive_is_streamed_once_across_restarts(spark, tmp_path):
    client, inner, options = filled(tmp_path)
    spark.dataSource.register(drive.DriveSource)

    def run():
        q = spark.readStream.format("privlake_drive").options(**options).load().writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.cle, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a:a.txt", b"un"), ("b:dossier/b.txt", b"deux")]
    assert run() == [("a:a.txt", b"un"), ("b:dossier/b.txt", b"deux")] and reads(tmp_path) == {"a": 1, "b": 1}
    deep = client.folder(inner, "plus bas")
    client.create(deep, "d.txt", b"quatre", "d")
    client.create("ailleurs", "e.txt", b"cinq", "e")
    client.create("racine", "f.txt", b"six", "f")
    client.delete("f")
    after = run()
    assert after[2:] == [("d:dossier/plus bas/d.txt", b"quatre")] and reads(tmp_path) == {"a": 1, "b": 1, "d": 1}
    client.create("racine", "a.txt", b"un de plus", "a")  # changed in place
    assert ("a:a.txt", b"un de plus") in run() and reads(tmp_path)["a"] == 2


def test_writing_to_a_drive(spark, tmp_path):
    client, inner, options = filled(tmp_path)
    d = spark.createDataFrame([("x.txt", b"1"), ("dossier/y.txt", b"2"), ("neuf/z/z.txt", None)], "cle string, content binary").repartition(3)
    files.CONNECTORS["gdrive"].write(d, options)
    got = {r.cle.split(":", 1)[1]: bytes(r.content) for r in files.drive(spark, options).collect()}
    assert got == {"a.txt": b"un", "dossier/b.txt": b"deux", "x.txt": b"1", "dossier/y.txt": b"2", "neuf/z/z.txt": b""}
    assert not [f for f in client._now().values() if f["name"].startswith(drive.STAGING)]


@pytest.mark.parametrize("bad", ["../dehors.txt", "refuse.txt"])  # one fails in its task, one when the job commits
def test_an_aborted_write_leaves_nothing(spark, tmp_path, bad):
    client, _, options = filled(tmp_path)
    before = set(client._now())
    d = spark.createDataFrame([("x.txt", b"1"), ("n/y.txt", b"2"), (bad, b"3")], "cle string, content binary").repartition(3)
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.CONNECTORS["gdrive"].write(d, options)
    left = {f["name"] for k, f in client._now().items() if k not in before and f["mimeType"] != drive.FOLDER}
    assert left == set() and not [f for f in client._now().values() if f["name"].startswith(drive.STAGING)]
