"""Sources, encodings, extraction, redaction, tasks: what the first tests leave out."""

import logging

import pytest
from pyspark.sql import functions as F

from privlake.functions import spans as sp, text as tx
from privlake.functions.normalize import normalise
from privlake.operators import catalog, ner, protect, statistics as stats
from privlake.schema import SOURCE
from privlake.sources import drive, files


def test_drive(spark):
    got = files.list_sources(spark, [{"id": "s", "type": "gdrive", "configuration": {"client": "tests.fake_drive:client", "dossier": "racine"}}])
    rows = {r.cle: (bytes(r.content), r.type_mime, r.taille) for r in got.collect()}
    assert rows == {
        "1:a.txt": (b"un", "text/plain", 2), "2:b.csv": (b"deux", "text/csv", 4), "3:dossier/c.txt": ("été".encode(), "text/plain", 5), "4:dossier/plus bas/d.txt": (b"quatre", None, 6),
        "5:dossier/plus bas/e.txt": (b"", "text/plain", 0), "6:dossier/plus bas/f.txt": (b"six", "text/plain", 3),
    }
    client = drive.load("tests.fake_drive:client")
    assert drive.read(client, "3:autre nom.txt") == "été".encode()
    with pytest.raises(FileNotFoundError):
        drive.read(client, "99:x")


def test_written_files_read_back(spark, tmp_path):
    rows = [("a.txt", b"1"), ("d/e/b.bin", bytes(range(256))), ("vide", b""), ("nul", None)]
    d = spark.createDataFrame(rows, "cle string, content binary")
    for _ in range(2):  # again: the same files
        files.CONNECTORS["local"].write(d, {"chemin": str(tmp_path / "out")})
    got = {r.cle: bytes(r.content or b"") for r in files.list_files(spark, str(tmp_path / "out")).collect()}
    assert got == {k: v or b"" for k, v in rows}
    assert files.read_file(spark, str(tmp_path / "out"), "d/e/b.bin") == bytes(range(256)) and files.read_file(spark, str(tmp_path / "out"), "vide") == b""
    with pytest.raises(FileNotFoundError):
        files.read_file(spark, str(tmp_path / "out"), "absent")
    for bad in ("../x", "a/../../x"):
        with pytest.raises(ValueError):
            files.read_file(spark, str(tmp_path / "out"), bad)
        with pytest.raises(ValueError):
            files.write_files(spark.createDataFrame([(bad, b"")], "cle string, content binary"), str(tmp_path / "out"))


@pytest.mark.parametrize(("text", "encoding"), [
    ("Thérèse Kouamé,Abidjan", "latin-1"), ("l’été à 5 €", "cp1252"), ("“guillemets” – œuvre", "cp1252"), ("déjà été à l'école", "cp850"), ("Thérèse et Noël", "utf-16"),
    ("Awa Diouf, née à Thiès", "utf-16-le"), ("ascii", "ascii"), ("", "utf-8"), ("été € ’", "utf-8"), ("﻿marque", "utf-8"),
])
def test_encodings(spark, text, encoding):
    d = spark.createDataFrame([(text.encode(encoding),)], "b binary")
    assert d.select(tx.decode_bytes(F.col("b"))).first()[0] == text


def test_undecodable_bytes_are_text(spark):
    d = spark.createDataFrame([(bytes(range(128, 160)),), (None,)], "b binary")
    assert [r[0] is None for r in d.select(tx.decode_bytes(F.col("b"))).collect()] == [False, True]


def test_pages_in_normalised_positions(spark):
    pages = ["page  un\n\n", "deux\r\ntrois  \n\n", "fin"]
    d = spark.createDataFrame([("".join(pages), [len(p) for p in pages])], "t string, n array<int>").withColumn("x", normalise("t"))
    r = d.select("x.texte", sp.page_bounds(F.col("n"), F.col("x.map_offsets")).alias("p")).first()
    assert [r.texte[p.debut : p.fin].strip() for p in r.p] == ["page un", "deux\ntrois", "fin"] and [p.numero for p in r.p] == [1, 2, 3]
    assert r.p[0].debut == 0 and all(a.fin == b.debut for a, b in zip(r.p, r.p[1:], strict=False))


def test_thin_pdf_and_images_wait_for_ocr(spark):
    thick, thin = ["x" * 150, "y" * 80], ["x", ""]
    readers = {files.PDF: ("pdf", lambda data: thick if data.endswith(b"1") else thin)}
    rows = [("a.pdf", b"%PDF1"), ("b.pdf", b"%PDF2"), ("c.png", b"\x89PNG"), ("d.bin", b"PK\x03\x04")]
    d = spark.createDataFrame(rows, "cle string, content binary").withColumn("type_mime", F.lit(None).cast("string"))
    got = {r.cle: (r.texte, r.methode, list(r.pages)) for r in files.extract(d, readers).collect()}
    assert got["a.pdf"] == ("x" * 150 + "\n\n" + "y" * 80, "pdf", [152, 80])
    assert got["b.pdf"][:2] == (None, "ocr") and got["c.png"][:2] == (None, "ocr") and got["d.bin"][:2] == (None, "echec")


def test_redaction(spark):
    boxes = "array<struct<debut:int,fin:int,page:int,x:int,y:int,largeur:int,hauteur:int>>"
    d = spark.createDataFrame(
        [("a", "image/png", b"img", [(0, 5), (4, 8)], [(0, 3, 1, 10, 20, 30, 5), (4, 8, 1, 50, 20, 30, 5), (9, 12, 2, 0, 0, 9, 9)]), ("b", "image/png", b"img", [], [(0, 3, 1, 1, 1, 1, 1)]), ("c", "x/y", b"z", [], [])],
        f"cle string, type_mime string, content binary, e array<struct<debut:int,fin:int>>, b {boxes}",
    ).withColumn("rectangles", protect.redaction_boxes(F.col("e"), F.col("b")))
    assert [(r.page, r.x) for r in d.first().rectangles] == [(1, 10), (1, 50)]
    paint = {"image/png": lambda data, r: data + str(sorted(x["x"] for x in r)).encode()}
    assert {r.cle: bytes(r.content) for r in protect.redact_files(d, paint).collect()} == {"a": b"img[10, 50]", "b": b"img", "c": b"z"}
    with pytest.raises(Exception, match="can't redact"):
        protect.redact_files(d, {}).collect()


def test_task_queue(spark):
    t0 = "2024-01-01 00:00:00"
    queue = spark.createDataFrame([], catalog.QUEUE)
    queue = catalog.enqueue(queue, spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), t0)
    queue = catalog.enqueue(queue, spark.createDataFrame([("b",), ("c",)], "id string"), t0)
    assert sorted(r.document_id for r in queue.collect()) == ["a", "b", "c"]
    docs = spark.createDataFrame([(i, "decouvert", 0, "x") for i in "abcd"], "id string, statut string, tentatives smallint, motif_echec string")
    now, due = catalog.start_analyses(docs, queue, t0)
    assert {r.id: (r.statut, r.tentatives) for r in now.collect()} == {"a": ("en_analyse", 0), "b": ("en_analyse", 0), "c": ("en_analyse", 0), "d": ("decouvert", 0)} and due.count() == 3
    waits = []
    for _ in range(3):
        queue = catalog.finish_analyses(queue, spark.createDataFrame([("a", True), ("b", False)], "document_id string, reussi boolean"), t0)
        waits.append({r.document_id: (r.essais, r.s) for r in queue.select("document_id", "essais", (F.unix_timestamp("pret_le") - F.unix_timestamp(F.lit(t0))).alias("s")).collect()})
    assert waits == [{"b": (1, 5), "c": (0, 0)}, {"b": (2, 10), "c": (0, 0)}, {"c": (0, 0)}]
    assert catalog.start_analyses(docs, queue, "2023-01-01")[1].count() == 0


def test_sources_are_checked(spark):
    table = spark.createDataFrame([], SOURCE)
    out = catalog.create_source(spark, table, "local", "Dossiers", {"chemin": "/x"}).first()
    assert (out.type, out.libelle, out.configuration, out.frequence_cron, out.actif) == ("local", "Dossiers", '{"chemin": "/x"}', "0 2 * * *", True)
    for bad in (("ftp", "x", {}), ("local", " ", {}), ("local", "x", "y")):
        with pytest.raises(ValueError):
            catalog.create_source(spark, table, *bad)


def test_keys_and_base64(spark):
    assert tx.cipher_key("00" * 16) == bytes(16) and tx.cipher_key(" MDEyMzQ1Njc4OWFiY2RlZg== ") == b"0123456789abcdef" and tx.cipher_key("clé de 24 octets, oui.x") == "clé de 24 octets, oui.x".encode()
    with pytest.raises(ValueError):
        tx.cipher_key("court")
    d = spark.createDataFrame([("TQ==",), ("TWE=",), ("TWFu",), ("",), ("TQ=",), ("T Q==",), ("TWFu!",), (None,)], "t string")
    assert [None if r[0] is None else bytes(r[0]) for r in d.select(tx.base64_bytes(F.col("t"))).collect()] == [b"M", b"Ma", b"Man", b"", None, None, None, None]


def test_the_two_canonical_forms_differ_in_marks(spark):
    mark = "a⃗b"  # a combining mark beyond U+036F
    d = spark.createDataFrame([(mark,), (" É  b ",), (None,)], "t string")
    got = [(r.x, r.y) for r in d.select(tx.canonical(F.col("t")).alias("x"), tx.stored_canonical(F.col("t")).alias("y")).collect()]
    assert got == [("ab", mark), ("e b", "e b"), (None, None)]


def test_labels_of_models(spark):
    d = spark.createDataFrame([(x,) for x in ("PER", "location", "NRP", "EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS", "MISC")], "l string")
    assert [r[0] for r in d.select(ner.entity_type(F.col("l"))).collect()] == ["NOM_PERSONNE", "LOCALITE", "LOCALITE", "EMAIL", "CARTE_BANCAIRE", "ADRESSE_IP", None]


def test_a_missing_model_is_said(caplog):
    ner._LOADED.clear()
    with caplog.at_level(logging.WARNING):
        assert ner.finder("presidio")("Awa") == []
    assert "presidio" in caplog.text
    ner._LOADED.clear()


def test_corpus_tables_of_an_empty_corpus(spark):
    from privlake.schema import ANNOTATION

    assert stats.corpus_tables(spark.createDataFrame([], ANNOTATION)).count() == 0


def test_a_missing_matrix_refuses(spark, tmp_path):
    from privlake.operators import policy
    from privlake.schema import policy_matrix

    docs = spark.createDataFrame([("d", "analyse", "faible")], "id string, statut string, niveau_max string")
    asked = spark.createDataFrame([("conformite", "d")], "role string, document_id string")
    assert policy.decide(asked, docs, policy.load(spark, str(tmp_path / "absent"))).first().code == 403
    policy_matrix(spark).write.parquet(str(tmp_path / "matrix"))
    assert policy.decide(asked, docs, policy.load(spark, str(tmp_path / "matrix"))).first().code == 200
