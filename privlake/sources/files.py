"""File sources: listing, reading, content types, extraction.

Listing and reading are Spark's ``binaryFile`` source; a store that Hadoop
doesn't know plugs in through ``Connector``.  Extraction dispatches by the
content's own signature; each binary format is one Arrow-free ``mapInPandas``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from privlake.functions.spans import folded
from privlake.functions.text import decode_bytes

# --- fixed values: content types ---
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TEXT_TYPES = ("text/plain", "text/csv", "application/json", "text/html", "text/markdown")
IMAGE_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/tiff", "image/bmp", "image/webp")
EXTENSIONS = {
    ".pdf": PDF, ".docx": DOCX, ".csv": "text/csv", ".txt": "text/plain", ".json": "application/json", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".png": "image/png",
}
RESOURCE = "cle string, taille bigint, date_modification timestamp, type_mime string, content binary"
EXTRACTED = "cle string, texte string, methode string, pages array<int>"
MIN_CHARS_A_PAGE = 100


@dataclass(frozen=True)
class Connector:
    """A driver: ``list`` gives rows of RESOURCE for a configuration (``content`` may be left out of a listing), ``write``
    stores rows (cle, content)."""

    list: Callable[[SparkSession, dict], DataFrame]
    write: Callable[[DataFrame, dict], None] | None = None


def _hadoop(root: str, spark: SparkSession) -> tuple[object, object]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """All files below ``root`` by key (path relative to it).  A missing folder lists nothing."""
    fs, path = _hadoop(root, spark)
    if not fs.exists(path):
        return spark.createDataFrame([], RESOURCE)
    base = fs.getFileStatus(path).getPath().toString().rstrip("/") + "/"
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = F.substr("path", F.instr("path", F.lit(base)) + len(base))
    content = F.col("content") if with_content else F.lit(None).cast("binary")
    none = F.lit(None).cast("string")
    found = d.select(key.alias("cle"), F.col("length").alias("taille"), F.col("modificationTime").alias("date_modification"), none.alias("type_mime"), content.alias("content"))
    # the source gives no row for an empty file, but its file index, which the driver holds anyway, has it
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in d.inputFiles()], "path string")
    empty = listed.join(d.select("path"), "path", "left_anti").select(
        key.alias("cle"), F.lit(0).cast("long").alias("taille"), F.lit(None).cast("timestamp").alias("date_modification"), none.alias("type_mime"), F.lit(b"").alias("content")
    )
    return found.unionByName(empty)


def escapes(key: Column) -> Column:
    """True for a key that leaves the root once its dots are resolved."""
    parts = F.filter(F.split(key, "/"), lambda p: ~p.isin("", "."))
    depth = lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), depth)["low"] < 0


def read_file(spark: SparkSession, root: str, key: str) -> bytes:
    """The bytes of one file below ``root``; a key that leaves the root, or isn't there, is an error."""
    if spark.range(1).select(escapes(F.lit(key))).first()[0]:
        raise ValueError(f"key leaves the root: {key}")
    path = f"{root.rstrip('/')}/{key}"
    fs, at = _hadoop(path, spark)
    if not fs.exists(at):
        raise FileNotFoundError(key)
    if fs.getFileStatus(at).getLen() == 0:
        return b""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def write_files(files: DataFrame, root: str) -> None:
    """Write rows (cle, content) below ``root``, a folder or store that all executors reach, a file a row.

    A task that runs again writes its files again.  Keys that leave the root are refused before anything is written.
    """
    bad = files.where(escapes(F.col("cle"))).select("cle").limit(1).collect()
    if bad:
        raise ValueError(f"key leaves the root: {bad[0].cle}")

    def run(rows) -> None:
        from pyarrow import fs

        # Hadoop writes a local root as file:/x
        store, base = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "/", root))
        for r in rows:
            path = f"{base}/{r.cle}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(bytes(r.content or b""))

    files.select("cle", "content").foreachPartition(run)


def drive(spark: SparkSession, configuration: dict) -> DataFrame:
    """Rows of RESOURCE from a drive, through ``DriveSource``; ``client`` names a factory as ``module:function``."""
    from privlake.sources.drive import DriveSource

    spark.dataSource.register(DriveSource)
    return spark.read.format(DriveSource.name()).options(client=configuration["client"], dossier=configuration["dossier"]).load()


def write_drive(files: DataFrame, configuration: dict) -> None:
    """Write rows (cle, content) below a folder of a drive, all or none."""
    from privlake.sources.drive import DriveSource

    files.sparkSession.dataSource.register(DriveSource)
    d = files.select("cle", "content").write.format(DriveSource.name()).options(client=configuration["client"], dossier=configuration["dossier"])
    d.mode("append").save()


def _bucket(c: dict) -> str:
    return f"s3a://{c['bucket']}/{c.get('prefixe', '')}"


CONNECTORS: dict[str, Connector] = {
    "local": Connector(lambda spark, c: list_files(spark, c["chemin"]), lambda df, c: write_files(df, c["chemin"])),
    "s3": Connector(lambda spark, c: list_files(spark, _bucket(c)).where("NOT endswith(cle, '/')"), lambda df, c: write_files(df, _bucket(c).replace("s3a://", "s3://"))),
    "gdrive": Connector(drive, write_drive),
}


def list_sources(spark: SparkSession, sources: list[dict], connectors: dict[str, Connector] | None = None) -> DataFrame:
    """Rows of all sources (id, type, configuration), with ``source_id``; an unknown type is an error."""
    known = CONNECTORS | (connectors or {})
    frames = []
    for s in sources:
        if s["type"] not in known:
            raise ValueError(f"unknown source type: {s['type']}")
        frames.append(known[s["type"]].list(spark, s["configuration"]).withColumn("source_id", F.lit(s["id"])))
    return reduce(DataFrame.unionByName, frames)


def content_type(content: Column, announced: Column, name: Column) -> Column:
    """The effective type: signature, then the announced type, then the extension, then plain text."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    said = F.lower(F.trim(F.substring_index(announced, ";", 1)))
    low = F.lower(F.coalesce(name, F.lit("")))
    out = (
        F.when(head(4) == "25504446", PDF).when(head(3) == "FFD8FF", "image/jpeg").when(head(4) == "89504E47", "image/png")
        .when(head(4).isin("49492A00", "4D4D002A"), "image/tiff").when(head(4) == "504B0304", DOCX)
        .when(said.isin(*IMAGE_TYPES, *TEXT_TYPES, PDF, DOCX), said)
    )
    for extension, kind in EXTENSIONS.items():
        out = out.when(low.endswith(extension), kind)
    return out.otherwise("text/plain")


def _docx_text(data: bytes) -> str:
    """Header, footer, paragraphs, then tables (cells joined by ' | '), a line each."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    words = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))
    lines: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))
        for n in sorted(names, key=lambda n: "footer" in n):
            lines += [words(p) for p in ElementTree.fromstring(z.read(n)).iter(f"{w}p")]
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        lines += [words(p) for p in body.findall(f"{w}p")]
        for t in body.findall(f"{w}tbl"):
            lines += [" | ".join("\n".join(words(p) for p in c.iter(f"{w}p")) for c in r.findall(f"{w}tc")) for r in t.findall(f"{w}tr")]
    return "\n".join(x for x in lines if x.strip())


def _pdf_pages(data: bytes) -> list[str]:
    """The text layer of each page, by the first PDF library there is."""
    import io

    try:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as pdf:
            return [page.get_text("text") or "" for page in pdf]
    except ImportError:
        pass
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs PyMuPDF or pdfplumber") from e
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


def needs_ocr(characters: Column, pages: Column) -> Column:
    """Too few characters a page for a text layer."""
    return characters / F.greatest(pages, F.lit(1)) < MIN_CHARS_A_PAGE


#: Readers of binary formats: the texts of the pages; formats without pages have one.
READERS: dict[str, tuple[str, Callable[[bytes], list[str]]]] = {DOCX: ("docx", lambda data: [_docx_text(data)]), PDF: ("pdf", _pdf_pages)}
PAGE_BREAK = "\n\n"


def extract(resources: DataFrame, readers: dict[str, tuple[str, Callable[[bytes], list[str]]]] | None = None) -> DataFrame:
    """(cle, texte, methode, pages): text formats in the JVM, binary ones by their reader; ``pages`` has the lengths of the
    pages with their breaks.

    Failures have method 'echec' and a null text; images, and PDF files whose text layer is too thin, have 'ocr': their
    words come from elsewhere, through ``assemble_words``.
    """
    known = READERS if readers is None else readers
    d = resources.withColumn("_type", content_type(F.col("content"), F.col("type_mime"), F.col("cle")))
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    plain = d.where(empty | F.col("_type").isin(*TEXT_TYPES)).select("cle", F.when(empty, F.lit("")).otherwise(decode_bytes(F.col("content"))).alias("texte"), F.when(empty, "aucune").otherwise("texte").alias("methode"))
    plain = plain.withColumn("pages", F.when(F.col("methode") == "aucune", F.array().cast("array<int>")).otherwise(F.array(F.length("texte"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, kind, data in zip(pdf["cle"], pdf["_type"], pdf["content"], strict=True):
                method, reader = known.get(kind, ("ocr" if kind in IMAGE_TYPES else "echec", None))
                try:
                    pages = reader(bytes(data)) if reader else None
                except Exception:  # noqa: BLE001  one broken file doesn't stop a scan
                    pages, method = None, "echec"
                broken = [x + PAGE_BREAK for x in pages[:-1]] + pages[-1:] if pages else []
                rows.append((key, "".join(broken) if pages is not None else None, method, [len(x) for x in broken]))
            yield pd.DataFrame(rows, columns=["cle", "texte", "methode", "pages"])

    binary = d.where(~empty & ~F.col("_type").isin(*TEXT_TYPES)).select("cle", "_type", "content").mapInPandas(run, EXTRACTED)
    thin = (F.col("methode") == "pdf") & needs_ocr(F.length("texte"), F.size("pages"))
    binary = binary.withColumns({"methode": F.when(thin, "ocr").otherwise(F.col("methode")), "texte": F.when(~thin | thin.isNull(), F.col("texte"))})
    return plain.unionByName(binary)


def assemble_words(words: DataFrame) -> DataFrame:
    """Text of pages from words in reading order (doc, page, ligne, rang, mot, confiance): words joined by a space, lines by a
    line end, pages by two; with each word's place and the mean confidence."""
    row = F.struct("page", "ligne", "rang", "mot", "confiance")
    d = words.groupBy("doc").agg(F.sort_array(F.collect_list(row)).alias("w"), F.avg("confiance").alias("confiance"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("l"))

    def step(a: Column, x: Column) -> tuple[Column, Column, Column]:
        page, line = x["page"].cast("int"), x["ligne"].cast("int")
        gap = F.when(a["p"].isNull(), "").when(page != a["p"], "\n\n").when(line != a["l"], "\n").otherwise(" ")
        begin = a["n"] + F.length(gap)
        end = begin + F.length(x["mot"])
        one = F.struct(F.concat(gap, x["mot"]).alias("t"), begin.alias("debut"), end.alias("fin"), page.alias("page"))
        return F.struct(end.alias("n"), page.alias("p"), line.alias("l")), one, F.lit(True)

    d = d.withColumn("a", folded(F.col("w"), start, step, "array<struct<t:string,debut:int,fin:int,page:int>>"))
    boxes = F.transform("a", lambda x: F.struct(x["debut"].alias("debut"), x["fin"].alias("fin"), x["page"].alias("page")))
    return d.select("doc", F.array_join(F.transform("a", lambda x: x["t"]), "").alias("texte"), boxes.alias("boites"), "confiance")


def read_annotations(spark: SparkSession, path: str, partition: str | None = None) -> DataFrame:
    from privlake.schema import ANNOTATION

    d = spark.read.schema(ANNOTATION).json(path)
    return d if partition is None else d.where(F.col("partition") == partition)


def read_scan_index(spark: SparkSession, path: str) -> DataFrame:
    from privlake.schema import SCAN_INDEX

    return spark.read.schema(SCAN_INDEX).json(path)
