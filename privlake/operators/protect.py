"""Protection of texts: masking, pseudonyms, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from privlake.functions.spans import folded, with_boxes
from privlake.functions.text import canonical, canonical_all, encrypt, mask_value, token, value_hash


def rewrite(text: Column, entities: Column, replacement, union: bool = False) -> Column:
    """``text`` with every span replaced, from the end; a span that reaches into a later one already replaced is left.

    ``replacement`` maps an entity to a column.  ``union`` instead joins overlapping spans under one
    replacement, so no part of them stays readable.  The spans that count are told first, then the text is cut once at each.
    """
    size = F.length(text)
    kind = "array<struct<a:int,b:int,r:string>>"
    one = lambda x: F.struct(x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b"), x["r"].alias("r"))
    rows = lambda e: (e["debut"].alias("a"), e["fin"].alias("b"), replacement(e).alias("r"))
    if union:
        ordered = F.array_sort(F.transform(entities, lambda e: F.struct(*rows(e))))
        # a span that lies in what is already replaced moves the end only: its stretch is empty
        step = lambda at, x: (F.greatest(at, x["b"]), F.struct(F.greatest(at, x["a"]).cast("int").alias("a"), F.greatest(at, x["b"]).cast("int").alias("b"), F.when(x["a"] >= at, x["r"]).otherwise("").alias("r")), F.lit(True))
        kept = folded(ordered, F.lit(0), step, kind)
    else:
        ordered = F.array_sort(F.transform(entities, lambda e, i: F.struct((-e["debut"]).alias("k"), i.alias("i"), *rows(e))))
        ok = lambda at, x: (x["a"] < x["b"]) & (x["b"] <= size) & (x["b"] <= at)
        kept = F.reverse(folded(ordered, size + 1, lambda at, x: (F.when(ok(at, x), x["a"]).otherwise(at), one(x), ok(at, x)), kind))

    def cut(spans: Column) -> Column:
        before = lambda i: F.coalesce(F.when(i > 0, F.get(spans, i - 1)["b"]), F.lit(0))
        pieces = F.transform(spans, lambda x, i: F.concat(F.substr(text, before(i) + 1, F.greatest(x["a"] - before(i), F.lit(0))), x["r"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, before(F.size(spans)) + 1))

    return F.when(entities.isNotNull(), F.element_at(F.transform(F.array(kept), cut), 1))


def mask(text: Column, entities: Column) -> Column:
    return rewrite(text, entities, lambda e: mask_value(e["valeur"], e["type_entite"]))


def with_hashes(df: DataFrame, salt: str, ascii_only: bool = False) -> DataFrame:
    """Exploded rows (entity struct ``e``) with the hash and token of their values."""
    d = df.withColumn("empreinte_valeur", value_hash(canonical(F.col("e.valeur"), ascii_only), salt))
    return d.withColumn("jeton", token(F.col("empreinte_valeur"), F.col("e.type_entite")))


def pseudonymise(df: DataFrame, salt: str, text_col: str = "texte") -> DataFrame:
    """``df`` with ``texte_protege``: spans replaced by tokens.  Values are hashed within their row: no shuffle."""
    forms = canonical_all(F.transform("entites", lambda e: e["valeur"]))
    d = df.withColumn("_f", forms)
    named = F.transform("entites", lambda e, i: F.struct(
        e["debut"].alias("debut"), e["fin"].alias("fin"), token(value_hash(F.get("_f", i), salt), e["type_entite"]).alias("jeton")
    ))
    return d.withColumn("texte_protege", rewrite(F.col(text_col), named, lambda e: e["jeton"])).drop("_f")


def pseudonym_rows(entities: DataFrame, key: Column) -> DataFrame:
    """Rows for the pseudonym table, one for each hash; the clear value only encrypted."""
    d = entities.select("empreinte_valeur", "jeton", encrypt(F.col("e.valeur"), key).alias("valeur_chiffree"))
    return d.dropDuplicates(["empreinte_valeur"]).withColumn("cree_le", F.current_timestamp())


def protect(action: Column, text: Column, entities: Column, tokens: Column) -> Column:
    """Text by access action: whole, masked, tokens; null when refused.  Without entities the text is unchanged."""
    return F.when(action == "refus", F.lit(None).cast("string")).when((action == "complet") | (F.size(entities) == 0), text).when(
        action == "masque", mask(text, entities)
    ).when(action == "pseudonymise", tokens)


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_replaced(data: bytes, values: dict[str, str]) -> bytes:
    """A DOCX file with every value replaced, in header, footer, paragraphs and tables; a changed paragraph is one run."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ElementTree.register_namespace("w", _WORD[1:-1])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            part = old.read(name)
            if name.endswith(".xml") and name.startswith(("word/document", "word/header", "word/footer")):
                root = ElementTree.fromstring(part)
                for p in root.iter(f"{_WORD}p"):
                    runs = list(p.iter(f"{_WORD}t"))
                    text = "".join(t.text or "" for t in runs)
                    fresh = text
                    for v in sorted(values, key=lambda v: (-len(v), v)):
                        fresh = fresh.replace(v, values[v]) if v else fresh
                    if fresh != text:
                        for t in runs:
                            t.text = ""
                        runs[0].text = fresh
                part = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            new.writestr(name, part)
    return out.getvalue()


def protect_docx(files: DataFrame) -> DataFrame:
    """``files`` (cle, content, remplacements: map of value to replacement) with the rewritten content; an empty map changes nothing."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            content = [docx_replaced(bytes(c), dict(m)) if c is not None and m is not None and len(m) else c for c, m in zip(pdf["content"], pdf["remplacements"], strict=True)]
            yield pd.DataFrame({"cle": pdf["cle"], "content": content})

    return files.select("cle", "content", "remplacements").mapInPandas(run, "cle string, content binary")


RECTANGLE = "struct<page:int,x:int,y:int,largeur:int,hauteur:int>"


def redaction_boxes(entities: Column, boxes: Column) -> Column:
    """Rectangles to blacken: the boxes of all words that an entity overlaps, each once."""
    hit = F.flatten(F.transform(with_boxes(entities, boxes), lambda x: x["boites"]))
    return F.array_distinct(F.transform(hit, lambda b: F.struct(*[b[c].cast("int").alias(c) for c in ("page", "x", "y", "largeur", "hauteur")])))


def _blacken_image(data: bytes, rectangles: list) -> bytes:
    import io

    try:
        from PIL import Image, ImageDraw
    except ImportError as e:
        raise RuntimeError("redacting images needs Pillow") from e
    image = Image.open(io.BytesIO(data))
    kind, pen = image.format or "PNG", ImageDraw.Draw(image)
    for r in rectangles:
        pen.rectangle([r["x"], r["y"], r["x"] + r["largeur"], r["y"] + r["hauteur"]], fill=0)
    out = io.BytesIO()
    image.save(out, kind)
    return out.getvalue()


def _blacken_pdf(data: bytes, rectangles: list, dpi: int = 300) -> bytes:
    """Text under the rectangles is removed, not only covered; boxes are in pixels of the scan."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("redacting PDF needs PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as pdf:
        for r in rectangles:
            page = pdf[max(0, min(pdf.page_count - 1, r["page"] - 1))]
            x, y, w, h = (r[c] * 72.0 / dpi for c in ("x", "y", "largeur", "hauteur"))
            page.add_redact_annot(fitz.Rect(x, y, x + w, y + h), fill=(0, 0, 0))
        for page in pdf:
            page.apply_redactions()
        return pdf.tobytes()


PAINTERS = {"application/pdf": _blacken_pdf, "image/png": _blacken_image, "image/jpeg": _blacken_image, "image/tiff": _blacken_image}


def redact_files(files: DataFrame, painters: dict | None = None) -> DataFrame:
    """``files`` (cle, type_mime, content, rectangles) with their rectangles blackened; without any, the bytes stay.

    A type without a painter, or a painter whose library is missing, is an error: content is never passed on unprotected.
    """
    import pandas as pd

    known = PAINTERS if painters is None else painters

    def run(batches):
        for pdf in batches:
            out = []
            for kind, content, rectangles in zip(pdf["type_mime"], pdf["content"], pdf["rectangles"], strict=True):
                if rectangles is None or not len(rectangles) or content is None:
                    out.append(content)
                elif kind in known:
                    out.append(known[kind](bytes(content), [dict(r) for r in rectangles]))
                else:
                    raise ValueError(f"can't redact {kind}")
            yield pd.DataFrame({"cle": pdf["cle"], "content": out})

    d = files.select("cle", "type_mime", "content", F.col("rectangles").cast(f"array<{RECTANGLE}>"))
    return d.mapInPandas(run, "cle string, content binary")
