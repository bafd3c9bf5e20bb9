"""End-to-end plans: files to catalogued, classified documents; requests to protected texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from privlake.functions.normalize import normalise
from privlake.functions.spans import entries, page_of, to_source
from privlake.functions.text import canonical, value_hash
from privlake.operators import detect, merge, ner, policy, protect


def analyse_texts(df: DataFrame, text_col: str = "texte", today: Column | None = None, ocr: bool = False, backend: str = "aucun") -> DataFrame:
    """``df`` with ``normalise`` (text and offsets), ``entites`` (positions in the normalised text) and ``niveau_max``."""
    d = df.withColumn("normalise", normalise(F.col(text_col))).withColumn("_t", F.col("normalise.texte"))
    d = detect.detect_ocr(d, "_t", "candidats", today) if ocr else detect.detect(d, "_t", "candidats", today)
    if backend != "aucun":
        d = ner.ner_entities(d, "_t", "_ner", backend).withColumn("candidats", F.concat("candidats", "_ner"))
    return merge.analyse(d.drop("_t", "_ner"))


def source_positions(analysed: DataFrame) -> DataFrame:
    """``entites`` with positions in the source text."""
    offsets = F.col("normalise.map_offsets")
    moved = F.transform("entites", lambda e: e.withField("debut", to_source(e["debut"], offsets)).withField("fin", to_source(e["fin"], offsets)))
    return analysed.withColumn("entites", moved)


def detected_rows(analysed: DataFrame, salt: str, id_col: str = "id", pages: Column | None = None) -> DataFrame:
    """Rows of the entity table: hashes, never values."""
    none = F.lit(None).cast("array<struct<numero:int,debut:int,fin:int>>")
    d = analysed.select(F.col(id_col).alias("document_id"), F.explode(entries(F.col("entites"))).alias("e"), (none if pages is None else pages).alias("_p"))
    page = page_of(F.col("e.debut"), F.col("_p"))
    return d.select(
        "document_id", F.col("e.type_entite").alias("type_entite"), value_hash(canonical(F.col("e.valeur")), salt).alias("empreinte_valeur"),
        F.col("e.debut").alias("position_debut"), F.col("e.fin").alias("position_fin"), page.cast("smallint").alias("page"),
        F.col("e.niveau").alias("niveau_sensibilite"), F.col("e.score").cast("float").alias("score_confiance"), F.col("e.methode").alias("methode"),
    )


def restitute(requests: DataFrame, documents: DataFrame, analysed: DataFrame, matrix: DataFrame, salt: str) -> DataFrame:
    """Decided requests with ``contenu``: whole, masked or tokenised by the matrix; null unless the code is 200.

    Texts are joined for allowed requests only.  Entities at or above the document's own level are replaced.
    """
    decided = policy.decide(requests, documents, matrix)
    wanted = decided.where("code = 200").select("document_id").distinct()
    texts = analysed.join(wanted, F.col("id") == F.col("document_id"), "left_semi")
    texts = texts.withColumn("entites", merge.at_least(F.col("entites"), F.col("niveau_max")))
    texts = protect.pseudonymise(texts, salt).select(F.col("id").alias("document_id"), "texte", "entites", "texte_protege")
    d = decided.join(texts, "document_id", "left")
    content = protect.protect(F.col("action"), F.col("texte"), F.col("entites"), F.col("texte_protege"))
    return d.select(*decided.columns, F.when(F.col("code") == 200, content).alias("contenu"))
