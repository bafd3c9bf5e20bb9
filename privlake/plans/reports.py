"""Report files: CSV, JSON and Markdown of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from privlake.schema import rank


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A table of at most ``limit`` rows with padded cells; reports are small, larger results are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [df.columns, *[[text(v) for v in r] for r in rows]]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, cells[1:])])


def score_table(scores: DataFrame) -> DataFrame:
    """Scores as a report has them: types by name, then levels by rank, then the whole; figures with four decimals."""
    place = F.when(F.col("axe") == "type", 0).when(F.col("axe") == "niveau", 1).otherwise(2)
    figures = [F.format_string("%.4f", F.col(c)).alias(c) for c in ("precision", "rappel", "f1", "f2")]
    d = scores.select("axe", "cle", *figures, F.col("support").cast("long").alias("support"), place.alias("_p"), F.when(F.col("axe") == "niveau", rank(F.col("cle"))).otherwise(0).alias("_r"))
    return d.orderBy("_p", "_r", "cle").drop("_p", "_r")


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder of CSV (with a header) or JSON lines."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)
