"""The evaluation report of a scored table as Markdown, and the export of importances.

Only aggregates of fixed size come to the driver: metrics, ten deciles, a few
rows of errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as mt


def _table(rows: list, columns: list[str]) -> list[str]:
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "/").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(shown(r[c]) for c in columns) + " |" for r in rows)]


def evaluation_report(scored: DataFrame, threshold: float | None = None, top: int = 10, key: str = "pair_id") -> list[str]:
    """Lines of the report: data, metrics with their lights, confusion, deciles, the errors of most weight.

    ``scored`` has ``key``, ``y`` and ``score``; without a threshold the best
    that keeps the recall is taken.  An empty table gives a report that says so.
    """
    data = scored.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    lines = ["# Avaliação", "", f"Pares: {data.n}; positivos: {data.p}."]
    if not data.n:
        return lines + ["", "Sem pares, sem medidas."]
    at = mt.best_threshold(scored).first().threshold if threshold is None else threshold
    one = mt.roc_auc(scored).crossJoin(mt.average_precision(scored)).crossJoin(mt.confusion(scored, at)).crossJoin(mt.error_rates(scored, at).select("fp_share", "fn_share"))  # one row each
    judged = mt.verdict(one).first()
    lines += ["", "## Medidas", "", f"Limiar: {at:.4f}. Veredito: **{judged.veredito}**.", ""]
    lines += _table([{"medida": m, "valor": float(judged[m]), "cor": judged[f"cor_{m}"] if f"cor_{m}" in judged.asDict() else judged.cor_fn if m == "fn_share" else ""} for m in ("roc_auc", "average_precision", "precision", "recall", "f1", "fp_share", "fn_share")], ["medida", "valor", "cor"])
    lines += ["", "## Confusão", "", *_table([judged], ["tp", "fp", "fn", "tn"])]
    lines += ["", "## Decis", "", *_table(mt.deciles(scored, key).orderBy("decile").collect(), ["decile", "lowest", "highest", "pairs", "positives", "rate"])]
    for title, rows in (("Falsos positivos", mt.false_positives(scored, at, key, top)), ("Falsos negativos", mt.false_negatives(scored, at, key, top))):
        lines += ["", f"## {title}", "", *_table(rows.collect(), [key, "score"])]
    return lines


def write_report(scored: DataFrame, path: str, **more) -> None:
    """The report as one text file under ``path``."""
    scored.sparkSession.createDataFrame([("\n".join(evaluation_report(scored, **more)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def importance_table(importances: DataFrame) -> DataFrame:
    """``(position, feature, importance, block, share, running)``, the most important first; one row a feature."""
    ranked = mt.cumulative_importance(importances)
    return ranked.select("position", "feature", "importance", mt.group_of(F.col("feature")).alias("block"), "share", "running").orderBy("position")


def export_importances(importances: DataFrame, path: str) -> None:
    """``importance_table`` as CSV with a header."""
    importance_table(importances).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
