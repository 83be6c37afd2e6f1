"""Sinks: Parquet, CSV, JSON, sparse triples, models and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_triples(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sparse matrix as ``(row_idx, col_idx, count)``, sorted inside files for run-length coding."""
    counts.select("row_idx", "col_idx", "count").repartition("row_idx").sortWithinPartitions("row_idx", "col_idx").write.mode(mode).parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, col_idx, count)`` as ``write_triples`` left it."""
    return spark.read.parquet(path).select("row_idx", "col_idx", "count")


def save_model(model, path: str) -> None:
    """A Spark ML model, overwriting an older one."""
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """A model of a Spark ML class as ``save_model`` left it."""
    return kind.load(path)


def markdown_report(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """Small tables as a markdown text; every section shows at most ``rows`` rows, as a report does."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in row) + " |" for row in df.limit(rows).collect()]
    return "\n".join(out) + "\n"


def pipeline_report(steps: dict[str, str | None], documents: DataFrame, at: str, models: dict[str, dict], results: dict[str, dict]) -> str:
    """A run as a JSON text: steps done and those that failed (with their error), the data's size and dates, measures of models and results."""
    first, last, n = documents.agg(F.min(at), F.max(at), F.count("*")).first()
    facts = {
        "pipeline_run": {"steps_completed": [s for s, error in steps.items() if error is None], "errors": [{"step": s, "error": e} for s, e in steps.items() if e is not None]},
        "data_summary": {"n_documents": n, "date_range": f"{first} to {last}" if n else None},
        "model_summary": models, "results_summary": results,
    }
    return json.dumps(facts, indent=2, default=str)
