"""Runnable jobs: whole pipelines from tables to result files.

``python -m sylvan.plans.jobs NAME SF_DIR OUT`` runs one.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import acquire, qa, reports, screening
from ..sources import adapters as A
from ..sources import files
from . import catalog as C


def sampling(spark: SparkSession, sf_dir: str, start: str = "1996-01-01", end: str = "1997-01-01") -> dict[str, DataFrame]:
    """Band values at points of the clear scenes of a period that have a cloud image."""
    scenes = acquire.save_first(acquire.scene_source(A.scenes(spark, sf_dir), start, end), A.clouds(spark, sf_dir))
    return {"samples": acquire.sample(scenes, A.pixels(spark, sf_dir))}


def spatial_qa(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sweep over all settings, the best of them, and the records flagged by it."""
    base = C.neighbours(spark, sf_dir)
    swept = qa.sweep(base)
    best = qa.best(qa.candidates(swept))
    row = best.first()  # one setting, or none where too few records stay
    out = {"neighbours": base, "sweep": swept, "best": best}
    if row is not None:
        never = {"min_pred_total": qa.NEVER, "min_disagree": qa.NEVER, "min_pred_rate": float(qa.NEVER)}
        flagged = qa.apply_flags(base, {k: never[k] if row[k] is None else row[k] for k in qa.PARAMETERS})
        out |= {"flagged": flagged, "summary": qa.qa_summary(flagged)}
    return out


def screens(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tree-year and tree summaries, threshold screens and their selectivity."""
    years = C.tree_years(spark, sf_dir)
    found = screening.all_screens(years)
    return {"tree_years": years, "tree_summary": screening.tree_summary(years), "screens": found, "selectivity": screening.by_selectivity(screening.selectivity(found))}


def errors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Accuracy by genus, year and coverage, error counts and confident errors."""
    rows = C.flagged(spark, sf_dir)
    return {"by_genus": reports.accuracy_by(rows, "genus_name"), "by_year": reports.accuracy_by(rows, "year"), "by_coverage": reports.accuracy_by_bin(rows), "counts": reports.error_counts(rows), "confident": reports.confident_errors(rows)}


JOBS: dict[str, Callable[..., dict[str, DataFrame]]] = {"sampling": sampling, "qa": spatial_qa, "screening": screens, "errors": errors}


def run(spark: SparkSession, name: str, sf_dir: str, out: str, kind: str = "parquet") -> list[str]:
    """Write the tables of a job below ``out`` and return their paths."""
    paths = []
    for table, df in JOBS[name](spark, sf_dir).items():
        paths.append(f"{out}/{table}")
        files.write_table(df, paths[-1], kind)
    return paths


if __name__ == "__main__":
    print("\n".join(run(SparkSession.builder.appName(sys.argv[1]).getOrCreate(), *sys.argv[1:4])))
