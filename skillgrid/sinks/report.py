"""Results of a run as JSON lines, with what the run was and how many rows it wrote counted while they are written."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, slug string, vista string, estado string, generado_en string, categoria string, pregunta string, limitacion string, metadata string, parametros string, total_resultados long, duracion_segundos double, error string, columnas array<string>"
)


def _key(run_id: str) -> str:
    if not run_id or not all(c.isalnum() or c in "-_." for c in run_id) or run_id.startswith("."):
        raise ValueError("a run's id holds letters, digits, - _ and . only")
    return run_id


def write_rows(df: DataFrame, path: str) -> int:
    """Writes rows as JSON lines, nulls as well, in place of what the path held; returns how many, counted in the job
    that writes them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return int(seen.get["n"])


def run(spark: SparkSession, folder: str, run_id: str, views: Mapping[tuple[str, str], tuple[DataFrame, dict]]) -> DataFrame:
    """Runs views {(slug, vista): (rows, about)} and gives their report, a row each as in SCHEMA; about may hold
    categoria, pregunta, limitacion, metadata and parametros. Rows go to <folder>/resultados/run_id=R/slug=S/vista=V and
    the report to <folder>/reporte/run_id=R.

    A second run of the same id replaces the first one's files, so that nothing is there twice, and leaves other runs
    alone. A view that fails is reported with its error, and the others still run. The driver holds one row of report
    for each view, never results."""
    _key(run_id)
    lines = []
    for (slug, vista), (rows, about) in views.items():
        began = time.perf_counter()
        row = {"run_id": run_id, "slug": slug, "vista": vista, "generado_en": datetime.now(timezone.utc).isoformat(), "columnas": rows.columns, "error": None}
        row |= {k: about.get(k) for k in ("categoria", "pregunta", "limitacion")}
        row |= {k: json.dumps(about.get(k) or {}, ensure_ascii=False, sort_keys=True, default=str) for k in ("metadata", "parametros")}
        try:
            row |= {"total_resultados": write_rows(rows, f"{folder}/resultados/run_id={run_id}/slug={_key(slug)}/vista={_key(vista)}"), "estado": "ok"}
        except Exception as e:
            row |= {"total_resultados": None, "estado": "error", "error": str(e).splitlines()[0][:500]}
        lines.append(row | {"duracion_segundos": round(time.perf_counter() - began, 3)})
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    report = spark.createDataFrame([tuple(x[n] for n in names) for x in lines], SCHEMA)
    write_rows(report.drop("run_id").coalesce(1), f"{folder}/reporte/run_id={run_id}")
    return report


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of all runs in a folder."""
    return spark.read.schema(SCHEMA).json(f"{folder}/reporte")


def results(spark: SparkSession, folder: str, run_id: str, slug: str, vista: str, like: DataFrame) -> DataFrame:
    """The rows that a run wrote for a view, of like's columns and types."""
    return spark.read.schema(like.schema).json(f"{folder}/resultados/run_id={_key(run_id)}/slug={_key(slug)}/vista={_key(vista)}")


def catalogue(g: object, params: Mapping[str, Mapping[str, object]]) -> dict[tuple[str, str], tuple[DataFrame, dict]]:
    """The catalogue's views over a graph as run() takes them: every general one, and the specific ones that `params`
    has parameters for, by slug."""
    from skillgrid.plans.catalog import CATALOGUE

    out = {}
    for spec in CATALOGUE:
        about = {"categoria": spec.section, "pregunta": spec.question, "metadata": {"limites": spec.limits, "grafico": spec.chart, "requiere_curricula": spec.needs_curriculum}}
        out[spec.slug, "general"] = (spec.run(g), about)
        if spec.slug in params:
            out[spec.slug, "especifica"] = (spec.run(g, **params[spec.slug]), about | {"parametros": dict(params[spec.slug])})
    return out
