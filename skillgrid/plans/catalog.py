"""The catalogue: twelve questions with a general and a specific view each, and their contracts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from skillgrid.plans import alignment, companies, panorama
from skillgrid.plans.panorama import months_before
from skillgrid.sources.graph import DIMENSIONS, GraphContext

MONTH_LIMIT = 20


@dataclass(frozen=True)
class QuerySpec:
    """One question. params are what the specific view takes, exactly; limits are of rows; empty_status is the
    availability that stands for an empty result."""

    slug: str
    section: str
    question: str
    chart: str
    limits: tuple[int, int]
    params: tuple[str, ...]
    general: Callable[[GraphContext], DataFrame]
    specific: Callable[..., DataFrame]
    metric: str = "value"
    needs_curriculum: bool = False
    empty_status: str = "no_data"

    def run(self, g: GraphContext, **params: object) -> DataFrame:
        """The general view without parameters, else the specific one."""
        if not params:
            return self.general(g)
        return self.specific(g, **self.checked(params))

    def checked(self, params: dict[str, object]) -> dict[str, object]:
        """The parameters in order; ValueError says what is wrong with them."""
        if set(params) != set(self.params):
            raise ValueError(f"{self.slug} takes exactly {', '.join(self.params)}")
        for k, v in params.items():
            if v is None or (isinstance(v, str) and not v.strip()):
                raise ValueError(f"{k} is blank")
        if "tipo_conocimiento" in params and params["tipo_conocimiento"] not in DIMENSIONS:
            raise ValueError(f"tipo_conocimiento is one of {', '.join(DIMENSIONS)}")
        if "desde" in params:
            desde, hasta = (self.moment(k, str(params[k])) for k in ("desde", "hasta"))
            if desde >= hasta:
                raise ValueError("desde must come before hasta")
            if self.slug == "tendencia_ofertas" and len(months_before(str(params["desde"]), str(params["hasta"]), 10_000)) > MONTH_LIMIT:
                raise ValueError(f"the period has more than {MONTH_LIMIT} months")
        if "empresa_a_id" in params and params["empresa_a_id"] == params["empresa_b_id"]:
            raise ValueError("the companies must differ")
        return {k: params[k] for k in self.params}

    @staticmethod
    def moment(name: str, value: str) -> datetime:
        try:
            return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            raise ValueError(f"{name} is not an ISO date") from None


_P, _A, _E = "Panorama laboral", "Alineación curricular", "Empresas y funciones"
_CONTEXT = ("carrera_id", "industria_id", "tipo_conocimiento", "desde", "hasta")
_PLACE = ("carrera_id", "industria_id", "desde", "hasta")

CATALOGUE: tuple[QuerySpec, ...] = (
    QuerySpec("tendencia_ofertas", _P, "¿Cómo evolucionan las ofertas publicadas?", "line", (12, 20), _PLACE, panorama.trend, panorama.trend_of),
    QuerySpec("carreras_con_mayor_demanda", _P, "¿Qué carreras tienen mayor demanda?", "ranked_bar", (14, 14), ("facultad_id", "industria_id", "desde", "hasta"), panorama.careers, panorama.careers_of),
    QuerySpec("industrias_por_carrera", _P, "¿Qué industrias buscan cada carrera?", "bar_drilldown", (14, 10), ("carrera_id", "desde", "hasta"), panorama.industries, panorama.industries_of),
    QuerySpec("conocimientos_mas_demandados", _P, "¿Qué conocimientos se piden más?", "ranked_bar_tabs", (15, 20), _CONTEXT, panorama.knowledge, panorama.knowledge_of),
    QuerySpec("cobertura_curricular", _A, "¿Qué cubre el currículo de cada carrera?", "coverage_status_then_bar", (14, 20), ("carrera_id", "tipo_conocimiento"), alignment.coverage, alignment.coverage_of, needs_curriculum=True, empty_status="unavailable"),
    QuerySpec("brechas_demanda_alta", _A, "¿Qué se pide más de lo que se enseña?", "quadrant_or_grouped_bar", (20, 20), _CONTEXT, alignment.gaps, alignment.gaps_of, needs_curriculum=True, empty_status="no_market_data"),
    QuerySpec("senales_revision_vigencia", _A, "¿Qué se enseña más de lo que se pide?", "diverging_bar", (20, 20), _CONTEXT, alignment.currency, alignment.currency_of, needs_curriculum=True, empty_status="no_market_data"),
    QuerySpec("cursos_con_mayor_correspondencia", _A, "¿Qué cursos corresponden más a las ofertas?", "ranked_bar", (20, 20), _CONTEXT, alignment.courses, alignment.courses_of, needs_curriculum=True, empty_status="no_market_data"),
    QuerySpec("empresas_y_conocimientos", _E, "¿Qué empresas publican más y qué piden?", "ranked_bar_with_detail", (20, 20), _PLACE, companies.companies, companies.companies_of),
    QuerySpec("diferenciadores_empresas", _E, "¿Qué distingue a unas empresas de otras?", "diverging_bar", (20, 20), ("empresa_a_id", "empresa_b_id", "desde", "hasta"), companies.distinctive, companies.distinctive_of),
    QuerySpec("conocimientos_liderazgo", _E, "¿Dónde se buscan líderes y qué se les pide?", "ranked_bar_drilldown", (20, 10), ("industria_id", "desde", "hasta"), companies.leadership, companies.leadership_of),
    QuerySpec("funciones_por_tipo_empresa", _E, "¿Qué puestos ofrece cada tipo de empresa?", "grouped_bar_drilldown", (20, 20), ("carrera_id", "desde", "hasta"), companies.job_titles, companies.job_titles_of),
)
BY_SLUG = {q.slug: q for q in CATALOGUE}
