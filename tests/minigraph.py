"""A graph small enough to count by hand.

C1 has a whole curriculum, C2 covers one dimension only, C3 has no courses. Twelve offers over fourteen months:
O11 has no date, O1 lies before the last twelve months, O12 stands exactly at the cut-off, O2 on a month's first
moment. O5 is directed to two careers, O9 asks for nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from skillgrid.sources.graph import GraphContext

DATES = {
    1: "2024-11-20", 2: "2025-01-01", 3: "2025-01-15", 4: "2025-02-10", 5: "2025-03-05", 6: "2025-03-20", 7: "2025-05-01", 8: "2025-06-11", 9: "2025-07-07", 10: "2025-08-30", 11: None, 12: "2025-12-15 10:00:00",
}
COMPANY = {1: "EA", 2: "EA", 3: "EA", 4: "EA", 5: "EA", 6: "EA", 7: "EB", 8: "EB", 9: "EB", 10: "EC", 11: "EC", 12: "EB"}
CAREERS = {1: ["C1"], 2: ["C1"], 3: ["C1"], 4: ["C2"], 5: ["C1", "C2"], 6: ["C3"], 7: ["C1"], 8: ["C2"], 9: ["C1"], 10: ["C3"], 11: ["C1"], 12: ["C1"]}
ASKS = {1: ["k1"], 2: ["k1", "h1"], 3: ["k1", "t1"], 4: ["k2"], 5: ["k1", "k2"], 6: ["h1"], 7: ["k1", "h1"], 8: ["k1", "h2"], 9: [], 10: ["t1"], 11: ["k1"], 12: ["k2", "t1"]}
TITLES = {1: "Jefe", 2: "DIRECTOR DE OPERACIONES", 3: "ASISTENTE DE DIRECTORIO", 4: "  ", 5: None, 6: "Analista", 7: " analista\t", 8: "Team Lead", 9: "GERENTE", 10: "Manager", 11: "Jefe", 12: "Analista"}


def build(spark: SparkSession) -> GraphContext:
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pairs = lambda d: [(f"O{o}", x) for o, xs in d.items() for x in xs]
    known = [("k1", "Python", "competencia"), ("k2", "SQL", "competencia"), ("h1", "Hablar", "habilidad"), ("h2", "Leer", "habilidad"), ("t1", "Excel", "herramienta")]
    requires = frame(pairs(ASKS), "oferta string, conocimiento string")
    return GraphContext(
        carrera=frame([("C1", "Sistemas"), ("C2", "Derecho"), ("C3", "Arte")], "carrera string, carrera_nombre string"),
        facultad=frame([("F1", "Ingeniería"), ("F2", "Letras")], "facultad string, facultad_nombre string"),
        curso=frame([("U1", "Programar"), ("U2", "Datos"), ("U3", "Leyes")], "curso string, curso_nombre string"),
        conocimiento=frame(known, "conocimiento string, conocimiento_nombre string, dimension string"),
        oferta=frame([(f"O{o}", datetime.fromisoformat(d) if d else None) for o, d in DATES.items()], "oferta string, fecha timestamp_ntz"),
        empresa=frame([("EA", "EVENTIVA S.A.C.", "privada"), ("EB", "Banco Bravo", "pública"), ("EC", "Casa", None), ("ED", "Eventiva del Sur S.A.", "privada")], "empresa string, empresa_nombre string, tipo string"),
        industria=frame([("I1", "Banca"), ("I2", "Comercio")], "industria string, industria_nombre string"),
        puesto=frame([(f"P{o}", t) for o, t in TITLES.items()], "puesto string, puesto_nombre string"),
        silabo=frame([("U1", "S-1", "Bases"), ("U2", "S-2", None)], "curso string, codigo string, sumilla string"),
        ofrece=frame([("F1", "C1"), ("F2", "C2"), ("F2", "C3")], "facultad string, carrera string"),
        ensenia=frame([("C1", "U1"), ("C1", "U2"), ("C2", "U3")], "carrera string, curso string"),
        cubre=frame([("U1", "B1", "k1"), ("U1", "B1", "h1"), ("U2", "B2", "t1"), ("U2", "B3", "k1"), ("U3", "B4", "k2")], "curso string, cobertura string, conocimiento string"),
        dirige=frame(pairs(CAREERS), "oferta string, carrera string"),
        publica=frame([(e, f"O{o}") for o, e in COMPANY.items()], "empresa string, oferta string"),
        agrupa=frame([("I2", "EA"), ("I1", "EB"), ("I1", "EC"), ("I2", "ED")], "industria string, empresa string"),
        requiere=requires,
        ofrece_puesto=frame([(f"O{o}", f"P{o}") for o in TITLES], "oferta string, puesto string"),
        define=frame([(f"P{o}", x) for o, xs in ASKS.items() for x in xs], "puesto string, conocimiento string"),
    )
