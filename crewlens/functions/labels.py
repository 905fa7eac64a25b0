"""Labels, orders and cut-offs whose text must equal the
reference's output for results to match. Kept together, in natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values --------------------------------------------------------
PERF_LABELS = ("Baixa", "Média", "Alta")
PERF_EDGES = (0.0, 1.5, 2.5, 3.01)
POT_LABELS = ("Baixo", "Médio", "Alto")
POT_LOW, POT_HIGH = 0.0, 101.0
POT_PROBS = (0.33, 0.66)
RANK = {"Baixo": 1, "Médio": 2, "Alto": 3, "Baixa": 1, "Média": 2, "Alta": 3}
QUADRANTS = (
    # (potential band, performance band, quadrant)
    ("Alto", "Alta", "Estrela"),
    ("Alto", "Média", "Alto Potencial"),
    ("Alto", "Baixa", "Enigma"),
    ("Médio", "Alta", "Forte Desempenho"),
    ("Médio", "Média", "Core"),
    ("Médio", "Baixa", "Em Desenvolvimento"),
    ("Baixo", "Alta", "Sólido"),
    ("Baixo", "Média", "Eficiente"),
    ("Baixo", "Baixa", "Em Risco"),
)
QUADRANT_ORDER = (
    "Estrela", "Forte Desempenho", "Alto Potencial",
    "Sólido", "Core", "Em Desenvolvimento",
    "Eficiente", "Enigma", "Em Risco",
)
CULTURE_BANDS = ("Muito-Baixo", "Baixo", "Medio-Baixo", "Medio", "Medio-Alto", "Alto", "Muito-Alto")
CULTURE_LOW_BANDS = ("Baixo", "Medio-Baixo", "Muito-Baixo")
TRAJECTORIES = ("Crescente", "Estável", "Decrescente")
ASSESSMENTS = ("Raciocínio", "Social", "Motivacional", "Cultura")
NOT_APPLICABLE = "N/A"
REASON_NOT_FOUND = "pessoa nao encontrada em Pessoas - Full"
REASON_DUPLICATE = "nome duplicado em Pessoas - Full"
REASON_NO_STATUS = "situacao ausente"
REASON_NO_DEPARTMENT = "departamento ausente"
REASON_NO_JOB = "cargo ausente"
REASON_BAD_DAY = "data de salario invalida"
RAISE_OTHERS, RAISE_INITIAL, RAISE_RAISE = "others", "initial", "raise"
PRESENT_STATUS_PREFIX = "Atual"
# Internal moves (dashboard block): promotable = high potential with low or
# middle performance; at risk = low potential and low performance.
PROMOTABLE_PERF = ("Baixa", "Média")
# Headline KPI cut-offs (a different rule from the internal-moves block).
KPI_UNDERALLOCATED_PERF = 2.0
KPI_AT_RISK_PERF = 1.5
FIRST_PERIOD_WARN_SHARE = 0.15
# --------------------------------------------------------------------------


def order_rank(col, values) -> Column:
    """1-based rank of ``col`` in a fixed order (0 when absent)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int")


def quadrant_dim(spark: SparkSession) -> DataFrame:
    """The 9-row quadrant dimension: bands, label, rank product, listing order."""
    rows = [
        (p, f, q, RANK[p] * RANK[f], QUADRANT_ORDER.index(q) + 1, RANK[p], RANK[f])
        for p, f, q in QUADRANTS
    ]
    return spark.createDataFrame(
        rows,
        "pot_cat string, perf_cat string, quadrante string, valor int, ordem int, pot_rank int, perf_rank int",
    )


def quadrant_of(pot_cat, perf_cat) -> Column:
    """(potential band, performance band) -> quadrant; unmapped -> 'N/A'."""
    p = F.col(pot_cat) if isinstance(pot_cat, str) else pot_cat
    f = F.col(perf_cat) if isinstance(perf_cat, str) else perf_cat
    expr = None
    for pb, fb, q in QUADRANTS:
        cond = (p == pb) & (f == fb)
        expr = F.when(cond, F.lit(q)) if expr is None else expr.when(cond, F.lit(q))
    return expr.otherwise(F.lit(NOT_APPLICABLE))
