"""Text, cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import fixtures, model, register
from crewlens.functions import text
from crewlens.functions.stats import rounded
from crewlens.oracle.ctes import PERIOD_YEARS, PY_SPACE, sql_band, sql_fold, sql_normalize, sql_strip, sql_title, sql_upper, with_ctes
from crewlens.plans import profile as P
from crewlens.plans.analysis import period_key, period_label
from crewlens.plans.feed import split_names
from crewlens.plans.people import PRESENCE_FLAGS
from crewlens.queries import q_feed  # noqa: F401  (registers the feed CTEs used below)


PERIOD_COLUMNS = [f"perf_{s}_{y}" for y in PERIOD_YEARS for s in (1, 2)]


def r6(x: str) -> str:
    return f"round({x}, 6)"


@register(
    "text_fold",
    f"SELECT doc_id, {sql_normalize('text')} AS texto_normalizado, {sql_normalize(sql_upper('text'))} AS texto_upper FROM documents",
)
def text_fold(spark, sf_dir):
    """X1/X2 on whole documents: NFD fold + whitespace collapse, plain and upper-cased."""
    return fixtures(spark, sf_dir).t.documents.select(
        "doc_id",
        text.normalize_text("text").alias("texto_normalizado"),
        text.normalize_text(F.upper("text")).alias("texto_upper"),
    )


@register(
    "name_title",
    with_ctes(
        f"""SELECT cpf, {sql_title(f"concat({sql_strip('nome')}, ' ', {sql_strip('sobrenome')})")} AS nome_completo,
  {sql_upper(sql_strip('nome'))} AS nome_upper, {sql_title(sql_strip('sobrenome'))} AS sobrenome_title,
  {sql_fold(sql_title(sql_strip('nome')))} AS nome_sem_acento
FROM people_main""",
        "people_main",
    ),
)
def name_title(spark, sf_dir):
    """X3/X6 (and X1 on names): title case, upper, strip."""
    p = fixtures(spark, sf_dir).people_main
    return p.select(
        "cpf",
        text.full_name("nome", "sobrenome").alias("nome_completo"),
        F.upper(text.strip_py("nome")).alias("nome_upper"),
        text.title_case(text.strip_py("sobrenome")).alias("sobrenome_title"),
        text.fold_ascii(text.title_case(text.strip_py("nome")), "NFKD").alias("nome_sem_acento"),
    )


@register(
    "band_label",
    with_ctes(
        f"SELECT cpf, cultura_classificacao AS bruto, {sql_band('cultura_classificacao')} AS cultura_classificacao FROM people_main",
        "people_main",
    ),
)
def band_label(spark, sf_dir):
    """Strip -> title -> fold -> hyphen."""
    p = fixtures(spark, sf_dir).people_main
    return p.select(
        "cpf", F.col("cultura_classificacao").alias("bruto"),
        text.band_label("cultura_classificacao").alias("cultura_classificacao"),
    )


_LEVEL = sql_normalize(sql_upper(f"regexp_split_to_array({sql_strip('cargo')}, '{PY_SPACE}+')[1]"))


@register(
    "name_split",
    with_ctes(
        f"""SELECT chg_id, nome, sobrenome, {_LEVEL} AS level, {sql_normalize(sql_upper('cargo'))} AS cargo_norm
FROM feed_split""",
        "feed_split",
    ),
)
def name_split(spark, sf_dir):
    """Split once into first name / rest; first word of the job title as level."""
    s = split_names(fixtures(spark, sf_dir).feed)
    return s.select(
        "chg_id", "nome", "sobrenome",
        text.first_word_level("cargo").alias("level"),
        text.normalize_text(F.upper("cargo")).alias("cargo_norm"),
    )


_FLAG_SQL = ", ".join(f"CAST({src} IS NOT NULL AS int) AS {flag}" for flag, src in PRESENCE_FLAGS.items())


@register("presence_flags", with_ctes(f"SELECT cpf, {_FLAG_SQL} FROM people_main", "people_main"))
def presence_flags(spark, sf_dir):
    """Test-taken flags per person."""
    from crewlens.operators.core import presence_flags as flags

    return flags(fixtures(spark, sf_dir).people_main, PRESENCE_FLAGS).select("cpf", *PRESENCE_FLAGS)


@register(
    "presence_totals",
    with_ctes(
        "SELECT " + ", ".join(f"CAST(sum({f}) AS bigint) AS {f}" for f in PRESENCE_FLAGS)
        + f" FROM (SELECT {_FLAG_SQL} FROM people_main)",
        "people_main",
    ),
)
def presence_totals(spark, sf_dir):
    """P9 totals: how many people took each test."""
    p = model(spark, sf_dir).people
    return p.agg(*[F.sum(f).cast("long").alias(f) for f in PRESENCE_FLAGS])


_MERGED_COLS = (
    "cpf, nome_completo, potencial_bruto, round(raciocinio, 6) AS raciocinio, round(social, 6) AS social, "
    "round(motivacional, 6) AS motivacional, cultura_pontuacao, cultura_classificacao, "
    "perfil_comunicacao, atributo_comunicacao, "
    + ", ".join(PRESENCE_FLAGS)
    + ", area, round(perf_media, 6) AS perf_media, n_avaliacoes, "
    + ", ".join(PERIOD_COLUMNS)
)


MERGED_SQL = with_ctes(f"SELECT {_MERGED_COLS} FROM merged", "merged")


def merged_columns(m):
    """The merged person table with its float means rounded for display."""
    df = P.merged(m)
    return df.select(
        *[rounded(c).alias(c) if c in ("raciocinio", "social", "motivacional", "perf_media") else F.col(c) for c in df.columns]
    )


@register("clean_merge", MERGED_SQL)
def clean_merge(spark, sf_dir):
    """Cleaned people ⟕ last area per cpf ⟕ performance summary."""
    return merged_columns(model(spark, sf_dir))


@register(
    "rename_periods",
    with_ctes(
        """SELECT printf('perf_%d_%d', semestre, ano) AS coluna, printf('%d-%dº', ano, semestre) AS label, ano, semestre,
  CAST(row_number() OVER (ORDER BY ano, semestre) AS int) AS ordem
FROM (SELECT DISTINCT ano, semestre FROM perf_long)""",
        "perf_long",
    ),
)
def rename_periods(spark, sf_dir):
    """Period column names, labels and chronological order.

    The window runs over the distinct periods only (a handful per year).
    """
    from pyspark.sql import Window

    per = model(spark, sf_dir).perf.select("ano", "semestre").distinct()
    return per.select(
        F.format_string("perf_%d_%d", "semestre", "ano").alias("coluna"), period_label().alias("label"),
        "ano", "semestre", F.row_number().over(Window.orderBy(period_key())).alias("ordem"),
    )


@register(
    "ts_parse_duration",
    with_ctes(
        f"""SELECT cpf, assessment, wk, inicio, fim, date_diff('microsecond', inicio, fim) / 6e7 AS dur_min,
  CAST(CAST(inicio AS date) AS timestamp) AS dia, strftime(inicio, '%d/%m/%Y') AS data_txt,
  CAST(CAST(try_strptime(strftime(inicio, '%d/%m/%Y'), '%d/%m/%Y') AS date) AS timestamp) AS data_parsed,
  try_strptime(strftime(fim, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS fim_segundos,
  CAST(CAST(try_strptime(assessment, '%d/%m/%Y') AS date) AS timestamp) AS data_invalida
FROM assess_sessions""",
        "assess_sessions",
    ),
)
def ts_parse_duration(spark, sf_dir):
    """Strict day parse (bad -> null), timestamp parse, date key, duration in minutes."""
    s = model(spark, sf_dir).sessions
    data_txt = F.date_format("inicio", "dd/MM/yyyy")
    fim_txt = F.date_format("fim", "yyyy-MM-dd HH:mm:ss")
    return s.select(
        "cpf", "assessment", "wk", "inicio", "fim",
        (F.timestamp_diff("MICROSECOND", F.col("inicio"), F.col("fim")) / 6e7).alias("dur_min"),
        # day keys are returned as midnight timestamps
        F.to_date("inicio").cast("timestamp_ntz").alias("dia"),
        data_txt.alias("data_txt"),
        F.try_to_date(data_txt, "dd/MM/yyyy").cast("timestamp_ntz").alias("data_parsed"),
        F.try_to_timestamp(fim_txt, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("fim_segundos"),
        F.try_to_timestamp(F.col("assessment"), F.lit("dd/MM/yyyy")).cast("date").cast("timestamp_ntz").alias("data_invalida"),
    )


_MERGED_ALL = (
    "nome_completo potencial_bruto raciocinio social motivacional cultura_pontuacao cultura_classificacao "
    "perfil_comunicacao atributo_comunicacao " + " ".join(PRESENCE_FLAGS) + " area perf_media n_avaliacoes"
).split() + PERIOD_COLUMNS


@register(
    "null_profile",
    with_ctes(
        "SELECT coluna, nulos, round(CAST(nulos AS double) * 100 / nullif(total, 0), 6) AS pct_nulos FROM ("
        + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos, count(*) AS total FROM merged" for c in ["cpf", *_MERGED_ALL]
        )
        + ") WHERE nulos > 0",
        "merged",
    ),
)
def null_profile(spark, sf_dir):
    """A19 on the merged data set."""
    return P.null_profile_merged(model(spark, sf_dir))


_NUM = ["potencial_bruto", "raciocinio", "social", "motivacional", "cultura_pontuacao", "perfil_comunicacao", "atributo_comunicacao"]


_RAW_COLS = {
    "assessments": ("people_main", ["cpf", "nome", "sobrenome", "potencial_bruto", "raciocinio", "social",
                                    "motivacional", "cultura_pontuacao", "cultura_classificacao",
                                    "perfil_comunicacao", "atributo_comunicacao"]),
    "performance": ("perf_long", ["cpf", "ano", "semestre", "score"]),
    "area": ("area_raw", ["cpf", "area", "ordinal"]),
}


@register(
    "null_profile_raw",
    with_ctes(
        "SELECT coluna, nulos, round(CAST(nulos AS double) * 100 / nullif(total, 0), 6) AS pct_nulos, tabela FROM ("
        + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos, count(*) AS total, '{t}' AS tabela FROM {view}"
            for t, (view, cols) in _RAW_COLS.items() for c in cols
        )
        + ") WHERE nulos > 0",
        "people_main", "perf_long", "area_raw",
    ),
)
def null_profile_raw(spark, sf_dir):
    """A19 on the raw input tables."""
    return P.null_profile_raw(model(spark, sf_dir))


@register(
    "describe_numeric",
    with_ctes(
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS coluna, count({c}) AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
  {r6(f'CAST(min({c}) AS double)')} AS min, {r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50,
  {r6(f'quantile_cont({c}, 0.75)')} AS p75, {r6(f'CAST(max({c}) AS double)')} AS max FROM people_main"""
            for c in _NUM
        ),
        "people_main",
    ),
)
def describe_numeric(spark, sf_dir):
    """A20 on the raw assessment table."""
    return P.describe_people(model(spark, sf_dir))


@register(
    "distinct_values",
    with_ctes(
        """SELECT DISTINCT coluna, valor FROM (
  SELECT 'cultura_classificacao' AS coluna, cultura_classificacao AS valor FROM people_main
  UNION ALL SELECT 'area', area FROM area_raw
  UNION ALL SELECT 'nome_completo', nome_completo FROM people) WHERE valor IS NOT NULL""",
        "people_main", "area_raw", "people",
    ),
)
def distinct_values(spark, sf_dir):
    """A21/O6."""
    return P.distinct_values(model(spark, sf_dir))


def _dup_sql(table: str, key: str, src: str, cols: str) -> str:
    return (
        f"SELECT '{table}' AS tabela, '{key}' AS chave, linhas, distintos, linhas - distintos AS duplicados FROM "
        f"(SELECT CAST(coalesce(sum(c), 0) AS bigint) AS linhas, count(*) AS distintos FROM "
        f"(SELECT {cols}, count(*) AS c FROM {src} GROUP BY ALL))"
    )


@register(
    "duplicate_counts",
    with_ctes(
        "\nUNION ALL\n".join(
            [
                _dup_sql("assessments", "*", "people_main", "cpf, nome, sobrenome, potencial_bruto, raciocinio, social, motivacional, cultura_pontuacao, cultura_classificacao, perfil_comunicacao, atributo_comunicacao"),
                _dup_sql("assessments", "cpf", "people_main", "cpf"),
                _dup_sql("assessments", "nome,sobrenome", "people_main", "nome, sobrenome"),
                _dup_sql("area", "cpf", "area_raw", "cpf"),
                _dup_sql("performance", "cpf,ano,semestre", "perf_long", "cpf, ano, semestre"),
            ]
        ),
        "people_main", "area_raw", "perf_long",
    ),
)
def duplicate_counts(spark, sf_dir):
    """A22."""
    return P.duplicate_counts(model(spark, sf_dir))


@register(
    "duplicated_members",
    with_ctes(
        "SELECT * FROM area_raw WHERE cpf IN (SELECT cpf FROM area_raw GROUP BY cpf HAVING count(*) > 1)",
        "area_raw",
    ),
)
def duplicated_members(spark, sf_dir):
    """keep=False members of duplicated cpf in the area table."""
    return P.area_duplicated_members(model(spark, sf_dir))


@register(
    "key_overlap",
    with_ctes(
        """SELECT count(CASE WHEN m THEN 1 END) AS cpf_main, count(CASE WHEN p THEN 1 END) AS cpf_perf,
  count(CASE WHEN a THEN 1 END) AS cpf_area, count(CASE WHEN m AND p AND a THEN 1 END) AS nas_tres,
  count(CASE WHEN m AND NOT p THEN 1 END) AS main_sem_perf, count(CASE WHEN m AND NOT a THEN 1 END) AS main_sem_area,
  count(CASE WHEN p AND NOT m THEN 1 END) AS perf_sem_main, count(CASE WHEN a AND NOT m THEN 1 END) AS area_sem_main,
  count(CASE WHEN m AND NOT p AND NOT a THEN 1 END) AS so_main
FROM (SELECT k.cpf, k.cpf IN (SELECT cpf FROM people_main) AS m, k.cpf IN (SELECT cpf FROM perf_long) AS p,
        k.cpf IN (SELECT cpf FROM area_raw) AS a
      FROM (SELECT cpf FROM people_main UNION SELECT cpf FROM perf_long UNION SELECT cpf FROM area_raw) k
      WHERE k.cpf IS NOT NULL)""",
        "people_main", "perf_long", "area_raw",
    ),
)
def key_overlap(spark, sf_dir):
    """J10/U2."""
    return P.key_overlap(model(spark, sf_dir))


@register(
    "run_summary",
    with_ctes(
        f"""SELECT 'assessments' AS tabela, count(*) AS linhas, 11 AS colunas, CAST(NULL AS double) AS com_area FROM people_main
UNION ALL SELECT 'performance', count(*), 4, CAST(NULL AS double) FROM perf_long
UNION ALL SELECT 'area', count(*), 3, CAST(NULL AS double) FROM area_raw
UNION ALL SELECT 'merged', count(*), {len(_MERGED_ALL) + 1}, CAST(count(area) AS double) FROM merged""",
        "people_main", "perf_long", "area_raw", "merged",
    ),
)
def run_summary(spark, sf_dir):
    """S8 of the cleaning job."""
    return P.run_summary(model(spark, sf_dir))
