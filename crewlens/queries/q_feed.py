"""Change-feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import fixtures, register
from crewlens.oracle.ctes import CTES, PY_SPACE, sql_normalize, sql_strip, sql_upper, with_ctes
from crewlens.plans.feed import FeedJob, import_ids, salary_days
from crewlens.sources.tables import promote_header


def job(spark, sf_dir) -> FeedJob:
    return FeedJob.from_fixtures(fixtures(spark, sf_dir))


_NORM = sql_normalize(sql_upper("colaborador"))

CTES.update(
    {
        "feed_split": (
            f"""SELECT chg_id, colaborador, data_alteracao, salario, departamento, cargo, situacao,
  CASE WHEN strpos(nrm, ' ') > 0 THEN substr(nrm, 1, strpos(nrm, ' ') - 1) ELSE nrm END AS nome,
  CASE WHEN strpos(nrm, ' ') > 0 THEN substr(nrm, strpos(nrm, ' ') + 1) END AS sobrenome
FROM (SELECT *, {_NORM} AS nrm FROM feed)""",
            ("feed",),
        ),
        "sys_people_norm": (
            f"SELECT person, {sql_normalize('nome')} AS nome, {sql_normalize('sobrenome')} AS sobrenome FROM sys_people",
            ("sys_people",),
        ),
        "prio": (
            """SELECT p.person, p.nome, p.sobrenome,
  (CASE WHEN p.person IN (SELECT person FROM sys_jobs) THEN 1 ELSE 0 END)
  + (CASE WHEN p.person IN (SELECT person FROM sys_areas) THEN 1 ELSE 0 END) AS prioridade
FROM sys_people_norm p""",
            ("sys_people_norm", "sys_jobs", "sys_areas"),
        ),
        "best": (
            """SELECT nome, sobrenome, person, prioridade FROM (
  SELECT *, row_number() OVER (PARTITION BY nome, sobrenome ORDER BY prioridade DESC, person) AS rn FROM prio
) WHERE rn = 1""",
            ("prio",),
        ),
        "ids": (
            """SELECT b.person, f.chg_id, f.colaborador, f.data_alteracao, f.salario, f.departamento, f.cargo,
  f.situacao, f.nome, f.sobrenome
FROM feed_split f LEFT JOIN best b
  ON f.nome IS NOT DISTINCT FROM b.nome AND f.sobrenome IS NOT DISTINCT FROM b.sobrenome""",
            ("feed_split", "best"),
        ),
        "found": ("SELECT * FROM ids WHERE person IS NOT NULL", ("ids",)),
        "pending_rows": (
            """SELECT *, 'pessoa nao encontrada em Pessoas - Full' AS motivo FROM ids WHERE person IS NULL
UNION ALL
SELECT * EXCLUDE (rn), 'nome duplicado em Pessoas - Full' AS motivo FROM (
  SELECT i.*, row_number() OVER (PARTITION BY i.nome, i.sobrenome ORDER BY i.chg_id) AS rn
  FROM ids i WHERE EXISTS (
    SELECT 1 FROM (SELECT nome, sobrenome FROM sys_people_norm GROUP BY ALL HAVING count(*) > 1) d
    WHERE i.nome IS NOT DISTINCT FROM d.nome AND i.sobrenome IS NOT DISTINCT FROM d.sobrenome)
) WHERE rn = 1
UNION ALL
SELECT *, 'situacao ausente' FROM ids WHERE person IS NOT NULL AND situacao IS NULL
UNION ALL
SELECT *, 'departamento ausente' FROM ids WHERE person IS NOT NULL AND starts_with(situacao, 'Atual') AND departamento IS NULL
UNION ALL
SELECT *, 'cargo ausente' FROM ids WHERE person IS NOT NULL AND starts_with(situacao, 'Atual') AND cargo IS NULL""",
            ("ids", "sys_people_norm"),
        ),
        "salary_rows": (
            """SELECT '' AS id, f.person, f.data_alteracao AS date, f.salario AS salary,
  CASE WHEN f.person IS NULL THEN 'others' WHEN l.ultima IS NULL THEN 'initial'
       WHEN f.data_alteracao > l.ultima THEN 'raise' ELSE 'initial' END AS raise_type,
  CAST(f.data_alteracao AS date) AS _day
FROM found f LEFT JOIN (SELECT person, max(dt) AS ultima FROM sys_salaries GROUP BY person) l ON f.person = l.person""",
            ("found", "sys_salaries"),
        ),
        "salary_hist_days": ("SELECT DISTINCT person, CAST(dt AS date) AS _day FROM sys_salaries", ("sys_salaries",)),
        "created": (
            """SELECT CAST((SELECT coalesce(max(id), 0) FROM sys_instances) + row_number() OVER (ORDER BY _first, name) AS bigint) AS id, name
FROM (SELECT departamento AS name, min(chg_id) AS _first FROM found WHERE departamento IS NOT NULL GROUP BY 1) d
WHERE name NOT IN (SELECT name FROM sys_instances)""",
            ("found", "sys_instances"),
        ),
        "inst_map": (
            """SELECT name, arg_max(id, _src * 1000000000000 + id) AS area_nova FROM (
  SELECT id, name, 0 AS _src FROM sys_instances UNION ALL SELECT id, name, 1 AS _src FROM created
) GROUP BY name""",
            ("sys_instances", "created"),
        ),
        "current_rows": ("SELECT * FROM found WHERE coalesce(starts_with(situacao, 'Atual'), false)", ("found",)),
    }
)


def person_text(df):
    """Output form of the nullable person id (text; null when not found)."""
    return df.withColumn("person", F.col("person").cast("string"))


@register("feed_resolve", with_ctes("SELECT * REPLACE (CAST(person AS varchar) AS person) FROM ids", "ids"))
def feed_resolve(spark, sf_dir):
    return person_text(job(spark, sf_dir).ids)


@register("person_priority", with_ctes("SELECT nome, sobrenome, person, prioridade FROM best", "best"))
def person_priority(spark, sf_dir):
    return job(spark, sf_dir).best.select("nome", "sobrenome", "person", "prioridade")


@register("feed_pending", with_ctes("SELECT * REPLACE (CAST(person AS varchar) AS person) FROM pending_rows", "pending_rows"))
def feed_pending(spark, sf_dir):
    return person_text(job(spark, sf_dir).pending)


@register(
    "salary_new",
    with_ctes(
        """SELECT id, person, date, salary, raise_type FROM salary_rows r
WHERE NOT EXISTS (SELECT 1 FROM salary_hist_days h WHERE h.person = r.person AND h._day = r._day)""",
        "salary_rows", "salary_hist_days",
    ),
)
def salary_new(spark, sf_dir):
    return job(spark, sf_dir).salaries_split[0]


@register(
    "salary_skipped",
    with_ctes(
        """SELECT person, date, salary FROM salary_rows r
WHERE EXISTS (SELECT 1 FROM salary_hist_days h WHERE h.person = r.person AND h._day = r._day)""",
        "salary_rows", "salary_hist_days",
    ),
)
def salary_skipped(spark, sf_dir):
    return job(spark, sf_dir).salaries_split[1]


@register("instance_new", with_ctes("SELECT id, name FROM created", "created"))
def instance_new(spark, sf_dir):
    return job(spark, sf_dir).created


_SCD2_AREA = """mapped AS (
  SELECT c.*, m.area_nova FROM current_rows c LEFT JOIN inst_map m ON c.departamento = m.name
  WHERE c.departamento IS NOT NULL),
j AS (SELECT w.*, a.id AS _aid, a.start_date AS _astart, a.area AS area_atual
  FROM mapped w LEFT JOIN (SELECT * FROM sys_areas WHERE end_date IS NULL) a ON w.person = a.person)
SELECT CAST(_aid AS varchar) AS id, person, _astart AS start_date, data_alteracao AS end_date, area_atual AS area,
  'fechar' AS acao, chg_id
FROM j WHERE area_atual IS NOT NULL AND area_atual IS DISTINCT FROM area_nova
UNION ALL
SELECT '' AS id, person, data_alteracao AS start_date, CAST(NULL AS timestamp) AS end_date,
  area_nova AS area, 'abrir' AS acao, chg_id
FROM j WHERE area_atual IS NULL OR area_atual IS DISTINCT FROM area_nova"""


@register(
    "scd2_area",
    with_ctes(
        "SELECT * FROM scd2_area_rows", "current_rows", "inst_map", "sys_areas",
        extra=(("scd2_area_rows", "WITH " + _SCD2_AREA),),
    ),
)
def scd2_area(spark, sf_dir):
    return import_ids(job(spark, sf_dir).area_changes)


def _LEVEL(x: str) -> str:  # noqa: N802
    return sql_normalize(sql_upper(f"regexp_split_to_array({sql_strip(x)}, '{PY_SPACE}+')[1]"))

_SCD2_JOB = f"""cur AS (
  SELECT c.*, {sql_normalize(sql_upper('cargo'))} AS cargo_norm, {_LEVEL('cargo')} AS level_novo
  FROM current_rows c WHERE c.cargo IS NOT NULL),
act AS (
  SELECT id, person, start_date, name AS cargo_atual, {sql_normalize('name')} AS cargo_atual_norm,
    {_LEVEL('name')} AS level_atual
  FROM sys_jobs WHERE end_date IS NULL),
j AS (SELECT c.*, a.id AS _aid, a.start_date AS _astart, a.cargo_atual, a.cargo_atual_norm, a.level_atual
  FROM cur c LEFT JOIN act a ON c.person = a.person)
SELECT CAST(_aid AS varchar) AS id, person, _astart AS start_date, data_alteracao AS end_date,
  cargo_atual AS name, level_atual AS level, 'fechar' AS acao, chg_id
FROM j WHERE cargo_atual_norm IS NOT NULL AND cargo_atual_norm IS DISTINCT FROM cargo_norm
UNION ALL
SELECT '' AS id, person, data_alteracao AS start_date, CAST(NULL AS timestamp) AS end_date,
  {sql_upper('cargo')} AS name, level_novo AS level, 'abrir' AS acao, chg_id
FROM j WHERE cargo_atual_norm IS NULL OR cargo_atual_norm IS DISTINCT FROM cargo_norm"""


@register(
    "scd2_job",
    with_ctes(
        "SELECT * FROM scd2_job_rows", "current_rows", "sys_jobs",
        extra=(("scd2_job_rows", "WITH " + _SCD2_JOB),),
    ),
)
def scd2_job(spark, sf_dir):
    return import_ids(job(spark, sf_dir).job_changes)


def _chain(rows: str, active: str, new: str, cur: str, payload_new: str, payload_cur: str) -> str:
    """Changes of a person in order: islands of equal values, each opening ended by the next."""
    return f"""c AS ({rows}), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY start_date DESC, id DESC) AS _r
  FROM ({active}) WHERE {cur} IS NOT NULL) WHERE _r = 1),
o AS (SELECT c.*, s.* EXCLUDE (person, id, start_date), s.id AS _aid, s.start_date AS _astart,
    lag({new}) OVER w AS _b, row_number() OVER w AS _n
  FROM c LEFT JOIN s ON c.person = s.person WINDOW w AS (PARTITION BY c.person ORDER BY data_alteracao, chg_id)),
h AS (SELECT *, lead(data_alteracao) OVER w AS _until, row_number() OVER w AS _hn FROM o
  WHERE CASE WHEN _n = 1 THEN _aid IS NULL OR {new} IS DISTINCT FROM {cur} ELSE {new} IS DISTINCT FROM _b END
  WINDOW w AS (PARTITION BY person ORDER BY data_alteracao, chg_id))
SELECT CAST(_aid AS varchar) AS id, person, _astart AS start_date, data_alteracao AS end_date, {payload_cur}, 'fechar' AS acao, chg_id
FROM h WHERE _hn = 1 AND _aid IS NOT NULL
UNION ALL
SELECT '' AS id, person, data_alteracao AS start_date, _until AS end_date, {payload_new}, 'abrir' AS acao, chg_id FROM h"""


@register(
    "scd2_area_chain",
    with_ctes(
        "SELECT * FROM chained", "current_rows", "inst_map", "sys_areas",
        extra=(("chained", "WITH " + _chain(
            "SELECT c.*, m.area_nova FROM current_rows c LEFT JOIN inst_map m ON c.departamento = m.name WHERE c.departamento IS NOT NULL",
            "SELECT id, person, start_date, area AS area_atual FROM sys_areas WHERE end_date IS NULL",
            "area_nova", "area_atual", "area_nova AS area", "area_atual AS area",
        )),),
    ),
)
def scd2_area_chain(spark, sf_dir):
    """E6 with B10 as a chain: a person's changes in order."""
    j = job(spark, sf_dir)
    j.sequence = "chain"
    return import_ids(j.area_changes)


@register(
    "scd2_job_chain",
    with_ctes(
        "SELECT * FROM chained", "current_rows", "sys_jobs",
        extra=(("chained", "WITH " + _chain(
            f"""SELECT c.*, {sql_normalize(sql_upper('cargo'))} AS cargo_norm, {_LEVEL('cargo')} AS level_novo
  FROM current_rows c WHERE c.cargo IS NOT NULL""",
            f"""SELECT id, person, start_date, name AS cargo_atual, {sql_normalize('name')} AS cargo_atual_norm, {_LEVEL('name')} AS level_atual
  FROM sys_jobs WHERE end_date IS NULL""",
            "cargo_norm", "cargo_atual_norm", f"{sql_upper('cargo')} AS name, level_novo AS level", "cargo_atual AS name, level_atual AS level",
        )),),
    ),
)
def scd2_job_chain(spark, sf_dir):
    """E7 with B10 as a chain."""
    j = job(spark, sf_dir)
    j.sequence = "chain"
    return import_ids(j.job_changes)


@register(
    "feed_summary",
    with_ctes(
        """SELECT
  (SELECT count(*) FROM feed) AS linhas,
  (SELECT count(*) FROM ids WHERE person IS NOT NULL) AS resolvidos,
  (SELECT count(*) FROM pending_rows) AS pendentes,
  (SELECT count(*) FROM salary_rows r WHERE NOT EXISTS (SELECT 1 FROM salary_hist_days h WHERE h.person = r.person AND h._day = r._day)) AS salarios_novos,
  (SELECT count(*) FROM salary_rows r WHERE EXISTS (SELECT 1 FROM salary_hist_days h WHERE h.person = r.person AND h._day = r._day)) AS salarios_ignorados,
  (SELECT count(*) FROM created) AS instancias_novas,
  (SELECT count(*) FROM scd2_area_rows WHERE acao = 'fechar') AS areas_fechadas,
  (SELECT count(*) FROM scd2_area_rows WHERE acao = 'abrir') AS areas_abertas,
  (SELECT count(*) FROM scd2_job_rows WHERE acao = 'fechar') AS cargos_fechados,
  (SELECT count(*) FROM scd2_job_rows WHERE acao = 'abrir') AS cargos_abertos""",
        "feed", "ids", "pending_rows", "salary_rows", "salary_hist_days", "created", "current_rows",
        "inst_map", "sys_areas", "sys_jobs",
        extra=(("scd2_area_rows", "WITH " + _SCD2_AREA), ("scd2_job_rows", "WITH " + _SCD2_JOB)),
    ),
)
def feed_summary(spark, sf_dir):
    return job(spark, sf_dir).summary()


@register(
    "feed_rejects",
    """SELECT o_orderkey AS id, o_custkey AS person, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS salary,
  'data de salario invalida' AS motivo FROM orders WHERE o_orderkey % 50 = 0""",
)
def feed_rejects(spark, sf_dir):
    """Salary rows whose day cannot be read, with the reason."""
    return salary_days(fixtures(spark, sf_dir).sys_salaries_text, "date", "dd/MM/yyyy")[1]


@register(
    "feed_header",
    """SELECT CAST(c_custkey AS varchar) AS chave, c_name AS nome, c_mktsegment AS segmento,
  c_custkey + 10 AS linha FROM customer""",
)
def feed_header(spark, sf_dir):
    """S3: a sheet with preamble rows; the third row becomes the header."""
    return promote_header(fixtures(spark, sf_dir).change_sheet, "linha", 2)
