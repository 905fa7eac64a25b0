"""DuckDB SQL building blocks for the correctness oracle.

The fixture views (FIXTURES.md) and the cleaned people tables written as
plain DuckDB SQL. ``with_ctes`` prepends the CTEs a query body needs, in
dependency order, so each oracle string is self-contained.
"""

from __future__ import annotations

# Whitespace classes shared with crewlens.functions.text (WS_CLASS, PY_SPACE).
WS = r"[\x09-\x0D\x20\x1C-\x1F]"
PY_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# Years of the order dates: SQL has to name the wide period columns.
PERIOD_YEARS = range(1995, 2002)


def sql_title(x: str) -> str:
    return (
        "array_to_string(list_transform(regexp_extract_all(" + x + r", '(\p{L}+|[^\p{L}]+)'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def sql_upper(x: str) -> str:
    """Upper case as Python / Java do it: DuckDB maps 'ß' to 'ẞ', they expand it to 'SS'."""
    return f"upper(replace({x}, 'ß', 'SS'))"


def sql_fold(x: str) -> str:
    return "regexp_replace(strip_accents(" + x + r"), '[^\x00-\x7F]', '', 'g')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '{WS}+', ' ', 'g'))"


def sql_band(x: str) -> str:
    return f"replace({sql_fold(sql_title(sql_strip(x)))}, ' ', '-')"


def sql_pearson(x: str, y: str) -> str:
    bx = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    by = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({bx}) * stddev_pop({by}), 0))"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "perf_long": (
        """SELECT o_custkey AS cpf, CAST(extract(year FROM o_orderdate) AS int) AS ano,
  CASE WHEN extract(month FROM o_orderdate) <= 6 THEN 1 ELSE 2 END AS semestre,
  CASE WHEN min(substring(o_orderpriority,1,1)) = '1' THEN 3
       WHEN min(substring(o_orderpriority,1,1)) <= '4' THEN 2 ELSE 1 END AS score
FROM orders
GROUP BY 1, 2, 3""",
        (),
    ),
    "assess_sessions": (
        """SELECT user_id AS cpf, event_type AS assessment, CAST(extract(week FROM ts) AS int) AS wk,
  min(ts) AS inicio, max(ts) AS fim, avg(value) AS score
FROM events GROUP BY 1, 2, 3""",
        (),
    ),
    "assess_scores": (
        """SELECT user_id AS cpf,
  avg(CASE WHEN event_type = 'click' THEN value END) AS raciocinio,
  avg(CASE WHEN event_type = 'view' THEN value END) AS social,
  avg(CASE WHEN event_type = 'signup' THEN value END) AS motivacional
FROM events GROUP BY 1""",
        (),
    ),
    "people_main": (
        """SELECT c_custkey AS cpf,
  concat('  ', translate(lower(c_mktsegment), 'aeiou', 'áéíóú'), ' ') AS nome,
  concat(lower(replace(n_name, '_', ' d''')), ' ') AS sobrenome,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS potencial_bruto,
  raciocinio, social, motivacional,
  CASE WHEN c_custkey % 9 <> 0 THEN CAST((c_custkey * 7919) % 101 AS double) END AS cultura_pontuacao,
  CASE WHEN c_custkey % 9 = 0 THEN NULL
       WHEN (c_custkey * 7919) % 101 < 15 THEN ' muito baixo'  WHEN (c_custkey * 7919) % 101 < 35 THEN 'BAIXO'
       WHEN (c_custkey * 7919) % 101 < 50 THEN 'médio baixo '  WHEN (c_custkey * 7919) % 101 < 60 THEN 'Médio'
       WHEN (c_custkey * 7919) % 101 < 75 THEN 'médio-alto'    WHEN (c_custkey * 7919) % 101 < 90 THEN 'alto'
       ELSE 'Muito Alto' END AS cultura_classificacao,
  CAST(label AS double) AS perfil_comunicacao, CAST(embedding[1] AS double) * 100 + 50 AS atributo_comunicacao
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN assess_scores ON cpf = c_custkey
  LEFT JOIN embeddings ON vec_id = c_custkey""",
        ("assess_scores",),
    ),
    "area_raw": (
        """SELECT c_custkey AS cpf, concat(' ', lower(r_name)) AS area, 1 AS ordinal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 11 <> 0
UNION ALL
SELECT c_custkey AS cpf, 'Operações' AS area, 2 AS ordinal FROM customer WHERE c_custkey % 20 = 0""",
        (),
    ),
    "sys_people": (
        """SELECT c_custkey AS person, upper(c_mktsegment) AS nome, upper(n_name) AS sobrenome
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        (),
    ),
    "sys_salaries": (
        """SELECT o_custkey AS person, o_orderdate AS dt, o_totalprice AS salary
FROM orders WHERE o_orderdate < timestamp '2000-07-04 00:00:00' AND o_custkey % 5 <> 0
UNION ALL
SELECT c_custkey AS person, timestamp '2000-07-03 00:00:00' AS dt, c_acctbal AS salary FROM customer WHERE c_custkey % 3 = 0""",
        (),
    ),
    "sys_areas": (
        """SELECT o_orderkey AS id, o_custkey AS person, o_orderdate AS start_date,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_date,
  CAST(substring(o_orderpriority,1,1) AS int) AS area
FROM orders WHERE o_orderdate < timestamp '2000-07-01 00:00:00' AND o_custkey % 7 <> 0
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 6 = 0)""",
        (),
    ),
    "sys_instances": (
        """SELECT DISTINCT CAST(substring(o_orderpriority,1,1) AS int) AS id, concat('Dept ', o_orderpriority) AS name
FROM orders WHERE o_orderpriority < '4'""",
        (),
    ),
    "sys_jobs": (
        """SELECT o_orderkey AS id, o_custkey AS person, o_orderdate AS start_date,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_date,
  CASE o_orderstatus WHEN 'F' THEN 'ANALISTA DE OPERACOES' WHEN 'O' THEN 'COORDENADOR' ELSE 'ASSISTENTE' END AS name
FROM orders WHERE o_orderdate < timestamp '2000-07-01 00:00:00' AND o_custkey % 8 <> 0
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 8 = 1)""",
        (),
    ),
    "feed": (
        """SELECT o_orderkey AS chg_id,
  concat(translate(lower(c_mktsegment), 'aeiou', 'áéíóú'), '  ', lower(n_name),
         CASE WHEN c_custkey % 10 = 0 THEN ' x' ELSE '' END) AS colaborador,
  o_orderdate AS data_alteracao, o_totalprice AS salario,
  CASE WHEN o_orderkey % 41 <> 0 THEN concat('Dept ', o_orderpriority) END AS departamento,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'Analista de Operações'
       WHEN o_orderpriority = '2-HIGH' THEN 'Coordenador' ELSE 'Assistente' END AS cargo,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Desligado' ELSE 'Atual' END AS situacao
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= timestamp '2000-07-01 00:00:00'""",
        (),
    ),
    "attributes_long": (
        """SELECT vec_id AS cpf, CAST(i AS int) AS idx, CAST(embedding[i] AS double) * 100 + 50 AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
        (),
    ),
    "attribute_names": (
        """SELECT CAST(p_partkey AS int) AS idx, min(p_name) || ' ' || p_partkey AS atributo FROM part GROUP BY p_partkey""",
        (),
    ),
    # ---- cleaned people model -------------------------------------------
    "people": (
        f"""SELECT {sql_title(f"concat({sql_strip('nome')}, ' ', {sql_strip('sobrenome')})")} AS nome_completo,
  cpf, potencial_bruto, raciocinio, social, motivacional, cultura_pontuacao,
  {sql_band('cultura_classificacao')} AS cultura_classificacao,
  CAST(raciocinio IS NOT NULL AS int) AS fez_raciocinio,
  CAST(cultura_pontuacao IS NOT NULL AS int) AS fez_cultura,
  CAST(social IS NOT NULL AS int) AS fez_social,
  perfil_comunicacao, atributo_comunicacao,
  CAST(motivacional IS NOT NULL AS int) AS fez_motivacional,
  CAST(perfil_comunicacao IS NOT NULL AS int) AS fez_perfil,
  CAST(atributo_comunicacao IS NOT NULL AS int) AS fez_atributos
FROM people_main""",
        ("people_main",),
    ),
    "area": (
        f"""SELECT cpf, arg_max({sql_fold(sql_title(sql_strip('area')))}, ordinal) AS area
FROM area_raw WHERE cpf IS NOT NULL GROUP BY cpf""",
        ("area_raw",),
    ),
    "summary": (
        """SELECT cpf, avg(score) AS perf_media, count(score) AS n_avaliacoes
FROM perf_long WHERE cpf IS NOT NULL GROUP BY cpf""",
        ("perf_long",),
    ),
    "periods": (
        "SELECT cpf, " + ", ".join(
            f"CAST(max(CASE WHEN ano = {y} AND semestre = {s} THEN score END) AS double) AS perf_{s}_{y}"
            for y in PERIOD_YEARS for s in (1, 2)
        ) + " FROM perf_long WHERE cpf IS NOT NULL GROUP BY cpf",
        ("perf_long",),
    ),
    "merged": (
        """SELECT b.*, w.* EXCLUDE (cpf) FROM base b LEFT JOIN periods w ON b.cpf = w.cpf""",
        ("base", "periods"),
    ),
    "base": (
        """SELECT p.*, a.area, s.perf_media, coalesce(s.n_avaliacoes, 0) AS n_avaliacoes
FROM people p LEFT JOIN area a ON p.cpf = a.cpf LEFT JOIN summary s ON p.cpf = s.cpf""",
        ("people", "area", "summary"),
    ),
    "perf_area": (
        """SELECT l.cpf, l.ano, l.semestre, l.score, a.area
FROM perf_long l JOIN people p ON l.cpf = p.cpf LEFT JOIN area a ON l.cpf = a.cpf""",
        ("perf_long", "people", "area"),
    ),
    "attrs_complete": (
        """SELECT cpf FROM attributes_long WHERE value IS NOT NULL GROUP BY cpf
HAVING count(idx) = (SELECT max(len(embedding)) FROM embeddings)""",
        ("attributes_long",),
    ),
    # ---- 9-box ----------------------------------------------------------
    "nb_pop": (
        """SELECT * FROM base WHERE n_avaliacoes >= 2 AND potencial_bruto IS NOT NULL""",
        ("base",),
    ),
    "nb_banded": (
        """SELECT b.*, c.q33, c.q66,
  CASE WHEN perf_media >= 0 AND perf_media <= 1.5 THEN 'Baixa'
       WHEN perf_media > 1.5 AND perf_media <= 2.5 THEN 'Média'
       WHEN perf_media > 2.5 AND perf_media <= 3.01 THEN 'Alta' END AS perf_cat,
  CASE WHEN potencial_bruto >= 0 AND potencial_bruto <= c.q33 THEN 'Baixo'
       WHEN potencial_bruto > c.q33 AND potencial_bruto <= c.q66 THEN 'Médio'
       WHEN potencial_bruto > c.q66 AND potencial_bruto <= 101 THEN 'Alto' END AS pot_cat
FROM nb_pop b, (SELECT quantile_cont(potencial_bruto, 0.33) AS q33, quantile_cont(potencial_bruto, 0.66) AS q66 FROM nb_pop) c""",
        ("nb_pop",),
    ),
    "quadrant_dim": (
        """SELECT * FROM (VALUES
  ('Alto', 'Alta', 'Estrela', 9, 1), ('Alto', 'Média', 'Alto Potencial', 6, 3), ('Alto', 'Baixa', 'Enigma', 3, 8),
  ('Médio', 'Alta', 'Forte Desempenho', 6, 2), ('Médio', 'Média', 'Core', 4, 5), ('Médio', 'Baixa', 'Em Desenvolvimento', 2, 6),
  ('Baixo', 'Alta', 'Sólido', 3, 4), ('Baixo', 'Média', 'Eficiente', 2, 7), ('Baixo', 'Baixa', 'Em Risco', 1, 9)
) t(pot_cat, perf_cat, quadrante, valor, ordem)""",
        (),
    ),
    "nb_quad": (
        """SELECT b.*, coalesce(d.quadrante, 'N/A') AS quadrante, d.ordem AS _ordem
FROM nb_banded b LEFT JOIN quadrant_dim d ON b.pot_cat = d.pot_cat AND b.perf_cat = d.perf_cat""",
        ("nb_banded", "quadrant_dim"),
    ),
}


def with_ctes(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``body`` with the CTEs ``names`` need, dependencies first,
    followed by query-local ``extra`` CTEs ``(name, sql)`` in the given order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in CTES[n][1]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    blocks = [(n, CTES[n][0]) for n in ordered] + list(extra)
    if not blocks:
        return body
    parts = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in blocks)
    return f"WITH {parts}\n{body}"
