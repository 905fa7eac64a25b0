"""Maps the driver's TPC-H-style tables onto the people-analytics shapes.

Each builder is a lazy DataFrame over the parquet scans, so Catalyst prunes
columns and pushes the date filters into the scan. The mapping rules (which
column stands for what) are fixed by FIXTURES.md and mirrored as DuckDB SQL
in ``crewlens.oracle.ctes``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.operators.sequence import next_in_group



# Fixed values of the fixture mapping: vowels accented in generated names.
PLAIN_VOWELS = "aeiou"
ACCENTED_VOWELS = "áéíóú"

# System history lies before the boundary, the client's changes from it on;
# salaries run a few days over it so that some changes are already present.
FEED_BOUNDARY = "2000-07-01 00:00:00"
SALARY_START = "2000-07-03 00:00:00"
SALARY_BOUNDARY = "2000-07-04 00:00:00"


def ts_ntz(text: str):
    """A TIMESTAMP_NTZ literal (the driver tables store naive timestamps)."""
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


class Tables:
    """Lazy handles on the driver tables of one scale-factor directory."""

    NAMES = (
        "region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Tables.NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


class Fixtures:
    """The twelve people / change-feed views of FIXTURES.md as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)

    # -- activity 1 inputs -------------------------------------------------
    @cached_property
    def perf_long(self) -> DataFrame:
        """(cpf, ano, semestre, score): one performance score per person and half-year."""
        o = self.t.orders
        ts = F.col("o_orderdate")
        # min over the first character's code point orders exactly like the
        # string min of that character, and keeps a fixed-width buffer so the
        # aggregate runs hash-based instead of sort-based
        first = F.min(F.ascii("o_orderpriority"))
        return (
            o.groupBy(
                F.col("o_custkey").alias("cpf"),
                F.year(ts).cast("int").alias("ano"),
                F.when(F.month(ts) <= 6, F.lit(1)).otherwise(F.lit(2)).alias("semestre"),
            )
            .agg(
                F.when(first == ord("1"), F.lit(3)).when(first <= ord("4"), F.lit(2)).otherwise(F.lit(1)).alias("score")
            )
        )

    @cached_property
    def assess_sessions(self) -> DataFrame:
        """(cpf, assessment, wk, inicio, fim, score): timed assessment attempts."""
        e = self.t.events
        return e.groupBy(
            F.col("user_id").alias("cpf"),
            F.col("event_type").alias("assessment"),
            F.weekofyear("ts").cast("int").alias("wk"),
        ).agg(F.min("ts").alias("inicio"), F.max("ts").alias("fim"), F.avg("value").alias("score"))

    @cached_property
    def assess_scores(self) -> DataFrame:
        """(cpf, raciocinio, social, motivacional): structurally null for most people."""
        e = self.t.events

        def score_of(kind: str):
            return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

        return e.groupBy(F.col("user_id").alias("cpf")).agg(
            score_of("click").alias("raciocinio"),
            score_of("view").alias("social"),
            score_of("signup").alias("motivacional"),
        )

    @cached_property
    def people_main(self) -> DataFrame:
        """Assessment wide row with deliberately messy names and band labels."""
        c = self.t.customer
        n = self.t.nation
        key = F.col("c_custkey")
        h = (key * 7919) % 101
        band = (
            F.when(key % 9 == 0, F.lit(None).cast("string"))
            .when(h < 15, F.lit(" muito baixo"))
            .when(h < 35, F.lit("BAIXO"))
            .when(h < 50, F.lit("médio baixo "))
            .when(h < 60, F.lit("Médio"))
            .when(h < 75, F.lit("médio-alto"))
            .when(h < 90, F.lit("alto"))
            .otherwise(F.lit("Muito Alto"))
        )
        base = c.join(n, c.c_nationkey == n.n_nationkey).select(
            key.alias("cpf"),
            F.concat(
                F.lit("  "), F.translate(F.lower("c_mktsegment"), PLAIN_VOWELS, ACCENTED_VOWELS), F.lit(" ")
            ).alias("nome"),
            F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit(" d'"))), F.lit(" ")).alias("sobrenome"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("potencial_bruto"),
            F.when(key % 9 != 0, (h).cast("double")).alias("cultura_pontuacao"),
            band.alias("cultura_classificacao"),
        )
        s = self.assess_scores
        # one row per key by construction: the join goes away where its columns are not read
        e = self.t.embeddings.groupBy(F.col("vec_id").alias("cpf")).agg(
            F.max(F.col("label").cast("double")).alias("perfil_comunicacao"),
            F.max(self._attribute(F.get("embedding", F.lit(0)))).alias("atributo_comunicacao"),
        )
        return base.join(s, "cpf", "left").join(e, "cpf", "left").select(
            "cpf", "nome", "sobrenome", "potencial_bruto", "raciocinio", "social", "motivacional",
            "cultura_pontuacao", "cultura_classificacao", "perfil_comunicacao", "atributo_comunicacao",
        )

    @staticmethod
    def _attribute(v):
        """An embedding coordinate on the 0-100 scale of the attribute scores."""
        return v.cast("double") * 100 + 50

    @cached_property
    def area_raw(self) -> DataFrame:
        """(cpf, area, ordinal): duplicate keys, keep the highest ordinal."""
        c, n, r = self.t.customer, self.t.nation, self.t.region
        first = (
            c.where(F.col("c_custkey") % 11 != 0)
            .join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("c_custkey").alias("cpf"),
                F.concat(F.lit(" "), F.lower("r_name")).alias("area"),
                F.lit(1).alias("ordinal"),
            )
        )
        moved = c.where(F.col("c_custkey") % 20 == 0).select(
            F.col("c_custkey").alias("cpf"), F.lit("Operações").alias("area"), F.lit(2).alias("ordinal")
        )
        return first.unionByName(moved)

    @cached_property
    def attributes(self) -> DataFrame:
        """(cpf, attrs): the behavioural attributes of a person as one array, every coordinate one attribute."""
        return self.t.embeddings.select(F.col("vec_id").alias("cpf"), F.transform("embedding", self._attribute).alias("attrs"))

    @cached_property
    def attribute_columns(self) -> DataFrame:
        """(idx, coluna): the source's column name of each attribute position, one row per part key."""
        names = self.t.part.groupBy(F.col("p_partkey").cast("int").alias("idx")).agg(F.min("p_name").alias("_name"))
        return names.select("idx", F.concat(F.lit("atributo-"), F.col("_name"), F.lit(" "), F.col("idx")).alias("coluna"))

    # -- activity 2 inputs -------------------------------------------------
    @cached_property
    def sys_people(self) -> DataFrame:
        c, n = self.t.customer, self.t.nation
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("person"),
            F.upper("c_mktsegment").alias("nome"),
            F.upper("n_name").alias("sobrenome"),
        )

    @cached_property
    def sys_salaries(self) -> DataFrame:
        o, c = self.t.orders, self.t.customer
        hist = o.where(
            (F.col("o_orderdate") < ts_ntz(SALARY_BOUNDARY)) & (F.col("o_custkey") % 5 != 0)
        ).select(
            F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("dt"), F.col("o_totalprice").alias("salary")
        )
        start = c.where(F.col("c_custkey") % 3 == 0).select(
            F.col("c_custkey").alias("person"), ts_ntz(SALARY_START).alias("dt"), F.col("c_acctbal").alias("salary")
        )
        return hist.unionByName(start)

    @cached_property
    def sys_salaries_text(self) -> DataFrame:
        """Salary history as exported: days as dd/mm/yyyy text, every 50th order's in another form."""
        ts = F.col("o_orderdate")
        day = F.when(F.col("o_orderkey") % 50 == 0, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "dd/MM/yyyy"))
        return self.t.orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), day.alias("date"),
            F.col("o_totalprice").alias("salary"),
        )

    @cached_property
    def change_sheet(self) -> DataFrame:
        """The customer list as a headerless sheet: two preamble rows, a header row, then data, all text."""
        c = self.t.customer
        data = c.select(
            (F.col("c_custkey") + 10).alias("linha"), F.col("c_custkey").cast("string").alias("_c0"),
            F.col("c_name").alias("_c1"), F.col("c_mktsegment").alias("_c2"),
        )
        # the three leading rows come from the table's own one-row count
        n = c.agg(F.count(F.lit(1)).cast("string").alias("n"))
        lead = n.select(F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("linha"), F.lit("Relatório").alias("_c0"), F.col("n").alias("_c1"), F.lit(None).cast("string").alias("_c2")),
            F.struct(F.lit(1).cast("long").alias("linha"), F.lit(None).cast("string").alias("_c0"), F.lit(None).cast("string").alias("_c1"), F.lit(None).cast("string").alias("_c2")),
            F.struct(F.lit(2).cast("long").alias("linha"), F.lit("chave").alias("_c0"), F.lit("nome").alias("_c1"), F.lit("segmento").alias("_c2")),
        )).alias("r")).select("r.*")
        return data.unionByName(lead)

    def _history(self, modulo: int, nation_mod: int, nation_rem: int) -> DataFrame:
        o, c = self.t.orders, self.t.customer
        excluded = c.where(F.col("c_nationkey") % nation_mod == nation_rem).select(F.col("c_custkey"))
        rows = o.where(
            (F.col("o_orderdate") < ts_ntz(FEED_BOUNDARY)) & (F.col("o_custkey") % modulo != 0)
        ).join(excluded, o.o_custkey == excluded.c_custkey, "left_anti")
        # end_date = next start of the same person (lead over the person),
        # computed day by day, so a hot person's rows are not sorted in one task
        rows = rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
        rows = next_in_group(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "end_date", F.to_date("o_orderdate"))
        return rows.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("person"),
            F.col("o_orderdate").alias("start_date"),
            "end_date",
            "o_orderpriority",
            "o_orderstatus",
        )

    @cached_property
    def sys_areas(self) -> DataFrame:
        return self._history(7, 6, 0).select(
            "id", "person", "start_date", "end_date",
            F.substring("o_orderpriority", 1, 1).cast("int").alias("area"),
        )

    @cached_property
    def sys_instances(self) -> DataFrame:
        o = self.t.orders
        return (
            o.where(F.col("o_orderpriority") < "4")
            .select(
                F.substring("o_orderpriority", 1, 1).cast("int").alias("id"),
                F.concat(F.lit("Dept "), F.col("o_orderpriority")).alias("name"),
            )
            .distinct()
        )

    @cached_property
    def sys_jobs(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self._history(8, 8, 1).select(
            "id", "person", "start_date", "end_date",
            F.when(status == "F", F.lit("ANALISTA DE OPERACOES"))
            .when(status == "O", F.lit("COORDENADOR"))
            .otherwise(F.lit("ASSISTENTE"))
            .alias("name"),
        )

    @cached_property
    def feed(self) -> DataFrame:
        """Client change list; names ending in ' x' have no system person."""
        o, c, n = self.t.orders, self.t.customer, self.t.nation
        prio = F.col("o_orderpriority")
        return (
            o.where(F.col("o_orderdate") >= ts_ntz(FEED_BOUNDARY))
            .join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .select(
                F.col("o_orderkey").alias("chg_id"),
                F.concat(
                    F.translate(F.lower("c_mktsegment"), PLAIN_VOWELS, ACCENTED_VOWELS),
                    F.lit("  "),
                    F.lower("n_name"),
                    F.when(F.col("c_custkey") % 10 == 0, F.lit(" x")).otherwise(F.lit("")),
                ).alias("colaborador"),
                F.col("o_orderdate").alias("data_alteracao"),
                F.col("o_totalprice").alias("salario"),
                # every 41st, 43rd and 97th change lacks a value (cases for the pending list)
                F.when(F.col("o_orderkey") % 41 != 0, F.concat(F.lit("Dept "), prio)).alias("departamento"),
                F.when(F.col("o_orderkey") % 43 == 0, F.lit(None).cast("string"))
                .when(prio == "1-URGENT", F.lit("Analista de Operações"))
                .when(prio == "2-HIGH", F.lit("Coordenador"))
                .otherwise(F.lit("Assistente"))
                .alias("cargo"),
                F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string"))
                .when(F.col("o_orderstatus") == "F", F.lit("Desligado")).otherwise(F.lit("Atual")).alias("situacao"),
            )
        )
