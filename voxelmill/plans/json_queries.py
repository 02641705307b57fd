"""Queries on a run's state as nested JSON: a document for each customer, an inventory for each order.

A customer's orders are its load cases and materials, their lines the loads.
Some documents are cut off, some are absent, so that every status occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import state_json
from .tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text) for each customer."""
    line = F.struct(
        F.concat(F.lit("SET_"), F.col("l_suppkey").cast("string")).alias("target"), (F.col("l_linenumber") % 3 + 1).alias("dof"), F.col("l_quantity").alias("magnitude"),
        F.when(F.col("l_linenumber") % 3 != 0, "MOD").alias("op"),
    )
    loads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("loads"))
    o = table(spark, sf_dir, "orders").join(loads, "o_orderkey", "left")
    key = F.col("o_orderkey")
    name = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    density = F.when(key % 5 != 0, 1.5).alias("density")
    material = lambda prefix, k, poisson: F.struct(name(prefix, k).alias("name"), F.col("o_totalprice").alias("youngs_modulus"), F.lit(poisson).alias("poisson_ratio"), density)
    listed = lambda c, when=None: F.array_sort(F.collect_list(c if when is None else F.when(when, c)))
    ground = F.struct(name("Mat_", key).alias("material"), name("el_", key).alias("elset"), F.lit(1.0).alias("youngs_modulus"), F.lit(0.2).alias("poisson_ratio"), F.lit(0.5).alias("density"))
    case = F.struct(name("load_case_", key), F.struct(name("case_", key % 3).alias("template"), "loads"))
    of = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.map_from_entries(listed(case)).alias("cases"), listed(material("mat_", key, 0.25), key % 3 == 0).alias("all"), listed(ground, F.col("o_orderstatus") == "P").alias("ground"),
        listed(material("pt_cage_", key % 50, 0.3), key % 2 == 0).alias("cage"), listed(material("pt_bone_", key % 60, 0.3), key % 2 == 1).alias("bone"),
    )
    c = table(spark, sf_dir, "customer").join(of, "c_custkey", "left")
    k = F.col("c_custkey")
    family = lambda elset, c: F.struct(F.lit(elset).alias("section_elset_prefix"), F.array(F.lit(0), k % 100).alias("bucket_index_range"), F.col(c).alias("materials"))
    text = F.to_json(F.struct(
        F.struct(
            F.col("c_acctbal").alias("voxel_volume"), F.lit(0.5).alias("time_step_dt"), (k % 40).alias("num_time_steps"), F.lit(1.75).alias("bone_density_upper_bound_b_max"),
            F.struct((k * 2).alias("E0_bo"), F.lit(0.125).alias("Emin_bo")).alias("bone_modulus"), F.struct((k * 3).alias("E0_cage"), F.lit(0.25).alias("Emin_cage")).alias("cage_modulus"),
            F.struct(F.lit(0.75).alias("initial_bone_density"), (k % 7).alias("single_load_design_cage"), F.when(k % 4 != 0, k % 9).alias("three_load_design_cage")).alias("initial_conditions"),
        ).alias("simulation_constants"),
        F.struct("all", F.struct(family("set_cage", "cage").alias("cage_design_domain"), family("set_bone", "bone").alias("bone_objective_domain"), F.col("ground").alias("bone_background_domains")).alias("families")).alias("materials"),
        F.array(
            F.struct(name("TOP_", k).alias("target"), F.lit("ENCASTRE").alias("constraint"), F.lit(None).cast("int").alias("dof_start"), F.lit(None).cast("int").alias("dof_end"), F.lit(None).cast("double").alias("value")),
            F.struct(name("BOT_", k).alias("target"), F.lit(None).cast("string").alias("constraint"), F.lit(1).alias("dof_start"), (k % 3 + 1).cast("int").alias("dof_end"), F.col("c_acctbal").alias("value")),
        ).alias("boundary_conditions"),
        F.col("cases").alias("forward_load_cases"),
        F.struct(
            name("prefix_", k).alias("prefix_template"), name("suffix_", k).alias("suffix_template"),
            F.struct(F.lit("P.{node}").alias("target_format"), F.sequence(F.lit(1).cast("long"), k % 3 + 1).alias("components"), F.lit("adjoint").alias("magnitude_source"), F.lit("").alias("description")).alias("injection_rule"),
        ).alias("adjoint_load_template"),
        F.array(F.create_map(F.lit("elset"), name("set_", k))).alias("section_assignments"),
    ))
    half = F.expr("left(t, CAST(length(t) / 2 AS INT))")
    return c.select(k.alias("doc"), text.alias("t")).select("doc", F.when(F.col("doc") % 13 == 5, None).when(F.col("doc") % 11 == 3, half).otherwise(F.col("t")).alias("text"))


_STATUS = """st AS (SELECT c_custkey AS doc, c_acctbal, CASE WHEN c_custkey % 13 = 5 THEN 'missing' WHEN c_custkey % 11 = 3 THEN 'malformed'
  WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) THEN 'incomplete' ELSE 'readable' END AS status FROM customer), ok AS (SELECT * FROM st WHERE status = 'readable')"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_json.parsed(documents(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT doc, status FROM st")
def state_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's document is."""
    return _states(spark, sf_dir).select("doc", "status")


@query(
    f"""WITH {_STATUS} SELECT doc, c_acctbal AS voxel_volume, 0.5::DOUBLE AS time_step_dt, CAST(doc % 40 AS INT) AS num_time_steps, 1.75::DOUBLE AS bone_density_upper_bound,
  (doc * 2)::DOUBLE AS bone_modulus_0, 0.125::DOUBLE AS bone_modulus_min, (doc * 3)::DOUBLE AS cage_modulus_0, 0.25::DOUBLE AS cage_modulus_min, 0.75::DOUBLE AS initial_bone_density, (doc % 7)::DOUBLE AS single_load_design,
  CASE WHEN doc % 4 <> 0 THEN (doc % 9)::DOUBLE END AS three_load_design, CAST(doc % 100 AS INT) AS cage_bucket_max, CAST(doc % 100 AS INT) AS bone_bucket_max FROM ok"""
)
def state_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_json.constants(_states(spark, sf_dir))


@query(
    f"""WITH {_STATUS} SELECT doc, 'load_case_' || o_orderkey AS "case", CAST(o_orderkey AS INT) AS case_no, 'case_' || (o_orderkey % 3) AS template, 'SET_' || l_suppkey AS target,
  CASE WHEN l_orderkey IS NOT NULL THEN CAST(l_linenumber % 3 + 1 AS INT) END AS dof, l_quantity AS magnitude, CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_linenumber % 3 <> 0 THEN 'MOD' ELSE 'NEW' END AS op
FROM ok JOIN orders ON o_custkey = doc LEFT JOIN lineitem ON l_orderkey = o_orderkey"""
)
def state_load_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load of each case."""
    return state_json.load_cases(_states(spark, sf_dir)).drop("n")


@query(
    f"""WITH {_STATUS} SELECT doc, 0 AS n, 'TOP_' || doc AS target, 'ENCASTRE' AS "constraint", NULL::INT AS dof_start, NULL::INT AS dof_end, NULL::DOUBLE AS value FROM ok
UNION ALL SELECT doc, 1, 'BOT_' || doc, NULL, 1, CAST(doc % 3 + 1 AS INT), c_acctbal FROM ok"""
)
def state_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_json.boundary_conditions(_states(spark, sf_dir))


@query(
    f"""WITH {_STATUS}, o AS (SELECT doc, o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s, CASE WHEN o_orderkey % 5 <> 0 THEN 1.5::DOUBLE END AS d FROM ok JOIN orders ON o_custkey = doc)
SELECT doc, CASE WHEN k % 2 = 0 THEN 'cage_design_domain' ELSE 'bone_objective_domain' END AS family, CAST(CASE WHEN k % 2 = 0 THEN k % 50 ELSE k % 60 END AS INT) AS bucket,
  CASE WHEN k % 2 = 0 THEN 'PT_CAGE_' || (k % 50) ELSE 'PT_BONE_' || (k % 60) END AS material, CASE WHEN k % 2 = 0 THEN 'set_cage' || (k % 50) ELSE 'set_bone' || (k % 60) END AS section_elset,
  v AS youngs_modulus, 0.3::DOUBLE AS poisson_ratio, coalesce(d, 0) AS density FROM o
UNION ALL SELECT doc, 'bone_background_domains', -1, 'MAT_' || k, 'EL_' || k, CASE WHEN k % 3 = 0 THEN v ELSE 1 END, CASE WHEN k % 3 = 0 THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END,
  CASE WHEN k % 3 = 0 THEN coalesce(d, 0.5::DOUBLE) ELSE 0.5::DOUBLE END FROM o WHERE s = 'P'"""
)
def state_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materials of both families and of the background."""
    states = _states(spark, sf_dir)
    return state_json.material_buckets(states).unionByName(state_json.background_materials(states))


@query(
    f"""WITH {_STATUS} SELECT doc, 'prefix_' || doc AS prefix_template, 'suffix_' || doc AS suffix_template, 'P.{{node}}' AS target_format, 'adjoint' AS magnitude_source,
  CAST(c - 1 AS INT) AS n, CAST(c AS INT) AS component, 'set_' || doc AS elset FROM ok, (SELECT unnest(range(1, 4)) AS c) WHERE c <= doc % 3 + 1"""
)
def state_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjoint templates' components with their document's sections."""
    states = _states(spark, sf_dir)
    sections = state_json.section_assignments(states).filter("field = 'elset'").select("doc", F.col("value").alias("elset"))
    return state_json.adjoint_templates(states).join(sections, "doc")


@query(
    """WITH m AS (SELECT l_orderkey AS doc, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT DISTINCT doc FROM m),
e AS (SELECT doc, name, n + CASE WHEN doc % 7 = 0 THEN 1 ELSE 0 END AS n FROM m WHERE NOT (doc % 9 = 0 AND name = 'N') UNION ALL SELECT doc, 'GHOST', 2 FROM d WHERE doc % 10 = 1)
SELECT doc, name, coalesce(m.n, 0) AS found, e.n AS expected, CASE WHEN e.n IS NULL THEN 'unknown' WHEN m.n = e.n THEN 'ok' WHEN m.n IS NULL THEN 'missing' ELSE 'mismatch' END AS status
FROM m FULL JOIN (SELECT * FROM e WHERE doc % 50 <> 7) e USING (doc, name)"""
)
def inventory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by flag against each order's inventory; some inventories are cut off, or say something else."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lower("l_returnflag").alias("name"))
    doc = F.col("doc")
    told = li.groupBy("doc", "name").count().select("doc", F.when(~((doc % 9 == 0) & (F.col("name") == "n")), F.struct("name", (F.col("count") + F.when(doc % 7 == 0, 1).otherwise(0)).alias("count"))).alias("s"))
    sets = told.groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("s"))
    ghost = F.when(doc % 10 == 1, F.array(F.struct(F.lit("ghost").alias("name"), F.lit(2).cast("long").alias("count"))))
    sets = sets.select("doc", F.concat("s", F.coalesce(ghost, F.filter("s", lambda _: F.lit(False)))).alias("s"))
    text = F.to_json(F.struct(F.struct(F.col("s").alias("node_sets_from_templates")).alias("static_external_inputs")))
    docs = sets.select("doc", text.alias("t")).select("doc", F.when(doc % 50 == 7, F.expr("left(t, length(t) - 3)")).otherwise(F.col("t")).alias("text"))
    return state_json.checked_counts(li, state_json.inventory_counts(docs))
