"""A run's state from nested JSON documents: constants, materials, loads, templates and inventories.

A document is a row (doc, text); nothing is parsed on the driver. Documents that
can't be read keep their row with a status, and give no rows in the tables made
from readable ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The documents' sections and fields; these names are the format.
_LOADS = "array<struct<target:string,dof:double,magnitude:double,op:string>>"
STATE = f"""
simulation_constants struct<
  voxel_volume:double, time_step_dt:double, num_time_steps:double, bone_density_upper_bound_b_max:double,
  bone_modulus:struct<E0_bo:double,Emin_bo:double>, cage_modulus:struct<E0_cage:double,Emin_cage:double>,
  initial_conditions:struct<initial_bone_density:double,single_load_design_cage:double,three_load_design_cage:double>>,
materials struct<all:array<struct<name:string,youngs_modulus:double,poisson_ratio:double,density:double>>, families:map<string,string>>,
boundary_conditions array<struct<target:string,constraint:string,dof_start:double,dof_end:double,value:double>>,
forward_load_cases map<string,struct<template:string,loads:{_LOADS}>>,
adjoint_load_template struct<prefix_template:string,suffix_template:string,
  injection_rule:struct<target_format:string,components:array<double>,magnitude_source:string,description:string>>,
section_assignments array<map<string,string>>,
discretization_rules map<string,string>"""
FAMILY = "section_elset_prefix string, bucket_index_range array<double>, materials array<struct<name:string,youngs_modulus:double,poisson_ratio:double,density:double>>"
BACKGROUND = "array<struct<material:string,elset:string,youngs_modulus:double,poisson_ratio:double,density:double>>"
INVENTORY = "static_external_inputs struct<global_constants:struct<grid_shape:array<double>>, node_sets_from_templates:array<struct<name:string,count:double>>>"
REQUIRED = ("simulation_constants", "materials", "forward_load_cases")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc: the file's path, text) of JSON files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def parsed(docs: DataFrame, schema: str = STATE, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(doc, state, status) of documents (doc, text). status: `missing` without a
    text, `malformed` where it isn't JSON or a field has another type,
    `incomplete` where a required section is absent, else `readable`. Fields
    that are not in the schema are ignored."""
    state = F.from_json("text", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    absent = F.lit(False)
    for section in required:
        absent = absent | F.col(f"state.{section}").isNull()
    status = F.when(F.col("text").isNull() | (F.trim("text") == ""), "missing").when(F.col("state").isNull() | F.col("state._corrupt").isNotNull(), "malformed").when(absent, "incomplete")
    return docs.select("doc", "text").withColumn("state", state).select("doc", "state", status.otherwise("readable").alias("status"))


def readable(states: DataFrame) -> DataFrame:
    return states.filter("status = 'readable'")


def family(name: str) -> Column:
    """A family of materials as a struct; the format has families of other kinds too, so each is parsed by itself."""
    return F.from_json(F.col("state.materials.families")[name], FAMILY)


def constants(states: DataFrame) -> DataFrame:
    """A row of constants for each readable document; what it doesn't say is null."""
    c, at = "state.simulation_constants", lambda path: F.col(f"state.simulation_constants.{path}")
    top = lambda name: F.get(family(name)["bucket_index_range"], F.lit(1)).cast("int")
    return readable(states).select(
        "doc", *[F.col(f"{c}.{n}") for n in ("voxel_volume", "time_step_dt")], at("num_time_steps").cast("int").alias("num_time_steps"), at("bone_density_upper_bound_b_max").alias("bone_density_upper_bound"),
        at("bone_modulus.E0_bo").alias("bone_modulus_0"), at("bone_modulus.Emin_bo").alias("bone_modulus_min"), at("cage_modulus.E0_cage").alias("cage_modulus_0"), at("cage_modulus.Emin_cage").alias("cage_modulus_min"),
        at("initial_conditions.initial_bone_density").alias("initial_bone_density"), at("initial_conditions.single_load_design_cage").alias("single_load_design"), at("initial_conditions.three_load_design_cage").alias("three_load_design"),
        top("cage_design_domain").alias("cage_bucket_max"), top("bone_objective_domain").alias("bone_bucket_max"),
    )


def _number_behind(name: Column) -> Column:
    return F.substring_index(name, "_", -1).cast("int")


def load_cases(states: DataFrame) -> DataFrame:
    """(doc, case, case_no, template, n, target, dof, magnitude, op): each load of
    each case; cases stand by the number behind their name's last underscore,
    loads by n; op is NEW where a load doesn't say. A case without loads has
    one row without a target."""
    cases = readable(states).select("doc", F.explode("state.forward_load_cases").alias("case", "c"))
    loads = cases.select("doc", "case", _number_behind(F.col("case")).alias("case_no"), F.col("c.template").alias("template"), F.posexplode_outer("c.loads").alias("n", "l"))
    op = F.when(F.col("l").isNotNull(), F.coalesce("l.op", F.lit("NEW")))
    return loads.select("doc", "case", "case_no", "template", "n", F.col("l.target").alias("target"), F.col("l.dof").cast("int").alias("dof"), F.col("l.magnitude").alias("magnitude"), op.alias("op"))


def boundary_conditions(states: DataFrame) -> DataFrame:
    """(doc, n, target, constraint, dof_start, dof_end, value)."""
    rows = readable(states).select("doc", F.posexplode("state.boundary_conditions").alias("n", "b"))
    return rows.select("doc", "n", "b.target", "b.constraint", F.col("b.dof_start").cast("int").alias("dof_start"), F.col("b.dof_end").cast("int").alias("dof_end"), "b.value")


MATERIAL = ["doc", "family", "bucket", "material", "section_elset", "youngs_modulus", "poisson_ratio", "density"]


def material_buckets(states: DataFrame, families: tuple[str, ...] = ("cage_design_domain", "bone_objective_domain")) -> DataFrame:
    """(doc, family, bucket, material, section_elset, youngs_modulus,
    poisson_ratio, density) of the materials of families; the bucket is the
    number behind a material's last underscore; no density is 0."""
    lists = F.array(*[F.struct(F.lit(f).alias("family"), family(f).alias("f")) for f in families])
    rows = readable(states).select("doc", F.explode(lists).alias("e")).select("doc", "e.family", F.col("e.f.section_elset_prefix").alias("prefix"), F.explode("e.f.materials").alias("m"))
    name = F.upper("m.name")
    bucket = _number_behind(name)
    return rows.select("doc", "family", bucket.alias("bucket"), name.alias("material"), F.concat("prefix", bucket.cast("string")).alias("section_elset"), "m.youngs_modulus", "m.poisson_ratio", F.coalesce("m.density", F.lit(0.0)).alias("density"))


def background_materials(states: DataFrame, name: str = "bone_background_domains") -> DataFrame:
    """The same columns for the list of background domains, bucket -1: what the
    document's list of all materials says of a name (its last entry of that
    name, in either case), else what the domain says itself."""
    docs = readable(states)
    own = docs.select("doc", F.posexplode(F.from_json(F.col("state.materials.families")[name], BACKGROUND)).alias("n", "b"), F.reverse("state.materials.all").alias("all"))
    material = F.upper("b.material")
    known = F.get(F.filter("all", lambda m: F.upper(m["name"]) == F.upper(F.col("b.material"))), F.lit(0))
    rows = own.withColumn("known", known)
    value = lambda c: F.when(F.col("known").isNotNull(), F.col(f"known.{c}")).otherwise(F.col(f"b.{c}"))
    density = F.coalesce("known.density", "b.density", F.lit(0.0))
    return rows.select("doc", F.lit(name).alias("family"), F.lit(-1).alias("bucket"), material.alias("material"), F.upper("b.elset").alias("section_elset"), value("youngs_modulus").alias("youngs_modulus"), value("poisson_ratio").alias("poisson_ratio"), density.alias("density"))


def named_buckets(elements: DataFrame, buckets: DataFrame, prefix: str) -> DataFrame:
    """elements (doc, bucket, modulus, others) with material and youngs_modulus of
    their bucket in buckets (one family's); a bucket that has no material is
    named prefix and its number, and keeps the element's own modulus. Of
    materials of one bucket the last by name counts."""
    known = buckets.groupBy("doc", "bucket").agg(F.max(F.struct("material", "youngs_modulus")).alias("m"))
    # documents have at most a hundred or so buckets, elements may be many: a hot document's elements are split by AQE
    met = elements.join(known, ["doc", "bucket"], "left")
    name = F.coalesce("m.material", F.concat(F.lit(prefix), F.col("bucket").cast("string")))
    return met.select(*elements.columns, name.alias("material"), F.coalesce("m.youngs_modulus", "modulus").alias("youngs_modulus"))


def adjoint_templates(states: DataFrame) -> DataFrame:
    """(doc, prefix_template, suffix_template, target_format, magnitude_source, n,
    component): a row for each component that loads are injected for."""
    a = readable(states).filter("state.adjoint_load_template IS NOT NULL").select("doc", "state.adjoint_load_template.*")
    rule = "injection_rule"
    return a.select("doc", "prefix_template", "suffix_template", f"{rule}.target_format", f"{rule}.magnitude_source", F.posexplode_outer(f"{rule}.components").alias("n", "c")).withColumn("component", F.col("c").cast("int")).drop("c")


def section_assignments(states: DataFrame) -> DataFrame:
    """(doc, n, field, value) of each section's fields."""
    rows = readable(states).select("doc", F.posexplode("state.section_assignments").alias("n", "s"))
    return rows.select("doc", "n", F.explode("s").alias("field", "value"))


def inventory_counts(docs: DataFrame) -> DataFrame:
    """(doc, name, expected) of the node sets in inventories (doc, text), names in
    upper case; of a name's entries the last counts."""
    found = readable(parsed(docs, INVENTORY, ("static_external_inputs",)))
    rows = found.select("doc", F.posexplode("state.static_external_inputs.node_sets_from_templates").alias("n", "s"))
    last = rows.groupBy("doc", F.upper("s.name").alias("name")).agg(F.max(F.struct("n", F.col("s.count").alias("count"))).alias("l"))
    return last.select("doc", "name", F.col("l.count").cast("long").alias("expected"))


def inventory_shapes(docs: DataFrame) -> DataFrame:
    """(doc, n_x, n_y, n_z): the grid's shape in inventories."""
    found = readable(parsed(docs, INVENTORY, ("static_external_inputs",)))
    return found.select("doc", *[F.get("state.static_external_inputs.global_constants.grid_shape", F.lit(i)).cast("int").alias(f"n_{a}") for i, a in enumerate("xyz")])


def checked_counts(members: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, name, found, expected, status): members (doc, name, others), a row
    each, against inventory_counts: `ok`, `mismatch`, `missing` (expected, but
    without members, unless none are expected) or `unknown` (not expected).
    Members are counted before they meet their inventory."""
    found = members.groupBy("doc", F.upper("name").alias("name")).agg(F.count("*").alias("found"))
    both = found.join(expected, ["doc", "name"], "full")
    n = F.coalesce("found", F.lit(0).cast("long"))
    status = F.when(F.col("expected").isNull(), "unknown").when(n == F.col("expected"), "ok").when(n == 0, "missing").otherwise("mismatch")
    return both.select("doc", "name", n.alias("found"), "expected", status.alias("status"))


def checked_shapes(shapes: DataFrame, inventory: DataFrame) -> DataFrame:
    """(doc, status): shapes (doc, n_x, n_y, n_z) of meshes against inventory_shapes."""
    axes = [f"n_{a}" for a in "xyz"]
    both = shapes.select("doc", *axes).join(inventory.select("doc", F.struct(*axes).alias("want")), "doc", "full")
    own = F.struct(*axes)
    absent = F.col("n_x").isNull() & F.col("n_y").isNull() & F.col("n_z").isNull()
    status = F.when(F.col("want").isNull(), "unknown").when(absent, "missing").when(own.eqNullSafe(F.col("want")), "ok").otherwise("mismatch")
    return both.select("doc", status.alias("status"))
