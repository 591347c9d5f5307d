"""Registered queries of the conformance compiler and the SQL sources: every nation is made a type, every region a base of search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conformance import compile_registry, documents_of, profile, read_package
from .queries import registered
from .registry import Registry
from .sources.star import Star
from .workspace import new_path

_DEFINITION = "http://hl7.org/fhir/StructureDefinition/"


def definitions(spark: SparkSession, sf_dir: str) -> list[dict]:
    """A type for each nation, a parameter and a compartment for each region, and the parts' types as codes."""
    star = Star(spark, sf_dir)
    nations = [r.asDict() for r in star.table("nation").orderBy("n_nationkey").collect()]
    codes = sorted(r[0] for r in star.table("part").select("p_type").distinct().collect())
    out: list[dict] = []
    for n in nations:
        k, name = n["n_nationkey"], f"N{n['n_nationkey']}"
        rows = [
            {"path": name, "min": 0, "max": "*", "constraint": [{"key": f"n-{k}", "severity": "error", "human": "a name", "expression": "name.exists()", "source": f"{_DEFINITION}{name}"}, {"key": "dom-1", "expression": "true", "source": f"{_DEFINITION}DomainResource"}]},
            {"path": f"{name}.id", "min": 0, "max": "1", "type": [{"code": "http://hl7.org/fhirpath/System.String"}], "base": {"path": "Resource.id"}},
            {"path": f"{name}.name", "min": k % 2, "max": "1" if k % 3 else "*", "type": [{"code": "string"}], "base": {"path": f"{name}.name"}, "isSummary": True},
            {"path": f"{name}.kind", "min": 0, "max": "1", "type": [{"code": "code"}], "binding": {"strength": "required" if k % 2 else "example", "valueSet": "urn:vs/part-types|1"}},
            {"path": f"{name}.near", "min": 0, "max": "*", "type": [{"code": "Reference", "targetProfile": [f"{_DEFINITION}N{(k + 1) % len(nations)}"]}]},
            {"path": f"{name}.value[x]", "min": 0, "max": "1", "type": [{"code": "string"}, {"code": "integer"}]},
            {"path": f"{name}.part", "min": 0, "max": "*", "type": [{"code": "BackboneElement"}]},
            {"path": f"{name}.part.inner", "min": 0, "max": "*", "contentReference": f"#{name}.part"},
        ]
        out.append({"resourceType": "StructureDefinition", "url": f"{_DEFINITION}{name}", "type": name, "kind": "resource", "derivation": "specialization", "baseDefinition": f"{_DEFINITION}DomainResource", "snapshot": {"element": rows}})
        narrower = [{"id": name, "path": name}, {"id": f"{name}.name", "path": f"{name}.name", "min": 1, "max": "1"}, {"id": f"{name}.kind", "path": f"{name}.kind", "min": 0, "max": "1", "fixedCode": codes[k % len(codes)]}, {"id": f"{name}.value[x]", "path": f"{name}.value[x]", "min": 0, "max": "1", "type": [{"code": "integer"}]}]
        out.append({"resourceType": "StructureDefinition", "url": f"urn:profile/{name}", "type": name, "kind": "resource", "derivation": "constraint", "baseDefinition": f"{_DEFINITION}{name}", "snapshot": {"element": narrower}})
    for region in sorted({n["n_regionkey"] for n in nations}):
        mine = [f"N{n['n_nationkey']}" for n in nations if n["n_regionkey"] == region]
        out.append({"resourceType": "SearchParameter", "url": f"urn:sp/{region}", "code": f"called-{region}", "type": "string", "base": mine, "expression": " | ".join(f"{m}.name" for m in mine)})
        out.append({"resourceType": "CompartmentDefinition", "url": f"urn:c/{region}", "code": mine[0], "resource": [{"code": m, "param": [f"called-{region}"]} for m in mine[1:]] + [{"code": "Patient"}]})
    out.append({"resourceType": "CodeSystem", "url": "urn:cs/parts", "content": "complete", "concept": [{"code": c} for c in codes]})
    out.append({"resourceType": "ValueSet", "url": "urn:vs/part-types", "compose": {"include": [{"system": "urn:cs/parts"}]}})
    return out


@registered("conformance_elements", """SELECT 'N' || n_nationkey AS type, e AS path, CASE WHEN e = 'name' THEN CAST(n_nationkey % 2 AS INT) ELSE 0 END AS low, CASE WHEN e IN ('near', 'part', 'part.inner') OR (e = 'name' AND n_nationkey % 3 = 0) THEN '*' ELSE '1' END AS high,
  CASE e WHEN 'name' THEN 'string' WHEN 'kind' THEN 'code' WHEN 'near' THEN 'Reference' WHEN 'value[x]' THEN 'string|integer' WHEN 'part' THEN 'BackboneElement' ELSE '#part' END AS kinds,
  CASE WHEN e = 'near' THEN 'N' || ((n_nationkey + 1) % (SELECT count(*) FROM nation)) ELSE '' END AS targets
  FROM nation CROSS JOIN (SELECT unnest(['name', 'kind', 'near', 'value[x]', 'part', 'part.inner']) AS e)""")
def conformance_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = compile_registry(definitions(spark, sf_dir), Registry())
    rows = [(t.name, e.path, e.min, e.max, "|".join(e.types), "|".join(e.targets)) for t in registry.types.values() if t.name[0] == "N" and t.name[1:].isdigit() for e in t.elements.values()]
    return spark.createDataFrame(rows, "type string, path string, low int, high string, kinds string, targets string")


@registered("conformance_invariants", "SELECT 'N' || n_nationkey AS type, 'n-' || n_nationkey AS key, 'name.exists()' AS expression FROM nation")
def conformance_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the constraints that a definition gives itself."""
    registry = compile_registry(definitions(spark, sf_dir), Registry())
    return spark.createDataFrame([(t.name, i.key, i.expression) for t in registry.types.values() if t.name[0] == "N" and t.name[1:].isdigit() for i in t.invariants], "type string, key string, expression string")


@registered("conformance_params", "SELECT 'N' || n_nationkey AS type, 'called-' || n_regionkey AS code, 'N' || n_nationkey || '.name' AS expression FROM nation")
def conformance_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = compile_registry(definitions(spark, sf_dir), Registry())
    return spark.createDataFrame([(b, p.code, p.expression) for p in registry.params if p.code.startswith("called-") for b in p.base], "type string, code string, expression string")


@registered("conformance_compartments", "SELECT 'N' || first AS compartment, 'N' || n_nationkey AS type, 'called-' || n_regionkey AS param FROM nation JOIN (SELECT n_regionkey AS r, min(n_nationkey) AS first FROM nation GROUP BY 1) ON n_regionkey = r WHERE n_nationkey <> first")
def conformance_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = compile_registry(definitions(spark, sf_dir), Registry())
    return spark.createDataFrame([(c, t, p) for c, types in registry.compartments.items() if c != "Patient" for t, ps in types.items() for p in ps], "compartment string, type string, param string")


@registered("conformance_bound_sets", "SELECT DISTINCT 'part-types' AS name, 'urn:cs/parts' AS system, p_type AS code FROM part")
def conformance_bound_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = compile_registry(definitions(spark, sf_dir), Registry())
    system, codes = registry.value_sets["part-types"]
    return spark.createDataFrame([("part-types", system, c) for c in codes], "name string, system string, code string")


@registered("conformance_profiles", """SELECT 'N' || n_nationkey AS type, 'name' AS path, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS low, CASE WHEN n_nationkey % 3 = 0 THEN '1' ELSE '*' END AS high, '' AS value FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0
  UNION ALL SELECT 'N' || n_nationkey, 'kind', 0, '*', (SELECT list_sort(list(DISTINCT p_type)) FROM part)[1 + n_nationkey % (SELECT count(DISTINCT p_type) FROM part)] FROM nation
  UNION ALL SELECT 'N' || n_nationkey, 'value', 0, '*', 'integer' FROM nation""")
def conformance_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What profiles ask beyond their types: nothing where a type asks as much."""
    docs = definitions(spark, sf_dir)
    registry = compile_registry(docs, Registry())
    made = [profile(d, registry) for d in docs if d.get("derivation") == "constraint"]
    return spark.createDataFrame([(p.type, r.path, r.min, r.max, str(r.fixed or r.type or "")) for p in made for r in p.rules], "type string, path string, low int, high string, value string")


@registered("conformance_search", "SELECT 'i' || n_nationkey AS id, n_name AS exact FROM nation")
def conformance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the compiled types are indexed by the compiled parameters."""
    from .operators.extract import wide_rows

    registry = compile_registry(definitions(spark, sf_dir), Registry())
    kind = F.concat(F.lit("N"), "n_nationkey")
    n = Star(spark, sf_dir).table("nation").withColumn("pid", F.col("n_nationkey").cast("long"))
    docs = n.select("pid", kind.alias("resource_type"), F.lit(False).alias("deleted"), F.to_json(F.struct(kind.alias("resourceType"), F.concat(F.lit("i"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name")).alias("name"))).alias("content"), "n_name", "n_nationkey")
    single = F.to_json(F.struct(kind.alias("resourceType"), F.concat(F.lit("i"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    docs = docs.withColumn("content", F.when(F.col("n_nationkey") % 3 == 0, F.col("content")).otherwise(single))
    types = [t for t in registry.types if t[0] == "N" and t[1:].isdigit()]
    rows = wide_rows(docs, types, text=False, registry=registry).where("tab = 'string'")
    return rows.select(F.concat(F.lit("i"), "pid").alias("id"), F.col("b").alias("exact"))


@registered("package_scan", "SELECT 'StructureDefinition' AS kind, 'http://hl7.org/fhir/StructureDefinition/N' || n_nationkey AS url FROM nation UNION ALL SELECT 'StructureDefinition', 'urn:profile/N' || n_nationkey FROM nation UNION ALL SELECT DISTINCT 'SearchParameter', 'urn:sp/' || n_regionkey FROM nation")
def package_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's folder, of which only the definitions of two kinds are read."""
    path = new_path(spark, "packages")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    for k, d in enumerate(definitions(spark, sf_dir)):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{d['resourceType']}-{k}.json"), True)
        out.write(bytearray(json.dumps(d).encode()))
        out.close()
    found = read_package(spark, path, ("StructureDefinition", "SearchParameter"))
    if len(documents_of(found)) != found.count():
        raise ValueError("a definition was lost")
    return found.select("kind", "url")


@registered("sqlite_round_trip", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_custkey % 2 = 0 AS even, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def sqlite_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.sql import read_sqlite, write_sqlite

    path = new_path(spark, "sqlite")
    d = Star(spark, sf_dir).table("customer")
    rows = d.select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"), (F.col("c_custkey") % 2 == 0).alias("even"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    write_sqlite(rows, path)
    return read_sqlite(spark, path, rows.schema)
