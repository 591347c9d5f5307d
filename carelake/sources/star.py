"""A star schema read as resources: current-version table, documents and index tables as lazy projections.

Every index is a union of projections with constant type and code, so a filter on
these prunes all other branches and only the columns in use are scanned. pids are
made of a type number and the source's key: stable, unique, and without a window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folding import folded, words
from ..operators.lower import Tables
from ..schemas import FULLTEXT, INDEXES, LAST, RESOURCE

TYPES = ("Patient", "Organization", "Location", "Encounter", "Observation", "Medication", "DocumentReference", "Communication", "ValueSet")
#: lastUpdated of all loaded resources: 2024-01-01T00:00:00Z.
LOADED = 1_704_067_200_000_000


def _pid(type_: str, key: Column, offset: int = 0) -> Column:
    return F.lit((TYPES.index(type_) << 56) + (offset << 48)) + key.cast("long")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def half(number: Column) -> Column:
    """Half a unit of the last written decimal."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -F.length(F.substring_index(number.cast("string"), ".", -1)))


class Star(Tables):
    """Only what a plan asks for is built: a branch for each type and code."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._read: dict[str, DataFrame] = {}
        self._branches = self._entries()

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._read[name]

    # resources: type -> (rows with pid and id, content expressions)

    def source(self, type_: str) -> DataFrame:
        """The type's rows with pid, id and what its content and indexes need."""
        if f"={type_}" not in self._read:
            self._read[f"={type_}"] = self._source(type_)
        return self._read[f"={type_}"]

    def _source(self, type_: str) -> DataFrame:
        def keyed(table: str, key: str, letter: str, **more: Column) -> DataFrame:
            return self.table(table).withColumns({"pid": _pid(type_, F.col(key)), "id": F.concat(F.lit(letter), key), **more})

        if type_ == "Patient":
            d = keyed("customer", "c_custkey", "c", organization=F.concat(F.lit("s"), F.pmod("c_custkey", F.lit(10))))
            return d.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if type_ == "Organization":
            return keyed("supplier", "s_suppkey", "s")
        if type_ == "Location":
            nation = self.table("nation").select(_pid(type_, F.col("n_nationkey")).alias("pid"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
            region = self.table("region").select(_pid(type_, F.col("r_regionkey"), 1).alias("pid"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
            return nation.unionByName(region)
        if type_ == "Encounter":
            return keyed("orders", "o_orderkey", "o")
        if type_ == "Observation":
            return keyed("events", "event_id", "e", k=F.get_json_object("props", "$.k"))
        if type_ == "Medication":
            return keyed("part", "p_partkey", "p")
        if type_ == "DocumentReference":
            return keyed("documents", "doc_id", "d")
        if type_ == "Communication":
            return self.table("conversations").withColumns({"pid": _pid(type_, F.col("conv_id") * 4096 + F.col("turn")), "id": F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn")})
        return keyed("pages", "page_id", "w")

    def _content(self, type_: str) -> Column:
        """The document as JSON; numbers keep their written form where Spark's own text does."""
        c, lit = F.col, F.lit
        coding = lambda system, code: F.struct(F.array(F.struct(lit(system).alias("system"), code.alias("code"))).alias("coding"), code.alias("text"))
        ref = lambda kind, id_: F.struct(F.concat(lit(f"{kind}/"), id_).alias("reference"))
        quantity = lambda v, unit: F.struct(v.alias("value"), lit(unit).alias("unit"), lit("urn:unit").alias("system"), lit(unit).alias("code"))
        extension = lambda url, **value: F.struct(lit(url).alias("url"), *[v.alias(k) for k, v in value.items()])
        fields: dict[str, list[Column]] = {
            "Patient": [
                F.array(extension("urn:balance", valueQuantity=quantity(c("c_acctbal"), "usd"))).alias("extension"),
                F.array(F.struct(lit("urn:mrn").alias("system"), c("c_custkey").cast("string").alias("value"))).alias("identifier"),
                F.array(F.struct(c("c_name").alias("family"))).alias("name"), F.array(F.struct(c("n_name").alias("country"))).alias("address"),
                coding("urn:segment", c("c_mktsegment")).alias("maritalStatus"), ref("Organization", c("organization")).alias("managingOrganization"),
            ],
            "Organization": [c("s_name").alias("name")],
            "Location": [c("name"), F.when(c("parent").isNotNull(), ref("Location", c("parent"))).alias("partOf")],
            "Encounter": [
                c("o_orderstatus").alias("status"), coding("urn:priority", c("o_orderpriority")).alias("priority"), ref("Patient", F.concat(lit("c"), "o_custkey")).alias("subject"),
                F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start")).alias("actualPeriod"),
            ],
            "Observation": [
                lit("final").alias("status"), coding("urn:event", c("event_type")).alias("code"), ref("Patient", F.concat(lit("c"), "user_id")).alias("subject"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("effectiveInstant"), quantity(c("value"), "u").alias("valueQuantity"),
                F.array(
                    F.struct(F.struct(F.array(F.struct(lit("urn:event").alias("system"), c("event_type").alias("code"))).alias("coding")).alias("code"), quantity(c("value").cast("decimal(20,2)"), "u").alias("valueQuantity")),
                    F.struct(F.struct(F.array(F.struct(lit("urn:prop").alias("system"), lit("k").alias("code"))).alias("coding")).alias("code"), quantity(c("k").cast("decimal(20,2)"), "u").alias("valueQuantity")),
                ).alias("component"),
            ],
            "Medication": [
                F.array(extension("urn:size", valueInteger=c("p_size"), valueQuantity=F.lit(None).cast("struct<value:double,unit:string,system:string,code:string>")), extension("urn:price", valueInteger=F.lit(None).cast("int"), valueQuantity=quantity(c("p_retailprice"), "usd"))).alias("extension"),
                F.struct(F.array(F.struct(lit("urn:brand").alias("system"), c("p_brand").alias("code")), F.struct(lit("urn:type").alias("system"), c("p_type").alias("code"))).alias("coding"), c("p_name").alias("text")).alias("code"),
            ],
            "DocumentReference": [c("lang").alias("language"), lit("current").alias("status"), F.array(coding("urn:source", c("source"))).alias("category"), F.struct(lit("additional").alias("status"), c("text").alias("div")).alias("text")],
            "Communication": [lit("completed").alias("status"), F.array(coding("urn:role", c("role"))).alias("category"), F.array(F.struct(c("text").alias("contentString"))).alias("payload")],
            "ValueSet": [c("url"), lit("active").alias("status")],
        }
        return F.to_json(F.struct(lit(type_).alias("resourceType"), c("id"), *fields[type_]))

    def resource(self, type_: str) -> DataFrame:
        return self.source(type_).select("pid", F.lit(type_).alias("resource_type"), F.col("id").alias("fhir_id"), F.lit(1).cast("long").alias("version_id"), F.lit(LOADED).cast("long").alias("last_updated"), F.lit(False).alias("deleted"), self._content(type_).alias("content"))

    # tables

    def get(self, table: str, type_: str | None = None, code: str | None = None) -> DataFrame:
        if table == "resource":
            kinds = [t for t in TYPES if type_ in (None, t)]
            return reduce(DataFrame.unionByName, map(self.resource, kinds)) if kinds else self.spark.createDataFrame([], RESOURCE)
        fits = [build for kind, t, c, build in self._branches if kind == table and type_ in (None, t) and code in (None, c)]
        if fits:
            return reduce(DataFrame.unionByName, [f() for f in fits])
        return self.spark.createDataFrame([], FULLTEXT if table == "fulltext" else INDEXES[table])

    def _entries(self) -> list[tuple[str, str, str, Callable[[], DataFrame]]]:
        """Every branch: index table, type, code and how it is built."""
        out: list[tuple[str, str, str, Callable[[], DataFrame]]] = []
        c, lit = F.col, F.lit

        def rows(table: str, type_: str, code: str, seq: int, test: str, columns: Callable[[], dict[str, Column]]) -> None:
            def build() -> DataFrame:
                d = self.source(type_).select("pid", lit(type_).alias("resource_type"), lit(code).alias("code"), lit(seq).alias("seq"), *[v.alias(k) if k in ("low", "high") else F.coalesce(v, lit("")).alias(k) for k, v in columns().items()])
                return d.where(test)

            out.append((table, type_, code, build))

        def string(type_: str, code: str, column: str) -> None:
            rows("string", type_, code, 0, "exact <> ''", lambda: {"norm": folded(c(column)), "exact": c(column)})

        def token(type_: str, code: str, system: str, v: Callable[[], Column], seq: int = 0) -> None:
            rows("token", type_, code, seq, "value <> ''", lambda: {"system": lit(system), "value": v()})

        def reference(type_: str, code: str, target: str, v: Callable[[], Column]) -> None:
            rows("reference", type_, code, 0, "target_id <> ''", lambda: {"target_type": lit(target), "target_id": v(), "url": F.concat(lit(f"{target}/"), v())})

        def quantity(type_: str, code: str, v: Callable[[], Column], unit: str, seq: int = 0, whole: bool = False) -> None:
            def columns() -> dict[str, Column]:
                x, h = v().cast("double"), lit(0.5) if whole else half(v().cast("double"))
                return {"low": x - h, "high": x + h, "system": lit("urn:unit"), "unit": lit(unit)}

            rows("quantity", type_, code, seq, "low is not null", columns)

        for type_, code, column in (
            ("Patient", "family", "c_name"), ("Patient", "name", "c_name"), ("Patient", "address-country", "n_name"), ("Patient", "address", "n_name"), ("Patient", "marital-status", "c_mktsegment"),
            ("Organization", "name", "s_name"), ("Location", "name", "name"), ("Medication", "name", "p_name"), ("Medication", "code", "p_name"),
            ("Observation", "code", "event_type"), ("Encounter", "priority", "o_orderpriority"), ("DocumentReference", "category", "source"), ("Communication", "role", "role"),
        ):
            string(type_, code, column)
        pair = "component-code-value-quantity"
        for type_, code, system, column, seq in (
            ("Patient", "identifier", "urn:mrn", "c_custkey", 0), ("Patient", "marital-status", "urn:segment", "c_mktsegment", 0),
            ("Encounter", "status", "", "o_orderstatus", 0), ("Encounter", "priority", "urn:priority", "o_orderpriority", 0),
            ("Observation", "status", "", "=final", 0), ("Observation", "code", "urn:event", "event_type", 0), ("Observation", "component-code", "urn:event", "event_type", 0), ("Observation", "component-code", "urn:prop", "=k", 0),
            ("Observation", "code-value-quantity$0", "urn:event", "event_type", 0), ("Observation", f"{pair}$0", "urn:event", "event_type", 0), ("Observation", f"{pair}$0", "urn:prop", "=k", 1),
            ("Medication", "code", "urn:brand", "p_brand", 0), ("Medication", "code", "urn:type", "p_type", 0),
            ("DocumentReference", "status", "", "=current", 0), ("DocumentReference", "language", "", "lang", 0), ("DocumentReference", "category", "urn:source", "source", 0),
            ("Communication", "status", "", "=completed", 0), ("Communication", "role", "urn:role", "role", 0), ("ValueSet", "status", "", "=active", 0),
        ):
            token(type_, code, system, lambda column=column: lit(column[1:]) if column.startswith("=") else c(column).cast("string"), seq)
        for type_, code, target, column in (
            ("Patient", "organization", "Organization", "organization"), ("Location", "partof", "Location", "parent"),
            ("Encounter", "subject", "Patient", "+o_custkey"), ("Encounter", "patient", "Patient", "+o_custkey"), ("Observation", "subject", "Patient", "+user_id"), ("Observation", "patient", "Patient", "+user_id"),
        ):
            reference(type_, code, target, lambda column=column: F.concat(lit("c"), c(column[1:])) if column.startswith("+") else c(column))
        for type_, code, column, unit, seq in (
            ("Patient", "balance", "c_acctbal", "usd", 0), ("Medication", "price", "p_retailprice", "usd", 0), ("Observation", "value-quantity", "value", "u", 0),
            ("Observation", "code-value-quantity$1", "value", "u", 0), ("Observation", f"{pair}$1", "value", "u", 0), ("Observation", f"{pair}$1", "k", "u", 1), ("Observation", "component-value-quantity", "value", "u", 0), ("Observation", "component-value-quantity", "k", "u", 1),
        ):
            quantity(type_, code, lambda column=column: c(column), unit, seq, column == "k")
        day, milli = lambda: micros(F.date_trunc("day", "o_orderdate")), lambda: F.floor(micros(c("ts")) / 1000).cast("long") * 1000
        rows("date", "Encounter", "date", 0, "low is not null", lambda: {"low": day(), "high": lit(LAST).cast("long")})
        rows("date", "Observation", "date", 0, "low is not null", lambda: {"low": milli(), "high": milli() + 999})
        rows("uri", "ValueSet", "url", 0, "value <> ''", lambda: {"value": c("url")})
        rows("number", "Medication", "size", 0, "low is not null", lambda: {"low": c("p_size").cast("double") - 0.5, "high": c("p_size").cast("double") + 0.5})

        def text(type_: str, narrative: str, *content: str) -> None:
            def build() -> DataFrame:
                both = words(F.coalesce(c(narrative), lit(""))) if narrative else F.array().cast("array<string>")
                return self.source(type_).select("pid", lit(type_).alias("resource_type"), both.alias("narrative"), words(F.concat_ws(" ", *content)).alias("content"))

            out.append(("fulltext", type_, "", build))

        text("DocumentReference", "text", "lang", "source", "text")
        text("Communication", "", "role", "text")
        text("Medication", "", "p_brand", "p_type", "p_name")
        return out
