"""Registered queries of the path language: one for each function or operator, over whole tables of documents."""

from __future__ import annotations

from .functions.fhirpath import parse
from .queries import over

_PATIENT = "SELECT 'c' || c_custkey AS id, {} AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"
_EVENT = "SELECT 'e' || event_id AS id, {} AS v FROM events"
_ORDER = "SELECT 'o' || o_orderkey AS id, {} AS v FROM orders"
_PART = "SELECT 'p' || p_partkey AS id, {} AS v FROM part"


def _text(test: str) -> str:
    """A truth value as the path language writes it; unknown is the empty text."""
    return f"CASE WHEN {test} THEN 'true' WHEN NOT ({test}) THEN 'false' ELSE '' END"


def patient(name: str, expression: str, sql: str) -> None:
    over(f"path_{name}", "Patient", expression, _PATIENT.format(sql))


def event(name: str, expression: str, sql: str) -> None:
    over(f"path_{name}", "Observation", expression, _EVENT.format(sql))


def order(name: str, expression: str, sql: str) -> None:
    over(f"path_{name}", "Encounter", expression, _ORDER.format(sql))


def part(name: str, expression: str, sql: str) -> None:
    over(f"path_{name}", "Medication", expression, _PART.format(sql))


_KEY, _FAMILY = "identifier.value.first()", "name.family.first()"
_K = "CAST(c_custkey AS VARCHAR)"
_CODES = "component.code.coding.code"
_HALF = "0.5 * pow(10.0, -length(split_part(CAST(value AS VARCHAR), '.', -1)))"

# collections
patient("empty", "name.where(family.endsWith('3')).empty()", _text("NOT ends_with(c_name, '3')"))
event("repeat", f"repeat(component).code.coding.code.join(',')", "event_type || ',k'")
patient("iif", "iif(maritalStatus.text = 'BUILDING', name.family, address.country)", "CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE n_name END")
patient("define_variable", f"defineVariable('f', {_FAMILY}).select(address.country.first() & '/' & %f)", "n_name || '/' || c_name")
patient("trace", "name.family.trace('names').upper()", "upper(c_name)")
event("sort", f"{_CODES}.sort().join(',')", "array_to_string(list_sort([event_type, 'k']), ',')")
event("sort_descending", f"{_CODES}.sort(-$this).join(',')", "array_to_string(list_reverse_sort([event_type, 'k']), ',')")
event("distinct", f"{_CODES}.combine(code.coding.code).distinct().join(',')", "event_type || ',k'")
part("is_distinct", "extension.value.ofType(integer).combine(code.coding.code.select(length())).isDistinct()", _text("p_size <> length(p_brand) AND p_size <> length(p_type) AND length(p_brand) <> length(p_type)"))
_ENDS = "name.family.select(endsWith('1')).combine(address.country.select(endsWith('1')))"
patient("all_true", f"{_ENDS}.allTrue()", _text("ends_with(c_name, '1') AND ends_with(n_name, '1')"))
patient("any_true", f"{_ENDS}.anyTrue()", _text("ends_with(c_name, '1') OR ends_with(n_name, '1')"))
patient("all_false", f"{_ENDS}.allFalse()", _text("NOT ends_with(c_name, '1') AND NOT ends_with(n_name, '1')"))
patient("any_false", f"{_ENDS}.anyFalse()", _text("NOT ends_with(c_name, '1') OR NOT ends_with(n_name, '1')"))
event("subset_of", f"code.coding.code.subsetOf({_CODES}.where($this != 'click'))", _text("event_type <> 'click'"))
event("superset_of", f"{_CODES}.where($this != 'click').supersetOf(code.coding.code)", _text("event_type <> 'click'"))
patient("single", "identifier.single().value", _K)
event("tail", f"{_CODES}.combine(code.text).tail().join(',')", "'k,' || event_type")
event("take", f"{_CODES}.take(1)", "event_type")
event("intersect", f"{_CODES}.intersect(code.coding.code)", "event_type")
event("exclude", f"{_CODES}.combine('click').exclude(code.coding.code).join(',')", "CASE WHEN event_type = 'click' THEN 'k' ELSE 'k,click' END")
event("union", f"{_CODES}.union(code.coding.code).join(',')", "event_type || ',k'")
event("combine", f"{_CODES}.combine(code.coding.code).join(',')", "event_type || ',k,' || event_type")
part("index", "code.coding[1].code & '/' & code.coding[0].code", "p_type || '/' || p_brand")
event("membership_in", "code.text in ('click' | 'view')", _text("event_type IN ('click', 'view')"))
event("membership_contains", "('click' | 'view') contains code.text", _text("event_type IN ('click', 'view')"))
event("index_variable", f"{_CODES}.select($this & $index.toString()).join(',')", "event_type || '0,k1'")

# nodes and types
patient("children", "maritalStatus.children().ofType(string)", "c_mktsegment")
patient("descendants", "maritalStatus.descendants().ofType(code)", "c_mktsegment")
patient("extension", "extension('urn:balance').value.value > 5000", _text("c_acctbal > 5000"))
patient("has_value", f"maritalStatus.text.hasValue() and {_KEY}.endsWith('3')", _text(f"ends_with({_K}, '3')"))
patient("get_value", "maritalStatus.text.getValue().lower()", "lower(c_mktsegment)")
order("resolve", "subject.where(resolve() is Patient).reference", "'Patient/c' || o_custkey")
patient("conforms_to", f"conformsTo('http://hl7.org/fhir/StructureDefinition/Patient') and {_KEY}.endsWith('2')", _text(f"ends_with({_K}, '2')"))
event("type", "value.type().name & ':' & code.text", "'Quantity:' || event_type")
event("of_type", "effective.ofType(instant).exists() and value.ofType(Quantity).value > 100", _text("value > 100"))
event("is_operator", "iif(value is Quantity, code.text, 'no')", "event_type")
event("is_function", "iif(value.is(string), 'no', code.text)", "event_type")
event("as_operator", "(value as Quantity).value > 250", _text("value > 250"))
event("as_function", "value.as(Quantity).unit & code.text", "'u' || event_type")
patient("type_name_as_focus", f"Patient.{_FAMILY}", "c_name")
patient("environment", f"%resource.{_FAMILY} & %context.identifier.value.first() & %ucum.substring(7, 4)", f"c_name || {_K} || 'unit'")

# an expression printed and parsed again means the same
patient("printed", str(parse("name . where( (family.endsWith('7') or family.endsWith('9')) and true ).select( family & ('-' & %resource.address[0].country) )")), "CASE WHEN ends_with(c_name, '7') OR ends_with(c_name, '9') THEN c_name || '-' || n_name ELSE '' END")

# truth and comparison
patient("not", "(maritalStatus.text = 'BUILDING').not()", _text("c_mktsegment <> 'BUILDING'"))
patient("xor_implies", "(maritalStatus.text = 'BUILDING' xor name.family.first().endsWith('1')) implies address.country.first().endsWith('3')", _text("NOT ((c_mktsegment = 'BUILDING') <> ends_with(c_name, '1')) OR ends_with(n_name, '3')"))
event("less_and_greater", "value.value >= 100 and value.value < 300.5", _text("value >= 100 AND value < 300.5"))
event("at_most_and_above", "value.value <= 50 or value.value > 400", _text("value <= 50 OR value > 400"))
patient("equivalent", "maritalStatus.text ~ 'building' and address.country.first() !~ 'nation_3'", _text("c_mktsegment = 'BUILDING' AND n_name <> 'NATION_3'"))
order("temporal_compare", "actualPeriod.start >= @1995-06-01", _text("o_orderdate >= DATE '1995-06-01'"))
order("temporal_partial", "actualPeriod.start > @1996", "CASE WHEN year(o_orderdate) > 1996 THEN 'true' WHEN year(o_orderdate) < 1996 THEN 'false' ELSE '' END")
event("quantity_compare", "value > 100 'u'", _text("value > 100"))
patient("quantity_alignment", f"({_KEY} & ' \\'g\\'').toQuantity() > 1 'kg'", _text("c_custkey > 1000"))
event("comparable", "value.comparable(1 'mg') or code.text = 'click'", _text("event_type = 'click'"))

# arithmetic
patient("unary_minus", f"-({_KEY}.toInteger())", "CAST(-c_custkey AS VARCHAR)")
patient("arithmetic", f"{_KEY}.toInteger() div 7 + {_KEY}.toInteger() mod 7 * 3 - 1", "CAST(c_custkey // 7 + c_custkey % 7 * 3 - 1 AS VARCHAR)")
patient("division", f"{_KEY}.toInteger() / 4 > 25.25", _text("c_custkey / 4.0 > 25.25"))
patient("abs", f"(100 - {_KEY}.toInteger()).abs()", "CAST(abs(100 - c_custkey) AS VARCHAR)")
event("ceiling", "value.value.ceiling()", "CAST(CAST(ceil(value) AS BIGINT) AS VARCHAR)")
event("truncate", "(-value.value).truncate()", "CAST(-CAST(trunc(value) AS BIGINT) AS VARCHAR)")
event("round", "value.value.round(1) > 100.5", _text("round(CAST(value AS DECIMAL(18, 4)), 1) > 100.5"))
event("sqrt", "value.value.sqrt() > 10.5", _text("sqrt(value) > 10.5"))
event("exp", "(value.value / 1000).exp() < 1.25", _text("exp(value / 1000) < 1.25"))
event("ln", "(value.value + 1).ln() > 4.5", _text("ln(value + 1) > 4.5"))
event("log", "(value.value + 1).log(10) > 2.2", _text("log10(value + 1) > 2.2"))
patient("power", f"{_KEY}.toInteger().power(2)", "CAST(CAST(c_custkey AS BIGINT) * c_custkey AS VARCHAR)")
event("precision", "value.value.precision()", "CAST(length(split_part(CAST(value AS VARCHAR), '.', -1)) AS VARCHAR)")
event("low_boundary", "value.value.lowBoundary(6).toString()", f"printf('%.6f', value - {_HALF})")
event("high_boundary", "value.value.highBoundary(6).toString()", f"printf('%.6f', value + {_HALF})")
event("aggregate_largest", "(value.value | component.value.value.last()).aggregate(iif($total.empty() or $this > $total, $this, $total)) > 90", _text("greatest(value, CAST(json_extract(props, '$.k') AS DOUBLE)) > 90"))

# strings
patient("trim", f"(' ' & {_FAMILY} & '  ').trim()", "c_name")
patient("to_chars", "maritalStatus.text.toChars().join('-')", "array_to_string(string_split(c_mktsegment, ''), '-')")
patient("starts_with", "maritalStatus.text.startsWith('B')", _text("starts_with(c_mktsegment, 'B')"))
patient("contains", "maritalStatus.text.contains('U')", _text("contains(c_mktsegment, 'U')"))
patient("index_of", "maritalStatus.text.indexOf('I')", "CAST(strpos(c_mktsegment, 'I') - 1 AS VARCHAR)")
patient("last_index_of", "maritalStatus.text.lastIndexOf('I')", "CAST(CASE WHEN contains(c_mktsegment, 'I') THEN length(c_mktsegment) - strpos(reverse(c_mktsegment), 'I') ELSE -1 END AS VARCHAR)")
patient("substring", f"{_FAMILY}.substring(9).substring(5, 3)", "substr(c_name, 15, 3)")
patient("matches", f"{_FAMILY}.matches('0[1-5]$')", _text("regexp_matches(c_name, '0[1-5]$')"))
patient("matches_full", f"{_FAMILY}.matchesFull('Customer#0+[1-9]+')", _text("regexp_full_match(c_name, 'Customer#0+[1-9]+')"))
patient("replace_matches", f"{_FAMILY}.replaceMatches('([a-z])#0+', '$1-')", "regexp_replace(c_name, '([a-z])#0+', '\\1-')")
patient("split", f"{_FAMILY}.split('#').join('|')", "replace(c_name, '#', '|')")
patient("encode_base64", f"{_FAMILY}.encode('base64')", "base64(encode(c_name))")
patient("encode_hex", f"{_FAMILY}.encode('hex')", "lower(hex(encode(c_name)))")
patient("decode", f"{_FAMILY}.encode('urlbase64').decode('urlbase64').lower()", "lower(c_name)")
patient("escape", f"('<' & {_FAMILY} & '>').escape('html')", "'&lt;' || c_name || '&gt;'")
patient("unescape", f"('&lt;' & {_FAMILY} & '&amp;').unescape('html')", "'<' || c_name || '&'")

# conversions
event("to_boolean", "iif(code.text = 'click', 'yes', 'n').toBoolean()", _text("event_type = 'click'"))
patient("to_decimal", f"{_KEY}.toDecimal() > 100.5", _text("c_custkey > 100.5"))
order("to_date", "actualPeriod.start.toString().toDate() < @1996-02-01", _text("o_orderdate < DATE '1996-02-01'"))
order("to_date_time", "(actualPeriod.start.toString().toDateTime() + 1 year).toString().substring(0, 7)", "strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m')")
event("to_time", "effective.ofType(instant).toString().substring(11, 8).toTime() >= @T12:00:00", _text("hour(ts) >= 12"))
patient("to_quantity", f"({_KEY} & ' days').toQuantity() > 100 days", _text("c_custkey > 100"))
_ONE = "{}.endsWith('1')".format(_FAMILY)
_SQL1 = "ends_with(c_name, '1')"
patient("converts_to_string", f"iif({_ONE}, {_KEY}, maritalStatus.text).convertsToString() and {_ONE}", _text(_SQL1))
patient("converts_to_boolean", f"{_KEY}.substring(0, 1).convertsToBoolean()", _text(f"{_K}[1] IN ('0', '1')"))
patient("converts_to_integer", f"iif({_ONE}, {_KEY}, 'x').convertsToInteger()", _text(_SQL1))
patient("converts_to_decimal", f"iif({_ONE}, {_KEY} & '.5', '1.').convertsToDecimal()", _text(_SQL1))
order("converts_to_date", "iif(status = 'F', actualPeriod.start.toString(), 'x').convertsToDate()", _text("o_orderstatus = 'F'"))
order("converts_to_date_time", "iif(status = 'F', actualPeriod.start.toString() & 'T10:00:00Z', 'x').convertsToDateTime()", _text("o_orderstatus = 'F'"))
event("converts_to_time", "iif(code.text = 'click', '12:30', '99:99').convertsToTime()", _text("event_type = 'click'"))
patient("converts_to_quantity", f"({_KEY} & iif({_ONE}, ' days', ' leagues')).convertsToQuantity()", _text(_SQL1))

# the clock
event("now", "now() > @2000-01-01T00:00:00Z and code.text = 'click'", _text("event_type = 'click'"))
event("today", "today() > @2000-01-01 and code.text = 'view'", _text("event_type = 'view'"))
event("time_of_day", "timeOfDay() >= @T00:00:00.000 and code.text = 'error'", _text("event_type = 'error'"))
order("date_minus_days", "(actualPeriod.start - 40 days).toString()", "strftime(o_orderdate - INTERVAL 40 DAY, '%Y-%m-%d')")
