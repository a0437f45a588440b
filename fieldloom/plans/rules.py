"""Unit, compatibility, name and evidence rules over whole tables of stand-in fields.

A part is a field: its wording is made from its columns so that all branches of the
rules occur. The SQL is generated from the same vocabularies by other means: CASE
chains and lookups in VALUES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import names as N
from ..functions import rules as G
from ..functions import statements as T
from ..functions import units as U
from ..functions import vocabulary as V
from ..functions.portable import rounded
from .base import Registry, table

registry = Registry()
query = registry.query

#: Spellings, names, tables and specimens that a part's number picks from.
UNITS = ["mmHg", " MM HG ", "degF", "c", "mEq/L", "mmol/l", "K/uL", "10*3/ul", "lb", "kg", "", "n/a", "foo", "mcg/kg/min", "mcg/min", "mg/dl", "g/dL", "L/min", "ml/h", "%", "inches"]
NAMES = [
    "Temperature (C)", "Temperature (F)", "Non-Invasive BP Mean", "Invasive BP Mean", "MAP (mmHg)", "Arterial Line MAP (mmHg)",
    "Bedside Glucose", "Respiratory Rate (Set)", "SaO2", "SpO2", "platelets x 1000", "Albumin, Ascites", "Protein, Urine", "Heart Rate",
    "Norepinephrine mcg/kg/min", "Vital Signs|Heart Rate|HR", "O2 Sat", "Hgb",
]
TABLES = [*V.TABLE_FAMILIES, "unknown.table"]
SPECIMENS = ["Blood", "Urine", "Ascites", "Cerebrospinal Fluid (CSF)", "Cerebrospinal Fluid x", "Stool", "", "Pleural fluid"]
TYPES = ["numeric", "categorical", "mixed", ""]


def text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def lookup_sql(key: str, table_: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table_.items()) + " END"


def first_sql(value: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, {text('(?i)' + p)}) THEN {text(v)}" for p, v in rules) + " END"


def pick(values: list[str], step: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") * step % len(values)).cast("int"))


def pick_sql(values: list[str], step: int) -> str:
    return f"{listed(values)}[(p_partkey * {step}) % {len(values)} + 1]"


SLOTS = {"raw_name": (NAMES, 5), "src_table": (TABLES, 7), "unit_observed": (UNITS, 11), "dtype_inferred": (TYPES, 3), "specimen": (SPECIMENS, 5)}


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fields: a part and its successor in the picks."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    for side, shift in (("a_", 0), ("b_", 3)):
        part = part.withColumns({side + k: pick(values, step + shift) for k, (values, step) in SLOTS.items()})
        part = part.withColumn(side + "dtype_declared", (F.col("p_partkey") + shift) % 2 == 0)
    return part


PAIRS_SQL = "SELECT p_partkey, p_retailprice, p_size, " + ", ".join(
    f"{pick_sql(values, step + shift)} AS {side}{k}" for side, shift in (("a_", 0), ("b_", 3)) for k, (values, step) in SLOTS.items()
) + ", p_partkey % 2 = 0 AS a_dtype_declared, (p_partkey + 3) % 2 = 0 AS b_dtype_declared FROM part"

TIDY = r"lower(trim(regexp_replace({u}, '\s+', ' ', 'g')))"


def unit_sql(u: str) -> str:
    tidy = TIDY.format(u=u)
    known = listed(list(V.UNIT_ALIASES))
    return (
        f"CASE WHEN {u} IS NULL THEN NULL WHEN list_contains({known}, {tidy}) THEN {lookup_sql(tidy, V.UNIT_ALIASES)} "
        f"WHEN list_contains({known}, replace({tidy}, ' ', '')) THEN {lookup_sql(f"replace({tidy}, ' ', '')", V.UNIT_ALIASES)} ELSE trim({u}) END"
    )


def relation_sql(a: str, b: str) -> str:
    known = ", ".join(f"({text(x)}, {text(y)})" for x, y, f, *_ in V.UNIT_CONVERSIONS if f is not None)
    open_ = ", ".join(f"({text(x)}, {text(y)})" for x, y, f, *_ in V.UNIT_CONVERSIONS if f is None)
    da, db = (lookup_sql(x, V.UNIT_DIMENSIONS) for x in (a, b))
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown' WHEN {a} = {b} THEN 'same' WHEN ({a}, {b}) IN ({known}) THEN 'convertible' "
        f"WHEN ({a}, {b}) IN ({open_}) THEN 'unknown' WHEN ({b}, {a}) IN ({known}) THEN 'convertible' WHEN ({b}, {a}) IN ({open_}) THEN 'unknown' "
        f"WHEN {da} <> {db} THEN 'conflict' ELSE 'unknown' END"
    )


UNIT_PAIRS_SQL = f"SELECT *, {unit_sql('a_unit_observed')} AS ua, {unit_sql('b_unit_observed')} AS ub FROM ({PAIRS_SQL})"


@query(f"SELECT p_partkey, a_unit_observed AS spelling, ua AS unit, {lookup_sql('ua', V.UNIT_DIMENSIONS)} AS dimension FROM ({UNIT_PAIRS_SQL})")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fields(spark, sf_dir).withColumn("unit", U.normalize_unit(F.col("a_unit_observed")))
    return known.select("p_partkey", F.col("a_unit_observed").alias("spelling"), "unit", U.dimension(F.col("unit")).alias("dimension"))


@query(f"SELECT ua, ub, {relation_sql('ua', 'ub')} AS relation, count(*) AS n FROM ({UNIT_PAIRS_SQL}) GROUP BY ua, ub")
def unit_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fields(spark, sf_dir).select(U.normalize_unit(F.col("a_unit_observed")).alias("ua"), U.normalize_unit(F.col("b_unit_observed")).alias("ub"))
    return pairs.groupBy("ua", "ub").agg(F.count(F.lit(1)).alias("n")).withColumn("relation", U.relation(F.col("ua"), F.col("ub")))


CONVERSIONS_SQL = "(VALUES " + ", ".join(f"({text(a)}, {text(b)}, {f!r}::DOUBLE, {o!r}::DOUBLE)" for a, b, f, o, *_ in V.UNIT_CONVERSIONS if f is not None) + ") c(f, t, factor, off)"


@query(f"""SELECT p_partkey, round(CASE WHEN ua = ub THEN p_retailprice ELSE (p_retailprice + off) * factor END, 4) AS converted
FROM ({UNIT_PAIRS_SQL}) LEFT JOIN {CONVERSIONS_SQL} ON ua = f AND ub = t""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = U.convert(F.col("p_retailprice"), F.col("a_unit_observed"), F.col("b_unit_observed"))
    return fields(spark, sf_dir).select("p_partkey", rounded(value, 4).alias("converted"))


TOLD_SQL = first_sql("{s}_raw_name", V.NAME_UNITS)
EFFECTIVE_SQL = f"""
SELECT *, coalesce(ua, na) AS ea, coalesce(ub, nb) AS eb,
  CASE WHEN ua IS NOT NULL THEN 'measured' WHEN na IS NOT NULL THEN 'from_name' ELSE 'missing' END AS sa
FROM (SELECT *, {TOLD_SQL.replace('{s}', 'a')} AS na, {TOLD_SQL.replace('{s}', 'b')} AS nb FROM ({UNIT_PAIRS_SQL}))"""


@query(f"SELECT p_partkey, na AS told, sa AS source, ea AS unit FROM ({EFFECTIVE_SQL})")
def unit_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = U.effective_unit(F.col("a_unit_observed"), F.col("a_raw_name"))
    return fields(spark, sf_dir).select("p_partkey", U.unit_from_name(F.col("a_raw_name")).alias("told"), e["source"].alias("source"), e["unit"].alias("unit"))


METHOD_SQL = first_sql("{s}_raw_name", V.METHODS)
S = "lower(trim({s}_specimen))"
WORD_SQL = f"lower(regexp_extract({{s}}_raw_name, {text('(?i)' + V.SPECIMEN_IN_NAME)}, 1))"
SPECIMEN_SQL = (
    f"coalesce({lookup_sql(S, V.SPECIMENS)}, CASE WHEN {S} = '' THEN NULL "
    + " ".join(f"WHEN contains({S}, {text(k)}) THEN {text(v)}" for k, v in V.SPECIMENS.items())
    + f" END, CASE WHEN {WORD_SQL} = '' THEN NULL WHEN contains({WORD_SQL}, 'csf') OR contains({WORD_SQL}, 'cerebro') THEN 'csf' "
    f"WHEN contains({WORD_SQL}, 'urin') THEN 'urine' WHEN contains({WORD_SQL}, 'stool') THEN 'stool' ELSE 'body_fluid' END)"
)
FACTS_SQL = f"SELECT *, {relation_sql('ea', 'eb')} AS rel" + "".join(
    f", {METHOD_SQL.replace('{s}', s)} AS m{s}, {SPECIMEN_SQL.replace('{s}', s)} AS sp{s}, {lookup_sql(s + '_src_table', V.TABLE_FAMILIES)} AS f{s}, "
    f"coalesce(nullif({s}_dtype_inferred, ''), 'unknown') AS t{s}"
    for s in "ab"
) + f" FROM ({EFFECTIVE_SQL})"
CONFLICT_SQL = "(least(fa, fb), greatest(fa, fb)) IN (" + ", ".join(f"({text(a)}, {text(b)})" for a, b in V.FAMILY_CONFLICTS) + ")"
BEDSIDE_SQL = " AND ".join(f"list_contains({listed(V.BEDSIDE_GROUP)}, {f})" for f in ("fa", "fb"))


def verdicts_sql(concept_mode: bool) -> str:
    return f"""SELECT *, CASE WHEN rel IN ('same', 'convertible') THEN 0.0 WHEN rel = 'conflict' THEN 1.0 ELSE 0.5 END::DOUBLE AS v_unit,
  CASE WHEN ta IN ('unknown', 'mixed') OR tb IN ('unknown', 'mixed') THEN 0.5 WHEN ta = tb THEN 0.0
    WHEN a_dtype_declared AND b_dtype_declared THEN 1.0 ELSE 0.5 END::DOUBLE AS v_type,
  CASE WHEN ma IS NOT NULL AND mb IS NOT NULL AND ma <> mb THEN 1.0 WHEN fa IS NULL OR fb IS NULL THEN 0.5
    WHEN {CONFLICT_SQL} THEN {0.5 if concept_mode else 1.0} WHEN fa = fb AND (ma IS NULL) <> (mb IS NULL) THEN 0.5 WHEN fa = fb THEN 0.0
    WHEN {BEDSIDE_SQL} THEN 0.0 ELSE 0.5 END::DOUBLE AS v_prov,
  CASE WHEN spa IS NULL OR spb IS NULL THEN 0.5 WHEN spa = spb THEN 0.0 ELSE 1.0 END::DOUBLE AS v_specimen,
  CASE WHEN ma IS NULL THEN 0.0 WHEN mb IS NOT NULL THEN CASE WHEN ma = mb THEN 0.0 ELSE 1.0 END
    WHEN {" OR ".join(f"contains(lower(trim(b_raw_name)), {text(k)})" for k in V.METHOD_BEARING_CONCEPTS)} THEN 0.5 ELSE 1.0 END::DOUBLE AS v_method
FROM ({FACTS_SQL})"""


def gates(spark: SparkSession, sf_dir: str, concept_mode: bool) -> DataFrame:
    a, b = G.Field.at("a_", prepared=True), G.Field.at("b_", prepared=True)
    known = G.prepare(G.prepare(fields(spark, sf_dir), "a_"), "b_")
    return known.select("p_partkey", "p_retailprice", "p_size", G.gate(a, b, concept_mode).alias("g"), G.v_method(a, b).alias("v_method"))


@query(f"SELECT p_partkey, v_unit, v_type, v_prov, v_specimen, v_method, v_unit = 1 OR v_type = 1 OR v_specimen = 1 OR v_prov = 1 AS hard_reject FROM ({verdicts_sql(False)})")
def gate_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(spark, sf_dir, False).select("p_partkey", "g.v_unit", "g.v_type", "g.v_prov", "g.v_specimen", "v_method", "g.hard_reject")


@query(f"SELECT v_prov, v_unit, v_type, v_specimen, count(*) AS n FROM ({verdicts_sql(True)}) GROUP BY ALL")
def gate_concept_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(spark, sf_dir, True).groupBy("g.v_prov", "g.v_unit", "g.v_type", "g.v_specimen").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT p_partkey, CASE WHEN v_unit = 1 OR v_type = 1 OR v_specimen = 1 OR v_prov = 1 THEN NULL
  ELSE round(p_retailprice / 1000 - v_unit - v_type - 0.5 * v_prov, 6) END AS score FROM ({verdicts_sql(True)})""")
def soft_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = G.gated_score(F.col("p_retailprice") / 1000, F.col("g"), (1.0, 1.0, 0.5))
    finite = F.when(score > float("-inf"), rounded(score, 6))
    return gates(spark, sf_dir, True).select("p_partkey", finite.alias("score"))


@query(f"SELECT a_raw_name AS name, ma AS method, count(*) AS n FROM ({FACTS_SQL}) GROUP BY ALL")
def method_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fields(spark, sf_dir).select(F.col("a_raw_name").alias("name"), G.method(F.col("a_raw_name")).alias("method"))
    return named.groupBy("name", "method").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT a_specimen AS specimen, a_raw_name AS name, spa AS class, fa AS family, count(*) AS n FROM ({FACTS_SQL}) GROUP BY ALL")
def specimen_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    specimen, name = F.col("a_specimen"), F.col("a_raw_name")
    told = fields(spark, sf_dir).select(
        specimen.alias("specimen"), name.alias("name"), G.specimen_class(specimen, name).alias("class"), G.family(F.col("a_src_table")).alias("family")
    )
    return told.groupBy("specimen", "name", "class", "family").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN v_method = 1 THEN 'flagged' ELSE 'clear' END AS verdict, ma AS method, count(*) AS n FROM ({verdicts_sql(True)}) GROUP BY ALL")
def method_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.Field.at("a_"), G.Field.at("b_")
    told = fields(spark, sf_dir).select(F.when(G.v_method(a, b) == 1, "flagged").otherwise("clear").alias("verdict"), G.method(a.raw_name).alias("method"))
    return told.groupBy("verdict", "method").agg(F.count(F.lit(1)).alias("n"))


# --- names ------------------------------------------------------------------------
SEGMENT = "list_last(string_split({x}, '|'))"


def name_sql(x: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace({SEGMENT.replace('{x}', f'lower({x})')}, '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
    words = f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce({lookup_sql('w', V.NAME_ABBREVIATIONS)}, w)), ' ')"
    return f"coalesce({lookup_sql(plain, V.NAME_ABBREVIATIONS)}, {words})"


@query(f"SELECT name, {name_sql('name')} AS normalized, n FROM (SELECT a_raw_name || CASE WHEN p_size % 2 = 0 THEN ' temp!' ELSE '' END AS name, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY ALL)")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("a_raw_name", F.when(F.col("p_size") % 2 == 0, " temp!").otherwise(""))
    counted = fields(spark, sf_dir).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("normalized", N.normalize_name(F.col("name")))


RAW_CONCEPTS = ["'HeartRate_min'", "temp_c_max_first", "O2 Saturation", "pH", "Whatever (x)", "SysBP_mean", "gcs", "nibp_mean", "rate-dopamine", "a__b_", "glucose_median_24hours"]


def concept_sql(x: str) -> str:
    s = rf"trim(regexp_replace(regexp_replace(lower(trim(trim({x}), '''\"')), '[\s\-/().,]+', '_', 'g'), '_+', '_', 'g'), '_')".replace('\\"', '"')
    for _ in range(3):
        s = f"regexp_replace({s}, {text(V.AGGREGATE_SUFFIX)}, '')"
    return s


RAW_CONCEPT_SQL = f"{pick_sql(RAW_CONCEPTS, 7)} || CASE p_size % 4 WHEN 0 THEN '_min' WHEN 1 THEN ' - max' WHEN 2 THEN ' ' || lower(p_type) ELSE '' END"


@query(f"WITH r AS (SELECT DISTINCT {RAW_CONCEPT_SQL} AS raw FROM part), s AS (SELECT raw, {concept_sql('raw')} AS s FROM r) "
       + f"SELECT raw, coalesce({lookup_sql("replace(s, '_', '')", V.CONCEPT_SYNONYMS)}, {lookup_sql('s', V.CONCEPT_SYNONYMS)}, s) AS concept FROM s")
def concept_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    rest = F.when(k == 0, "_min").when(k == 1, " - max").when(k == 2, F.concat(F.lit(" "), F.lower("p_type"))).otherwise("")
    raw = table(spark, sf_dir, "part").select(F.concat(pick(RAW_CONCEPTS, 7), rest).alias("raw")).distinct()
    return raw.withColumn("concept", N.normalize_concept(F.col("raw")))


CONCEPTS = ["sbp_noninvasive", "mbp_ni", "nibp", "ibp", "glucose_bedside", "rr_set", "gcs_total", "heart_rate", "inv1_site", "inv12_type", "label", "x", "dbp_invasive"]
BASE_SQL = " ".join(f"WHEN ends_with(c, {text(s)}) THEN substr(c, 1, length(c) - {len(s)})" for s, _ in V.METHOD_SUFFIXES)
KIND_SQL = " ".join(f"WHEN ends_with(c, {text(s)}) THEN {text(m)}" for s, m in V.METHOD_SUFFIXES)


@query(f"""SELECT c AS concept, CASE WHEN c IN ('nibp', 'ibp') THEN 'bp' {BASE_SQL} ELSE c END AS base,
  CASE WHEN c = 'nibp' THEN 'noninvasive' WHEN c = 'ibp' THEN 'invasive' {KIND_SQL} ELSE 'unspecified' END AS method,
  c IN ({", ".join(map(text, V.ARTEFACTS))}) OR regexp_matches(c, {text(V.ARTEFACT_PATTERN)}) OR length(c) <= 1 AS artefact
FROM (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN lower(p_type) || '_' ELSE '' END || {pick_sql(CONCEPTS, 5)} AS c FROM part)""")
def concept_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("p_size") % 3 == 0, F.concat(F.lower("p_type"), F.lit("_"))).otherwise("")
    named = table(spark, sf_dir, "part").select(F.concat(before, pick(CONCEPTS, 5)).alias("concept")).distinct()
    found = named.withColumn("b", N.base_and_method(F.col("concept")))
    return found.select("concept", "b.base", "b.method", N.is_artefact(F.col("concept")).alias("artefact"))


#: Source statements of a part, of seven kinds; {k}, {s}, {n} and {t} are its key, size, name and type.
STATEMENTS = [
    "MAX(CASE WHEN itemid = {k} THEN valuenum END) AS {t}_x,",
    "MAX(CASE WHEN itemid IN ({k}, {s}) AND v > 0 THEN CASE WHEN u THEN v END END ) AS c{s},",
    "when itemid in ({k},{s}) and v > 0 then 1 -- {n} {t}, bpm",
    "CASE WHEN itemid = {k} THEN '{n}' WHEN itemid = {s} THEN 'L{k}' ELSE null END AS label{s},",
    "max(case when labname in ('{n}', 'lab {k}') then r else null end) as lab{s}, max(case when labname = '{t}' then r end) as t{s},",
    "max(case when respchartvaluelabel in ('{n}', 'resp {k}') then v else null end) as fio{s},",
    "max(case when nursingchartcelltypevallabel = '{t}' and nursingchartcelltypevalname = '{n}' and x = {s} then v else null end) as nurse{s}, CASE WHEN itemid IN (",
]
_PARTS = {"k": "p_partkey", "s": "p_size", "n": "p_name", "t": "p_type"}


def _split(statement: str) -> list[tuple[bool, str]]:
    """Pieces of a statement: (is a column, text or column)."""
    pieces = statement.replace("{", "}\0").split("}")
    return [(p.startswith("\0"), _PARTS[p[1:]] if p.startswith("\0") else p) for p in pieces if p]


_LINE_SQL = "CASE p_partkey % 7 " + " ".join(
    f"WHEN {i} THEN " + " || ".join(p if is_column else text(p) for is_column, p in _split(s)) for i, s in enumerate(STATEMENTS)
) + " END"
FILES_SQL = f"SELECT p_brand || '.sql' AS src_file, string_agg({_LINE_SQL}, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text, db): the statements of a brand's parts are one file."""
    ways = [F.concat(*(F.col(p).cast("string") if is_column else F.lit(p) for is_column, p in _split(s))) for s in STATEMENTS]
    line = F.get(F.array(*ways), (F.col("p_partkey") % 7).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    files = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.lit(".sql")).alias("file")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return files.withColumn("db", F.lit("x"))


def _pattern_sql(name: str, pattern: str, one: str, many: str | None, ids: str, concept: int, body: int | None) -> str:
    """Triples by one pattern over both ends of a statement, as regular expressions scan for it."""
    def groups(n: int) -> str:
        return f"regexp_extract_all(text, {text(pattern)}, {n})"

    several = f"unnest({groups(int(many))}) AS many" if many else "'' AS many"
    long = f"unnest({groups(body)}) AS body" if body else "'' AS body"
    listed_ = f"CASE WHEN one <> '' THEN [one] ELSE regexp_extract_all(many, {text(ids)}, 1) END"
    return f"""SELECT src_file, unnest({listed_}) AS field_key, trim(concept) AS concept_raw, '{name}' AS pattern
FROM (SELECT src_file, {one if one.startswith("unnest") else f"unnest({groups(int(one))})" if one else "''"} AS one, {several}, unnest({groups(concept)}) AS concept, {long} FROM f) WHERE length(body) <= 900"""


#: The same statements by patterns that span them (fixed values), for the SQL.
SPANNING = [
    ("P1", r"(?is)CASE\s+WHEN\s+itemid\s*(?:=\s*(\d+)|IN\s*\(([^)]*)\))(.*?)END\s*\)?\s*AS\s+([A-Za-z_][\w]*)", "1", "2", r"(\d+)", 4, None),
    ("P2", r"(?i)when\s+itemid\s+in\s*\(([^)]*)\).*?then\s+\d+\s*--\s*([^\n,]+)", "", "1", r"(\d+)", 2, None),
    ("P3", r"(?i)WHEN\s+itemid\s*=\s*(\d+)\s+THEN\s+'([^']+)'", "1", None, r"(\d+)", 2, None),
    ("P4", r"(?is)case\s+when\s+labname\s*(?:=\s*'([^']+)'|in\s*\(([^)]*)\)).*?end\s*\)?\s*as\s+([A-Za-z_][\w]*)", "1", "2", "'([^'']+)'".replace("''", "'"), 3, None),
    ("P5b", r"(?is)respchartvaluelabel\s*(?:=\s*'([^']+)'|in\s*\(([^)]*)\))(.*?)end\s*(?:\)\s*)?as\s+([A-Za-z_][\w]*)", "1", "2", "'([^']+)'", 4, 3),
]
P5 = r"(?is)nursingchartcelltypevallabel\s*=\s*'([^']+)'\s*and\s*nursingchartcelltypevalname\s*=\s*'([^']+)'(.*?)end\s*(?:\)\s*)?as\s+([A-Za-z_][\w]*)"
TWO_LEVELS_SQL = f"""SELECT src_file, a || '|' || b AS field_key, concept AS concept_raw, 'P5' AS pattern FROM (SELECT src_file,
  {', '.join(f"unnest(regexp_extract_all(text, {text(P5)}, {n})) AS {c}" for n, c in ((1, 'a'), (2, 'b'), (4, 'concept'), (3, 'body')))} FROM f) WHERE length(body) <= 900"""


@query(f"WITH f AS ({FILES_SQL}) SELECT DISTINCT * FROM (" + " UNION ALL ".join(_pattern_sql(*x) for x in SPANNING) + ")")
def pattern_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.triples(source_files(spark, sf_dir), "db", "text", "file").filter("pattern <> 'P5'")
    return found.select("src_file", "field_key", "concept_raw", "pattern").distinct()


@query("""SELECT p_partkey, 'name: ' || p_name || '; category: ' || CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_type END || '; unit: ' || p_brand || '; size: ' || p_size AS card,
  substr(sha256('name: ' || p_name || '; category: ' || CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_type END || '; unit: ' || p_brand || '; size: ' || p_size), 1, 16) AS sha,
  p_brand || '.' || p_name || ' -- ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'category ' || p_type || '; ' END || 'median ' || p_size AS line, false AS leaks FROM part""")
def field_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    card = N.field_card({"name": F.col("p_name"), "category": category, "unit": F.col("p_brand"), "size": F.col("p_size")})
    line = N.field_line(F.col("p_brand"), F.col("p_name"), category, F.lit(None), F.lit(""), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", card.alias("card"), F.substring(F.sha2(card, 256), 1, 16).alias("sha"), line.alias("line"), N.leaks_key(card).alias("leaks"))




@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS source_column, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type END AS concept FROM part")
def parse_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    parts = ['```json {"mappings": [{"source_column": "', key, '", "target_mappings": [{"mapping": "t.', F.col("p_type"), '"}, {"mapping": "none"}]}]} ```']
    completion = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    told = table(spark, sf_dir, "part").select("p_partkey", F.explode(N.parse_mappings(completion)).alias("m"))
    members = F.array(F.lit("ECONOMY"), F.lit("PROMO"))
    return told.select("p_partkey", "m.source_column", N.catalogue_member(F.get("m.targets", 0), members).alias("concept"))


ANSWERS = ["Heart Rate", " N/A ", "?", "base-excess", "Not Sure", "", "no match", "{n}"]


@query(f"""SELECT answer, CASE WHEN lower(trim(answer)) IN ('unknown', 'none', 'n/a', 'no match') THEN 'UNKNOWN' WHEN lower(trim(answer)) IN ('unsure', '?', 'not sure') THEN 'UNSURE'
  ELSE replace(replace(lower(trim(answer)), ' ', '_'), '-', '_') END AS normalized, count(*) AS n FROM (SELECT replace({pick_sql(ANSWERS, 3)}, '{{n}}', p_name || '-' || p_type) AS answer FROM part) GROUP BY answer""")
def answer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.replace(pick(ANSWERS, 3), F.lit("{n}"), F.concat_ws("-", "p_name", "p_type"))
    answers = table(spark, sf_dir, "part").groupBy(named.alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    return answers.withColumn("normalized", N.normalize_answer(F.col("answer")))


# --- evidence ---------------------------------------------------------------------
@query("""
WITH r AS (SELECT p_partkey, log10(abs(p_retailprice) + 1e-6) AS v FROM part), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rk, count(*) OVER () AS n FROM r),
e AS (SELECT list(v ORDER BY i) AS edges FROM k, range(1, 10) t(i) WHERE rk = floor(n * i / 10))
SELECT p_partkey, CAST(CASE WHEN p_partkey % 17 = 0 THEN 10 ELSE least(len(list_filter(edges, lambda x: v >= x)), 9) END AS BIGINT) AS bucket FROM r, e""")
def evidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", E.log_magnitude(F.col("p_retailprice")).alias("v"))
    value = F.when(F.col("p_partkey") % 17 != 0, F.col("v"))
    edges = E.quantile_edges(part, "v")  # one row
    return part.crossJoin(F.broadcast(edges)).select("p_partkey", E.bucket(value, F.col("edges")).alias("bucket"))


@query(f"""SELECT p_partkey, {lookup_sql('ea', V.UNIT_DIMENSIONS)} IS NULL AS x, CASE WHEN ea IS NULL THEN 'missing' ELSE coalesce({lookup_sql('ea', V.UNIT_DIMENSIONS)}, 'other') END AS unit_class,
  coalesce({first_sql("nullif(trim(a_src_table), '')", V.CATEGORY_GROUPS)}, 'other') AS category FROM ({EFFECTIVE_SQL})""")
def evidence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit, name = F.col("a_unit_observed"), F.col("a_raw_name")
    no_dimension = U.dimension(U.effective_unit(unit, name)["unit"]).isNull()
    return fields(spark, sf_dir).select("p_partkey", no_dimension.alias("x"), E.unit_class(unit, name).alias("unit_class"), E.category_group(F.col("a_src_table")).alias("category"))


@query("""SELECT p_partkey, round(CASE WHEN x <= 0 OR y <= 0 THEN CASE WHEN abs(x - y) > greatest(abs(x), abs(y), 1e-6) THEN 0.5 ELSE 1.0 END
  ELSE exp(-abs(log10(x) - log10(y))) END, 6) AS similarity FROM (SELECT p_partkey, p_retailprice AS x, (p_size - 10) * 10.0::DOUBLE AS y FROM part)""")
def stat_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = ((F.col("p_size") - 10) * 10.0).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", rounded(E.stat_similarity(F.col("p_retailprice"), y), 6).alias("similarity"))


SB_SQL = "CASE WHEN ub IS NOT NULL THEN 'measured' WHEN nb IS NOT NULL THEN 'from_name' ELSE 'missing' END"


@query(f"SELECT p_partkey, 'unit: ' || coalesce(ea, '-') || ' (' || sa || ') / ' || coalesce(eb, '-') || ' (' || {SB_SQL} || ') ' || {relation_sql('ea', 'eb')} AS reason FROM ({EFFECTIVE_SQL})")
def unit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the explanation that tells what is known of both units."""
    found = fields(spark, sf_dir)
    return found.select("p_partkey", G.unit_reason(G.Field.at("a_"), G.Field.at("b_")).alias("reason"))


_TYPE_REASON = """'type: ' || ta || ' / ' || tb || ' ' || CASE WHEN v_type = 0 THEN 'compatible' WHEN v_type = 1 THEN 'both declared' WHEN ta IN ('unknown', 'mixed') OR tb IN ('unknown', 'mixed') THEN 'cannot tell' ELSE 'inferred only' END"""
_SPECIMEN_REASON = "'specimen: ' || coalesce(spa, '-') || ' / ' || coalesce(spb, '-') || ' ' || CASE v_specimen WHEN 0 THEN 'compatible' WHEN 1 THEN 'other specimen' ELSE 'cannot tell' END"
_METHODS, _FAMILIES = ("'{} ' || coalesce({}, '-') || ' / ' || coalesce({}, '-')".format(*x) for x in (("methods", "ma", "mb"), ("families", "fa", "fb")))
_PROV_REASON = f"""'provenance: ' || CASE WHEN ma IS NOT NULL AND mb IS NOT NULL AND ma <> mb THEN {_METHODS} || ' differ' WHEN fa IS NULL OR fb IS NULL THEN {_FAMILIES} || ' not registered'
  WHEN {CONFLICT_SQL} THEN {_FAMILIES} || ' conflict' WHEN fa = fb AND (ma IS NULL) <> (mb IS NULL) THEN {_METHODS} || ' told on one side' WHEN v_prov = 0 THEN {_FAMILIES} || ' go together' ELSE {_FAMILIES} || ' not listed' END"""


@query(f"""SELECT p_partkey, 'unit: ' || coalesce(ea, '-') || ' (' || sa || ') / ' || coalesce(eb, '-') || ' (' || {SB_SQL} || ') ' || rel AS unit, {_TYPE_REASON} AS kind, {_PROV_REASON} AS provenance, {_SPECIMEN_REASON} AS specimen
FROM ({verdicts_sql(False)})""")
def rule_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule compared, and why it came out as it did."""
    known = G.prepare(G.prepare(fields(spark, sf_dir), "a_"), "b_")
    told = G.reasons(G.Field.at("a_", prepared=True), G.Field.at("b_", prepared=True))
    return known.select("p_partkey", told.alias("r")).select("p_partkey", *(F.get("r", F.lit(i)).alias(c) for i, c in enumerate(("unit", "kind", "provenance", "specimen"))))


_CONCEPT_SQL = f"SELECT *, p_partkey % 9 AS concept FROM ({EFFECTIVE_SQL}) WHERE p_partkey % 9 < 7"


@query(f"""SELECT r.concept, coalesce(t.unit_class, 'missing') AS unit_class FROM range(9) r(concept) LEFT JOIN (
  SELECT concept, CASE WHEN ea IS NULL THEN 'missing' ELSE coalesce({lookup_sql('ea', V.UNIT_DIMENSIONS)}, 'other') END AS unit_class
  FROM ({_CONCEPT_SQL}) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY p_size DESC, p_partkey) = 1) t USING (concept)""")
def concept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a concept are those of its field with the most rows."""
    found = fields(spark, sf_dir).withColumns({"concept": F.col("p_partkey") % 9, "field_key": F.col("p_partkey"), "n_rows": F.col("p_size")})
    tokens = {"unit_class": E.unit_class(F.col("a_unit_observed"), F.col("a_raw_name"))}
    concepts = spark.range(9).select(F.col("id").alias("concept"))
    return E.concept_tokens(found.filter("concept < 7"), concepts, tokens, {"unit_class": F.lit("missing")})
