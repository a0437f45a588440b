"""Hard cases of the compatibility rules, as small relations."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import rules as G
from fieldloom.functions import units as U
from fieldloom.functions.evidence import stat_similarity
from fieldloom.functions.names import base_and_method, normalize_concept, normalize_name, parse_mappings

SHAPE = ", ".join(
    f"{s}_raw_name string, {s}_src_table string, {s}_unit_observed string, {s}_dtype_inferred string, {s}_dtype_declared boolean, {s}_specimen string"
    for s in "ab"
)


def field(name, table=None, unit=None, kind=None, declared=False, specimen=None):
    return (name, table, unit, kind, declared, specimen)


def gate(spark, a, b, **options):
    row = spark.createDataFrame([a + b], SHAPE)
    return row.select(G.gate(G.Field.at("a_"), G.Field.at("b_"), **options).alias("g")).first()["g"]


NURSE, LAB, CHART, LABEVENTS = "eicu.nurseCharting", "eicu.lab", "mimiciv.icu.chartevents", "mimiciv.hosp.labevents"

CASES = [
    ("temperatures convert", field("Temperature (C)", NURSE, kind="numeric"), field("Temperature (F)", NURSE), {"v_unit": 0.0, "hard_reject": False}),
    ("cuff and line", field("Non-Invasive BP Mean", NURSE), field("Invasive BP Mean", NURSE), {"v_prov": 1.0, "hard_reject": True}),
    ("synonyms pass", field("Vital Signs|Heart Rate|Heart Rate", NURSE), field("Other|Pulse|Value", NURSE), {"hard_reject": False}),
    ("one-sided method", field("MAP (mmHg)", NURSE), field("Arterial Line MAP (mmHg)", NURSE), {"v_unit": 0.0, "v_prov": 0.5}),
    ("declared types", field("Temperature Location", kind="categorical", declared=True), field("Temperature (F)", kind="numeric", declared=True), {"v_type": 1.0, "hard_reject": True}),
    ("inferred types", field("Temperature Location", kind="categorical", declared=True), field("Temperature C", kind="numeric"), {"v_type": 0.5}),
    ("lab and bedside", field("bedside glucose", LAB, "mg/dL"), field("Bedside Glucose", NURSE), {"v_prov": 1.0, "hard_reject": True}),
    ("ions", field("potassium", LAB, "mmol/L"), field("Potassium", LABEVENTS, "mEq/L"), {"v_unit": 0.0}),
    ("missing unit", field("anion gap", LAB), field("Anion Gap", LABEVENTS, "mEq/L"), {"v_unit": 0.5, "hard_reject": False}),
    ("ordered and given", field("Norepinephrine", "mimiciv.hosp.prescriptions", "mg"), field("Norepinephrine", "mimiciv.icu.inputevents", "mcg/kg/min"), {"v_prov": 1.0, "hard_reject": True}),
    ("pressure and heat", field("Arterial BP mean", CHART, "mmHg"), field("Temperature Celsius", CHART, "degC"), {"v_unit": 1.0, "hard_reject": True}),
    ("fluids", field("Albumin", LABEVENTS, "g/dL", specimen="Blood"), field("Albumin, Ascites", LABEVENTS, "g/dL"), {"v_unit": 0.0, "v_specimen": 1.0, "hard_reject": True}),
    ("no fluid", field("Glucose"), field("Glucose"), {"v_specimen": 0.5, "hard_reject": False}),
]


@pytest.mark.parametrize("a,b,expected", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_gate(spark, a, b, expected):
    g = gate(spark, a, b)
    assert {k: g[k] for k in expected} == expected
    assert {g[k] for k in ("v_unit", "v_type", "v_prov", "v_specimen")} <= {0.0, 0.5, 1.0}


def test_concept_mode_softens_families_only(spark):
    lab, nurse = field("glucose", LAB, "mg/dL"), field("Glucose", NURSE)
    assert gate(spark, lab, nurse)["v_prov"] == 1.0
    assert gate(spark, lab, nurse, concept_mode=True)["v_prov"] == 0.5
    cuff, line = field("Non-Invasive BP Mean", NURSE), field("Invasive BP Mean", NURSE)
    assert gate(spark, cuff, line, concept_mode=True)["v_prov"] == 1.0


def test_provenance_may_be_soft(spark):
    a, b = field("X", "mimiciv.hosp.prescriptions", "mg"), field("X", "mimiciv.icu.inputevents", "mg")
    assert gate(spark, a, b)["hard_reject"] and not gate(spark, a, b, reject_provenance=False)["hard_reject"]


def one(spark, column, **values):
    shape = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], shape).select(column.alias("x")).first()["x"]


def test_units(spark):
    f = F.col
    assert round(one(spark, U.convert(f("v"), f("a"), f("b")), v=98.4, a="degF", b="c"), 2) == 36.89
    assert one(spark, U.convert(f("v"), f("a"), f("b")), v=1.0, a="degC", b="degF") is None
    assert one(spark, U.effective_unit(f("u"), f("n"))["source"], u="degC", n="Temperature (F)") == "measured"
    assert one(spark, U.effective_unit(f("u"), f("n"))["unit"], u=None, n="platelets x 1000") == "K/uL"
    assert one(spark, U.normalize_unit(f("u")), u=" Mm  Hg") == "mmHg"
    assert one(spark, U.normalize_unit(f("u")), u=" Odd Unit ") == "Odd Unit"
    assert one(spark, U.normalize_unit(f("u")), u="N/A") is None


@pytest.mark.parametrize(
    "specimen,name,expected",
    [("Blood", None, "blood"), ("Serum", None, "blood"), ("Urine", None, "urine"), ("Ascites", None, "body_fluid"), ("Pleural", None, "body_fluid"),
     ("Cerebrospinal Fluid (CSF)", None, "csf"), ("Cerebrospinal Fluid x", None, "body_fluid"), ("Stool", None, "stool"), ("", None, None),
     (None, "Glucose, Pleural", "body_fluid"), (None, "Protein, Urine", "urine"), (None, "Heart Rate", None)],
)
def test_specimen(spark, specimen, name, expected):
    assert one(spark, G.specimen_class(F.col("s"), F.col("n")), s=specimen, n=name) == expected


def test_explain_lists_every_dimension(spark):
    row = spark.createDataFrame([field("a") + field("b")], SHAPE)
    told = row.select(G.explain(G.gate(G.Field.at("a_"), G.Field.at("b_"))).alias("t")).first()["t"]
    assert len(told.split("\n")) == 5 and "v_unit=0.5" in told


def test_names(spark):
    assert one(spark, normalize_name(F.col("n")), n="Vital Signs|HR") == "heart rate"
    assert one(spark, normalize_name(F.col("n")), n=None) == ""
    assert one(spark, normalize_concept(F.col("c")), c="'SysBP_mean_max'") == "sbp"
    assert one(spark, base_and_method(F.col("c"))["base"], c="nibp") == "bp"


def test_bad_json_has_no_mappings(spark):
    assert one(spark, F.size(parse_mappings(F.col("t"))), t="no json {at all") == 0
    assert one(spark, F.size(parse_mappings(F.col("t"))), t=None) == 0


def test_a_decade_apart(spark):
    assert round(one(spark, stat_similarity(F.col("a"), F.col("b")), a=10.0, b=1.0), 4) == 0.3679
    assert one(spark, stat_similarity(F.col("a"), F.col("b")), a=-1.0, b=1.0) == 0.5
