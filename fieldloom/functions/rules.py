"""Three-valued compatibility of two fields, as struct-valued column expressions.

A field is a struct of ``raw_name, src_table, unit_observed, dtype_inferred,
dtype_declared, specimen``. Every V is 0 (compatible), 0.5 (cannot tell) or 1
(conflict), never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V
from .portable import first_match, lookup
from .units import effective_unit, relation

CANNOT_TELL = 0.5


@dataclass(frozen=True)
class Field:
    """The columns of one side of a comparison."""

    raw_name: Column
    src_table: Column
    unit_observed: Column
    dtype_inferred: Column
    dtype_declared: Column
    specimen: Column

    #: Columns of what the rules derive, where ``prepare`` has worked them out.
    derived: dict[str, Column] | None = None

    @classmethod
    def at(cls, prefix: str, prepared: bool = False) -> Field:
        own = [F.col(prefix + name) for name in list(cls.__annotations__)[:6]]
        return cls(*own, {k: F.col(prefix + k) for k in DERIVED} if prepared else None)

    def get(self, name: str) -> Column:
        return self.derived[name] if self.derived else DERIVED[name](self)


def prepare(df: DataFrame, prefix: str) -> DataFrame:
    """Adds what the rules derive of a field, so that each is worked out once a row."""
    field = Field.at(prefix)
    return df.withColumns({prefix + k: make(field) for k, make in DERIVED.items()})


def family(table: Column) -> Column:
    return lookup(table, V.TABLE_FAMILIES)


def method(name: Column) -> Column:
    return first_match(name, V.METHODS)


def specimen_class(specimen: Column, name: Column) -> Column:
    """By the exact specimen, else by a wording it contains, else by the name."""
    s = F.lower(F.trim(F.coalesce(specimen, F.lit(""))))
    inside = F.coalesce(*(F.when(s.contains(k), F.lit(v)) for k, v in V.SPECIMENS.items()))
    word = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), "(?i)" + V.SPECIMEN_IN_NAME, 1))
    told = (
        F.when(word == "", F.lit(None).cast("string"))
        .when(word.contains("csf") | word.contains("cerebro"), "csf")
        .when(word.contains("urin"), "urine")
        .when(word.contains("stool"), "stool")
        .otherwise("body_fluid")
    )
    return F.coalesce(lookup(s, V.SPECIMENS), F.when(s != "", inside), told)


#: What the rules derive of a field.
DERIVED = {
    "unit": lambda f: effective_unit(f.unit_observed, f.raw_name)["unit"],
    "method": lambda f: method(f.raw_name),
    "family": lambda f: family(f.src_table),
    "specimen_class": lambda f: specimen_class(f.specimen, f.raw_name),
}


def v_unit(a: Field, b: Field) -> Column:
    found = relation(a.get("unit"), b.get("unit"))
    return F.when(found.isin("same", "convertible"), 0.0).when(found == "conflict", 1.0).otherwise(CANNOT_TELL)


def v_type(a: Field, b: Field) -> Column:
    """A conflict only where both types are declared: inferred ones may be wrong."""
    x, y = (F.coalesce(F.nullif(f.dtype_inferred, F.lit("")), F.lit("unknown")) for f in (a, b))
    vague = x.isin("unknown", "mixed") | y.isin("unknown", "mixed")
    declared = F.coalesce(a.dtype_declared, F.lit(False)) & F.coalesce(b.dtype_declared, F.lit(False))
    return F.when(vague, CANNOT_TELL).when(x == y, 0.0).when(declared, 1.0).otherwise(CANNOT_TELL)


def v_specimen(a: Field, b: Field) -> Column:
    x, y = a.get("specimen_class"), b.get("specimen_class")
    return F.when(x.isNull() | y.isNull(), CANNOT_TELL).when(x == y, 0.0).otherwise(1.0)


def v_prov(a: Field, b: Field, concept_mode: bool = False) -> Column:
    """Method first, then table family. A concept is bound to no table: there a
    conflict of families only cannot tell."""
    fa, fb, ma, mb = a.get("family"), b.get("family"), a.get("method"), b.get("method")
    pair = F.concat_ws("+", F.least(fa, fb), F.greatest(fa, fb))
    conflict = pair.isin([f"{x}+{y}" for x, y in V.FAMILY_CONFLICTS])
    one_sided = ma.isNull() != mb.isNull()
    return (
        F.when(ma.isNotNull() & mb.isNotNull() & (ma != mb), 1.0)
        .when(fa.isNull() | fb.isNull(), CANNOT_TELL)
        .when(conflict, CANNOT_TELL if concept_mode else 1.0)
        .when((fa == fb) & one_sided, CANNOT_TELL)
        .when(fa == fb, 0.0)
        .when(fa.isin(V.BEDSIDE_GROUP) & fb.isin(V.BEDSIDE_GROUP), 0.0)
        .otherwise(CANNOT_TELL)
    )


def v_method(field: Field, concept: Field) -> Column:
    """A method told by the field only is a conflict, unless the concept bears one."""
    mf, mc = field.get("method"), concept.get("method")
    name = F.lower(F.trim(F.coalesce(concept.raw_name, F.lit(""))))
    bearing = F.greatest(*(name.contains(k) for k in V.METHOD_BEARING_CONCEPTS))
    return (
        F.when(mf.isNull(), 0.0)
        .when(mc.isNotNull(), F.when(mf == mc, 0.0).otherwise(1.0))
        .when(bearing, CANNOT_TELL)
        .otherwise(1.0)
    )


def gate(a: Field, b: Field, concept_mode: bool = False, reject_provenance: bool = True) -> Column:
    """struct(v_unit, v_type, v_prov, v_specimen, hard_reject, reasons)."""
    vs = {"v_unit": v_unit(a, b), "v_type": v_type(a, b), "v_prov": v_prov(a, b, concept_mode), "v_specimen": v_specimen(a, b)}
    hard = (vs["v_unit"] == 1) | (vs["v_type"] == 1) | (vs["v_specimen"] == 1)
    if reject_provenance:
        hard = hard | (vs["v_prov"] == 1)
    reasons = F.array(*(F.concat(F.lit(k + "="), v.cast("string")) for k, v in vs.items()))
    return F.struct(*(v.alias(k) for k, v in vs.items()), hard.alias("hard_reject"), reasons.alias("reasons"))


def gated_score(score: Column, g: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Minus infinity if rejected, else the score less the weighted soft conflicts."""
    unit, kind, prov = weights
    soft = score - unit * g["v_unit"] - kind * g["v_type"] - prov * g["v_prov"]
    return F.when(g["hard_reject"], float("-inf")).otherwise(soft)


def unit_reason(a: Field, b: Field) -> Column:
    """The units that were compared, what each is known by, and how they relate."""
    def side(f: Field) -> Column:
        e = effective_unit(f.unit_observed, f.raw_name)
        return F.concat(F.coalesce(e["unit"], F.lit("-")), F.lit(" ("), e["source"], F.lit(")"))

    return F.concat(F.lit("unit: "), side(a), F.lit(" / "), side(b), F.lit(" "), relation(a.get("unit"), b.get("unit")))


def _told(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _pair(x: Column, y: Column) -> Column:
    return F.concat(_told(x), F.lit(" / "), _told(y))


def type_reason(a: Field, b: Field) -> Column:
    """Both types, and whether a conflict is one of declared types or of inferred ones."""
    x, y = (F.coalesce(F.nullif(f.dtype_inferred, F.lit("")), F.lit("unknown")) for f in (a, b))
    v = v_type(a, b)
    vague = x.isin("unknown", "mixed") | y.isin("unknown", "mixed")
    why = F.when(v == 0, "compatible").when(v == 1, "both declared").when(vague, "cannot tell").otherwise("inferred only")
    return F.concat(F.lit("type: "), _pair(x, y), F.lit(" "), why)


def specimen_reason(a: Field, b: Field) -> Column:
    v = v_specimen(a, b)
    why = F.when(v == 0, "compatible").when(v == 1, "other specimen").otherwise("cannot tell")
    return F.concat(F.lit("specimen: "), _pair(a.get("specimen_class"), b.get("specimen_class")), F.lit(" "), why)


def provenance_reason(a: Field, b: Field, concept_mode: bool = False) -> Column:
    """What decided: methods, an unknown family, a conflict of families, a one-sided method, or a group."""
    fa, fb, ma, mb = a.get("family"), b.get("family"), a.get("method"), b.get("method")
    v, one_sided = v_prov(a, b, concept_mode), ma.isNull() != mb.isNull()
    pair = F.concat_ws("+", F.least(fa, fb), F.greatest(fa, fb))
    conflict = pair.isin([f"{x}+{y}" for x, y in V.FAMILY_CONFLICTS])
    methods = F.concat(F.lit("methods "), _pair(ma, mb))
    families = F.concat(F.lit("families "), _pair(fa, fb))
    why = (
        F.when(ma.isNotNull() & mb.isNotNull() & (ma != mb), F.concat(methods, F.lit(" differ")))
        .when(fa.isNull() | fb.isNull(), F.concat(families, F.lit(" not registered")))
        .when(conflict, F.concat(families, F.lit(" conflict; a concept is bound to none" if concept_mode else " conflict")))
        .when((fa == fb) & one_sided, F.concat(methods, F.lit(" told on one side")))
        .when(v == 0, F.concat(families, F.lit(" go together")))
        .otherwise(F.concat(families, F.lit(" not listed")))
    )
    return F.concat(F.lit("provenance: "), why)


def reasons(a: Field, b: Field, concept_mode: bool = False) -> Column:
    """One line for each rule: what it compared, and why it came out as it did."""
    return F.array(unit_reason(a, b), type_reason(a, b), provenance_reason(a, b, concept_mode), specimen_reason(a, b))


def explain(g: Column, a: Field | None = None, b: Field | None = None, concept_mode: bool = False) -> Column:
    """The verdicts line by line; with both fields, what each rule compared and why, too."""
    verdict = F.when(g["hard_reject"], "rejected").otherwise("kept")
    told = [] if a is None or b is None else [F.array_join(reasons(a, b, concept_mode), "\n")]
    return F.concat_ws("\n", g["reasons"], *told, verdict)
