"""Domain vocabularies, as data. All values below are fixed values.

Order is meaning wherever a list is of (pattern, value) pairs: the first hit wins.
"""

# --- units: spelling → canonical unit; None marks "no unit" -----------------------
UNIT_ALIASES = {
    "": None, "none": None, "null": None, "n/a": None, "?": None,
    "f": "degF", "°f": "degF", "degf": "degF", "fahrenheit": "degF",
    "c": "degC", "°c": "degC", "degc": "degC", "celsius": "degC",
    "mmhg": "mmHg", "mm hg": "mmHg", "torr": "mmHg",
    "cmh2o": "cmH2O", "cm h2o": "cmH2O", "cmh20": "cmH2O",
    "meq/l": "mEq/L", "meql": "mEq/L", "mmol/l": "mmol/L",
    "mg/dl": "mg/dL", "g/dl": "g/dL", "ug/dl": "ug/dL", "mcg/dl": "ug/dL",
    "k/ul": "K/uL", "k/mcl": "K/mcL", "10*3/ul": "10*3/uL", "10^3/ul": "K/uL",
    "in": "inch", "inches": "inch", "cm": "cm", "kg": "kg", "kgs": "kg",
    "lb": "lb", "lbs": "lb", "pounds": "lb",
    "bpm": "bpm", "beats/min": "bpm", "insp/min": "insp/min", "breaths/min": "bpm",
    "l/min": "L/min", "lpm": "L/min", "ml/hr": "mL/hr", "ml/h": "mL/hr",
    "mcg/kg/min": "mcg/kg/min", "mcg/min": "mcg/min", "units/hour": "units/hr",
    "%": "%", "percent": "%", "sec": "s", "seconds": "s",
}

UNIT_DIMENSIONS = {
    "degF": "temperature", "degC": "temperature",
    "mmHg": "pressure", "cmH2O": "pressure",
    "mEq/L": "concentration", "mmol/L": "concentration",
    "mg/dL": "mass_concentration", "g/dL": "mass_concentration", "ug/dL": "mass_concentration",
    "K/uL": "cell_count", "K/mcL": "cell_count", "10*3/uL": "cell_count",
    "inch": "length", "cm": "length", "kg": "mass", "lb": "mass",
    "bpm": "rate", "insp/min": "rate", "L/min": "flow", "mL/hr": "flow",
    "mcg/kg/min": "dose_rate", "mcg/min": "dose_rate", "units/hr": "dose_rate",
    "%": "fraction", "s": "time",
}

#: (from, to, factor, offset, condition, source); no factor: conditional, unknown.
UNIT_CONVERSIONS = [
    ("degF", "degC", 5.0 / 9.0, -32.0, "", "definition of the Celsius scale"),
    ("mmol/L", "mEq/L", 1.0, 0.0, "monovalent ions", "definition of the equivalent"),
    ("mEq/L", "mmol/L", 1.0, 0.0, "monovalent ions", "definition of the equivalent"),
    ("inch", "cm", 2.54, 0.0, "", "international inch"),
    ("lb", "kg", 0.45359237, 0.0, "", "international pound"),
    ("cmH2O", "mmHg", 0.735559, 0.0, "", "conventional water and mercury columns"),
    ("K/mcL", "K/uL", 1.0, 0.0, "", "same unit, two spellings"),
    ("10*3/uL", "K/uL", 1.0, 0.0, "", "same unit, two spellings"),
    ("g/dL", "mg/dL", 1000.0, 0.0, "", "SI prefixes"),
    ("mg/dL", "ug/dL", 1000.0, 0.0, "", "SI prefixes"),
    ("L/min", "mL/hr", 60000.0, 0.0, "", "SI prefixes"),
    ("insp/min", "bpm", 1.0, 0.0, "", "both count events per minute"),
    ("mcg/kg/min", "mcg/min", None, 0.0, "needs the patient's weight", "dose per weight"),
]

#: Units told inside a field's name.
NAME_UNITS = [
    (r"\(\s*(?:deg\s*)?c\s*\)", "degC"), (r"\(\s*(?:deg\s*)?f\s*\)", "degF"),
    (r"\(\s*mmhg\s*\)", "mmHg"), (r"\(\s*cmh2o\s*\)", "cmH2O"),
    (r"\(\s*%\s*\)|\bpercent\b", "%"), (r"\(\s*l/min\s*\)|\blpm\b", "L/min"),
    (r"\(\s*ml/hr?\s*\)", "mL/hr"), (r"\(\s*bpm\s*\)|\bbeats?/min\b", "bpm"),
    (r"\(\s*mg/dl\s*\)", "mg/dL"), (r"\(\s*mmol/l\s*\)", "mmol/L"), (r"\(\s*meq/l\s*\)", "mEq/L"),
    (r"\bx\s*1000\b", "K/uL"), (r"\bmcg/kg/min\b", "mcg/kg/min"), (r"\bmcg/min\b", "mcg/min"),
    (r"\bunits?/hr?\b", "units/hr"), (r"\binch(es)?\b", "inch"), (r"\bkg\b", "kg"), (r"\blbs?\b", "lb"),
]

# --- provenance -------------------------------------------------------------------
TABLE_FAMILIES = {
    "mimiciv.hosp.labevents": "laboratory", "mimiciii.LABEVENTS": "laboratory", "eicu.lab": "laboratory",
    "mimiciv.icu.chartevents": "bedside_nursing", "mimiciii.CHARTEVENTS": "bedside_nursing",
    "eicu.nurseCharting": "bedside_nursing",
    "eicu.vitalPeriodic": "monitor", "eicu.vitalAperiodic": "monitor",
    "eicu.respiratoryCharting": "respiratory",
    "mimiciv.hosp.prescriptions": "prescription",
    "mimiciv.icu.inputevents": "administration", "mimiciii.INPUTEVENTS_CV": "administration",
    "mimiciii.INPUTEVENTS_MV": "administration", "eicu.infusionDrug": "administration",
}

#: Families that exclude each other; each pair in alphabetical order.
FAMILY_CONFLICTS = [
    ("administration", "bedside_nursing"), ("administration", "laboratory"), ("administration", "monitor"),
    ("administration", "prescription"), ("bedside_nursing", "laboratory"), ("bedside_nursing", "prescription"),
    ("laboratory", "monitor"), ("laboratory", "prescription"), ("laboratory", "respiratory"),
    ("monitor", "prescription"),
]

BEDSIDE_GROUP = ["bedside_nursing", "monitor", "respiratory"]

#: How something was measured, told by a field's name.
METHODS = [
    (r"non[\s\-_]?invasive|\bnibp\b|\bcuff\b|manual\s*bp", "noninvasive"),
    (r"\barterial\s*line\b|\ba[\s\-]?line\b|\bibp\b|\binvasive\b|\barterial\s*bp\b|systemic(systolic|diastolic|mean)", "invasive"),
    (r"^\s*set[\s_]|[\s_]set\s*$|\(\s*set\s*\)|\bsetting\b|\bset\s+(rr|peep|fio2|tv|vt)\b|\bdesired\b|\btarget\b", "set"),
    (r"^total[\s_]|_total$|\bobserved\b|\bmeasured\b|\bspontaneous\b", "measured"),
    (r"\bbedside\b|\bpoc\b|\bpoint[\s\-]of[\s\-]care\b|\bfinger\s*stick\b|\bfingerstick\b|\bglucomet|\bcapillary\b", "bedside"),
    (r"\bsao2\b|\bsa\s*o2\b|arterial\s+(o2\s+)?sat", "bloodgas_sat"),
    (r"\bspo2\b|\bsp\s*o2\b|pulse\s*ox|oximetr", "pulse_oximetry"),
]

METHOD_BEARING_CONCEPTS = ["spo2", "so2", "sao2"]

#: Specimen by exact value, else by the first key that the value contains.
SPECIMENS = {
    "blood": "blood", "serum": "blood", "plasma": "blood", "whole blood": "blood", "urine": "urine",
    "ascites": "body_fluid", "pleural": "body_fluid", "joint fluid": "body_fluid", "other body fluid": "body_fluid",
    "fluid": "body_fluid", "bone marrow": "body_fluid",
    "cerebrospinal fluid": "csf", "cerebrospinal fluid (csf)": "csf", "csf": "csf", "stool": "stool",
}
SPECIMEN_IN_NAME = (
    r"\b(ascites|ascitic|pleural|peritoneal|synovial|joint\s*fluid|cerebrospinal|csf|urine|urinary|stool|bone\s*marrow)\b"
)

# --- names ------------------------------------------------------------------------
NAME_ABBREVIATIONS = {
    "hgb": "hemoglobin", "hct": "hematocrit", "wbc": "white blood cells", "rbc": "red blood cells",
    "bun": "urea nitrogen", "hr": "heart rate", "rr": "respiratory rate", "bp": "blood pressure",
    "temp": "temperature", "spo2": "oxygen saturation", "sao2": "oxygen saturation", "o2 sat": "oxygen saturation",
    "sbp": "systolic blood pressure", "dbp": "diastolic blood pressure", "map": "mean arterial pressure",
    "mbp": "mean blood pressure", "inr": "international normalized ratio", "ptt": "partial thromboplastin time",
    "pt": "prothrombin time", "gcs": "glasgow coma scale", "alt": "alanine aminotransferase",
    "ast": "aspartate aminotransferase", "alp": "alkaline phosphatase", "ldh": "lactate dehydrogenase",
    "cvp": "central venous pressure", "icp": "intracranial pressure", "peep": "positive end expiratory pressure",
    "fio2": "fraction of inspired oxygen",
}

CONCEPT_SYNONYMS = {
    "heartrate": "heart_rate", "hr": "heart_rate", "pulse": "heart_rate",
    "resprate": "respiratory_rate", "respiratoryrate": "respiratory_rate",
    "resp_rate": "respiratory_rate", "rr": "respiratory_rate",
    "sysbp": "sbp", "systolic": "sbp", "nibp_systolic": "sbp_noninvasive",
    "systemicsystolic": "sbp_invasive", "ibp_systolic": "sbp_invasive",
    "diasbp": "dbp", "diastolic": "dbp", "nibp_diastolic": "dbp_noninvasive",
    "systemicdiastolic": "dbp_invasive", "ibp_diastolic": "dbp_invasive",
    "meanbp": "mbp", "nibp_mean": "mbp_noninvasive", "systemicmean": "mbp_invasive",
    "ibp_mean": "mbp_invasive", "mbp_ni": "mbp_noninvasive",
    "spo2": "spo2", "o2saturation": "spo2", "o2_saturation": "spo2", "sao2": "spo2",
    "temperature": "temperature", "tempc": "temperature", "tempf": "temperature",
    "temp_c": "temperature", "temp_f": "temperature",
    "glucose": "glucose", "bedsideglucose": "glucose_bedside", "hematocrit": "hematocrit", "hct": "hematocrit",
    "hemoglobin": "hemoglobin", "hgb": "hemoglobin", "platelet": "platelets", "platelets": "platelets",
    "wbc": "wbc", "whitebloodcell": "wbc", "bun": "bun", "ureanitrogen": "bun",
    "aniongap": "anion_gap", "totalco2": "bicarbonate", "co2": "bicarbonate",
    "inr": "inr", "ptinr": "inr", "pt": "pt", "ptt": "ptt",
    "alt": "alt", "altsgpt": "alt", "ast": "ast", "astsgot": "ast",
    "alp": "alkaline_phosphatase", "alkalinephos": "alkaline_phosphatase",
    "bilirubin": "bilirubin_total", "totalbilirubin": "bilirubin_total",
    "o2flow": "o2_flow", "tidalvolume": "tidal_volume",
    "hco3": "bicarbonate", "ventilationrate": "respiratory_rate_set",
    "norepinephrine": "norepinephrine", "epinephrine": "epinephrine",
    "dopamine": "dopamine", "dobutamine": "dobutamine", "vasopressin": "vasopressin",
    "ratenorepinephrine": "norepinephrine", "rateepinephrine": "epinephrine",
    "ratedopamine": "dopamine", "ratedobutamine": "dobutamine",
    "pao2": "po2", "po2": "po2", "paco2": "pco2", "pco2": "pco2",
    "ph": "ph", "fio2": "fio2", "peep": "peep", "baseexcess": "base_excess", "basedeficit": "base_deficit",
    "lactate": "lactate", "gcs": "gcs_total", "gcstotal": "gcs_total", "gcseyes": "gcs_eyes",
    "gcsmotor": "gcs_motor", "gcsverbal": "gcs_verbal", "urineoutput": "urine_output", "uo": "urine_output",
    "cvp": "cvp", "icp": "icp", "etco2": "etco2", "weight": "weight", "height": "height",
}
AGGREGATE_SUFFIX = r"(_min|_max|_mean|_median|_first|_last|_avg|_24hours|_value)$"

#: Columns of source SQL that are no concepts.
ARTEFACTS = [
    "valuenum", "itemid", "vitalid", "label", "comments", "decimal", "amount", "rate", "impute_abs", "line_number",
    "labresult", "specimen", "flow_rate", "vaso", "vaso_amount", "vaso_null", "vaso_stopped", "vaso_rate",
    "dialysis_type", "arterial_line",
]
ARTEFACT_PATTERN = r"^inv\d+_(site|type)$"
METHOD_SUFFIXES = [
    ("_noninvasive", "noninvasive"), ("_ni", "noninvasive"), ("_invasive", "invasive"), ("_bedside", "bedside"),
    ("_set", "set"), ("_observed", "observed"), ("_spontaneous", "spontaneous"), ("_total", "total"),
    ("_chartevents", "chartevents"),
]

#: Category wording → coarse group.
CATEGORY_GROUPS = [
    (r"lab|chem|hema|coag|blood ?gas|abg|enzyme|urine|csf|micro", "lab"),
    (r"vital|hemodynam|cardio|bp|pressure|pulse|temperature", "vital"),
    (r"resp|vent|airway|oxygen|o2|pulmon", "respiratory"),
    (r"med|drug|infus|prescri|solution|fluid|intake", "medication"),
    (r"neuro|gcs|sedat|pain|deliri", "neuro"),
    (r"skin|access|line|care|assess|position|safety|activity", "care"),
]

#: The closing of a statement, and what stands before the first one.
_END = r"END\s*+(?:\)\s*+)?AS\s++"
CLOSING = rf"{_END}[A-Za-z_]\w*+"
_TO_END = rf"((?:(?!{_END}[A-Za-z_]).)*+)(?:{_END}([A-Za-z_]\w*+))?+"
#: What tells a name behind a line's value, and a key that goes on in the next line.
_TOLD = r"then\s++\d++\s*+--\s*"
_BROKEN = r"when[^\S\n]*+(?:\n|itemid[^\S\n]*+(?:\n|in[^\S\n]*+(?:\n|\([^)\n]*+\n)))"
#: Statements of source SQL that map ids or labels to concepts: label, the text it is found in, pattern, groups of
#: the only id (or both levels of it), of a list of ids, pattern of each of those, groups of
#: the name and of what stands between, and the most that may.
STATEMENT_KINDS = [
    ("P1", "_closed", rf"(?is)CASE\s++WHEN\s++itemid\s*+(?:=\s*+(\d++)|IN\s*+\(([^)]*+)\)){_TO_END}", (1,), 2, r"(\d+)", 4, None, 0),
    ("P2", "_lines", rf"(?i)when\s++itemid\s++in\s*+\(([^)]*+)\)(?:(?:(?!{_TOLD})[^\n])*+{_TOLD}([^\n,]+)|(?:(?!{_BROKEN})[^\n])*+)", (), 1, r"(\d+)", 2, None, 0),
    ("P3", "_lines", r"(?i)WHEN\s++itemid\s*+=\s*+(\d++)\s++THEN\s++'([^']++)'", (1,), None, "", 2, None, 0),
    ("P4", "_closed", rf"(?is)case\s++when\s++labname\s*+(?:=\s*+'([^']++)'|in\s*+\(([^)]*+)\)){_TO_END}", (1,), 2, r"'([^']+)'", 4, None, 0),
    ("P5b", "_closed", rf"(?is)respchartvaluelabel\s*+(?:=\s*+'([^']++)'|in\s*+\(([^)]*+)\)){_TO_END}", (1,), 2, r"'([^']+)'", 4, 3, 900),
    ("P5", "_closed", rf"(?is)nursingchartcelltypevallabel\s*+=\s*+'([^']++)'\s*+and\s*+nursingchartcelltypevalname\s*+=\s*+'([^']++)'{_TO_END}", (1, 2), None, "", 4, 3, 900),
]

#: Words in experts' notes → the kind of error, the first that is found.
ERROR_WORDS = [
    (["poc", "fingerstick", "床旁", "末梢", "指血"], "measurement method: point-of-care vs laboratory"),
    (["set rate", "设定"], "measurement method: ventilator setting vs measured"),
    (["sao2", "pulse oximetry"], "measurement method: arterial SaO2 vs pulse oximetry"),
]
UNDECIDED_WORDS = ["cannot", "拿不准", "没有单位"]
