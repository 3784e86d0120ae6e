"""Queries over small literal tables: operators on notes, spans, records, scores and the protocol, held against written answers.

Each case is a row of the input; the SQL counterpart is the list of answers.
"""

from __future__ import annotations

from random import Random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloflow.functions import spans as S
from siloflow.operators import evaluate, extraction, features, federated, metrics, perturb, pii
from siloflow.privacy import accounting, crypto, secagg, wire
from siloflow.sources import notes


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def answers(columns: str, rows: list[tuple], **casts: str) -> str:
    """SQL that gives written rows; ``casts`` says the type of columns that may be all null."""
    names = columns.split()
    shown = ", ".join(f"CAST({n} AS {casts[n]}) AS {n}" if n in casts else n for n in names)
    return f"SELECT {shown} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(names)})"


# ---- personal data in notes

# Notes, an age if one is known, and all that is personal in them, in page order.
_ADDRESS, _DOB = ("Rosenweg 5, 10115 Berlin", "ADDRESS"), ("01.02.1970", "DATE_OF_BIRTH")
DETECTED = [
    (
        "Patient: Anna Keller | DOB: 01.02.1970 | Case ID: B-123456\n"
        "Address: Lindenallee 17, 10117 Berlin | Telephone: +49 30 0000 1111\n"
        "Encounter date: 03.04.2025 | Attending physician: Dr. Emil Brandt\n"
        "Electronically signed by Dr. Emil Brandt, emil.brandt@synthetic-clinic.example",
        None,
        [
            ("Anna Keller", "PATIENT_NAME"), _DOB, ("B-123456", "PATIENT_ID"), ("Lindenallee 17, 10117 Berlin", "ADDRESS"), ("+49 30 0000 1111", "PHONE_NUMBER"),
            ("03.04.2025", "ENCOUNTER_DATE"), ("Emil Brandt", "CLINICIAN_NAME"), ("Emil Brandt", "CLINICIAN_NAME"), ("emil.brandt@synthetic-clinic.example", "EMAIL"),
        ],
    ),
    ("Allergy record: NKDA. Author: Laura König <laura.koenig@synthetic-clinic.example>.", None, [("Laura König", "CLINICIAN_NAME"), ("laura.koenig@synthetic-clinic.example", "EMAIL")]),
    ("Attending: Dr. med. Hans Müller", None, [("Hans Müller", "CLINICIAN_NAME")]),
    ("Home: Flat 15-B, 31 Marina Cross Street, Chennai - 600 018. Mobile +91 00000 34235.", None, [("Flat 15-B, 31 Marina Cross Street, Chennai - 600 018", "ADDRESS"), ("+91 00000 34235", "PHONE_NUMBER")]),
    ("Diagnoses: Vorhofflimmern, Parkinson disease, Hodgkin lymphoma. BP 123/72, Eliquis 5 mg, creatinine 136 µmol/L, Hb 151 g/L, EF 45%.", None, []),
    ("EXPORT // B-191271 // 21.02.2026\nAnton Adler, born 23.05.1963, 62 y, male.", 62, [("B-191271", "PATIENT_ID"), ("21.02.2026", "ENCOUNTER_DATE"), ("Anton Adler", "PATIENT_NAME"), ("23.05.1963", "DATE_OF_BIRTH")]),
    ("RECORD 23.05.1963 ... 21.02.2026", 62, [("23.05.1963", "DATE_OF_BIRTH"), ("21.02.2026", "ENCOUNTER_DATE")]),
    ("Mail from Laura König: laura.koenig@x.example. Later Laura König came.", None, [("Laura König", "CLINICIAN_NAME"), ("laura.koenig@x.example", "EMAIL"), ("Laura König", "CLINICIAN_NAME")]),
    ("", None, []),
    (None, None, []),
    *((f"Patient: Anna Keller | Date of birth: 02.02.1960 | Admitted on: {d}.", None, [("Anna Keller", "PATIENT_NAME"), ("02.02.1960", "DATE_OF_BIRTH"), (d, "ENCOUNTER_DATE")]) for d in ("2025-03-14", "14 March 2025", "March 14, 2025", "14-Mar-2025", "14.03.25", "14/03/2025")),
    *((f"MRN: {i} | Patient: Anna Keller", None, [(i, "PATIENT_ID"), ("Anna Keller", "PATIENT_NAME")]) for i in ("BER/2025/12", "UHID/12345/25", "MRN-12-34567", "HYD864557", "CHN-5425165")),
    *((f"Tel.: {p} | Address: Rosenweg 5, 10115 Berlin", None, [(p, "PHONE_NUMBER"), _ADDRESS]) for p in ("(030) 1234 5678", "+91-98765-43210", "98765 43210", "+49 (0)30 12345678")),
    *((f"Patient name: {n} | DOB: 01.02.1970", None, [(n, "PATIENT_NAME"), _DOB]) for n in ("Anna-Lena Schmidt-Weber", "Ana Sofia O'Connor", "NEUMANN, Anton", "Neumann, Anton", "Sri Lakshmi Rao")),
]
LABEL_GROUPS = {
    "detected_emails": ("EMAIL",), "detected_phones": ("PHONE_NUMBER",), "detected_ids": ("PATIENT_ID",), "detected_dates": ("DATE_OF_BIRTH", "ENCOUNTER_DATE"),
    "detected_addresses": ("ADDRESS",), "detected_names": ("PATIENT_NAME", "CLINICIAN_NAME"),
}


def _placed(text: str | None, found: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    out, at = [], 0
    for said, label in found:
        at = text.index(said, at)
        out.append((at, at + len(said), label, said))
        at += len(said)
    return out


def _notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, age) for i, (t, age, _) in enumerate(DETECTED)], "case_no int, note_text string, age int").coalesce(1)


def _detected(labels: tuple[str, ...]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = pii.detect(_notes(spark), age="age").select("case_no", "note_text", F.inline("pii_entities"))
        return got.where(F.col("label").isin(*labels)).select("case_no", "start", "end", "label", F.substring("note_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("said"))

    return query


def deidentified_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.deidentified(pii.detect(_notes(spark), age="age")).select("case_no", "deidentified_text")


def _rendered(text: str | None, found: list[tuple[str, str]]) -> str:
    out, at = "", 0
    for s, e, label, _ in _placed(text, found):
        out, at = f"{out}{text[at:s]}[{label}]", e
    return out + (text or "")[at:]


# ---- facts in notes

# Texts and what is to be read in them.
FIELDS = {
    "diagnoses": [
        ("Diagnoses: Vorhofflimmern (AF); arterial hypertension.", "atrial_fibrillation,hypertension"), ("Dx: HFrEF; T2DM; CKD stage III.", "chronic_kidney_disease,heart_failure,type_2_diabetes"),
        ("Problem list—NSTEMI; COAD.", "acute_coronary_syndrome,copd"), ("Known diagnoses: stable ischemic heart disease; infective consolidation.", "coronary_artery_disease,pneumonia"),
        ("Diagnoses [unstable angina; LV failure; DM2].", "acute_coronary_syndrome,heart_failure,type_2_diabetes"), ("Atrial fibrillation was considered but not confirmed.", ""),
        ("The patient denies a history of COPD.", ""), ("No history of heart failure.", ""), ("Family history of atrial fibrillation in a first-degree relative.", ""), ("Mother had type 2 diabetes.", ""),
        ("Pneumonia was ruled out.", ""), ("?pneumonia", ""), ("No COPD but known hypertension.", "hypertension"), ("Diagnoses: type 1 diabetes mellitus.", ""), ("", ""), (None, ""),
    ],
    "medications": [
        ("Medication list: Eliquis 5 mg b.i.d.; Lasix 40 mg; ecosprin 75 mg.", "apixaban,aspirin,furosemide"), ("Rx—Tab Xarelto 20 mg OD; frusemide 40 OD; atorva 40.", "atorvastatin,furosemide,rivaroxaban"),
        ("Current therapy: acetylsalicylic acid 100 mg; ASA 75 mg; basal insulin.", "aspirin,insulin"), ("Medication [APX 5 mg BID; azithro 500; phenprocoumon/warfarin therapy].", "apixaban,azithromycin,warfarin"),
        ("Apixaban was discussed but was not started.", ""), ("Metformin was discontinued last month.", ""), ("Allergy: allergic to aspirin.", ""), ("Medication list: none documented.", ""),
    ],
    "heart_rate_bpm": [("HR 102 bpm", "102"), ("pulse 82/min", "82"), ("ventricular rate 73 per minute", "73"), ("Heart rate: 88", "88"), ("vital signs not captured in the export", None), ("RR 18/min", None)],
    "systolic_bp_mmhg": [("BP 123/72 mmHg", "123"), ("blood pressure 142 over 74", "142"), ("RR 135/85 mmHg", "135"), ("RR 18/min", None)],
    "creatinine_mg_dl": [("creatinine 1,14 mg/dL", "1.14"), ("serum creatinine 136 µmol/L", "1.54"), ("Kreatinin 97 umol/l", "1.1"), ("creatinine and hemoglobin unavailable", None), ("creatinine 0.95 mg/dL", "0.95")],
    "hemoglobin_g_dl": [("Hb 151 g/L", "15.1"), ("hemoglobin 12.6 g/dL", "12.6"), ("Hb 8,4 mmol/l", "13.5"), ("HbA1c 7.2%", None)],
    "lvef_percent": [("EF=58%", "58"), ("LVEF 35%", "35"), ("left ventricular ejection fraction approximately 53 per cent", "53"), ("echocardiographic ejection fraction not documented", None), ("EF 35-40%", "38"), ("heart failure with reduced EF; SpO2 95%", None)],
    "smoking_status": [
        ("Smoking status: stopped smoking several years ago.", "former"), ("smoking=ex-smoker", "former"), ("Tobacco history: non-smoker.", "never"), ("NKDA; no tobacco use.", "never"), ("Smoking: ongoing tobacco use.", "current"),
        ("tobacco: actively smokes cigarettes.", "current"), ("Smoking: quit 2019.", "former"), ("Smoking: no.", "never"), ("No smoking data.", None), ("Smoking history not documented.", None), ("Diagnoses: HTN.", None),
    ],
    "allergy": [
        ("Allergies: NKDA.", "none"), ("Drug allergy: no medication allergy documented.", "none"), ("Allergy: penicillin causes rash.", "penicillin"), ("Allergy: ibuprofen-associated urticaria.", "nsaid"),
        ("Allergy=allergic to non-steroidal anti-inflammatory drugs", "nsaid"), ("Drug allergy: contrast medium reaction.", "iodinated_contrast"), ("Diagnoses: HTN.", None),
    ],
}


def _field(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cases = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FIELDS[name])], "case_no int, note_text string").coalesce(1)
        value = F.col(f"extracted_clinical_data.{name}")
        shown = F.array_join(value, ",") if name in ("diagnoses", "medications") else value.cast("string")
        return extraction.extract(cases).select("case_no", shown.alias("value"))

    return query


#: (clause, mention, whether it is a drug, whether it is stated as a fact)
ASSERTED = [
    ("known hypertension", "hypertension", False, True), ("no hypertension", "hypertension", False, False), ("denies any chest pain or COPD", "COPD", False, False),
    ("no fever in the past six or seven days, known COPD", "COPD", False, True), ("no COPD but known hypertension", "hypertension", False, True), ("pneumonia was ruled out", "pneumonia", False, False),
    ("mother had COPD", "COPD", False, False), ("allergy: aspirin", "aspirin", True, False), ("aspirin 75 mg", "aspirin", True, True), ("metformin was discontinued", "metformin", True, False),
    ("rash with pneumonia", "pneumonia", False, True), ("? pneumonia", "pneumonia", False, False),
]


def asserted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, c, c.index(m), c.index(m) + len(m), d) for i, (c, m, d, _) in enumerate(ASSERTED)], "case_no int, clause string, s int, e int, drug boolean")
    said = F.when(F.col("drug"), extraction.asserted(F.col("clause"), F.col("s"), F.col("e"), True)).otherwise(extraction.asserted(F.col("clause"), F.col("s"), F.col("e"), False))
    return cases.select("case_no", said.alias("fact"))


CLAUSES = [
    ("One. Two; three | four\nfive", ["One.", "Two", " three ", " four", "five"]), ("BP 1.5 mg. then", ["BP 1.5 mg. then"]), ("[a] b", ["[a]", "b"]), ("  ; \n ", []), ("End.", ["End"]), (None, []),
]


def note_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLAUSES)], "case_no int, t string")
    return cases.select("case_no", F.posexplode(extraction.clauses(F.col("t"))).alias("i", "clause"))


# ---- spans, values and records

_SPANS = [(2, 1, "EMAIL"), (0, 4, "EMAIL"), (3, 6, "EMAIL"), (4, 5, "NONE"), (8, 99, "EMAIL"), (6, 8, "ADDRESS")]


def spans_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.array(*(S.span(F.lit(s), F.lit(e), label, "given") for s, e, label in _SPANS))
    return spark.range(1).select(F.inline(S.to_json(S.validated(held, F.lit(9)))))


VALUES = [(0.25, "0.25"), (None, None), (float("nan"), "nan"), (1.5, " 1.5 "), (-0.1, "x"), (float("inf"), "inf"), (1.0, "7,5"), (0.0, "-3")]


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(VALUES)], "case_no int, p double")
    return rows.select("case_no", metrics.probability(F.col("p")).alias("p"))


def numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(VALUES)], "case_no int, v string")
    return rows.select("case_no", metrics.numeric_value(F.col("v")).alias("v"))


def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as lines of JSON, nulls too, and read back strictly."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.nullif("quality", F.lit(0)).alias("quality"), F.struct("toxic").alias("more"))
    lines = notes.as_lines(labels)
    return notes.parsed(lines, "doc_id long, quality int, more struct<toxic:int>").select("doc_id", "quality", "more.toxic")


def all_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with even ids stand for the labelled split, the others for inputs whose truth is a table of its own."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    case = F.col("doc_id").cast("string").alias("case_id")
    none = F.array().cast(notes.SPAN_SCHEMA).alias("pii_entities")
    named = docs.join(labels, "doc_id").select(case, F.col("lang").alias("hospital_id"), F.col("text").alias("note_text"), F.struct(F.col("n_chars").cast("int").alias("age_years")).alias("structured_features"), F.struct(none, F.col("quality").alias("readmission_30d")).alias("labels"), (F.col("doc_id") % 2).alias("odd"))
    truth = named.where("odd = 1").select("case_id", none, F.col("labels.readmission_30d").alias("readmission_30d"))
    got = notes.labelled_notes(named.where("odd = 0").drop("odd"), named.where("odd = 1").drop("odd", "labels"), truth)
    return got.select("case_id", F.length("note_text").alias("n_chars"), F.size("spans").alias("n_spans"), "age")


def doubled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("A",), ("B",), ("A",), ("",), (None,), ("C",)], "case_id string")
    return evaluate.duplicate_keys(rows, "case_id").select(F.coalesce("case_id", F.lit("null")).alias("case_id"), "count")


def labels_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = labels.select(F.col("doc_id").alias("case_id"), F.col("quality").alias("readmission_30d"))
    return notes.attach_labels(docs.select(F.col("doc_id").alias("case_id"), "lang"), truth)


def note_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extended features of two cases, those that are not 0."""
    rows = [("A", "NOWHERE", "", None), ("B", "BERLIN_NODE", "Known hypertension. EF 40%. Metformin 500 mg. Smoking: quit 2019.", (71, "male", None, 2, True))]
    got = features.with_features(extraction.extract(spark.createDataFrame(rows, notes.INPUT_SCHEMA).coalesce(1)), "extended")
    names = features.SETS["extended"]
    return got.select("case_id", F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names)))).where("value <> 0")


_FEATURES = {
    "A": dict.fromkeys((f"missing_{f}" for f in features.LABS), 1.0),
    "B": {"age_years": 71.0, "sex_male": 1.0, "length_of_stay_days": 2.0, "emergency_admission": 1.0, "site_BERLIN_NODE": 1.0, "dx_hypertension": 1.0, "lvef_percent": 40.0, "n_medications": 1.0, "smoking_former": 1.0}
    | dict.fromkeys((f"missing_{f}" for f in features.LABS if f != "lvef_percent"), 1.0),
}


# ---- evaluation

_FACTS = (["hypertension"], ["ramipril"], None, None, None, None, None, "never", "none")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perfect submission, and one with a missing row, a wrong label and a wrong number."""
    note, shown, span = "Patient: Anna Keller", "Patient: [PATIENT_NAME]", [(9, 20, "PATIENT_NAME")]
    ids, y = ["X1", "X2"], [1, 0]
    inputs = spark.createDataFrame([(i, "BERLIN_NODE", note) for i in ids], "case_id string, hospital_id string, note_text string")
    truth = spark.createDataFrame([(i, "BERLIN_NODE", span, shown, _FACTS, v) for i, v in zip(ids, y, strict=True)], notes.TRUTH_SCHEMA)
    good = spark.createDataFrame([(i, span, shown, _FACTS, float(v)) for i, v in zip(ids, y, strict=True)], notes.PREDICTION_SCHEMA)
    worse = spark.createDataFrame([("X1", [(9, 20, "CLINICIAN_NAME")], "Patient: [CLINICIAN_NAME]", (["copd"], ["ramipril"], 80, None, None, None, None, "never", "penicillin"), 1.0)], notes.PREDICTION_SCHEMA)
    told = []
    for name, pred in (("good", good), ("worse", worse)):
        r = evaluate.evaluate(inputs, truth, pred)
        flat = {"deid": r["deidentification"]["composite"], "leakage": r["deidentification"]["leakage_rate"], "extraction": r["extraction"]["composite"], "diagnoses": r["extraction"]["fields"]["diagnoses"], "heart_rate": r["extraction"]["fields"]["heart_rate_bpm"],
                "prediction": r["prediction"]["overall"]["composite"], "composite": r["composite"], "points": r["points"], "missing": r["missing_predictions"]}
        told += [(name, k, round(float(v), 6)) for k, v in flat.items()]
    return spark.createDataFrame(told, "submission string, score string, value double")


# By hand: of 22 personal characters 11 are found, all with the wrong label, none as an entity; one case of two has no prediction.
_CHAR = 2 * 11 / (2 * 11 + 0 + 11)
_W_DEID = 0.55 * _CHAR
_W_SETS, _W_NUM, _W_CAT = (0.0, 2 * 1 / (2 + 0 + 1)), (0.5 + 1 + 1 + 1 + 1) / 5, (0.5 + 0.0) / 2
_W_EXTR = 0.22 * _W_SETS[0] + 0.22 * _W_SETS[1] + 0.40 * _W_NUM + 0.16 * _W_CAT
_W_PRED = 0.55 * 1.0 + 0.25 * 1.0 + 0.20 * (1 - 0.25 / 2)
EVALUATION = [("good", k, v) for k, v in (("deid", 1.0), ("leakage", 0.0), ("extraction", 1.0), ("diagnoses", 1.0), ("heart_rate", 1.0), ("prediction", 1.0), ("composite", 1.0), ("points", 40.0), ("missing", 0.0))] + [
    ("worse", k, round(v, 6))
    for k, v in (
        ("deid", _W_DEID), ("leakage", 0.5), ("extraction", _W_EXTR), ("diagnoses", 0.0), ("heart_rate", 0.5), ("prediction", _W_PRED),
        ("composite", 0.375 * _W_DEID + 0.375 * _W_EXTR + 0.25 * _W_PRED), ("points", 15 * _W_DEID + 15 * _W_EXTR + 10 * _W_PRED), ("missing", 1.0),
    )
]


# ---- perturbation: whatever is changed, spans stay spans of their label

FORMS = {
    "ids_alternative_schemes": ("PATIENT_ID", r"^(?:BER/\d{4}/\d{2}|UHID/\d{5}/\d{2}|MRN-\d{2}-\d{5})$"),
    "phones_national_formats": ("PHONE_NUMBER", r"^[0-9+() -]+$"),
    "names_complex": ("PATIENT_NAME", r"^\p{Lu}.* .*$"),
    "names_inverted": ("PATIENT_NAME", r"^[^,]+, .+$"),
}


def perturbed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of the changed label there are after each transform, and how many have the form it gives them."""
    gold = spark.createDataFrame([(i, t, [(s, e, label, "gold") for s, e, label, _ in _placed(t, found)]) for i, (t, _, found) in enumerate(DETECTED) if t], f"case_no int, note_text string, gold {S.SPANS}").coalesce(1)
    told = None
    for name, (label, form) in FORMS.items():
        said = perturb.perturb(gold, "note_text", "gold", name, seed=3).select("note_text", F.inline("gold")).where(F.col("label") == label)
        said = said.withColumn("said", F.substring("note_text", F.col("start") + 1, F.col("end") - F.col("start")))
        part = said.agg(F.lit(name).alias("transform"), F.count("*").alias("n"), F.count_if(F.col("said").rlike(form)).alias("n_form"))
        told = part if told is None else told.unionByName(part)
    return told


def perturbed_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the gold spans of a whole note, how many the detector still finds after each transform, and after all together."""
    text, _, found = DETECTED[0]
    gold = spark.createDataFrame([(text, [(s, e, label, "gold") for s, e, label, _ in _placed(text, found)])], f"note_text string, gold {S.SPANS}")
    moved = perturb.every_transform(gold, "note_text", "gold", seed=3)
    return perturb.evaluate_transforms(moved, "note_text", "gold").select("transform", "n_gold", "n_found", "n_other")


# ---- protocol and accounting


def key_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of five sites agrees on the same key from both sides, and on another one for another use; sealed messages open, tampered ones do not."""
    keys = [crypto.key_pair(Random(i)) for i in range(5)]
    told = []
    for a in range(5):
        for b in range(a):
            here, there = crypto.agree(keys[a].secret, keys[b].public, b"use"), crypto.agree(keys[b].secret, keys[a].public, b"use")
            blob = crypto.seal(here, b"hello", b"about", Random(7))
            try:
                crypto.unseal(there, blob[:-1] + bytes([blob[-1] ^ 1]), b"about")
                refused = False
            except crypto.CryptoError:
                refused = True
            told.append((b, a, here == there, here != crypto.agree(keys[a].secret, keys[b].public, b"other"), crypto.unseal(there, blob, b"about") == b"hello", refused))
    return spark.createDataFrame(told, "a int, b int, same boolean, by_use boolean, opens boolean, refused boolean")


def secret_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which subsets of five shares give the secret back; three are needed."""
    from itertools import combinations

    secret = 2**255 + 12345
    shares = crypto.split(secret, 5, 3, Random(1))
    told = [(k, ",".join(map(str, at)), crypto.join([shares[i] for i in at]) == secret) for k in (2, 3, 4, 5) for at in combinations(range(5), k)]
    return spark.createDataFrame(told, "n int, shares string, whole boolean")


def secure_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of order lines by region under the whole protocol, first of all sites, then with one that drops out after masking."""
    from siloflow.plans.sites import NAMES, site_rows

    rows = site_rows(spark, sf_dir).groupBy("site").agg(*(F.round(F.sum(n), 2).alias(n) for n in NAMES)).toPandas().sort_values("site")
    vectors = {i: r[NAMES].to_numpy(float) for i, (_, r) in enumerate(rows.iterrows())}
    agg = secagg.Aggregator({i: secagg.Site(i, 3, Random(i)) for i in vectors}, 3)
    told = [("all", agg.sum(vectors)), ("without the first", agg.sum(vectors, frozenset({0})))]
    return spark.createDataFrame([(who, n, round(float(v), 2)) for who, total in told for n, v in zip(NAMES, total, strict=True)], "sites string, name string, total double")


def masks_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two masks of every pair of sites add up to nothing in the ring, and differ from round to round."""
    keys = {i: crypto.key_pair(Random(i)) for i in range(4)}
    told = []
    for a in range(4):
        for b in range(a + 1, 4):
            here, there = secagg.pair_mask(keys[a].secret, keys[b].public, a, b, 1, 64), secagg.pair_mask(keys[b].secret, keys[a].public, a, b, 1, 64)
            told.append((a, b, int((here == there).sum()), int((here != secagg.pair_mask(keys[a].secret, keys[b].public, a, b, 2, 64)).sum())))
    return spark.createDataFrame(told, "a int, b int, equal int, fresh int")


# Targets and the noise they take over 30 steps at a delta of 1e-3.
NOISE = [(0.5, 25.251), (1.0, 14.102), (2.0, 7.916), (4.0, 4.508), (8.0, 2.629)]


def noise_for_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e, round(accounting.multiplier_for(e, 30, 1e-3), 3), round(accounting.epsilon(accounting.multiplier_for(e, 30, 1e-3), 30, 1e-3), 3)) for e, _ in NOISE]
    return spark.createDataFrame(rows, "target double, sigma double, epsilon double")


def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all types that may be sent, there and back, and one that may not."""
    sent = {"numbers": [1, 2.5, None, True], "big": 2**70, "bytes": b"\x00\xff", "words": np.array([1, 2**63], dtype=np.uint64), "matrix": np.eye(2), "keys": {1: "a", 2: {"b": [1]}}}
    back = {k: wire.decode(wire.encode(v)) for k, v in sent.items()}
    same = {k: bool(np.array_equal(back[k], v) and back[k].dtype == v.dtype) if isinstance(v, np.ndarray) else back[k] == v for k, v in sent.items()}
    try:
        wire.encode({"x": object()})
        refused = False
    except TypeError:
        refused = True
    return spark.createDataFrame([(k, v, wire.describe(sent[k])) for k, v in same.items()] + [("object", refused, "refused")], "message string, same boolean, shape string")


def own_site_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's rows pass its guard; with a foreign row among them the job fails."""
    rows = spark.createDataFrame([("A", 1), ("A", 2)], "site string, v int")
    kept = federated.own_rows(rows, "site", "A").count()
    try:
        federated.own_rows(rows.unionByName(spark.createDataFrame([("B", 3)], "site string, v int")), "site", "A").agg(F.sum("v")).collect()
        failed = False
    except Exception as e:  # noqa: BLE001
        failed = "foreign row" in str(e)
    return spark.createDataFrame([(kept, failed)], "kept long, failed boolean")


QUERIES = {name: _detected(labels) for name, labels in LABEL_GROUPS.items()} | {f"field_{name}": _field(name) for name in FIELDS}
QUERIES |= {
    f.__name__: f
    for f in (
        deidentified_cases, asserted_mentions, note_clauses, spans_validated, probabilities, numeric_values, jsonl_records, all_labelled, doubled_ids, labels_attached,
        note_features, evaluation, perturbed_forms, perturbed_detection, key_agreement, secret_shares, secure_sum, masks_cancel, noise_for_targets, wire_messages, own_site_only,
    )
}


def _oracle() -> dict[str, str]:
    from itertools import combinations

    from siloflow.plans.sites import _SITE, NAMES

    out = {}
    for name, labels in LABEL_GROUPS.items():
        out[name] = answers("case_no start \"end\" label said", [(i, s, e, label, said) for i, (t, _, found) in enumerate(DETECTED) for s, e, label, said in _placed(t, found) if label in labels])
    out["deidentified_cases"] = answers("case_no deidentified_text", [(i, _rendered(t, found)) for i, (t, _, found) in enumerate(DETECTED)])
    for name, cases in FIELDS.items():
        out[f"field_{name}"] = answers("case_no value", [(i, v) for i, (_, v) in enumerate(cases)], value="VARCHAR")
    out["asserted_mentions"] = answers("case_no fact", [(i, v) for i, (*_, v) in enumerate(ASSERTED)])
    out["note_clauses"] = answers("case_no i clause", [(n, i, c) for n, (_, held) in enumerate(CLAUSES) for i, c in enumerate(held)])
    out["spans_validated"] = answers('start "end" label', [(0, 4, "EMAIL"), (6, 8, "ADDRESS")])
    out["probabilities"] = answers("case_no p", [(0, 0.25), (1, 0.5), (2, 0.5), (3, 1.0), (4, 0.0), (5, 0.5), (6, 1.0), (7, 0.0)], p="DOUBLE")
    out["numeric_values"] = answers("case_no v", [(0, 0.25), (1, None), (2, None), (3, 1.5), (4, None), (5, None), (6, None), (7, -3.0)], v="DOUBLE")
    out["jsonl_records"] = "SELECT doc_id, nullif(quality, 0) AS quality, toxic FROM labels"
    out["all_labelled"] = "SELECT CAST(doc_id AS VARCHAR) AS case_id, CAST(length(text) AS INTEGER) AS n_chars, 0 AS n_spans, CAST(n_chars AS INTEGER) AS age FROM documents JOIN labels USING (doc_id)"
    out["doubled_ids"] = answers("case_id count", [("A", 2), ("", 1), ("null", 1)])
    out["labels_attached"] = "SELECT d.doc_id AS case_id, lang, readmission_30d FROM documents d JOIN (SELECT doc_id, max(quality) AS readmission_30d FROM labels GROUP BY 1) l USING (doc_id)"
    out["note_features"] = answers("case_id feature value", [(c, k, v) for c, held in _FEATURES.items() for k, v in held.items()])
    out["evaluation"] = answers("submission score value", EVALUATION)
    n = {label: sum(x == label for t, _, found in DETECTED for _, x in found) for label in S.LABELS}
    out["perturbed_forms"] = answers("transform n n_form", [(k, n[label], n[label]) for k, (label, _) in FORMS.items()])
    gold = len(DETECTED[0][2])
    out["perturbed_detection"] = answers("transform n_gold n_found n_other", [(k, gold, gold, 0) for k in ("identity", *perturb.TRANSFORMS, "combined")])
    out["key_agreement"] = answers("a b same by_use opens refused", [(b, a, True, True, True, True) for a in range(5) for b in range(a)])
    out["secret_shares"] = answers("n shares whole", [(k, ",".join(map(str, at)), k >= 3) for k in (2, 3, 4, 5) for at in combinations(range(5), k)])
    out["secure_sum"] = " UNION ALL ".join(f"SELECT '{who}' AS sites, '{x}' AS name, round(sum(v), 2) AS total FROM (SELECT site, round(sum({x}), 2) AS v FROM ({_SITE}) s GROUP BY site) t{cond}" for who, cond in (("all", ""), ("without the first", " WHERE site <> 'AFRICA'")) for x in NAMES)
    out["masks_cancel"] = answers("a b equal fresh", [(a, b, 64, 64) for a in range(4) for b in range(a + 1, 4)])
    out["noise_for_targets"] = answers("target sigma epsilon", [(e, s, e) for e, s in NOISE])
    out["wire_messages"] = answers("message same shape", [("numbers", True, "list[4]"), ("big", True, "int"), ("bytes", True, "bytes[2]"), ("words", True, "uint64[2]"), ("matrix", True, "float64[2x2]"), ("keys", True, "dict[2]"), ("object", True, "refused")])
    out["own_site_only"] = answers("kept failed", [(2, True)])
    return out


ORACLE = _oracle()
