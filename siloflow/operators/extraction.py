"""Structured facts from clinical notes, as column expressions: concepts with their context, numbers with units, categories.

A note is cut into clauses once; everything else is array expressions over the clauses or the note, so
nothing is shuffled and nothing leaves the JVM. Repeated groups in patterns are possessive, as Java
matches other starred groups by recursion and long runs of blanks or colons would exhaust its stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.functions.regex import DIALECT, found, has, matches

# The terminology. Per concept: spellings in any case, then abbreviations in this case only.
DIAGNOSES = {
    "atrial_fibrillation": ([r"atrial fibrillation", r"a-?fib", r"vorhofflimmern"], ["AF", "AFib", "PAF"]),
    "heart_failure": (
        [r"heart failure", r"cardiac failure", r"LV failure", r"left ventricular failure", r"cardiac insufficiency", r"herzinsuffizienz"],
        ["HFrEF", "HFpEF", "HFmrEF", "CHF", "CCF", "LVF"],
    ),
    "hypertension": ([r"hypertension", r"hypertensive (?:disease|heart disease)", r"high blood pressure", r"(?:arterielle )?hypertonie"], ["HTN"]),
    "type_2_diabetes": (
        [
            r"type (?:2|ii) (?:diabetes(?: mellitus)?|dm)", r"diabetes mellitus(?: type (?:2|ii))?", r"type 2 dm", r"diabetes type (?:2|ii)",
            r"non-insulin[- ]dependent diabetes",
        ],
        ["T2DM", "DM2", "DM ?II", "T2D", "NIDDM", "DM"],
    ),
    "chronic_kidney_disease": ([r"chronic kidney disease", r"chronic renal (?:disease|dysfunction|insufficiency|failure|impairment)", r"chronische niereninsuffizienz"], ["CKD"]),
    "coronary_artery_disease": ([r"coronary (?:artery |heart )?disease", r"isch(?:a)?emic heart disease", r"koronare herzkrankheit"], ["CAD", "IHD", "CHD", "KHK"]),
    "acute_coronary_syndrome": (
        [r"acute coronary syndrome", r"unstable angina", r"(?:non-?ST|ST)[- ]elevation myocardial infarction", r"acute myocardial infarction"],
        ["ACS", "N?STEMI"],
    ),
    "pneumonia": ([r"pneumonia", r"bronchopneumonia", r"infective consolidation", r"pneumonie"], ["CAP"]),
    "copd": (
        [r"chronic obstructive (?:pulmonary|airways?|lung) disease", r"chronic airways? obstruction", r"obstructive (?:lung|airways?) disease"],
        ["COPD", "COAD"],
    ),
}
MEDICATIONS = {
    "apixaban": (["apixaban", "eliquis"], ["APX"]),
    "rivaroxaban": (["rivaroxaban", "xarelto"], []),
    "warfarin": (["warfarin", "coumadin", "marevan"], []),
    "metoprolol": (["metoprolol", "lopressor", "betaloc", "beloc(?:-zok)?", "toprol"], []),
    "bisoprolol": (["bisoprolol", "concor"], []),
    "furosemide": (["furosemide", "frusemide", "lasix"], []),
    "ramipril": (["ramipril", "tritace", "altace", "delix"], []),
    "amlodipine": (["amlodipine?", "norvasc", "amlong"], []),
    "metformin": (["metformin", "glucophage", "glycomet"], []),
    "insulin": (["insulin(?: glargine| detemir| aspart| lispro)?", "lantus", "levemir", "novorapid"], []),
    "atorvastatin": (["atorvastatin", "atorva", "lipitor", "sortis"], []),
    "aspirin": (["aspirin", "acetylsalicylic acid", "ecosprin"], ["ASA", "ASS"]),
    "clopidogrel": (["clopidogrel", "plavix", "iscover"], []),
    "amiodarone": (["amiodarone?", "cordarone"], []),
    "digoxin": (["digoxin", "lanoxin"], []),
    "azithromycin": (["azithromycin", "azithro", "zithromax", "azee"], []),
}
TYPE_1_DIABETES = r"(?i:type (?:1|i) (?:diabetes|dm)|\bT1DM\b|\bIDDM\b|juvenile diabetes)"
TYPE_2_DIABETES = r"(?i:type (?:2|ii)|T2DM|DM2)"
# Context triggers.
NEGATED_BEFORE = (
    r"(?i:\b(?:no|not|denies|denied|deny|without|negative for|free of|absence of|absent|ruled out|rule out|"
    r"r/o|excluded|no evidence of|no history of|no signs? of|no clinical features of|never had|kein(?:e|en)?|"
    r"not on|off|avoid(?:ed)?|contraindicated|suspected|possible|query|questionable)\b)|(?:^|\s)\?\s*$"
)
NEGATED_AFTER = (
    r"(?i:\b(?:considered but|not confirmed|ruled out|was excluded|excluded|unlikely|not started|"
    r"was not started|not commenced|discussed but|discontinued|stopped|ceased|held|withheld|on hold|"
    r"declined|refused|not tolerated|was considered|to be considered|planned|to start|if needed)\b)"
)
FAMILY = (
    r"(?i:\b(?:family history|fam(?:ily)? hx|FHx?|mother|father|brother|sister|sibling|parent|grandmother|"
    r"grandfather|aunt|uncle|cousin|relative|degree relative)\b)"
)
ALLERGY = r"(?i:allerg|intoleran|hypersensitiv|anaphyla|urticaria|rash|reaction|nkda|unvertr)"
CONTRAST = r"(?i:\b(?:but|however|although|except|apart from)\b)"
CLAUSE_END = r"(?:(?<=[.!?])\s+(?=[A-Z\[(])|[;\n|]|(?<=\])\s|\.\s*$)"
SCOPE_WORDS = 6
# Numeric cues, links and units.
NUMBER = r"(\d{1,4}(?:[.,]\d{1,3})?)"
LINK = r"(?:\s*+(?:of|was|is|at|measured|approximately|approx\.?|about|around|~|estimated(?: at)?|=|:)\s*+)*+\s*+"
HEART_RATE = rf"(?i:\b(?:heart rate|HR|pulse(?: rate)?|ventricular rate|herzfrequenz)\b){LINK}(\d{{2,3}})(?!\d|[.,]\d|\s*/\s*\d)\s*(?:bpm|/ ?min|per minute|beats)?"
PRESSURE = rf"(?i:\b(?:blood pressure|BP|NIBP|RR|arterial pressure)\b){LINK}(\d{{2,3}})\s*(?:/|over)\s*(\d{{2,3}})"
SYSTOLIC = rf"(?i:\b(?:SBP|systolic (?:blood pressure|BP|pressure))\b){LINK}(\d{{2,3}})"
CREATININE = rf"(?i:\b(?:serum |plasma |s-?)?(?:creatinine|creat|kreatinin|cr|scr)\b){LINK}{NUMBER}\s*(mg/dl|mg/100 ?ml|µmol/l|μmol/l|umol/l|micromol/l|mmol/l)?"
HEMOGLOBIN = rf"(?i:\b(?:ha?emoglobin|hämoglobin|hgb|hb)\b){LINK}{NUMBER}\s*(g/dl|g/l|mmol/l|g%)?"
EJECTION = rf"(?i:\b(?:LVEF|LV-?EF|EF|ejection fraction)\b){LINK}(\d{{1,2}}(?:[.,]\d)?)(?:\s*(?:-|–|to)\s*(\d{{1,2}}))?\s*(?:%|per ?cent|percent)"
UMOL_PER_MG, HB_PER_MMOL = 88.4, 1.611
# Smoking and allergy wording, in the order in which it decides.
SMOKING = [
    ("never", r"(?i:never[- ]smok|non-?smoker|nonsmoker|\bno tobacco\b|never used tobacco|does not smoke|doesn't smoke|denies (?:smoking|tobacco)|no (?:history of )?smoking|lifelong non|nichtraucher|tobacco: no\b|smoking: no\b)"),
    ("former", r"(?i:ex-?smoker|ex smoker|former(?:ly)? (?:smoker|smoked|tobacco)|stopped smoking|quit(?:ting)? smoking|gave up smoking|previous(?:ly)? smok|past smoker|prior smoker|quit tobacco|ex-?raucher|ehemalige[rn]? raucher|smoked .{0,20}(?:until|ago)|abstinent)"),
    ("current", r"(?i:current(?:ly)? smok|actively smokes|active smoker|ongoing (?:tobacco|smoking)|smokes \d|(?:still|daily) smok|smokes (?:cigarettes|daily|tobacco)|\braucher(?:in)?\b|tobacco: yes|smoking: yes|\bsmoker\b)"),
]
SMOKING_PLAIN = [
    ("former", r"(?i:\b(?:quit|ex|former|stopped|previous|past)\b)"),
    ("current", r"(?i:\b(?:current|yes|active|daily|pack)\b)"),
    ("never", r"(?i:\b(?:never|none|no|nil|denies)\b)"),
]
SMOKING_TOPIC = r"(?i:smok|tobacco|cigar|raucher|nicotin)"
UNDOCUMENTED = r"(?i:not (?:documented|recorded|available|known|assessed)|unknown|no (?:\w+ )?(?:data|information|details)|unavailable)"
ALLERGENS = [
    ("penicillin", r"(?i:penicillin|amoxicillin|ampicillin|augmentin|beta-?lactam|flucloxacillin)"),
    ("nsaid", r"(?i:nsaid|non-?steroidal|ibuprofen|diclofenac|naproxen|nsar)"),
    ("iodinated_contrast", r"(?i:contrast|iodinated|iodine|radiocontrast|kontrastmittel)"),
]
NO_ALLERGY = (
    r"(?i:\bnkda\b|\bnka\b|no known (?:drug )?allerg|no (?:known )?(?:medication|drug) allerg|no allergies|"
    r"allerg(?:y|ies)\s*[:=]\s*(?:none|nil|no)\b|keine (?:bekannten )?allergien|nil known)"
)
FIELDS = ("diagnoses", "medications", "heart_rate_bpm", "systolic_bp_mmhg", "creatinine_mg_dl", "hemoglobin_g_dl", "lvef_percent", "smoking_status", "allergy")


def clauses(note: Column) -> Column:
    """The clauses of a note, without blank ones."""
    return F.filter(F.split(F.coalesce(note, F.lit("")), DIALECT + CLAUSE_END, -1), lambda c: F.trim(F.regexp_replace(c, r"(?U)\s", " ")) != "")


def concept_pattern(spellings: list[str], abbreviations: list[str]) -> str:
    every = [f"(?i:{'|'.join(spellings)})", *abbreviations]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(every)})(?![A-Za-z0-9])"


def mention_pattern(lexicon: dict[str, tuple[list[str], list[str]]]) -> str:
    """Any mention of a lexicon; what ends clauses is no letter or digit, so notes have what their clauses have."""
    return rf"(?<![A-Za-z0-9])(?:(?i:{'|'.join(x for spelled, _ in lexicon.values() for x in spelled)})|{'|'.join(x for _, short in lexicon.values() for x in short)})(?![A-Za-z0-9])"


def asserted(clause: Column, start: Column, end: Column, drug: bool) -> Column:
    """Whether what stands at a place of a clause is stated as an active fact."""
    before, after = F.substring(clause, F.lit(1), start), F.substring(clause, end + 1, F.length(clause))
    scope = F.element_at(F.split(before, DIALECT + CONTRAST, -1), -1)
    tokens = F.filter(F.split(scope, r"(?U)\s+", -1), lambda x: x != "")
    near = F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - SCOPE_WORDS + 1, F.lit(1)), F.lit(SCOPE_WORDS)), " ")
    fact = ~has(near, NEGATED_BEFORE) & ~has(after, NEGATED_AFTER) & ~has(clause, FAMILY)
    return fact & ~has(clause, ALLERGY) if drug else fact


def concepts(clause_array: Column, lexicon: dict[str, tuple[list[str], list[str]]], drug: bool) -> Column:
    """The sorted concepts of which some mention is asserted; one pass finds mentions of all, each is then named."""
    named = {k: concept_pattern(*v) for k, v in lexicon.items()}
    every = "|".join(f"(?:{p})" for p in named.values())

    def name(said: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, p in reversed(named.items()):
            out = F.when(has(said, f"\\A(?:{p})\\z"), k).otherwise(out)
        return out

    def of_clause(c: Column) -> Column:
        facts = F.filter(found(c, every), lambda m: asserted(c, m["start"], m["end"], drug))
        return F.transform(facts, lambda m: name(m["text"]))

    mentioned = F.filter(clause_array, lambda c: has(c, every))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(mentioned, of_clause)), lambda x: x.isNotNull())))


def diagnoses(note: Column, clause_array: Column) -> Column:
    """Without type 2 diabetes where only type 1 is spelled out."""
    hits = concepts(clause_array, DIAGNOSES, drug=False)
    type_1 = has(note, TYPE_1_DIABETES) & ~has(note, TYPE_2_DIABETES)
    return F.when(type_1, F.array_remove(hits, "type_2_diabetes")).otherwise(hits)


def medications(clause_array: Column) -> Column:
    return concepts(clause_array, MEDICATIONS, drug=True)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).cast("double")


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _pairs(note: Column, pattern: str) -> Column:
    """Two groups of every match side by side, missing ones null."""
    gone = lambda x: F.when(x != "", x)
    return F.zip_with(matches(note, pattern, 1), matches(note, pattern, 2), lambda a, b: F.struct(a.alias("a"), gone(b).alias("b")))


def creatinine_mg_dl(value: Column, unit: Column) -> Column:
    """To mg/dL; without a unit, values above 25 are read as µmol/L. Null out of 0.1 to 25."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    v = (
        F.when(u.isin("µmol/l", "μmol/l", "umol/l", "micromol/l"), value / UMOL_PER_MG)
        .when(u == "mmol/l", value * 1000.0 / UMOL_PER_MG)
        .when((u == "") & (value > 25), value / UMOL_PER_MG)
        .otherwise(value)
    )
    return F.when(v.between(0.1, 25.0), F.bround(v, 2))


def hemoglobin_g_dl(value: Column, unit: Column) -> Column:
    """To g/dL; without a unit, values above 30 are read as g/L. Null out of 3 to 25."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    v = F.when(u == "g/l", value / 10.0).when(u == "mmol/l", value * HB_PER_MMOL).when((u == "") & (value > 30), value / 10.0).otherwise(value)
    return F.when(v.between(3.0, 25.0), F.bround(v, 1))


def heart_rate(note: Column) -> Column:
    return _first(F.transform(matches(note, HEART_RATE, 1), lambda x: F.when(x.cast("int").between(20, 250), x.cast("int"))))


def systolic(note: Column) -> Column:
    """From pairs first, then from systolic values alone; a pair must be plausible, as RR is also a breathing rate."""
    pair = lambda p: F.when(p["a"].cast("int").between(50, 280) & (p["b"].cast("int") >= 20) & (p["b"].cast("int") < p["a"].cast("int")), p["a"].cast("int"))
    alone = lambda x: F.when(x.cast("int").between(50, 280), x.cast("int"))
    return _first(F.concat(F.transform(_pairs(note, PRESSURE), pair), F.transform(matches(note, SYSTOLIC, 1), alone)))


def creatinine(note: Column) -> Column:
    return _first(F.transform(_pairs(note, CREATININE), lambda p: creatinine_mg_dl(_number(p["a"]), p["b"])))


def hemoglobin(note: Column) -> Column:
    return _first(F.transform(_pairs(note, HEMOGLOBIN), lambda p: hemoglobin_g_dl(_number(p["a"]), p["b"])))


def ejection_fraction(note: Column) -> Column:
    value = lambda p: F.when(p["b"].isNotNull(), (_number(p["a"]) + p["b"].cast("double")) / 2).otherwise(_number(p["a"]))
    return F.bround(_first(F.transform(_pairs(note, EJECTION), lambda p: F.when(value(p).between(5.0, 90.0), value(p))))).cast("int")


def _first_rule(clause_array: Column, rules: list[tuple[str, str]], unless: str | None = None) -> Column:
    """The answer of the first rule, in their order, that the first clause with any answer meets."""

    def answer(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, pattern in reversed(rules):
            out = F.when(has(c, pattern), label).otherwise(out)
        return F.when(~has(c, unless), out) if unless else out

    return _first(F.transform(clause_array, answer))


def smoking(clause_array: Column) -> Column:
    told = F.filter(clause_array, lambda c: has(c, SMOKING_TOPIC) & ~has(c, FAMILY) & ~has(c, UNDOCUMENTED))
    return F.coalesce(_first_rule(told, SMOKING), _first_rule(told, SMOKING_PLAIN))


def allergy(clause_array: Column) -> Column:
    told = F.filter(clause_array, lambda c: has(c, ALLERGY))
    none = F.when(F.exists(told, lambda c: has(c, NO_ALLERGY)), F.lit("none"))
    return F.coalesce(_first_rule(told, ALLERGENS, unless=NO_ALLERGY), none)


def extract(notes: DataFrame, text: str = "note_text", into: str = "extracted_clinical_data") -> DataFrame:
    """Add a struct of all nine fields; lists are empty and single values null where nothing is found.

    A note is cut into clauses only if it has a sign of some field that is read by clauses.
    """
    signs = {"d": mention_pattern(DIAGNOSES), "m": mention_pattern(MEDICATIONS), "s": SMOKING_TOPIC, "a": ALLERGY}
    out = notes.withColumn("_n", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_g", F.struct(*(has(F.col("_n"), p).alias(k) for k, p in signs.items()), has(F.col("_n"), r"\d").alias("n")))
    seen = lambda k: F.col("_g")[k]
    none = F.array().cast("array<string>")
    # a partition's number, which is never below 0, keeps later filters above: pushed below, they would copy the staged columns
    signed = (seen("d") | seen("m") | seen("s") | seen("a")) & (F.spark_partition_id() >= 0)
    out = out.withColumn("_c", F.when(signed, clauses(F.col("_n"))).otherwise(none))
    n, c = F.col("_n"), F.col("_c")
    listed = (F.when(seen("d"), diagnoses(n, c)).otherwise(none), F.when(seen("m"), medications(c)).otherwise(none))
    measured = [F.when(seen("n"), f(n)) for f in (heart_rate, systolic, creatinine, hemoglobin, ejection_fraction)]
    values = (*listed, *measured, F.when(seen("s"), smoking(c)), F.when(seen("a"), allergy(c)))
    return out.withColumn(into, F.struct(*(v.alias(k) for k, v in zip(FIELDS, values, strict=True)))).drop("_n", "_g", "_c")
