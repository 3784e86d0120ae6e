"""The jobs end to end on cases of our own, and their refusals."""

import json

from siloflow import jobs
from siloflow.plans.cases import DETECTED

SITES = ("BERLIN_NODE", "CHENNAI_NODE", "HYDERABAD_NODE")
TEXT, _, FOUND = DETECTED[0]


def case(i, labelled):
    note = f"{TEXT}\n{'Known heart failure. ' if i % 3 == 0 else ''}HR {70 + i} bpm."
    out = {"case_id": f"C{i}", "hospital_id": SITES[i % 3], "note_text": note, "structured_features": {"age_years": 40 + i, "sex": "male", "prior_admissions_12m": i % 4, "length_of_stay_days": i % 7, "emergency_admission": i % 2 == 0}}
    facts = {"diagnoses": ["heart_failure"] if i % 3 == 0 else [], "medications": [], "heart_rate_bpm": 70 + i}
    spans, at = [], 0
    for said, label in FOUND:
        at = note.index(said, at)
        spans.append({"start": at, "end": at + len(said), "label": label})
        at += len(said)
    if labelled:
        out["labels"] = {"pii_entities": spans, "extracted_clinical_data": facts, "readmission_30d": int(i % 4 > 1)}
    return out, spans, facts


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_a_run_and_its_report(spark, tmp_path, capsys):
    train = lines(tmp_path / "train.jsonl", [case(i, True)[0] for i in range(36)])
    made = [case(i, False) for i in range(40, 46)]
    inputs = [c for c, _, _ in made] + [{"case_id": "EDGE", "hospital_id": "NOWHERE", "note_text": "", "structured_features": {}}]
    given = lines(tmp_path / "in.jsonl", inputs)
    truth = [{"case_id": c["case_id"], "hospital_id": c["hospital_id"], "pii_entities": s, "deidentified_text": rendered(c["note_text"], s), "extracted_clinical_data": f, "readmission_30d": i % 2} for i, (c, s, f) in enumerate(made)]
    known = lines(tmp_path / "truth.jsonl", truth)
    out, artifacts = str(tmp_path / "out"), tmp_path / "artifacts"
    assert jobs.main(["run", "--train", train, "--input", given, "--output", out, "--artifacts-dir", str(artifacts), "--eval-labels", known, "--quick"], spark) == 0
    told = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {r["case_id"] for r in told} == {c["case_id"] for c in inputs} and all(0 <= r["readmission_probability"] <= 1 for r in told)
    report = json.loads((artifacts / "validation_report.json").read_text())
    assert report["deidentification"]["composite"] == 1.0 and report["extraction"]["fields"]["diagnoses"] == 1.0
    summary, privacy = json.loads((artifacts / "experiment_summary.json").read_text()), json.loads((artifacts / "privacy_summary.json").read_text())
    assert summary["aggregation"] == privacy["aggregation"] == "secure" and {r["regime"] for r in summary["cross_validation"]} == {"local", "federated", "centralized"}
    capsys.readouterr()
    assert jobs.main(["evaluate", "--input", given, "--truth", known, "--predictions", out, "--report", str(tmp_path / "r.json")], spark) == 0
    assert "composite: " in capsys.readouterr().out and json.loads((tmp_path / "r.json").read_text())["missing_predictions"] == 0
    assert jobs.main(["evaluate", "--input", str(tmp_path / "none.jsonl"), "--truth", known, "--predictions", out], spark) == 2
    assert jobs.main(["run", "--train", str(tmp_path / "none.jsonl"), "--input", given, "--output", out, "--artifacts-dir", str(artifacts)], spark) == 1


def rendered(note, spans):
    out, at = "", 0
    for s in spans:
        out, at = f"{out}{note[at : s['start']]}[{s['label']}]", s["end"]
    return out + note[at:]


def test_messages_are_cut():
    assert jobs.shortened(["a" * 300, *map(str, range(20))]) == ["a" * 200 + "...", *map(str, range(9)), "and 11 more"]
