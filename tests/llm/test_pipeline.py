"""The SQL of the corpus queries, and the pipeline stage by stage against plain versions."""

import sys
from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare  # noqa: E402

from siloflow.llm import queries  # noqa: E402
from siloflow.llm.oracle import ORACLE  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", queries.QUERIES[name], ORACLE[name])


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        ids = {r["doc_id"] for r in after}
        texts = {r["doc_id"]: r["text"] for r in before}
        if name == "language_id":
            model = brute.language_model([(r["text"], r["lang"]) for r in before if None not in (r["text"], r["lang"])])
            found = {i: brute.language(t, model) for i, t in texts.items()}
            assert ids == {i for i, (lang, p) in found.items() if lang != "und" and p >= 0.5}
        elif name == "near_duplicates":
            comp = brute.components(texts.items(), 5, 100, 80)
            assert ids == {i for i, c in comp.items() if i == c} and len(after) == len(ids)
        elif name == "decontamination":
            assert ids == set(texts) - {i for i, _ in brute.contained(texts.items(), items)}
        elif name == "mixing":
            size, source = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}, {r["doc_id"]: r["source"] for r in before}
            per, got, most = Counter(), Counter(), Counter()
            for i, n in size.items():
                per[source[i]] += n
                most[source[i]] = max(most[source[i]], n)
            for r in after:
                got[r["source"]] += size[r["doc_id"]]
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
            assert all(abs(got[s] - t) <= 0.02 * t + most[s] for s, t in brute.water_fill(per).items())
        else:
            same = lambda rows: sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows), key=repr)
            assert same(before) == same(after) and all(r["_shard"] for r in after)
        docs = out


def test_run_keeps_documents_whole(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(r["text"] == texts[r["doc_id"]] for r in got) and max(Counter(r["doc_id"] for r in got).values()) <= 2
