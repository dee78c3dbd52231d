import ast
import inspect

import corpus_pipeline
from spanwise.llm import decontam, langid, secret_scan, simhash
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows
from tests.llm.test_decontam import plain as plain_decontam
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_groups, plain_near_fingerprint


def test_stages_against_brute_force(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "mix"]
    docs = table(spark, small, "documents")
    named = langid.learn(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"))
    data = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    said = named.predict([t for _, t, _ in data])
    data = sorted(d for d, (lang, _) in zip(data, said, strict=True) if lang != "und")
    groups = plain_groups([plain_near_fingerprint(t) for _, t, _ in data], simhash.NEAR_BUDGET)
    data = [data[g] for g in sorted(set(groups))]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    dirty = {r[0] for r in plain_decontam([d[:2] for d in data], items) if r[-1]}
    data = [(i, secret_scan.redacted(t), s) for i, t, s in data if i not in dirty]
    got = rows(corpus_pipeline.run(spark, small))
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in data)
    sizes = {i: len(t.encode().split()) for i, t, _ in data}
    totals = {}
    for i, _, s in data:
        totals[s] = totals.get(s, 0) + sizes[i]
    target = plain_targets(totals)
    source = {i: s for i, _, s in data}
    assert all(r["size"] == sizes[r["doc_id"]] and abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 for r in got)
    assert decontam.SPAN == 13


def test_every_stage_takes_edges_and_empty_tables(spark, small):
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "mix":
                assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name


def test_no_caught_imports():
    assert not any(isinstance(n, ast.Try) for n in ast.walk(ast.parse(inspect.getsource(corpus_pipeline))))
