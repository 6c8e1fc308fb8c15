"""The stages keep the columns, decide as their operators do, and keep clean documents."""

from collections import Counter

import pytest

from folio.llm import queries

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    p = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        seen.append(docs)
    toxic, exact, near, mixed, packed = seen
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r.doc_id for r in toxic.collect()}
    clean = [i for i, t in y.items() if t == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    texts = [r.text for r in exact.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in toxic.collect()}
    ids = {r.doc_id for r in near.collect()}
    assert ids <= {r.doc_id for r in exact.collect()} and len(ids) > 0.5 * len(texts)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= ids and max(copies.values()) <= 2
    pieces = Counter((r.doc_id, r.piece) for r in packed.collect())
    assert {i: n for (i, k), n in pieces.items() if k == 0} == dict(copies)
