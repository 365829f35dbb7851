"""The whole pipeline on a small table with nulls, copies, ties and clashing columns, and on empty tables."""

import pandas as pd
import pytest

import corpus_pipeline
from rolloutframe.llm import queries, sp_sampling

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, `a.b` int"


def table(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(path))


@pytest.fixture(scope="module")
def base():
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    return d[d.text.str.len() < 6000].head(300)


def test_odd_rows_go_through(spark, tmp_path, base):
    rows = [(int(r.doc_id), r.text, r.lang, r.source, len(r.text), "x", 1) for r in base.itertuples()]
    good = max((r for r in rows if base.set_index("doc_id").quality[r[0]] == 1 and base.set_index("doc_id").toxic[r[0]] == 0), key=lambda r: len(r[1]))
    odd = [(900_001, None, "en", None, None, None, None), (900_002, "", None, "web", 0, "y", 2), (None, good[1], "en", "web", 1, "z", 3), (900_003, good[1], "en", "web", 1, "z", 3), (900_004, good[1] + " tail", "en", None, 1, "z", 3)]
    table(spark, rows + odd + [odd[3]], DOCUMENTS, tmp_path / "documents.parquet")
    labels = [(int(r.doc_id), int(r.quality), int(r.toxic)) for r in base.itertuples()] + [(900_001, 1, 0), (None, 0, 1), (900_003, None, None)]
    table(spark, labels, "doc_id long, quality int, toxic int", tmp_path / "labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "piece_ids"]
    texts = {}
    for r in rows + odd:
        texts.setdefault(r[0], set()).add(r[1])
    back = sp_sampling.decode(out, queries.tokenizer("piece_bpe_32k.model")).collect()
    assert back
    assert all(r.text in texts[r.doc_id] for r in back)
    kept = {r.doc_id for r in back}
    assert not kept & {900_001, 900_002, 900_003, 900_004}  # empty ones take no part, copies of the least id go
    assert max(pd.Series([r.doc_id for r in back]).value_counts()) <= 2


def test_empty_tables(spark, tmp_path):
    table(spark, [], DOCUMENTS, tmp_path / "documents.parquet")
    table(spark, [], "doc_id long, quality int, toxic int", tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
