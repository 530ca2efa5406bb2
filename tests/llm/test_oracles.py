"""Registered queries: those with SQL equal it, the others have their columns."""

import pytest

from pagewright.llm import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "expected_grade": "double", "tail_over_0": "double", "tail_over_1": "double", "selected": "boolean"},
    "op9_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "start": "int", "end": "int", "edits": "int"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double", "perplexity": "double"},
    "op13_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
}


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_equals_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], connect(SF))


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    result = registry.queries()[name](spark, SF)
    assert dict(result.dtypes) == COLUMNS[name]
    if name not in ("op3_neighbours", "op9_decontaminate", "op13_whitening"):
        assert result.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op1_secrets", "op7_chat"])
def test_native_plans_hold_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
