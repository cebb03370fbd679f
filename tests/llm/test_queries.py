"""Every registered query, beside its SQL where there is one."""

import pytest
from compare import connect, differences

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()

COLUMNS = {
    "op1": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2": ["doc_id", "n_tokens", "log_score", "n_backoffs", "mean_log_score"],
    "op3": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4": ["page_id", "url", "text", "n_chars"],
    "op5": ["doc_id", "n_pretokens", "n_tokens", "log_prob"],
    "op6": ["doc_id", "n_shingles", "component_id"],
    "op7": ["doc_id", "size", "source_size", "target", "taken"],
    "op8": ["query_id", "rank", "vec_id", "score"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op13": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF)
    wanted = COLUMNS[name.split("_")[0]]
    assert found.columns[: len(wanted)] == wanted
    if name in SQL:
        assert differences(found, SQL[name], con) == []
    else:
        assert found.count() == spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'documents'}.parquet").count()
