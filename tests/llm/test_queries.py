"""The contract queries as queries: names, types, whole tables, and SQL where there is some."""

import duckdb
import pytest

from quire.llm import quality, queries

TYPES = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_deleted": "bigint", "text_sha256": "string"},
    "op6_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_chat_format": {"conv_id": "bigint", "turn": "bigint", "kind": "string", "status": "string", "json": "string"},
    "op9_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract(name, spark, sf_dir):
    got = queries.queries()[name](spark, sf_dir)
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in TYPES[name]} == TYPES[name]
    ids = {r.doc_id for r in queries.documents(spark, sf_dir).select("doc_id").collect()}
    rows = got.collect()
    if "doc_id" in types:
        assert {r.doc_id for r in rows} == ids and (len(rows) == len(ids) or name == "op6_packing")
    if name == "op1_simhash":
        assert all(len(r.fingerprint) == 16 and set(r.fingerprint) <= set("0123456789abcdef") and r.component_id <= r.doc_id for r in rows)


AWKWARD = [(1, None, "en"), (2, "", "en"), (3, "a b c\nd e f g h i j k l\nz", "de"), (4, "x\na b c\nd e f g h i j k l", None), (5, "\n\n", "it"), (6, None, None), (7, "a b c\nd e f g h i j k l\nz", "en"), (7, "other text\na b c\nd e f g h i j k l", "en"), (7, "other text\na b c\nd e f g h i j k l", "en")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("awkward", [False, True])
def test_sql(name, awkward, spark, sf_dir, tmp_path, monkeypatch):
    """The same rows in a second engine, also over nulls, shared ids and repeated rows."""
    folder = sf_dir
    if awkward:
        folder = str(tmp_path)
        spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    path = f"{folder}/documents.parquet/*.parquet" if awkward else f"{folder}/documents.parquet"
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    wanted = connection.sql(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in connection.sql(queries.oracle_sql()[name]).description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in wanted), key=repr)
    assert quality.RULES
