import duckdb
import pytest

from driftline.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    2: ["doc_id", "held_out", "score", "predicted"],
    3: ["page_id", "url", "text", "n_chars"],
    4: ["doc_id", "item_id", "similarity", "first_word", "n_words"],
    5: ["doc_id", "n_shingles", "component_id"],
    6: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    7: ["vec_id", "n_links", "component_id", "kept"],
    8: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    9: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    10: ["doc_id", "held_out", "score", "predicted"],
}


def strings(df):
    df = df.astype(object).where(df.notna(), None)
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract_columns_and_rows(spark, name):
    got = queries.queries()[name](spark, DATA)
    want = COLUMNS[int(name[2:].split("_")[0])]
    assert [c for c in got.columns if c in want] == want
    table, key = {"page_id": ("pages", "page_id"), "vec_id": ("embeddings", "vec_id")}.get(got.columns[0], ("documents", "doc_id"))
    if not name.startswith("op4"):
        ids = [r[0] for r in got.select(key).collect()]
        assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert strings(queries.queries()[name](spark, DATA).toPandas()) == strings(con.sql(queries.oracle_sql()[name]).df())
