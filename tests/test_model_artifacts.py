"""a27_model_artifacts against its SQL, on documents that have no tokens, no id, or not all languages."""

import duckdb
import pytest

from docloom import queries

SOME = {"en": "the red fox is here", "fr": "le renard rouge est ici", "de": "der rote Fuchs ist hier", "es": "el zorro rojo vive lejos"}
ROWS = [(i, f"{SOME[lang]} {i}", lang) for i, lang in enumerate([*SOME] * 3)]


@pytest.mark.parametrize(
    "rows",
    [
        [*ROWS, (20, "", "en"), (21, None, "fr"), (22, " \n\t ", "it"), (23, "la volpe rossa", "it"), (24, "and more", None), (None, "no id", "en"), (None, None, "de"), (0, "the same id", "en")],
        [r for r in ROWS if r[2] != "es"],
        [r for r in ROWS if r[2] == "en"],
    ],
    ids=["odd", "three languages", "one language"],
)
def test_all_documents_count(spark, tmp_path, rows):
    table = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.queries()["a27_model_artifacts"](spark, str(tmp_path))
    want = con.sql(queries.oracle_sql()["a27_model_artifacts"]).fetchall()
    assert sorted(map(tuple, got.select("lang", "documents", "same").collect()), key=str) == sorted(want, key=str)
