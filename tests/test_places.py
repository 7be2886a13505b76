"""Tables of several files: places run on from file to file, in order of their names."""

import duckdb
import pytest

from lodestrata import catalog
from tests.oracle import difference


@pytest.mark.parametrize("name", ["physical_locators", "row_locators"])
def test_places_in_a_table_of_several_files(spark, tmp_path, name):
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    rows = "SELECT doc_id, 'x' AS text FROM (SELECT unnest(range({0}, {1})) AS doc_id) ORDER BY doc_id DESC"
    for file, low, high in (("part-b", 0, 70), ("part-a c+d", 70, 75), ("part-a%", 75, 80), ("part-c", 80, 200)):
        duckdb.sql(rows.format(low, high)).write_parquet(f"{folder}/{file}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    assert difference(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name]) == ""
