"""Names in the bodies of pages."""

import __spark_entry__ as entry_points


def test_names_in_page_bodies_are_found(spark, tmp_path):
    tables = {
        "pages": ([(7, "http://h.net/x", "<p>See <b>Ods.Orders3</b> and raw.pay2</p>"), (8, None, None)],
                  "page_id long, url string, html string"),
        "documents": ([(1, "src.cust5 here")], "doc_id long, text string"),
        "conversations": ([(2, 0, "no name")], "conv_id long, turn int, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {tuple(r) for r in entry_points.queries()["q_text_refs_whole"](spark, str(tmp_path)).collect()}
    assert {r for r in found if r[0].startswith("html")} == {("html 7", 0, "ods.orders3"), ("html 7", 1, "raw.pay2")}
    assert {tuple(r) for r in entry_points.queries()["q_text_refs"](spark, str(tmp_path)).collect()} == {
        r for r in found if not r[0].startswith("html")}
