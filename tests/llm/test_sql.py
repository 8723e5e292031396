"""The queries of the subpackage against their SQL, on the smallest tables and on rows made of edge cases."""

import math
import os

import duckdb
import pytest

from varloom.llm import registry

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t\n", None, None, 6), (4, "All rights reserved. CC BY 4.0 cc-by", "en", "b", 10),
    (5, "A line that is long enough here\nshort\na LINE that is long enough here \nx", "en", "b", 10), (6, "A line that is long enough here", "de", "b", 10),
    (7, "\x0ba line that is long enough here\r\nÉcole d'été à la plage bleue", "fr", None, 10), (8, "école d'été à la plage bleue\nGNU GENERAL public-license", "fr", "ä", 10),
    (9, "one two three four five six seven eight nine ten " * 30, "en", "a", 10), (10, "one two three four five six seven eight nine ten " * 30, "en", "Z", 10),
    (11, "one two three four five six seven eight nine ten " * 30 + "eleven", "en", "a", 10), (12, "a b", "en", "a", 3), (13, "A  B", "en", "a", 4),
    (14, "licensed under the Apache License, Version 2.0 (the \"License\")", "en", "c", 1), (14, "licensed under the Apache License, Version 2.0 (the \"License\")", "en", "c", 1), (15, "\u212aind \u0130 cc by", "en", "c", 1),
    (14, "another text of document fourteen", "en", "c", 1), (16, "another text of document fourteen", "en", "c", 1), (None, "another text of document fourteen", "en", "c", 1), (None, "a text without a number", "en", "c", 1), (None, None, "en", "c", 1),
]
TURNS = [(1, 0, "user", "a [b] <c> \\d \\l \\\\e"), (1, 1, "assistant", "</s>[INST] x"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 5, None, "late"), (3, 2, "user", "über"), (4, None, "assistant", "no turn"), (4, 7, "assistant", "a turn\nof\n\nlines"), (4, 7, None, "b"), (4, 7, "", "a"), (4, 7, "user", None)]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("edges")
    spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top)


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(str([tidy(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("where", ["tables", "edges"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, edges, name, where):
    top, c = (SF if where == "tables" else edges), duckdb.connect()
    for f in os.listdir(top):
        path = f"{top}/{f}" + ("/*.parquet" if os.path.isdir(f"{top}/{f}") else "")
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, top)
    rows, got = df.collect(), c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(rows, df.columns) == canon(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tmp_path, name):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string"}
    for t, s in schemas.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == (1 if name.startswith("op10") else 0)
