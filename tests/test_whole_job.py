"""Cases that the given tables don't hold, against the SQL of the queries."""

import duckdb
import pandas as pd

from quillspark import catalog

from .compare import DATA, plain, rows


def held_to_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.to_parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    got = df.collect()
    found = con.execute(catalog.oracle_sql()[name])
    assert rows(df.columns, [tuple(map(plain, r)) for r in got]) == rows([d[0] for d in found.description], found.fetchall())
    return got


def test_short_passages_are_guarded(spark, tmp_path):
    long = "one two three four five six seven eight nine ten"
    texts = [long, "x" + long, "prefixone two threesuffix", "one", "two  three\nfour", "seven", "", " ", None, "one two three four five six sevenths", "phone twofold", long.replace(" ", "\n ")]
    items = [long, " ".join(long.split()[:8]), " ".join(long.split()[:7]), "one two three", "one two", "two  three", "one", "seve", "n", " ", "", None, "three\nfour five six", "absent", "absent absent absent", " one two three four "]
    got = held_to_sql(spark, tmp_path, "verbatim_guard", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), benchmark=pd.DataFrame({"item_id": range(len(items)), "text": items}))
    assert {r["item_id"] for r in got} == set(range(len(items))) - {11, 13, 14}


def test_short_passages_alone(spark, tmp_path):
    got = held_to_sql(spark, tmp_path, "verbatim_guard", documents=pd.DataFrame({"doc_id": [1, 2], "text": ["a b c d", "b"]}), benchmark=pd.DataFrame({"item_id": [1, 2], "text": ["a b", "c"]}))
    assert len(got) == 2


def test_duplicates_of_every_language_are_found(spark, tmp_path):
    rows_ = [(1, "Ein  Satz", "de", "a"), (2, "ein satz", None, "a"), (3, "EIN\nSATZ", "en", "a"), (4, "ein satz", "de", "b"), (5, "Éin", "fr", "a"), (6, "éin", "fr", "a"), (7, "x" * 120 + "y", "es", None), (8, "X" * 120 + "z", "es", None), (9, "", "de", "a"), (10, None, "de", "a"), (11, " ", None, "a")]
    got = held_to_sql(spark, tmp_path, "duplicate_citations_all", documents=pd.DataFrame(rows_, columns=["doc_id", "text", "lang", "source"]))
    assert {r["doc_id"] for r in got} == {1, 2, 3, 7, 8}


def test_duplicates_of_the_whole_table(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    texts = pd.read_parquet(f"{folder}/documents.parquet")
    ascii_ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = [" ".join((t or "").translate(ascii_).split())[:120] for t in texts.text]
    texts["n"] = texts.assign(key=key).groupby(["source", "key"], dropna=False).doc_id.transform("size")
    got = {r["doc_id"] for r in catalog.queries()["duplicate_citations_all"](spark, folder).collect()}
    assert got == set(texts[(texts.n > 1) & pd.Series([k != "" for k in key])].doc_id) and got - set(texts[texts.lang == "en"].doc_id)


def test_long_texts_are_covered_whole(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import advice

    gap = "." * (1 << 20)
    df = spark.createDataFrame([(f"a b {gap} left",), (f"a b {gap}",)], "t string")
    assert [r[0] for r in df.select(advice.covers(F.col("t"), F.array(F.lit("a"), F.lit("b")))).collect()] == [False, True]


def test_long_parts_of_an_entry_are_kept(spark):
    from quillspark.operators import fields

    name = "of " + "x" * 1500
    bars = " | ".join(f"p{i}" for i in range(1200))
    df = spark.createDataFrame([(1, f"2010 - 2014 Manager {name}"), (2, f"{bars} 2010 - 2014")], "i int, text string")
    got = {r["i"]: r for r in fields.employment(df).collect()}
    assert name in (got[1]["title"] or "") + " " + (got[1]["employer"] or "")
    assert got[2]["employer"].endswith("p1199")


def test_lines_are_read_once_however_often_they_are_asked_for(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import text as T
    from quillspark.operators import headings, lines, reconcile

    rows = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.col("id").cast("string").alias("line"), F.lit(False).alias("is_header_footer"))
    items = spark.createDataFrame([], "doc_id long, item_ord long, section string, fields map<string,string>, raw_text string")
    used = lambda df, sign: df._jdf.queryExecution().optimizedPlan().toString().count(sign)
    form = "[^\\w\\s,/-]"
    assert used(rows.where(T.junk(F.col("line"))), form) == 1
    assert used(lines.running_headers(rows), form) < 10
    assert used(reconcile.uncovered(headings.resolve(rows, approximate=False), items), form) < 10
    assert used(T.settled(rows, x=F.upper("line")).where("x <> 'A' and x <> 'B'"), "upper(") == 1


def test_a_contact_without_a_number_or_an_address_is_kept(spark):
    from quillspark.operators import letterhead

    lines_ = spark.createDataFrame([(1, 0, "Contact: 4th floor"), (1, 1, "of the house")], "doc_id int, line_no int, line string")
    got = letterhead.letterhead(lines_, lines_.selectExpr("doc_id", "line_no as ord", "line")).collect()
    assert [(r["section"], r["value"]) for r in got] == [("contact_info", "4th floor")]
