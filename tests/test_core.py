"""Golden values and properties of the web-table operators."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import numeric, text
from tablewright.operators import algebra, align, retrieval, rewrite, synthesis, tables, templates, triples
from tablewright.operators.algebra import Expression, Select, Where
from tablewright.plans import queries
from tablewright.sources import html, pages


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_text(spark):
    assert column(spark, ["", "  ", " a\t b ", "x y", None], text.clean_text) == ["none", "none", "a b", "x y", "none"]
    assert column(spark, ["No. of (Games)", "A - B"], text.column_name) == ["no_of_games", "a__b"]
    assert column(spark, ["Jan 5 and Dec 6", "May 1", "Jan"], text.expand_months) == ["January 5 and December 6", "May 1", "Jan"]
    assert column(spark, ["East_India-3"], text.table_seed) == [1336831996]
    assert column(spark, [["a", "b"]], lambda c: text.linearize_row(c, F.array(F.lit("x"), F.lit(""))), "array<string>") == ["a is x."]
    assert column(spark, [[["a", "b"], ["1", "2"], ["3", "4"]], [["a"]]], text.linearize_grid, "array<array<string>>") == ["col: a | b | row 0: 1 | 2 | row 1: 3 | 4", "col: a"]
    assert column(spark, ["ﬁ²"], text.normal_form) == ["fi2"]
    assert column(spark, ["Dr. Who ran. Then he hid! Why?"], text.sentences) == [["Dr. Who ran.", "Then he hid!", "Why?"]]


NUMBERS = ["1,000.7", "1,000", "5,5556", "0.0.0.1", "0,0,0,1", "100,5", "none", "", "1d", "1_000", "-3.5", "+.5", "1.", " 12 ", "1e3"]


def test_to_float(spark):
    assert column(spark, NUMBERS, numeric.to_float) == [1000.7, 1000.0, 5.5556, 1.0, 1.0, 1005.0, None, None, None, 1000.0, -3.5, 0.5, 1.0, 12.0, 1000.0]
    assert column(spark, [0.125, 1.005, 2.675, 3.0, None], numeric.format_number, "double") == ["0.12", "1.00", "2.67", "3", None]
    assert column(spark, ["2", "2;", "x3y", "abc", None], numeric.span_int) == [2, 2, 3, 1, 1]
    assert column(spark, ["2", "2;", "x3y", None], numeric.strict_span_int) == [2, 2, 1, 1]


def rule_float(v):
    """The rules of ``to_float`` said again, in Python."""
    if "," in v and "." in v or len(v.split(",")) > 1 and any(len(p) == 3 for p in v.split(",")):
        v = v.replace(",", "")
    elif v.count(",") == 1:
        v = v.replace(",", ".")
    elif v.count(".") > 1:
        v = v.replace(".", "")
    else:
        v = v.replace(",", "")
    try:
        return float(v)
    except ValueError:
        return None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789.,-", max_size=9), min_size=30, max_size=60))
def test_to_float_by_rule(spark, values):
    assert column(spark, values, numeric.to_float) == [rule_float(v) for v in values]


ROWS = [(1, 0, "a", "3"), (1, 1, "b", "1"), (1, 2, "a", "1"), (2, 0, "a", "x"), (2, 1, "b", "2"), (3, 0, "z", "5")]


def answer(spark, e, rows=ROWS):
    df = spark.createDataFrame(rows, "table_id int, row_index int, k string, v string")
    return {r["table_id"]: r["answer"] for r in algebra.evaluate(df, e).collect()}


def test_algebra(spark):
    say = lambda kind, *w: answer(spark, Expression(Select(kind, "v"), w))
    assert say("COUNT") == {1: ["3"], 2: ["2"], 3: ["1"]}
    assert say("NONE") == {1: ["1", "3"], 2: ["2", "x"], 3: ["5"]}
    assert say("FIRST") == {1: ["3"], 2: ["x"], 3: None}
    assert say("LAST") == {1: ["1"], 2: ["2"], 3: None}
    assert say("SUM") == {1: ["5"], 2: None, 3: None}
    assert say("AVERAGE")[1] == ["1.67"]
    assert say("RANGE")[1] == ["2"] and say("LOWEST")[1] == ["1"] and say("GREATEST")[1] == ["3"]
    assert say("FIRST_DIFF")[1] == ["2"] and say("LAST_DIFF")[1] == ["0"]
    assert say("SUM", Where("k", "=", "a")) == {1: ["4"], 2: None, 3: None}
    assert say("FIRST_DIFF", Where("k", "=", "a"))[1] == ["2"]
    # a comparison of text voids the answer only where an earlier clause kept the row
    assert say("COUNT", Where("v", ">", "1")) == {1: ["1"], 2: None, 3: ["1"]}
    assert say("COUNT", Where("k", "=", "b"), Where("v", ">", "1")) == {1: None, 2: ["1"], 3: None}


def test_algebra_ties_and_empty(spark):
    rows = [(1, 0, "p", "1,0"), (1, 1, "q", "1.0"), (1, 2, "r", "1")]
    assert answer(spark, Expression(Select("LOWEST", "v")), rows) == {1: ["1,0"]}
    assert answer(spark, Expression(Select("GREATEST", "v")), rows) == {1: ["1,0"]}
    assert answer(spark, Expression(Select("SUM", "v")), []) == {}
    with pytest.raises(ValueError):
        Select("MEDIAN", "v")


GRID = [["Name", "Points"], ["a", "1"], ["b", "2"], ["b", "x"]]


def test_tables(spark):
    t = spark.createDataFrame([("t", GRID), ("u", GRID[:2]), ("v", [["A", "a"], ["1"], ["2"], ["3"]])], "table_id string, grid array<array<string>>")
    assert [r["table_id"] for r in tables.valid_tables(t).collect()] == ["t"]
    cells = tables.cells_of(t)
    kinds = {(r["table_id"], r["header"]): (r["column_type"], r["is_grouped"]) for r in tables.column_types(cells).collect()}
    assert kinds[("t", "Name")] == ("TEXT", True) and kinds[("t", "Points")] == ("TEXT", False) and kinds[("u", "Points")] == ("NUMBER", False)
    assert {r["rank"] for r in tables.ranked(cells).filter("table_id = 'v'").collect()} == {0, 1, 2}
    said = {r["table_id"]: r["said"] for r in tables.table_texts(cells).collect()}
    assert said["u"] == "name is a, points is 1."
    assert {r["table_id"]: r["grid"] for r in tables.grids(cells).collect()}["t"] == GRID


def test_short_rows_count_as_none(spark):
    grid = [["k", "v", "w", "x"], ["1", "2", "a", "none"], ["2", "3", "b"], ["3"]]
    cells = tables.cells_of(spark.createDataFrame([("t", grid)], "table_id string, grid array<array<string>>"))
    kinds = {r["header"]: (r["column_type"], r["is_grouped"]) for r in tables.column_types(cells).collect()}
    assert kinds == {"k": ("NUMBER", False), "v": ("TEXT", False), "w": ("TEXT", False), "x": ("TEXT", True)}
    assert {(r["header"], r["rank"]) for r in tables.ranked(cells).collect()} == {("k", 0), ("k", 1), ("k", 2), ("v", None), ("w", None), ("x", None)}
    at = lambda r, c: tables.cell_at(F.array(*(F.array(*map(F.lit, row)) for row in grid)), F.lit(r), F.lit(c))
    assert spark.range(1).select(at(3, 2).alias("a"), at(2, 1).alias("b"), at(0, 3).alias("c"), at(9, 0).alias("d")).first() == ("none", "3", "x", None)
    assert [r["v"] for r in tables.wide(cells, ["v"]).orderBy("row_index").collect()] == ["2", "3", "none"]


def test_templates(spark):
    t = templates.Template("SELECT [COLUMN_TEXT_0] FROM W WHERE ID > 1 AND [COLUMN_GROUPED_TEXT_1] = [TEXT] LIMIT [LIMIT_VALUE]")
    assert t.valid and [s.type for s in t.columns] == ["TEXT", "GROUPED_TEXT"] and "ROWID" in t.text
    assert not templates.Template("SELECT [NUMBER] FROM W").valid
    assert not templates.Template("SELECT [COLUMN_TEXT_0] FROM W WHERE x = [NUMBER]").valid
    assert templates.Template("SELECT x HAVING COUNT ( [COLUMN_TEXT_0] ) > [NUMBER]").slots[-1].literal == "2"
    cells = tables.cells_of(spark.createDataFrame([("t", GRID)], "table_id string, grid array<array<string>>"))
    made = templates.populate(cells, templates.Template("SELECT [COLUMN_TEXT_0] FROM W WHERE [COLUMN_TEXT_0] = [TEXT]")).collect()
    assert len(made) == 1 and re.fullmatch(r'SELECT (\w+) FROM W WHERE \1 = "\w"', made[0]["sql"])
    asked = synthesis.synthesize(cells).collect()
    assert len(asked) == 1 and asked[0]["question"].startswith("What is ")


def test_populate_executes(spark):
    grids = [("t", [["Name", "Points"], ["a", "1"], ["b", "2"], ["b", "30"]]), ("r", [["Name", "Points"], ["a", "1"], ["b"]]), ("order", [["Order", "Points"], ["a", "1"]])]
    cells = tables.cells_of(spark.createDataFrame(grids, "table_id string, grid array<array<string>>"))
    empty = ["SELECT [COLUMN_TEXT_0] FROM W GROUP BY [COLUMN_TEXT_0] HAVING COUNT ( [COLUMN_TEXT_0] ) > [NUMBER]", "SELECT COUNT ( * ) FROM W WHERE [COLUMN_NUMBER_0] > 99", "SELECT MAX ( [COLUMN_NUMBER_0] ) FROM W WHERE ID > 9", "SELECT FROM [COLUMN_TEXT_0]"]
    long = "SELECT " + " , ".join(["[COLUMN_TEXT_0]"] * 90) + " FROM W"
    good = ["SELECT [COLUMN_NUMBER_0] FROM W ORDER BY [COLUMN_NUMBER_0] DESC LIMIT [LIMIT_VALUE]", "SELECT [COLUMN_TEXT_0] FROM W WHERE ID = 2"]
    got = templates.populate_all(cells, [*empty, long, *good]).collect()
    assert {(r["table_id"], r["template"]): r["exec"] for r in got} == {("t", good[0]): "30", ("t", good[1]): "b"}


def test_synthesis_tries_all(spark):
    # "a" repeats only once among many other texts, so few conditions leave two rows
    tall = [["k", "v"], ["a", "7"], *([f"x{i}", str(i)] for i in range(40)), ["a", "9"]]
    flat = [["k", "v"], ["p", "4"], ["q", "4"], ["r", "4"]]
    grids = [(f"{name}{i}", g) for name, g in (("tall", tall), ("flat", flat)) for i in range(60)]
    cells = tables.cells_of(spark.createDataFrame(grids, "table_id string, grid array<array<string>>"))
    asked = {r["table_id"]: (r["question"], r["answer"]) for r in synthesis.synthesize(cells).collect()}
    assert len(asked) == len(grids)
    said = {q.removeprefix("What is ") for q, _ in asked.values()}
    firsts = {(q, a) for t, (q, a) in asked.items() if t.startswith("tall") and "difference of v for first" in q}
    assert firsts == {("What is the difference of v for first two", "7")}
    assert ("What is the difference of v for last two", "30") in asked.values()
    assert not any("difference" in q and " when " in q for q in said)
    for t, (q, _) in asked.items():
        if "difference" not in q and t.startswith("tall"):
            assert " when " in q  # some condition always leaves enough rows
    # no condition on k leaves two rows of v, some on v leave two of k
    assert {q for t, (q, _) in asked.items() if t.startswith("flat") and "total v" in q} == {"What is the total v"}
    assert all(q.endswith("when v is 4") for t, (q, _) in asked.items() if t.startswith("flat") and ("first k" in q or "last k" in q))
    assert [a for t, (q, a) in asked.items() if t.startswith("tall") and q == "What is the total v when k is a"] in ([], ["16"], ["16"] * 2, ["16"] * 3, ["16"] * 4, ["16"] * 5)


PAGE = """<html><title>T - Wikipedia</title><div id="bodyContent"><h2><span class="mw-headline">A</span></h2><h4><span class="mw-headline">skip</span></h4>
<h3><span class="mw-headline">B</span></h3><div><table class="wikitable sortable"><caption>C</caption><tr><th colspan="2">x</th><th>y</th></tr>
<tr><td rowspan="3;">1<sup class="reference">[1]</sup></td><td><span class="flagicon"><a title="Peru"></a></span></td><td><span data-sort-value="5!"></span></td></tr>
<tr><td><div>in <b>side</b></div><td style="display:none">no</td><td><span title="tip"></span></td></tr><tr><td>z</td></tr></table></div>
<p>One. <sup>9</sup>Two is here.\nThird<p>Next"""


def test_html(spark):
    (t,) = html.tables_of(PAGE)
    assert t["grid"] == [["x", "x", "y"], ["1", "Peru", "5"], ["1", "in side", "tip"], ["1", "z"]]
    assert t["section_titles"] == ["A", "B"] and t["table_caption"] == "C" and t["page_title"] == "T - Wikipedia"
    assert t["spans"][0][0] == {"text": "x", "rowspan": 1, "colspan": 2, "is_header": True} and t["spans"][1][0]["rowspan"] == 3
    assert html.expanded([]) == [] and html.tables_of("") == []
    p = spark.createDataFrame([("u", PAGE), ("n", None)], "url string, html string")
    assert html.extract_tables(p).count() == 1
    s = pages.page_sentences(p).orderBy("para_id", "split_id", "sent_id").collect()
    assert [r["sent"] for r in s] == ["One.", "Two is here.", "Third", "Next"] and s[0]["title"] == "T"
    assert pages.index_documents(pages.page_sentences(p)).filter("id = 'T-0-0-1'").first()["contents"] == "T. Two is here."


def test_page_titles_keep_quotes_and_pages_that_share_a_url(spark, tmp_path):
    made = spark.createDataFrame([(1, "u", "<title>A &amp; &quot;B&quot;</title>"), (2, "u", "<title>C</title>"), (3, None, "<TITLE x>D"), (4, "v", None)], "page_id long, url string, html string")
    made.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.page_title(spark, str(tmp_path)).collect())
    assert got == [(1, "A & &quot;B&quot;"), (2, "C"), (3, ""), (4, None)]


def test_tall_row_span():
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(1, 2500))
    (t,) = html.tables_of(f'<table class="wikitable"><tr><th>a</th><th>b</th></tr><tr><td rowspan="2500">x</td><td>0</td></tr>{rows}</table>')
    assert t["grid"] == [["a", "b"], *(["x", str(i)] for i in range(2500))]


def test_fetch(spark):
    seen = spark.createDataFrame([("ok",), ("gone",), ("busy",), ("odd",)], "url string")
    got = pages.fetched(seen, lambda u: {"ok": (200, "x"), "gone": (404, ""), "busy": (429, ""), "odd": (500, "")}[u], wait=0)
    kept, again = pages.routed(got)
    assert [r["url"] for r in kept.collect()] == ["ok"] and {r["url"] for r in again.collect()} == {"busy", "odd"}


def test_alignment(spark):
    cells = spark.createDataFrame([("p", "t", 0, 0, "New York"), ("p", "t", 0, 1, "8"), ("p", "t", 1, 0, "York Minster"), ("p", "t", 1, 1, "8")], "page string, table_id string, row_index int, column_index int, text string")
    sents = spark.createDataFrame([("p", 0, "In New York they won 8 of York.")], "page string, sent_id int, text string")
    got = {(r["row_index"], r["column_index"], r["match_type"]) for r in align.aligned(cells, sents).collect()}
    assert got == {(0, 0, "EXACT"), (0, 1, "EXACT"), (1, 1, "EXACT"), (1, 0, "PARTIAL")}
    spans = align.unique_alignments(cells, sents).filter("row_index = 0 AND column_index = 0").first()["mentions"]
    assert [(s["start"], s["end"]) for s in spans] == [(3, 11)]


def test_extracted_pairs(spark):
    body = [("Won", "2,041"), ("Team", "Reds"), ("Played", "27")]
    cells = spark.createDataFrame([("p", "t", 0, i, h, v) for i, (h, v) in enumerate(body)], "page string, table_id string, row_index int, column_index int, header string, text string")
    sents = spark.createDataFrame([("p", 0, "The Reds won 2,041 of them."), ("p", 1, "The Reds lost."), ("p", 2, "On 27 May the Reds came.")], "page string, sent_id int, text string")
    found = {r["sent_id"]: {(h["column_index"], h["match_type"], h["is_stat"]) for h in r["highlighted"]} for r in align.extracted_pairs(cells, sents).collect()}
    assert found == {0: {(0, "EXACT", True), (1, "EXACT", False)}, 2: {(1, "EXACT", False), (2, "EXACT", True)}}
    # a number before a month is a date in its sentence, and a number in its cell
    dates = lambda found: F.transform(found, lambda t, i: F.when(F.get(found, i + 1) == "May", F.lit("DATE")).when(t.rlike("^[0-9]+$"), F.lit("CARDINAL")).otherwise(F.lit("")))
    (r,) = align.extracted_pairs(cells, sents, dates).collect()
    assert r["sent_id"] == 0 and r["sentence"] == "The Reds won 2,041 of them."
    assert [[(a["start"], a["end"]) for a in h["alignments"]] for h in r["highlighted"]] == [[(3, 6)], [(1, 2)]]


def test_rewrite(spark):
    contexts = spark.createDataFrame([("c", "t", "a b c")], "context_id string, table_id string, text string")
    focus = spark.createDataFrame([("c", 0, i, [(2 * i, 2 * i + 1)]) for i in range(3)], "context_id string, row_index int, column_index int, mentions array<struct<start:int,end:int>>")
    cells = spark.createDataFrame([("t", r, c, "abc"[c] if r == 0 else f"{r}{c}") for r in range(3) for c in range(3)], "table_id string, row_index int, column_index int, text string")
    (r,) = rewrite.contrastive(contexts, focus, cells).collect()
    (x,) = r["replacements"]
    assert r["contrastive_text"][x["new_start"] : x["new_end"]] == x["replaced_text"] != x["original_text"]
    assert r["original_text"][: x["start"]] == r["contrastive_text"][: x["new_start"]] and r["original_text"][x["end"] :] == r["contrastive_text"][x["new_end"] :]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fox"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "red fox")], "query_id int, text string")
    assert [r["doc_id"] for r in retrieval.bm25(docs, asked).orderBy("place").collect()] == [1, 2]
    assert retrieval.partial_ratio("abcd", "xxabcdxx") == 100 and retrieval.partial_ratio("", "a") == 0 and retrieval.partial_ratio("abcd", "zzzz") == 0


def test_triples(spark):
    say = lambda s: [(t["head"], t["type"], t["tail"]) for t in column(spark, [s], triples.parsed_triples)[0]]
    assert say("<s><triplet> A b <subj> C <obj> r s <subj> D <obj> q</s>") == [("A b", "r s", "C"), ("A b", "q", "D")]
    assert say("<triplet> A <subj> C <obj> r <subj> D") == [("A", "r", "C"), ("A", "r", "D")]
    assert say("<triplet> A <subj> C") == [] and say("") == []


def test_exact_sum_of_large_numbers(spark):
    from pyspark.sql import functions as F

    from tablewright.functions import numeric

    rows = [(1, 1e20), (1, 1.0), (2, 0.1), (2, 0.2), (2, None), (3, None), (4, float("inf")), (4, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(numeric.exact_sum(F.col("x")).alias("s"))
    assert {r["k"]: r["s"] for r in df.collect()} == {1: 1e20, 2: 0.3, 3: None, 4: float("inf")}


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(i, i % 3, "OFP"[i % 3 - 1], 1000.25 * i, f"{i % 5}-LOW") for i in range(20)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["partial_align", "extract_pairs", "row_gate", "context_valid", "focus_groups", "date_clash_align", "candidate_sentences"])
def test_alignment_shuffles_cells_and_sentences_once(spark, orders, name):
    assert exchanges(queries.queries()[name](spark, orders)) <= 2


def test_contrastive_rewrite_shuffles_no_pairs(spark, orders):
    plan = queries.contrastive_rewrite(spark, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_row_index" in plan and exchanges(queries.contrastive_rewrite(spark, orders)) <= 9


def test_ranks_take_one_sort_of_cells(spark, orders):
    plan = queries.dense_rank_column(spark, orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2


@pytest.fixture
def odd_texts(spark, tmp_path):
    said = [None, "", "--", "a b fox", "a\nb, fox FOX", "½ x² a", "ΌΣΟΣ b", "c", "a b fox", "a_b a", "ⅷ c a‿b"]
    docs = [(None if i % 11 == 3 else i % 29, said[i * i % 11], "w") for i in range(80)] + [(100 + i, "a b fox", "w") for i in range(300)] + [(None, "rare", "w"), (50, "rare", "w"), (50, "rare two", "w")]
    asked = [(None, "a ½"), (1, "fox fox"), (1, "b"), (2, None), (3, "zzz"), (4, "όσοσ c x²"), (5, "a‿b ⅷ"), (6, "rare")]
    spark.createDataFrame(docs, "doc_id long, text string, words string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_bm25_equals_its_sql_on_odd_texts_and_repeated_ids(spark, odd_texts):
    import duckdb

    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS FROM '{odd_texts}/{name}.parquet/*.parquet'")
    want = sorted(duckdb.sql(queries.oracle_sql()["bm25_topk"]).fetchall(), key=str)
    assert len(want) > 10 and any(r[1] is None for r in want)
    assert sorted(map(tuple, queries.bm25_topk(spark, odd_texts).collect()), key=str) == want


def test_bm25_scores_in_blocks(monkeypatch):
    import pyarrow as pa

    known, n = ["a", "b"], 50
    model = {"known": known, "asked": [{"query_id": 1, "words": ["a"]}, {"query_id": 2, "words": ["b", "b"]}, {"query_id": 3, "words": []}], "counts": [{"term": t, "n": c} for t, c in ((-1, n), (-2, n), (-3, 3 * n), (0, n), (1, n))]}
    rows = pa.RecordBatch.from_pylist([{"doc_id": i, "len": 3, "terms": [0, 1], "tfs": [1 + (i == 40), 1 + i % 2], "model": model if i == 0 else None} for i in range(n)])
    got = []
    for cells in (1 << 20, 7, 1):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got.append(sorted((r["query_id"], r["doc_id"]) for b in retrieval.scores(3, 0.9, 0.4)(iter([rows.slice(0, 20), rows.slice(20)])) for r in b.to_pylist()))
    assert got == [[(1, 0), (1, 1), (1, 40), (2, 1), (2, 3), (2, 5)]] * 3


def test_bm25_shuffles_no_pairs_of_queries_and_documents(spark, odd_texts):
    plan = queries.bm25_topk(spark, odd_texts)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, doc_id|doc_id#\d+L?, query_id|term#\d+, doc_id)", plan)
    assert plan.count("hashpartitioning(doc_id") <= 2


def test_repeated_places_and_long_partial_matches(spark):
    cells = spark.createDataFrame([("p", "t", 0, 0, "a b a"), ("p", "t", 1, 0, "x the red fox y")], "page string, table_id string, row_index int, column_index int, text string")
    sents = spark.createDataFrame([("p", 0, "a b a b a, the red fox"), ("p", 1, None)], "page string, sent_id int, text string")
    assert sorted((r["start"], r["end"]) for r in align.exact_alignments(cells, sents).collect()) == [(0, 3), (2, 5)]
    t, c = F.col("t"), F.struct(F.col("c").alias("t"), text_between("c"), F.transform("c", align.may_stand_alone).alias("solo"))
    got = spark.createDataFrame([("the red fox , a".split(), "x the red fox y".split()), ("the , of".split(), "the x of , z".split()), ("a".split(), ["a"])], "t array<string>, c array<string>").select(align.longest(t, c).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in got] == [(0, 3), None, None]


def text_between(name):
    return align.between_blanks(F.col(name)).alias("inside")
