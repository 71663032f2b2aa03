"""One query for each operator family, over the driver's tables, each with
DuckDB SQL where SQL can say it.

Relations serve as collections of web tables: an order's line items, a
customer's orders, a region's nations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import algebra, align, retrieval, rewrite, synthesis, tables, templates, triples
from ..operators.algebra import Expression, Select, Where
from ..sources import html, pages

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "agg_sum_where_eq"
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_text(c: str) -> Column:
    """A price as a cell's text with two decimals."""
    return F.col(c).cast("decimal(18,2)").cast("string")


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a web table of its line items."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("row_index"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"), number_text("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


ITEMS = """
items AS (SELECT l_orderkey AS table_id, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS row_index,
  CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS f, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,10)) AS d,
  CAST(l_quantity AS INT) AS q, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""


def said(x: str) -> str:
    """SQL: a number as ``format_number`` writes it."""
    return f"CASE WHEN {x} = floor({x}) THEN format('{{:.0f}}', {x}) ELSE format('{{:.2f}}', {x}) END"


def answers(df: DataFrame) -> DataFrame:
    return df.select("table_id", F.array_join("answer", " | ").alias("answer"))


def register_aggregations() -> None:
    """One query for each aggregation, without and with a condition."""
    value = {
        "SUM": said("CAST(sum(d) AS DOUBLE)"), "AVERAGE": said("CAST(sum(d) AS DOUBLE) / count(*)"), "RANGE": said("max(f) - min(f)"),
        "FIRST": "arg_min(price, row_index)", "LAST": "arg_max(price, row_index)",
        "LOWEST": "(list(price ORDER BY f, row_index))[1]", "GREATEST": "(list(price ORDER BY f DESC, row_index))[1]",
        "FIRST_DIFF": said("abs((list(f ORDER BY row_index))[1] - (list(f ORDER BY row_index))[2])"),
        "LAST_DIFF": said("abs((list(f ORDER BY row_index DESC))[1] - (list(f ORDER BY row_index DESC))[2])"),
    }
    for kind in algebra.AGGREGATIONS:
        for where, test in (((), "true"), ((Where("flag", "=", "R"),), "flag = 'R'")):
            if kind == "COUNT":
                answer = "CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN CAST(count(*) FILTER (WHERE ok) AS VARCHAR) END"
            elif kind == "NONE":
                answer = "array_to_string(list_sort(list(DISTINCT price) FILTER (WHERE ok)), ' | ')"
            else:
                answer = f"CASE WHEN count(*) >= 2 THEN {value[kind]} END"
            column = None if kind == "COUNT" else "price"
            if kind in ("COUNT", "NONE"):
                sql = f"WITH {ITEMS} SELECT table_id, {answer} AS answer FROM (SELECT *, {test} AS ok FROM items) GROUP BY table_id"
            else:
                sql = f"WITH {ITEMS}, a AS (SELECT table_id, {answer} AS answer FROM items WHERE {test} GROUP BY table_id) SELECT t.table_id, a.answer FROM (SELECT DISTINCT table_id FROM items) t LEFT JOIN a USING (table_id)"

            def run(spark: SparkSession, sf_dir: str, kind: str = kind, where: tuple[Where, ...] = where, column: str | None = column) -> DataFrame:
                return answers(algebra.evaluate(item_rows(spark, sf_dir), Expression(Select(kind, column), where)))

            run.__name__ = f"agg_{kind.lower()}" + "_where_eq" * bool(where)
            query(sql)(run)


register_aggregations()


def comparison(comparator: str) -> tuple[str, Query]:
    sql = f"WITH {ITEMS} SELECT table_id, CASE WHEN count(*) FILTER (WHERE q {comparator} 25) > 0 THEN CAST(count(*) FILTER (WHERE q {comparator} 25) AS VARCHAR) END AS answer FROM items GROUP BY table_id"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return answers(algebra.evaluate(item_rows(spark, sf_dir), Expression(Select("COUNT"), (Where("quantity", comparator, "25"),))))

    return sql, run


for _name, _c in (("where_greater", ">"), ("where_lesser", "<")):
    _sql, _run = comparison(_c)
    _run.__name__ = _name
    query(_sql)(_run)


@query(f"WITH {ITEMS} SELECT table_id, CASE WHEN bool_or(status = 'O' AND flag NOT SIMILAR TO '[0-9]+') THEN NULL ELSE NULL END AS answer, bool_or(status = 'O') AS failed FROM items GROUP BY table_id")
def where_strict_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of letters voids an answer, but only where an earlier
    clause left a row to compare."""
    e = Expression(Select("COUNT"), (Where("status", "=", "O"), Where("flag", ">", "5")))
    rows = item_rows(spark, sf_dir)
    return answers(algebra.evaluate(rows, e)).join(algebra.strict_failures(rows, e), "table_id")


@query(f"WITH {ITEMS} SELECT table_id, CASE WHEN bool_or(status = 'O' AND flag = 'R') THEN NULL WHEN count(*) FILTER (WHERE status = 'O' AND q > 5) > 0 THEN CAST(count(*) FILTER (WHERE status = 'O' AND q > 5) AS VARCHAR) END AS answer, bool_or(status = 'O' AND flag = 'R') AS failed FROM items GROUP BY table_id")
def where_strict_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of numbers and letters: only tables whose compared rows hold a
    letter lose their answer."""
    e = Expression(Select("COUNT"), (Where("status", "=", "O"), Where("mixed", ">", "5")))
    rows = item_rows(spark, sf_dir).withColumn("mixed", F.when(F.col("flag") == "R", F.col("flag")).otherwise(F.col("quantity")))
    return answers(algebra.evaluate(rows, e)).join(algebra.strict_failures(rows, e), "table_id")


@query(f"WITH {ITEMS} SELECT table_id, CASE WHEN count(*) FILTER (WHERE q > 10 AND flag = 'N') > 0 THEN CAST(count(*) FILTER (WHERE q > 10 AND flag = 'N') AS VARCHAR) END AS answer FROM items GROUP BY table_id")
def where_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Expression(Select("COUNT"), (Where("quantity", ">", "10"), Where("flag", "=", "N")))
    return answers(algebra.evaluate(item_rows(spark, sf_dir), e))


@query("SELECT * FROM (VALUES ('the total price when flag is R and quantity is less than 5', 'What is the total price when flag is R and quantity is less than 5'), ('the count', 'What is the count'), ('the difference of price for first two', 'What is the difference of price for first two'), ('price', 'What is price')) t(said, question)")
def verbalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = [Expression(Select("SUM", "price"), (Where("flag", "=", "R"), Where("quantity", "<", "5"))), Expression(Select("COUNT")), Expression(Select("FIRST_DIFF", "price")), Expression(Select("NONE", "price"))]
    return spark.createDataFrame([(e.said(), e.question()) for e in es], "said string, question string")


# --- text and numbers -----------------------------------------------------


@query(r"SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'none' ELSE regexp_replace(trim(concat('  ', p_name, chr(9), chr(10), ' ', p_brand, '  ')), '\s+', ' ', 'g') END AS cleaned FROM part")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("\t\n "), "p_brand", F.lit("  "))
    return read(spark, sf_dir, "part").select("p_partkey", text.clean_text(raw).alias("cleaned"))


@query(r"""SELECT p_partkey, lower(array_to_string(list_transform(string_split(concat(p_name, ' (', p_brand, ') & ', p_type), ' '), lambda w: translate(w, '.+-?!*@%^&#=/\:"''()', '')), '_')) AS name FROM part""")
def column_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.column_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") & "), "p_type")).alias("name"))


@query("SELECT o_orderkey, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(strftime(o_orderdate, '%b %d, %Y'), 'Jan ', 'January '), 'Feb ', 'February '), 'Mar ', 'March '), 'Apr ', 'April '), 'Jun ', 'June '), 'Jul ', 'July '), 'Aug ', 'August '), 'Sep ', 'September '), 'Oct ', 'October '), 'Nov ', 'November '), 'Dec ', 'December ') AS spelt FROM orders")
def month_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", text.expand_months(F.date_format("o_orderdate", "MMM dd, yyyy")).alias("spelt"))


NUMBER_FORMS = """
SELECT o_orderkey, n, v FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS s FROM orders),
LATERAL (VALUES (0, s), (1, s || '.25'), (2, '1,' || lpad(right(s, 3), 3, '0')), (3, '1,' || lpad(right(s, 3), 3, '0') || '.5'), (4, right(s, 2) || ',5'), (5, '0.0.' || s), (6, right(s, 1) || ',0,1'), (7, 'none'), (8, s || 'd'), (9, '')) x(n, v)"""


@query(f"""WITH x AS ({NUMBER_FORMS})
SELECT o_orderkey, n, v AS form, TRY_CAST(CASE
  WHEN contains(v, ',') AND contains(v, '.') THEN replace(v, ',', '')
  WHEN contains(v, ',') AND len(list_filter(string_split(v, ','), lambda p: length(p) = 3)) > 0 THEN replace(v, ',', '')
  WHEN length(v) - length(replace(v, ',', '')) = 1 THEN replace(v, ',', '.')
  WHEN length(v) - length(replace(v, '.', '')) > 1 THEN replace(v, '.', '')
  ELSE replace(v, ',', '') END AS DOUBLE) AS number FROM x""")
def convert_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor("o_totalprice").cast("bigint").cast("string")
    tail = F.lpad(F.right(s, F.lit(3)), 3, "0")
    forms = [s, F.concat(s, F.lit(".25")), F.concat(F.lit("1,"), tail), F.concat(F.lit("1,"), tail, F.lit(".5")), F.concat(F.right(s, F.lit(2)), F.lit(",5")), F.concat(F.lit("0.0."), s), F.concat(F.right(s, F.lit(1)), F.lit(",0,1")), F.lit("none"), F.concat(s, F.lit("d")), F.lit("")]
    each = read(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*forms)).alias("n", "form"))
    return each.select("o_orderkey", "n", "form", numeric.to_float(F.col("form")).alias("number"))


@query(f"SELECT c_custkey, {said('c_acctbal / 8')} AS said FROM customer")
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", numeric.format_number(F.col("c_acctbal") / 8).alias("said"))


@query("SELECT c_custkey, (" + " + ".join(f"CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS BIGINT)" for i in range(8)) + ") % 4294967295 AS seed FROM (SELECT c_custkey, sha256('''' || c_name || '''') AS h FROM customer)")
def sha_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", text.table_seed(F.col("c_name")).alias("seed"))


@query("SELECT event_id, v AS span, coalesce(TRY_CAST(v AS INT), TRY_CAST(regexp_extract(v, '[0-9]+') AS INT), 1) AS lenient, coalesce(TRY_CAST(trim(v, ';') AS INT), 1) AS strict FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 9 AS VARCHAR) WHEN 1 THEN concat(event_id % 9, ';') WHEN 2 THEN concat('w', event_id % 9, 'px') ELSE 'abc' END AS v FROM events)")
def span_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 9).cast("string")
    v = F.when(F.col("event_id") % 4 == 0, n).when(F.col("event_id") % 4 == 1, F.concat(n, F.lit(";"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("w"), n, F.lit("px"))).otherwise("abc")
    return read(spark, sf_dir, "events").select("event_id", v.alias("span")).select("event_id", "span", numeric.span_int(F.col("span")).alias("lenient"), numeric.strict_span_int(F.col("span")).alias("strict"))


@query(r"""SELECT o_orderkey, v AS form, (v SIMILAR TO '[0-9,.:]+' AND v SIMILAR TO '.*[,.:].*') OR contains(v, '°C') OR (length(v) NOT IN (1, 4) AND v SIMILAR TO '[0-9]+') AS is_stat
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN CAST(1900 + o_orderkey % 100 AS VARCHAR) WHEN 2 THEN concat(o_orderkey % 40, ' °C') WHEN 3 THEN o_orderpriority ELSE CAST(10000 + o_orderkey % 90000 AS VARCHAR) END AS v FROM orders)""")
def statistic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 5 == 0, number_text("o_totalprice")).when(k % 5 == 1, (1900 + k % 100).cast("string")).when(k % 5 == 2, F.concat((k % 40).cast("string"), F.lit(" °C"))).when(k % 5 == 3, F.col("o_orderpriority")).otherwise((10000 + k % 90000).cast("string"))
    cells = read(spark, sf_dir, "orders").select("o_orderkey", v.alias("text"), F.lit("value").alias("header"))
    return align.annotated(cells).select("o_orderkey", F.col("text").alias("form"), "is_stat")


@query(r"SELECT item_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_À-ÿ]+|[^A-Za-z0-9_À-ÿ\s]')) AS INT) AS n_tokens FROM benchmark")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(text.tokens_with_offsets(F.col("text"))).alias("n_tokens"))


@query("SELECT item_id, text FROM benchmark")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round trip: the text rebuilt from tokens at their offsets."""
    t = text.tokens_with_offsets(F.col("text"))
    b = read(spark, sf_dir, "benchmark").select("item_id", "text", t.alias("t"))
    again = F.expr("aggregate(t, named_struct('at', 0, 'o', cast(array() as array<string>)), (a, x) -> named_struct('at', x.end, 'o', concat(a.o, array(substring(text, a.at + 1, x.start - a.at), x.text))), a -> concat(array_join(a.o, ''), substring(text, a.at + 1)))")
    return b.select("item_id", again.alias("text"))


# --- tables ----------------------------------------------------------------


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a web table's cells."""
    o = read(spark, sf_dir, "orders").withColumns({"price": number_text("o_totalprice"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "number": F.col("o_orderkey").cast("string")})
    return tables.melt(o, F.col("o_custkey"), F.col("o_orderkey"), ["number", "price", "status", "priority"])


ORDERS = """
o AS (SELECT CAST(o_custkey AS VARCHAR) AS table_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_index,
  CAST(o_orderkey AS VARCHAR) AS number, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
cells AS (SELECT table_id, row_index, 0 AS column_index, 'number' AS header, number AS text FROM o UNION ALL SELECT table_id, row_index, 1, 'price', price FROM o
  UNION ALL SELECT table_id, row_index, 2, 'status', status FROM o UNION ALL SELECT table_id, row_index, 3, 'priority', priority FROM o)"""


@query(f"WITH {ORDERS} SELECT * FROM cells")
def melt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir)


@query(f"WITH {ORDERS} SELECT table_id, row_index, column_index, CASE WHEN column_index < 2 THEN CAST(dense_rank() OVER (PARTITION BY table_id, column_index ORDER BY TRY_CAST(text AS DOUBLE)) - 1 AS INT) END AS rank FROM cells")
def dense_rank_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ranked(order_cells(spark, sf_dir)).select("table_id", "row_index", "column_index", "rank")


@query(f"WITH {ORDERS} SELECT table_id, column_index, header, CASE WHEN column_index < 2 THEN 'NUMBER' ELSE 'TEXT' END AS column_type, column_index >= 2 AND count(DISTINCT text) < count(*) AS is_grouped FROM cells GROUP BY table_id, column_index, header")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_types(order_cells(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT table_id FROM o GROUP BY table_id HAVING count(*) + 1 BETWEEN 4 AND 30")
def valid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.valid_tables(tables.grids(order_cells(spark, sf_dir)), vocabulary=["price", "status"]).select("table_id")


@query(f"WITH {ORDERS} SELECT table_id, 'col: number | price | status | priority | ' || string_agg(concat('row ', row_index, ': ', number, ' | ', price, ' | ', status, ' | ', priority), ' | ' ORDER BY row_index) AS said FROM o GROUP BY table_id")
def linearize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grids(order_cells(spark, sf_dir)).select("table_id", text.linearize_grid(F.col("grid")).alias("said"))


@query(f"WITH {ORDERS} SELECT table_id, string_agg(concat('number is ', number, ', price is ', price, ', status is ', status, ', priority is ', priority, '.'), ' ' ORDER BY row_index) AS said FROM o GROUP BY table_id")
def linearize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_texts(order_cells(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT table_id, 'status' AS head, max(price) FILTER (WHERE row_index = 0) AS first_price, coalesce(max(price) FILTER (WHERE row_index = 7), NULL) AS eighth FROM o GROUP BY table_id")
def cell_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grids(order_cells(spark, sf_dir))
    at = lambda r, c: tables.cell_at(F.col("grid"), F.lit(r), F.lit(c))
    return g.select("table_id", at(0, 2).alias("head"), at(1, 1).alias("first_price"), at(8, 1).alias("eighth"))


@query("SELECT event_id, user_id || '-' || event_id % 7 AS iid FROM events")
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://x/?curid="), F.col("user_id").cast("string")).alias("page_url"), (F.col("event_id") % 7).cast("int").alias("page_table_index"))
    return e.select("event_id", tables.table_id(e).alias("iid"))


@query(f"WITH {ORDERS} SELECT table_id, row_index, price, status FROM o")
def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.wide(order_cells(spark, sf_dir), ["price", "status"])


#: Every third row of a table ends after its first cell; a cell it lacks counts
#: as ``none``.
SHORT = f"{ORDERS}, p AS (SELECT table_id, row_index, column_index, header, column_index > 0 AND row_index % 3 = 2 AS lacks, CASE WHEN column_index > 0 AND row_index % 3 = 2 THEN 'none' ELSE text END AS text FROM cells)"


def short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir).filter("column_index = 0 OR row_index % 3 <> 2")


@query(f"WITH {SHORT}, r AS (SELECT *, CASE WHEN column_index < 2 AND NOT bool_or(lacks) OVER (PARTITION BY table_id, column_index) THEN CAST(dense_rank() OVER (PARTITION BY table_id, column_index ORDER BY TRY_CAST(text AS DOUBLE)) - 1 AS INT) END AS rank FROM p) SELECT table_id, row_index, column_index, rank FROM r WHERE NOT lacks")
def ragged_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ranked(short_rows(spark, sf_dir)).select("table_id", "row_index", "column_index", "rank")


@query(f"WITH {SHORT}, t AS (SELECT table_id, column_index, header, CASE WHEN column_index < 2 AND NOT bool_or(lacks) THEN 'NUMBER' ELSE 'TEXT' END AS column_type, count(DISTINCT text) < count(*) AS repeats FROM p GROUP BY table_id, column_index, header) SELECT table_id, column_index, header, column_type, column_type = 'TEXT' AND repeats AS is_grouped FROM t")
def ragged_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_types(short_rows(spark, sf_dir))


@query(f"WITH {SHORT} SELECT table_id, row_index, max(text) FILTER (WHERE header = 'price') AS price, max(text) FILTER (WHERE header = 'status') AS status FROM p GROUP BY table_id, row_index")
def ragged_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.wide(short_rows(spark, sf_dir), ["price", "status"])


# --- SQL templates and synthesis -------------------------------------------


@query(f"WITH {ITEMS} SELECT table_id, arg_min(f, row_index) FILTER (WHERE flag = 'N') - arg_min(f, row_index) FILTER (WHERE flag = 'R') AS value FROM items GROUP BY table_id")
def sql_scalar_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.scalar_difference(item_rows(spark, sf_dir), "price", "flag", F.lit("N"), F.lit("R"))


@query(f"WITH {ITEMS} SELECT table_id, (list(flag ORDER BY f DESC, row_index))[1] AS value FROM items GROUP BY table_id")
def sql_order_limit1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.ordered_first(item_rows(spark, sf_dir), "flag", "price", descending=True)


@query(f"WITH {ITEMS}, g AS (SELECT table_id, flag FROM items GROUP BY ALL HAVING count(*) > 2) SELECT table_id, string_agg(flag, ' | ' ORDER BY flag) AS answer FROM g GROUP BY table_id")
def sql_group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.having_count(item_rows(spark, sf_dir), "flag")


@query(f"WITH {ORDERS} SELECT table_id, string_agg(price, ' | ' ORDER BY row_index) AS answer FROM (SELECT *, first_value(priority) OVER (PARTITION BY table_id ORDER BY row_index) AS v FROM o) WHERE priority = v GROUP BY table_id")
def sql_select_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SELECT price FROM W WHERE priority = v``, v each table's first
    priority."""
    cells = order_cells(spark, sf_dir)
    picks = cells.filter("column_index = 3 AND row_index = 0").select("table_id", F.lit(1).alias("c0"), F.lit(3).alias("c1"), F.col("text").alias("v1"))
    return templates.select_where(cells, picks, "c0", "c1")


@query()
def sql_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded picks: rows only."""
    return templates.populate_all(order_cells(spark, sf_dir), ["SELECT [COLUMN_TEXT_0] FROM W WHERE [COLUMN_TEXT_0] = [TEXT]", "SELECT [COLUMN_NUMBER_0] FROM W WHERE [COLUMN_GROUPED_TEXT_1] = [TEXT] LIMIT [LIMIT_VALUE]", "SELECT [COLUMN_TEXT_0] FROM W GROUP BY [COLUMN_TEXT_0] HAVING COUNT ( [COLUMN_TEXT_0] ) > [NUMBER]"])


@query("SELECT n_nationkey, CASE WHEN trim(s) <> '' AND s NOT IN ('0', 'None') AND len(string_split(s, ' ')) <= 200 THEN s END AS answer FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' | ' || n_name WHEN 1 THEN '0' WHEN 2 THEN 'None' ELSE repeat(n_name || ' ', 250) END AS s FROM nation)")
def answer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    items = F.when(k == 0, F.array("n_name", "n_name")).when(k == 1, F.array(F.lit("0"))).when(k == 2, F.array(F.lit("None"))).otherwise(F.array(F.repeat(F.concat("n_name", F.lit(" ")), 250)))
    return read(spark, sf_dir, "nation").select("n_nationkey", templates.linearized_answer(items).alias("answer"))


@query()
def synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded picks: rows only; every table gets a question."""
    return synthesis.synthesize(order_cells(spark, sf_dir))


@query()
def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return synthesis.retrieval_queries(cells, tables.row_texts(cells))


# --- pages, sentences, HTML ------------------------------------------------


@query(r"SELECT page_id, replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_titles(read(spark, sf_dir, "pages"), "page_id")


@query("SELECT url, 'Title' AS title, ['body'] AS body FROM pages")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    blocks = read(spark, sf_dir, "pages").select(F.concat(F.lit('<doc id="1" url="'), escaped, F.lit('">\nTitle\n\nbody\n')).alias("value"))
    return pages.blocks_of(blocks)


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INT) AS segment FROM documents")
def stripe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.striped(read(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@query()
def leaf_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_paragraphs(read(spark, sf_dir, "pages"))


@query()
def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_sentences(read(spark, sf_dir, "pages"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_id", "sent"))


@query("SELECT d.doc_id, u.para - 1 AS para_id, 'Doc ' || d.doc_id || '-' || (u.para - 1) || '-0-0' AS id, sha256('Doc ' || d.doc_id || '. ' || string_split(d.text, chr(10))[u.para]) AS contents FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS para) u")
def sentence_index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = document_lines(spark, sf_dir).select("doc_id", "para_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" - Wikipedia")).alias("title"), F.lit(0).alias("split_id"), F.lit(0).alias("sent_id"), "sent")
    title = text.plain_title(F.col("title"))
    made = s.select("doc_id", "para_id", F.concat_ws("-", title, F.col("para_id").cast("string"), F.col("split_id").cast("string"), F.col("sent_id").cast("string")).alias("id"), F.sha2(F.concat(title, F.lit(". "), "sent"), 256).alias("contents"))
    return made


def region_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a page with a table of its nations whose first cell
    spans the rows."""
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("r"))
    body = F.transform("r", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("r").cast("string"), F.lit(">"), F.col("r_name"), F.lit("</td>"))).otherwise(""), F.lit("<td><a href=x>"), x["n_name"], F.lit("</a><sup class=reference>[1]</sup><span style='display:none'>no</span></td><td>"), x["n_nationkey"].cast("string"), F.lit("</td></tr>")))
    page = F.concat(F.lit("<html><title>"), "r_name", F.lit(" - Wikipedia</title><div id=bodyContent><h2><span class=mw-headline>Nations</span></h2><h3><span class=mw-headline>Of "), "r_name", F.lit("</span></h3><table class=wikitable><caption>All</caption><tr><th>region</th><th colspan=2>nation</th></tr>"), F.array_join(body, ""), F.lit("</table></div></html>"))
    return rows.select(F.concat(F.lit("https://x/?curid="), "r_name").alias("url"), page.alias("html"))


@query("SELECT r_name AS region, n_name AS nation, CAST(n_nationkey AS VARCHAR) AS number FROM nation JOIN region ON n_regionkey = r_regionkey")
def html_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span expansion against the relational join."""
    rows = html.extract_tables(region_pages(spark, sf_dir)).select(F.explode(F.slice("grid", 2, F.size("grid") - 1)).alias("r"))
    return rows.select(*(F.col("r")[i].alias(c) for i, c in enumerate(("region", "nation", "number"))))


@query("SELECT 'https://x/?curid=' || r_name AS url, 0 AS idx, r_name || ' - Wikipedia' AS page_title, 'Nations > Of ' || r_name AS sections, 'All' AS table_caption, 'region|nation|nation' AS header FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html.extract_tables(region_pages(spark, sf_dir))
    return t.select("url", "idx", "page_title", F.array_join("section_titles", " > ").alias("sections"), "table_caption", F.array_join(F.col("grid")[0], "|").alias("header"))


@query("SELECT r_name AS url, list_sort(list(n_name)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def html_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexpanded struct cells: the first cell's row span says how many
    nations follow."""
    t = html.extract_tables(region_pages(spark, sf_dir)).select(F.replace("url", F.lit("https://x/?curid="), F.lit("")).alias("url"), F.slice("spans", 2, F.size("spans") - 1).alias("s"))
    names = F.transform("s", lambda r: F.element_at(r, -2)["text"])
    return t.filter(F.col("s")[0][0]["rowspan"] == F.size("s")).select("url", F.array_sort(names).alias("names"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS text, 'none' AS description, 'a, b' AS aliases FROM nation")
def kg_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))  # a fixed list of 25
    rows = F.transform("n", lambda x: F.concat(F.lit("<tr><td>"), x["n_nationkey"].cast("string"), F.lit("<td>"), x["n_name"], F.lit("<td> <td>a, b</tr>")))
    page = n.select(F.lit("u").alias("url"), F.concat(F.lit("<table><tr><th>ID<th>label<th>description<th>aliases</tr>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
    return pages.property_list(page)


# --- alignment -------------------------------------------------------------


def priced_sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as a page's table, and a sentence on each order."""
    o = order_cells(spark, sf_dir).withColumnRenamed("table_id", "page").withColumn("table_id", F.col("page"))
    w = tables.wide(order_cells(spark, sf_dir), ["number", "price", "status", "priority"])
    s = w.select(F.col("table_id").alias("page"), F.col("row_index").alias("sent_id"), F.concat(F.lit("Order "), "number", F.lit(" of "), F.col("status"), F.lit(" cost "), "price", F.lit(" ("), "priority", F.lit(").")).alias("text"))
    return o, s


@query(f"WITH {ORDERS} SELECT a.table_id AS page, a.row_index AS sent_id, b.row_index AS row_index, CAST(count(*) AS BIGINT) AS n FROM o a JOIN o b USING (table_id), LATERAL (VALUES (b.number), (b.price), (b.status), (b.priority)) c(t) WHERE contains(concat('Order ', a.number, ' of ', a.status, ' cost ', a.price, ' (', a.priority, ').'), c.t) GROUP BY ALL")
def row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sents = priced_sentences(spark, sf_dir)
    hits = F.filter("cells", lambda c: F.contains(F.col("sentence"), c["text"]))
    return align.gated_rows(cells, sents.withColumnRenamed("text", "sentence")).select("page", "sent_id", "row_index", F.size(hits).cast("bigint").alias("n"))


@query(f"WITH {ORDERS} SELECT a.table_id AS page, a.row_index AS sent_id, b.row_index AS row_index, 1 AS column_index FROM o a JOIN o b ON a.table_id = b.table_id AND a.price = b.price")
def ngram_exact_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price column's exact matches."""
    cells, sents = priced_sentences(spark, sf_dir)
    return align.exact_alignments(cells.filter("column_index = 1"), sents).select("page", "sent_id", "row_index", "column_index").distinct()


@query(f"WITH {ORDERS} SELECT a.table_id AS page, a.row_index AS sent_id, b.row_index AS row_index FROM o a JOIN o b ON a.table_id = b.table_id AND a.price = b.price WHERE NOT starts_with(a.price, '1') AND NOT contains(a.price, '.1')")
def date_clash_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are statistics, three tokens each; those with a token that a
    tagger takes for a date, here one that starts with 1, don't match."""
    cells, sents = priced_sentences(spark, sf_dir)
    marked = align.annotated(cells.filter("header = 'price'"))
    tagger = lambda found: F.transform(found, lambda t: F.when(t.startswith("1"), F.lit("DATE")).otherwise(F.lit("")))
    return align.exact_alignments(marked, sents, tagger).select("page", "sent_id", "row_index").distinct()


@query()
def extract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.extracted_pairs(*priced_sentences(spark, sf_dir))


@query()
def partial_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sents = priced_sentences(spark, sf_dir)
    return align.aligned(cells, sents)


@query(f"WITH {ORDERS}, x AS (SELECT a.table_id AS page, a.row_index AS sent_id, b.row_index AS row_index, (a.number = b.number)::INT + (a.price = b.price)::INT + (a.status = b.status)::INT + (a.priority = b.priority)::INT AS c FROM o a JOIN o b USING (table_id)) SELECT page, sent_id FROM x GROUP BY ALL HAVING max(c) >= 3 OR count(*) FILTER (WHERE c = 2) >= 2")
def context_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sents = priced_sentences(spark, sf_dir)
    exact = align.exact_alignments(cells, sents).withColumn("match_type", F.lit("EXACT"))
    return align.valid_contexts(align.focus_spans(exact))


@query(f"WITH {ORDERS} SELECT a.table_id AS page, a.row_index AS sent_id, b.row_index AS row_index, list_filter([CASE WHEN a.price = b.price THEN 1 END, CASE WHEN a.status = b.status THEN 2 END, CASE WHEN a.priority = b.priority THEN 3 END], lambda v: v IS NOT NULL) AS columns FROM o a JOIN o b ON a.table_id = b.table_id AND (a.price = b.price OR a.status = b.status OR a.priority = b.priority)")
def focus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sents = priced_sentences(spark, sf_dir)
    exact = align.exact_alignments(cells.filter("column_index > 0"), sents).withColumn("match_type", F.lit("EXACT"))
    return align.focus_groups(align.focus_spans(exact))


@query(f"WITH {ORDERS} SELECT DISTINCT table_id AS page, row_index AS sent_id FROM o")
def candidate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, sents = priced_sentences(spark, sf_dir)
    m = align.exact_alignments(cells, sents).withColumn("is_stat", F.col("text").contains("."))
    return align.candidate_sentences(m)


@query(f"WITH {ORDERS} SELECT table_id FROM o GROUP BY table_id HAVING count(*) >= 2 AND count(*) % 3 = count(DISTINCT priority) % 3")
def high_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_cells(spark, sf_dir).groupBy("table_id").agg(F.countDistinct("row_index").alias("n_rows"), (F.countDistinct("row_index") % 3).alias("n_highlighted"), (F.countDistinct(F.when(F.col("column_index") == 3, F.col("text"))) % 3).alias("n_focus"))
    return align.high_quality(p).select("table_id")


@query()
def contrastive_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded picks: rows only; tests hold the invariants."""
    cells, sents = priced_sentences(spark, sf_dir)
    focus = align.unique_alignments(cells, sents).filter("row_index = sent_id").withColumn("context_id", F.concat_ws("/", "page", F.col("sent_id").cast("string")))
    contexts = sents.select(F.concat_ws("/", "page", F.col("sent_id").cast("string")).alias("context_id"), F.col("page").alias("table_id"), "text")
    return rewrite.contrastive(contexts, focus.select("context_id", "row_index", "column_index", "mentions"), cells.select("table_id", "row_index", "column_index", "text"))


# --- retrieval -------------------------------------------------------------


BM25 = r"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN_]+'), lambda t: t <> '') AS t FROM documents),
q AS (SELECT item_id, u AS term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN_]+'), lambda t: t <> '')) AS u FROM benchmark) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(t)) AS average FROM d),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id AS query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / average))) AS score FROM q JOIN f USING (term) JOIN p USING (term), size GROUP BY ALL)"""


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 4) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS place FROM s) WHERE place <= 3")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieval.bm25(read(spark, sf_dir, "documents"), b)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"), "place")


@query()
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sent"))
    hits = F.broadcast(retrieval.bm25(read(spark, sf_dir, "documents"), b).join(b.withColumnRenamed("text", "original"), "query_id"))  # three a query
    hits = d.join(hits, "doc_id")
    return retrieval.hard_negatives(hits).select("query_id", "doc_id", "place")


@query("SELECT conv_id AS query_id, 'conv ' || conv_id AS \"table\", sha256(text) AS text, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label FROM conversations WHERE role IN ('user', 'assistant')")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumns({"query_id": F.col("conv_id"), "table": F.concat(F.lit("conv "), F.col("conv_id").cast("string")), "sent": F.col("text")})
    pairs = retrieval.training_pairs(c.filter("role = 'assistant'"), c.filter("role = 'user'"))
    return pairs.withColumn("text", F.sha2("text", 256))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 1")
def dataset_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharding operator: one of four shards."""
    return pages.shard(read(spark, sf_dir, "documents").select("doc_id", "lang"), 4, 1, "doc_id")


# --- triples ---------------------------------------------------------------


@query("SELECT c_name AS head, 'lives in' AS type, n_name AS tail, CAST(c_custkey AS VARCHAR) AS doc_id, '0' AS sent_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_name, 'buys for', c_mktsegment, CAST(c_custkey AS VARCHAR), '0' FROM customer JOIN nation ON c_nationkey = n_nationkey")
def triples_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    t = F.concat(F.lit("<s><triplet> "), "c_name", F.lit(" <subj> "), "n_name", F.lit(" <obj> lives in <subj> "), "c_mktsegment", F.lit(" <obj> buys for</s><pad>"))
    return triples.triples(n.select(F.col("c_custkey").alias("doc_id"), F.lit("0").alias("sent_id"), t.alias("text")))


@query("SELECT s_name AS head, 'LINK_TO' AS type, n_name AS tail, CAST(s_suppkey AS VARCHAR) AS doc_id, '0' AS sent_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    links = F.array(F.struct(F.lit(4).alias("start"), F.length("s_name").alias("length"), F.col("n_name").alias("entity")))
    return triples.entity_links(n.select(F.col("s_suppkey").alias("doc_id"), F.lit("0").alias("sent_id"), F.concat(F.lit("The "), "s_name", F.lit(" sells.")).alias("text"), links.alias("links")))
