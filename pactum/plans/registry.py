"""The registered queries of the contract operators and their DuckDB equivalents."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.contract import Column, Contract, Correlation, Dataset, Monotone, Relationship
from pactum.functions import rules as R
from pactum.functions.draws import draws_sql
from pactum.functions.ranks import ACKLAM, drawn, exactly
from pactum.operators import clean, enrich, forest, generate, prepare, privacy, relational, stats
from pactum.plans import jobs
from pactum.sources import tables as io
from pactum.sources.work import materialised, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query and its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def bits_sql(label: str, key: str, seed: int = 42) -> str:
    """DuckDB's form of the draws of functions.ranks: 52 bits."""
    return f"('0x' || substr(md5('{seed}:{label}:' || coalesce(({key})::VARCHAR, '')), 1, 13))::BIGINT"


def draw_sql(label: str, key: str, seed: int = 42) -> str:
    return f"(({bits_sql(label, key, seed)})::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def C(name: str, type_: str, low: float | None = None, high: float | None = None, dist: str | None = None, **more: object) -> Column:
    return Column(name, type_, low, high, dist, **more)


LINEITEM = Contract(
    (
        C("l_orderkey", "int", 0, None, "uniform"),
        C("l_partkey", "int", 0, None, "uniform"),
        C("l_suppkey", "int", 0, None, "uniform"),
        C("l_linenumber", "int", 1, 7, "uniform"),
        C("l_quantity", "float", 1, 48, "uniform"),
        C("l_extendedprice", "float", 0, None, "normal"),
        C("l_discount", "float", 0, 0.1, "uniform"),
        C("l_tax", "float", 0, 0.08, "uniform"),
        C("l_returnflag", "category", categories=("A", "N", "R")),
        C("l_linestatus", "category", categories=("F", "O")),
        C("l_shipdate", "datetime"),
    ),
    rules=("l_discount <= 0.08", "NOT (l_quantity > 40 AND l_tax > 0.06)"),
    correlations=(Correlation("l_quantity", "l_extendedprice", "+", 0.5),),
)
ORDERS = Contract(
    (
        C("o_orderkey", "int", 0, None, "uniform"),
        C("o_custkey", "int", 0, None, "uniform"),
        C("o_orderstatus", "category", categories=("F", "O")),
        C("o_totalprice", "float", 1000, 400_000, "lognormal"),
        C("o_orderdate", "datetime"),
        C("o_orderpriority", "str"),
    ),
    primary_key="o_orderkey",
)
CUSTOMER = Contract(
    (C("c_custkey", "int", 0, None, "uniform"), C("c_name", "str"), C("c_nationkey", "int", 0, 24, "uniform"), C("c_acctbal", "float", 0, None, "uniform"), C("c_mktsegment", "str")),
    primary_key="c_custkey",
)
SHOP = Dataset(
    {"customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM},
    "customer",
    (Relationship("customer", "c_custkey", "orders", "o_custkey", 10.0), Relationship("orders", "o_orderkey", "lineitem", "l_orderkey", 4.0, 0, 7)),
)


def shop(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in SHOP.tables}


# ---- sources and sinks


@query("s1_read_csv", "SELECT * FROM orders")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as CSV and read by contract."""
    paths = io.write_table(table(spark, d, "orders"), work_path(spark, "s1"), "orders", ("csv",))
    return io.read_table(spark, paths["csv"], "csv", ORDERS)


@query("s1_read_json_batches", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def s1_json(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON objects that hold batches of rows under data, and read back."""
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    batches = df.groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.collect_list(F.struct(*df.columns)).alias("data"))
    path = work_path(spark, "s1")
    batches.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return io.read_table(spark, path, "json").select(df.columns)


@query("s1_read_commented_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s1_commented(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV with lines of comment above every header and among the rows, and read back."""
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    lines = df.select(F.concat(F.when(F.col("c_custkey") % 7 == 0, "# a note\n").otherwise(""), F.to_csv(F.struct(*df.columns))).alias("value"))

    def headed(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for k, batch in enumerate(batches):
            yield from [pa.RecordBatch.from_pydict({"value": ["# source: customers", ",".join(("c_custkey", "c_name", "c_acctbal"))]})] if k == 0 else []
            yield batch

    path = work_path(spark, "s1")
    lines.mapInArrow(headed, "value string").write.text(path)
    return io.read_table(spark, path, "csv", CUSTOMER)


@query("s2_write_formats", "SELECT f AS format, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer, (VALUES ('parquet'), ('csv'), ('json')) v(f) GROUP BY f")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Customers written in every format and read back."""
    paths = io.write_table(table(spark, d, "customer"), work_path(spark, "s2"), "customer", io.FORMATS)
    out = None
    for fmt, path in paths.items():
        back = io.read_table(spark, path, fmt, CUSTOMER)
        one = back.agg(F.lit(fmt).alias("format"), F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
        out = one if out is None else out.unionByName(one)
    return out


_ODD_TEXT = """CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 3 THEN 'a "quoted", one'
  WHEN 4 THEN '#no comment' WHEN 5 THEN '  blanks  ' WHEN 6 THEN 'cr' || chr(13) || chr(10) || '"' WHEN 7 THEN '""' ELSE o_orderpriority END"""


@query("s2_csv_round_trip", f"SELECT {_ODD_TEXT} AS note, o_orderkey, o_totalprice, o_orderdate FROM orders")
def s2_csv(spark: SparkSession, d: str) -> DataFrame:
    """Orders with notes of line breaks, quotes, signs of comment, blanks, empty and missing text, written as CSV and read back."""
    notes = table(spark, d, "orders").select(F.expr(_ODD_TEXT).alias("note"), "o_orderkey", "o_totalprice", "o_orderdate")
    path = io.write_table(notes, work_path(spark, "s2"), "notes", ("csv",))["csv"]
    kinds = Contract((C("note", "str"), C("o_orderkey", "int"), C("o_totalprice", "float"), C("o_orderdate", "datetime")))
    return io.read_table(spark, path, "csv", kinds)


@query("s3_reference_sample", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 2000")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """A reference sample of at most 2000 rows, without the nested column."""
    return io.reference_sample(table(spark, d, "embeddings"), 2000, ["vec_id"])


@query("s4_numeric_cast", "SELECT o_orderkey::DOUBLE AS k, o_totalprice AS price, o_orderpriority AS priority FROM orders")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Text columns turned into numbers where all values parse."""
    text = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"))
    return io.numeric_where_all_parse(text)


def _html_sql() -> str:
    x = "html"
    for tag in io.SILENT:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|title|body|html|head)\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"
    x = f"replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;', '&')"
    return f"""WITH t AS (SELECT page_id, [trim(regexp_replace(x, '[ \\t\\r\\f\\x0B]+', ' ', 'g')) FOR x IN string_split({x}, chr(10))] AS l FROM pages)
SELECT page_id, array_to_string([x FOR x IN l IF length(x) > 20], chr(10)) AS text FROM t"""


@query("s5_html_text", _html_sql())
def s5(spark: SparkSession, d: str) -> DataFrame:
    """The text lines of all pages."""
    return io.html_text(table(spark, d, "pages")).select("page_id", "text")


@query(
    "s6_manifest",
    """SELECT 'customer' AS "table", count(*) AS n, 5::BIGINT AS n_columns, 'c_custkey' AS primary_key, 100.0::DOUBLE AS retention FROM customer
UNION ALL SELECT 'orders', count(*), 6, 'o_orderkey', 100.0 FROM orders UNION ALL SELECT 'lineitem', count(*), 11, NULL, 100.0 FROM lineitem""",
)
def s6(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of customers, orders and lineitems."""
    return io.manifest(shop(spark, d), SHOP).select("table", F.col("rows").alias("n"), F.size("columns").cast("long").alias("n_columns"), "primary_key", F.col("retention_pct").alias("retention"))


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]
_LINE_TEXT = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _LINES)
_LINE_SUMS = " || '-' || ".join(f"(sum(('0x' || substr(h{k}, {at}, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR" for k in (1, 2) for at in (1, 17))


@query(
    "s7_fingerprint",
    f"""WITH t AS (SELECT l_returnflag, {_LINE_TEXT} AS t FROM lineitem), h AS (SELECT l_returnflag, md5('1:' || t) AS h1, md5('2:' || t) AS h2 FROM t),
g AS (SELECT 'all' AS part, h1, h2 FROM h UNION ALL SELECT l_returnflag, h1, h2 FROM h)
SELECT part, count(*) AS n, md5('{",".join(f"{c}:{k}" for c, k in zip(_LINES, _LINE_TYPES, strict=True))}') || '-' || {_LINE_SUMS} AS digest FROM g GROUP BY part""",
)
def s7(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprints of lineitems of each flag, and that of all, put together from these."""
    df = table(spark, d, "lineitem").select(*_LINES)
    flags = [r[0] for r in df.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    own = {flag: io.fingerprint(df.where(F.col("l_returnflag") == flag)) for flag in flags}
    whole = functools.reduce(io.merged, own.values())
    return spark.createDataFrame([(k, f["rows"], f["digest"]) for k, f in [*own.items(), ("all", whole)]], "part string, n long, digest string")


# ---- row filters and cleaning


@query("f1_contract_order", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Contract columns first."""
    df = table(spark, d, "customer")
    return clean.in_contract_order(df.select(*reversed(df.columns)), CUSTOMER)


@query("f2_duplicates", "SELECT DISTINCT * FROM lineitem")
def f2(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates removed from twice the lineitems."""
    df = table(spark, d, "lineitem")
    return clean.without_duplicates(df.unionByName(df))


@query("f3_schema_bounds", "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('F', 'O') AND o_orderkey >= 0 AND o_custkey >= 0 AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Orders within the contract's bounds and categories."""
    return clean.within_bounds(table(spark, d, "orders"), ORDERS)


@query(
    "f3_bounds_report",
    """SELECT u.c AS "column", u.v AS violations FROM (SELECT count(*) FILTER (o_orderkey < 0) AS a, count(*) FILTER (o_custkey < 0) AS b, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS c,
 count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS e, count(*) FILTER (o_orderdate IS NULL) AS f, count(*) FILTER (o_orderpriority IS NULL) AS g FROM orders) t,
LATERAL (VALUES ('o_orderkey', a), ('o_custkey', b), ('o_orderstatus', c), ('o_totalprice', e), ('o_orderdate', f), ('o_orderpriority', g)) u(c, v)""",
)
def f3_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations of each column over the same rows."""
    return clean.bounds_report(table(spark, d, "orders"), ORDERS)


RULES = ("l_quantity * l_tax <= 3", "l_returnflag = 'N'", "l_quantity < 0", "l_nothing > 3", "l_discount + l_tax")


@query("f4_business_rules", "SELECT * FROM lineitem WHERE l_quantity * l_tax <= 3 AND l_returnflag = 'N'")
def f4(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems that obey the rules; one that all violate is skipped."""
    return clean.obeying_rules(table(spark, d, "lineitem"), RULES)


@query(
    "f4_rules_report",
    """SELECT u.* FROM (SELECT count(*) FILTER (NOT l_quantity * l_tax <= 3) AS a, count(*) FILTER (l_returnflag <> 'N') AS b, count(*) AS n FROM lineitem) t,
LATERAL (VALUES ('l_quantity * l_tax <= 3', 'applied', a, a >= n / 2.0), ('l_returnflag = ''N''', 'applied', b, b >= n / 2.0), ('l_quantity < 0', 'skipped', n, true), ('l_nothing > 3', 'skipped', NULL, false), ('l_discount + l_tax', 'skipped', NULL, false)) u(rule, status, violations, suspicious)""",
)
def f4_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of each rule."""
    return clean.rules_report(table(spark, d, "lineitem"), RULES).drop("reason")


EXPRESSIONS = {
    "chained": ("1 < l_quantity <= 25", "l_quantity > 1 AND l_quantity <= 25"),
    "membership": ("l_returnflag IN ('A', 'R') or l_linenumber not in [1, 2]", "l_returnflag IN ('A', 'R') OR l_linenumber NOT IN (1, 2)"),
    "arithmetic": ("abs(l_tax - l_discount) * 100 > 3 and -l_quantity < -2", "abs(l_tax - l_discount) * 100 > 3 AND l_quantity > 2"),
    "zero_division": ("l_tax / l_discount > 1", "CASE WHEN l_discount = 0 THEN l_tax > 0 ELSE l_tax / l_discount > 1 END"),
    "null_test": ("l_tax IS NULL", "l_tax IS NULL"),
    "dates": ("l_shipdate >= '1995-01-01'", "l_shipdate >= TIMESTAMP '1995-01-01'"),
}


@query("f5_rule_language", "SELECT u.* FROM (SELECT " + ", ".join(f"count(*) FILTER ({sql}) AS {n}" for n, (_, sql) in EXPRESSIONS.items()) + " FROM lineitem) t, LATERAL (VALUES " + ", ".join(f"('{n}', {n})" for n in EXPRESSIONS) + ") u(name, rows_true)")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """How many lineitems each kind of rule expression is true for."""
    df = table(spark, d, "lineitem")
    one = df.agg(*[F.count_if(R.to_column(rule, df.schema)).alias(n) for n, (rule, _) in EXPRESSIONS.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("rows_true")) for n in EXPRESSIONS])))


ELIGIBLE = Contract((C("l_quantity", "float"), C("l_extendedprice", "float", dist="exponential"), C("l_discount", "float"), C("l_tax", "float", dist="uniform"), C("l_linenumber", "int")))
_ZERO = "CASE WHEN count(*) FILTER (x = 0) > 0.3 * count(x) THEN 'zero inflated' WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) <= 0 THEN 'no spread' WHEN abs((quantile_cont(x, 0.75) + quantile_cont(x, 0.25) - 2 * quantile_cont(x, 0.5)) / (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))) > 0.30 THEN 'skewed' ELSE 'symmetric' END"


@query(
    "f6_zscore_eligibility",
    f"""WITH t AS (SELECT 'l_quantity' AS c, l_quantity::DOUBLE AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem),
r AS (SELECT c AS "column", {_ZERO} AS reason FROM t GROUP BY c)
SELECT "column", reason = 'symmetric' AS eligible, reason FROM r UNION ALL VALUES ('l_extendedprice', false, 'declared exponential'), ('l_tax', true, 'declared uniform')""",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    """Which columns a z-score suits, and why."""
    return clean.zscore_eligibility(table(spark, d, "lineitem"), ELIGIBLE)


@query("f7_zscore", "SELECT * FROM events WHERE NOT coalesce(abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) > 3, false)")
def f7(spark: SparkSession, d: str) -> DataFrame:
    """Events without outliers of their value."""
    return clean.without_zscore_outliers(table(spark, d, "events"), ["value"])


@query("f8_isolation_forest")
def f8(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems without the two percent that are most isolated."""
    return forest.without_isolated(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.02)


@query(
    "f9_preserved",
    """WITH t AS (SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(n_chars) AS a, stddev_pop(n_chars) AS s FROM t)
SELECT t.* FROM t, m WHERE abs(n_chars - a) / s <= 1.5 OR toxic = 1""",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    """Documents of usual length, and all that are labelled toxic."""
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "toxic")
    contract = Contract((C("n_chars", "int"),), preserve_column="toxic", preserve_value=1)
    return clean.without_zscore_outliers(df, ["n_chars"], 1.5, clean.preserved(df, contract))


GUARD = Contract((C("l_quantity", "float", dist="uniform"), C("l_extendedprice", "float", dist="normal")), correlations=(Correlation("l_quantity", "l_extendedprice", "+", 0.85),))


@query(
    "f10_correlation_guard",
    """WITH t AS (SELECT DISTINCT l_quantity AS q, l_extendedprice AS p, l_orderkey, l_linenumber FROM lineitem), m AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(p) AS ap, stddev_pop(p) AS sp, corr(q, p) AS r FROM t),
k AS (SELECT t.*, m.r AS r0 FROM t, m WHERE abs(q - aq) / sq <= 1 AND abs(p - ap) / sp <= 1)
SELECT any_value(r0) >= 0.85 AND corr(q, p) < 0.85 AS reverted, CASE WHEN any_value(r0) >= 0.85 AND corr(q, p) < 0.85 THEN (SELECT count(*) FROM t) ELSE count(*) END AS n FROM k""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Outlier removal is undone if it breaks a correlation that held."""
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber")
    run = clean.validate(df, GUARD, z_threshold=1.0)
    return spark.createDataFrame([(run.guard_reverted, run.rows.count())], "reverted boolean, n long")


_Z = [c.name for c in LINEITEM.columns if c.numeric]


@query(
    "f11_validate_lineitem",
    f"""WITH b AS (SELECT DISTINCT * FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 AND l_quantity BETWEEN 1 AND 48 AND l_extendedprice >= 0 AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.08
 AND l_returnflag IN ('A', 'N', 'R') AND l_linestatus IN ('F', 'O') AND l_shipdate IS NOT NULL AND l_discount <= 0.08 AND NOT (l_quantity > 40 AND l_tax > 0.06)),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)} FROM b)
SELECT b.* FROM b, m WHERE {' AND '.join(f'abs({c} - m_{c}) / s_{c} <= 3' for c in _Z)}""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems after the whole validation."""
    return clean.validate(table(spark, d, "lineitem"), LINEITEM).rows


@query(
    "f11_stages",
    f"""WITH u AS (SELECT DISTINCT * FROM lineitem),
b AS (SELECT * FROM u WHERE l_linenumber BETWEEN 1 AND 7 AND l_quantity BETWEEN 1 AND 48 AND l_extendedprice >= 0 AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.08
 AND l_returnflag IN ('A', 'N', 'R') AND l_linestatus IN ('F', 'O') AND l_shipdate IS NOT NULL),
r AS (SELECT * FROM b WHERE l_discount <= 0.08 AND NOT (l_quantity > 40 AND l_tax > 0.06)),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)} FROM r),
z AS (SELECT count(*) AS n FROM r, m WHERE {' AND '.join(f'abs({c} - m_{c}) / s_{c} <= 3' for c in _Z)}),
n AS (SELECT (SELECT count(*) FROM lineitem) AS a, (SELECT count(*) FROM u) AS u, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM r) AS r, (SELECT n FROM z) AS z),
t AS (SELECT x.* FROM n, LATERAL (VALUES (1, 'duplicates', a, u), (2, 'bounds', u, b), (3, 'rules', b, r), (4, 'zscore', r, z), (5, 'isolation_forest', z, z)) x(step, stage, rows_before, rows_after))
SELECT *, rows_before - rows_after AS removed, round(100.0 * (rows_before - rows_after) / rows_before, 4)::DOUBLE AS removed_pct FROM t""",
)
def f11_stages(spark: SparkSession, d: str) -> DataFrame:
    """Rows before and after each stage."""
    return clean.validate(table(spark, d, "lineitem"), LINEITEM).stages


ODD = Contract((C("c_custkey", "int"), C("c_acctbal", "int", 2000, 5000), C("c_mktsegment", "category", categories=("BUILDING", "MACHINERY")), C("c_phone", "str")), row_count=10**9)


@query(
    "f12_conformance",
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal < 2000) / count(*)::DOUBLE AS lo, count(*) FILTER (c_acctbal > 5000) / count(*)::DOUBLE AS hi, count(*) FILTER (c_acctbal <> floor(c_acctbal)) / count(*)::DOUBLE AS fr, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) / count(*)::DOUBLE AS ot FROM customer),
r AS (SELECT u.* FROM t, LATERAL (VALUES ('c_phone', 'missing', NULL::DOUBLE, true), ('c_name', 'extra', NULL, true), ('c_nationkey', 'extra', NULL, true), (NULL, 'too few rows', n::DOUBLE, true), ('c_acctbal', 'below min', round(lo, 6), lo > 0.25), ('c_acctbal', 'above max', round(hi, 6), hi > 0.25), ('c_acctbal', 'fractions in an int column', round(fr, 6), fr > 0), ('c_mktsegment', 'unknown categories', round(ot, 6), ot > 0.1)) u(c, issue, measured, holds))
SELECT c AS "column", issue, measured FROM r WHERE holds""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    """How the customers depart from a contract that does not fit."""
    return clean.conformance_issues(table(spark, d, "customer"), ODD)


@query("f13_integer_alignment", "SELECT c_custkey, round_even(c_acctbal, 0)::BIGINT AS c_acctbal FROM customer")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Balances as whole numbers."""
    return clean.aligned_integers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ODD)


# ---- profiles and statistics


def _stats_sql(t: str, numbers: list[str], others: list[str]) -> str:
    one = [f"""SELECT '{c}' AS "column", 'numeric' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, round(min({c}), 4)::DOUBLE AS low, round(max({c}), 4)::DOUBLE AS high, round(avg({c}), 4)::DOUBLE AS mean, round(stddev_samp({c}), 4)::DOUBLE AS std, round(median({c}), 4)::DOUBLE AS median FROM {t}""" for c in numbers]
    one += [f"SELECT '{c}', 'other', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL FROM {t}" for c in others]
    return " UNION ALL ".join(one)


@query("x1_column_stats", _stats_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
def x1(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all columns of orders."""
    s = stats.column_stats(table(spark, d, "orders"))
    return s.select("column", "kind", F.col("rows").alias("n"), "nulls", F.col("distinct").alias("n_distinct"), *[F.round(c, 4).alias(a) for c, a in (("min", "low"), ("max", "high"), ("mean", "mean"), ("std", "std"), ("median", "median"))])


@query(
    "x1_top_values",
    """WITH t AS (SELECT 'o_orderpriority' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders),
g AS (SELECT c, v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v)::INT AS k FROM g)
SELECT c AS "column", v AS value, n AS "count", k AS rank FROM r WHERE k <= 5""",
)
def x1_top(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of three columns of orders."""
    return stats.top_values(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query("x2_schema_conformance", "SELECT 'c_phone' AS missing, 'c_name,c_nationkey' AS extra, true AS order_matches, count(*) AS n FROM customer")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """Missing and extra columns of customers, and the rows that this concerns."""
    df = table(spark, d, "customer")
    s = stats.schema_conformance(df, ODD)
    return s.select(F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "order_matches").join(df.agg(F.count("*").alias("n")))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for k, a in enumerate(_NUM) for b in _NUM[k + 1 :]]


@query("x3_pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in _PAIRS))
def x3(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlations of lineitem columns."""
    return stats.correlation_matrix(table(spark, d, "lineitem"), _NUM).select("a", "b", F.round("r", 9).alias("r"))


def _rank_sql(t: str, c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


_RANKED = "SELECT " + ", ".join(f"{_rank_sql('lineitem', c)} AS {c}" for c in _NUM[:3]) + " FROM lineitem"


@query("x3_spearman_matrix", f"WITH t AS ({_RANKED}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM t" for a, b in _PAIRS if "l_tax" not in (a, b)))
def x3_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlations of lineitem columns."""
    return stats.correlation_matrix(table(spark, d, "lineitem"), _NUM[:3], "spearman").select("a", "b", F.round("r", 9).alias("r"))


DECLARED = Contract((C("l_quantity", "float"), C("l_extendedprice", "float"), C("l_discount", "float"), C("l_returnflag", "str")), correlations=(Correlation("l_quantity", "l_extendedprice", "+", 0.5), Correlation("l_quantity", "l_discount", "-", 0.3, "pearson"), Correlation("l_discount", "l_returnflag", "+", 0.1)))


@query(
    "x4_correlation_check",
    """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, '+' AS sign, round(corr(l_quantity, l_extendedprice), 9) AS r, corr(l_quantity, l_extendedprice) >= 0.5 AS passed FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', '-', round(corr(l_quantity, l_discount), 9), -corr(l_quantity, l_discount) >= 0.3 FROM lineitem UNION ALL SELECT 'l_discount', 'l_returnflag', '+', NULL, false""",
)
def x4(spark: SparkSession, d: str) -> DataFrame:
    """Declared correlations of lineitems."""
    return stats.correlation_check(table(spark, d, "lineitem"), DECLARED).select("a", "b", "sign", F.round("r", 9).alias("r"), "passed")


@query(
    "x5_kendall",
    """WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
m AS (SELECT q.x = t.x AS own, (q.x > t.x)::INT AS lower, q.x, t.y FROM (SELECT DISTINCT x FROM t) q JOIN t ON t.x <= q.x),
w AS (SELECT own, coalesce(sum(lower) OVER (PARTITION BY x ORDER BY y DESC GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM m),
d AS (SELECT sum(above)::DOUBLE AS d FROM w WHERE own),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
a AS (SELECT coalesce(sum(c * (c - 1) / 2), 0)::DOUBLE AS tx FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY x)),
b AS (SELECT coalesce(sum(c * (c - 1) / 2), 0)::DOUBLE AS ty FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY y)),
c AS (SELECT coalesce(sum(c * (c - 1) / 2), 0)::DOUBLE AS txy FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY x, y))
SELECT round((n * (n - 1) / 2 - tx - ty + txy - 2 * d) / (sqrt(n * (n - 1) / 2 - tx) * sqrt(n * (n - 1) / 2 - ty)), 9) AS tau FROM n, a, b, c, d""",
)
def x5(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau-b of quantity and price over all lineitems."""
    tau = stats.pair_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "kendall")
    return spark.createDataFrame([(None if tau is None else round(tau, 9),)], "tau double")


@query(
    "x6_ks_test",
    """WITH t AS (SELECT l_extendedprice AS v, (l_returnflag = 'A')::INT AS a, (l_returnflag = 'R')::INT AS b FROM lineitem WHERE l_returnflag IN ('A', 'R')),
g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM t GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g)
SELECT 'l_extendedprice' AS "column", any_value(na)::BIGINT AS n1, any_value(nb)::BIGINT AS n2, round(max(abs(ca / na - cb / nb)), 9) AS statistic FROM c""",
)
def x6(spark: SparkSession, d: str) -> DataFrame:
    """Prices of returned and accepted items compared."""
    df = table(spark, d, "lineitem")
    got = stats.ks_test(df.where("l_returnflag = 'A'"), df.where("l_returnflag = 'R'"), ["l_extendedprice"])
    return got.select("column", "n1", "n2", F.round("statistic", 9).alias("statistic"))


@query(
    "x7_profile",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4)::DOUBLE AS mean, round(stddev_samp({c}), 4)::DOUBLE AS std FROM part""" for c in ("p_partkey", "p_size", "p_retailprice"))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', count({c}), NULL, NULL FROM part" for c in ("p_name", "p_brand", "p_type")),
)
def x7(spark: SparkSession, d: str) -> DataFrame:
    """A profile of parts."""
    return stats.describe(table(spark, d, "part")).select("column", F.col("count").alias("n"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("x7_first_rows", "SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 8")
def x7_first(spark: SparkSession, d: str) -> DataFrame:
    """The eight rows of parts to look at: the cheapest."""
    return stats.first_rows(table(spark, d, "part"), 8, ["p_retailprice", "p_partkey"])


@query(
    "x8_histogram",
    """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM orders, m GROUP BY 1)
SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(40) r(b) LEFT JOIN c ON c.bin = b""",
)
def x8(spark: SparkSession, d: str) -> DataFrame:
    """Total prices in 40 bins."""
    return stats.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", F.col("count").alias("n"))


def _edges(t: str, x: str, y: str, n: int) -> str:
    cuts = ", ".join(str(k / n) for k in range(n + 1))
    return f"p AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{cuts}]))) AS e FROM p)"


@query(
    "x9_binned_monotonicity",
    f"""WITH {_edges('lineitem', 'l_quantity', 'l_extendedprice', 10)},
b AS (SELECT len([k FOR k IN e[2:len(e) - 1] IF k <= x]) AS bin, avg(y) AS m FROM p, e GROUP BY 1), s AS (SELECT m - lag(m) OVER (ORDER BY bin) AS d FROM b)
SELECT count(d)::INT AS steps, count(*) FILTER (d >= -1e-6)::INT AS steps_ok FROM s""",
)
def x9(spark: SparkSession, d: str) -> DataFrame:
    """Whether price rises with quantity over its deciles."""
    return stats.binned_monotonicity(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("steps", "steps_ok")


@query(
    "x10_concordance",
    f"""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM p),
w AS (SELECT x, y, CASE WHEN t <= 4000 THEN n ELSE floor(n * (4000 / t::DOUBLE) + {draw_sql('concordance', "x || ':' || y")}) END::INT AS w FROM p, t),
c AS (SELECT x, y, unnest(range(1, w + 1))::INT AS copy FROM w WHERE w > 0),
r AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('pairing', "x || ':' || y || ':' || copy")}, x, y, copy) AS k, count(*) OVER () // 2 AS half FROM c),
d AS (SELECT (a.x - b.x) AS dx, (a.y - b.y) AS dy FROM r a JOIN r b ON b.k = a.k + a.half WHERE a.k <= a.half AND a.x <> b.x)
SELECT count(*)::INT AS pairs, count(*) FILTER (dx * dy > 0)::INT AS concordant, count(*) FILTER (dx * dy > 0) / count(*)::DOUBLE AS ratio FROM d""",
)
def x10(spark: SparkSession, d: str) -> DataFrame:
    """Random pairs of lineitems in which price rises with quantity."""
    return stats.pairwise_concordance(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


def _monotone_sql(x: str, y: str, direction: str, k: int) -> str:
    """The three measures of a declared relation over lineitem, as tables numbered ``k``."""
    sign = 1 if direction == "increasing" else -1
    return f"""p{k} AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM lineitem), e{k} AS (SELECT list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM p{k}),
b{k} AS (SELECT len([i FOR i IN e[2:len(e) - 1] IF i <= x]) AS bin, avg(y) AS m FROM p{k}, e{k} GROUP BY 1), s{k} AS (SELECT {sign} * (m - lag(m) OVER (ORDER BY bin)) AS d FROM b{k}),
g{k} AS (SELECT x, y, count(*) AS n FROM p{k} GROUP BY 1, 2), t{k} AS (SELECT sum(n) AS t FROM g{k}),
w{k} AS (SELECT x, y, CASE WHEN t <= 4000 THEN n ELSE floor(n * (4000 / t::DOUBLE) + {draw_sql('concordance', "x || ':' || y")}) END::INT AS w FROM g{k}, t{k}),
c{k} AS (SELECT x, y, unnest(range(1, w + 1))::INT AS copy FROM w{k} WHERE w > 0),
r{k} AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('pairing', "x || ':' || y || ':' || copy")}, x, y, copy) AS i, count(*) OVER () // 2 AS half FROM c{k}),
d{k} AS (SELECT count(*) FILTER ({sign} * (a.x - b.x) * (a.y - b.y) > 0) / count(*)::DOUBLE AS pairwise FROM r{k} a JOIN r{k} b ON b.i = a.i + a.half WHERE a.i <= a.half AND a.x <> b.x),
h{k} AS (SELECT corr(rank_x, rank_y) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rank_x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS rank_y FROM p{k})),
v{k} AS (SELECT '{x}' AS x, '{y}' AS y, '{direction}' AS direction, (SELECT count(*) FILTER (d >= -1e-6) / count(d)::DOUBLE FROM s{k}) AS binned, pairwise, rho AS spearman, {sign} * rho >= -0.05 AS ranks FROM d{k}, h{k})"""


@query(
    "x11_monotonicity",
    "WITH " + ", ".join(_monotone_sql(x, y, w, k) for k, (x, y, w) in enumerate((("l_quantity", "l_extendedprice", "increasing"), ("l_discount", "l_tax", "decreasing"))))
    + """ SELECT x, y, direction, round(binned, 9) AS binned, round(pairwise, 9) AS pairwise, round(spearman, 9) AS spearman, binned >= 0.9 AND pairwise >= 0.85 * 0.9 AND ranks AS passed, '' AS reason FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1)
UNION ALL SELECT 'l_nothing', 'l_tax', 'increasing', NULL, NULL, NULL, false, 'missing column'""",
)
def x11(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on declared monotone relations."""
    rules = (Monotone("l_quantity", "l_extendedprice"), Monotone("l_discount", "l_tax", "decreasing"), Monotone("l_nothing", "l_tax"))
    got = stats.monotonicity_check(table(spark, d, "lineitem"), rules)
    return got.withColumns({c: F.round(c, 9) for c in ("binned", "pairwise", "spearman")})


@query(
    "x12_weight_of_evidence",
    f"""WITH d AS (SELECT n_chars, 1 - quality AS bad FROM documents JOIN labels USING (doc_id)), {_edges('d', 'n_chars', 'bad', 10)},
b AS (SELECT len([k FOR k IN e[2:len(e) - 1] IF k < x]) AS bin, count(*) AS n, sum(y)::BIGINT AS bad FROM p, e GROUP BY 1), t AS (SELECT sum(n - bad) AS g, sum(bad) AS b FROM b)
SELECT bin::INT AS bin, n, n - bad AS good, bad, round(ln((greatest(n - bad, 0.5) / greatest(t.g, 0.5)) / (greatest(bad, 0.5) / greatest(t.b, 0.5))), 9)::DOUBLE AS woe FROM b, t""",
)
def x12(spark: SparkSession, d: str) -> DataFrame:
    """Weight of evidence of a document's length for low quality."""
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("bad", 1 - F.col("quality"))
    return stats.weight_of_evidence(df, "n_chars", "bad").select("bin", "n", "good", "bad", F.round("woe", 9).alias("woe"))


@query(
    "x12_information_value",
    f"""WITH d AS (SELECT n_chars, 1 - quality AS bad FROM documents JOIN labels USING (doc_id)), {_edges('d', 'n_chars', 'bad', 10)},
b AS (SELECT len([k FOR k IN e[2:len(e) - 1] IF k < x]) AS bin, count(*) AS n, sum(y)::BIGINT AS bad FROM p, e GROUP BY 1), t AS (SELECT sum(n - bad) AS g, sum(bad) AS b FROM b),
s AS (SELECT bin, greatest(n - bad, 0.5) / greatest(t.g, 0.5) AS good, greatest(bad, 0.5) / greatest(t.b, 0.5) AS bad FROM b, t),
v AS (SELECT bin, ln(good / bad) AS woe, (good - bad) * ln(good / bad) AS iv FROM s), w AS (SELECT *, woe - lag(woe) OVER (ORDER BY bin) AS step FROM v)
SELECT round(sum(iv), 7)::DOUBLE AS iv, CASE WHEN sum(iv) < 0.02 THEN 'unpredictive' WHEN sum(iv) < 0.10 THEN 'weak' WHEN sum(iv) < 0.30 THEN 'medium' ELSE 'strong' END AS power,
  CASE WHEN min(step) >= -0.05 THEN 'increasing' WHEN max(step) <= 0.05 THEN 'decreasing' ELSE 'none' END AS trend FROM w""",
)
def x12_iv(spark: SparkSession, d: str) -> DataFrame:
    """How much a document's length says about low quality, and whether evidence goes one way."""
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("bad", 1 - F.col("quality"))
    return stats.information_value(df, "n_chars", "bad").withColumn("iv", F.round("iv", 7))


# ---- keys across tables

_KEPT = """WITH c AS (SELECT * FROM customer WHERE c_acctbal >= 0), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) """


def _cut_shop(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The shop without customers in debt: their orders, and the items of these, are orphans."""
    tables = shop(spark, d)
    return {**tables, "customer": tables["customer"].where("c_acctbal >= 0")}


@query(
    "j1_primary_keys",
    """SELECT 'customer' AS "table", count(*) AS n, (count(*) - count(DISTINCT c_custkey))::BIGINT AS duplicates, 0::BIGINT AS nulls, count(*) = count(DISTINCT c_custkey) AS passed FROM customer
UNION ALL SELECT 'orders', 2 * count(*), 2 * count(*) - count(DISTINCT o_orderkey), 0, false FROM orders""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    """Keys of customers, and of orders that are all there twice."""
    tables = shop(spark, d)
    tables["orders"] = tables["orders"].unionByName(tables["orders"])
    return relational.check_primary_keys(tables, SHOP).select("table", F.col("rows").alias("n"), "duplicates", "nulls", "passed")


@query(
    "j2_foreign_keys",
    """SELECT 'orders.o_custkey->customer.c_custkey' AS relationship, count(*) AS n, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) AS orphans FROM orders
UNION ALL SELECT 'lineitem.l_orderkey->orders.o_orderkey', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Orphans after customers in debt are gone."""
    return relational.check_foreign_keys(_cut_shop(spark, d), SHOP).select("relationship", F.col("rows").alias("n"), "orphans")


@query(
    "j3_cardinality",
    """WITH o AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey), l AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)
SELECT 'orders.o_custkey->customer.c_custkey' AS relationship, (SELECT count(DISTINCT c_custkey) FROM customer) AS parents, sum(c)::BIGINT AS children, max(c) AS max_children FROM o
UNION ALL SELECT 'lineitem.l_orderkey->orders.o_orderkey', (SELECT count(DISTINCT o_orderkey) FROM orders), sum(c)::BIGINT, max(c) FROM l""",
)
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Children for each parent."""
    return relational.check_cardinality(shop(spark, d), SHOP).select("relationship", "parents", "children", "max_children")


@query("j4_orphan_repair", _KEPT + "SELECT * FROM l")
def j4(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems that are left when the loss of customers cascades."""
    return relational.repair_orphans(_cut_shop(spark, d), SHOP)["lineitem"]


@query("j4_repair_report", _KEPT + """SELECT 'customer' AS "table", (SELECT count(*) FROM c) AS rows_before, (SELECT count(*) FROM c) AS rows_after UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM l)""")
def j4_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table before and after the repair."""
    tables = _cut_shop(spark, d)
    return relational.repair_report(tables, relational.repair_orphans(tables, SHOP)).drop("removed")


@query(
    "j5_relational_validation",
    _KEPT
    + """, k AS (SELECT 'customer' AS t, 'c_custkey' AS c, count(*) - count(DISTINCT c_custkey) AS d FROM c UNION ALL SELECT 'orders', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM o)
SELECT 'primary key' AS "check", t || '.' || c AS subject, d = 0 AS passed, d || ' duplicates, 0 nulls' AS detail FROM k
UNION ALL VALUES ('foreign key', 'orders.o_custkey->customer.c_custkey', true, '0 orphans'), ('foreign key', 'lineitem.l_orderkey->orders.o_orderkey', true, '0 orphans')
UNION ALL SELECT 'cardinality', 'orders.o_custkey->customer.c_custkey', abs(m - 10) <= 5, printf('%.4f children', m) FROM (SELECT (SELECT count(*) FROM o) / (SELECT count(*) FROM c) AS m)
UNION ALL SELECT 'cardinality', 'lineitem.l_orderkey->orders.o_orderkey', abs(m - 4) <= 2 AND top <= 7, printf('%.4f children', m) FROM (SELECT (SELECT count(*) FROM l) / (SELECT count(*) FROM o) AS m, (SELECT max(n) FROM (SELECT count(*) AS n FROM l GROUP BY l_orderkey)) AS top)""",
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    """All checks after the repair."""
    return relational.validate_relationships(_cut_shop(spark, d), SHOP)[1]


def _far_sql(columns: list[str]) -> tuple[str, str]:
    """(moments, test) of values within three standard deviations."""
    return ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns), " AND ".join(f"abs({c} - m_{c}) / s_{c} <= 3" for c in columns)


_CUST_M, _CUST_Z = _far_sql(["c_custkey", "c_nationkey", "c_acctbal"])
_ORD_M, _ORD_Z = _far_sql(["o_orderkey", "o_custkey"])
_LINE_M, _LINE_Z = _far_sql(_Z)
_VALID_SHOP = f"""WITH c0 AS (SELECT DISTINCT * FROM customer WHERE c_acctbal >= 0 AND c_custkey >= 0 AND c_nationkey BETWEEN 0 AND 24), cm AS (SELECT {_CUST_M} FROM c0), c AS (SELECT c0.* FROM c0, cm WHERE {_CUST_Z}),
o0 AS (SELECT DISTINCT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('F', 'O')), om AS (SELECT {_ORD_M} FROM o0), o AS (SELECT o0.* FROM o0, om WHERE {_ORD_Z} AND o_custkey IN (SELECT c_custkey FROM c)),
l0 AS (SELECT DISTINCT * FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 AND l_quantity BETWEEN 1 AND 48 AND l_extendedprice >= 0 AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.08 AND l_returnflag IN ('A', 'N', 'R') AND l_linestatus IN ('F', 'O') AND l_discount <= 0.08 AND NOT (l_quantity > 40 AND l_tax > 0.06)),
lm AS (SELECT {_LINE_M} FROM l0), l AS (SELECT l0.* FROM l0, lm WHERE {_LINE_Z} AND l_orderkey IN (SELECT o_orderkey FROM o)),
n AS (SELECT 'customer' AS t, (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM customer) AS b UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem))
"""
_J6_SQL = _VALID_SHOP + 'SELECT t AS "table", n AS "rows", round(100.0 * n / b, 4)::DOUBLE AS retention_pct FROM n'


@query(
    "j6_dataset_validation",
    _J6_SQL,
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after tables, then keys, are validated."""
    return jobs.validate_dataset(shop(spark, d), SHOP).manifest.select("table", "rows", "retention_pct")


# ---- privacy


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts by their type's group as table and reference, on two numeric columns."""
    df = table(spark, d, "part").select("p_size", "p_retailprice", "p_brand")
    side = drawn(42, "side", "p_brand") < 0.5
    return df.where(side).drop("p_brand"), df.where(~side).drop("p_brand")


_HALVES = f"""WITH h AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b, {draw_sql('side', 'p_brand')} < 0.5 AS own FROM part),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM h WHERE NOT own),
z AS (SELECT row_number() OVER () AS i, own, (a - ma) / sa AS a, (b - mb) / sb AS b FROM h, m),
q AS (SELECT x.i, x.own, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d FROM z x JOIN z y ON NOT y.own AND x.i <> y.i),
n AS (SELECT own, min(d) AS d1, list_sort(list(d))[2] AS d2 FROM q GROUP BY own, i)
"""


@query("p1_distances", _HALVES + """SELECT CASE WHEN own THEN 'table' ELSE 'reference' END AS side, count(*) AS n, round(min(d1), 9) AS dcr_min, round(avg(d1), 9) AS dcr_mean, round(quantile_cont(d1, 0.05), 9) AS dcr_p5, count(*) FILTER (d1 <= 1e-6) AS identical,
 count(*) FILTER (CASE WHEN d2 = 0 THEN 0 ELSE d1 / d2 END < 0.2) AS close FROM n GROUP BY own""")
def p1(spark: SparkSession, d: str) -> DataFrame:
    """Distances of parts of some brands to the nearest of the others."""
    got = privacy.distance_report(*_halves(spark, d))
    return got.withColumns({c: F.round(c, 9) for c in ("dcr_min", "dcr_mean", "dcr_p5")})


@query(
    "p2_exact_copies",
    """WITH t AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_quantity, l_discount)
SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS n, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND (l_quantity, l_discount) IN (SELECT (l_quantity, l_discount) FROM t)) AS copies, (SELECT sum(c)::BIGINT FROM g) AS reference_rows, (SELECT sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT FROM g) AS reference_duplicates""",
)
def p2(spark: SparkSession, d: str) -> DataFrame:
    """Accepted lineitems that equal a returned one in quantity and discount."""
    df = table(spark, d, "lineitem")
    return privacy.exact_copies(df.where("l_returnflag = 'A'"), df.where("l_returnflag = 'R'"), ["l_quantity", "l_discount"]).withColumnRenamed("rows", "n")


_FLAGS = "l_quantity", "l_extendedprice", "l_discount"


def _whole_sql() -> str:
    points = ", ".join(f"({c} - avg({c}) FILTER (f = 'R') OVER ()) / stddev_pop({c}) FILTER (f = 'R') OVER () AS v{k}" for k, c in enumerate(_FLAGS))
    far = " + ".join(f"(x.v{k} - y.v{k}) ** 2" for k in range(len(_FLAGS)))
    return f"""WITH h AS (SELECT l_returnflag AS f, {', '.join(_FLAGS)} FROM lineitem WHERE l_returnflag IN ('A', 'R')), z AS (SELECT row_number() OVER () AS i, f, {points} FROM h),
q AS (SELECT x.f, x.i, min({far}, 2) AS d FROM z x JOIN z y ON y.f = 'R' AND x.i <> y.i GROUP BY x.f, x.i), n AS (SELECT f, sqrt(d[1]) AS d1, sqrt(d[2]) AS d2 FROM q)
SELECT CASE f WHEN 'A' THEN 'table' ELSE 'reference' END AS side, count(*) AS n, round(min(d1), 9) AS dcr_min, round(avg(d1), 9) AS dcr_mean, round(quantile_cont(d1, 0.05), 9) AS dcr_p5, count(*) FILTER (d1 <= 1e-6) AS identical,
 count(*) FILTER (CASE WHEN d2 = 0 THEN 0 ELSE d1 / d2 END < 0.2) AS close FROM n GROUP BY f"""


@query("p1_whole_reference", _whole_sql())
def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all accepted lineitems to the nearest of all returned ones, and of these to each other."""
    df = table(spark, d, "lineitem")
    got = privacy.distance_report(df.where("l_returnflag = 'A'"), df.where("l_returnflag = 'R'"), list(_FLAGS), max_reference=None)
    return got.withColumns({c: F.round(c, 9) for c in ("dcr_min", "dcr_mean", "dcr_p5")})


_RISK = _HALVES + """, g AS (SELECT own, count(*) AS n, quantile_cont(d1, 0.05) AS p5, count(*) FILTER (d1 <= 1e-6) AS same, count(*) FILTER (CASE WHEN d2 = 0 THEN 0 ELSE d1 / d2 END < 0.2) AS close FROM n GROUP BY own),
t AS (SELECT * FROM g WHERE own), b AS (SELECT * FROM g WHERE NOT own),
e AS (SELECT count(*) FILTER (own AND (a, b) IN (SELECT (a, b) FROM h WHERE NOT own)) AS copies, count(*) FILTER (NOT own) AS base, coalesce((SELECT sum(c) FROM (SELECT count(*) AS c FROM h WHERE NOT own GROUP BY a, b) WHERE c > 1), 0) AS repeats FROM h),
k AS (SELECT 'identical' AS "check", greatest(copies, t.same) AS k, t.n AS n, repeats AS bk, base AS bn, greatest(copies, t.same) > 0 AND repeats = 0 AS sure FROM e, t UNION ALL SELECT 'close', t.close, t.n, b.close, b.n, false FROM t, b),
r AS (SELECT *, k / n - bk / bn AS excess, sqrt((k + bk) / (n + bn) * (1 - (k + bk) / (n + bn)) * (1 / n + 1 / bn)) AS error FROM k),
l AS (SELECT "check", CASE WHEN sure OR excess > greatest(3 * error, 0.01) THEN 'HIGH' WHEN excess > greatest(2 * error, 0.005) THEN 'MEDIUM' ELSE 'LOW' END AS level, k / n AS value, bk / bn AS baseline FROM r
  UNION ALL SELECT 'distance_p5', CASE WHEN t.p5 < 0.8 * b.p5 THEN 'MEDIUM' ELSE 'LOW' END, t.p5, b.p5 FROM t, b)
"""
_P3_SQL = _RISK + """SELECT "check", level, round(value, 9) AS value, round(baseline, 9) AS baseline FROM l
UNION ALL SELECT 'overall', max_by(level, list_position(['LOW', 'MEDIUM', 'HIGH'], level)), NULL, NULL FROM l"""


@query("p3_risk", _P3_SQL)
def p3(spark: SparkSession, d: str) -> DataFrame:
    """The privacy verdict on parts."""
    got = privacy.privacy_risk(*_halves(spark, d))
    return got.withColumns({c: F.round(c, 9) for c in ("value", "baseline")})


@query(
    "p4_divergence",
    f"""WITH r AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_returnflag = 'R'), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{', '.join(str(k / 20) for k in range(21))}]))) AS e FROM r),
b AS (SELECT len([k FOR k IN e[2:len(e) - 1] IF k <= l_extendedprice]) AS bin, count(*) FILTER (l_returnflag = 'A') AS p, count(*) FILTER (l_returnflag = 'R') AS q FROM lineitem, e WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM b)
SELECT 'l_extendedprice' AS "column", round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 7) AS distance FROM s""",
)
def p4(spark: SparkSession, d: str) -> DataFrame:
    """How far prices of accepted items are from those of returned ones."""
    df = table(spark, d, "lineitem")
    return privacy.divergence(df.where("l_returnflag = 'A'"), df.where("l_returnflag = 'R'"), ["l_extendedprice"]).select("column", F.round("distance", 7).alias("distance"))


@query("p5_identifiers", "SELECT 'age' AS \"column\", 'ages over 89' AS category, count(*) || ' rows' AS detail FROM customer WHERE c_custkey % 110 > 89 UNION ALL VALUES ('c_name', 'names', 'column name'), ('email_address', 'geography', 'column name'), ('email_address', 'email addresses', 'column name')")
def p5(spark: SparkSession, d: str) -> DataFrame:
    """Columns of customers that look like identifiers, and old ages."""
    df = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 110).alias("age"), F.lit("x").alias("email_address"))
    return privacy.identifier_findings(df)


@query(
    "p6_date_shift",
    f"""WITH t AS (SELECT l_orderkey, o_orderdate, l_shipdate, floor({draw_sql('shift', 'o_custkey')} * 336) + 30 AS size, {draw_sql('shift back', 'o_custkey')} < 0.5 AS back FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT l_orderkey, o_orderdate + to_days((CASE WHEN back THEN -size ELSE size END)::INT) AS o_orderdate, l_shipdate + to_days((CASE WHEN back THEN -size ELSE size END)::INT) AS l_shipdate FROM t""",
)
def p6(spark: SparkSession, d: str) -> DataFrame:
    """All dates of a customer moved by the same days."""
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "o_custkey", "o_orderdate", "l_shipdate")
    return privacy.shift_dates(both, ["o_orderdate", "l_shipdate"], "o_custkey").drop("o_custkey")


@query("p7_age_cap", "SELECT c_custkey, CASE WHEN c_custkey % 110 > 89 THEN 90 ELSE c_custkey % 110 END AS age FROM customer")
def p7(spark: SparkSession, d: str) -> DataFrame:
    """Ages above 89 become 90."""
    return privacy.cap_ages(table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 110).alias("age")), "age")


_JENSEN_SHANNON = "sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0))"


@query(
    "p8_privacy_audit",
    _RISK
    + f""", v AS (SELECT own, 'p_size' AS c, a AS x FROM h UNION ALL SELECT own, 'p_retailprice', b FROM h),
cuts AS (SELECT c, list_sort(list_distinct(quantile_cont(x, [{', '.join(str(k / 20) for k in range(21))}]))) AS edges FROM v WHERE NOT own GROUP BY c),
bins AS (SELECT c, len([k FOR k IN edges[2:len(edges) - 1] IF k <= x]) AS bin, count(*) FILTER (own) AS p, count(*) FILTER (NOT own) AS q FROM v JOIN cuts USING (c) GROUP BY 1, 2),
shares AS (SELECT c, p / sum(p) OVER (PARTITION BY c) AS p, q / sum(q) OVER (PARTITION BY c) AS q FROM bins),
far AS (SELECT avg(d) AS d FROM (SELECT {_JENSEN_SHANNON} AS d FROM shares GROUP BY c)),
found AS (SELECT "check", level, value FROM l
  UNION ALL SELECT 'overall', max_by(level, list_position(['LOW', 'MEDIUM', 'HIGH'], level)), NULL FROM l
  UNION ALL SELECT 'copies', CASE WHEN copies = 0 THEN 'passed' ELSE 'found' END, copies / (SELECT count(*) FROM h WHERE own) FROM e
  UNION ALL SELECT 'divergence', CASE WHEN d < 0.1 THEN 'LOW' WHEN d < 0.3 THEN 'MEDIUM' ELSE 'HIGH' END, d FROM far
  UNION ALL SELECT 'identifiers', CASE WHEN n = 0 THEN 'passed' ELSE 'found' END, n FROM (SELECT count(*)::DOUBLE AS n FROM (VALUES ('p_size'), ('p_retailprice')) names(c) WHERE regexp_matches(c, 'name|mail|phone|ssn|addr')))
SELECT 'part' AS "table", "check", level, round(value, 7) AS value FROM found""",
)
def p8(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit of parts of some brands against the others."""
    own, ref = _halves(spark, d)
    return privacy.audit({"part": own}, {"part": ref}, "part").withColumn("value", F.round("value", 7))


# ---- generation


def _like(spark: SparkSession, d: str, name: str, key: str | None = None, **more: object) -> Contract:
    return jobs.contract_like(table(spark, d, name), key, **more)


def ppf_sql(p: str) -> str:
    """The normal quantile of functions.ranks."""
    a, b, c, d = ([f"({x!r}::DOUBLE)" for x in part] for part in ACKLAM)

    def poly(parts: list[str], x: str) -> str:
        out = parts[0]
        for k in parts[1:]:
            out = f"({out} * {x} + {k})"
        return out

    tail = lambda x: f"({poly(c, x)} / {poly(d, x)})"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    middle = f"({p} - 0.5)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -{tail(high)} ELSE {middle} * {poly(a, f'({middle} * {middle})')} / {poly(b, f'({middle} * {middle})')} END"


def _money(x: str) -> str:
    return f"round_even({x}, 2)"


def _whole(x: str) -> str:
    return f"round_even({x}, 0)::BIGINT"


def _drawn(names: dict[str, str], rows: str, seed: int = 42) -> str:
    """Rows 0, 1, ... of ``rows`` (a count) with the draws of generation by name: column -> label."""
    return draws_sql(f"(SELECT unnest(range({rows})) AS row)", "row", {name: (seed, label) for name, label in names.items()})


def _category(c: str, categories: str, edges: list[float]) -> str:
    return f"({categories})[1 + len([e FOR e IN {[float(e) for e in edges[:-1]]}::DOUBLE[] IF e <= {c}])]"


def _edges(name: str, n: int) -> list[float]:
    return generate.category_edges(C(name, "category", categories=tuple(map(str, range(n)))), 42)


_ORDERS_LIKE = f"""
WITH s AS (SELECT count(*) AS n, min(o_custkey)::DOUBLE AS c0, max(o_custkey)::DOUBLE AS c1, min(o_totalprice) AS p0, max(o_totalprice) AS p1,
  date_trunc('day', min(o_orderdate)) AS d0, date_trunc('day', max(o_orderdate)) AS d1,
  list_sort(list(DISTINCT o_orderstatus)) AS states, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders),
u AS ({_drawn({c: c for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "flag", "note")}, "(SELECT count(*) FROM orders)")})
"""
_DAY = "s.d0 + floor(u.o_orderdate * date_diff('second', s.d0, s.d1)::DOUBLE)::BIGINT * INTERVAL 1 SECOND AS o_orderdate"
_PRIORITY = f"{_category('u.o_orderpriority', 's.priorities', _edges('o_orderpriority', 5))} AS o_orderpriority"


@query(
    "g1_generate",
    f"""{_ORDERS_LIKE}
SELECT row + 1 AS o_orderkey, {_whole('s.c0 + (s.c1 - s.c0) * u.o_custkey')} AS o_custkey, {_category('u.o_orderstatus', 's.states', _edges('o_orderstatus', 3))} AS o_orderstatus,
  {_money('s.p0 + (s.p1 - s.p0) * u.o_totalprice')} AS o_totalprice, {_DAY}, {_PRIORITY} FROM u, s
""",
)
def g1(spark: SparkSession, d: str) -> DataFrame:
    """As many orders as there are, drawn from a contract like theirs."""
    contract = _like(spark, d, "orders", "o_orderkey")
    loose = Contract(tuple(c if c.name != "o_orderkey" else C(c.name, "int", 1) for c in contract.columns), contract.row_count, contract.seed, primary_key="o_orderkey")
    return generate.generate(spark, loose)


#: Columns of the distributions that SQL can draw, and the mean of those that it cannot.
DRAWN = (
    C("normal", "float", dist="normal", mean=50.0, std=8.0),
    C("uniform", "float", 10, 30, "uniform"),
    C("lognormal", "float", dist="lognormal", mean=200.0, std=60.0),
    C("exponential", "float", dist="exponential", mean=12.0),
    C("pareto", "float", 5, 400, "pareto", shape=2.5),
    C("poisson", "int", dist="poisson", mean=4.0),
    C("zip", "int", dist="zip", mean=3.0, zero_prob=0.6),
)
TABLED = {
    "gamma": (C("gamma", "float", dist="gamma", shape=2.5, scale=1500.0), 3750.0),
    "tweedie": (C("tweedie", "float", dist="tweedie", mean=250.0, p_index=1.65, scale=2.0), 250.0),
}
_SIGMA = math.sqrt(math.log1p((60.0 / 200.0) ** 2))


def _counts(u: str, mean: float) -> str:
    return f"len([e FOR e IN {[float(e) for e in generate.poisson_table(mean)]}::DOUBLE[] IF e < {u}])::BIGINT"


@query(
    "g2_distributions",
    f"""
WITH u AS ({_drawn({c.name: c.name for c in DRAWN}, "(SELECT count(*) FROM orders)")})
SELECT {_money(f"50 + 8 * ({ppf_sql('u.normal')})")} AS normal, {_money("10 + 20 * u.uniform")} AS uniform,
  {_money(f"exp({math.log(200.0) - _SIGMA * _SIGMA / 2!r}::DOUBLE + {_SIGMA!r}::DOUBLE * ({ppf_sql('u.lognormal')}))")} AS lognormal,
  {_money("-12 * ln(1 - u.exponential)")} AS exponential, {_money("least(400, 5 * pow(1 - u.pareto, -0.4::DOUBLE))")} AS pareto,
  {_counts("u.poisson", 4.0)} AS poisson, CASE WHEN u.zip < 0.6 THEN 0 ELSE {_counts("((u.zip - 0.6::DOUBLE) / 0.4::DOUBLE)", 3.0)} END AS zip FROM u
""",
)
def g2(spark: SparkSession, d: str) -> DataFrame:
    """The distributions of the contract language, drawn as often as there are orders."""
    return generate.generate(spark, Contract(DRAWN, table(spark, d, "orders").count()))


@query("g2_gamma_tweedie", "SELECT d AS distribution, (SELECT count(*) FROM orders) AS n, true AS mean_close FROM (VALUES ('gamma'), ('tweedie')) v(d)")
def g2_tabled(spark: SparkSession, d: str) -> DataFrame:
    """Gamma and tweedie drawn as often as there are orders, with the mean that their formula has."""
    n = table(spark, d, "orders").count()
    made = generate.generate(spark, Contract(tuple(c for c, _ in TABLED.values()), n))
    got = made.agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in TABLED], *[F.stddev_samp(k).alias(f"s_{k}") for k in TABLED]).first()
    rows = [(k, got["n"], abs(got[k] - mean) <= 5 * got[f"s_{k}"] / got["n"] ** 0.5 + 0.01) for k, (_, mean) in TABLED.items()]
    return spark.createDataFrame(rows, "distribution string, n long, mean_close boolean")


@query("g3_g6_columns", f"{_ORDERS_LIKE} SELECT u.flag > 1 - 0.3::DOUBLE AS flag, {_PRIORITY}, {_DAY}, 'NOTE_' || lpad(floor(u.note * least(500, greatest(10, s.n // 2)))::BIGINT::VARCHAR, 4, '0') AS note FROM u, s")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """Bool, category, date and text columns drawn from a contract like that of orders."""
    contract = _like(spark, d, "orders")
    cols = (C("flag", "bool", target_ratio=0.3), contract["o_orderpriority"], contract["o_orderdate"], C("note", "str"))
    return generate.generate(spark, Contract(cols, contract.row_count))


@query("g7_primary_key", "SELECT count(*) AS n, count(*) AS n_distinct, 'SKU_000001' AS first, 'SKU_' || lpad(count(*)::VARCHAR, 6, '0') AS last FROM part")
def g7(spark: SparkSession, d: str) -> DataFrame:
    """Text keys for as many rows as there are parts."""
    n = table(spark, d, "part").count()
    made = generate.generate(spark, Contract((C("sku", "str"), C("price", "float", 1, 9)), n, primary_key="sku"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("sku").alias("n_distinct"), F.min("sku").alias("first"), F.max_by("sku", F.struct(F.length("sku"), "sku")).alias("last"))


CORRELATED = (
    C("basket", "float", 0, 100_000, "lognormal", mean=200.0, std=120.0),
    C("items", "int", 0, 60, "poisson", mean=5.0),
    C("shipping", "float", 0, 60, "normal", mean=10.0, std=5.0),
    C("returned", "bool", target_ratio=0.05),
)
WANTED = (Correlation("basket", "items", "+", 0.5), Correlation("basket", "shipping", "+", 0.4), Correlation("basket", "returned", "+", 0.2))


@query("g8_g9_correlated", "SELECT (SELECT count(*) FROM lineitem) AS n, a, b, true AS passed FROM (VALUES ('basket', 'items'), ('basket', 'shipping'), ('basket', 'returned')) v(a, b)")
def g8(spark: SparkSession, d: str) -> DataFrame:
    """Correlated columns, one of them two-class, for as many rows as there are lineitems."""
    contract = Contract(CORRELATED, table(spark, d, "lineitem").count(), correlations=WANTED)
    made = generate.generate(spark, contract)
    n = made.count()
    return stats.correlation_check(made, contract).select(F.lit(n).cast("long").alias("n"), "a", "b", "passed")


_REORDER = (["o_totalprice", "o_custkey"], {("o_custkey", "o_totalprice"): 0.7})


def _reorder_sql() -> str:
    columns, pairs = _REORDER
    factor = generate.reorder_factor(columns, pairs)
    drawn_ = draws_sql(f"(SELECT o_orderkey, {', '.join(columns)} FROM orders)", "o_orderkey", {f"n{k}": (42, f"reorder {c}") for k, c in enumerate(columns)})
    noise = ", ".join(f"{ppf_sql(f'n{k}')} AS z{k}" for k in range(len(columns)))
    mixes = [" + ".join(f"{float(factor[k, j])!r}::DOUBLE * z{j}" for j in range(k + 1)) for k in range(len(columns))]
    ranks_ = ", ".join(f"row_number() OVER (ORDER BY {mix}, o_orderkey) AS r{k}" for k, mix in enumerate(mixes))
    values = " ".join(f"JOIN (SELECT {c}, row_number() OVER (ORDER BY {c} NULLS FIRST, o_orderkey) AS r FROM orders) v{k} ON s.r{k} = v{k}.r" for k, c in enumerate(columns))
    return f"WITH u AS ({drawn_}), z AS (SELECT *, {noise} FROM u), s AS (SELECT o_orderkey, {ranks_} FROM z) SELECT s.o_orderkey, {', '.join(f'v{k}.{c}' for k, c in enumerate(columns))} FROM s {values}"


@query("g8_reorder", _reorder_sql())
def g8_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Prices and customers of given orders correlated by reordering; their values stay the same."""
    return generate.reorder(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey", *_REORDER)


_SHOP_DRAWS = {c: c for c in ("total", "paid", "units", "gifts", "placed", "sent", "due")} | {f"fix_{c}": f"repair {c}" for c in ("paid", "gifts", "sent")}
_JAN, _JUN, _DEC = 1_704_067_200, 1_719_705_600, 1_735_603_200


def _mended(old: str, low: str, high: str, fix: str, grid: str) -> str:
    """A value beyond one end of [low, high] mirrored there or, if that leaves the interval, drawn from it."""
    m = f"(CASE WHEN {old} > {high} THEN 2 * {high} - {old} ELSE 2 * {low} - {old} END)"
    return grid.format(f"(CASE WHEN {m} BETWEEN {low} AND {high} THEN {m} ELSE {low} + ({high} - {low}) * {fix} END)")


_CENTS = "(floor(round({} * 100, 6)) / 100)"


@query(
    "g10_rule_repair",
    f"""
WITH u AS ({_drawn(_SHOP_DRAWS, "(SELECT count(*) FROM orders)")}),
v AS (SELECT row, fix_paid, fix_gifts, fix_sent, {_money("1000 * total")} AS total, {_money("1000 * paid")} AS paid, {_whole("1 + 49 * units")} AS units, {_whole("50 * gifts")} AS gifts,
  1e6 * ({_JAN} + floor(placed * {_JUN - _JAN}::DOUBLE)) AS placed, 1e6 * ({_JAN} + floor(sent * {_DEC - _JAN}::DOUBLE)) AS sent FROM u),
w AS (SELECT *, {_CENTS.format("total")} AS top, least(units - 1, 50)::DOUBLE AS most FROM v),
x AS (SELECT *, CASE WHEN paid <= total THEN paid ELSE {_mended("paid", "0", "top", "fix_paid", _CENTS)} END AS paid2,
  CASE WHEN gifts < units THEN gifts ELSE {_mended("gifts", "0", "most", "fix_gifts", "floor({})")}::BIGINT END AS gifts2,
  CASE WHEN sent >= placed THEN sent ELSE {_mended("sent", "placed", f"{_DEC}e6::DOUBLE", "fix_sent", "floor({})")} END AS sent2 FROM w)
SELECT total, paid2 AS paid, units, gifts2 AS gifts, make_timestamp(placed::BIGINT) AS placed, make_timestamp(sent2::BIGINT) AS sent, {_CENTS.format("(total - paid2 + 0.005)")} AS due FROM x
""",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Generated rows whose values are changed, along the graph of the rules, so that rules of several forms hold."""
    cols = (C("total", "float", 0, 1000), C("paid", "float", 0, 1000), C("units", "int", 1, 50), C("gifts", "int", 0, 50), C("placed", "datetime", description="from 2024-01-01 to 2024-06-30"), C("sent", "datetime", description="from 2024-01-01 to 2024-12-31"), C("due", "float"))
    rules = ("due == total - paid", "paid <= total", "gifts < units", "sent >= placed")
    return generate.generate(spark, Contract(cols, table(spark, d, "orders").count(), rules=rules))


def _small_shop(n: int) -> Dataset:
    tables = {
        "customers": Contract((C("customer_id", "int", 1), C("tenure", "int", 0, 120)), n, primary_key="customer_id"),
        "orders": Contract((C("order_id", "int", 1), C("customer_id", "int", 1), C("amount", "float", 0, dist="gamma", shape=2.0, scale=40.0)), primary_key="order_id"),
        "items": Contract((C("item_id", "int", 1), C("order_id", "int", 1), C("price", "float", 0, 100)), primary_key="item_id"),
    }
    links = (Relationship("customers", "customer_id", "orders", "customer_id", 2.5, 1, 5), Relationship("orders", "order_id", "items", "order_id", 2.0, 1, 4))
    return Dataset(tables, "customers", links)


@query("g11_linked_tables", "SELECT 'customers' AS \"table\", count(*) AS roots, 0::BIGINT AS orphans, 0::BIGINT AS duplicates, true AS within FROM customer UNION ALL SELECT 'orders', count(*), 0, 0, true FROM customer UNION ALL SELECT 'items', count(*), 0, 0, true FROM customer")
def g11(spark: SparkSession, d: str) -> DataFrame:
    """Linked tables for as many customers as there are: no orphans, unique keys, children within limits."""
    n = table(spark, d, "customer").count()
    dataset = _small_shop(n)
    made = {name: materialised(df, name) for name, df in generate.generate_dataset(spark, dataset, n).items()}
    fk = {r["relationship"].split(".")[0]: r["orphans"] for r in relational.check_foreign_keys(made, dataset).collect()}
    pk = {r["table"]: r["duplicates"] for r in relational.check_primary_keys(made, dataset).collect()}
    card = {r["relationship"].split(".")[0]: r for r in relational.check_cardinality(made, dataset).collect()}
    limits = {r.child: (r.min_per_parent, r.max_per_parent) for r in dataset.relationships}
    rows = [(t, made["customers"].count(), fk.get(t, 0), pk[t], t not in card or limits[t][0] <= card[t]["min_children"] and card[t]["max_children"] <= limits[t][1]) for t in dataset.tables]
    return spark.createDataFrame(rows, "table string, roots long, orphans long, duplicates long, within boolean")


@query("w2_build_dataset", "SELECT 'customers' AS \"table\", true AS keys_hold FROM customer GROUP BY 1 UNION ALL VALUES ('orders', true), ('items', true)")
def w2(spark: SparkSession, d: str) -> DataFrame:
    """Linked tables generated, cleaned, repaired, checked and written."""
    n = table(spark, d, "customer").count()
    done = jobs.build_dataset(spark, _small_shop(n), n, work_path(spark, "w2"))
    bad = done.integrity.where("check <> 'cardinality' AND NOT passed").count()
    return done.manifest.select("table", F.lit(bad == 0).alias("keys_hold"))


# ---- enrichment


@query(
    "e1_event_times",
    f"""WITH w AS (SELECT {list(enrich.HOUR_WEIGHTS)} AS w),
u AS (SELECT o_orderkey, {draw_sql('day', 'o_orderkey')} AS d, {draw_sql('hour', 'o_orderkey')} AS h, {draw_sql('second', 'o_orderkey')} AS s FROM orders)
SELECT o_orderkey, DATE '2024-01-01' + to_days(floor(d * 91)::INT) + to_hours(len([k FOR k IN range(1, 24) IF h >= list_sum(w[:k])::DOUBLE / list_sum(w)])) + to_seconds(floor(s * 3600)) AS event_time FROM u, w""",
)
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Random times for orders: more by day than by night."""
    df = enrich.with_event_times(table(spark, d, "orders"), "o_orderkey", "2024-01-01", "2024-03-31", entity_column="o_custkey")
    return df.select("o_orderkey", "event_time")


@query(
    "e2_velocity",
    """WITH t AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT event_id, round(greatest(coalesce(gap / 1e6, 86400.0), 0), 1)::DOUBLE AS seconds_since_last, round(greatest(coalesce(gap / 1e6, 86400.0), 0), 1) < 3600 AS is_high_velocity FROM t""",
)
def e2(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since each user's previous event."""
    return enrich.with_velocity(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "seconds_since_last", "is_high_velocity")


@query(
    "e3_bursts",
    f"""WITH p AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
r AS (SELECT event_id, row_number() OVER (ORDER BY {bits_sql('burst', 'event_id')}, event_id) AS k FROM p WHERE previous IS NOT NULL),
h AS (SELECT p.*, coalesce(r.k <= round_even((SELECT count(*) FROM events) * 0.02, 0), false) AS is_burst FROM p LEFT JOIN r USING (event_id))
SELECT event_id, is_burst, CASE WHEN is_burst THEN previous + to_seconds(4 + floor({draw_sql('burst gap', 'event_id')} * 22)::BIGINT) ELSE ts END AS ts FROM h""",
)
def e3(spark: SparkSession, d: str) -> DataFrame:
    """Two percent of the events moved to seconds after the previous one."""
    return enrich.with_bursts(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "is_burst", "ts")


@query("e4_time_summary", "SELECT count(*) AS n, count(DISTINCT user_id) AS entities, min(ts) AS first, max(ts) AS last, 0::BIGINT AS out_of_order FROM events")
def e4(spark: SparkSession, d: str) -> DataFrame:
    """A summary of events in time order, and how many rows of the ordered table come before the one ahead of them."""
    df = enrich.chronological(table(spark, d, "events"), "ts", "event_id")
    wrong = F.lit(enrich.out_of_order(df, "ts", "event_id")).cast("long").alias("out_of_order")
    return enrich.time_summary(df, "user_id", "ts").select(F.col("rows").alias("n"), "entities", "first", "last", wrong)


@query("e5_ratios", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE round(l_extendedprice / (l_discount / 12), 4) END AS amount_to_income_ratio, round(l_extendedprice / l_linenumber, 4) AS amount_to_limit_ratio FROM lineitem")
def e5(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of prices to two other columns; zero denominators give 0."""
    return enrich.with_ratios(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", "l_linenumber").select("l_orderkey", "l_linenumber", "amount_to_income_ratio", "amount_to_limit_ratio")


@query("e6_bands", "SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'UNKNOWN' WHEN p_size < 30 THEN 'YOUNG' WHEN p_size < 50 THEN 'ADULT' WHEN p_size < 65 THEN 'MIDDLE_AGE' ELSE 'SENIOR' END AS age_group, CASE WHEN p_retailprice IS NULL THEN 'UNKNOWN' WHEN p_retailprice < 580 THEN 'POOR' WHEN p_retailprice < 670 THEN 'FAIR' WHEN p_retailprice < 740 THEN 'GOOD' WHEN p_retailprice < 800 THEN 'VERY_GOOD' ELSE 'EXCELLENT' END AS credit_rating FROM part")
def e6(spark: SparkSession, d: str) -> DataFrame:
    """Bands of two columns of parts."""
    return enrich.with_bands(table(spark, d, "part"), "p_size", "p_retailprice").select("p_partkey", "age_group", "credit_rating")


@query("e7_time_parts", "SELECT event_id, extract(hour FROM ts)::INT AS hour_of_day, dayname(ts) AS day_name, isodow(ts) >= 6 AS is_weekend, extract(hour FROM ts) BETWEEN 0 AND 5 AS is_night FROM events")
def e7(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the events' times."""
    return enrich.with_time_parts(table(spark, d, "events"), "ts").select("event_id", "hour_of_day", "day_name", "is_weekend", "is_night")


@query("e8_risk_flag", "SELECT l_orderkey, l_linenumber, l_linenumber >= 2 AND l_extendedprice > 2 * (SELECT median(l_extendedprice) FROM lineitem) AS high_risk_combo FROM lineitem")
def e8(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems with a late number and a price above twice the median."""
    return enrich.with_risk_flag(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice").select("l_orderkey", "l_linenumber", "high_risk_combo")


@query(
    "e9_fraud",
    f"""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS s, round_even(count(*) * 0.03, 0) AS n FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY {bits_sql('fraud', 'o_orderkey')}, o_orderkey) AS k FROM orders)
SELECT o_orderkey, (k <= n)::INT AS is_fraud, CASE WHEN k <= n THEN round(a + (4.5 + 4.5 * {draw_sql('fraud amount', 'o_orderkey')}) * s, 2) ELSE o_totalprice END AS o_totalprice FROM r, m""",
)
def e9(spark: SparkSession, d: str) -> DataFrame:
    """Three percent of the orders turned into labelled fraud with high prices."""
    return enrich.inject_fraud(table(spark, d, "orders"), "o_orderkey", 0.03, amount="o_totalprice").select("o_orderkey", "is_fraud", "o_totalprice")


@query("e10_noise", "SELECT count(*) AS n, round_even(count(*) * 0.05, 0)::BIGINT AS corrupted, 0::BIGINT AS unexplained, 0::BIGINT AS keys_changed FROM customer")
def e10(spark: SparkSession, d: str) -> DataFrame:
    """Five percent of the customers corrupted, each with its details; keys stay."""
    df = table(spark, d, "customer")
    out = materialised(enrich.with_noise(df, "c_custkey"), "noise")
    lost = out.join(df.select("c_custkey"), "c_custkey", "left_anti").count()
    return out.agg(F.count("*").alias("n"), F.count_if("is_corrupted").alias("corrupted"), F.count_if(F.col("is_corrupted") != (F.col("corruption_details") != "")).alias("unexplained"), F.lit(lost).cast("long").alias("keys_changed"))


@query("e11_pipeline_order", _VALID_SHOP + "SELECT t AS \"table\", n, CASE WHEN t = 'customer' THEN round_even(n * 0.05, 0)::BIGINT ELSE 0 END AS corrupted FROM n")
def e11(spark: SparkSession, d: str) -> DataFrame:
    """Features before validation, noise after it, on chosen tables."""
    steps = [jobs.Step("time parts", lambda x: enrich.with_time_parts(x, "o_orderdate"), ("orders",))]
    noise = [jobs.Step("noise", lambda x: enrich.with_noise(x, "c_custkey"), ("customer",))]
    done = jobs.run_steps(shop(spark, d), steps, SHOP, noise)
    counts = [(n, x.count(), x.where("is_corrupted").count() if "is_corrupted" in x.columns else 0) for n, x in done.tables.items()]
    return spark.createDataFrame(counts, "table string, n long, corrupted long")


@query("w3_fraud_benchmark")
def w3(spark: SparkSession, d: str) -> DataFrame:
    """A labelled benchmark from events: fraud, bursts, velocity, validation, noise and a split."""
    df = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("amount"))
    contract = Contract((C("event_id", "int", 0), C("user_id", "int", 0), C("ts", "datetime"), C("amount", "float", 0)), preserve_column="is_fraud", preserve_value=1)
    rows = jobs.fraud_benchmark(df, contract, "event_id", "user_id", "ts")["rows"]
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("is_fraud") == 1).alias("frauds"), F.count_if("is_corrupted").alias("corrupted"))


# ---- training sets


@query("t1_random_split", f"SELECT event_id, CASE WHEN {draw_sql('split', 'event_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM events")
def t1(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the events, by a hash of their key."""
    return prepare.random_split(table(spark, d, "events"), "event_id").select("event_id", "split")


@query("t1_temporal_split", "SELECT event_id, CASE WHEN epoch_us(ts) > (SELECT quantile_cont(epoch_us(ts), 0.8) FROM events) THEN 'test' ELSE 'train' END AS split FROM events")
def t1_temporal(spark: SparkSession, d: str) -> DataFrame:
    """The latest fifth of the events."""
    return prepare.temporal_split(table(spark, d, "events"), "ts").select("event_id", "split")


@query("t1_group_split", f"SELECT event_id, user_id, CASE WHEN {draw_sql('split', 'user_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM events")
def t1_group(spark: SparkSession, d: str) -> DataFrame:
    """All events of a user on one side."""
    return prepare.group_split(table(spark, d, "events"), "user_id").select("event_id", "user_id", "split")


@query("t2_leakage", "SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)")
def t2(spark: SparkSession, d: str) -> DataFrame:
    """Columns that give the target away are removed."""
    df = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return prepare.without_leakage(df, ["quality"], "toxic")


@query("t3_class_balance", "SELECT 'quality' AS target, 0.85::DOUBLE AS planned, round(avg(quality), 9) AS measured, abs(avg(quality) - 0.85) <= 0.02 AS passed FROM labels")
def t3(spark: SparkSession, d: str) -> DataFrame:
    """The share of good documents against the planned one."""
    return prepare.class_balance(table(spark, d, "labels"), "quality", 0.85).withColumn("measured", F.round("measured", 9))


@query("exact_selection", f"SELECT o_orderkey FROM orders ORDER BY {bits_sql('pick', 'o_orderkey', 7)}, o_orderkey LIMIT 1000")
def exact_selection(spark: SparkSession, d: str) -> DataFrame:
    """Exactly so many rows chosen by seeded hashes."""
    df = table(spark, d, "orders")
    return df.where(exactly(df, 1000, 7, "pick", "o_orderkey")).select("o_orderkey")


