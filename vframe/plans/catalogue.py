"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL where SQL can express them.

The tables hold no nulls, so ``holed`` makes every seventh value null, by key, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vframe.functions import caps
from vframe.functions import text as text_functions
from vframe.operators import fit, profile
from vframe.operators.apply import op_of
from vframe.plans import summary
from vframe.plans.specs import Node, Step, dumps, loads
from vframe.plans.store import VersionStore
from vframe.sources import io
from vframe.streaming.replay import apply_chain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def holed(column: str, key: str) -> str:
    return f"CASE WHEN {key} % 7 = 0 THEN NULL ELSE {column} END AS {column}"


def holed_frame(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str], others: list[str] = ()) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(key, *others, *[holed(c, key) for c in columns])


def holed_sql(name: str, key: str, columns: list[str], others: list[str] = ()) -> str:
    return f"(SELECT {', '.join([key, *others, *[holed(c, key) for c in columns]])} FROM {name})"


def one(column: str, op: str, value: object = None) -> list[dict]:
    return [{"logic": "and", "conditions": [{"column": column, "op": op, "value": value}]}]


# Projections and filters.

LINE = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("scan_project", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.transform(op_of(fit.drop_columns(df, ["l_suppkey", "l_shipdate"])))


def _filters() -> None:
    signs = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "=", "ne": "<>"}
    for op, sign in signs.items():

        def run(spark: SparkSession, sf_dir: str, op: str = op) -> DataFrame:
            df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
            return df.transform(op_of(fit.filter_rows(df, one("l_quantity", op, 25))))

        query(f"filter_keep_{op}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {sign} 25")(run)
    orders = holed_sql("orders", "o_orderkey", ["o_totalprice"])
    for op, sign in {"is_null": "IS NULL", "is_not_null": "IS NOT NULL"}.items():

        def run(spark: SparkSession, sf_dir: str, op: str = op) -> DataFrame:
            df = holed_frame(spark, sf_dir, "orders", "o_orderkey", ["o_totalprice"])
            return df.transform(op_of(fit.filter_rows(df, one("o_totalprice", op))))

        query(f"filter_keep_{op}", f"SELECT * FROM {orders} WHERE o_totalprice {sign}")(run)


_filters()

TREE = [
    {"logic": "and", "conditions": [{"column": "l_quantity", "op": "gt", "value": 25}, {"column": "l_returnflag", "op": "eq", "value": "R"}]},
    {"logic": "or", "conditions": [{"column": "l_discount", "op": "eq", "value": 0.0}, {"column": "l_tax", "op": "ge", "value": 0.08}]},
]
TREE_SQL = "((l_quantity > 25 AND l_returnflag = 'R') OR (l_discount = 0 OR l_tax >= 0.08))"


@query("filter_keep_tree", f"SELECT {', '.join(LINE)} FROM lineitem WHERE {TREE_SQL}")
def filter_keep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", *LINE)
    return df.transform(op_of(fit.filter_rows(df, TREE, "or")))


@query("filter_delete_nulls", f"SELECT * FROM {holed_sql('orders', 'o_orderkey', ['o_totalprice'])} WHERE (o_totalprice > 100000) IS NOT TRUE")
def filter_delete_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed_frame(spark, sf_dir, "orders", "o_orderkey", ["o_totalprice"])
    return df.transform(op_of(fit.filter_rows(df, one("o_totalprice", "gt", 100000.0), action="delete")))


@query("indicator_tree", f"SELECT {', '.join(LINE)}, CAST(coalesce({TREE_SQL}, false) AS TINYINT) AS flagged FROM lineitem")
def indicator_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", *LINE)
    return df.transform(op_of(fit.create_indicator(df, TREE, "or", "flagged")))


@query("indicator_null_zero", f"SELECT *, CAST(coalesce(o_totalprice > 100000, false) AS TINYINT) AS large FROM {holed_sql('orders', 'o_orderkey', ['o_totalprice'])}")
def indicator_null_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed_frame(spark, sf_dir, "orders", "o_orderkey", ["o_totalprice"])
    return df.transform(op_of(fit.create_indicator(df, one("o_totalprice", "gt", 100000.0), "and", "large")))


# Unary and n-ary features.


def _monos() -> None:
    cases = {
        "cos": ("part", "p_partkey", "p_size", {}, "cos(p_size)"), "sin": ("part", "p_partkey", "p_size", {}, "sin(p_size)"),
        "tan": ("part", "p_partkey", "p_size", {}, "tan(p_size)"), "exp": ("lineitem", "l_orderkey", "l_discount", {}, "exp(l_discount)"),
        "log": ("customer", "c_custkey", "c_acctbal", {}, "ln(c_acctbal)"),
        "log2": ("part", "p_partkey", "p_size", {"method": "log", "base": 2.0}, "ln(p_size) / ln(2.0::DOUBLE)"),
        "log_zero": ("lineitem", "l_orderkey", "l_discount", {"method": "log"}, "ln(l_discount)"),
        "sqrt": ("customer", "c_custkey", "c_acctbal", {}, "sqrt(c_acctbal)"),
        "square": ("part", "p_partkey", "p_size", {}, "p_size::DOUBLE * p_size"),
        "power": ("part", "p_partkey", "p_size", {"exponent": 3.0}, "pow(p_size, 3.0)"),
        "linear": ("part", "p_partkey", "p_retailprice", {"a": 2.0, "b": -1.5}, "2.0::DOUBLE * p_retailprice + -1.5::DOUBLE"),
        "reciprocal": ("lineitem", "l_orderkey", "l_discount", {}, "1.0::DOUBLE / l_discount"),
        "abs": ("customer", "c_custkey", "c_acctbal", {}, "abs(c_acctbal)"),
    }
    for name, (source, key, column, options, sql) in cases.items():

        def run(spark: SparkSession, sf_dir: str, name=name, source=source, key=key, column=column, options=options) -> DataFrame:
            df = table(spark, sf_dir, source, key, column)
            made = df.transform(op_of(fit.transform_mono(df, [{"column": column, "method": name, "output_name": "made", **options}])))
            return made.withColumn("made", F.round("made", 6))

        query(f"mono_{name}", f"SELECT {key}, {column}, round({sql}, 6) AS made FROM {source}")(run)
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    joins = {"product": " * ", "sum": " + ", "difference": " - ", "ratio": " / "}
    for method in ("product", "sum", "mean", "difference", "ratio"):

        def run(spark: SparkSession, sf_dir: str, method: str = method) -> DataFrame:
            df = holed_frame(spark, sf_dir, "lineitem", "l_orderkey", ["l_extendedprice"], ["l_quantity", "l_discount"])
            made = df.transform(op_of(fit.transform_combination(df, columns, method, "made")))
            return made.withColumn("made", F.round("made", 6))

        sql = f"({' + '.join(columns)}) / 3.0::DOUBLE" if method == "mean" else joins[method].join(columns)
        rows = holed_sql("lineitem", "l_orderkey", ["l_extendedprice"], ["l_quantity", "l_discount"])
        query(f"comb_{method}", f"SELECT *, round({sql}, 6) AS made FROM {rows}")(run)


_monos()


@query(
    "fill_zero_bool",
    "SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value > 100 END, FALSE) AS dear FROM events",
)
def fill_zero_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events", "event_id", "value")
    df = df.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") > 100).alias("dear"))
    return df.transform(op_of(fit.fill_missing(df, [{"column": "dear", "action": "zero"}])))


@query("comb_ratio_zero", "SELECT l_orderkey, l_tax, l_discount, l_tax / l_discount AS made FROM lineitem")
def comb_ratio_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_tax", "l_discount")
    return df.transform(op_of(fit.transform_combination(df, ["l_tax", "l_discount"], "ratio", "made")))


# Missing values.

EVENTS = holed_sql("events", "event_id", ["value", "event_type"], ["user_id"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed_frame(spark, sf_dir, "events", "event_id", ["value", "event_type"], ["user_id"])


def _fills() -> None:
    mode = f"(SELECT event_type FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    base = "SELECT event_id, user_id, {value} AS value, {type} AS event_type{more} FROM " + EVENTS
    row = lambda value="value", type="event_type", more="": base.format(value=value, type=type, more=more)  # noqa: E731, A002
    cases = {
        "fill_zero_num": ([{"column": "value", "action": "zero"}], row("coalesce(value, 0)")),
        "fill_zero_str": ([{"column": "event_type", "action": "zero"}], row(type="coalesce(event_type, '0')")),
        "fill_mean": ([{"column": "value", "action": "avg"}], row(f"round(coalesce(value, (SELECT avg(value) FROM {EVENTS})), 6)")),
        "fill_median": ([{"column": "value", "action": "median"}], row(f"round(coalesce(value, (SELECT median(value) FROM {EVENTS})), 6)")),
        "fill_mode": ([{"column": "event_type", "action": "mode"}], row(type=f"coalesce(event_type, {mode})")),
        "fill_delete": ([{"column": "value", "action": "delete"}], row() + " WHERE value IS NOT NULL"),
        "fill_indicator": (
            [{"column": "value", "action": "zero", "add_indicator": True}],
            row("coalesce(value, 0)", more=", CAST(value IS NULL AS TINYINT) AS value_is_missing"),
        ),
        "fill_multi": (
            [{"column": "value", "action": "avg", "add_indicator": True}, {"column": "event_type", "action": "mode"}],
            row(f"round(coalesce(value, (SELECT avg(value) FROM {EVENTS})), 6)", f"coalesce(event_type, {mode})", ", CAST(value IS NULL AS TINYINT) AS value_is_missing"),
        ),
    }
    for name, (pairs, sql) in cases.items():

        def run(spark: SparkSession, sf_dir: str, pairs: list = pairs) -> DataFrame:
            df = events(spark, sf_dir)
            made = df.transform(op_of(fit.fill_missing(df, pairs)))
            return made.withColumn("value", F.round("value", 6)) if pairs[0]["action"] in ("avg", "median") else made

        query(name, sql)(run)
    lines = holed_sql("lineitem", "l_orderkey", ["l_extendedprice"], ["l_quantity", "l_returnflag", "l_linestatus"])
    stats = {"mean": "avg(l_extendedprice)", "median": "median(l_extendedprice)"}
    for kind, stat in stats.items():

        def run(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            df = holed_frame(spark, sf_dir, "lineitem", "l_orderkey", ["l_extendedprice"], ["l_quantity", "l_returnflag", "l_linestatus"])
            step = fit.fill_missing(df, [{"column": "l_extendedprice", "action": {"mean": "avg"}.get(kind, kind), "group_by": "l_returnflag"}])
            return df.transform(op_of(step)).withColumn("l_extendedprice", F.round("l_extendedprice", 6))

        query(
            f"fill_group_{kind}",
            f"""WITH t AS {lines}, g AS (SELECT l_returnflag AS k, {stat} AS s FROM t GROUP BY 1)
            SELECT l_orderkey, l_quantity, l_returnflag, l_linestatus, round(coalesce(l_extendedprice, s, (SELECT {stat} FROM t)), 6) AS l_extendedprice
            FROM t LEFT JOIN g ON l_returnflag = k""",
        )(run)

    def group_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = holed_frame(spark, sf_dir, "lineitem", "l_orderkey", ["l_linestatus"], ["l_returnflag"])
        return df.transform(op_of(fit.fill_missing(df, [{"column": "l_linestatus", "action": "mode", "group_by": "l_returnflag"}])))

    status = holed_sql("lineitem", "l_orderkey", ["l_linestatus"], ["l_returnflag"])
    query(
        "fill_group_mode",
        f"""WITH t AS {status}, c AS (SELECT l_returnflag AS k, l_linestatus AS s, count(*) AS n FROM t WHERE l_linestatus IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT k, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS r FROM c) WHERE r = 1)
        SELECT l_orderkey, l_returnflag, coalesce(l_linestatus, s) AS l_linestatus FROM t LEFT JOIN g ON l_returnflag = k""",
    )(group_mode)

    def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = holed_frame(spark, sf_dir, "lineitem", "l_orderkey", ["l_extendedprice"], ["l_quantity", "l_returnflag", "l_linestatus"])
        step = fit.fill_missing(df, [{"column": "l_extendedprice", "action": "avg", "group_by": "l_quantity", "group_bins": 4}])
        return df.transform(op_of(step)).withColumn("l_extendedprice", F.round("l_extendedprice", 6))

    query(
        "fill_group_binned",
        f"""WITH t AS {lines}, e AS (SELECT min(l_quantity)::DOUBLE AS a, max(l_quantity)::DOUBLE AS b FROM t),
        u AS (SELECT t.*, (l_quantity > a + 1 * (b - a) / 4)::INT + (l_quantity > a + 2 * (b - a) / 4)::INT + (l_quantity > a + 3 * (b - a) / 4)::INT AS k FROM t, e),
        g AS (SELECT k, avg(l_extendedprice) AS s FROM u GROUP BY 1)
        SELECT l_orderkey, l_quantity, l_returnflag, l_linestatus, round(coalesce(l_extendedprice, s), 6) AS l_extendedprice FROM u JOIN g USING (k)""",
    )(binned)


_fills()

# Encoding, scaling and projection.


@query("onehot_lexical", "SELECT o_orderkey, o_orderstatus = 'O' AS \"o_orderstatus_O\", o_orderstatus = 'P' AS \"o_orderstatus_P\" FROM orders")
def onehot_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return df.transform(op_of(fit.encode(df, [("o_orderstatus", "one_hot")])))


@query("onehot_null", f"SELECT o_orderkey, o_orderstatus = 'O' AS \"o_orderstatus_O\", o_orderstatus = 'P' AS \"o_orderstatus_P\" FROM {holed_sql('orders', 'o_orderkey', ['o_orderstatus'])}")
def onehot_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed_frame(spark, sf_dir, "orders", "o_orderkey", ["o_orderstatus"])
    return df.transform(op_of(fit.encode(df, [("o_orderstatus", "one_hot")])))


@query(
    "onehot_appearance",
    """WITH f AS (SELECT o_orderstatus AS first FROM orders ORDER BY o_orderkey LIMIT 1)
    SELECT o_orderkey, CASE WHEN o_orderstatus = first THEN '' ELSE 'o_orderstatus_' || o_orderstatus END AS hot,
           (SELECT CAST(count(DISTINCT o_orderstatus) - 1 AS INT) FROM orders) AS n_made FROM orders, f""",
)
def onehot_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which made column is hot in each row, as their names depend on the data."""
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    wide = df.transform(op_of(fit.encode(df, [("o_orderstatus", "one_hot")], "appearance", "o_orderkey")))
    made = [c for c in wide.columns if c != "o_orderkey"]
    hot = F.array_join(F.array(*[F.when(F.col(c), F.lit(c)) for c in made]), "|")
    return wide.select("o_orderkey", hot.alias("hot"), F.lit(len(made)).alias("n_made"))


def _labels() -> None:
    for name, column in (("label_str", "p_type"), ("label_int", "p_size")):

        def run(spark: SparkSession, sf_dir: str, column: str = column) -> DataFrame:
            df = table(spark, sf_dir, "part", "p_partkey", column)
            return df.transform(op_of(fit.encode(df, [(column, "label")])))

        query(name, f"SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS BIGINT) AS {column} FROM part")(run)

    def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = holed_frame(spark, sf_dir, "part", "p_partkey", ["p_name"])
        return df.transform(op_of(fit.encode(df, [("p_name", "label")])))

    rows = holed_sql("part", "p_partkey", ["p_name"])
    query("label_null", f"WITH t AS {rows}, c AS (SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_name FROM t WHERE p_name IS NOT NULL)) SELECT p_partkey, code AS p_name FROM t LEFT JOIN c USING (p_name)")(nulls)


_labels()


@query("standardize", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return df.transform(op_of(fit.standardize(df, ["c_acctbal"]))).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(
    "pca_2col",
    """WITH s AS (SELECT l_orderkey, l_linenumber,
        (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem) AS x,
        (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem) AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((x + (SELECT sign(corr(x, y)) FROM s) * y) / sqrt(2.0::DOUBLE), 4) AS pc1 FROM s""",
)
def pca_2col(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    step = fit.dim_reduct(df, "pca", 1, columns=["l_quantity", "l_extendedprice"])
    return df.transform(op_of(step)).withColumn("pc1", F.round("pc1", 4))


_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "pca_4col",
    f"""WITH m AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _FOUR)} FROM lineitem)
    SELECT l_orderkey, l_linenumber, round({' + '.join(f"(({c} - m_{c}) / s_{c}) * (({c} - m_{c}) / s_{c})" for c in _FOUR)} + 1e-9, 6) AS norm FROM lineitem, m""",
)
def pca_4col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four components are a rotation of the standardised columns, so they keep each row's length."""
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *_FOUR)
    wide = df.transform(op_of(fit.dim_reduct(df, "pca", 4, columns=list(_FOUR))))
    norm = F.col("pc1") * F.col("pc1") + F.col("pc2") * F.col("pc2") + F.col("pc3") * F.col("pc3") + F.col("pc4") * F.col("pc4")
    return wide.select("l_orderkey", "l_linenumber", F.round(norm + F.lit(1e-9), 6).alias("norm"))


@query(
    "pca_variance",
    f"""WITH c AS (SELECT {', '.join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(combinations(_FOUR, 2)))} FROM lineitem)
    SELECT 4.0::DOUBLE AS total, round(4 + 2 * ({' + '.join(f"r{i} * r{i}" for i in range(6))}) + 1e-9, 6) AS squares, true AS uncorrelated, true AS falling FROM c""",
)
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components' variances sum to the trace of the correlation matrix, their squares to that of its square; they fall and don't correlate."""
    df = table(spark, sf_dir, "lineitem", *_FOUR)
    wide = df.transform(op_of(fit.dim_reduct(df, "pca", 4)))
    names = ["pc1", "pc2", "pc3", "pc4"]
    v = wide.agg(*[F.var_samp(c).alias(c) for c in names], *[F.abs(F.corr(a, b)).alias(f"{a}_{b}") for a, b in combinations(names, 2)])
    total, squares = (F.round(sum((F.col(c) ** k for c in names[1:]), F.col("pc1") ** k) + F.lit(1e-9), 6) for k in (1, 2))
    apart = F.greatest(*[F.col(f"{a}_{b}") for a, b in combinations(names, 2)]) < 1e-6
    return v.select(total.alias("total"), squares.alias("squares"), apart.alias("uncorrelated"), ((F.col("pc1") >= F.col("pc2")) & (F.col("pc2") >= F.col("pc3")) & (F.col("pc3") >= F.col("pc4"))).alias("falling"))


@query("lda_multi")
def lda_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part", "p_type", "p_size", "p_retailprice")
    return df.transform(op_of(fit.dim_reduct(df, "lda", 2, target="p_type")))


@query(
    "lda_one_feature",
    """WITH t AS (SELECT * FROM part WHERE p_partkey % 7 <> 0), m AS (SELECT avg(p_retailprice) AS m FROM t)
    SELECT p_partkey, round(abs(p_retailprice - m) / (SELECT max(abs(p_retailprice - m)) FROM t, m) + 1e-9, 6) AS ld FROM t, m""",
)
def lda_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one feature the discriminant is that feature, centred and scaled; rows without a target aren't part of it."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", holed("p_type", "p_partkey"), "p_retailprice")
    wide = df.transform(op_of(fit.dim_reduct(df, "lda", 1, target="p_type", columns=["p_retailprice"])))
    far = wide.agg(F.max(F.abs("ld1"))).first()[0]
    return wide.select("p_partkey", F.round(F.abs("ld1") / F.lit(far) + F.lit(1e-9), 6).alias("ld"))


# Profiles.


def _schema_sql(rows: str, columns: dict[str, str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count,
        round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_rate,
        CAST(count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::INT), 0) AS BIGINT) AS n_unique FROM t"""
        for c, t in columns.items()
    ]
    return f"WITH t AS {rows} " + " UNION ALL ".join(parts)


@query("schema_report", _schema_sql(EVENTS, {"event_id": "bigint", "user_id": "bigint", "value": "double", "event_type": "string"}))
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.schema_report(events(spark, sf_dir))


def _describe_sql(rows: str, columns: list[str]) -> str:
    pick = lambda c, q: f"(SELECT {c}::DOUBLE FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM t WHERE {c} IS NOT NULL) WHERE r = floor((n - 1) * {q} + 0.5))"
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, round(avg({c}) + 1e-9, 6) AS mean,
        round(median({c})::DOUBLE + 1e-9, 6) AS median, round(stddev_samp({c}) + 1e-9, 6) AS std, min({c})::DOUBLE AS min, {pick(c, '0.25')} AS q1, {pick(c, '0.75')} AS q3, max({c})::DOUBLE AS max FROM t"""
        for c in columns
    ]
    return f"WITH t AS {rows} " + " UNION ALL ".join(parts)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _described(df: DataFrame) -> DataFrame:
    """A description rounded beside exact ties: means of decimals often lie on one, where the last bit of a sum would decide."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(1e-9), 6) for n in ("mean", "median", "std")})


@query("describe", _describe_sql("(SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(profile.describe(table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))


@query("describe_null", _describe_sql(EVENTS, ["value"]))
def describe_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(profile.describe(events(spark, sf_dir), ["value"]))


def _pearson_sql(a: str, b: str, rows: str) -> str:
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS value FROM {rows}"


@query("corr_pearson", " UNION ALL ".join(_pearson_sql(a, b, "lineitem") for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount")
    return _rounded(profile.pearson(df, [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]), "value")


@query("corr_constant", "SELECT 'l_quantity' AS column_a, 'same' AS column_b, CAST(NULL AS DOUBLE) AS value")
def corr_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pearson(table(spark, sf_dir, "lineitem", "l_quantity").withColumn("same", F.lit(1.0)), [("l_quantity", "same")])


_CRAMER = """SELECT 'o_orderstatus' AS column_a, 'o_orderpriority' AS column_b, round(sqrt(x / (t * (least(r, c) - 1))), 6) AS value FROM (
    SELECT sum((n - e) * (n - e) / e) AS x, max(t) AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM (
        SELECT a, b, n, t, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / t AS e FROM (
            SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM orders GROUP BY 1, 2)))"""
_ETA = """SELECT 'o_orderpriority' AS column_a, 'o_totalprice' AS column_b, round(sum(n * (m - g) * (m - g)) / max(tss), 6) AS value FROM (
    SELECT count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority), (SELECT avg(o_totalprice) AS g, var_pop(o_totalprice) * count(*) AS tss FROM orders)"""


@query("cramers_v", _CRAMER)
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.cramers_v(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), "value")


@query("eta_squared", _ETA)
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.eta_squared(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), "value")


_ETA2 = _ETA.replace("o_orderpriority", "o_orderstatus")


@query("corr_matrix_mixed", f"SELECT 'cramers_v' AS method, * FROM ({_CRAMER}) UNION ALL SELECT 'eta_squared', * FROM ({_ETA}) UNION ALL SELECT 'eta_squared', * FROM ({_ETA2})")
def corr_matrix_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return _rounded(profile.correlation(df).drop("rank"), "value")


def _hist_sql(rows: str, c: str, bins: int = 10) -> str:
    return f"""WITH t AS {rows}, e AS (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b FROM t),
    g AS (SELECT i, a + i * (b - a) / {bins} AS low, CASE WHEN i = {bins - 1} THEN b ELSE a + (i + 1) * (b - a) / {bins} END AS high, a FROM e, generate_series(0, {bins - 1}) AS s(i))
    SELECT CAST(i AS INT) AS bin, round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM t WHERE {c} <= high AND ({c} > low OR (i = 0 AND {c} >= low))) AS count FROM g"""


@query("hist_numeric", _hist_sql("(SELECT l_extendedprice FROM lineitem)", "l_extendedprice"))
def hist_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice").drop("label"), "low", "high")


@query("hist_empty_bins", _hist_sql("(SELECT CASE WHEN p_partkey = 1 THEN 1000.0 ELSE p_size END::DOUBLE AS x FROM part)", "x"))
def hist_empty_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").selectExpr("CAST(CASE WHEN p_partkey = 1 THEN 1000.0 ELSE p_size END AS DOUBLE) AS x")
    return _rounded(profile.histogram(df, "x").drop("label"), "low", "high")


@query("hist_constant", "SELECT 0 AS bin, 1.5::DOUBLE AS low, 1.5::DOUBLE AS high, count(*) AS count FROM part")
def hist_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "part").select(F.lit(1.5).alias("x")), "x").drop("label")


@query("freq_topk", "SELECT p_name AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM part), 4) AS proportion FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequencies(table(spark, sf_dir, "part"), "p_name")


@query("freq_null", f"SELECT event_type AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM events), 4) AS proportion FROM {EVENTS} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20")
def freq_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(events(spark, sf_dir), "event_type")


@query("fit_chi2")
def fit_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fit_distributions(table(spark, sf_dir, "events"), "value")


@query(
    "fit_chi2_uniform",
    """WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, count(*) AS n FROM customer),
    h AS (SELECT i, count(c_acctbal) AS o FROM e, generate_series(0, 9) AS s(i) LEFT JOIN customer ON
          c_acctbal <= CASE WHEN i = 9 THEN (SELECT b FROM e) ELSE (SELECT a + (i + 1) * (b - a) / 10 FROM e) END
          AND (i = 0 OR c_acctbal > (SELECT a + i * (b - a) / 10 FROM e)) GROUP BY i)
    SELECT 'uniform' AS distribution, round(sum((o - n / 10.0::DOUBLE) * (o - n / 10.0::DOUBLE) / (n / 10.0::DOUBLE)) + 1e-9, 6) AS statistic FROM h, e""",
)
def fit_chi2_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.fit_distributions(table(spark, sf_dir, "customer"), "c_acctbal").where("distribution = 'uniform'")
    return found.select("distribution", F.round(F.col("statistic") + F.lit(1e-9), 6).alias("statistic"))


@query("fit_monte_carlo")
def fit_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fit_distributions(table(spark, sf_dir, "supplier"), "s_acctbal", method="monte_carlo")


# Summaries.


@query(
    "fill_summary",
    f"""WITH t AS {holed_sql("part", "p_partkey", ["p_size", "p_type"])}
    SELECT 'p_size' AS "column", 'avg' AS method, count(*) FILTER (p_size IS NULL) AS nulls_before, count(*) FILTER (p_size IS NULL) AS nulls_filled, CAST(NULL AS BIGINT) AS rows_deleted FROM t
    UNION ALL SELECT 'p_type', 'delete', count(*) FILTER (p_type IS NULL), NULL, count(*) FILTER (p_type IS NULL) FROM t""",
)
def fill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed_frame(spark, sf_dir, "part", "p_partkey", ["p_size", "p_type"])
    step = fit.fill_missing(df, [{"column": "p_size", "action": "avg"}, {"column": "p_type", "action": "delete"}])
    names = ("column", "method", "nulls_before", "nulls_filled", "rows_deleted")
    rows = [tuple(e.get(n) for n in names) for e in summary.of_step(step, df)]
    return spark.createDataFrame(rows, "column string, method string, nulls_before long, nulls_filled long, rows_deleted long")


@query("condition_text", "SELECT '(l_quantity > 25.0 and l_returnflag = ''R'') or l_discount is null' AS said, count(*) AS n FROM lineitem WHERE (l_quantity > 25 AND l_returnflag = 'R') OR l_discount IS NULL")
def condition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition's text, and the rows that it keeps."""
    groups = [{"logic": "and", "conditions": [{"column": "l_quantity", "op": "gt", "value": 25.0}, {"column": "l_returnflag", "op": "eq", "value": "R"}]}, {"conditions": [{"column": "l_discount", "op": "is_null"}]}]
    df = table(spark, sf_dir, "lineitem")
    kept = df.transform(op_of(fit.filter_rows(df, groups, "or")))
    return kept.agg(F.count("*").alias("n")).withColumn("said", F.lit(summary.in_words(groups, "or")))


@query("commit_step", "SELECT 1 AS new_data_version, (SELECT count(*) FROM customer) AS rows_before, count(*) AS rows_after FROM customer WHERE c_acctbal > 0")
def commit_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = VersionStore(spark)
    store.load(f"{sf_dir.rstrip('/')}/customer.parquet", "parquet")
    done = store.commit(lambda df: fit.filter_rows(df, one("c_acctbal", "gt", 0.0)))
    rows = [(done["new_data_version"], done["rows_before"], done["rows_after"])]
    return spark.createDataFrame(rows, "new_data_version int, rows_before long, rows_after long")


@query("capped_report", "SELECT 3 AS shown, count(*) AS total FROM (SELECT DISTINCT p_name FROM part)")
def capped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report shows what its limit allows and counts all."""
    shown, note = caps.capped_rows(profile.frequencies(table(spark, sf_dir, "part"), "p_name", 1 << 30), 3)
    return spark.createDataFrame([(len(shown), note["total"])], "shown int, total long")


# Versions.

CHAIN_SQL = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 50000),
    b AS (SELECT o_orderkey, o_totalprice, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus FROM a),
    c AS (SELECT *, (SELECT avg(o_totalprice) FROM b) AS m, (SELECT stddev_samp(o_totalprice) FROM b) AS s FROM b)
    SELECT o_orderkey, CAST(o_orderstatus AS BIGINT) AS o_orderstatus, round((o_totalprice - m) / s, 6) AS o_totalprice,
           round(((o_totalprice - m) / s) * ((o_totalprice - m) / s), 6) AS square_o_totalprice FROM c"""


def _chain(spark: SparkSession, sf_dir: str) -> VersionStore:
    """source, drop, filter, label, standardise, square; each step is fitted on the version before it."""
    store = VersionStore(spark)
    store.load(f"{sf_dir.rstrip('/')}/orders.parquet", "parquet")
    df = store.get()
    store.derive(fit.drop_columns(df, [c for c in df.columns if c not in ("o_orderkey", "o_orderstatus", "o_totalprice")]))
    store.derive(fit.filter_rows(store.get(), one("o_totalprice", "gt", 50000.0)))
    store.derive(fit.encode(store.get(), [("o_orderstatus", "label")]))
    store.derive(fit.standardize(store.get(), ["o_totalprice"]))
    store.derive(fit.transform_mono(store.get(), [{"column": "o_totalprice", "method": "square"}]))
    return store


@query("replay_chain", CHAIN_SQL)
def replay_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chain(spark, sf_dir).get(), "o_totalprice", "square_o_totalprice")


@query("replay_fork", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS o_orderstatus FROM orders WHERE o_totalprice > 50000")
def replay_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _chain(spark, sf_dir)
    return store.get(store.derive(fit.drop_columns(store.get(3), ["o_totalprice"]), parent=3))


@query("replay_restored", CHAIN_SQL)
def replay_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _chain(spark, sf_dir)
    again = VersionStore.restored(spark, [(dumps(n), "") for n in store.chain(store.head)], store.head)
    return _rounded(again.get(), "o_totalprice", "square_o_totalprice")


@query("emit_script_equiv", CHAIN_SQL)
def emit_script_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    names: dict = {}
    exec(_chain(spark, sf_dir).script(), names)  # the script is our own; it leaves its frame in df
    return _rounded(names["df"], "o_totalprice", "square_o_totalprice")


@query(
    "replay_new_data",
    """WITH t AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, t WHERE o_orderkey % 5 = 0""",
)
def replay_new_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    step = loads(dumps(Node(1, fit.standardize(df.where("o_orderkey % 5 <> 0"), ["o_totalprice"]), (0,)))).step
    return _rounded(df.where("o_orderkey % 5 = 0").transform(op_of(step)), "o_totalprice")


@query("versions_listing", "SELECT * FROM (VALUES (0, 'source', false), (1, 'drop_columns', false), (2, 'filter_rows', false), (3, 'encode', false), (4, 'standardize', false), (5, 'transform_mono', true)) AS v(version, kind, is_head)")
def versions_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).listing().select(F.col("version").cast("int").alias("version"), "kind", "is_head")


def _exports() -> None:
    for fmt in ("csv", "parquet"):
        for single in (False, True):

            def run(spark: SparkSession, sf_dir: str, fmt: str = fmt, single: bool = single) -> DataFrame:
                path = f"{io.shared_path(spark)}/out/nation.{fmt}"
                store = VersionStore(spark)
                store.add_source(lambda: table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name"))
                done = store.export(0, path, fmt, single)
                return io.read(spark, path, fmt).withColumns({"rows": F.lit(done["rows"]).cast("long"), "cols": F.lit(done["cols"])})

            name = f"export_{'single' if single else 'roundtrip'}_{fmt}"
            query(name, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, count(*) OVER () AS rows, 2 AS cols FROM nation")(run)


_exports()


@query("stream_replay", "SELECT event_id, round(2.0::DOUBLE * value + 1.0, 6) AS made FROM events WHERE value > 10")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen chain over a stream of the events, into files that are read back."""
    base = table(spark, sf_dir, "events", "event_id", "value")
    steps: list[Step] = [fit.filter_rows(base, one("value", "gt", 10.0)), fit.transform_mono(base, [{"column": "value", "method": "linear", "a": 2.0, "b": 1.0, "output_name": "made"}])]
    whole = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    path = io.shared_path(spark)
    made = apply_chain(stream.select("event_id", "value"), steps).select("event_id", F.round("made", 6).alias("made"))
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


# Text and message logs.

_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
_TOKENS = f"CAST(round_even(CAST(0.8 AS DOUBLE) * (length(text) - length(regexp_replace(text, '{_WIDE}', '', 'g'))) + CAST(0.3 AS DOUBLE) * length(regexp_replace(text, '{_WIDE}', '', 'g')), 0) AS BIGINT)"


@query("text_tokens", f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.token_estimate(F.col("text")).alias("tokens"))


@query("text_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…[+' || (length(text) - 200) || ' chars]' ELSE text END AS text FROM documents")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.truncated(F.col("text")).alias("text"))


@query("conv_token_buckets", f"SELECT conv_id, CAST(coalesce(sum({_TOKENS} + 4) FILTER (role = 'user'), 0) AS BIGINT) AS \"user\", CAST(coalesce(sum({_TOKENS} + 4) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant, CAST(0 AS BIGINT) AS tool_results FROM conversations GROUP BY 1")
def conv_token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_functions.token_buckets(table(spark, sf_dir, "conversations"))


@query(
    "conv_cutoff",
    """WITH r AS (SELECT conv_id, role = 'user' AS u, row_number() OVER w AS l, sum((role = 'user')::INT) OVER w AS us, count(*) OVER (PARTITION BY conv_id) AS n
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, CAST(coalesce(max(n) - max(l) FILTER (u AND n >= 5 AND us <= 2 AND l < 5), CASE WHEN max(n) >= 5 THEN max(n) - min(l) FILTER (u) END, 0) AS BIGINT) AS cutoff FROM r GROUP BY 1""",
)
def conv_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_functions.compaction_cutoff(table(spark, sf_dir, "conversations"), 2, 5)


@query(
    "conv_breakdown",
    f"""WITH t AS (SELECT conv_id, CAST(coalesce(sum({_TOKENS} + 4) FILTER (role = 'user'), 0) AS BIGINT) AS u, CAST(coalesce(sum({_TOKENS} + 4) FILTER (role = 'assistant'), 0) AS BIGINT) AS a FROM conversations GROUP BY 1)
    SELECT conv_id, 6::BIGINT AS system, 0::BIGINT AS summary, 0::BIGINT AS tools, u AS "user", a AS assistant, 0::BIGINT AS tool_results, 6 + u + a AS total, round((6 + u + a) / 256000.0::DOUBLE + 1e-9, 6) AS utilisation FROM t""",
)
def conv_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_functions.context_breakdown(table(spark, sf_dir, "conversations"), system="You help with data.")
    return found.withColumn("utilisation", F.round(F.col("utilisation") + F.lit(1e-9), 6))


@query(
    "memory_parse",
    """SELECT conv_id, turn, coalesce(text, '') AS user_goal, CAST(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END AS INT) AS n_findings, 'Goal: ' || text AS first_line
    FROM conversations WHERE length(text) > 0 AND NOT contains(text, chr(10))""",
)
def memory_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as a model would write them, fenced, read back and rendered."""
    rows = table(spark, sf_dir, "conversations").where("length(text) > 0 and not contains(text, '\\n')")
    body = F.to_json(F.struct(F.col("text").alias("用户目标"), F.array("text", F.lit(" ")).alias("key_findings")))
    memory = rows.select("conv_id", "turn", text_functions.parsed_memory(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("m"))
    first = F.substring_index(text_functions.rendered_memory(F.col("m")), "\n", 1)
    return memory.select("conv_id", "turn", F.col("m.user_goal").alias("user_goal"), F.size("m.key_findings").alias("n_findings"), first.alias("first_line"))


@query(
    "conv_route",
    """WITH r AS (SELECT conv_id, role = 'user' AS u, row_number() OVER w AS l, sum((role = 'user')::INT) OVER w AS us, count(*) OVER (PARTITION BY conv_id) AS n
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
    c AS (SELECT conv_id, coalesce(max(n) - max(l) FILTER (u AND n >= 4 AND us <= 1 AND l < 4), CASE WHEN max(n) >= 4 THEN max(n) - min(l) FILTER (u) END, 0) AS cutoff FROM r GROUP BY 1)
    SELECT conv_id, CASE WHEN cutoff > 0 THEN 'summarize' ELSE 'react' END AS enters, CASE WHEN (SELECT max_by(role, turn) FROM conversations x WHERE x.conv_id = c.conv_id) = 'assistant' THEN 'tools' ELSE 'finish' END AS goes_on FROM c""",
)
def conv_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("tool_calls", F.when(F.col("role") == "assistant", '[{"name": "f"}]').otherwise("[]"))
    return text_functions.routes(rows, 1, 4)


@query(
    "open_items",
    """SELECT o_custkey, string_agg('[#' || o_orderkey || '] ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS shown FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey AS id", "o_orderpriority AS content", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status")
    return text_functions.open_items(items, "o_custkey")


@query("turns_added", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1")
def turns_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_functions.turns_added(table(spark, sf_dir, "conversations"), "conv_id")


@query("latest_role", "SELECT conv_id, max_by(role, turn) AS role FROM conversations GROUP BY 1")
def latest_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_functions.latest(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


@query("conv_history", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' OR (role = 'assistant' AND text <> '')")
def conv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_functions.history(table(spark, sf_dir, "conversations"))


@query(
    "upsert_latest",
    f"""WITH t AS {EVENTS} SELECT user_id, (SELECT max_by(value, event_id) FROM t AS x WHERE x.user_id = t.user_id AND value IS NOT NULL) AS value,
    (SELECT max_by(event_type, event_id) FROM t AS x WHERE x.user_id = t.user_id AND event_type IS NOT NULL) AS event_type FROM t GROUP BY user_id""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_functions.upsert_latest(events(spark, sf_dir), "user_id", "event_id")


@query(
    "memory_merge",
    f"""WITH said AS (
        SELECT conv_id, text AS finding, min(CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS part
        FROM conversations WHERE text IS NOT NULL GROUP BY ALL
    ), ranked AS (
        SELECT conv_id, finding, row_number() OVER (PARTITION BY conv_id ORDER BY part, finding) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM said
    )
    SELECT conv_id, CAST(place - greatest(n - {text_functions.FINDINGS_CAP}, 0) AS BIGINT) AS place, finding FROM ranked WHERE place > n - {text_functions.FINDINGS_CAP}""",
)
def memory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "role", "text")
    old = F.array_sort(F.collect_set(F.when(F.col("role") == "user", F.col("text"))))
    both = rows.groupBy("conv_id").agg(old.alias("old"), F.array_sort(F.collect_set("text")).alias("new"))
    each = both.select("conv_id", F.posexplode(text_functions.merged_findings(F.col("old"), F.col("new"))).alias("place", "finding"))
    return each.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), "finding")


@query(
    "flagship",
    _describe_sql("(SELECT l_extendedprice / l_quantity AS unit_price, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R')", ["l_quantity", "l_extendedprice", "unit_price"]),
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, derive a ratio and describe, through the version store."""
    store = VersionStore(spark)
    store.add_source(lambda: table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_returnflag"))
    store.derive(fit.filter_rows(store.get(), TREE[:1]))
    store.derive(fit.transform_combination(store.get(), ["l_extendedprice", "l_quantity"], "ratio", "unit_price"))
    return _described(profile.describe(store.get()))
