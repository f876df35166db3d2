"""Steps: fitted constants, three-way agreement of spec, JSON and script, and refused requests."""

import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vframe import cli
from vframe.functions import caps, exprs, text
from vframe.operators import fit, linalg, profile, ranks
from vframe.operators.apply import op_of
from vframe.plans import emit, summary
from vframe.plans.ledger import Ledger
from vframe.plans.specs import Node, Step, StepError, dumps, loads
from vframe.plans.store import VersionStore
from vframe.sources import io

ROWS = [(1, 2.0, "a", True, "x"), (2, None, "b", None, "x"), (3, 4.0, None, False, "y"), (4, float("nan"), "b", True, None), (5, 9.0, "a", True, "y")]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id long, v double, s string, b boolean, g string")


def by_id(frame, name):
    return {r["id"]: r[name] for r in frame.collect()}


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b))


STEPS = {
    "zero": lambda d: fit.fill_missing(d, [{"column": "v", "action": "zero", "add_indicator": True}, {"column": "s", "action": "zero"}, {"column": "b", "action": "zero"}]),
    "mode": lambda d: fit.fill_missing(d, [{"column": "s", "action": "mode"}, {"column": "b", "action": "mode", "group_by": "g"}]),
    "delete": lambda d: fit.fill_missing(d, [{"column": "v", "action": "delete"}]),
    "onehot": lambda d: fit.encode(d, [("s", "one_hot"), ("b", "label")]),
    "filter": lambda d: fit.filter_rows(d, [{"logic": "and", "conditions": [{"column": "v", "op": "gt", "value": 3.0}]}], action="delete"),
    "indicator": lambda d: fit.create_indicator(d, [{"logic": "or", "conditions": [{"column": "s", "op": "eq", "value": "a"}, {"column": "v", "op": "is_null"}]}], "and", "f"),
    "mono": lambda d: fit.transform_mono(d, [{"column": "v", "method": m} for m in exprs.UNARY]),
    "combine": lambda d: fit.transform_combination(d, ["v", "id"], "ratio", "r"),
    "drop": lambda d: fit.drop_columns(d, ["s", "s"]),
    "scale": lambda d: fit.standardize(d, ["id"]),
    "pca": lambda d: fit.dim_reduct(d, "pca", 1, columns=["id"]),
}


@pytest.mark.parametrize("name", STEPS)
def test_json_round_trip_applies_alike(df, name):
    step = STEPS[name](df)
    again = loads(dumps(Node(1, step, (0,)))).step
    one, two = op_of(step)(df), op_of(again)(df)
    assert one.columns == two.columns
    for a, b in zip(one.collect(), two.collect(), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True))


def test_fills_spare_nan(df):
    filled = by_id(op_of(STEPS["zero"](df))(df), "v")
    assert filled[2] == 0 and math.isnan(filled[4])


def test_modes(df):
    out = op_of(STEPS["mode"](df))(df)
    assert by_id(out, "s")[3] == "a"  # a tie goes to the smaller value
    assert by_id(out, "b")[2] is True


def test_delete_spares_unknown(df):
    assert set(by_id(op_of(STEPS["filter"](df))(df), "id")) == {1, 2}


def test_unary_edges(spark):
    d = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, 4.0), (4, None)], "id long, x double")
    out = {m: by_id(op_of(fit.transform_mono(d, [{"column": "x", "method": m, "output_name": "y"}]))(d), "y") for m in ("log", "reciprocal", "sqrt")}
    assert out["log"][1] == -math.inf and math.isnan(out["log"][2]) and out["log"][4] is None
    assert out["reciprocal"][1] == math.inf and out["reciprocal"][3] == 0.25
    assert math.isnan(out["sqrt"][2]) and out["sqrt"][3] == 2


def test_ratio_by_negative_zero(spark):
    rows = [(1, 1.0, -0.0), (2, -1.0, -0.0), (3, 0.0, -0.0), (4, None, -0.0), (5, 1.0, 0.0), (6, math.inf, -0.0), (7, math.nan, -0.0), (8, 3.0, None), (9, 3.0, -2.0)]
    d = spark.createDataFrame(rows, "id long, x double, z double")
    step = fit.transform_combination(d, ["x", "z"], "ratio", "y")
    scope = {"df": d}
    exec(emit.HEADER + "\n".join(emit.code(step)), scope)
    for out in (by_id(op_of(step)(d), "y"), by_id(scope["df"], "y")):
        assert [str(out[i]) for i in range(1, 10)] == ["-inf", "inf", "nan", "None", "inf", "-inf", "nan", "None", "-1.5"]


def test_statistics_stay_frozen(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    step = fit.standardize(train, ["x"])
    assert [r[0] for r in op_of(step)(spark.createDataFrame([(2.0,)], "x double")).collect()] == [0.0]


@pytest.mark.parametrize(
    "ask",
    [
        lambda d: fit.drop_columns(d, ["nope"]),
        lambda d: fit.drop_columns(d, []),
        lambda d: fit.fill_missing(d, [{"column": "s", "action": "avg"}]),
        lambda d: fit.fill_missing(d, [{"column": "v", "action": "zero"}, {"column": "v", "action": "mode"}]),
        lambda d: fit.standardize(d, ["v"]),
        lambda d: fit.filter_rows(d, [], "and"),
        lambda d: fit.filter_rows(d, [{"logic": "and", "conditions": [{"column": "v", "op": "gt", "value": True}]}]),
        lambda d: fit.transform_combination(d, ["v", "v"], "sum", "t"),
        lambda d: fit.transform_mono(d, [{"column": "v", "method": "cos", "output_name": "s"}]),
        lambda d: fit.encode(d, [("s", "other")]),
        lambda d: fit.dim_reduct(d, "pca", 9),
        lambda d: profile.describe(d, ["s"]),
        lambda d: profile.histogram(d, "s"),
    ],
)
def test_refused(df, ask):
    with pytest.raises(StepError):
        ask(df)


def test_codec_refuses_foreign_types():
    with pytest.raises(TypeError):
        dumps(Node(1, Step("drop_columns", {"columns": ("a",)})))
    text = dumps(Node(1, Step("standardize", {"x": [math.nan, -math.inf, -0.0, True, 1]})))
    back = loads(text).step.params["x"]
    assert math.isnan(back[0]) and back[1] == -math.inf and str(back[2]) == "-0.0" and back[3] is True and type(back[4]) is int


def test_versions_fork_restore_and_script(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("depth,shore\n7,east\n12,west\n9.5,east\n")
    ledger = Ledger(str(tmp_path / "l.db"))
    store = VersionStore(spark, sink=lambda node, text: ledger.record("t", node, text))
    store.load(path)
    assert [t for _, t in store.get().dtypes] == ["double", "string"]
    label = store.derive(fit.encode(store.get(), [("shore", "label")]))
    scaled = store.derive(fit.standardize(store.get(), ["depth"]))
    fork = store.derive(fit.drop_columns(store.get(label), ["shore"]), parent=label)
    again = VersionStore.restored(spark, ledger.versions("t"), scaled)
    for v in (label, scaled, fork):
        assert sorted(again.get(v).collect()) == sorted(store.get(v).collect())
    out = str(tmp_path / "out")
    exec(store.script(scaled, out, "parquet"), {})
    assert sorted(spark.read.parquet(out).collect()) == sorted(store.get(scaled).collect())
    assert store.cache(scaled).count() == 3 and store.listing().count() == 4
    with pytest.raises(StepError):
        store.unpin(store.derive_by(lambda d: d))
    assert ledger.forget("t") == 4


def test_sandbox_and_formats(tmp_path):
    assert io.within(str(tmp_path), "a/b") and io.within(str(tmp_path), "../x") is None
    assert io.resolve_format("a.PQ") == "parquet" and io.resolve_format("a") == "csv"
    with pytest.raises(ValueError):
        io.resolve_format("a.xlsx")


def test_numerics():
    assert math.isclose(linalg.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert profile.merge_low([1, 2, 9, 1], [2.0, 3.0, 6.0, 1.0]) == ([3, 10], [5.0, 7.0])


def test_histogram_edges(spark):
    d = spark.createDataFrame([(float(x),) for x in (0, 2, 4, 4.5, 16, 9)], "v double")
    assert [r["count"] for r in profile.histogram(d, "v", 8).orderBy("bin").collect()] == [2, 1, 1, 0, 1, 0, 0, 1]
    assert profile.histogram(d.where("v < 0"), "v").count() == 0
    assert [r["label"] for r in profile.histogram(d, "v", 2).orderBy("bin").collect()] == ["[0.0, 8.0]", "(8.0, 16.0]"]


@pytest.mark.parametrize(("ranked", "accuracy"), [(20_000, 5_000), (10, 20), (2, 4)])
def test_order_statistics(spark, monkeypatch, ranked, accuracy):
    monkeypatch.setattr(ranks, "RANKED", ranked)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rnd = random.Random(3)
    columns = {
        "a": [rnd.choice([None, 1.5, 1.5, rnd.gauss(0, 100)]) for _ in range(700)], "b": [rnd.randint(-3, 3) * 1.0 for _ in range(700)],
        "c": [rnd.choice([math.nan, math.inf, -math.inf, 0.0, rnd.random()]) for _ in range(700)],
    }
    d = spark.createDataFrame(list(zip(*columns.values(), strict=True)), "a double, b double, c double")
    for name, values in columns.items():
        ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        asked = [0, 1, len(ordered) // 3, len(ordered) // 2, len(ordered) - 1, len(ordered)]
        got = ranks.order_statistics(d, {name: asked}, {name: len(ordered)})[name]
        assert all(same(x, y) for x, y in zip(got, [*[ordered[k] for k in asked[:-1]], None], strict=True))


def test_describe_of_no_values(spark):
    d = spark.createDataFrame([(None, 3), (None, 4)], "x double, y int")
    rows = {r["column"]: r for r in profile.describe(d).collect()}
    assert rows["x"]["count"] == 0 and rows["x"]["median"] is None and rows["y"]["median"] == 3.5 and rows["y"]["q1"] == 3


def test_long_maps_are_tables(spark, monkeypatch):
    rows = [(i, f"v{i * 7 % 50:02d}" if i % 9 else None, i % 13, float(i) if i % 4 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, s string, g int, x double").repartition(5)
    asks = [lambda: fit.encode(d, [("s", "label")]), *[lambda a=a, c=c: fit.fill_missing(d, [{"column": c, "action": a, "group_by": "g"}]) for a, c in (("avg", "x"), ("median", "x"), ("mode", "s"))]]
    short = [ask() for ask in asks]
    monkeypatch.setattr(fit, "MAP_LIMIT", 5)
    for one, ask in zip(short, asks, strict=True):
        step = loads(dumps(Node(1, ask(), (0,)))).step
        assert "_table" in str(step.params) and "_table" not in str(one.params)
        assert sorted(map(str, op_of(step)(d).collect())) == sorted(map(str, op_of(one)(d).collect()))
        names = {"df": d, "spark": spark}
        exec(emit.HEADER + "\n".join(emit.code(step)), names)
        assert sorted(map(str, names["df"].collect())) == sorted(map(str, op_of(one)(d).collect()))


@pytest.mark.parametrize("name", STEPS)
def test_emitted_code_applies_alike(df, name):
    step = STEPS[name](df)
    scope: dict = {}
    exec(emit.HEADER, scope)
    scope["df"] = df
    exec("\n".join(emit.code(step)), scope)
    one, two = op_of(step)(df), scope["df"]
    assert one.columns == two.columns
    for a, b in zip(sorted(one.collect(), key=str), sorted(two.collect(), key=str), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True))


def test_script_runs_without_this_package(spark, tmp_path):
    source, out = tmp_path / "in.csv", tmp_path / "made"
    source.write_text("depth,kind,size\n1,reef,10\n2,sand,\n3,reef,5\n8,kelp,7\n")
    store = VersionStore(spark)
    store.load(str(source))
    for made in (
        lambda d: fit.fill_missing(d, [{"column": "size", "action": "median", "add_indicator": True}]),
        lambda d: fit.encode(d, [("kind", "one_hot")]),
        lambda d: fit.transform_mono(d, [{"column": "depth", "method": "log"}, {"column": "depth", "method": "power", "exponent": 0.5}]),
        lambda d: fit.transform_combination(d, ["depth", "size"], "ratio", "share"),
        lambda d: fit.create_indicator(d, [{"conditions": [{"column": "depth", "op": "ge", "value": 2}]}], "and", "deep"),
        lambda d: fit.dim_reduct(d, "pca", 1, columns=["depth", "size"]),
    ):
        store.derive(made(store.get()))
    script = tmp_path / "run.py"
    done = store.export(store.head, str(script))
    assert done["format"] == "py" and "vframe" not in re.sub('""".*?"""', "", script.read_text(), flags=re.S)
    script.write_text(store.script(store.head, str(out), "parquet"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-I", str(script)], check=True, env=env, cwd=tmp_path, capture_output=True)
    assert sorted(map(str, spark.read.parquet(str(out)).collect())) == sorted(map(str, store.get().collect()))


def test_commit_summary_info_and_catalogue(spark, tmp_path, df):
    ledger = Ledger(str(tmp_path / "l.db"))
    store = VersionStore(spark)
    store.add_source(lambda: df)
    done = store.commit(lambda d: fit.fill_missing(d, [{"column": "v", "action": "avg", "add_indicator": True, "group_by": "g"}, {"column": "s", "action": "delete"}]))
    assert (done["new_data_version"], done["rows_before"], done["rows_after"]) == (1, 5, 4) and len(done["preview"]) == 4
    assert done["summary"][0] == {"column": "v", "method": "avg by g", "nulls_before": 1, "nulls_filled": 1}
    assert done["summary"][1:] == [{"column": "s", "method": "delete", "nulls_before": 1, "rows_deleted": 1}, {"column": "v", "indicator_column": "v_is_missing", "action": "add_indicator", "nulls_flagged": 1}]
    bad = store.commit(lambda d: fit.drop_columns(d, ["nope"]))
    assert bad["error"] and store.head == 1
    info = store.info(0)
    assert info["children"] == [1] and info["pinned"] and store.info()["kind"] == "fill_missing"
    with pytest.raises(KeyError):
        store.info(9)
    out = store.export_and_record(1, str(tmp_path / "a/b/out.csv"), ledger, "t", description="d", single=True)
    assert (out["rows"], out["cols"]) == (4, 6) and (tmp_path / "a/b/out.csv").is_file()
    store.export_and_record(1, str(tmp_path / "c/folder.parquet"), None, "t")
    assert ledger.exports() == [("t", 1, out["path"], "csv", "d", 4, 6)] == ledger.exports("t") and ledger.exports("u") == []


def test_sessions(tmp_path):
    ledger = Ledger(str(tmp_path / "l.db"))
    ledger.touch("a", "first", "w")
    ledger.touch("b", "second", "x")
    assert ledger.rename("a", "renamed") and not ledger.rename("z", "n")
    assert ledger.conversations("w") == [("a", "renamed", "w")] and len(ledger.conversations()) == 2
    assert ledger.remove("a") and not ledger.remove("a") and ledger.conversations() == [("b", "second", "x")]


def test_listing_and_head(spark, tmp_path, df):
    (tmp_path / "z").mkdir()
    for i in range(4):
        (tmp_path / f"F{i}").write_bytes(b"x" * (600 * 10**i))
    shown, total = io.listing(str(tmp_path), 3)
    assert shown == [("z", True, ""), ("F0", False, "600B"), ("F1", False, "5.9KB")] and total == 5
    names, rows = io.head(df)
    assert names == df.columns and len(rows) == 5


def test_reports_count_what_they_leave_out(spark, df):
    assert caps.capped([1, 2, 3], 2) == ([1, 2], {"truncated": True, "shown": 2, "total": 3}) and caps.capped([1], 2) == ([1], None)
    wide = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(230)])
    found = profile.report(wide)
    assert (found["shown"], found["total"], len(found["columns"]), found["rows"]) == (200, 230, 200, 3)
    assert profile.schema_report(wide).count() == 230 and profile.describe(wide).count() == 230
    assert "truncated" not in profile.report(df)
    many = spark.range(120).select(F.col("id").cast("string").alias("s"))
    assert summary.of_step(fit.encode(many, [("s", "label")]), many)[0]["total"] == 120
    assert summary.in_words([{"conditions": [{"column": "a", "op": "ge", "value": 1}, {"column": "b", "op": "is_not_null"}], "logic": "or"}, {"conditions": [{"column": "c", "op": "eq", "value": "x"}]}]) == "(a >= 1 or b is not null) and c = 'x'"


def test_lda_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) + np.repeat([[0, 0, 0], [2, 1, 0], [0, 3, 1]], 30, 0)
    labels = [*"a" * 30, *"b" * 30, *"c" * 30]
    rows = [(*map(float, r), k) for r, k in zip(x, labels, strict=True)] + [(9.0, 9.0, 9.0, None)]
    d = spark.createDataFrame(rows, "f1 double, f2 double, f3 double, k string")
    out = op_of(fit.dim_reduct(d, "lda", 2, target="k"))(d).toPandas()
    assert len(out) == 90  # rows without a target are no part of it
    means = np.array([x[i * 30 : i * 30 + 30].mean(0) for i in range(3)])
    within = sum((x[i * 30 : i * 30 + 30] - means[i]).T @ (x[i * 30 : i * 30 + 30] - means[i]) for i in range(3))
    between = 30 * (means - x.mean(0)).T @ (means - x.mean(0))
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    order = values.real.argsort()[::-1][:2]
    y = out[["ld1", "ld2"]].to_numpy()
    for i, k in enumerate(order):
        assert abs(abs(np.corrcoef(y[:, i], x @ vectors[:, k].real)[0, 1]) - 1) < 1e-9
    folded = y - y.mean(0)
    assert abs(folded[:, 0] @ folded[:, 1]) < 1e-6 * (folded[:, 0] @ folded[:, 0])


def test_monte_carlo_fit(spark):
    rng = np.random.default_rng(42)
    values = rng.normal(100, 15, 400)
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    one = profile.fit_distributions(d, "v", method="mc").collect()
    assert one == profile.fit_distributions(d.repartition(7), "v", method="mc").collect()  # however rows are dealt
    by_name = {r["distribution"]: r for r in one}
    ordered = np.sort(values)
    z = (ordered - values.mean()) / values.std()
    cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    n = len(values)
    assert math.isclose(by_name["normal"]["statistic"], max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()), rel_tol=1e-6)
    assert by_name["normal"]["p_value"] > 0.05 > by_name["exponential"]["p_value"]


def test_exponential_fit(spark):
    values = np.random.default_rng(7).exponential(3.0, 4000)
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["distribution"]: r for r in profile.fit_distributions(d, "v").collect()}["exponential"]
    low, scale = values.min(), values.mean() - values.min()
    edges = np.linspace(low, values.max(), 11)
    at = np.array([0.0, *(1 - np.exp(-(edges[1:-1] - low) / scale)), 1.0])
    observed = np.array([((values > a) & (values <= b)).sum() for a, b in zip(edges, edges[1:])])
    observed[0] += (values == low).sum()
    o, e = profile.merge_low(observed.tolist(), (4000 * np.diff(at)).tolist())
    assert math.isclose(got["statistic"], sum((a - b) ** 2 / b for a, b in zip(o, e)), rel_tol=1e-6) and got["p_value"] > 0.001


def test_memory(spark):
    said = ['```json\n{"user_goal": "g", "key_findings": "one", "progress": ""}\n```', '{"用户目标": "z", "关键发现": ["a", " ", "b"], "进展": "p"}', "[1]", "no", None, '{"key_findings": []}']
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", text.parsed_memory(F.col("t")).alias("m"))
    got = {r["i"]: r["m"] for r in rows.collect()}
    assert tuple(got[0]) == ("g", ["one"], "") and tuple(got[1]) == ("z", ["a", "b"], "p") and got[2] is got[3] is got[4] is None and tuple(got[5]) == ("", [], "")
    shown = {r["i"]: r["t"] for r in rows.select("i", text.rendered_memory(F.col("m")).alias("t")).collect()}
    assert shown[0] == "Goal: g\nFindings:\n- one" and shown[1] == "Goal: z\nFindings:\n- a\n- b\nProgress: p" and shown[5] == ""


def test_reducers(spark):
    now = spark.createDataFrame([(1, "a", "open"), (4, "b", "open")], "id long, content string, status string")
    news = spark.createDataFrame([(None, "n1", "open", 1), (4, None, "done", 2), (9, "u", None, 3), (None, "n2", None, 4), (4, "bb", None, 5)], "id long, content string, status string, seq int")
    got = {r["id"]: (r["content"], r["status"]) for r in text.upsert_by_id(now, news).collect()}
    assert got == {1: ("a", "open"), 4: ("bb", "done"), 9: ("u", None), 10: ("n1", "open"), 11: ("n2", None)}
    steps = spark.createDataFrame([("k", 2, "x", 1), ("k", None, None, 2)], "k string, n int, v string, seq int")
    assert text.latest(steps, "k", "v", "seq").first()["v"] is None and text.turns_added(steps, "k", "n").first()["turns"] == 3


def test_tool_calls_and_budget(spark):
    d = spark.createDataFrame([(1, "assistant", "abcdefghij", '[{"name": "f"}]'), (1, "tool", "0123456789", None)], "conv_id int, role string, text string, tool_calls string")
    found = text.context_breakdown(d, tools=["x" * 10], factor=2.0).first()
    assert (found["assistant"], found["tool_results"], found["tools"], found["total"]) == (22, 14, 6, 42)
    shares = spark.createDataFrame([(-0.5,), (0.26,), (3.0,)], "x double").select(text.bar_fill(F.col("x"), 10).alias("n")).collect()
    assert [r["n"] for r in shares] == [0, 3, 10]


def test_shell(spark, tmp_path):
    (tmp_path / "reef.csv").write_text("depth,kind\n1,a\n2,b\n")
    shell = cli.Shell(spark, tmp_path)
    assert shell.run("/load-file reef.csv") == "version 0: depth, kind"
    shell.store.derive(fit.standardize(shell.store.get(), ["depth"]), description="scaled")
    assert shell.run("versions").splitlines() == ["  0 source initial load", "* 1 standardize scaled"]
    assert shell.run("export 0 'out/a copy.csv'").endswith("2 rows, 2 columns") and (tmp_path / "out/a copy.csv").is_file()
    assert shell.run("export run.py").endswith("run.py") and "reef.csv" in (tmp_path / "run.py").read_text()
    assert "out/" in shell.run("ls") and shell.run("ls ../..").startswith("error")
    assert shell.run("report").startswith("2 rows, 2 columns")
    thread = shell.thread
    again = cli.Shell(spark, tmp_path)
    assert again.run("conversations") == f"{thread} reef.csv" and again.run(f"conversations resume {thread}") == "2 versions, head 1"
    assert sorted(again.store.get().collect()) == sorted(shell.store.get().collect())
    assert again.run("switch 0") == "head 0" and again.run("switch 7").startswith("error")
    assert again.run(f"conversations rename {thread} new name") == "done" and again.run("conversations") == f"{thread} new name"
    assert again.run(f"conversations delete {thread}") == "done" and again.run(f"conversations resume {thread}").startswith("error")
    assert cli.hints("/e") == [cli.HELP["export"], cli.HELP["exit"]] and again.run("nope") == "no command 'nope'" and cli.parsed(" / ") == ("", [])
    assert again.run("exit") == "" and again.done


def test_names_of_fits():
    assert [profile.fit_method(n) for n in ("Monte Carlo", "mc", "K-S", "chi2", None, "?")] == ["monte_carlo"] * 3 + ["chi2"] * 3
    assert set(linalg.CANDIDATES) == set(linalg.PARAMETERS)


def test_calibration(spark):
    rows = spark.createDataFrame([(1.0, 100, 200), (1.0, 10, 200), (1.0, 100, 10_000), (1.0, 100, None)], "p double, e int, a int")
    got = [r["n"] for r in rows.select(text.calibrated(F.col("p"), F.col("e"), F.col("a")).alias("n")).collect()]
    assert got == [1.3, 1.0, 5.0, 1.0]
