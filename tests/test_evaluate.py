"""Metrics, summaries, saved runs, the evaluation job, profile and coverage."""

import json

import pytest
from pyspark.sql import functions as F

from lodesift.operators import metrics, profile
from lodesift.operators.coverage import watch_coverage
from lodesift.operators.documents import build_documents, dense_ids
from lodesift.operators.embed import HashedEncoder
from lodesift.operators.inference import Models
from lodesift.plans.evaluate import evaluate, score_results
from lodesift.plans.index import index_of
from lodesift.plans.report import coverage_report, profile_report
from lodesift.schemas import EVAL_ITEM
from lodesift.sources.runs import newest_run, read_results_csv, read_runs, run_results, write_run


def one(spark, column, **values):
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("v")).first()["v"]


def test_a16_a17_a18_metrics(spark):
    t, k, a = F.col("t"), F.col("k"), F.col("a")
    assert one(spark, metrics.precision_at_k(t, k), t=["an email", "none"], k=["AI"]) == 0.5
    assert one(spark, metrics.precision_at_k(t, k), t=["an email"], k=[]) == 0.0
    assert one(spark, metrics.precision_at_k(t, k), t=[], k=["x"]) == 0.0
    assert one(spark, metrics.structure_score(a, k), a="## STRENGTHS", k=["Strengths", "Threats"]) == 0.5
    assert one(spark, metrics.structure_score(a, k), a="x", k=[]) == 1.0
    assert one(spark, metrics.bad_result_check(t, k), t=["ends with Start", "up here"], k=["start up"]) == 0.0
    assert one(spark, metrics.bad_result_check(t, k), t=["a"], k=[]) == 1.0


RESULT = "id string, analysis_type string, context_relevancy double, groundedness double, answer_relevancy double, precision_at_k double, structure_score double, bad_result_check double, latency_seconds double, error string"


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([
        ("a", "swot", 0.9, 0.8, 0.7, 1.0, 1.0, 1.0, 2.0, None), ("b", "swot", 0.5, 0.9, 0.9, 0.5, 1.0, 0.0, 4.0, None),
        ("c", "similar", 0.7, 0.7, 0.7, 0.0, 0.5, 1.0, 6.0, None), ("d", "auto", *[None] * 7, "429"),
    ], RESULT)


def test_a19_to_a23(spark, results):
    total = metrics.run_summary(results).first()
    assert (total["total_queries"], total["successful"], total["failed"], total["error"]) == (4, 3, 1, None)
    assert total["avg_context_relevancy"] == 0.7 and total["avg_latency_seconds"] == 4.0
    failed = metrics.run_summary(results.filter("id = 'd'")).first()
    assert failed["error"] == "All queries failed" and failed["avg_groundedness"] is None
    types = metrics.summary_by_type(results).collect()
    assert [(r["analysis_type"], r["count"]) for r in types] == [("similar", 1), ("swot", 2)]
    rolled = {r["analysis_type"]: r for r in metrics.summary_rollup(results).collect()}
    assert rolled["all"]["successful"] == 3 and rolled["auto"]["failed"] == 1
    assert tuple(metrics.latency_summary(results).first()) == (4.0, 2.0, 6.0)
    assert [(r["id"], r["passed"]) for r in metrics.pass_table(results).collect()] == [("c", True), ("b", False), ("a", True)]
    rate = metrics.pass_rate(results).first()
    assert (rate["scored"], rate["passed"], rate["pass_rate"]) == (3, 2, 0.6667)
    assert metrics.metric_matrix(results).count() == 18 and metrics.metric_matrix(results, long=False).count() == 3


def test_s10_s11_saved_runs(spark, results, tmp_path):
    full = results.withColumns({"query": F.lit('a "quoted"\nquery, here'), "answer_preview": F.lit("line\nline")})
    write_run(full, str(tmp_path / "run1"), str(tmp_path / "csv1"), model_name="m", provider="p")
    back = read_results_csv(spark, str(tmp_path / "csv1"))
    assert back.count() == 3 or "model_name" not in full.columns
    (tmp_path / "saved").mkdir()
    for name, date in (("eval_1.json", "2024-01-01"), ("eval_2.json", "2024-02-01")):
        text = json.dumps({"summary": {"run_date": date, "total_queries": 2, "by_analysis_type": {"swot": {"count": 1}}},
                           "results": [{"id": "x", "query": "q", "groundedness": 0.5}, {"id": "y", "error": "429"}]}, indent=2)
        (tmp_path / "saved" / name).write_text(text)
    runs = read_runs(spark, str(tmp_path / "saved"))
    assert runs.count() == 2 and newest_run(runs).first()["run"] == "eval_2.json"
    assert runs.filter("run = 'eval_1.json'").first()["summary"]["by_analysis_type"]["swot"]["count"] == 1
    exploded = run_results(runs)
    assert exploded.count() == 4 and metrics.compare_runs(exploded).filter("failed = 1").count() == 2
    own = read_runs(spark, str(tmp_path / "run1"))
    summary = own.first()["summary"]
    assert summary["successful"] == 3 and summary["model_name"] == "m" and sorted(summary["by_analysis_type"]) == ["similar", "swot"]
    assert run_results(own).count() == 4


def test_l6_evaluation(spark):
    docs = spark.createDataFrame([(n, f"alpha widgets number{n}") for n in range(20)] + [(50, "bad apple")], "doc_id long, text string")
    items = spark.createDataFrame([
        ("s1", "alpha widgets", "similar", ["alpha"], ["bad apple"], ["Similar Companies"], "d"),
        ("s2", "alpha number3", "swot", ["nothing"], [], ["Strengths", "Costs"], "d"),
    ], EVAL_ITEM)
    index = index_of(docs, HashedEncoder(32))
    got = {r["id"]: r for r in evaluate(items, index, model_name="rules").collect()}
    assert got["s1"]["precision_at_k"] == 1.0 and got["s1"]["bad_result_check"] == 1.0 and got["s1"]["structure_score"] == 1.0
    assert got["s1"]["context_relevancy"] == 1.0 and not got["s1"]["judge_failed"] and got["s1"]["num_sources"] == 5
    assert got["s2"]["precision_at_k"] == 0.0 and got["s2"]["structure_score"] == 0.0
    def judge(ps):
        return ["no idea" if "how well the records support" in p else "8/10" for p in ps]
    judged = {r["id"]: r for r in evaluate(items, index, models=Models(judge=judge)).collect()}
    assert judged["s1"]["context_relevancy"] == 1.0 and judged["s1"]["groundedness"] == 0.0 and judged["s1"]["judge_failed"]


def test_j6_missing_and_failed_results(spark):
    items = spark.createDataFrame([(i, "q", "swot", [], [], [], "d") for i in "abc"], EVAL_ITEM)
    docs_type = "array<struct<rank:int,doc_id:bigint,text:string,score:double,rerank_score:double>>"
    results = spark.createDataFrame(
        [("a", "an answer", [(1, 1, "q text", 1.0, 1.0)], None, 1.234), ("b", None, None, "429", None)],
        f"id string, answer string, docs {docs_type}, error string, latency_seconds double")
    got = {r["id"]: r for r in score_results(items, results).collect()}
    assert got["a"]["error"] is None and got["a"]["latency_seconds"] == 1.23 and got["a"]["total_tokens"] == 4
    assert got["b"]["error"] == "429" and got["c"]["error"] == "no result" and got["c"]["groundedness"] is None


COMPANY = "ordinal int, startup_id string, name string, description string, industry string, tags string, country string, founded_year int, source string, is_suspicious boolean"


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([
        (3, "3", "Stripe", "d" * 2500, "fintech", "a, b", "US", 2010, "YC", False),
        (1, "1", "stripe inc", "d" * 40, "", "", "US", None, "Crunchbase", False),
        (2, "2", "Big Airbnb Co", "d" * 12, "travel", "", "", 1800, "Crunchbase", True),
        (5, "5", "Stripe", "d" * 100, "x", "", "DE", 2023, "Crunchbase", False),
    ], COMPANY).repartition(2)


def test_j7_t8_coverage(spark, companies):
    watch = spark.createDataFrame([("STRIPE",), ("airbnb",), ("Dropbox",), ("stripe i",), ("",)], "name string")
    got = {r["watch_name"]: tuple(r)[1:] for r in watch_coverage(companies, watch).collect()}
    assert got == {"STRIPE": ("exact", "Stripe", "YC"), "airbnb": ("partial", "Big Airbnb Co", "Crunchbase"),
                   "Dropbox": ("missing", None, None), "stripe i": ("partial", "stripe inc", "Crunchbase")}
    report = coverage_report(companies, watch)
    assert [r["startup_id"] for r in report["suspicious_sample"].collect()] == ["2"]


def test_l7_profile(companies):
    report = profile_report(companies)
    assert {r["country"]: r["count"] for r in report["top_countries"].collect()} == {"US": 2, "DE": 1}
    assert "" not in {r["industry"] for r in report["top_industries"].collect()}
    assert {r["founded_year"]: r["count"] for r in report["founded_per_year"].collect()} == {2010: 1, 2023: 1}
    assert {r["source"]: (r["clean"], r["suspicious"]) for r in report["quality_by_source"].collect()} == {"YC": (1, 0), "Crunchbase": (2, 1)}
    assert {r["is_suspicious"]: r["share"] for r in report["quality_share"].collect()} == {False: 0.75, True: 0.25}
    bins = {r["bin"]: r["count"] for r in report["description_lengths"].collect()}
    assert bins[59] == 1 and bins[0] == 2 and sum(bins.values()) == 4
    summary = report["summary"].first()
    assert (summary["total"], summary["industries"], summary["suspicious"], summary["median_year"]) == (4, 3, 1, 2010.0)
    assert report["median_description"].first()[0] == 70.0
    assert profile.length_histogram(companies.filter("ordinal = 1")).first()["bin"] == 0


def test_p13_p14_p15_documents(spark, companies):
    docs = {r["doc_id"]: r for r in build_documents(companies).collect()}
    assert docs["2"]["text"] == "Name: Big Airbnb Co\nIndustry: travel\nFounded: 1800\nDescription: " + "d" * 12
    assert docs["2"]["metadata"] == {"startup_id": "2", "source": "Crunchbase", "is_suspicious": "True", "country": "", "founded_year": "1800"}
    assert docs["1"]["metadata"]["founded_year"] == "" and "Founded" not in docs["1"]["text"]
    compat = {r["doc_id"]: r for r in build_documents(companies, float_years=True).collect()}
    assert "Founded: 1800.0" in compat["2"]["text"]
    empty = spark.createDataFrame([(1, "x", None, " ", "", None, "", None, "YC", False)], COMPANY)
    assert build_documents(empty).count() == 0


def test_w4_dense_ids(spark):
    df = spark.createDataFrame([(n * 3, f"r{n}") for n in range(500)], "ordinal int, v string").repartition(9)
    got = dense_ids(df, "ordinal").orderBy("ordinal").collect()
    assert [r["position"] for r in got] == list(range(500))
