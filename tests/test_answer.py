"""Routing, prompts, models, the two-pass answer job, external hits."""

from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodesift.config import AnswerConfig, RetrievalConfig
from lodesift.functions import rules
from lodesift.operators import prompts
from lodesift.operators.embed import HashedEncoder
from lodesift.operators.inference import Models, batch_complete
from lodesift.plans.answer import answer_queries, turns_of
from lodesift.plans.index import index_of
from lodesift.sources.external import external_hits, keep_approved, review_items


def test_p19_confidence(spark):
    cases = [(0.5, 0), (0.019, 3), (0.02, 3), (0.099, 3), (0.10, 3), (-5.0, 1)]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, best double, docs int")
    on = df.select("n", rules.confidence_band(F.col("best"), F.col("docs")).alias("c")).orderBy("n")
    assert [r["c"] for r in on.collect()] == ["none", "none", "low", "low", "high", "none"]
    off = df.select("n", rules.confidence_band(F.col("best"), F.col("docs"), RetrievalConfig(guardrails=False)).alias("c")).orderBy("n")
    assert [r["c"] for r in off.collect()] == ["none"] + ["high"] * 5


def plain_gate(confidence, retries, kind, web):
    if confidence in ("high", "low"):
        return f"generate_{kind}"
    return "rewrite" if retries < 1 else "web_search" if web else "refuse"


def plain_validate(passed, confidence, retries):
    return "end" if passed or confidence == "low" or retries >= 1 else "rewrite"


def test_p20_p21_p22_routes(spark):
    cases = list(product(["high", "low", "none"], [0, 1, 2], ["swot", "similar"], [True, False]))
    df = spark.createDataFrame(cases, "c string, r int, t string, p boolean")
    cols = (F.col("c"), F.col("r"), F.col("t"))
    for row in df.select(
        "*", rules.step_after_confidence(*cols, 1, True).alias("web"), rules.step_after_confidence(*cols, 1, False).alias("no"),
        rules.step_after_validation(F.col("p"), F.col("c"), F.col("r"), 1).alias("v"), rules.generation_step(F.col("t")).alias("g"),
    ).collect():
        assert row["web"] == plain_gate(row["c"], row["r"], row["t"], True)
        assert row["no"] == plain_gate(row["c"], row["r"], row["t"], False)
        assert row["v"] == plain_validate(row["p"], row["c"], row["r"])
        assert row["g"] == f"generate_{row['t']}"


def test_p23_p24_labels_and_verdicts(spark):
    labels = ["swot", " SWOT\t".strip("\t"), "auto", "nonsense", None, ""]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(labels)], "n int, v string")
    assert [r[0] for r in df.orderBy("n").select(rules.analysis_type(F.col("v"))).collect()] == [
        "swot", "swot", "similar", "similar", "similar", "similar"]
    cases = [(3, 0.5, "pass", None), (3, 0.5, "Pass ", None), (3, 0.5, "pass.", None), (3, 0.5, "fail", None),
             (3, 0.5, None, "boom"), (3, 0.0, "pass", None), (3, -1.2, "pass", None), (0, 0.5, "pass", None), (3, 0.5, None, None)]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, d int, b double, r string, e string")
    got = [r[0] for r in df.orderBy("n").select(rules.verdict(F.col("d"), F.col("b"), F.col("r"), F.col("e"))).collect()]
    assert got == [True, True, False, False, True, False, False, False, False]


def test_p29_prompts(spark):
    df = spark.createDataFrame([(t, "q {documents}", "d {query}") for t in [*prompts.TEMPLATES, "other"]],
                               "analysis_type string, query string, documents string")
    got = {r["analysis_type"]: r for r in prompts.add_prompts(df, on_unknown="report").collect()}
    for name, template in prompts.TEMPLATES.items():
        head, tail = template.split("{documents}")
        assert got[name]["prompt"] == head + "d {query}" + tail.replace("{query}", "q {documents}")
    assert got["other"]["prompt"] is None and "other" in got["other"]["prompt_error"]
    with pytest.raises(PySparkException):
        prompts.add_prompts(df).collect()


def test_m10_failure_capture(spark):
    df = spark.createDataFrame([(n, f"p{n}") for n in range(10)], "n int, p string").repartition(2)
    def model(batch):
        if any(p == "p7" for p in batch):
            raise RuntimeError("bad prompt")
        return [p.upper() for p in batch]
    got = {r["n"]: r for r in batch_complete(df, F.col("p"), model, "out", batch_rows=4).collect()}
    assert all(got[n]["out"] == f"P{n}" and got[n]["out_error"] is None for n in range(10) if n != 7)
    assert got[7]["out"] is None and got[7]["out_error"] == "RuntimeError: bad prompt"


DOCS = [(n, f"alpha company number{n} makes widgets\nmore about widgets") for n in range(30)]
DOCS += [(n + 30, f"beta firm number{n} sells gadgets") for n in range(30)]
QUESTIONS = [(0, "widgets alpha", ""), (1, "SWOT of gadgets beta", ""), (2, "zzz qqq www", ""), (3, "fail me widgets", ""),
             (4, "fail beta", ""), (5, "vvv uuu", "")]


@pytest.fixture(scope="module")
def index(spark):
    return index_of(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), HashedEncoder(64))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, text string, history string")


def answered(*args, **options):
    return {r["query_id"]: r for r in answer_queries(*args, **options).collect()}


@pytest.fixture
def verdict():
    def reply(batch):
        return ["fail" if "Question: fail" in p else "pass" for p in batch]
    return reply


def test_l4_l5_routes(spark, index, questions, verdict):
    external = spark.createDataFrame(
        [(2, n, f"t{n}", f"http://{n}", f"content {n}", 0.5) for n in range(7)] + [(0, 0, "t", "u", "unused", 0.1)],
        "query_id long, idx int, title string, url string, content string, score double")
    models = Models(validate=verdict)
    got = answered(questions, index, models=models, external=external)
    assert sorted(got) == list(range(6))
    assert got[0]["confidence"] == "high" and got[0]["validation_check"] and got[0]["retry_count"] == 0
    assert got[0]["answer"].startswith("Question: widgets alpha") and got[0]["num_sources"] == 5
    assert got[1]["analysis_type"] == "swot" and "## Threats" in got[1]["answer"]
    # Nothing relevant: retried once, then external results of low confidence.
    assert got[2]["retry_count"] == 1 and got[2]["web_searched"] and got[2]["confidence"] == "low"
    assert [d["text"] for d in got[2]["docs"]] == [f"content {n}" for n in range(5)]
    assert got[2]["answer"].startswith(prompts.DISCLAIMER)
    # Failed validation with retries left: one more pass, then the best effort.
    assert got[3]["retry_count"] == 1 and not got[3]["validation_check"] and got[3]["step"] == "end"
    # No external results for this one: answered without sources.
    assert got[5]["web_searched"] and got[5]["num_sources"] == 0 and not got[5]["validation_check"]

    offline = answered(questions, index, models=models)
    assert offline[2]["answer"] == prompts.REFUSAL and offline[2]["step"] == "refuse" and not offline[2]["web_searched"]
    assert offline[0]["answer"] == got[0]["answer"]

    none = answered(questions, index, models=models, external=external,
                    approvals=spark.createDataFrame([(2, 1), (2, 3)], "query_id long, idx int"))
    assert [d["text"] for d in none[2]["docs"]] == ["content 1", "content 3"]

    eager = answered(questions, index, AnswerConfig(max_retries=0), models=models)
    assert all(r["retry_count"] == 0 for r in eager.values()) and eager[2]["step"] == "refuse"


def test_models_replace_the_rules(index, questions, verdict):
    models = Models(
        classify=lambda ps: ["Competitor" for _ in ps], expand=lambda ps: [" beta gadgets " for _ in ps],
        generate=lambda ps: [f"{len(p) > 0}" for p in ps], validate=verdict, rewrite=lambda ps: [1 / 0 for _ in ps],
    )
    got = answered(questions, index, models=models)
    assert {r["analysis_type"] for r in got.values()} == {"competitor"}
    assert {r["expanded_query"] for r in got.values()} == {"beta gadgets"}
    assert {r["answer"] for r in got.values()} == {"True"}


def test_record_turns(index, questions):
    log = turns_of(answer_queries(questions, index)).orderBy("conv_id", "turn").collect()
    assert len(log) == 12 and [r["role"] for r in log[:2]] == ["user", "assistant"]
    assert log[0]["text"] == "widgets alpha" and log[0]["turn"] == 0 and log[1]["turn"] == 1


def test_s14_j8_external(spark, rows):
    hits = external_hits(spark.createDataFrame(
        [(q, i, None if i == 0 else f"t{i}", "u", "c" * 300, None) for q in (1, 2, 3) for i in (4, 2, 0)],
        "query_id long, idx int, title string, url string, content string, score double"))
    assert rows(hits, "query_id", "idx", "doc_id")[:3] == [(1, 0, "web_0"), (1, 1, "web_1"), (1, 2, "web_2")]
    assert hits.first()["confidence"] == "low" and hits.first()["score"] == 0.0
    approvals = spark.createDataFrame([(1, 0), (1, 2), (2, None)], "query_id long, idx int")
    kept = keep_approved(hits, approvals)
    assert rows(kept, "query_id", "idx") == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert keep_approved(hits, None).count() == 9
    shown = review_items(hits).filter("query_id = 1").orderBy("idx").collect()
    assert shown[0]["title"] == "Result 1" and len(shown[0]["snippet"]) == 200


def test_replies_are_made_call_by_call(spark):
    """Texts of one call are in Python at a time, also of rows with nulls; replies and errors keep their rows."""
    from lodesift.operators.inference import batch_complete

    def model(prompts):
        if "p7" in prompts:
            raise ValueError("no")
        return [p and p.upper() for p in prompts]

    rows = [(n, None if n % 10 == 3 else f"p{n}", 1.5 if n % 2 else None) for n in range(30)]
    df = spark.createDataFrame(rows, "n long, text string, x double").coalesce(1)
    done = batch_complete(df, F.col("text"), model, "reply", batch_rows=4)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    got = {r["n"]: (r["text"], r["x"], r["reply"], r["reply_error"]) for r in done.collect()}
    assert got == {n: (t, x, None if n == 7 else t and t.upper(), "ValueError: no" if n == 7 else None) for n, t, x in rows}
