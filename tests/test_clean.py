"""Cleaning, tags, years, deduplication, flags, CSV reading."""

import pytest
from pyspark.sql import functions as F

from lodesift.config import PANDAS_MISSING_TOKENS, CleanConfig
from lodesift.functions.numbers import judge_score, whole_number, year_of
from lodesift.functions.text import clean_text, first_tag, parse_tags, preview, token_estimate, tokens
from lodesift.operators.clean import (
    clean_accelerator, clean_registry, cleaning_report, flag_suspicious, keep_first, registry_description, unify,
)
from lodesift.plans.preprocess import preprocess, write_preprocessed
from lodesift.schemas import ACCELERATOR_RAW, REGISTRY_RAW
from lodesift.sources.catalog import first_rows, normalise_missing, read_csv, sanitise_for_export, write_table


def values(spark, function, items, dtype="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(items)], f"n int, v {dtype}").repartition(2)
    return [r[0] for r in df.select(function(F.col("v")).alias("out"), "n").orderBy("n").collect()]


def test_p1_whitespace(spark):
    got = values(spark, clean_text, ["a  b", "  x \n y ", None, "", "a  b", "\x1ca\x85"])
    assert got == ["a b", "x y", "", "", "a b", "a"]


def test_p2_tag_lists(spark):
    cases = {
        "['B2B', 'SaaS']": "B2B, SaaS", "[]": "", "['a', '']": "a", "plain, text": "plain, text", "[broken": "[broken",
        '["x y"]': "x y", "['it\\'s']": "it's", "['a', 3]": "a, 3", " ['a' , \"b\"] ": "a, b", "['[x]']": "[x]",
        "[1, 2.5, None]": "1, 2.5, None", r"['caf\u00e9', 'a\nb', '\x41\\n']": "café, a\nb, A\\n", "[['a']]": "[['a']]", r"['a\qb']": r"a\qb",
    }
    assert values(spark, parse_tags, list(cases)) == list(cases.values())
    assert values(spark, parse_tags, [None, "  x "]) == ["", "x"]


def test_p3_first_tag(spark):
    assert values(spark, first_tag, ["a, b", "", " c ,d", "e"]) == ["a", "", "c", "e"]


def test_p5_description_fallback(spark):
    rows = [(d, o, s) for d in ("", "D") for o in ("", "O") for s in ("", "S")]
    df = spark.createDataFrame(rows, "d string, o string, s string")
    intended = registry_description(F.col("d"), F.col("o"), F.col("s"), F.lit("web"), F.lit("t"))
    compat = registry_description(F.col("d"), F.col("o"), F.col("s"), F.lit("web"), F.lit("t"), "compat")
    for r in df.select("d", "o", "s", intended.alias("i"), compat.alias("c")).collect():
        assert r["i"] == (r["d"] or r["o"] or r["s"] or "Startup in web industry. Tags: t")
        assert r["c"] == (r["d"] or r["o"])


def test_p6_p7_years(spark):
    assert values(spark, lambda c: year_of(c, "yyyy-MM-dd"), ["2007-03-01", "2007-13-01", "01/02/2008", None]) == [
        2007, None, None, None]
    assert values(spark, whole_number, ["2010", "2010.0", "2010.5", "abc", None, " 1899 ", "1e12"]) == [
        2010, 2010, None, None, None, 1899, None]


def test_p16_p26_p27(spark):
    assert values(spark, tokens, ["Hi A1 x-ray é", None]) == [["hi", "a1", "ray"], []]
    assert values(spark, lambda c: preview(c, 3), ["abc", "abcd", None]) == ["abc", "abc…", None]
    assert values(spark, token_estimate, [" a  b\tc ", "", None]) == [6, 0, 0]


def test_p25_judge_text(spark):
    texts = ["0.8", ".5", "-0.3", "8/10", "Score: 0.75.", "n/a", None]
    assert values(spark, judge_score, texts) == [0.8, 1.0, 0.3, 1.0, 0.75, 0.0, 0.0]


def test_p12_flags(spark):
    data = [
        ("A", "d" * 30, 2000), ("Ab", "d" * 19, 2000), ("Ab", "d" * 20, 2000), ("test", "d" * 30, None),
        ("DEMO", "d" * 30, None), ("company12", "d" * 30, None), ("company", "d" * 30, None), ("testing", "d" * 30, None),
        ("my company", "d" * 30, None), ("Ok", "d" * 30, 1899), ("Ok", "d" * 30, 1900), ("Ok", "d" * 30, 2026),
        ("Ok", "d" * 30, 2027), (None, None, None),
    ]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(data)], "n int, name string, description string, founded_year int")
    got = [r[0] for r in flag_suspicious(df, 2025).orderBy("n").select("is_suspicious").collect()]
    assert got == [True, True, False, True, True, True, True, False, False, True, False, False, True, True]
    reasons = flag_suspicious(df, 2025, reasons=True).filter("n = 13").first()["reasons"]
    assert reasons == ["short_name", "short_description"]
    assert flag_suspicious(df).count() == len(data)


def test_w1_keep_first(spark):
    data = [(1, "Acme", None), (0, "ACME", None), (2, "acme", 2000), (3, "Acme", 2000), (4, "Other", None)]
    df = spark.createDataFrame(data, "ordinal int, name string, year int").repartition(3)
    keys = [F.lower("name"), F.col("year")]
    once = keep_first(df, keys)
    assert sorted(r["ordinal"] for r in once.collect()) == [0, 2, 4]
    assert sorted(keep_first(once, keys).collect()) == sorted(once.collect())
    assert "WindowGroupLimit" in once._jdf.queryExecution().executedPlan().toString()


def accelerator(spark, rows):
    columns = "company_id string, company_name string, short_description string, long_description string, tags string, country string, year_founded string, ordinal int"
    return spark.createDataFrame(rows, columns)


def test_clean_accelerator(spark):
    raw = accelerator(spark, [
        ("1", " Acme ", "short text here", "", "['Fin  tech', 'API']", "US", "2010.0", 1),
        ("2", "ACME", "x", "a later duplicate", "[]", "US", "2010", 2),
        ("3", "", "s", "no name at all here", "[]", "US", "2010", 3),
        ("4", "Tiny", "s", "ten chars!", "[]", "US", None, 4),
        ("5", "Elev", "s", "eleven char", "[]", None, None, 5),
    ])
    got = clean_accelerator(raw).orderBy("ordinal").drop("ordinal").collect()
    assert [tuple(r) for r in got] == [
        ("1", "Acme", "short text here", "Fin tech", "Fin tech, API", "US", 2010, "YC"),
        ("5", "Elev", "eleven char", "", "", "", None, "YC"),
    ]


def test_cross_source_duplicates_survive(spark):
    a = clean_accelerator(accelerator(spark, [("1", "Acme", "", "a description", "[]", "US", "2010", 1)]))
    raw = spark.createDataFrame(
        [("9", "Company", "Acme", "", "2010-01-01", "US", "", "another description", "", "", 1),
         ("8", "Person", "Acme", "", "2010-01-01", "US", "", "another description", "", "", 2)],
        "id string, entity_type string, name string, category_code string, founded_at string, country_code string, "
        "short_description string, description string, overview string, tag_list string, ordinal int")
    both = unify(a, clean_registry(raw))
    assert sorted(r["startup_id"] for r in both.collect()) == ["1", "9"]


def test_cleaning_report_counts_and_zero_rows(spark):
    raw = spark.createDataFrame([("YC", 10, 10), ("Crunchbase", 0, 0)], "source string, raw_rows long, entity_rows long")
    flagged = spark.createDataFrame([("YC", True)] * 2 + [("YC", False)] * 6, "source string, is_suspicious boolean")
    got = {r["source"]: r.asDict() for r in cleaning_report(raw, flagged).collect()}
    assert got["YC"]["drop_pct"] == 20.0 and got["YC"]["suspicious_rows"] == 2
    assert got["Crunchbase"]["drop_pct"] == 0.0 and got["all"]["kept_rows"] == 8


def test_csv_reading_and_preprocess(spark, tmp_path):
    head = "company_id,company_name,short_description,long_description,tags,country,year_founded,website\n"
    (tmp_path / "first.csv").write_text(
        head + '1,Acme,short,"line one\nline ""two"" here","[\'a\', \'b\']",NA,2010,w\n2,Beta,,long enough text,[],US,x,w\n')
    (tmp_path / "second.csv").write_text(head + "3,ACME,short,a newer description,[],US,2010,w\n4,Gamma,,another long text,[],DE,2011,w\n")
    (tmp_path / "registry.csv").write_text(
        "id,entity_type,name,category_code,founded_at,country_code,short_description,description,overview,tag_list\n"
        "c:1,Company,Acme,web,2007-03-01,US,,,,alpha\nc:2,Person,Bob,,,,,a long description,,\n"
        "c:3,Company,None,web,bad,NA,,a long description,,\n")
    paths = [str(tmp_path / "first.csv"), str(tmp_path / "second.csv")]
    done = preprocess(spark, paths, str(tmp_path / "registry.csv"), as_of_year=2025)
    got = {r["startup_id"]: r for r in done.unified.collect()}
    assert sorted(got) == ["1", "2", "4", "c:1", "c:3"]
    assert got["1"]["description"] == 'line one line "two" here' and got["1"]["country"] == "NA"
    assert got["c:1"]["description"] == "Startup in web industry. Tags: alpha" and got["c:1"]["founded_year"] == 2007
    compat = preprocess(spark, paths, str(tmp_path / "registry.csv"), as_of_year=2025, mode="compat",
                        missing=PANDAS_MISSING_TOKENS)
    assert sorted(r["startup_id"] for r in compat.unified.collect()) == ["1", "2", "4"]
    report = {r["source"]: r for r in done.report.collect()}
    assert report["Crunchbase"]["raw_rows"] == 3 and report["Crunchbase"]["entity_rows"] == 2
    assert report["YC"]["kept_rows"] == 3
    for fmt in ("parquet", "csv"):
        write_preprocessed(done, str(tmp_path / fmt), fmt)
        reader = spark.read.parquet if fmt == "parquet" else (lambda p: spark.read.csv(p, header=True))
        assert reader(str(tmp_path / fmt / "startups_unified")).count() == 5
        assert reader(str(tmp_path / fmt / "accelerator_cleaned")).count() == 3


def test_csv_ordinal_is_file_order(spark, tmp_path):
    lines = "".join(f"{n},Company,N{n},,,,,,,\n" for n in range(5000))
    path = tmp_path / "big.csv"
    path.write_text(",".join(REGISTRY_RAW.fieldNames()) + "\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        df = read_csv(spark, str(path), REGISTRY_RAW, multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        assert [int(r["id"]) for r in df.orderBy("ordinal").select("id").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("company_id,company_name\n1,a\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_csv(spark, str(tmp_path / "bad.csv"), ACCELERATOR_RAW)


def test_missing_tokens_limit_sanitise_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "NA", "a\x01b"), (2, "", None), (3, "x", "c\td")], "id int, a string, b string")
    assert [r["a"] for r in normalise_missing(df).orderBy("id").collect()] == ["NA", None, "x"]
    assert [r["a"] for r in normalise_missing(df, PANDAS_MISSING_TOKENS).orderBy("id").collect()] == [None, None, "x"]
    assert [r["b"] for r in sanitise_for_export(df).orderBy("id").collect()] == ["ab", "", "c\td"]
    assert [r["id"] for r in first_rows(df, "id", 2).collect()] == [1, 2] and first_rows(df, "id", None).count() == 3
    for fmt in ("json", "csv", "parquet"):
        write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xlsx")


def test_clean_is_partition_invariant(spark):
    raw = accelerator(spark, [(str(n), f"N{n % 7}", "", "some description", "[]", "US", str(2000 + n % 3), n) for n in range(200)])
    one, many = clean_accelerator(raw.coalesce(1)), clean_accelerator(raw.repartition(13))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert CleanConfig().min_description == 10
