"""History in batch and as streams; index maintenance."""

import pytest
from pyspark.sql import functions as F

from lodesift.catalogue.turns import history_stream, log_stream
from lodesift.operators.embed import HashedEncoder
from lodesift.operators.history import with_history
from lodesift.operators.lexical import corpus_statistics, read_corpus, term_statistics
from lodesift.schemas import TURN
from lodesift.sources.store import IndexStore
from lodesift.streaming.conversation import append_turns, recent_turns, write_histories, write_recent
from lodesift.streaming.index_updates import maintain_index


def plain_history(log):
    out, seen = {}, {}
    for conv, turn, role, text in sorted(log):
        lines = seen.setdefault(conv, [])
        out[conv, turn] = "Recent conversation:\n" + "\n".join(lines[-6:]) + "\n\n" if lines else ""
        body = text[:300] + "…" if role == "assistant" and len(text) > 300 else text
        lines.append(f"  {role}: {body}")
    return out


@pytest.fixture(scope="module")
def log():
    rows = [(1, n * 3, ("user", "assistant", "system")[n % 3], f"text {n}") for n in range(25)]
    rows += [(2, 0, "user", "u" * 400), (2, 1, "assistant", "a" * 300), (2, 2, "assistant", "b" * 301), (2, 9000, "user", "late")]
    return rows + [(3, 5, "user", "alone")]


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_w3_history(spark, log, chunk):
    turns = spark.createDataFrame(log, TURN).repartition(5)
    got = {(r["conv_id"], r["turn"]): r["history"] for r in with_history(turns, chunk=chunk).collect()}
    assert got == plain_history(log)


def write_parts(spark, path, parts, schema):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_r1_streams(spark, log, tmp_path):
    first, second = [r for r in log if r[1] < 30], [r for r in log if r[1] >= 30]
    source = str(tmp_path / "in")
    def run():
        stream = spark.readStream.schema(TURN).parquet(source)
        write_recent(recent_turns(stream), str(tmp_path / "recent"), str(tmp_path / "ck1")).awaitTermination()
        append_turns(stream, str(tmp_path / "log"), str(tmp_path / "ck2")).awaitTermination()
    for part in (first, second):
        write_parts(spark, source, [part], TURN)
        run()
    run()       # nothing new
    got = {(r["conv_id"], r["turn"]): r["history"] for r in spark.read.parquet(str(tmp_path / "recent")).collect()}
    assert got == plain_history(log)
    stored = spark.read.parquet(str(tmp_path / "log")).select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, stored.collect())) == sorted(log)
    # A repeated batch replaces its own folder.
    spark.createDataFrame(second, TURN).write.mode("overwrite").parquet(str(tmp_path / "log" / "batch=1"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(log)


def test_r2_index_maintenance(spark, tmp_path):
    schema = "doc_id long, text string"
    parts = [[(n, f"word{n} common") for n in range(10)], [(n, f"word{n} common") for n in range(8, 20)]]
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        maintain_index(stream, path, str(tmp_path / checkpoint), "docs", encoder=HashedEncoder(16)).awaitTermination()
    for part in parts:
        write_parts(spark, source, [part], schema)
        run("ck")
    store = IndexStore(spark, path)
    assert store.count() == 20 and store.vectors().count() == 20 and store.postings().count() == 40
    direct = spark.createDataFrame([(n, f"word{n} common") for n in range(20)], schema)
    order = F.col("term")
    # Frequencies as counted from the texts, totals as stored with the newest batch.
    counted = term_statistics(direct)
    assert sorted(map(tuple, store.terms().collect())) == sorted(map(tuple, counted.filter("term IS NOT NULL").select("term", "df").collect()))
    assert store.snapshot().corpus.__dict__ == pytest.approx(read_corpus(corpus_statistics(counted)).__dict__)
    assert store.terms().orderBy(order).first()["term"] == "common"
    store.append(direct, "replay", HashedEncoder(16))       # all known: nothing is added
    assert store.count() == 20 and store.terms().filter("term = 'common'").first()["df"] == 20


def test_r1_histories_of_a_hot_conversation(spark, tmp_path):
    """A conversation with most of the rows, in micro-batches, with a restart and a repeated batch folder."""
    turns = [(1, n, "user" if n % 2 else "assistant", f"t{n} " * (n % 90)) for n in range(90)] + [(2 + n % 7, 100 + n, "user", f"u{n}") for n in range(60)]
    schema = "conv_id long, turn long, role string, text string"
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        write_histories(stream, out, check, chunk=4).awaitTermination()

    arrive([t for t in turns if t[1] < 30])
    arrive([t for t in turns if 30 <= t[1] < 70])
    arrive([t for t in turns if t[1] >= 70])
    got = {(r["conv_id"], r["turn"]): r["history"] for r in spark.read.parquet(f"{out}/turns").collect()}
    want = {(r["conv_id"], r["turn"]): r["history"] for r in with_history(spark.createDataFrame(turns, schema)).collect()}
    assert got == want and len(got) == len(turns)
    last = spark.read.parquet(f"{out}/last").filter("conv_id = 1 AND batch = 2").count()
    assert last == 6


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("folder", [False, True])
def test_streams_of_a_table_in_one_file_or_a_folder(spark, log, tmp_path, files, folder):
    given = [r for r in log if r[0] == 1 or files == 1]
    rows, path = spark.createDataFrame(given, TURN), tmp_path / "conversations.parquet"
    if folder:
        rows.repartition(files).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
    told = {(r["conv_id"], r["turn"]): r["history"] for r in history_stream(spark, str(tmp_path)).collect()}
    assert told == plain_history(given)
    assert sorted(map(tuple, log_stream(spark, str(tmp_path)).collect())) == sorted(given)
