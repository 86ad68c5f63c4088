"""Upserts, registers, issues, usage, logs, files and streams."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from wattaudit.operators import documents, issues, upserts, usage, versions
from wattaudit.operators.lookups import bounded_rows, fits, lookup_join
from wattaudit.plans.intake import bill_intake, model_inputs, tariff_intake
from wattaudit.session import work_dir
from wattaudit.sources import bills as bill_source
from wattaudit.sources import files, logs, reports, tariffs
from wattaudit.sources.snapshots import SnapshotTable
from wattaudit.streaming.logs import log_windows, read_log_stream, start_log_windows, stream_logs, window_table
from wattaudit.streaming.tables import start_update_table
from wattaudit.streaming.usage import stream_usage

from conftest import plan, rows


def d(text):
    return dt.date.fromisoformat(text)


def test_upsert_keeps_replaces_and_adds(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    changes = spark.createDataFrame([("b", 5, "p", 1), ("b", 7, None, 3), ("b", 6, "q", 2), ("c", 9, "r", 1)], "k string, v int, w string, seq int")
    assert sorted(rows(upserts.upsert(base, changes, ["k"], "seq"))) == [("a", 1, "x"), ("b", 7, None), ("c", 9, "r")]


def test_upsert_rates_replaces_the_newest_row_of_the_month(spark):
    schema = "rate_type string, id long, effective_date date, sc_code string, rate decimal(18,6)"
    base = spark.createDataFrame(
        [("tra", 1, d("2021-04-02"), "SC1", D(1)), ("tra", 2, d("2021-04-20"), "SC1", D(2)), ("tra", 3, d("2021-05-01"), "SC1", D(3)),
         ("rdm", 2, d("2021-04-20"), "SC1", D(4))], schema)
    changes = spark.createDataFrame(
        [("tra", " SC1 ", d("2021-04-15"), D(8), 1), ("tra", "SC1", d("2021-04-16"), D(9), 2), ("tra", "SC2", d("2021-04-16"), D(7), 3),
         ("tra", "", d("2021-04-16"), D(7), 4), ("tra", "SC1", None, D(7), 5), ("tra", "SC1", d("2021-05-16"), None, 6)],
        "rate_type string, sc_code string, effective_date date, rate decimal(18,6), seq int")
    got = sorted(rows(upserts.upsert_rates(base, changes)), key=str)
    assert got == sorted(
        [("tra", 1, d("2021-04-02"), "SC1", D(1)), ("tra", 2, d("2021-04-01"), "SC1", D(9)), ("tra", 3, d("2021-05-01"), "SC1", D(3)),
         ("rdm", 2, d("2021-04-20"), "SC1", D(4)), ("tra", None, d("2021-04-01"), "SC2", D(7))], key=str)


def test_update_by_key(spark):
    base = spark.createDataFrame([(1, "new", "a"), (2, "new", "b")], "id int, status string, note string")
    changes = spark.createDataFrame([(2, "done"), (9, "done")], "id int, status string")
    assert sorted(rows(upserts.update_by_key(base, changes, "id"))) == [(1, "new", "a"), (2, "done", "b")]


def test_new_documents(spark):
    incoming = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, ""), (5, None), (6, "c")], "id int, file_name string")
    known = spark.createDataFrame([("c",), ("c",)], "file_name string")
    assert sorted(rows(documents.new_documents(incoming, known))) == [(1, "b"), (2, "a")]


def test_token_map_keeps_known_tokens(spark):
    b = spark.createDataFrame([("7",), (" 7 ",), ("8",), ("",), (None,)], "bill_account string")
    empty = spark.createDataFrame([], "token string, account_number string")
    first = documents.token_map(b, empty, "k")
    assert sorted(r.account_number for r in first.collect()) == ["7", "8"]
    old = first.where("account_number = '7'").withColumn("account_number", F.lit("kept"))
    assert sorted(r.account_number for r in documents.token_map(b, old, "k").collect()) == ["8", "kept"]
    assert rows(documents.accounts(b)) == [(" 7 ",), ("7",), ("8",)]


def test_run_ledger(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, "d", "start", "running", t, None), (1, "d", "finish", "failed", t + dt.timedelta(seconds=61.9), "boom"), (2, "d", "start", "running", t + dt.timedelta(days=1), None)],
        "run_id int, dag_id string, kind string, status string, ts timestamp, error_msg string")
    ledger = documents.run_ledger(events)
    got = {r.run_id: (r.status, r.total_runtime, r.error_msg) for r in ledger.collect()}
    assert got == {1: ("failed", 61, "boom"), 2: ("running", None, None)}
    assert [r.run_id for r in documents.recent_runs(ledger, 1).collect()] == [2]


def test_issues(spark):
    b = spark.createDataFrame([(1, "7"), (2, "7"), (3, "8")], "id long, bill_account string")
    t = dt.datetime(2024, 1, 1)
    found = spark.createDataFrame(
        [(10, "7", 1, "R1", "x", t, "new"), (11, "7", 1, "R2", "x", t + dt.timedelta(1), "open"), (12, "8", 3, "R1", "x", t, "new"), (13, "8", None, "R1", "x", t, "new")],
        "id long, account_id string, user_bill_id long, issue_type string, description string, detected_on timestamp, status string")
    assert [r.id for r in issues.validation_results(found, limit=2).collect()] == [11, 10]
    assert [r.id for r in issues.validation_results(found, account="8", status="new").collect()] == [12, 13]
    joined = issues.bills_with_issues(b, found, account=" 7 ", issue_type="R1")
    assert len(joined.columns) == 22 and [(r.bill_id, r.issue_id) for r in joined.collect()] == [(1, 10)]
    assert sorted(rows(issues.flag_issues(b, found).select("id", "_has_issue"))) == [(1, 1), (2, 0), (3, 1)]


@pytest.mark.parametrize("max_rows", [0, 100])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_paths_agree(spark, max_rows, how):
    rng = random.Random(1)
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{rng.randrange(9)}", rng.randrange(10)) for i in range(300)], "id int, k string, x int")
    dim = spark.createDataFrame([("hot", 3, "a"), ("hot", 7, "b"), ("k1", 0, "c")], "k string, low int, name string")
    got = lookup_join(facts, dim, ["k"], (F.col("low") <= F.col("x")) & (F.col("x") < F.col("low") + 4), how, max_rows, salts=5)
    spans = {"hot": [(3, "a"), (7, "b")], "k1": [(0, "c")]}
    want = []
    for r in facts.collect():
        hits = [(r.id, n) for low, n in spans.get(r.k, []) if low <= r.x < low + 4]
        want += hits or ([(r.id, None)] if how == "left" else [])
    assert sorted(map(str, rows(got.select("id", "name")))) == sorted(map(str, want))


def test_size_checks(spark):
    assert fits(spark.range(5), 5) and not fits(spark.range(6), 5)
    with pytest.raises(ValueError, match="more than 2 things"):
        bounded_rows(spark.range(3), 2, "things")


def test_usage(spark):
    t = dt.datetime(2024, 1, 31, 23)
    calls = spark.createDataFrame(
        [(1, t, "llm", "gpt-4.1", 1000, 10, True), (2, t + dt.timedelta(hours=2), "llm", "gpt-4.1-mini", 7, 3, True), (3, t, "llm", "other", 5, 5, False), (4, t, "op", "put", 0, 0, False)],
        "event_id long, ts timestamp, kind string, key string, input_tokens long, output_tokens long, success boolean")
    got = {(r.month, r.model): (r.requests, r.total_tokens, r.cost) for r in usage.llm_usage(calls).collect()}
    assert got == {
        ("2024-01", None): (2, 1020, D("0.00208")), ("2024-01", "gpt-4.1"): (1, 1010, D("0.00208")), ("2024-01", "other"): (1, 10, D(0)),
        ("2024-02", None): (1, 10, D("0.0000076")), ("2024-02", "gpt-4.1-mini"): (1, 10, D("0.0000076")),
    }
    assert rows(usage.op_usage(calls, "2024-01").where("operation is null").select("requests", "failures")) == [(1, 1)]
    recent = usage.recent_calls(calls, 2)
    assert sorted((r.kind, r.event_id) for r in recent.collect()) == [("llm", 2), ("llm", 3), ("op", 4)]
    assert "WindowGroupLimit" in plan(recent)


LINES = ["2024-01-01 10:00:00 | ERROR | app.x | a | b", "", "free text", "2024-01-01 11:00:00|INFO|y|z", "  ", "2024-13-01 10:00:00 | WARN | q | r"]


def test_logs(spark, tmp_path):
    path = tmp_path / "logs"
    path.mkdir()
    (path / "a.log").write_text("\n".join(LINES) + "\n")
    got = logs.parse_logs(logs.read_log_lines(spark, str(path)), "app").orderBy("line_no").collect()
    assert [(r.line_no, r.level, r.logger_name, r.description) for r in got] == [
        (1, "ERROR", "app.x", "a | b"), (3, "INFO", None, None), (4, "INFO", "y", "z"), (6, "WARN", "q", "r")
    ]
    assert got[0].event_time == dt.datetime(2024, 1, 1, 10) and got[3].event_time is None
    assert got[0].context == {"imported": "true", "line_number": "1"}
    capped = logs.parse_logs(logs.read_log_lines(spark, str(path)), "app", 3)
    assert sorted(r.line_no for r in capped.collect()) == [1, 3]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long"
    path.mkdir()
    for name, n in (("a.log", 5000), ("b.log", 3000)):
        (path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        lines = logs.read_log_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(lines) == 8000
    assert all(r.line.endswith(f"line {r.line_no}") for r in lines)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 2.5)], "id int, t string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(rows(files.read_csv(spark, str(tmp_path / "c"), df.schema))) == sorted(rows(df))
    assert sorted(rows(files.read_json(spark, str(tmp_path / "j"), df.schema))) == sorted(rows(df))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.pdf").write_bytes(b"123")
    assert [(r.file_name, r.length) for r in files.list_documents(spark, str(tmp_path / "docs")).collect()] == [("x.pdf", 3)]
    assert files.export_results(df.withColumnRenamed("x", "kwh")).columns == ["kWh"]


def test_account_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "bills")
    data = spark.createDataFrame([("7", "4/28/21", "$5"), ("8", "bad", "x")], "bill_account string, bill_date string, bill_amount string")
    bill_source.append_bills(data, path)
    bill_source.append_bills(data, path, bill_source.next_id(spark, path))
    one = bill_source.read_bills(spark, path, " 7 ")
    assert "EqualTo(bill_account,7)" in plan(one)
    assert {(r.bill_date, r.bill_amount) for r in one.collect()} == {(d("2021-04-28"), D(5))}
    ids = [r.id for r in bill_source.read_bills(spark, path).collect()]
    assert len(ids) == 4 == len(set(ids))


def test_streams_equal_batch(spark):
    path = work_dir(spark, "calls")
    rng = random.Random(4)
    t = dt.datetime(2024, 1, 30)
    schema = "event_id long, ts timestamp, kind string, key string, input_tokens long, output_tokens long, success boolean"
    for part in range(3):  # three files: three batches
        data = [(part * 50 + i, t + dt.timedelta(hours=rng.randrange(100)), "llm", rng.choice(["gpt-4.1", "m"]), rng.randrange(900), 3, True) for i in range(50)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = work_dir(spark, "counters")
    counted = stream_usage(stream)
    stored = SnapshotTable(spark, f"{table}/rows", counted.schema, ["month", "model"], 4)
    start_update_table(counted, stored, f"{table}/checkpoint").awaitTermination()
    got = stored.read()
    want = usage.llm_usage(batch).where("model is not null")
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want.select(*got.columns))))
    assert stored.snapshot().version == 3
    # The same files once more, and a batch of which only some calls are new, with and without forgetting ids.
    batch.limit(30).unionByName(batch.limit(2).withColumn("event_id", F.lit(None).cast("long"))).coalesce(1).write.mode("append").parquet(path)
    for keep, name in ((None, "checkpoint"), ("62 days", "forgetful")):
        counted = stream_usage(stream, keep=keep)
        stored = SnapshotTable(spark, f"{table}/rows-{name}", counted.schema, ["month", "model"], 4)
        start_update_table(counted, stored, f"{table}/{name}-2").awaitTermination()
        assert sum(r.requests for r in stored.read().collect()) == 152


def test_a_repeated_epoch_changes_nothing(spark):
    """As after a failure between the commit of the table and that of the stream."""
    folder = work_dir(spark, "epochs")
    spark.range(5).selectExpr("id AS event_id", "current_timestamp() AS ts", "'llm' AS kind", "'m' AS key", "1L AS input_tokens", "1L AS output_tokens", "true AS success").write.parquet(f"{folder}/calls")
    schema = spark.read.parquet(f"{folder}/calls").schema
    for checkpoint in ("first", "second"):  # the second run knows nothing of the first one
        counted = stream_usage(spark.readStream.schema(schema).parquet(f"{folder}/calls"))
        stored = SnapshotTable(spark, f"{folder}/rows", counted.schema, ["month", "model"], 4)
        start_update_table(counted, stored, f"{folder}/{checkpoint}").awaitTermination()
        assert [r.requests for r in stored.read().collect()] == [5] and stored.snapshot().version == 1


def test_log_windows_become_final_and_late_lines_are_counted_once(spark):
    folder = work_dir(spark, "log-windows")
    stored = window_table(spark, f"{folder}/windows", 4)

    def arrive(*times, checkpoint="checkpoint"):
        if times:
            lines = [*[(f"{x} | INFO | a | b",) for x in times], ("no time",), (" ",)]
            spark.createDataFrame(lines, "line string").coalesce(1).write.mode("append").text(f"{folder}/lines")
        start_log_windows(read_log_stream(spark, f"{folder}/lines"), stored, f"{folder}/{checkpoint}", "app").awaitTermination()
        return {r.start and r.start.hour: (r.n_lines, r.n_late, r.is_final) for r in log_windows(stored).collect()}

    assert arrive("2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 11:59:00") == {10: (2, 0, False), 11: (1, 0, False), None: (1, 0, False)}
    assert arrive("2024-01-01 13:10:00", "2024-01-01 10:45:00") == {10: (3, 0, True), 11: (1, 0, False), 13: (1, 0, False), None: (2, 0, False)}
    want = {10: (3, 1, True), 11: (2, 0, False), 13: (1, 0, False), None: (3, 0, False)}
    assert arrive("2024-01-01 10:50:00", "2024-01-01 11:00:00") == want
    assert arrive() == want  # a restart without new files
    assert arrive(checkpoint="lost") == want  # batches that the table holds already


def test_reports_are_read_back_from_their_own_files(spark):
    rng = random.Random(6)
    data = [(a, b, n, f"{a} {b} {n} é{'x' * rng.randrange(30)}") for a in ("a1", "a2", "a3", "big") for b in range(40 if a == "big" else 3) for n in range(rng.randrange(1, 6))]
    data += [(None, 1, 0, "nobody\nelse"), ("a2", 9, 0, None), ("a2", 9, 1, "")]
    lines = spark.createDataFrame(data, "bill_account string, bill_no long, line_no int, line string").repartition(3)
    folder = work_dir(spark, "reports")
    reports.write_reports(lines, folder, 500)
    files = [f for f in os.listdir(f"{folder}/files") if f.startswith("file=")]
    assert len(files) > 5
    for account in ("a1", "a2", "a3", "big", None):
        want = [(x[3] or "").replace("\n", " ") for x in sorted((x for x in data if x[0] == account), key=lambda x: x[1:3])]
        found = reports.read_report(spark, folder, account)
        assert [r.line for r in found.collect()] == want
        named = spark.read.parquet(f"{folder}/index").where(F.col("bill_account").eqNullSafe(F.lit(account))).count()
        assert sum("/files/" in f for f in found.inputFiles()) == named < len(files)
    assert reports.read_report(spark, folder, "none").count() == 0


def test_late_and_undated_log_lines_are_counted(spark):
    path = work_dir(spark, "lines")
    hours = [["2024-01-01 10:00:00", "2024-01-01 10:30:00"], ["2024-01-01 20:00:00"], ["2024-01-01 20:10:00"], ["2024-01-01 10:45:00", "2024-01-01 19:30:00"]]
    for times in hours:
        lines = spark.createDataFrame([*[(f"{x} | INFO | a | b",) for x in times], ("no time",), (" ",)], "line string").coalesce(1)
        lines.write.mode("append").parquet(path)
    # File order decides the batches: the last one holds lines of earlier hours.
    for i, f in enumerate(sorted((f for f in os.scandir(path) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f.path, (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(path)
    table = work_dir(spark, "log-counts")
    counted = stream_logs(stream, "app")
    stored = SnapshotTable(spark, f"{table}/rows", counted.schema, ["source", "level", "hour"], 4)
    start_update_table(counted, stored, f"{table}/checkpoint").awaitTermination()
    got = stored.read().collect()
    assert {(r.hour and r.hour.hour, r.n_lines) for r in got} == {(10, 3), (20, 2), (19, 1), (None, 4)}


def objects(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, answer string")


def test_model_answers(spark):
    one = '{"sc_code":"SC1","logic_steps":[],"metadata":{"effective_date":"04/27/2009"}}'
    good, bad = tariffs.parse_model_json(
        objects(spark, one, f"[{one},{one}]", f'{{"tariffs":[{one}]}}', f"```json\n{one}\n```", f"```\n{one}\n```", f"Sure: {one} done.", "{broken", "", "```json {x ```")
    )
    assert sorted((r.doc_id, r.pos) for r in good.collect()) == [(0, 0), (1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert {r.d for r in good.select(tariffs.item_date(F.col("item")).alias("d")).collect()} == {d("2009-04-27")}
    assert sorted(r.doc_id for r in bad.collect()) == [6, 7, 8]


def test_page_layouts(spark):
    listed = {"pages": [{"page_number": 2, "text": "b", "tables": [[["x", "y"]]]}, {"page_number": 1, "text": "a"}]}
    keyed = {"3": {"text": "c"}, "x": {"text": "z"}, "skip": {"other": 1}}
    docs = spark.createDataFrame([(1, json.dumps(listed)), (2, json.dumps(keyed)), (3, "broken")], "doc_id long, body string")
    got = sorted(rows(tariffs.doc_pages(docs).select("doc_id", "page_number", "text")))
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 0, "z"), (2, 3, "c")]
    assert tariffs.doc_pages(docs).where("text = 'b'").first().tables == [[["x", "y"]]]


def test_version_register(spark):
    one = '{"sc_code":"SC1","logic_steps":[{"value":%s}]}'
    answers = spark.createDataFrame(
        [(5, "SC1", d("2020-01-01"), one % 1), (6, "SC1", d("2020-01-01"), one % 2), (7, "SC3", d("2021-01-01"), one % 3), (8, "SC3", None, "nothing")],
        "doc_id long, section_code string, effective_date date, answer string")
    register = spark.createDataFrame([(1, "SC1", d("2020-01-01"), "old"), (2, "SC9", d("2020-01-01"), "kept")], "document_id long, sc_code string, effective_date date, logic string")
    out = tariff_intake(answers, register)
    got = {(r.sc_code, str(r.effective_date)): (r.document_id, r.logic) for r in out.register.collect()}
    assert got == {
        ("SC1", "2020-01-01"): (6, '{"logic_steps":[{"value":2}],"sc_code":"SC1"}'),
        ("SC1", "2021-01-01"): (7, '{"logic_steps":[{"value":3}],"sc_code":"SC1"}'),
        ("SC9", "2020-01-01"): (2, "kept"),
    }
    assert [r.doc_id for r in out.mismatched.collect()] == [7]
    assert [r.doc_id for r in out.unreadable.collect()] == [8]
    assert rows(versions.sc_codes(out.register)) == [("SC1",), ("SC9",)]
    assert rows(versions.versions_of(out.register, "SC1")) == [(d("2021-01-01"),), (d("2020-01-01"),)]
    assert versions.logic_of(out.register, "SC1", "2021-01-01").first().document_id == 7


def test_model_inputs(spark):
    pages = {"pages": [{"page_number": 1, "text": "SERVICE CLASSIFICATION NO. 1\nEffective Date: 04/27/2009"}, {"page_number": 2, "text": "rest"}]}
    r = model_inputs(spark.createDataFrame([(1, json.dumps(pages))], "doc_id long, body string")).first()
    assert (r.sc_code, r.effective_date, r.end_page) == ("SC1", d("2009-04-27"), 2)
    assert r.text == "SERVICE CLASSIFICATION NO. 1\nEffective Date: 04/27/2009\nrest"


def test_bill_intake(spark):
    text = "Customer: ACME Bill Account: 1120031219 x 4/30/2021 4/28/2021 40 92 0.0 0.00 0 $28.26 $0.00 $28.26 $0.00 Page 1 of 1"
    docs = spark.createDataFrame([("d1", text), ("d2", text)], "doc_id string, text string")
    out = bill_intake(docs, work_dir(spark, "intake"))
    assert sorted({r.issue_type for r in out.issues.collect()}) == ["R2_BILL_DAYS_OUT_OF_RANGE", "R6_DUPLICATE_PERIOD"]
    assert {r.user_bill_id for r in out.issues.collect()} == {r.id for r in out.bills.collect()}


def test_answers_are_made_and_parsed_once(spark):
    made = spark.range(4).select(F.col("id").alias("doc_id"), F.concat(F.lit('{"sc_code": "MARK'), "id", F.when(F.col("id") < 3, '"}').otherwise("")).alias("answer"))
    good, bad = tariffs.parse_model_json(made)
    code = F.try_variant_get("item", "$.sc_code", "string").alias("code")
    assert plan(good).count("MARK") == 1
    assert sorted(rows(good.select("doc_id", "pos", code))) == [(i, 0, f"MARK{i}") for i in range(3)]
    assert rows(bad) == [(3, '{"sc_code": "MARK3')]
