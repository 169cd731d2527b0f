"""Rules one fault at a time, whole documents, edits, streams, long documents, plans."""

import datetime
import json
import random
import os
import re

import pytest
from pyspark.sql import functions as F

from docproof.operators import edits as E, review
from docproof.operators.rules import validate
from docproof.plans.verify import recheck_edited, verify_documents
from docproof import session
from docproof.schema import EDIT, FIELDS, PAGE, RESPONSE, WAITING
from docproof.session import work_folder
from docproof.sources import files, pages as G, responses, results as W
from docproof.streaming import jobs

def iban(country, bban):
    """An account with the check digits that its country and number ask for."""
    rest = int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97
    return f"{country}{98 - rest:02d}{bban}"


ACCOUNT = iban("AT", "2011100055512345")
BROKEN = ACCOUNT[:-1] + str((int(ACCOUNT[-1]) + 1) % 10)
UNLISTED = iban("QZ", "HAFN000987654321")
NUMBER, TAX = "NP/2025/0417", "ATU81122334"
TEXT = (
    f"Nordlicht Papier\nHafenweg 7, Wien\nRechnung {NUMBER}\nvom 2025-09-12, zahlbar bis 2025-10-03\n"
    f"Summe 8905.60 EUR\nKonto {ACCOUNT}\nUID {TAX}\n"
)
SOUND = dict(
    company_name="Nordlicht Papier", company_address="Hafenweg 7, Wien", invoice_number=NUMBER,
    issue_date="2025-09-12", payment_date="2025-10-03", payment_terms_days="21", amount="8905.60",
    currency="EUR", tax_id=TAX, account=ACCOUNT,
)
REF = "2026-07-04"
SCHEMA = ", ".join(f"{c} string" for c in ["path", *FIELDS, "raw_text"])
CASES = [
    ({}, []), (dict(raw_text=""), [14]), (dict(raw_text=" \n "), [14]), (dict(raw_text=None), [14]),
    (dict(issue_date="31/02/2026"), [1]), (dict(payment_date="x"), [2]), (dict(amount="abc"), [3]),
    (dict(payment_terms_days="Net 30"), [4]), (dict(invoice_number=None), [5]), (dict(issue_date=""), [6]),
    (dict(amount=""), [7]), (dict(account=None), [8]), (dict(tax_id=""), [9]), (dict(company_name=None), [10]),
    (dict(company_address=""), [11]), (dict(currency=None), [12]),
    (dict(payment_date=None, payment_terms_days=""), [13]), (dict(payment_date="bad", payment_terms_days=None), [2]),
    (dict(company_name="Other"), [15]), (dict(invoice_number="NP/9"), [16]), (dict(account="999"), [17]),
    (dict(tax_id="nope"), [18]), (dict(amount="77.10"), [19]), (dict(currency="eur"), [22]),
    (dict(issue_date="2026-07-05", payment_date="2026-07-26"), [23]),
    (dict(payment_date="2025-09-11", payment_terms_days=None), [24]), (dict(payment_terms_days="30"), [25]),
    (dict(account=BROKEN), [17, 21]), (dict(company_name="   "), []), (dict(account="-"), []),
    (dict(amount="NaN", raw_text=""), [14]), (dict(amount="1E+40", raw_text=""), [14]),
    (dict(payment_terms_days="99999999999999999999", payment_date=None), []),
    (dict(amount="NaN"), "ValueError"), (dict(amount="1E+40"), "ValueError"),
    (dict(payment_terms_days="99999999999999999999"), "OverflowError"), (dict(payment_terms_days="-999999"), "OverflowError"),
    (dict(account=UNLISTED + "\n"), "ValueError"),
]


def test_rules(spark):
    rows = [(str(i), *[({**SOUND, "raw_text": TEXT} | c)[k] for k in [*FIELDS, "raw_text"]]) for i, (c, _) in enumerate(CASES)]
    got = {int(r.path): r for r in validate(spark.createDataFrame(rows, SCHEMA), REF).collect()}
    for i, (change, want) in enumerate(CASES):
        r = got[i]
        if isinstance(want, str):
            assert r.status == "error" and r.error.startswith(want) and r.data is None, change
            continue
        assert [x.rule_no for x in r.issues] == want, (change, r.issues)
        assert r.flagged == any(x.severity == "error" for x in r.issues)
        assert r.status == ("flagged" if r.flagged else "ok")
    phrases = {1: "not a valid ISO date", 3: "not a valid number", 4: "not a whole number", 5: "missing",
               13: "Either payment_date", 16: "not found verbatim", 21: "looks like an IBAN"}
    texts = {x.rule_no: x.message for r in got.values() for x in r.issues or []}
    assert all(phrase in texts[no] for no, phrase in phrases.items())


def tables(spark, n=40, pages_each=3):
    paths = [(f"/d/{i:03d}.pdf",) for i in range(n)]
    lines = TEXT.rstrip("\n").split("\n")
    pages, answers = [], []
    for i, (p,) in enumerate(paths):
        cut = [lines[j * len(lines) // pages_each:(j + 1) * len(lines) // pages_each] for j in range(pages_each)]
        pages += [(p, j + 1, "\n".join(c)) for j, c in enumerate(cut)]
        record = dict(SOUND, invoice_number=NUMBER if i % 2 == 0 else "NP/0", currency=None if i % 3 == 0 else "EUR")
        answers.append((p, json.dumps(record) if i % 5 else "{"))
    frame = spark.createDataFrame
    return frame(paths, "path string"), frame(pages, PAGE), frame(answers, RESPONSE)


def verdicts(df):
    return {r.path: (r.status, r.error, tuple(x.rule_no for x in r.issues or [])) for r in df.collect()}


def test_one_row_per_file(spark):
    f, p, r = tables(spark)
    more = spark.createDataFrame([("/d/none.pdf",), ("/d/000.pdf",)], "path string")
    got = verify_documents(f.unionByName(more), p, r.unionByName(r.limit(2)), REF).collect()
    assert len(got) == 41 and len({x.path for x in got}) == 41
    errors = {x.path: x.error for x in got}
    assert errors["/d/none.pdf"].startswith("MissingResponse")
    assert errors["/d/001.pdf"] is None  # the same response twice is one response
    other = r.limit(2).withColumn("output_text", F.lit("{}")).unionByName(r.filter("path = '/d/003.pdf'").withColumn("output_text", F.lit(None).cast("string")))
    again = {x.path: x.error for x in verify_documents(f, p, r.unionByName(other), REF).collect()}
    assert all(again[path].startswith("DuplicateResponse") for path in ("/d/001.pdf", "/d/003.pdf"))


def test_partitions_do_not_matter(spark):
    f, p, r = tables(spark)
    one = verdicts(verify_documents(f.repartition(1), p.repartition(1), r.repartition(1), REF))
    many = verdicts(verify_documents(f.repartition(9), p.repartition(13), r.repartition(5), REF))
    assert one == many


@pytest.mark.parametrize("block_chars", [1, 7, 1000])
def test_long_documents(spark, block_chars):
    """Values that run over page ends, pages of marks only, and tiny blocks give the same facts."""
    rng = random.Random(11)
    record = dict(SOUND)
    pages, answers, paths = [], [], []
    for i in range(60):
        text = TEXT.replace("8905.60", rng.choice(["8905.60", "8.905,60", "89 05.60", "8905 .. 60", "98905.60", "8905.607", "8\n9_05 ,60"]))
        path, page = f"/d/{i}.pdf", 0
        paths.append((path,))
        answers.append((path, json.dumps(record | {"company_name": rng.choice(["Nordlicht Papier", "nordlicht-pap", "NORDLICHTX"])})))
        while text:
            size = rng.randrange(1, 9)
            pages.append((path, page, text[:size]))
            text, page = text[size:], page + rng.choice([1, 1, 1, 700])
            if rng.random() < 0.2:
                pages.append((path, page, rng.choice(["", ".", "..", " , ", "_", "\n"])))
                page += 1
    frame = spark.createDataFrame
    args = frame(paths, "path string"), frame(pages, PAGE), frame(answers, RESPONSE)
    whole = verdicts(verify_documents(*args, REF))
    assert {s for s, _, _ in whole.values()} >= {"ok", "flagged"}
    assert verdicts(verify_documents(*args, REF, max_chars=20, block_chars=block_chars)) == whole


@pytest.mark.parametrize("block_chars", [1, 7, 44, 45, 1000])
def test_amounts_at_block_ends_and_odd_page_numbers(spark, block_chars):
    """Digits around the amount at every place of a cut; pages without number, and repeated numbers."""
    pages, answers, paths = [], [], []

    def add(name, parts):
        path = f"/d/{name}.pdf"
        paths.append((path,))
        pages.extend((path, no, text) for no, text in parts)
        answers.append((path, json.dumps(SOUND)))

    for shift in range(46):
        head, tail = TEXT.split("8905.60")
        for name, number in (("after", "8905.607"), ("before", "18905.60"), ("alone", "8905.60")):
            add(f"{name}-{shift}", [(1, "-" * shift + "y" * (shift % 3) + head + number), (2, tail)])
    add("numberless", [(None, TEXT)])
    add("some-numberless", [(1, TEXT.split("Summe")[1]), (None, TEXT.split("Summe")[0] + "Summe")])
    add("repeated", [(5, "b " + TEXT), (5, "a 8905.6"), (5, "c")])
    add("ends-in-amount", [(1, TEXT.replace("8905.60", "")), (2, "8905.60")])
    add("ends-in-digit", [(1, TEXT.replace("8905.60", "")), (2, "8905.6"), (3, "07")])
    frame = spark.createDataFrame
    args = frame(paths, "path string"), frame(pages, PAGE), frame(answers, RESPONSE)
    whole = verdicts(verify_documents(*args, REF))
    assert whole["/d/after-3.pdf"][2] == (19,) and whole["/d/alone-3.pdf"][2] == () and whole["/d/numberless.pdf"][2] == ()
    assert verdicts(verify_documents(*args, REF, max_chars=0, block_chars=block_chars)) == whole


def test_building_a_plan_starts_no_job(spark):
    args = tables(spark)
    tracker, group = spark.sparkContext.statusTracker(), "building"
    spark.sparkContext.setJobGroup(group, "plans only")
    results = verify_documents(*args, REF)
    recheck_edited(results, spark.createDataFrame(EDITS, EDIT), args[1], REF)
    G.assemble_text(args[1])
    assert tracker.getJobIdsForGroup(group) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_text_of_long_documents_comes_in_parts(spark):
    rows = [("a", i, f"t{i}") for i in range(2500)] + [("b", 1, "x"), ("b", 0, ""), ("c", 1, None), ("d", None, "first"), ("d", 3, "z"), ("d", 3, "y")]
    parts = {(r.path, r.part_no): r.raw_text for r in G.assemble_text(spark.createDataFrame(rows, PAGE), 100).collect()}
    assert parts[("b", 0)] == "x" and parts[("c", 0)] == "" and parts[("d", 0)] == "first\ny\nz"
    own = sorted(no for path, no in parts if path == "a")
    assert len(own) > 50 and "\n".join(parts[("a", i)] for i in own) == "\n".join(f"t{i}" for i in range(2500))
    assert max(map(len, parts.values())) < 200
    whole = G.assemble_text(spark.createDataFrame(rows, PAGE)).collect()
    assert len(whole) == 4 and {r.part_no for r in whole} == {0}


def test_responses(spark):
    bodies = {
        '{"amount":"1","amount":"2"}': "2", '{"amount": null}': None, "{}": None, ' {"amount":"5"}\n': "5",
        '{"amount":1}': "E", '{"amount":"1"} x': "E", '{"amount":"1"},{"amount":"2"}': "E", '{"amount":"1"},"z":{}': "E",
        '{"amount":"1"}],[{}': "E", "[]": "E", "null": "E", "": "E", "{'amount':'1'}": "E", '{"amount":{"a":"1"}}': "E",
        '{"vat":"1"}': "E", '{"amount":"1",}': "E", '{"amount":true}': "E", '{"amount":"1"': "E", '{"amount":["1"]}': "E",
    }
    df = spark.createDataFrame(list(bodies.items() | {("", "E")}), "output_text string, path string")
    got = responses.ingest_responses(df.select("path", "output_text").withColumn("n", F.monotonically_increasing_id()))
    keyed = {r.n: r for r in got.collect()}
    texts = {r.n: (r.output_text, r.path) for r in df.withColumn("n", F.monotonically_increasing_id()).collect()}
    for n, r in keyed.items():
        body, want = texts[n]
        assert (r.error is not None) == (want == "E"), body
        assert want == "E" or r.amount == want, body


def first_results(spark):
    f, p, r = tables(spark)
    return verify_documents(f, p, r, REF), p


EDITS = [
    ("/d/001.pdf", "invoice_number", 1, "edit", NUMBER), ("/d/002.pdf", "currency", 1, "edit", "  "),
    ("/d/002.pdf", "amount", 2, "edit", "abc"), ("/d/004.pdf", "amount", 1, "edit", "9.99"),
    ("/d/004.pdf", "amount", 2, "revert", None), ("/d/004.pdf", "tax_id", 3, "edit", f" {TAX} "),
    ("/d/005.pdf", "amount", 1, "edit", "1"), ("/d/006.pdf", "vat", 1, "edit", "1"), ("/d/zzz.pdf", "amount", 1, "edit", "1"),
]


def test_edits(spark):
    results, pages = first_results(spark)
    log = spark.createDataFrame(EDITS, EDIT)
    again = recheck_edited(results, log, pages, REF)
    got = verdicts(again)
    assert got == {"/d/001.pdf": ("ok", None, ()), "/d/002.pdf": ("flagged", None, (3, 12)), "/d/004.pdf": ("ok", None, ())}
    assert {(r.path, r.field) for r in E.edited_fields(again).collect()} == {
        ("/d/001.pdf", "invoice_number"), ("/d/002.pdf", "currency"), ("/d/002.pdf", "amount")}
    assert {r.path: r.version for r in again.collect()} == {"/d/001.pdf": 1, "/d/002.pdf": 2, "/d/004.pdf": 3}
    refused = {(r.path, r.reason) for r in E.rejected_edits(results, log).collect()}
    assert refused == {("/d/005.pdf", "document has no extracted data"), ("/d/006.pdf", "unknown field"), ("/d/zzz.pdf", "unknown document")}
    shuffled = random.Random(1).sample(EDITS + EDITS, 2 * len(EDITS))
    assert verdicts(recheck_edited(results, spark.createDataFrame(shuffled, EDIT), pages, REF)) == got
    rows = {(r.path, r.field): r for r in review.field_review(again).collect()}
    assert rows[("/d/002.pdf", "currency")].value == "—" and rows[("/d/002.pdf", "currency")].edited
    assert rows[("/d/002.pdf", "amount")].severity == "error" and not rows[("/d/004.pdf", "tax_id")].edited


def test_filters_stop_at_the_rules(spark):
    results, _ = first_results(spark)
    assert results.filter(F.size("issues") > 0).count() == len([1 for s in verdicts(results).values() if s[2]])


def test_results_are_appended_and_repeatable(spark):
    results, _ = first_results(spark)
    folder = work_folder(spark, "results")
    for run in ("a", "b", "b"):
        W.write_results(results, folder, run)
    stored = W.read_results(spark, folder)
    assert stored.count() == 80
    summary = review.run_summary(stored, "b").first()
    assert (summary.processed, summary.loaded) == (40, 80)
    assert [r.run_id for r in review.review_list(stored).collect()] == ["a"] * 40 + ["b"] * 40


def test_held_back_responses(spark):
    """A document is judged once, when it is whole; what is left is drained into error rows."""
    f, p, r = tables(spark, 10)
    source, pages, out, progress = (work_folder(spark, x) for x in ("responses", "pages", "out", "progress"))
    stream = lambda: spark.readStream.schema(WAITING).parquet(source)
    announced = r.withColumn("n_pages", F.lit(3).cast("bigint"))
    early = F.col("path") < "/d/005.pdf"
    W.save_by_path(p.filter(early | (F.col("page_no") == 1)).filter("path < '/d/008.pdf'"), pages)
    announced.filter(F.col("path") < "/d/008.pdf").write.parquet(source)
    jobs.stream_validate(stream(), pages, out, REF, progress).awaitTermination()
    assert spark.read.parquet(f"{out}/verdicts").count() == 5
    W.save_by_path(p.filter(~early & (F.col("page_no") > 1)).filter("path < '/d/008.pdf'"), pages)
    announced.filter(F.col("path") >= "/d/008.pdf").unionByName(announced.filter("path = '/d/001.pdf'")).write.mode("append").parquet(source)
    jobs.stream_validate(stream(), pages, out, REF, progress).awaitTermination()
    judged = verdicts(spark.read.parquet(f"{out}/verdicts"))
    assert judged == verdicts(verify_documents(f.filter("path < '/d/008.pdf'"), p, r, REF))
    assert spark.read.parquet(f"{out}/verdicts").count() == 8
    assert [x.path for x in spark.read.parquet(f"{out}/late").collect()] == ["/d/001.pdf"]
    more = f.unionByName(spark.createDataFrame([("/d/none.pdf",)], "path string"))
    rest = verdicts(jobs.drain(spark, more, pages, out, REF))
    assert {path: v[1].split(":")[0] for path, v in rest.items()} == {
        "/d/008.pdf": "MissingText", "/d/009.pdf": "MissingText", "/d/none.pdf": "MissingResponse"}


def test_refused_edits_of_a_stream(spark):
    results, pages = first_results(spark)
    log, kept, texts, out, progress = (work_folder(spark, x) for x in ("log", "results", "pages", "out", "progress"))
    W.save_by_path(results, kept)
    W.save_by_path(pages, texts)
    spark.createDataFrame(EDITS, EDIT).write.parquet(log)
    edits = spark.readStream.schema(EDIT).parquet(log)
    jobs.stream_edits(edits, kept, texts, out, REF, progress, trigger={"availableNow": True}).awaitTermination()
    refused = {(r.path, r.reason) for r in jobs.read_batches(spark, f"{out}/rejected").collect()}
    assert refused == {("/d/005.pdf", "document has no extracted data"), ("/d/006.pdf", "unknown field"), ("/d/zzz.pdf", "unknown document")}
    assert {r.path for r in jobs.read_batches(spark, f"{out}/versions").collect()} == {"/d/001.pdf", "/d/002.pdf", "/d/004.pdf"}


def test_only_parts_of_the_paths_asked_for_are_read(spark):
    f, p, _ = tables(spark)
    folder = work_folder(spark, "pages")
    W.save_by_path(p, folder)
    one = f.filter("path = '/d/007.pdf'")
    rows = W.read_by_path(folder, one, PAGE)
    assert rows.columns == PAGE.names and rows.count() == 3
    scanned = rows._jdf.queryExecution().executedPlan().toString()
    own = one.select(W.path_bucket(F.col("path"))).first()[0]
    assert "PartitionFilters: [isnotnull(path_bucket" in scanned and f"= {own})" in scanned


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_settings_are_checked_not_changed(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            responses.ingest_responses(tables(spark, 2)[2])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_writers(spark, tmp_path):
    """Requests and export are JSON lines that read back as they were."""
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    requests = files.build_extraction_requests(files.read_files(spark, str(tmp_path)))
    files.write_requests(requests, folder := work_folder(spark, "requests"))
    (line,) = [json.loads(r.value) for r in spark.read.text(folder).collect()]
    assert line["response_schema"] == {"name": files.SCHEMA_NAME, "strict": True, "schema": files.response_schema()}
    assert line["file"]["filename"] == "x.pdf" and line["prompt"] == files.extraction_prompt(None)
    results, _ = first_results(spark)
    W.write_json(results, folder := work_folder(spark, "export"))
    written = {d["path"]: d["document"] for d in (json.loads(r.value) for r in spark.read.text(folder).collect())}
    assert written == {r.path: json.loads(r.json) for r in W.export_json(results).collect()}


def test_files_and_requests(spark, tmp_path):
    for name in ["b.pdf", "A.PDF", "c.txt", "d.Pdf"]:
        (tmp_path / name).write_bytes(b"%PDF " + b"x" * 200)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.pdf").write_bytes(b"x")
    assert [r.name for r in files.scan_files(spark, str(tmp_path)).collect()] == ["A.PDF", "b.pdf"]
    request = files.build_extraction_requests(files.read_files(spark, str(tmp_path)), "Buyer Ltd").filter("filename = 'b.pdf'").first()
    import base64
    assert base64.b64decode(request.file_data.removeprefix("data:application/pdf;base64,")) == b"%PDF " + b"x" * 200
    assert "Buyer Ltd" in request.prompt and files.DEFAULT_BUYER in files.extraction_prompt(None)
    schema = json.loads(request.schema_json)
    assert schema["required"] == FIELDS == list(schema["properties"]) and schema["additionalProperties"] is False
    assert not any("default" in p for p in schema["properties"].values())


def test_plans(spark):
    """The page table is shuffled once, by path, and the text is read into no join side twice."""
    folder = work_folder(spark, "pages")
    f, p, r = tables(spark)
    p.write.parquet(folder)
    results = verify_documents(f, spark.read.schema(PAGE).parquet(folder), r, datetime.date(2026, 7, 4))
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list(CASE") <= 2 * 2  # partial and final, each with its attribute list
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def scans(df, *columns):
    """Planned file scans that read these columns, among others."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    return sum(1 for read in found if all(re.search(rf"\b{c}#", read) for c in columns))


def test_every_table_is_scanned_once_for_its_content(spark):
    """Page texts and responses are read once; page numbers a second time, without the texts."""
    f, p, r = tables(spark)
    kept = [work_folder(spark, name) for name in ("files", "pages", "responses", "results", "log")]
    for df, folder in zip((f, p, r), kept):
        df.write.parquet(folder)
    read = spark.read.parquet
    first = verify_documents(*[read(folder) for folder in kept[:3]], REF)
    assert scans(first, "output_text") == 1 and scans(first, "text") == 1 and scans(first, "page_no") == 2
    first.write.parquet(kept[3])
    spark.createDataFrame(EDITS, EDIT).write.parquet(kept[4])
    again = recheck_edited(read(kept[3]), read(kept[4]), read(kept[1]), REF)
    assert scans(again, "extracted") == 1 and scans(again, "page_no", "text") == 1 and scans(again, "page_no") == 2
    assert scans(again, "field", "seq", "op") == 1 and scans(again, "output_text") == 0
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 15


def test_first_look_skips_ordinary_pages(spark):
    """Pages 0 to 999 need no list of ranges; file statistics leave them out of the first look."""
    f, p, r = tables(spark)
    folder = work_folder(spark, "pages")
    p.write.parquet(folder)
    plan = verify_documents(f, spark.read.parquet(folder), r, REF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(page_no,1000)" in plan


def test_derived_tables_are_written_when_they_are_read(spark, tmp_path):
    from docproof.plans.catalog import QUERIES
    from docproof.plans.fixture import Documents

    nations = [(i, f"NATION {i}", i % 5) for i in range(5)]
    spark.createDataFrame(nations, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    suppliers = [(i, f"Vendor {i}", i % 5) for i in range(4)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    orders = spark.range(100).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "id + 0.5D as o_totalprice",
                                         "date_add(date '2026-01-01', int(id)) as o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["status"](spark, str(tmp_path)).count() == 100
    d = Documents(spark, str(tmp_path))
    written = {name for name in os.listdir(d.folder.removeprefix("file:"))}
    assert written == {"clean", "pages", "responses"}
    assert d.faulty.count() == 100 and d.edits.count() == 45


def test_bucketed_tables_are_not_shuffled(spark):
    f, p, r = tables(spark, 10)
    stored = {"docproof_files": f, "docproof_pages": p, "docproof_responses": r}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in stored.items():
            W.save_bucketed(df, name, 4)
        results = verify_documents(*[spark.table(name) for name in stored], REF)
        assert "Exchange hash" not in results._jdf.queryExecution().executedPlan().toString()
        assert verdicts(results) == verdicts(verify_documents(f, p, r, REF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in stored:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_records_are_not_carried_along_with_every_page(spark):
    """Pages become texts before records join them, and what is sorted in a review list is dealt out, not made twice."""
    folder = work_folder(spark, "pages")
    f, p, r = tables(spark)
    p.write.parquet(folder)
    results = verify_documents(f, spark.read.schema(PAGE).parquet(folder), r, REF)
    plan = results._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter", plan.index("raw_text")) < plan.index("Window [")
    assert "Filter ((size(" not in plan
    listed = review.review_list(results.withColumn("run_id", F.lit("a")))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert listed[0].startswith("Sort") and any("RepartitionByExpression" in line for line in listed[1:4])
    for table in (review.field_review, review.field_severity, review.issue_rows):
        assert "Filter ((size(" not in table(results)._jdf.queryExecution().optimizedPlan().toString()


def test_sound_responses_are_parsed_once(spark):
    """What the pattern takes for sound gives the same record as the strict way, odd characters included."""
    bodies = [json.dumps(dict(SOUND, company_name=name), ensure_ascii=False, separators=(",", ":")) for name in
              ("", "Żółć 株", "a\u00a0b", "{,}:[]", "null", "\U0001f600", "a'b", "1\u2028")]
    bodies += ['{"tax_id":"1","tax_id":null}', '{"tax_id":null,"tax_id":"2"}', '{"account":null}', "{}", '{"vat":"1"}', '{"tax_id":"1",}', '{"tax_id":"1"}\n', '{"tax_id":"a\tb"}']
    rows = [(str(i), b) for i, b in enumerate(bodies)] + [(f"{i} spaced", " " + b) for i, b in enumerate(bodies)]
    got = responses.ingest_responses(spark.createDataFrame(rows, RESPONSE))
    # A blank in front keeps a text from the pattern, but changes nothing that it says.
    records = {x.path: tuple(x)[1:] for x in got.collect()}
    assert all(records[str(i)] == records[f"{i} spaced"] for i in range(len(bodies)))
    assert sum(x[-1] is None for x in records.values()) == 2 * 13
    assert "from_json" in got._jdf.queryExecution().analyzed().toString()


def test_long_generated_methods_are_not_interpreted(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
