import io
import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spendframe import session
from spendframe.operators import features
from spendframe.plans import ingesting
from spendframe.sources import billing_exports as exports
from spendframe.sources import anomaly_store, csv_headers, generic_csv, headers, store, tables
from spendframe.streaming import ingest


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_header_matching():
    assert headers.resolve([" Usage-Start Date "], ["usage_start_date"]) == " Usage-Start Date "
    assert headers.resolve(["lineItem/Cost"], ["lineitem_cost"], slash=True) == "lineItem/Cost"
    assert headers.resolve(["lineItem/Cost"], ["lineitem_cost"]) is None
    assert headers.resolve(["Cost", "PRETAXCOST"], ["pretaxcost", "cost"]) == "PRETAXCOST"
    assert headers.resolve(["a"], ["b"]) is None


def test_provider_csv(spark, tmp_path):
    path = _write(tmp_path / "aws.csv", "lineItem/UsageStartDate,product/ProductName,lineItem/UnblendedCost\n"
                  "2024-01-01T00:00:00Z, Amazon EC2 ,1.5\n2024-01-01T23:00:00-02:00,S3,2\nnever,S3,2\n2024-01-02,S3,abc\n")
    got = [tuple(r) for r in exports.read_export(spark, path, "AWS").orderBy("date").collect()]
    assert got == [(datetime(2024, 1, 1), "Amazon EC2", 1.5, "aws"), (datetime(2024, 1, 2, 1), "S3", 2.0, "aws")]
    with pytest.raises(ValueError, match="no 'date' column"):
        exports.map_export(spark.createDataFrame([("x",)], "cost string"), "gcp")
    with pytest.raises(ValueError, match="unsupported provider"):
        exports.map_export(spark.range(1), "ibm")


def test_gcp_header_with_dot(spark, tmp_path):
    path = _write(tmp_path / "gcp.csv", "usage_start_time,service.description,cost\n2024-01-01 05:00:00,Cloud Run,3\n")
    assert exports.read_export(spark, path, "gcp").first().service == "Cloud Run"


def test_generic_csv_edges(spark, tmp_path):
    path = _write(tmp_path / "any.csv", "Cloud,Service,Cost,Date,End Date,ConsumedService,Tags,ResourceGroup,Quantity,Currency\n"
                  'aWs,EC2,"$1,234.50",13/01/2024,,,,rg1,2,eur\n'
                  ',VM,5,01/13/2024,2024-01-14,Microsoft.Compute,"{""env"": ""prod""}",rg2,x,\n'
                  ",,5,2024-01-01,,,,,,\n,S3,,2024-01-01,,,,,,\n,S3,NaN,2024-01-01,,,,,,\n,S3,5,soon,,,,,,\n"
                  ',Amazon S3,-2,20240105,,,"resource_group:mine,k:v",rg3,,USD\n')
    good, rejects = generic_csv.read_generic_csv(spark, path)
    got = {r.service_name: r for r in good.collect()}
    assert (got["EC2"].provider, got["EC2"].cost, got["EC2"].usage_start_date, got["EC2"].usage_end_date) == ("aws", 1234.5, datetime(2024, 1, 13), datetime(2024, 1, 13))
    assert (got["EC2"].currency, got["EC2"].usage_quantity, got["EC2"].tags) == ("EUR", 2.0, {"resource_group": "rg1"})
    assert (got["VM"].provider, got["VM"].usage_quantity, got["VM"].tags) == ("azure", None, {"resource_group": "rg2", "env": "prod"})
    assert (got["Amazon S3"].provider, got["Amazon S3"].cost, got["Amazon S3"].tags) == ("aws", -2.0, {"resource_group": "mine", "k": "v"})
    assert sorted(r.error for r in rejects.collect()) == ["Invalid numeric value", "Missing cost value", "Missing or empty service name", "Missing or invalid start date"]
    with pytest.raises(ValueError, match="missing required columns: cost"):
        generic_csv.parse_records(spark.createDataFrame([("a", "b")], "service string, date string"))


def test_encoding(spark, tmp_path):
    path = _write(tmp_path / "latin.csv", "service,cost,date\nCafé,£5,2024-01-01\n", "latin-1")
    good, _ = generic_csv.read_generic_csv(spark, path, "ISO-8859-1")
    assert (good.first().service_name, good.first().cost) == ("Café", 5.0)


def test_epoch_dates_in_typed_rows(spark):
    frame = spark.createDataFrame([("EC2", 1.0, 86400)], "service string, cost double, date bigint")
    assert generic_csv.parse_records(frame).first().usage_start_date == datetime(1970, 1, 2)


def test_training_files_with_mixed_headers(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "Date,MeterCategory,Cost\n2024-01-01,Virtual Machines,1\n")
    b = _write(tmp_path / "b.csv", "lineItem/UsageStartDate,product/ProductName,lineItem/UnblendedCost\n2024-01-01,Amazon EC2,2\n")
    c = _write(tmp_path / "c.csv", "Date,MeterCategory,Cost\n2024-01-02,Storage,4\n")
    merged, skipped = exports.read_training(spark, [a, b, c, str(tmp_path / "missing.csv")])
    assert [(r.path[-11:], r.reason) for r in skipped.collect()] == [("missing.csv", "not found")]
    assert sorted((str(r.date), r.service, r.cost) for r in merged.collect()) == [
        ("2024-01-01", "Amazon EC2", 2.0), ("2024-01-01", "Virtual Machines", 1.0), ("2024-01-02", "Storage", 4.0)]


def test_folder_of_files_with_columns_in_another_order(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    _write(folder / "a.csv", "Date,ServiceName,Cost\n2024-01-01,VM,1\n2024-01-02,VM,2\n")
    _write(folder / "b.csv", "Cost,Date,ServiceName\n3,2024-01-03,Disk\n4,2024-01-04,Disk\n")
    _write(folder / "c d.csv", "Service,Cost,Date\n\"two\nlines\",5,2024-01-05\n")
    got = exports.read_export(spark, str(folder), "azure", multiline=True)
    assert sorted((r.service, r.cost) for r in got.collect()) == [("Disk", 3.0), ("Disk", 4.0), ("VM", 1.0), ("VM", 2.0), ("two\nlines", 5.0)]


def test_rejects_name_their_file_and_row(spark, tmp_path):
    folder = tmp_path / "generic"
    folder.mkdir()
    _write(folder / "a.csv", "service,cost,date\nEC2,1,2024-01-01\nS3,x,2024-01-01\n\"EC2\nline two\",3,2024-01-02\n")
    _write(folder / "b.csv", "date,service,cost\n2024-01-01,,2\n")
    good, rejects = generic_csv.read_generic_csv(spark, str(folder), multiline=True)
    assert sorted((r.service_name, r.cost) for r in good.collect()) == [("EC2", 1.0), ("EC2\nline two", 3.0)]
    assert sorted((r.file[-5:], r.row_id, r.error_field) for r in rejects.collect()) == [("a.csv", 2, "cost"), ("b.csv", 1, "service_name")]
    report = generic_csv.reject_report(generic_csv.read_records(spark, str(folder), multiline=True)).collect()
    assert sorted((r.row, r.field, r.dropped_rows) for r in report) == [(1, "service_name", 2), (2, "cost", 2)]


def test_first_records():
    def first(data, encoding="UTF-8"):
        return csv_headers.first_record(io.BytesIO(data), encoding)

    assert first(b"a,b\n1,2\n") == first(b"\xef\xbb\xbfa,b\r\n1,2") == first(b"\n\na,b") == "a,b"
    assert first(b'"a\nb","c""\n""d"\n1,2\n') == '"a\nb","c""\n""d"' and first(b"") is None and first(b"\n\n") is None
    assert first("größe,b\n".encode("latin-1"), "ISO-8859-1") == "größe,b" and first("é,b\n".encode("utf-16"), "UTF-16") == "é,b"
    wide = ",".join(f"column{i}" for i in range(20_000))
    assert first(wide.encode() + b"\n1") == wide
    with pytest.raises(ValueError, match="no end of the header"):
        first(b"x" * (csv_headers.MAX_HEADER_BYTES + 1))


def test_headers_by_scan(spark, tmp_path):
    """Where tasks cannot open files, a scan of the lines finds the same headers."""
    folder = tmp_path / "scanned"
    folder.mkdir()
    for name, text in (("a b.csv", "\ufeffx,y\n1,2\n"), ("c+d%.csv", "\ny,x\n1,2\n3,4\n"), ("e.csv", "x,y\n"), ("empty.csv", "")):
        _write(folder / name, text)
    rows = [sorted((r.file.rpartition("/")[2], r.header) for r in found(spark, str(folder)).collect()) for found in (csv_headers.file_headers, csv_headers.scanned_headers)]
    assert rows[0] == rows[1] == [("a b.csv", "x,y"), ("c+d%.csv", "y,x"), ("e.csv", "x,y")]
    latin = _write(tmp_path / "latin-header.csv", "größe,y\n1,2\n", "latin-1")
    assert csv_headers.scanned_headers(spark, latin, "ISO-8859-1").first().header == "größe,y"
    assert csv_headers.opened_by_tasks(spark, [str(folder), "s3a://bucket/x"]) and not csv_headers.opened_by_tasks(spark, "viewfs://store/x")


def test_header_with_line_breaks(spark, tmp_path):
    folder = tmp_path / "broken"
    folder.mkdir()
    _write(folder / "a.csv", '"Note\nof two lines",Service,Cost,Date\nx,EC2,1,2024-01-01\n')
    _write(folder / "b.csv", "Date,Cost,Service\n2024-01-02,2,S3\n")
    _write(folder / "empty.csv", "")
    good, rejects = generic_csv.read_generic_csv(spark, str(folder), multiline=True)
    assert sorted((r.service_name, r.cost) for r in good.collect()) == [("EC2", 1.0), ("S3", 2.0)] and rejects.count() == 0
    got = ingesting.fetch(spark, "file", "gcp", _write(tmp_path / "g.csv", "usage_start_time,service,cost\n2024-01-01,\"Größe\nzwei\",3\n", "latin-1"), "2024-01-15", encoding="ISO-8859-1", multiline=True)
    assert got.first().cost == 3.0


def test_row_numbers_over_blocks(spark, tmp_path):
    """A file that is read in many blocks keeps its row numbers."""
    lines = [f"S{i},{'x' if i % 97 == 0 else i},2024-01-01" for i in range(1, 5001)]
    path = _write(tmp_path / "long.csv", "service,cost,date\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        good, rejects = generic_csv.read_generic_csv(spark, path)
        assert good.rdd.getNumPartitions() > 5 and good.count() == 5000 - 51
        assert sorted((r.row_id, r.service_name) for r in rejects.collect()) == [(i, f"S{i}") for i in range(97, 5001, 97)]
        numbered = generic_csv.read_records(spark, path)
        assert all(r.service_name == f"S{r.row_id}" for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_anomaly_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "anomalies")
    assert anomaly_store.read_anomalies(spark, path).count() == 0
    found = spark.createDataFrame(
        [(1, "EC2", 9.0, 3.0, date(2024, 3, d)) for d in (1, 2, 3)] + [(2, "S3", 1.0, 3.0, date(2024, 3, 3))],
        "user_id bigint, service_name string, detected_value double, expected_value double, detected_at date")
    for column in ("threshold", "deviation_percentage"):
        found = found.withColumn(column, F.lit(0.0))
    found = found.withColumn("severity", F.lit("high")).withColumn("message", F.lit("m"))
    counts = [ingesting.store_new_anomalies(rows, path, batch)[1]["stored"] for rows, batch in (
        (found.where("detected_at = '2024-03-02'"), "a"), (found, "b"), (found, "b"), (found.where("user_id = 1"), "b"), (found, "c"))]
    assert counts == [1, 3, 3, 2, 1]  # the decrease left batch b with its third run
    stored = anomaly_store.read_anomalies(spark, path)
    assert sorted((r.detected_at.day, r.batch_id) for r in stored.collect()) == [(1, "b"), (2, "a"), (3, "b")]
    since = anomaly_store.read_anomalies(spark, path, "2024-03-02", "a")
    plan = since._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert since.count() == 1 and "detected_day" in plan and "batch_id" in plan
    users = spark.createDataFrame([(1, "x@y", True, None, 0)], "user_id bigint, email string, email_alerts_enabled boolean, email_notifications boolean, email_alert_cooldown_minutes int")
    from spendframe.operators import alerts

    sent = alerts.select_alerts(stored.withColumn("alert_at", F.col("detected_at").cast("timestamp_ntz")), users)
    assert sent.count() == 3


def test_intermediate_tables_go_with_their_job(spark):
    with session.intermediate_tables(spark):
        kept = session.cut_lineage(spark.range(5))
        folder = Path(kept.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
        counted, seen = session.cut_counted(kept.where("id > 1"), rows=F.count(F.lit(1)))
        assert folder.exists() and counted.count() == seen["rows"] == 3
    assert not folder.exists()


def test_landed_api_results(spark, tmp_path):
    azure = spark.createDataFrame([(1.5, 20240105, "VM", "x"), (2.0, 20240106, None, "Disk")], "totalCost double, UsageDate int, ServiceName string, MeterCategory string")
    assert [(r.date, r.service) for r in exports.map_azure_rows(azure).collect()] == [(datetime(2024, 1, 5), "VM"), (datetime(2024, 1, 6), "Disk")]
    body = {"ResultsByTime": [{"TimePeriod": {"Start": "2024-01-01"}, "Groups": [
        {"Keys": ["EC2"], "Metrics": {"UNBLENDED_COST": {"Amount": "1.25"}}}, {"Keys": ["S3"], "Metrics": {"BLENDED_COST": {"Amount": "0"}}},
        {"Keys": ["Bad"], "Metrics": {"UNBLENDED_COST": {"Amount": "?"}}}]}]}
    path = _write(tmp_path / "aws.json", json.dumps(body))
    aws = spark.read.schema(exports.AWS_RESPONSE_SCHEMA).json(path)
    assert [(r.service, r.cost) for r in exports.map_aws_response(aws).collect()] == [("EC2", 1.25), ("S3", 0.0)]


def test_fetch_checks_and_default_range(spark, tmp_path):
    assert ingesting.default_range("2024-02-29") == ("2024-02-01", "2024-03-01")
    for arguments in (("ftp", "aws"), ("file", "ibm")):
        with pytest.raises(ValueError):
            ingesting.fetch(spark, *arguments, None, "2024-01-01")
    path = _write(tmp_path / "az.csv", "Date,ServiceName,Cost\n2024-01-01 10:00:00,VM scale sets,1\n2024-01-01,Virtual Machines,2\n")
    got = [tuple(r) for r in ingesting.fetch(spark, "file", "azure", path, "2024-01-15").collect()]
    assert [(c, p, v) for _, c, p, v in got] == [("Compute", "azure", 3.0)]


def test_cost_table_prunes_months(spark, tmp_path):
    costs = spark.createDataFrame(
        [(1, "AWS", "EC2", float(m), datetime(2024, m, 5), f"2024-{m:02d}") for m in range(1, 13)],
        "user_id bigint, provider string, service_name string, cost double, usage_start_date timestamp_ntz, billing_period string")
    for name in ("cloud_account_id", "resource_id", "region", "usage_unit", "currency"):
        costs = costs.withColumn(name, F.lit(""))
    costs = costs.withColumn("usage_quantity", F.lit(0.0)).withColumn("usage_end_date", F.col("usage_start_date"))
    for name in ("tags", "metadata"):
        costs = costs.withColumn(name, F.create_map().cast("map<string,string>"))
    costs = costs.withColumn("created_at", F.col("usage_start_date")).withColumn("updated_at", F.col("usage_start_date"))
    path = str(tmp_path / "costs")
    store.append_costs(costs, path)
    store.append_costs(costs.where("cost < 3"), path, "again")
    store.append_costs(costs.where("cost < 3"), path, "again")
    assert sorted(r.cost for r in store.read_costs(spark, path, "2024-02-01", "2024-02-28").collect()) == [2.0, 2.0]
    read = store.read_costs(spark, path, "2024-03-01", "2024-04-30")
    assert sorted(r.cost for r in read.collect()) == [3.0, 4.0]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(billing_period" in plan and "GreaterThanOrEqual(usage_start_date" in plan


def test_model_preference(spark):
    rows = spark.createDataFrame([(1, "Compute"), (2, "Compute"), (2, "Storage")], "user_id bigint, category string")
    keys = spark.createDataFrame([("Compute",), ("1_Compute",)], "model_key string")
    got = {(r.user_id, r.category): r.model_key for r in store.preferred_model_key(rows, keys).collect()}
    assert got == {(1, "Compute"): "1_Compute", (2, "Compute"): "Compute"}


def test_ingest_and_detect_twice_stores_once(spark, tmp_path):
    training = spark.range(100).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("date"),
        F.lit("Amazon EC2").alias("service"), (F.lit(100.0) + F.col("id") % 7).alias("cost"), F.lit("aws").alias("provider"))
    spiked = training.withColumn("cost", F.when(F.col("date") == F.lit("2024-04-08").cast("timestamp_ntz"), 5000.0).otherwise(F.col("cost")))
    normalized = features.normalize_costs(spiked)
    model = ingesting.train_model(training.drop("provider"), trees=30)
    paths = str(tmp_path / "costs"), str(tmp_path / "anomalies")
    first = ingesting.ingest_and_detect(normalized, 1, model, *paths, "2024-04-10", "one").first()
    assert (first.success_count, first.error_count) == (100, 0) and first.detected == first.stored >= 1
    repeated = ingesting.ingest_and_detect(normalized, 1, model, *paths, "2024-04-10", "one").first()
    assert repeated == first and store.read_costs(spark, paths[0]).count() == 100
    assert anomaly_store.read_anomalies(spark, paths[1]).count() <= spark.read.parquet(paths[1]).count() == first.stored
    again = ingesting.ingest_and_detect(normalized, 1, model, str(tmp_path / "c2"), paths[1], "2024-04-10", "two").first()
    assert again.detected == first.detected and again.stored == 0


def test_stream_ingest_splits_rejects(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    header = ",".join(ingest.RAW_FIELDS)
    _write(landing / "one.csv", f"{header}\n1,aws,a,EC2,,,,,5,USD,2024-01-01,2024-01-01\n1,bad,a,EC2,,,,,5,USD,2024-01-01,2024-01-01\n")
    folders = [str(tmp_path / n) for n in ("costs", "rejects", "check")]
    ingest.start_ingest(ingest.stream_csv(spark, str(landing)), *folders).awaitTermination()
    _write(landing / "two.csv", f"{header}\nnobody,gcp,a,Run,,,,,7,USD,2024-02-01,2024-02-02\n2,gcp,a,Run,,,,,7,USD,2024-02-01,2024-02-02\n")
    ingest.start_ingest(ingest.stream_csv(spark, str(landing)), *folders).awaitTermination()
    good = ingest.read_streamed_costs(spark, folders[0])
    assert sorted((r.provider, r.cost, r.billing_period) for r in good.collect()) == [("AWS", 5.0, "2024-01"), ("GCP", 7.0, "2024-02")]
    assert sorted(r.error for r in spark.read.parquet(folders[1]).collect()) == ["Provider must be one of: AWS, Azure, GCP, Other", ingest.BAD_TENANT]


def test_late_alerts_take_their_place(spark, tmp_path):
    """Alerts of a later micro-batch that are older than sent ones give the batch selection's rows."""
    from spendframe.operators import alerts
    from spendframe.plans.queries_streaming import ROCKSDB, STATE_PROVIDER
    from spendframe.streaming import cooldown

    schema = "user_id bigint, service_name string, alert_at timestamp_ntz"
    landing = tmp_path / "alerts"
    batches = [[0, 30, 60], [14, 25, 90, 91], [45, 200], [85, 260], [1000]]  # minutes
    start = datetime(2024, 1, 1)
    users = spark.createDataFrame([(1, "x@y", True, None, 20)], "user_id bigint, email string, email_alerts_enabled boolean, email_notifications boolean, email_alert_cooldown_minutes int")
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        for minutes in batches:
            rows = [(1, "EC2", start + timedelta(minutes=m)) for m in minutes]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(landing))
            stream = cooldown.cooldown_stream(spark.readStream.schema(schema).parquet(str(landing)), users, "2 hours")
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(
                str(tmp_path / "sent")).awaitTermination()
    finally:
        spark.conf.unset(STATE_PROVIDER)
    sent = sorted(r.alert_at for r in spark.read.parquet(str(tmp_path / "sent")).collect())
    everything = spark.createDataFrame([(1, "EC2", start + timedelta(minutes=m)) for b in batches[:-1] for m in b], schema)
    assert sent == sorted(r.alert_at for r in alerts.select_alerts(everything, users).collect())
    assert [int((at - start).total_seconds()) // 60 for at in sent] == [0, 25, 45, 85, 200, 260]


def test_rejects_of_a_file_written_in_parts(spark, tmp_path):
    folder = tmp_path / "parts" / "line=4"
    folder.mkdir(parents=True)
    (folder / "part-00000.csv").write_text("service,cost,date\nA,1,2024-01-01\nB,x,2024-01-01\n")
    (folder / "part-00001.csv").write_text("service,cost,date\nC,1,2024-01-01\nD,,2024-01-01\n")
    whole = lambda path: F.regexp_extract(path, "line=[0-9]+", 0)
    _, rejects = generic_csv.read_generic_csv(spark, str(tmp_path / "parts"), whole=whole)
    assert sorted((r.file, r.row_id) for r in rejects.collect()) == [("line=4", 2), ("line=4", 4)]
    report = generic_csv.reject_report(rejects, sample=1).collect()
    assert [(r.file, r.row, r.field, r.dropped_rows) for r in report] == [("line=4", 2, "cost", 2)]


def test_dealt_rows_are_sized_by_adaptive_execution(spark):
    plan = tables.dealt(spark.range(10))._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan


def test_stream_ingest_writes_few_files_for_a_month(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for n in range(12):
        _write(landing / f"{n}.csv", f"{','.join(ingest.RAW_FIELDS)}\n{n},aws,a,EC2,,,,,5,USD,2024-01-01,2024-01-01\n")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        folders = [str(tmp_path / n) for n in ("costs", "rejects", "check")]
        ingest.start_ingest(ingest.stream_csv(spark, str(landing)), *folders).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ingest.read_streamed_costs(spark, folders[0]).count() == 12
    assert len(list(Path(folders[0]).glob("*/*/part-*"))) < 12


def test_cooldown_reads_and_writes_state_once_a_call():
    import pandas as pd

    from spendframe.streaming.cooldown import Cooldown

    calls = []

    class Handle:
        value = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, ms):
            calls.append("timer")

        def deleteTimer(self, ms):
            calls.append("no timer")

        def getCurrentWatermarkInMs(self):
            return 100

    cooldown, handle = Cooldown(), Handle()
    cooldown.init(handle)
    key = (1, "EC2")
    list(cooldown.handleInputRows(key, iter([pd.DataFrame({"us": [50_000, 20_000, 150_000, 21_000], "cooldown_us": [9_000] * 4})]), None))
    assert calls == ["get", "timer", "update"]
    calls.clear()
    sent = pd.concat(cooldown.handleExpiredTimer(key, handle, None))
    assert sent["us"].tolist() == [20_000, 50_000] and calls == ["get", "timer", "update"]
    assert handle.value == (50_000, 151, [150_000], [9_000])
