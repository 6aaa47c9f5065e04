"""Cleaning, fingerprints and landing."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from controlweave.plans.run import report
from controlweave.plans.spec import SpecError
from controlweave.sources import evidence
from controlweave.sources.catalog import Catalog
from controlweave.sources.ledger import Ledger

from helpers import control, frame, keep, match, values


def test_headers(spark):
    df = frame(spark, "` Trade ID ` string, `Notional Amount` double", [("1", 2.0)])
    assert evidence.with_clean_names(df).columns == ["trade_id", "notional_amount"]
    with pytest.raises(SpecError, match="trade_id"):
        evidence.with_clean_names(frame(spark, "`Trade ID` string, trade_id string", []))


def test_dirty_cases(spark):
    df = frame(
        spark,
        "employee_number bigint, price string, closed_date string, paid_amount double, validation_date string, note string",
        [
            (7, "$12,345.67", "2025-07-01", 1.5, "2025-07-02 10:11:12", "fine"),
            (None, "1,000", "bad", 2.0, "07/03/2025", None),
            (8, "n/a", None, None, None, "12 apples"),
            (9, None, "04-Jul-2025", None, "x", "-"),
        ],
    )
    cleaned = evidence.clean(df)
    assert dict(cleaned.dtypes) == {
        "employee_number": "string", "price": "double", "closed_date": "timestamp_ntz",
        "paid_amount": "string", "validation_date": "timestamp_ntz", "note": "string",
    }
    rows = cleaned.collect()
    assert [r.employee_number for r in rows] == ["7", None, "8", "9"]
    assert [r.price for r in rows] == [12345.67, 1000.0, None, None]
    assert [r.closed_date for r in rows] == [datetime(2025, 7, 1), None, None, datetime(2025, 7, 4)]
    assert [r.validation_date for r in rows] == [datetime(2025, 7, 2, 10, 11, 12), datetime(2025, 7, 3), None, None]
    assert [r.note for r in rows] == ["fine", None, "12 apples", "-"]


def test_dotted_dates_are_dates(spark):
    df = frame(spark, "closed_date string", [("04.07.2025",), ("2025-07-05",)])
    assert values(evidence.clean(df)) == [(datetime(2025, 7, 4),), (datetime(2025, 7, 5),)]


def test_text_that_is_mostly_no_number_or_date_stays(spark):
    df = frame(spark, "memo string, candidate_id string, total string", [("2024", "C1", "7"), ("a word", "C2", "n/a"), (".", "C3", "1,5")])
    cleaned = evidence.clean(df)
    assert dict(cleaned.dtypes) == {"memo": "string", "candidate_id": "string", "total": "double"}
    assert values(cleaned.select("memo", "candidate_id")) == values(df.select("memo", "candidate_id"))


def test_overrides_and_lost_values(spark):
    df = frame(spark, "paid_amount string, memo string", [("$5", "17"), ("6", "hello"), ("x", None)])
    lost = {r.column_name: (r.rule, r.nulls_introduced) for r in evidence.cleaning_report(df).collect()}
    assert lost == {"paid_amount": ("string", 0), "memo": ("keep", 0)}
    fixed = evidence.clean(df, overrides={"paid_amount": "numeric", "memo": "keep"})
    assert values(fixed) == [(None, None), (5.0, "17"), (6.0, "hello")]
    lax = evidence.clean(df, min_share=0.4)
    assert dict(lax.dtypes)["memo"] == "double"
    with pytest.raises(SpecError, match="not known"):
        evidence.clean(df, overrides={"memo": "guess"})


@pytest.mark.parametrize(
    "text, number",
    [("$12,345.67", 12345.67), ("€ 5", 5.0), ("-3.5", -3.5), ("£1.000", 1.0), ("", None), ("1-2", None), ("abc", None),
     ("1.2.3", None), ("USD 7.25", 7.25)],
)
def test_number_text(spark, text, number):
    df = frame(spark, "v string", [(text,)])
    assert df.select(evidence.as_number(df.v).alias("n")).first().n == number


def test_decimal_comma(spark):
    df = frame(spark, "v string", [("1.234,56 €",)])
    assert df.select(evidence.as_number(df.v, decimal_comma=True).alias("n")).first().n == 1234.56


def test_schema_version_follows_names_types_and_order(spark):
    one = frame(spark, "a int, b string", [])
    assert len(evidence.schema_version(one)) == 16
    assert evidence.schema_version(one) == evidence.schema_version(frame(spark, "a int, b string", [(1, "x")]))
    others = [frame(spark, s, []) for s in ("b string, a int", "a bigint, b string", "a int, c string")]
    assert len({evidence.schema_version(df) for df in [one, *others]}) == 4


def test_file_hash_is_the_sha256_of_the_bytes(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "k int", [(i,) for i in range(10)]).coalesce(1).write.parquet(path)
    part = [f for f in os.listdir(path) if f.endswith(".parquet")][0]
    with open(os.path.join(path, part), "rb") as file:
        expected = hashlib.sha256(file.read()).hexdigest()
    found = evidence.dataset_hash(spark, path).first()
    assert (found.file_count, found.sha256_hash) == (1, expected)


def test_dataset_hash_changes_with_any_file(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "k int", [(i,) for i in range(50)]).repartition(6).write.parquet(path)
    before = evidence.dataset_hash(spark, path).first()
    assert before.file_count == 6
    assert evidence.dataset_hash(spark, path).first() == before
    frame(spark, "k int", [(99,)]).coalesce(1).write.mode("append").parquet(path)
    after = evidence.dataset_hash(spark, path).first()
    assert after.file_count == 7 and after.sha256_hash != before.sha256_hash


def test_content_fingerprint_ignores_order_only(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "c")]
    df = frame(spark, "k int, s string", rows)
    base = evidence.content_fingerprint(df).first()
    assert evidence.content_fingerprint(df.repartition(3).orderBy("s")).first() == base
    for other in ([(1, "a"), (2, None), (3, "c")], [(1, "a"), (2, None), (2, "x"), (3, "c")]):
        assert evidence.content_fingerprint(frame(spark, "k int, s string", other)).first() != base
    assert evidence.content_fingerprint(frame(spark, "k int", [])).first().row_count == 0


def test_landed_files_feed_a_control(spark, tmp_path):
    """CSV in, cleaned Parquet with a manifest out, control run on it."""
    source = tmp_path / "Trade Log.csv"
    source.write_text(
        "Trade ID,Notional Amount,Approval Status,Trade Date\n"
        'T1,"$60,000.00",approved ,2025-01-02\nT2,"75,000",PENDING,2025-01-03\nT3,10,PENDING,soon\n'
    )
    incoming = evidence.read_source(spark, str(source), "csv")
    prefix = evidence.file_prefix(str(source))
    manifests = evidence.land_all(
        spark, {"Sheet1": incoming}, prefix, str(tmp_path / "landed"), "BLOTTER", datetime(2025, 1, 4)
    )
    found = manifests["trade_log_sheet1"]
    assert (found["row_count"], found["column_count"], found["source_system"]) == (3, 4, "BLOTTER")
    assert found["columns"] == ["trade_id", "notional_amount", "approval_status", "trade_date"]
    assert found["extraction_timestamp"] == "2025-01-04T00:00:00" and len(found["sha256_hash"]) == 64
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.append_manifests(list(manifests.values()))
    ledger.append_manifests(list(manifests.values()))
    assert ledger.manifests().count() == 2
    assert ledger.manifests().first()["columns"] == found["columns"]

    spec = control("trade_log_sheet1", [keep("notional_amount", "gt", 50000)], [match("approval_status", "eq", "APPROVED")])
    cat = Catalog.of_manifests(spark, manifests)
    row = report([spec], cat).first()
    assert (row.total_population, row.exception_count) == (2, 1)
    assert cat.sha256_hash("trade_log_sheet1") == found["sha256_hash"]


@pytest.mark.parametrize("kind", ["json", "parquet", "orc"])
def test_other_formats(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    frame(spark, "k int, s string", [(1, "a"), (2, "b")]).write.format(kind).save(path)
    assert evidence.read_source(spark, path, kind).count() == 2
    with pytest.raises(SpecError):
        evidence.read_source(spark, path, "xlsx")


def settled(frame_):
    return frame_.sparkSession.createDataFrame(frame_.collect(), frame_.schema)


def test_a_file_of_more_than_two_gigabytes_and_a_flipped_byte(spark, tmp_path):
    import hashlib
    import os

    path = tmp_path / "large" / "part.parquet"
    os.makedirs(path.parent)
    size = (2 << 30) + 12_345
    with open(path, "wb") as file:  # holes: nothing of this takes disk
        file.truncate(size)
    ranges = settled(evidence.range_hashes(spark, str(path.parent)))
    assert ranges.count() == 33 and {r.bytes for r in ranges.collect()} == {64 << 20, 12_345}
    zeros = hashlib.sha256(bytes(64 << 20)).hexdigest()
    leaves = [zeros] * 32 + [hashlib.sha256(bytes(12_345)).hexdigest()]
    root = evidence.folded_hashes(ranges, ["path"], "range").first().sha256_hash
    assert root == hashlib.sha256("".join(leaves).encode()).hexdigest()
    with open(path, "r+b") as file:
        file.seek((5 << 26) + 99)
        file.write(b"\x01")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.append_ranges("large", ranges)
    current = settled(evidence.range_hashes(spark, str(path.parent)))
    found = values(ledger.tampered_ranges("large", current), "range", "offset", "bytes", "change")
    assert found == [(5, 5 << 26, 64 << 20, "CHANGED")]
    ledger.append_ranges("large", current)
    assert ledger.tampered_ranges("large", current).isEmpty()


def test_hash_trees_of_small_files_and_of_files_that_grow(spark, tmp_path):
    import hashlib

    folder = tmp_path / "few"
    folder.mkdir()
    for name, data in (("a.parquet", b"abc" * 10), ("b.parquet", b"x"), ("c.txt", b"no evidence"), ("d.parquet", b"")):
        (folder / name).write_bytes(data)
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256_hash for r in evidence.file_hashes(spark, str(folder)).collect()}
    assert hashes == {"a.parquet": hashlib.sha256(b"abc" * 10).hexdigest(), "b.parquet": hashlib.sha256(b"x").hexdigest()}
    before = settled(evidence.range_hashes(spark, str(folder), size=8))
    assert before.count() == 5
    (folder / "a.parquet").write_bytes(b"abc" * 12)
    (folder / "b.parquet").unlink()
    after = evidence.range_hashes(spark, str(folder), size=8)
    assert values(evidence.changed_ranges(before, after), "range", "change") == [(0, "MISSING"), (3, "CHANGED"), (4, "ADDED")]


def test_trees_do_not_depend_on_the_order_of_rows_and_fold_by_neighbours(spark):
    import hashlib

    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaves = [h(str(i)) for i in range(11)]
    level = [h(*leaves[:3]), h(*leaves[3:6]), h(*leaves[6:9]), h(*leaves[9:])]
    want = h(h(*level[:3]), level[3])
    frame_ = spark.createDataFrame([("f", i, x) for i, x in reversed(list(enumerate(leaves)))] + [("g", 0, leaves[0])], "f string, i bigint, sha256_hash string")
    assert values(evidence.folded_hashes(frame_.repartition(5), ["f"], "i", fan_out=3)) == [("f", want), ("g", leaves[0])]
    assert evidence.folded_hashes(frame_.limit(0), ["f"], "i").count() == 0


def test_a_column_of_slashed_dates_is_read_by_one_format(spark):
    rows = [("03/04/2024", "03/04/2024", "03/04/2024"), ("13/04/2024", "04/13/2024", "05/06/2024"), ("25/12/2023", "12/25/2023", "n/a"), ("2024-01-02", "02.01.2024", None)]
    got = evidence.clean(frame(spark, "`day date` string, `month date` string, `open date` string", rows))
    days = lambda name: [r[name] and r[name].date().isoformat() for r in got.collect()]
    assert days("day_date") == ["2024-04-03", "2024-04-13", "2023-12-25", "2024-01-02"]
    assert days("month_date") == ["2024-03-04", "2024-04-13", "2023-12-25", "2024-01-02"]
    assert days("open_date") == ["2024-03-04", "2024-05-06", None, None]  # nothing decides: the first of the formats


def test_rules_are_decided_in_one_pass(spark, monkeypatch):
    df = frame(spark, "a string, b string, `start date` string, id string", [("1", "x", "2024-01-02", "7")] * 20)
    passes = []
    kind = type(df)
    real = kind.first
    monkeypatch.setattr(kind, "first", lambda self: passes.append(1) or real(self))
    plan = {c.name: c.rule for c in evidence.cleaning(evidence.with_clean_names(df))}
    assert plan == {"a": "numeric", "b": "keep", "start_date": "timestamp", "id": "string"} and len(passes) == 1


def test_landed_evidence_is_files_of_bounded_size(spark, tmp_path):
    from controlweave.workload.evidence import landed

    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    landed(rows, ["k"], str(tmp_path / "items"), rows_per_file=1000)
    files = spark.read.parquet(str(tmp_path / "items")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 5 and max(f["count"] for f in files) < 2000


def test_ranges_are_hashed_by_all_tasks(spark, tmp_path, monkeypatch):
    spark.range(3000).repartition(6).write.parquet(str(tmp_path / "d"))
    ledger = Ledger(spark, str(tmp_path / "l"))
    ranges = evidence.range_hashes(spark, str(tmp_path / "d"), size=1 << 10)
    tasks = spark.sparkContext.accumulator(0)

    def seen(batches):
        tasks.add(1)
        yield from batches

    ledger.append_ranges("d", ranges.mapInArrow(seen, ranges.schema))
    assert tasks.value > 1 and ledger.ranges().count() == ranges.count()
