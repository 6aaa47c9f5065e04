"""Ten business controls on seeded evidence with known violations among many rows."""

import random
from datetime import date, datetime, timedelta

import pytest

from controlweave.plans.run import attribution, exceptions, report

from helpers import catalog, control, frame, join, keep, keep_in, keep_null, match, rule, values

DAY0 = date(2025, 1, 1)


def days(n):
    return (DAY0 + timedelta(days=n)).isoformat()


def deadline(base, op, target, n, assertion_id="deadline"):
    return rule("temporal_date_math", assertion_id, base_date_field=base, operator=op, target_date_field=target, offset_days=n)


def found_keys(spec, cat, key):
    return [k for (k,) in values(exceptions(spec, cat)["rows"], key)]


def verdict(spec, cat):
    row = report([spec], cat).first()
    return row.verdict, row.exception_count, row.total_population


@pytest.fixture
def rng():
    return random.Random(20250101)


def test_due_diligence(spark, rng):
    onboarding, edd = [], []
    for i in range(400):
        risk = rng.choice(["LOW", "MEDIUM", "HIGH"])
        start = rng.randrange(100)
        onboarding.append((f"C{i:04d}", f"TAX{i:04d}", days(start), risk, "OPEN"))
        if risk == "HIGH":
            edd.append((f"C{i:04d}", days(start + rng.randrange(0, 15)), "AN1"))
    onboarding += [("LATE", "TAXL", days(0), "HIGH", "OPEN"), ("MISSING", "TAXM", days(0), "HIGH", "OPEN"),
                   ("LISTED", "BAD1", days(0), "HIGH", "OPEN")]
    edd += [("LATE", days(25), "AN1"), ("LISTED", days(14), "AN1")]
    cat = catalog(
        log=frame(spark, "customer_id string, tax_id string, onboarding_date string, risk_rating string, account_status string", onboarding),
        edd=frame(spark, "customer_id string, edd_completion_date string, analyst_id string", edd),
        ofac=frame(spark, "tax_id string, sanction_entity_name string", [("BAD1", "X"), ("BAD2", "Y")]),
    )
    spec = control(
        "log",
        [keep("risk_rating", "eq", "HIGH"), ("edd", join("edd", "customer_id", "customer_id")),
         ("ofac", join("ofac", "tax_id", "tax_id"))],
        [match("ofac_tax_id", "eq", None, "not_listed"), match("edd_customer_id", "neq", None, "reviewed"),
         deadline("edd_completion_date", "lte", "onboarding_date", 14)],
    )
    assert found_keys(spec, cat, "customer_id") == ["LATE", "LISTED", "MISSING"]
    reasons = {r.customer_id: r.failed_assertions for r in attribution(spec, cat).collect()}
    assert reasons == {"LATE": ["deadline"], "LISTED": ["not_listed"], "MISSING": ["reviewed", "deadline"]}


def test_restricted_trading(spark, rng):
    trades = [(f"TXN{i:05d}", f"E{rng.randrange(100)}", f"OK{rng.randrange(50)}", days(rng.randrange(300))) for i in range(800)]
    register = [(f"E{i}", f"R{i}", days(10), "CLEARED", days(50)) for i in range(30)]
    register += [("E50", "R50", days(10), "RESTRICTED", None)]
    trades += [("EARLY", "E1", "R1", days(50)), ("BANNED", "E50", "R50", days(99)), ("FINE", "E2", "R2", days(51))]
    cat = catalog(
        blotter=frame(spark, "trade_id string, employee_id string, ticker_symbol string, trade_date string", trades),
        register=frame(spark, "employee_id string, ticker_symbol string, cross_date string, restriction_status string, clearance_date string", register),
    )
    spec = control(
        "blotter",
        [("wall", join("register", ["employee_id", "ticker_symbol"], ["employee_id", "ticker_symbol"])),
         keep_null("wall_employee_id", False)],
        [match("restriction_status", "eq", "CLEARED", "cleared"),
         rule("column_comparison", "cool_off", left_field="trade_date", operator="gt", right_field="clearance_date")],
    )
    assert found_keys(spec, cat, "trade_id") == ["BANNED", "EARLY"]
    assert verdict(spec, cat) == ("FAIL", 2, 3)


def test_ghost_accounts(spark, rng):
    accounts = [(f"A{i}", f"E{i}", rng.choice(["ACTIVE", "DISABLED"])) for i in range(600)]
    roster = [(f"E{i}", "ACTIVE") for i in range(600)]
    accounts += [("LEAVER", "E900", "ACTIVE"), ("GHOST", "E999", "ACTIVE"), ("OLD", "E901", "DISABLED")]
    roster += [("E900", "TERMINATED"), ("E901", "TERMINATED")]
    cat = catalog(ad=frame(spark, "account string, employee_id string, account_status string", accounts),
                  hr=frame(spark, "employee_id string, employment_status string", roster))
    spec = control(
        "ad", [("hr", join("hr", "employee_id", "employee_id")), keep("account_status", "eq", "ACTIVE")],
        [match("employment_status", "neq", "TERMINATED", "employed"), match("employment_status", "neq", None, "known")],
    )
    assert found_keys(spec, cat, "account") == ["GHOST", "LEAVER"]


def test_settlement(spark, rng):
    rows = [(f"EQ{i}", days(i % 90), days(i % 90 + rng.randrange(3)), rng.choice(["SETTLED", "PENDING"])) for i in range(900)]
    rows += [("SLOW", days(3), days(8), "SETTLED"), ("OPEN", days(3), days(9), "PENDING")]
    cat = catalog(t=frame(spark, "trade_id string, trade_date string, settlement_date string, trade_status string", rows))
    spec = control("t", [keep("trade_status", "eq", "SETTLED")], [deadline("settlement_date", "lte", "trade_date", 2)])
    assert found_keys(spec, cat, "trade_id") == ["SLOW"]


def test_invoice_authority(spark, rng):
    titles = [(f"AP{i}", rng.choice(["SVP", "EVP", "CEO", "CFO"])) for i in range(50)] + [("AP99", "ANALYST")]
    rows = [(f"INV{i}", rng.uniform(1, 250000), f"AP{rng.randrange(50)}") for i in range(500)]
    rows += [("BAD", 150000.0, "AP99"), ("SMALL", 100000.0, "AP99"), ("NOBODY", 100000.01, "AP77")]
    cat = catalog(inv=frame(spark, "invoice_id string, invoice_amount double, approver_id string", rows),
                  titles=frame(spark, "approver_id string, approver_title string", titles))
    spec = control(
        "inv", [keep("invoice_amount", "gt", 100000), ("t", join("titles", "approver_id", "approver_id"))],
        [match("approver_title", "in", ["SVP", "EVP", "CEO", "CFO"])],
    )
    assert found_keys(spec, cat, "invoice_id") == ["BAD", "NOBODY"]


def test_wash_trades(spark, rng):
    rows = []
    for i in range(900):
        buyer = rng.randrange(100)
        rows.append((f"EX{i}", rng.choice(["EXECUTED", "CANCELLED"]), f"ACC{buyer}", f"ACC{buyer + 1 + rng.randrange(50)}"))
    rows += [("WASH", "EXECUTED", "ACC42", "ACC42"), ("VOID", "CANCELLED", "ACC42", "ACC42"), ("HALF", "EXECUTED", "ACC1", None)]
    cat = catalog(t=frame(spark, "id string, status string, buyer_account_id string, seller_account_id string", rows))
    spec = control("t", [keep("status", "eq", "EXECUTED")],
                   [rule("column_comparison", left_field="buyer_account_id", operator="neq", right_field="seller_account_id")])
    assert found_keys(spec, cat, "id") == ["HALF", "WASH"]


def test_client_money(spark, rng):
    rows = [(days(d), f"A{a}", rng.choice(["CLIENT_FUNDS", "FIRM"]) if a else "CLIENT_FUNDS", 1e6)
            for d in range(30) for a in range(0, 100)]
    rows = [(d, a, k, 1e9 if a == "A0" and d != days(14) else b if d != days(14) else 1e5) for d, a, k, b in rows]
    cat = catalog(t=frame(spark, "calculation_date string, account_id string, account_type string, current_balance double", rows))
    spec = control("t", [keep("account_type", "eq", "CLIENT_FUNDS")],
                   [rule("aggregation", "buffer", group_by_fields=["calculation_date"], metric_field="current_balance",
                         aggregation_function="SUM", operator="gte", threshold=50000000)])
    assert values(exceptions(spec, cat)["buffer"], "calculation_date") == [(days(14),)]
    row = report([spec], cat).first()
    assert (row.exception_count, row.group_population) == (1, 30)


def test_leaver_access(spark, rng):
    leavers = [(f"E{i}", days(i % 60), rng.choice(["VOLUNTARY", "INVOLUNTARY", "RETIRED"])) for i in range(400)]
    tickets = [(f"T{i}", f"E{i}", "CLOSED", days(i % 60 + rng.randrange(2))) for i in range(400)]
    leavers += [("SLOW", days(1), "VOLUNTARY"), ("KEPT", days(1), "INVOLUNTARY"), ("NONE", days(1), "VOLUNTARY"), ("RET", days(1), "RETIRED")]
    tickets += [("T-S", "SLOW", "CLOSED", days(6)), ("T-K", "KEPT", "closed ", days(2))]
    accounts = [(f"ACC{i}", f"X{i}", days(5)) for i in range(200)] + [("ACC-K", "KEPT", days(9))]
    cat = catalog(hr=frame(spark, "employee_id string, termination_date string, termination_type string", leavers),
                  tickets=frame(spark, "ticket_id string, employee_id string, ticket_status string, closed_date string", tickets),
                  accounts=frame(spark, "account_id string, employee_id string, last_login string", accounts))
    spec = control(
        "hr",
        [keep_in("termination_type", "VOLUNTARY", "INVOLUNTARY"), ("ticket", join("tickets", "employee_id", "employee_id")),
         ("account", join("accounts", "employee_id", "employee_id"))],
        [match("ticket_status", "eq", "CLOSED", "closed"), deadline("closed_date", "lte", "termination_date", 1),
         match("account_employee_id", "eq", None, "gone")],
    )
    assert found_keys(spec, cat, "employee_id") == ["KEPT", "NONE", "SLOW"]


def test_vendor_reviews(spark, rng):
    contracts = [(f"K{i}", f"V{i}", rng.choice(["ACTIVE", "ENDED"]), days(100 + i % 50)) for i in range(300)]
    vendors = [(f"V{i}", f"Vendor {i}", "TIER_1" if i % 3 == 0 else "TIER_2") for i in range(400)]
    reviews = [(f"A{i}", f"V{i}", "FAILED", days(120), days(1)) for i in range(300)]
    reviews += [(f"B{i}", f"V{i}", "PASSED", days(400), days(2)) for i in range(300)]
    contracts += [("K-FAILED", "V303", "ACTIVE", days(10)), ("K-EXPIRED", "V306", "ACTIVE", days(100)), ("K-TIER2", "V304", "ACTIVE", days(10))]
    reviews += [("C1", "V303", "PASSED", days(400), days(1)), ("C2", "V303", "FAILED", days(400), days(3)),
                ("C3", "V306", "PASSED", days(70), days(3)), ("C4", "V304", "FAILED", days(1), days(3))]
    cat = catalog(
        contracts=frame(spark, "contract_id string, vendor_id string, contract_status string, renewal_date string", contracts),
        vendors=frame(spark, "vendor_id string, vendor_name string, criticality string", vendors),
        reviews=frame(spark, "assessment_id string, vendor_id string, assessment_status string, expiration_date string, done string", reviews),
    )
    spec = control(
        "contracts",
        [keep("contract_status", "eq", "ACTIVE"), ("v", join("vendors", "vendor_id", "vendor_id")), keep("criticality", "eq", "TIER_1"),
         ("r", join("reviews", "vendor_id", "vendor_id", latest_by=["done"]))],
        [match("assessment_status", "eq", "PASSED", "passed"),
         rule("column_comparison", "outlasts", left_field="expiration_date", operator="gt", right_field="renewal_date")],
    )
    assert found_keys(spec, cat, "contract_id") == ["K-EXPIRED", "K-FAILED"]


def test_letter_mismatch(spark, rng):
    rows = [(f"R{i}", days(i % 60), "MATCH", "N", None) for i in range(500)]
    rows += [("HANDLED", days(0), "MISMATCH", "Y", days(30)), ("UNRAISED", days(0), "MISMATCH", "N", days(5)),
             ("LATE", days(0), "MISMATCH", "Y", days(45)), ("OPEN", days(0), "MISMATCH", "Y", None)]
    cat = catalog(t=frame(spark, "record_id string, application_date string, reconciliation_status string, "
                                 "bref_raised_flag string, resolution_date string", rows))
    spec = control("t", [keep("reconciliation_status", "eq", "MISMATCH")],
                   [match("bref_raised_flag", "eq", "y", "raised"), deadline("resolution_date", "lte", "application_date", 30)])
    assert found_keys(spec, cat, "record_id") == ["LATE", "OPEN", "UNRAISED"]
    assert verdict(spec, cat) == ("FAIL", 3, 4)


def test_trades_roster_and_limits(spark, rng):
    """Ten thousand trades: an approval rule, an approver rule and a daily limit."""
    trades = []
    for i in range(10000):
        amount = rng.uniform(100, 9000)
        trades.append((f"TRD{i:06d}", datetime(2025, 1, 1) + timedelta(days=rng.randrange(60)), f"EMP{rng.randrange(500):04d}",
                       amount, rng.choices(["APPROVED", "PENDING", "REJECTED"], [80, 15, 5])[0], f"MGR{rng.randrange(50)}"))
    roster = [(f"MGR{i}", "ACTIVE") for i in range(50)] + [("MGR99", "TERMINATED")]
    when = datetime(2025, 2, 15)
    trades += [("BIG", when, "EMP1", 75000.0, "PENDING", "MGR1"), ("EXMGR", when, "EMP1", 10.0, "APPROVED", "MGR99")]
    trades += [(f"SUM{i}", when, "EMP_0099", 600000.0, "APPROVED", "MGR1") for i in range(4)]
    cat = catalog(
        trades=frame(spark, "trade_id string, trade_date timestamp_ntz, trader_id string, notional_amount double, approval_status string, approver_id string", trades),
        hr=frame(spark, "employee_id string, employment_status string", roster),
    )
    approval = control("trades", [keep("notional_amount", "gt", 50000)], [match("approval_status", "eq", "APPROVED")], control_id="A")
    approver = control("trades", [keep("approval_status", "eq", "APPROVED"), ("hr", join("hr", "approver_id", "employee_id"))],
                       [match("employment_status", "eq", "ACTIVE")], control_id="B")
    daily = control("trades", [], [rule("aggregation", "day", group_by_fields=["trader_id", "trade_date"], metric_field="notional_amount",
                                        aggregation_function="SUM", operator="lte", threshold=2000000)], control_id="C")
    assert found_keys(approval, cat, "trade_id") == ["BIG"]
    assert found_keys(approver, cat, "trade_id") == ["EXMGR"]
    assert values(exceptions(daily, cat)["day"], "trader_id", "exception_count", "total_amount") == [("EMP_0099", 4, 2400000.0)]
    together = {r.control_id: r.exception_count for r in report([approval, approver, daily], cat).collect()}
    assert together == {"A": 1, "B": 1, "C": 1}
