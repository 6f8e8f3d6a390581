"""Statement labels against a scan of all terms; tables of hand-written reports against what they say."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketloom.functions import taxonomy
from marketloom.operators import reports


def scanned(folded, code, bank):
    """The first rule whose terms all occur, by looking at every rule."""
    if not bank and code in taxonomy.CODES and (code != "270" or ("tong" in folded and "tai san" in folded)):
        return taxonomy.CODES[code]
    if "bao lanh" in folded and "thu phi" in folded:
        return None
    for terms, kind, meaning in taxonomy.rules(bank):
        if all(t in folded for t in terms):
            return kind, meaning
    return None


def test_labels_against_a_scan_of_all_terms(spark):
    rng = random.Random(1)
    words = [t for bank in (False, True) for terms, _, _ in taxonomy.rules(bank) for t in terms] + ["khac", "thu phi", "tong", "tai san", "x", "net", "tien mat"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), rng.choice(["", " 270", "400", "01 ", "99", None]), rng.random() < 0.5) for i in range(1500)]
    got = spark.createDataFrame([*rows, (-1, None, None, None)], "i int, label string, code string, bank boolean").select("i", taxonomy.classified(F.col("label"), F.col("code"), F.col("bank")).alias("f")).collect()
    found = {r["i"]: None if r["f"]["meaning"] is None else tuple(r["f"]) for r in got}
    assert found.pop(-1) is None
    assert found == {i: scanned(label, (code or "").strip(), bank) for i, label, code, bank in rows}
    assert len({v for v in found.values()}) > 15


def test_heads_of_columns(spark):
    heads = {
        "so cuoi nam": "CURRENT_PERIOD", "30/06/2026": "CURRENT_PERIOD", "31.12.2025": "CURRENT_PERIOD", "31 thang 3": "CURRENT_PERIOD", "01/01/2026": "PREVIOUS_PERIOD", "nam truoc": "PREVIOUS_PERIOD",
        "chi tieu": None, "31/05": None, "": None, "previous year, current prices": "CURRENT_PERIOD",
    }
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select("h", taxonomy.period_of(F.col("h")).alias("p")).collect()
    assert {r["h"]: r["p"] for r in rows} == heads


def read(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, body string")
    return reports.table_rows(docs, "doc", "body")


def test_statements_of_two_languages(spark):
    viet = """# Công ty A
BẢNG CÂN ĐỐI KẾ TOÁN
Đơn vị tính: triệu đồng
| Mã số | Tài sản | Thuyết minh | Số cuối năm | Số đầu năm |
|---|---|:---:|---:|---|
| 270 | TỔNG CỘNG TÀI SẢN | 3 | 1.234 | (90) |
Phải thu ngắn hạn khác | 130 | | 5.000.000 |
| 270 | Nguồn vốn | | 7 | - |

BÁO CÁO LƯU CHUYỂN TIỀN TỆ
| Mã số | Chỉ tiêu | Thuyết minh | Năm nay | Năm trước |
|---|---|---|---|---|
| 01 | Lợi nhuận trước thuế | | 10 | 9 |"""
    english = """## Statement of financial position
| Item | 30/06/2026 | 01/01/2026 |
| --- | ---: | ---: |
| Total assets | 100 | 95,5 |
| Goodwill | 3 | 3 |
## Income statement
| Item | Current period |
|---|---|
| Net revenue | 1,234,567 |"""
    facts = reports.statement_facts(read(spark, viet, english, None, "", "| a | b |"), "doc").collect()
    assert sorted((r["doc"], r["line"], r["meaning"], r["period"][:4], r["value"]) for r in facts) == [
        (0, 6, "total_assets", "CURR", 1.234e9), (0, 6, "total_assets", "PREV", -9e7),
        (1, 4, "total_assets", "CURR", 100.0), (1, 4, "total_assets", "PREV", 95.5), (1, 9, "revenue", "CURR", 1234567.0),
    ]


def test_related_parties_by_the_open_category(spark):
    text = """## 2.26 Các bên liên quan và giao dịch
| Bên | Số tiền |
|---|---|
| Công ty Không | 1 |
## 39a. Giao dịch với các bên liên quan
Đơn vị: nghìn đồng
| Bên liên quan | Năm nay |
|---|---|
| Thu hồi tiền cho vay | |
| Công ty B | 12 |
| Ông C | 3,5 |
| Đi vay |  |
| Ngân hàng D | (7) |
| Tổng cộng | 99 |
## 39b. Chi tiết khác
| Tên | Số tiền |
|---|---|
| Công ty E | 5 |
## 40. Sự kiện sau kỳ
| Tên | Số tiền |
|---|---|
| Công ty F | 6 |
## Số dư với các bên liên quan
| Bên liên quan | Số tiền |
|---|---|
| Phải thu |  |
| Công ty G | 8 |"""
    got = reports.related_party_frames(read(spark, text), "doc").collect()
    assert sorted((r["line"], r["party"], r["relation"], r["flow"], r["amount"]) for r in got) == [
        (10, "Công ty B", "LENDS_TO", "loan_repayment", 12e3), (11, "Ông C", "LENDS_TO", "loan_repayment", 3500.0), (13, "Ngân hàng D", "TRANSACTS_WITH", "borrowing", -7e3),
        (18, "Công ty E", "TRANSACTS_WITH", "service_revenue", 5e3), (27, "Công ty G", "TRANSACTS_WITH", "receivable_balance", 8e3),
    ]


def test_companies_and_boards(spark):
    text = """## Phụ lục 1: Danh sách công ty con
| STT | Tên công ty | Tỷ lệ biểu quyết | Tỷ lệ sở hữu (%) |
|---|---|---|---|
| 1 | Công ty X | 60 | 51,25% |
| 2 | Ông Y | 1 | 2 |
| 3 | Công ty Z | 1 | 150 |
## Đầu tư vào công ty liên kết
| Đơn vị | Ownership |
|---|---|
| Alpha JSC | 1.020,5 |
| Beta JSC | 20.5 |
## Hội đồng quản trị
| Họ và tên | Chức vụ | Số cổ phiếu |
|---|---|---|
| 1. Trần A / Tran A | Phó Chủ tịch HĐQT | 1.200 |
| b) Lê B Mr. Le B | Tổng Giám đốc | - |
| Công ty C | Thành viên HĐQT | 5 |
| Không có | | |
## Nghị quyết
| Tên | Chức vụ |
|---|---|
| Phạm D | Kế toán trưởng |"""
    rows = read(spark, text)
    owned = reports.ownership_frames(rows, "doc").collect()
    assert sorted((r["line"], r["company"], r["relation"], r["share"]) for r in owned) == [(4, "Công ty X", "OWNS", 51.25), (11, "Beta JSC", "INVESTS_IN", 20.5)]
    people = reports.governance_frames(rows, "doc").collect()
    # "Phó Chủ tịch" holds the words of the chair, which come first.
    assert sorted((r["line"], r["person"], r["role"], r["shares"]) for r in people) == [(15, "Trần A", "CHAIRMAN", 1200.0), (16, "Lê B", "CEO", None)]
    edges = reports.frame_edges(rows, "doc").collect()
    assert sorted((r["line"], r["relation"]) for r in edges) == [(4, "OWNS"), (11, "INVESTS_IN"), (15, "GOVERNED_BY"), (16, "GOVERNED_BY")]


def test_runs_of_rows_stay_together_until_they_are_chosen(spark):
    """Windows see a row a run, not a line; a row like a heading changes the section within its block."""
    text = "## A\n| h | x |\n|---|---|\n| 1 | 2 |\n# q | b | c\n| 3 | 4 |\n\n| k | l |\n" + "| 5 | 6 |\n" * 300
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a")], "doc long, body string")
    assert reports.blocks(docs, "doc", "body").count() == 3
    got = sorted(tuple(r) for r in reports.table_rows(docs, "doc", "body").select("line", "block", "section", "head", "cells").filter("line < 10").collect())
    assert got == [(4, 1, "## a", ["h", "x"], ["1", "2"]), (5, 1, "# q | b | c", ["h", "x"], ["# q", "b", "c"]), (6, 1, "# q | b | c", ["h", "x"], ["3", "4"]), (9, 2, "# q | b | c", ["k", "l"], ["5", "6"])]


def test_reports_of_a_task_are_bounded(spark, small, monkeypatch):
    from marketloom.plans import reports as plans

    monkeypatch.setattr(plans, "REPORTS", 1)
    count = spark.read.parquet(f"{small}/supplier.parquet").count()
    assert plans.reports(spark, small).rdd.getNumPartitions() > count > 8 or count <= 8 < plans.reports(spark, small).rdd.getNumPartitions() + 1
