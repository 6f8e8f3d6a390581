"""Reports of suppliers, written from trades and relations, and what is read back from them.

``reports`` renders a markdown report a supplier: its statements (in two languages, three
units, with lost pipes, negative numbers in brackets and a cash flow that must not be
read), its related parties by kind of flow, the companies it owns, and its board. The
queries read these texts; their SQL takes the figures from the tables instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import reports as R
from marketloom.operators.steps import written
from marketloom.plans.catalog import query
from marketloom.plans.relations import CONTROL, SQL_RELATIONS, relations
from marketloom.sources.tables import load

YEARS = (2000, 1999)
#: About as many reports are read in a task.
REPORTS = 1000
#: Kinds of relations as a report's categories call them.
CATEGORY = {"lends_to": "Cho vay", "guarantees_for": "Bảo lãnh", "transacts_with": "Mua hàng", "creditor_of": "Phải thu khách hàng"}
RELATION = {"lends_to": ("LENDS_TO", "loan"), "guarantees_for": ("GUARANTEES_FOR", "guarantee"), "transacts_with": ("TRANSACTS_WITH", "purchase"), "creditor_of": ("TRANSACTS_WITH", "receivable")}
SEATS = ("Chủ tịch HĐQT", "Thành viên HĐQT", "Thành viên HĐQT độc lập", "Trưởng Ban Kiểm soát", "Tổng Giám đốc", "Người được ủy quyền")
ROLE = ("CHAIRMAN", "BOD_MEMBER", "INDEPENDENT_BOD_MEMBER", "CHIEF_SUPERVISOR", "CEO", "INSIDER")
#: Items: code, Vietnamese and English label, statement, meaning and kind, and the sum they come from.
ITEMS = (
    ("270", "TỔNG CỘNG TÀI SẢN", "TOTAL ASSETS", "balance_sheet", "total_assets", "OTHER", "l_extendedprice"),
    ("400", "Vốn chủ sở hữu", "Total equity", "balance_sheet", "total_equity", "EQUITY", "l_extendedprice * (1 - l_discount)"),
    ("130", "Các khoản phải thu ngắn hạn", "Trade receivables", "balance_sheet", "total_receivables", "RECEIVABLE_BALANCE", "l_extendedprice * l_tax"),
    ("10", "Doanh thu thuần", "Net revenue", "income_statement", "revenue", "REVENUE", "CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END"),
    ("60", "Lợi nhuận sau thuế", "Net profit", "income_statement", "profit", "PROFIT", "l_extendedprice * (l_discount - 0.05)"),
)
_WHOLE = "CAST(floor({x} + 0.00005) AS BIGINT)"
_SCALE = "CASE s_suppkey % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1.0 END"
_SUMS = {f"a{k}_{y}": f"{_WHOLE.format(x=f'coalesce(sum(CASE WHEN year(l_shipdate) = {y} THEN {item[6]} END), 0)')}" for k, item in enumerate(ITEMS) for y in YEARS}
SQL_FIGURES = f"figures AS (SELECT l_suppkey AS s_suppkey, {', '.join(f'{x} AS {n}' for n, x in _SUMS.items())} FROM lineitem GROUP BY ALL)"
SQL_PARTIES = f"""{SQL_RELATIONS}, parties AS (SELECT source AS s_suppkey, kind, target, {_WHOLE.format(x="sum(amount)")} AS amount FROM relations GROUP BY ALL)"""
SQL_OWNED = f"""stakes AS (SELECT source, target, sum(amount) AS stake FROM relations GROUP BY ALL HAVING sum(amount) > 0),
owned AS (SELECT source AS s_suppkey, target, CAST(floor(1000 * share + 0.00005) AS BIGINT) / 10.0 AS share FROM (SELECT *, stake / sum(stake) OVER (PARTITION BY target) AS share, max(stake) OVER (PARTITION BY target) AS most FROM stakes) WHERE stake >= {CONTROL} * most)"""


def _amount(x: Column) -> Column:
    """A number as reports print it: dots between thousands, brackets for negative ones."""
    text = F.replace(F.format_number(F.abs(x), 0), F.lit(","), F.lit("."))
    return F.when(x < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def _line(*cells: Column | str, pipe: bool = True) -> Column:
    parts = [c if isinstance(c, Column) else F.lit(c) for c in cells]
    joined = F.concat_ws(" | ", *parts)
    return F.concat(F.lit("| "), joined, F.lit(" |")) if pipe else F.concat(joined, F.lit(" |"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """s_suppkey and text."""
    figures = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(*[F.expr(x).alias(n) for n, x in _SUMS.items()])
    made = written(relations(spark, d).select("source", "target", "kind", "amount"))
    flows = made.groupBy(F.col("source").alias("s_suppkey"), "kind", "target").agg(F.expr(_WHOLE.format(x="sum(amount)")).alias("amount"))
    names = load(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.concat(F.lit("Công ty "), F.col("s_name")).alias("name"))
    said = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])
    flows = flows.join(names, "target").groupBy("s_suppkey", "kind").agg(F.array_sort(F.collect_list(F.struct("target", _line(F.col("name"), _amount(F.col("amount"))).alias("row")))).alias("rows"))
    category = F.concat(F.array(_line(F.element_at(said, F.col("kind")), "")), F.transform("rows", lambda r: r["row"]))
    flows = flows.groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct("kind", category.alias("rows")))).alias("kinds"))
    flows = flows.select("s_suppkey", F.flatten(F.transform("kinds", lambda k: k["rows"])).alias("flow_rows"))
    stakes = made.groupBy("source", "target").agg(F.sum("amount").alias("stake")).filter("stake > 0")
    share = stakes.selectExpr("*", "stake / sum(stake) OVER (PARTITION BY target) AS share", "max(stake) OVER (PARTITION BY target) AS most").filter(f"stake >= {CONTROL} * most")
    tenths = F.floor(1000 * F.col("share") + 0.00005).cast("long")
    percent = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(" %"))
    owned = share.join(names, "target").groupBy(F.col("source").alias("s_suppkey")).agg(F.array_sort(F.collect_list(F.struct("target", _line(F.col("target").cast("string"), F.col("name"), percent).alias("row")))).alias("own"))
    owned = owned.select("s_suppkey", F.transform("own", lambda r: r["row"]).alias("own_rows"))
    count = load(spark, d, "supplier").count()
    seat = F.element_at(F.array(*map(F.lit, SEATS)), F.pmod(F.col("c_nationkey"), F.lit(len(SEATS))) + 1)
    board = load(spark, d, "customer").select(F.pmod("c_custkey", F.lit(count)).alias("s_suppkey"), "c_custkey", _line(F.concat((F.col("c_custkey") % 9 + 1).cast("string"), F.lit(". Nguyễn "), F.translate("c_name", "#0123456789", " abcdefghij"), F.lit(" / Mr. Nguyen")), seat, _amount(F.floor(F.abs("c_acctbal")).cast("long"))).alias("row"))
    board = board.groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))).alias("b")).select("s_suppkey", F.transform("b", lambda r: r["row"]).alias("board_rows"))
    s = load(spark, d, "supplier").select("s_suppkey", "s_name").join(figures, "s_suppkey", "left")
    for more in (flows, owned, board):
        s = s.join(more, "s_suppkey", "left")
    k = F.col("s_suppkey")
    english, bank, lost = k % 4 == 1, k % 5 == 0, k % 2 == 0
    figure = lambda i, y: _amount(F.coalesce(F.col(f"a{i}_{y}"), F.lit(0).cast("long")))

    def item(i: int) -> Column:
        code, viet, eng, *_ = ITEMS[i]
        said = [code, F.when(english, eng).otherwise(viet), "V.1" if i == 1 else "", figure(i, YEARS[0]), figure(i, YEARS[1])]
        return F.when(lost & (i == 2), _line(*said, pipe=False)).otherwise(_line(*said))

    head = lambda viet, eng: F.when(english, F.lit(eng)).otherwise(F.lit(viet))
    columns = F.when(english, _line("Code", "Item", "Note", "Current period", "Previous period")).when(k % 4 == 2, _line("Mã số", "CHỈ TIÊU", "Thuyết minh", f"31/12/{YEARS[0]}", f"01/01/{YEARS[0]}")).otherwise(_line("Mã số", "CHỈ TIÊU", "Thuyết minh", "Số cuối năm", "Số đầu năm"))
    rule = F.lit("| :--- | :--- | :--- | ---: | ---: |")
    rows = lambda c, *heads: F.when(F.col(c).isNotNull(), F.concat(F.array(*heads), F.col(c))).otherwise(F.array().cast("array<string>"))
    unit = F.when(k % 3 == 0, head("Đơn vị tính: triệu đồng", "Unit: million VND")).when(k % 3 == 1, head("Đơn vị: nghìn đồng", "Currency: thousand VND")).otherwise(head("Đơn vị: đồng", "Unit: VND"))
    text = F.concat(
        F.array(F.concat(F.when(bank, "# Ngân hàng ").otherwise("# Công ty "), "s_name"), F.lit("Doanh thu năm nay tăng 12,5 tỷ đồng."), unit, head("## BẢNG CÂN ĐỐI KẾ TOÁN", "## BALANCE SHEET"), columns, rule, *[item(i) for i in range(3)], F.lit("")),
        F.array(head("## BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH", "## INCOME STATEMENT"), columns, rule, *[item(i) for i in (3, 4)], F.lit("")),
        F.array(head("BÁO CÁO LƯU CHUYỂN TIỀN TỆ", "## STATEMENT OF CASH FLOWS"), columns, rule, _line("01", "Lợi nhuận kế toán trước thuế", "", "10", "9"), F.lit("")),
        F.array(F.lit("## 2.26 Các bên liên quan và giao dịch"), F.lit("Chính sách kế toán.")),
        rows("flow_rows", F.lit("## 39. Giao dịch với các bên liên quan"), _line("Bên liên quan", "Số tiền"), F.lit("| --- | ---: |")), F.array(F.lit("| Tổng cộng | 1 |"), F.lit("")),
        rows("own_rows", F.lit("## 5. Danh sách công ty con"), _line("STT", "Tên công ty", "Tỷ lệ sở hữu"), F.lit("|---|---|---|")), F.array(F.lit("")),
        rows("board_rows", F.lit("## Hội đồng quản trị"), _line("Họ và tên", "Chức vụ", "Số cổ phiếu"), F.lit("|---|---|---|")),
    )
    made = written(s.select("s_suppkey", F.array_join(text, "\n").alias("text")))
    # A task gets a bounded number of reports, so its windows' memory doesn't grow with the tables.
    return made.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + count // REPORTS), "s_suppkey")


def _facts_sql() -> str:
    parts = [
        f"SELECT s_suppkey, '{statement}' AS statement, '{kind}' AS kind, '{meaning}' AS meaning, '{period}' AS period, coalesce(a{k}_{y}, 0) * {_SCALE} AS value FROM supplier LEFT JOIN figures USING (s_suppkey)"
        for k, (_, _, _, statement, meaning, kind, _) in enumerate(ITEMS)
        for y, period in zip(YEARS, ("CURRENT_PERIOD", "PREVIOUS_PERIOD"), strict=True)
    ]
    return " UNION ALL ".join(parts)


@query("statement_facts", f"WITH {SQL_FIGURES} SELECT * FROM ({_facts_sql()})")
def statement_facts(spark: SparkSession, d: str) -> DataFrame:
    """Items of balance sheets and income statements by meaning and period, in single units."""
    return R.statement_facts(R.table_rows(reports(spark, d), "s_suppkey", "text"), "s_suppkey").drop("line")


_RELATION = lambda at: "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[at]}'" for k, v in RELATION.items()) + " END"
_PARTY = "'Công ty ' || t.s_name"


@query("related_party_frames", f"WITH {SQL_PARTIES} SELECT p.s_suppkey, {_PARTY} AS party, {_RELATION(0)} AS relation, {_RELATION(1)} AS flow, amount * {_SCALE.replace('s_suppkey', 'p.s_suppkey')} AS amount FROM parties p JOIN supplier t ON t.s_suppkey = p.target")
def related_party_frames(spark: SparkSession, d: str) -> DataFrame:
    """What a note about related parties says of each: relation, kind of flow, amount."""
    return R.related_party_frames(R.table_rows(reports(spark, d), "s_suppkey", "text"), "s_suppkey").drop("line")


@query("ownership_frames", f"WITH {SQL_RELATIONS}, {SQL_OWNED} SELECT o.s_suppkey, {_PARTY} AS company, 'OWNS' AS relation, share FROM owned o JOIN supplier t ON t.s_suppkey = o.target")
def ownership_frames(spark: SparkSession, d: str) -> DataFrame:
    return R.ownership_frames(R.table_rows(reports(spark, d), "s_suppkey", "text"), "s_suppkey").drop("line")


_BOARD = f"""board AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS s_suppkey, 'Nguyễn ' || translate(c_name, '#0123456789', ' abcdefghij') AS person,
  [{", ".join(f"'{r}'" for r in ROLE)}][c_nationkey % {len(ROLE)} + 1] AS role, floor(abs(c_acctbal)) AS shares FROM customer)"""


@query("governance_frames", f"WITH {_BOARD} SELECT * FROM board")
def governance_frames(spark: SparkSession, d: str) -> DataFrame:
    return R.governance_frames(R.table_rows(reports(spark, d), "s_suppkey", "text"), "s_suppkey").drop("line")


@query(
    "frame_graph",
    f"""WITH {SQL_PARTIES}, {SQL_OWNED}, {_BOARD}, e AS (SELECT s_suppkey, {_RELATION(0)} AS relation, target, amount * {_SCALE} AS amount FROM parties UNION ALL SELECT s_suppkey, 'OWNS', target, share FROM owned),
named AS (SELECT e.s_suppkey, relation, {_PARTY} AS other, amount FROM e JOIN supplier t ON t.s_suppkey = e.target UNION ALL SELECT s_suppkey, 'GOVERNED_BY', person, shares FROM board)
SELECT s_suppkey, relation, other, count(*) AS edges, round(sum(amount), 4) AS amount FROM named GROUP BY ALL""",
)
def frame_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph that all frames of a report make, parallel edges added up; every edge had its line of evidence."""
    edges = R.frame_edges(R.rows_of(written(R.blocks(reports(spark, d), "s_suppkey", "text")), "s_suppkey"), "s_suppkey")
    return edges.filter("line IS NOT NULL").groupBy("s_suppkey", "relation", "other").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("amount"), 4).alias("amount"))
