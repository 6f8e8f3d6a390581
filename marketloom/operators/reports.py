"""Tables in report texts: lines, blocks of pipe rows, and the frames their rows fill.

A report's lines of text, and its runs of table rows, are rows with their number. What
holds for a run (its section, the unit last told, its block, the block's head) is carried
down by windows over the report, which share one shuffle; queries about some tables make
rows of these only. A row then fills a frame from its own
cells and from what is open: a statement's item and period, a counterparty with the
category's kind of flow, a company with its share, a person with a role. Each frame has
the number of the line that is its evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import taxonomy
from marketloom.functions import text as T

#: Kinds of flows in the order they are tried: words of which one must occur (groups joined by & must all), relation, kind, and kind in tables of balances.
FLOWS = (
    ("cho vay&thu hoi", "LENDS_TO", "loan_repayment", "loan_repayment"), ("cho vay", "LENDS_TO", "loan", "loan_balance"),
    ("lai vay|lai tien gui|thu lai|chi phi lai&phai tra", "TRANSACTS_WITH", "interest_payable", "interest_payable"), ("lai vay|lai tien gui|thu lai|chi phi lai&chi phi|tra lai", "TRANSACTS_WITH", "interest_expense", "interest_expense"),
    ("lai vay|lai tien gui|thu lai|chi phi lai", "TRANSACTS_WITH", "service_revenue", "service_revenue"), ("vay&tra no", "TRANSACTS_WITH", "loan_repayment", "loan_repayment"), ("vay", "TRANSACTS_WITH", "borrowing", "borrowing_balance"),
    ("bao lanh", "GUARANTEES_FOR", "guarantee", "guarantee"), ("dau tu|gop von|tang von|von gop", "INVESTS_IN", "capital_contribution", "capital_contribution"),
    ("von co phan|co phan cua ben lien quan", "TRANSACTS_WITH", "ownership_value", "ownership_value"), ("co tuc|loi nhuan", "TRANSACTS_WITH", "dividend", "dividend"),
    ("tien gui", "TRANSACTS_WITH", "cash_deposit_balance", "cash_deposit_balance"), ("phai thu", "TRANSACTS_WITH", "receivable", "receivable_balance"), ("phai tra", "TRANSACTS_WITH", "payable", "payable_balance"),
    ("mua hang|mua dich vu|chi phi|mua tai san|hang mua", "TRANSACTS_WITH", "purchase", "purchase"), ("doanh thu|ban hang|cung cap|tien thue", "TRANSACTS_WITH", "service_revenue", "service_revenue"),
    ("dat coc|tam ung|hop tac dau tu|hop tac kinh doanh|bcc|chuyen nhuong du an|mua co phan", "TRANSACTS_WITH", "deposit_or_investment_advance", "deposit_or_investment_advance"),
    ("thue van phong|thue nha|thue dat|thue hoat dong", "TRANSACTS_WITH", "operating_lease", "operating_lease"), ("", "TRANSACTS_WITH", "service_revenue", "receivable_balance"),
)
#: What a row that opens a category begins with, and words that make it a name instead.
CATEGORIES = "doanh thu|ban hang|cung cap|gia tri hang mua|mua hang|hang mua|phai thu|phai tra|cho vay|thu hoi|di vay|vay|tra no goc vay|tien gui|co tuc|loi nhuan|lai tien gui|chi phi|thu lai|so du|cac khoan cho vay|bao lanh"
NAMES = r"cong ty|tnhh|\bcp\b|jsc|corp|group|\bong\b|\bba\b|chi nhanh|ngan hang|\bquy\b|\bvien\b|\btruong\b"
#: Roles in the order they are tried.
ROLES = (
    ("chu tich hdqt|chu tich hoi dong|chairman", "CHAIRMAN"), ("pho chu tich", "VICE_CHAIRMAN"), ("doc lap|independent", "INDEPENDENT_BOD_MEMBER"), ("truong ban kiem soat|head of bos|truong bks", "CHIEF_SUPERVISOR"),
    ("kiem soat|bks|supervisor", "SUPERVISOR"), ("tong giam doc|ceo", "CEO"), ("thanh vien hdqt|tv hdqt|uy vien hdqt|member of bod", "BOD_MEMBER"), ("", "INSIDER"),
)
#: Titles of statements; a cash flow's lines look like an income statement's and are left out.
STATEMENTS = (("cash_flow", "luu chuyen tien|cash flow"), ("balance_sheet", "can doi ke toan|balance sheet|financial position|tinh hinh tai chinh"), ("income_statement", "ket qua (hoat dong )?kinh doanh|income statement|comprehensive income|profit or loss"))
SUBSIDIARIES = "phu luc 1|danh sach cong ty con|dau tu vao (cac )?cong ty con|dau tu vao cong ty lien ket|dau tu tai chinh dai han|von gop lien doanh"
ASSOCIATES = "dau tu vao cong ty lien ket|von gop lien doanh"
BOARDS = "thanh vien hdqt|hoi dong quan tri|board of directors|thanh vien bks|ban kiem soat|board of supervisors|nguoi noi bo|nguoi co lien quan|giao dich co phieu"


def _first(rules, of: Column, pick) -> Column:
    """The value of the first rule that fits."""
    out = None
    for words, *values in rules:
        fits = F.lit(True)
        for group in filter(None, words.split("&")):
            fits = fits & of.rlike(group)
        out = F.when(fits, pick(values)) if out is None else out.when(fits, pick(values))
    return out


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pipe tables of reports in runs of rows: key, block, what holds for them, head (folded), and rows (line and raw) below the head.

    A row begins with a pipe, or has two pipes at least (where the first was lost). What
    holds for rows is told by the lines between them, so a run of rows stays one value
    while windows carry that down, and only lines of text and runs are rows there.
    ``title`` is the report's first heading, ``section`` the last one, ``context`` that and
    the line before the table. Null texts have no line; rows of one key are one report, so
    keys should be unique.
    """
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    d = docs.select(key, F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)).alias("all")).filter("all IS NOT NULL")
    d = d.withColumn("is_row", F.transform("all", lambda x: x.startswith("|") | (pipes(x) >= 2)))
    # A row that looks like a heading changes what holds for those after it, within its block.
    d = d.withColumn("breaks", F.transform("all", lambda x, i: ~F.get("is_row", i) | x.startswith("#") | (i == 0) | ~F.get("is_row", F.greatest(i - 1, F.lit(0)))))
    places = F.filter(F.transform("breaks", lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    d = d.withColumn("at", F.array_append(places, F.size("all")))
    each = F.transform(F.slice("at", 1, F.size("at") - 1), lambda i, k: F.struct(
        (i + 1).alias("line"), F.get("all", i).alias("raw"), F.get("is_row", i).alias("row"), ((i > 0) & F.get("is_row", F.greatest(i - 1, F.lit(0)))).alias("after_row"),
        F.when(F.get("is_row", i), F.transform(F.slice("all", i + 1, F.get("at", k + 1) - i), lambda x, j: F.struct((i + j + 1).alias("line"), x.alias("raw")))).alias("rows"),
    ))
    lines = d.select(key, F.explode(each).alias("e")).select(key, "e.*")
    lines = lines.withColumn("folded", T.fold_letters(F.col("raw")))
    row = F.col("row")
    heading = F.col("raw").startswith("#")
    told = F.col("folded").rlike("don vi|dvt|unit|currency") & F.col("folded").rlike("vnd|dong") & ~row
    w = Window.partitionBy(key).orderBy("line")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    plain = ~row & (F.col("raw") != "")
    kind = _first([(p, n) for n, p in STATEMENTS], F.col("folded"), lambda v: F.lit(v[0]))
    number = F.regexp_extract("folded", r"^#{1,6}\s*(?:note\s*)?([0-9]+)", 1)
    related = heading & F.col("folded").rlike("ben lien quan|related part") & F.col("folded").rlike("nghiep vu|giao dich|so du|thuyet minh|danh sach|chi tiet|transactions|balances") & ~F.col("folded").rlike(r"^#{1,3}\s*[23]\.[0-9]+\s")
    lines = lines.withColumns({
        "block": F.sum((row & ~F.col("after_row")).cast("int")).over(w), "section": last(F.when(heading, F.col("folded"))), "title": F.first(F.when(heading, F.col("folded")), ignorenulls=True).over(w),
        "unit": F.coalesce(last(F.when(told, T.unit_scale(F.col("raw")))), F.lit(1.0)), "statement": last(F.when(heading, F.coalesce(kind, F.lit(""))).when(plain, kind)),
        "before": last(F.when(plain, F.col("folded"))), "heading": heading, "related": related, "number": F.when(heading & (number != ""), number),
    })
    # A note about related parties goes on below headings that speak of them, or have its number.
    lines = lines.withColumn("note", last(F.when(F.col("related"), F.col("number"))))
    goes_on = F.col("folded").rlike("ben lien quan|related part|giao dich|so du") | F.coalesce(F.col("number") == F.col("note"), F.lit(False))
    lines = lines.withColumn("in_note", F.coalesce(last(F.when(F.col("related"), True).when(F.col("heading") & ~goes_on, False)), F.lit(False)))
    runs = lines.filter("row").withColumn("rows", F.filter("rows", lambda r: ~r["raw"].rlike("^[|: -]*-[|: -]*$")))
    b = Window.partitionBy(key, "block").orderBy("line")
    runs = runs.withColumn("first", F.first(F.get("rows", F.lit(0)), ignorenulls=True).over(b))
    below = F.filter("rows", lambda r: r["line"] > F.col("first.line"))
    head = F.transform(_cells(F.col("first.raw")), T.fold_letters)
    return runs.select(key, "block", below.alias("rows"), head.alias("head"), "title", "section", "unit", "statement", "in_note", F.concat_ws(" ", "section", "before").alias("context"))


def _cells(raw: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(raw, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def rows_of(runs: DataFrame, key: str) -> DataFrame:
    """A row for each one of ``blocks``: also line (from 1), cells and folded cells."""
    each = runs.select("*", F.explode("rows").alias("r")).select("*", _cells(F.col("r.raw")).alias("cells"))
    return each.select(key, F.col("r.line").alias("line"), "block", "cells", F.transform("cells", T.fold_letters).alias("folded"), "head", "title", "section", "unit", "statement", "in_note", "context")


def table_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of all pipe tables below their heads: key, line (from 1), cells, folded cells, head (folded), title, section, unit, statement, block, context."""
    return rows_of(blocks(docs, key, text), key)


def _at(head: Column, fits) -> Column:
    """The place of the first column whose head fits; 0 without one."""
    return F.array_position(F.transform(head, lambda h: F.coalesce(fits(h), F.lit(False))), True)


def _cell(of: str, at: Column) -> Column:
    return F.when(at > 0, F.get(of, (at - 1).cast("int")))


def statement_facts(rows: DataFrame, key: str) -> DataFrame:
    """key, line, statement, kind, meaning, period and value (in single units) of the statements' items."""
    head = F.col("head")
    r = rows.filter("statement IN ('balance_sheet', 'income_statement') AND NOT in_note")
    code = lambda h: h.rlike("ma so|^code")
    note = lambda h: h.rlike("thuyet minh|^note")
    label = lambda h: ~code(h) & ~note(h) & taxonomy.period_of(h).isNull()
    at = {"code_at": _at(head, code), "label_at": _at(head, label), **{f"{n}_at": _at(head, lambda h, n=n: taxonomy.period_of(h) == n) for n in ("CURRENT_PERIOD", "PREVIOUS_PERIOD")}}
    r = r.withColumns(at).filter("label_at > 0")
    r = r.select(
        key, "line", "statement", "unit", _cell("folded", F.col("label_at")).alias("label"), _cell("cells", F.col("code_at")).alias("code"), F.coalesce("title", F.lit("")).rlike("ngan hang|bank").alias("bank"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("period"), _cell("cells", F.col(f"{n}_at")).alias("raw")) for n in ("CURRENT_PERIOD", "PREVIOUS_PERIOD")])).alias("p"),
    )
    r = r.withColumns({"amount": T.parse_number(F.col("p.raw")), "fact": taxonomy.classified(F.col("label"), F.col("code"), F.col("bank"))})
    r = r.filter("amount IS NOT NULL AND fact.meaning IS NOT NULL")
    return r.select(key, "line", "statement", "fact.kind", "fact.meaning", "p.period", (F.col("amount") * F.col("unit")).alias("value"))


def related_party_frames(rows: DataFrame, key: str) -> DataFrame:
    """key, line, party, relation, flow and amount of related parties' rows; the category is the row that opened it, or the section."""
    label = F.trim(F.get("folded", F.lit(0)))
    amounts = F.filter(F.transform(F.slice("cells", 2, 1000), T.parse_number), lambda x: x.isNotNull())
    r = rows.filter("in_note").withColumns({"label": label, "amount": F.get(amounts, F.lit(0))})
    opens = F.col("label").rlike(f"^({CATEGORIES})") & ~F.col("label").rlike(NAMES)
    w = Window.partitionBy(key, "block").orderBy("line")
    # The window sorts rows, so they are narrow.
    r = r.select(key, "block", "line", "label", "amount", "section", "unit", F.get("cells", F.lit(0)).alias("party"), F.coalesce(F.get("head", F.lit(0)).rlike("ben lien quan|ten|cong ty|party|name"), F.lit(False)).alias("explicit"), opens.alias("opens"))
    r = r.withColumn("open", F.last(F.when(F.col("opens"), F.col("label")), ignorenulls=True).over(w))
    party = (F.col("label") != "") & ~F.col("label").rlike(r"^[0-9\s./()%:-]+$") & ~F.col("label").rlike("^(tong|cong|total):?$|^tong (cong|so)")
    r = r.filter(~F.col("opens") & party & F.col("amount").isNotNull() & (F.col("explicit") & (F.length("label") >= 3) | F.col("label").rlike(NAMES)))
    about, balance = F.coalesce("open", "section"), F.coalesce(F.col("section"), F.lit("")).rlike("so du|balance")
    flow = F.when(balance, _first(FLOWS, about, lambda v: F.lit(v[2]))).otherwise(_first(FLOWS, about, lambda v: F.lit(v[1])))
    return r.select(key, "line", "party", _first(FLOWS, about, lambda v: F.lit(v[0])).alias("relation"), flow.alias("flow"), (F.col("amount") * F.col("unit")).alias("amount"))


def percentage(raw: Column) -> Column:
    """A share of a hundred: the last dot or comma parts decimals; null beyond 0 to 100."""
    x = F.regexp_replace(F.trim(raw), r"[%\s]", "")
    value = F.regexp_replace(F.regexp_replace(x, r"[.,](?=.*[.,])", ""), ",", ".").try_cast("double")
    return F.when(value.between(0, 100), value)


def ownership_frames(rows: DataFrame, key: str) -> DataFrame:
    """key, line, company, relation (OWNS, or INVESTS_IN for associates) and share of tables about subsidiaries."""
    r = rows.filter(F.col("context").rlike(SUBSIDIARIES))
    head = F.col("head")
    r = r.withColumns({"name_at": _at(head, lambda h: h.rlike("ten cong ty|cong ty|don vi|company")), "share_at": _at(head, lambda h: h.rlike("ty le|% so huu|ownership") & ~h.rlike("bieu quyet|voting"))})
    r = r.withColumns({"company": _cell("cells", F.col("name_at")), "label": _cell("folded", F.col("name_at")), "share": percentage(_cell("cells", F.col("share_at")))})
    named = (F.length("company") >= 3) & F.col("label").rlike("[a-z]") & ~F.col("label").rlike("^(ong|ba|mr|ms) |tong cong|du phong|tai san|gia tri|loi nhuan|doanh thu|chi phi")
    relation = F.when(F.col("context").rlike(ASSOCIATES), "INVESTS_IN").otherwise("OWNS")
    return r.filter(named & F.col("share").isNotNull()).select(key, "line", "company", relation.alias("relation"), "share")


def person(raw: Column) -> Column:
    """A name without its number, its translation and its title."""
    bare = F.regexp_replace(raw, r"^\s*([0-9ivxIVXa-zA-Z]+[).]|-)\s*", "")
    return F.trim(F.get(F.split(F.get(F.split(bare, "/"), F.lit(0)), r"(?i)\b(?:mr|ms|mrs|miss)\.?\s+"), F.lit(0)))


def governance_frames(rows: DataFrame, key: str) -> DataFrame:
    """key, line, person, role and shares of tables about boards and insiders."""
    head = F.col("head")
    about = F.concat_ws(" ", "context", F.array_join("head", " "))
    r = rows.filter(about.rlike(BOARDS))
    name = lambda h: h.rlike("ho (va )?ten|name|thanh vien")
    r = r.withColumns({"name_at": _at(head, name), "role_at": _at(head, lambda h: h.rlike("chuc vu|position") & ~name(h)), "shares_at": _at(head, lambda h: h.rlike("so co phieu|shares|so cp"))})
    r = r.filter("name_at > 0").withColumns({"person": person(_cell("cells", F.col("name_at"))), "role": F.coalesce(_cell("folded", F.col("role_at")), F.lit("")), "shares": T.parse_number(_cell("cells", F.col("shares_at")))})
    folded = T.fold_letters(F.col("person"))
    real = folded.rlike("[a-z]") & ~folded.rlike(r"cong ty|joint stock|\bjsc\b|\bllc\b|\bltd\b|group") & ~folded.isin("tong giam doc", "ke toan truong", "khong co", "none", "n a")
    return r.filter(real).select(key, "line", "person", _first(ROLES, F.col("role"), lambda v: F.lit(v[0])).alias("role"), "shares")


def frame_edges(rows: DataFrame, key: str) -> DataFrame:
    """key, line, relation, other, detail and amount: the edges that all frames give, from the report's issuer to the other side."""
    none = F.lit(None).cast("string")
    flows = related_party_frames(rows, key).select(key, "line", "relation", F.col("party").alias("other"), F.col("flow").alias("detail"), "amount")
    owned = ownership_frames(rows, key).select(key, "line", "relation", F.col("company").alias("other"), none.alias("detail"), F.col("share").alias("amount"))
    people = governance_frames(rows, key).select(key, "line", F.lit("GOVERNED_BY").alias("relation"), F.col("person").alias("other"), F.col("role").alias("detail"), F.col("shares").alias("amount"))
    return flows.unionByName(owned).unionByName(people)
