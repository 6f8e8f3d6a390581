"""What items of financial statements mean: codes, terms, and an automaton over all terms.

A label is classified by its code where the issuer isn't a bank, else by the first rule
all of whose terms it holds. All terms of all rules are found in one pass over a label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard account codes, their kind and meaning.
CODES = {
    "110": ("OTHER", "cash_and_equivalents"), "130": ("RECEIVABLE_BALANCE", "total_receivables"), "210": ("RECEIVABLE_BALANCE", "long_term_receivables"), "270": ("OTHER", "total_assets"),
    "300": ("PAYABLE_BALANCE", "total_payables"), "310": ("PAYABLE_BALANCE", "short_term_payables"), "330": ("PAYABLE_BALANCE", "long_term_payables"), "400": ("EQUITY", "total_equity"),
    "410": ("EQUITY", "total_equity"), "411": ("EQUITY", "contributed_capital"), "412": ("EQUITY", "share_premium"), "420": ("EQUITY", "other_equity_reserves"), "421": ("EQUITY", "retained_earnings"),
    "01": ("REVENUE", "revenue"), "10": ("REVENUE", "revenue"), "11": ("OTHER", "cost_of_goods_sold"), "20": ("PROFIT", "gross_profit"), "21": ("REVENUE", "financial_income"),
    "22": ("REVENUE", "financial_income"), "23": ("OTHER", "borrowing_cost"), "50": ("PROFIT", "profit_before_tax"), "60": ("PROFIT", "profit"),
}
#: Terms of banks' statements (joined by +, all must occur), kind and meaning; the first that fits counts.
BANK_TERMS = (
    ("tong no phai tra va von chu so huu", "OTHER", "total_resources"), ("tong von chu so huu", "EQUITY", "total_equity"), ("von chu so huu+tong cong", "EQUITY", "total_equity"), ("von chu so huu", "EQUITY", "total_equity"),
    ("tong cong tai san", "OTHER", "total_assets"), ("tong tai san co", "OTHER", "total_assets"), ("tong no phai tra", "PAYABLE_BALANCE", "total_payables"), ("tien mat, vang bac", "OTHER", "cash_and_equivalents"),
    ("tien gui tai ngan hang nha nuoc", "OTHER", "cash_and_equivalents"), ("tien mat+tien gui", "OTHER", "cash_and_equivalents"), ("cho vay khach hang", "RECEIVABLE_BALANCE", "total_receivables"),
    ("cac khoan phai thu", "RECEIVABLE_BALANCE", "total_receivables"), ("thu nhap lai thuan", "REVENUE", "revenue"), ("thu nhap thuan tu hoat dong", "REVENUE", "revenue"), ("chi phi lai", "OTHER", "cost_of_goods_sold"),
    ("loi nhuan truoc thue", "PROFIT", "profit_before_tax"), ("loi nhuan sau thue", "PROFIT", "profit"), ("bao lanh", "OTHER", "bank_commitments"),
)
#: The same of other companies.
TERMS = (
    ("total assets", "OTHER", "total_assets"), ("total liabilities", "PAYABLE_BALANCE", "total_payables"), ("total equity", "EQUITY", "total_equity"), ("revenue", "REVENUE", "revenue"), ("net revenue", "REVENUE", "revenue"),
    ("cost of goods sold", "OTHER", "cost_of_goods_sold"), ("gross profit", "PROFIT", "gross_profit"), ("profit before tax", "PROFIT", "profit_before_tax"), ("profit after tax", "PROFIT", "profit"), ("net profit", "PROFIT", "profit"),
    ("cash and cash equivalents", "OTHER", "cash_and_equivalents"), ("trade receivables", "RECEIVABLE_BALANCE", "total_receivables"), ("trade payables", "PAYABLE_BALANCE", "total_payables"), ("bao lanh", "GUARANTEE_BALANCE", "guarantee_balance"),
    ("tong cong tai san", "OTHER", "total_assets"), ("tong tai san", "OTHER", "total_assets"), ("tong von chu so huu", "EQUITY", "total_equity"), ("von chu so huu", "EQUITY", "total_equity"),
    ("tien va cac khoan tuong duong tien", "OTHER", "cash_and_equivalents"), ("phai thu ngan han+tong", "RECEIVABLE_BALANCE", "total_receivables"), ("cac khoan phai thu", "RECEIVABLE_BALANCE", "total_receivables"),
    ("tong cong no phai tra", "PAYABLE_BALANCE", "total_payables"), ("no phai tra", "PAYABLE_BALANCE", "total_payables"), ("doanh thu thuan", "REVENUE", "revenue"), ("doanh thu ban hang", "REVENUE", "revenue"),
    ("gia von", "OTHER", "cost_of_goods_sold"), ("doanh thu hoat dong tai chinh", "REVENUE", "financial_income"), ("chi phi tai chinh", "OTHER", "borrowing_cost"), ("chi phi lai vay", "OTHER", "borrowing_cost"),
    ("loi nhuan sau thue", "PROFIT", "profit"), ("loi nhuan thuan", "PROFIT", "profit"),
)
#: Words of column heads for the period told, and for the one before.
CURRENT = ("cuoi ky", "cuoi nam", "so cuoi", "ky nay", "nam nay", "current")
PREVIOUS = ("dau ky", "dau nam", "so dau", "ky truoc", "nam truoc", "previous")

Rule = tuple[tuple[str, ...], str, str]


def rules(bank: bool) -> list[Rule]:
    """Rules in the order they are tried; a bank's fall back to the others."""
    told = [*BANK_TERMS, *TERMS] if bank else [*TERMS]
    return [(tuple(terms.split("+")), kind, meaning) for terms, kind, meaning in told]


class Terms:
    """All terms of some rules in one automaton."""

    def __init__(self, told: Sequence[Rule]):
        self.rules = list(told)
        self.automaton = ahocorasick.Automaton()
        for term in {t for terms, _, _ in self.rules for t in terms}:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()
        # The rules that a term takes part in, so that only they are looked at.
        self.of: dict[str, list[int]] = {}
        for k, (terms, _, _) in enumerate(self.rules):
            for t in terms:
                self.of.setdefault(t, []).append(k)

    def find(self, folded: str) -> tuple[str, str] | None:
        """The first rule whose terms all occur."""
        held = {term for _, term in self.automaton.iter(folded)}
        for k in sorted({k for t in held for k in self.of[t]}):
            terms, kind, meaning = self.rules[k]
            if held.issuperset(terms):
                return kind, meaning
        return None


@cache
def _terms(bank: bool) -> Terms:
    return Terms(rules(bank))


def meaning(folded: str, code: str, bank: bool) -> tuple[str, str] | None:
    """Kind and meaning of a folded label, with its code if it has one."""
    if not bank and code in CODES and (code != "270" or ("tong" in folded and "tai san" in folded)):
        return CODES[code]
    if "bao lanh" in folded and "thu phi" in folded:
        return None
    return _terms(bank).find(folded)


def classified(label: Column, code: Column, bank: Column) -> Column:
    """A struct of kind and meaning; both null where nothing fits. Nulls count as empty."""

    @F.pandas_udf("kind string, meaning string")
    def tell(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for labels, codes, banks in parts:
            found = [meaning(f or "", (c or "").strip(), bool(b)) or (None, None) for f, c, b in zip(labels, codes, banks, strict=True)]
            yield pd.DataFrame(found, columns=["kind", "meaning"], dtype=object)

    return tell(label, code, bank)


def period_of(folded: Column) -> Column:
    """CURRENT_PERIOD or PREVIOUS_PERIOD by a folded column head: its words, else an end or a beginning of a quarter; else null."""
    any_of = lambda words: folded.rlike("|".join(words))
    ends, begins = r"\b(3[01]|30)\s*([/.]|thang)\s*(12|0?6|0?9|0?3)\b", r"\b0?1\s*([/.]|thang)\s*0?1\b"
    return F.when(any_of(CURRENT), "CURRENT_PERIOD").when(any_of(PREVIOUS), "PREVIOUS_PERIOD").when(folded.rlike(ends), "CURRENT_PERIOD").when(folded.rlike(begins), "PREVIOUS_PERIOD")
