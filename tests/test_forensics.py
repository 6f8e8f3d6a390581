"""The eight indices and the score written out for one symbol."""

from __future__ import annotations

import pytest

from marketloom.plans import catalog, forensics
from marketloom.sources.tables import load, stocks


def test_indices_of_one_symbol_written_out(spark, small):
    symbol, quarters = 3, {}
    for r in load(spark, small, "lineitem").filter(f"l_suppkey = {symbol}").collect():
        ship = r["l_shipdate"]
        quarters.setdefault((ship.year, (ship.month - 1) // 3), []).append((r["l_extendedprice"], r["l_quantity"], r["l_discount"], r["l_tax"]))
    sums = {}
    for k, lines in quarters.items():
        total = lambda fn: sum(fn(*x) for x in lines)  # noqa: B023, E731
        sums[k] = {
            "rev": total(lambda e, q, d, t: e), "rec": total(lambda e, q, d, t: e * t), "cost": total(lambda e, q, d, t: e * (0.5 + d)), "ca": total(lambda e, q, d, t: e * (0.4 + t)), "ppe": total(lambda e, q, d, t: e * (0.2 + d)),
            "ta": total(lambda e, q, d, t: e) * 1.2 + 1000, "dep": total(lambda e, q, d, t: q * 20), "sga": total(lambda e, q, d, t: q * (30 + 100 * d)), "debt": total(lambda e, q, d, t: e * (d + 0.3)),
            "ni": total(lambda e, q, d, t: e * (d - 0.03)), "cfo": total(lambda e, q, d, t: e * (t - 0.02)),
        }
    order = sorted(sums)
    got = sorted((r for r in catalog.QUERIES["beneish_eight"](spark, small).collect() if r["symbol"] == symbol), key=lambda r: str(r["period"]))
    assert len(got) == len(order) > 8
    for n, (k, r) in enumerate(zip(order, got, strict=True)):
        if n < 4:
            assert r["dsri"] is None and r["model"] == "none" and r["status"] == "UNKNOWN"
            continue
        a, b = sums[k], sums[order[n - 4]]
        margin, soft, worn = (lambda x: (x["rev"] - x["cost"]) / x["rev"]), (lambda x: 1 - (x["ca"] + x["ppe"]) / x["ta"]), (lambda x: x["dep"] / (x["dep"] + x["ppe"]))
        want = {
            "dsri": (a["rec"] / a["rev"]) / (b["rec"] / b["rev"]), "gmi": margin(b) / margin(a), "aqi": soft(a) / soft(b), "sgi": a["rev"] / b["rev"], "depi": worn(b) / worn(a),
            "sgai": (a["sga"] / a["rev"]) / (b["sga"] / b["rev"]), "lvgi": (a["debt"] / a["ta"]) / (b["debt"] / b["ta"]), "tata": (a["ni"] - a["cfo"]) / a["ta"],
        }
        assert {c: r[c] for c in want} == {c: pytest.approx(v, abs=2e-5, rel=1e-5) for c, v in want.items()}
        kept = {c: v if c == "tata" else min(10, max(0.1, v)) for c, v in want.items()}
        score = -4.84 + sum(forensics.EIGHT[c] * v for c, v in kept.items())
        assert r["model"] == "8-variable" and r["score"] == pytest.approx(score, abs=1e-3) and r["status"] == ("FAIL" if score > -1.78 else "PASS")


def test_some_sectors_are_exempt(spark, medium):
    sectors = {r["symbol"]: r["sector"] for r in stocks(spark, medium).collect()}
    got = catalog.QUERIES["beneish_eight"](spark, medium).collect()
    exempt = {r["symbol"] for r in got if r["model"] == "exempt"}
    assert exempt == {s for s in {r["symbol"] for r in got} if sectors[s] in forensics.EXEMPT} and exempt
    assert all(r["status"] == "PASS" and r["score"] is None for r in got if r["model"] == "exempt")
