"""Registry of queries and of the SQL that must return the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "market_board_daily"


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers ``fn(spark, sf_dir)`` under ``name`` together with its oracle.

    Columns named in ``dates`` are given as text, on both sides alike.
    """

    def put(fn):
        def run(spark, sf_dir):
            out = fn(spark, sf_dir)
            return out.withColumns({c: out[c].cast("string") for c in dates}) if dates else out

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if dates else sql
        return fn

    return put


def _register() -> None:
    from marketloom.plans import candles, charts, documents, entities, factors, forensics, indicators, panel, ranker, regimes, relational, relations, reports, research, risk, rules, shapes, spaces, surface, trading  # noqa: F401


_register()
