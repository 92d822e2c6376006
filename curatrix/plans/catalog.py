"""All queries of the core with their SQL."""

from __future__ import annotations

from curatrix.plans import q_eval, q_io, q_records, q_text

_ALL = q_text.Q | q_records.Q | q_eval.Q | q_io.Q


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
