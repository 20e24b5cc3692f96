"""Training-data operators: near-duplicates, vector search, tokenizing, chat, quality, secrets, language, mixing.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` list what the
entry file registers.
"""

from __future__ import annotations


def queries() -> dict:
    from gleanframe.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from gleanframe.llm.registry import ORACLE_SQL

    return dict(ORACLE_SQL)
