"""Other query languages, translated to statements of the native one."""

from __future__ import annotations

from ..plans.ast import Statement
from ..plans.parser import QueryError


def translate(dialect: str, program: str) -> list[Statement]:
    if dialect == "cwb":
        from .cwb import translate as run
    elif dialect == "tiger":
        from .tiger import translate as run
    elif dialect == "pmltq":
        from .pmltq import translate as run
    else:
        raise QueryError(f"unknown dialect {dialect}")
    return run(program)
