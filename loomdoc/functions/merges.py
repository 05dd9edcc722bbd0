"""The four merges of JSON documents, as Columns over JSON text. They differ on purpose.

=========  ==================  ==================  ============
merge      arrays              records             null
=========  ==================  ==================  ============
fragment   concatenated        recursive           replaces
override   replaced            recursive           replaces
patch      replaced            recursive           removes key
shallow    replaced            replaced by key     replaces
=========  ==================  ==================  ============

Flat maps need none of these: ``map_concat`` with ``mapKeyDedupPolicy=LAST_WIN`` is the shallow merge. Trees of unknown depth go through Arrow batches, one small
recursive step for each pair. A null or unreadable side leaves the other as it is; two of them give null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Json = object


def fragment(base: Json, more: Json) -> Json:
    """Arrays are joined, records merge key by key, anything else is replaced."""
    if isinstance(base, list) and isinstance(more, list):
        return base + more
    if isinstance(base, dict) and isinstance(more, dict):
        return base | {k: fragment(base[k], v) if k in base else v for k, v in more.items()}
    return more


def override(base: Json, more: Json) -> Json:
    """Records merge key by key, anything else (arrays too) is replaced."""
    if isinstance(base, dict) and isinstance(more, dict):
        return base | {k: override(base.get(k), v) for k, v in more.items()}
    return more


def patch(base: Json, more: Json) -> Json:
    """Like ``override``, but a null removes its key. Nulls inside a record that is new as a whole stay."""
    if not (isinstance(base, dict) and isinstance(more, dict)):
        return more
    merged = base | {k: patch(base.get(k), v) for k, v in more.items()}
    return {k: v for k, v in merged.items() if k not in more or more[k] is not None}


def shallow(base: Json, more: Json) -> Json:
    """The later record's keys win whole."""
    return base | more if isinstance(base, dict) and isinstance(more, dict) else more


KINDS: dict[str, Callable[[Json, Json], Json]] = {"fragment": fragment, "override": override, "patch": patch, "shallow": shallow}


def _refuse(name: str) -> Json:
    raise ValueError(name)


def read(text: str | None) -> tuple[bool, Json]:
    """Whether ``text`` is JSON, and its value; ``NaN`` and ``Infinity`` are no JSON."""
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except (TypeError, ValueError):
        return False, None


def write(value: Json) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def merged(base: Column, more: Column, kind: str) -> Column:
    """JSON text of ``base`` merged with ``more``; ``kind`` is one of ``KINDS``."""
    step = KINDS[kind]

    @F.pandas_udf("string")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            (has_x, a), (has_y, b) = read(x), read(y)
            out.append(write(step(a, b)) if has_x and has_y else x if has_x else y if has_y else None)
        return pd.Series(out, dtype=object)

    return run(base, more)
