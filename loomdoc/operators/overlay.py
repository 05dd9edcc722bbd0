"""Overlay actions: ordered updates, removals and copies of the parts of JSON documents that a path points at.

An action sees what earlier ones did, so a document's actions fold over it in one task; documents are independent, so a table of them needs no shuffle. Paths are parsed
once, on the driver.
"""

from __future__ import annotations

import copy as copies
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.functions import merges
from loomdoc.functions.jsonpath import _PREDICATE, Segment, filter_literal, parse_json_path


class _UNSET:
    """No value. A class, which keeps its identity in tasks."""


@dataclass(frozen=True)
class Action:
    """``remove`` wins over ``copy`` and ``update``; ``copy`` is a path whose first match is the value to merge in."""

    target: str
    update: object = _UNSET
    remove: bool = False
    copy: str | None = None


class OverlayError(ValueError):
    pass


def resolve_actions(actions: Sequence[dict], reusable: dict[str, dict] | None = None) -> list[Action]:
    """Actions from records. ``{"$ref": "#/components/actions/NAME"}`` takes the fields of a reusable action; its own fields win. An unknown name is an error."""
    found = []
    for record in actions:
        fields = dict(record)
        if ref := fields.pop("$ref", None):
            name = ref.rsplit("/", 1)[-1]
            if name not in (reusable or {}):
                raise OverlayError(f"unknown reusable action: {ref}")
            fields = dict(reusable[name].get("fields", {})) | fields
        if "target" not in fields:
            raise OverlayError(f"an action without a target: {record}")
        found.append(Action(fields["target"], fields.get("update", _UNSET), fields.get("remove") is True, fields.get("copy")))
    return found


def _items(value) -> list[tuple]:
    return list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []


def _holds(value, predicate: str) -> bool:
    if predicate == "@":
        return value is not None
    found = _PREDICATE.fullmatch(predicate)
    if not found:
        return False
    name, op, raw = found[1] or found[2], found[3], found[4]
    literal, member = filter_literal(raw), value.get(name, _UNSET) if isinstance(value, dict) else _UNSET
    # true is not 1: kinds are compared before values
    kinds = [(type(x) is bool, isinstance(x, (int, float)), x is None) for x in (member, literal)]
    same = member is not _UNSET and kinds[0] == kinds[1] and member == literal
    return same if op == "==" else not same


def _step(segment: Segment, node: tuple) -> list[tuple]:
    """Nodes ``(parent, key, value)`` that one segment leads to."""
    value = node[2]
    inner = [(value, k, v) for k, v in _items(value)]
    if segment.kind == "child":
        return [n for n in inner if isinstance(value, dict) and n[1] == segment.value]
    if segment.kind == "wildcard":
        return inner
    if segment.kind == "filter":
        return [n for n in inner if _holds(n[2], segment.value)]
    if segment.kind == "descendant":
        found = []
        for n in inner:
            if segment.value is None or n[1] == segment.value:
                found.append(n)
            found += _step(segment, n)
        return found
    if not isinstance(value, list):
        return []
    if segment.kind == "slice":
        return inner[slice(*segment.value)]
    return inner[segment.value :][:1] if -len(inner) <= segment.value < len(inner) else []


def _find(root, path: list[Segment]) -> list[tuple]:
    nodes = [(None, None, root)]
    for segment in path:
        nodes = [n for node in nodes for n in _step(segment, node)]
    return nodes


def _removed(nodes: list[tuple]) -> None:
    """Take the nodes out of their parents; an array loses all its places at once."""
    lists: dict[int, tuple[list, set]] = {}
    for parent, key, _ in nodes:
        if isinstance(parent, list):
            lists.setdefault(id(parent), (parent, set()))[1].add(key)
        elif isinstance(parent, dict):
            parent.pop(key, None)
    for items, places in lists.values():
        items[:] = [v for i, v in enumerate(items) if i not in places]


def _act(root, action: Action, path: list[Segment], source: list[Segment] | None):
    nodes = _find(root, path)
    if action.remove:
        _removed(nodes)
        return root
    def put(parent, key, value):
        nonlocal root
        if parent is None:
            root = value
        else:
            parent[key] = value

    if source is not None:
        first = _find(root, source)[:1]
        if not first:
            raise OverlayError(f"nothing to copy at {action.copy}")
        for parent, key, _ in nodes:
            put(parent, key, copies.deepcopy(first[0][2]))
    if action.update is not _UNSET:
        for parent, key, matched in nodes:
            # an update merges into what was matched; only at the root does it see the copy
            put(parent, key, merges.patch(root if parent is None else matched, copies.deepcopy(action.update)))
    return root


def apply_overlay(docs: DataFrame, actions: Sequence[Action], doc_col: str = "doc", error_col: str | None = None) -> DataFrame:
    """``docs`` with the JSON text in ``doc_col`` changed by the actions in order: a copy replaces what the target matches, an update merges into it.

    Null and unreadable documents become null; a target that matches nothing changes nothing. A copy without a source is an error: with ``error_col`` the document stays as it is and the column says why (null: no
    error), without it the job fails.
    """
    plan = [(a, parse_json_path(a.target), parse_json_path(a.copy) if a.copy else None) for a in actions]

    @F.pandas_udf("doc string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out, errors = [], []
        for text in texts:
            known, root = merges.read(text)
            said = None
            try:
                for action, path, source in plan if known else ():
                    root = _act(root, action, path, source)
            except OverlayError as error:
                if error_col is None:
                    raise
                said = str(error)
            out.append(text if said else merges.write(root) if known else None)
            errors.append(said)
        return pd.DataFrame({"doc": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    made = docs.withColumn("__made", run(F.col(doc_col))).withColumn(doc_col, F.col("__made.doc"))
    return (made.withColumn(error_col, F.col("__made.error")) if error_col else made).drop("__made")


def overlay_union(overlays: Sequence[DataFrame]) -> DataFrame:
    """One table of actions from several; ``file`` is a table's place, so (file, seq) orders them."""
    every = None
    for i, overlay in enumerate(overlays):
        part = overlay.withColumn("file", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return every
