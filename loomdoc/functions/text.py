"""Text, path and HTTP functions as Column expressions. Null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The methods in their rank.
METHODS = ("get", "post", "put", "patch", "delete", "options", "head", "trace", "query")


def capitalize(s: Column) -> Column:
    """First character upper, the rest as it is."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def first_name(primary: Column, fallback: Column) -> Column:
    """The first of two that isn't blank, trimmed."""
    return F.coalesce(F.nullif(F.trim(primary), F.lit("")), F.nullif(F.trim(fallback), F.lit("")))


def path_parameters(path: Column) -> Column:
    """What stands in braces, in order."""
    return F.regexp_extract_all(path, F.lit(r"\{([^}]+)\}"), F.lit(1))


def operation_id(path: Column, method: Column) -> Column:
    """The method, a hyphen, and the path with hyphens for slashes, less one at its begin."""
    return F.concat(method, F.lit("-"), F.regexp_replace(F.translate(path, "/", "-"), "^-", ""))


def escape_regex(s: Column) -> Column:
    """Metacharacters escaped."""
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def camel_case(s: Column) -> Column:
    """Words of letters and digits, the first lower, the others capitalised; ``query`` if there is none."""
    words = F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda w: w != "")
    parts = F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    return F.when(F.size(words) == 0, "query").otherwise(F.array_join(parts, ""))


def call_path(path: Column) -> Column:
    """``:id`` and ``:id?`` as ``{id}``, one slash between parts and in front, none at the end."""
    braces = F.regexp_replace(path, r":([A-Za-z_]\w*)\??", r"{$1}")
    parts = F.filter(F.split(braces, "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def join_paths(*parts: Column) -> Column:
    """Parts joined as one call path; nulls are left out."""
    return call_path(F.concat_ws("/", *parts))


def file_route(path: Column) -> Column:
    """The route of a file: bracketed names in braces, groups and slots left out, ``/`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.(tsx?|jsx?|mjs)$", ""), r"/(route|index)$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"/\([^)/]+\)", ""), r"/@[^/]+", "")
    bare = F.regexp_replace(bare, r"\[{1,2}(?:\.\.\.)?([^\]]+)\]{1,2}", r"{$1}")
    return F.when(bare == "", "/").otherwise(bare)


def http_method(value: Column) -> Column:
    """Upper-cased if it is a method, else null."""
    return F.when(F.lower(value).isin(*METHODS), F.upper(value))


def method_rank(method: Column) -> Column:
    """Place in the fixed order; unknown methods last."""
    rank = F.lit(len(METHODS))
    for i, name in enumerate(METHODS):
        rank = F.when(F.lower(method) == name, i).otherwise(rank)
    return rank


def default_success_code(method: Column) -> Column:
    return F.when(F.upper(method) == "POST", "201").when(F.upper(method) == "DELETE", "204").otherwise("200")


def guess_status(code: Column, keywords: Mapping[str, int], other: int = 500) -> Column:
    """A leading number from 100 to 599, else the status of the first keyword that the lower-cased code holds, else ``other``."""
    found = F.lit(other)
    for word, status in reversed(list(keywords.items())):
        found = F.when(F.lower(code).contains(word), status).otherwise(found)
    number = F.regexp_extract(code, r"^\s*(\d{1,9})", 1).try_cast("int")
    return F.when(number.between(100, 599), number).otherwise(found)


def fill_template(template: Column, variables: Column) -> Column:
    """Every ``{{KEY}}`` replaced by the map's value."""
    return F.aggregate(F.map_entries(variables), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def glob_matches(path: Column, glob: str) -> Column:
    """``*`` stands for anything but slashes, ``**`` for anything, ``?`` for one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or ("\\" + glob[i] if glob[i] in r".+^${}()|[]\\" else glob[i]))
        i += 1
    return path.rlike("^" + "".join(out) + "$")
