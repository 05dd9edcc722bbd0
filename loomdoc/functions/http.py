"""Media types, examples, names, errors and document references as Columns. Null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.annotations import bound, strip

#: Error texts by status, keywords of error codes in their order.
ERROR_TEXTS = {"400": "Bad Request", "401": "Unauthorized", "403": "Forbidden", "404": "Not Found", "409": "Conflict", "422": "Unprocessable Entity", "429": "Too Many Requests", "500": "Internal Server Error"}
STATUS_KEYWORDS = {
    "bad": 400, "invalid": 400, "validation": 422, "unauthorized": 401, "auth": 401, "forbidden": 403, "permission": 403, "not_found": 404, "missing": 404, "conflict": 409, "duplicate": 409,
    "rate_limit": 429, "too_many": 429, "server": 500, "internal": 500,
}

#: Examples by parameter name and by type, names of frameworks and their aliases.
NAMED_EXAMPLES = {"slug": "slug", "username": "johndoe", "email": "user@example.com", "name": "name", "date": "2023-01-01", "page": "1", "role": "admin"}
FRAMEWORKS = {
    "next": "nextjs", "nextjs": "nextjs", "tanstack": "tanstack", "react-router": "react-router", "reactrouter": "react-router", "remix": "remix", "sveltekit": "sveltekit", "nuxt": "nuxt",
    "astro": "astro", "hono": "hono", "express": "express",
}


def _map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _has(s: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in parts])


def error_text(code: Column) -> Column:
    """The usual text of a status, else ``HTTP`` and the code."""
    return F.coalesce(F.try_element_at(_map(ERROR_TEXTS), code), F.concat(F.lit("HTTP "), code))


def content_type(body_type: Column, explicit: Column) -> Column:
    """The given media type, else a multipart form for types with such a name, else JSON; never null."""
    multipart = F.coalesce(_has(F.lower(body_type), "formdata", "fileupload", "multipart"), F.lit(False))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(multipart, "multipart/form-data").otherwise("application/json"))


def parameter_example(name: Column, kind: Column, enum: Column | None = None, format_: Column | None = None) -> Column:
    """An example as text: the first of the allowed values, else one for uuids, ids, known names, or the type."""
    low = F.lower(name)
    is_uuid = F.contains(low, F.lit("uuid")) if format_ is None else (F.coalesce(format_, F.lit("")) == "uuid") | F.contains(low, F.lit("uuid"))
    is_id = (name == "id") | name.endswith("Id") | name.endswith("_id")
    by_type = F.when(kind.isin("number", "integer"), "1").when(kind == "boolean", "true").otherwise("example")
    guess = F.when(is_uuid, "123e4567-e89b-12d3-a456-426614174000").when(is_id, "123").otherwise(F.coalesce(F.try_element_at(_map(NAMED_EXAMPLES), low), by_type))
    return guess if enum is None else F.coalesce(F.get(enum, F.lit(0)), guess)


def path_example(name: Column) -> Column:
    """The example that a finished document gets for a path parameter without one."""
    return F.when((name == "id") | name.endswith("Id"), "123").when(name == "slug", "example-slug").otherwise("example")


def file_method(path: Column) -> Column:
    """The method that ends a file's name (``users.get.ts``), upper case; null if none does."""
    found = F.regexp_extract(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.(t|j)sx?$", ""), r"(?i)\.(get|post|put|patch|delete|options|head|trace|query)$", 1)
    return F.nullif(F.upper(found), F.lit(""))


def server_url(api_dir: Column, kind: Column, router: Column) -> Column:
    """What follows the last route root of an API folder, with a slash; empty if nothing does or for other frameworks."""
    path = F.regexp_replace(F.regexp_replace(F.translate(api_dir, "\\", "/"), r"^\./", ""), "/$", "")
    app, pages = F.regexp_extract(path, r"^.*/app/(.*)$", 1), F.regexp_extract(path, r"^.*/pages/(.*)$", 1)
    rest = F.when(router == "pages", pages).otherwise(app)
    return F.when((F.coalesce(kind, F.lit("nextjs")) == "nextjs") & (rest != ""), F.concat(F.lit("/"), rest)).otherwise("")


def document_version(version: Column) -> Column:
    """The supported version that a version text means; later releases come to 3.2, anything else and null to 3.0."""
    out = F.when(version.startswith("3.2"), "3.2").when(version.startswith("3.1"), "3.1").when(version.startswith("3.0"), "3.0").when(version.rlike(r"^3\.3(\.0)?-preview"), "3.3-preview")
    return out.when(version.startswith("3.3") | version.startswith("4."), "3.2").otherwise("3.0")


def framework(kind: Column) -> Column:
    """The framework that a name or alias means, null is the default one; other names give null (``unknown_frameworks`` finds them)."""
    return F.when(kind.isNull(), "nextjs").otherwise(F.try_element_at(_map(FRAMEWORKS), kind))


def document_format(path: Column) -> Column:
    """``yaml`` by the file's extension, else ``json``."""
    return F.when(F.lower(path).rlike(r"\.ya?ml$"), "yaml").otherwise("json")


def document_self(explicit: Column, path: Column) -> Column:
    """The given URI, else the file's URL."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.concat(F.lit("file://"), path))


def relative_uri(base: Column, path: Column) -> Column:
    """The way from a file's folder to another file, both absolute and without dots: ``./`` or as many ``../`` as needed."""
    a, b = F.filter(F.split(F.regexp_replace(base, "/[^/]*$", ""), "/"), lambda x: x != ""), F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.sequence(F.lit(0), F.least(F.size(a), F.size(b) - 1))
    same = F.array_max(F.filter(steps, lambda k: F.slice(a, 1, k) == F.slice(b, 1, k)))
    up = F.repeat(F.lit("../"), F.size(a) - same)
    return F.concat(F.when(up == "", "./").otherwise(up), F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def inside(root: Column, path: Column) -> Column:
    """Whether a path is the root or lies in it."""
    bare = F.regexp_replace(root, "/+$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def pointer_token(token: Column) -> Column:
    """A JSON pointer's token without its escapes."""
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def action_name(ref: Column) -> Column:
    """The reusable action that a pointer within the document names; null for any other reference."""
    return F.nullif(pointer_token(F.regexp_extract(ref, r"^#/components/actions/([^/]+)$", 1)), F.lit(""))


def detected_format(doc: Column) -> Column:
    """``openapi``, ``asyncapi`` or ``arazzo``, by the first of these keys with a string; else null. ``doc`` is VARIANT."""
    is_text = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")) == "STRING", F.lit(False))
    return F.when(is_text("openapi"), "openapi").when(is_text("asyncapi"), "asyncapi").when(is_text("arazzo"), "arazzo")


def format_matches(doc: Column, wanted: Column) -> Column:
    """Whether a document has the wanted format; undetected documents and no wish match."""
    found = detected_format(doc)
    return wanted.isNull() | found.isNull() | (found == wanted)


def generic_arguments(s: Column) -> Column:
    """``(base, arguments)`` of ``Base<A, B<C>>``: arguments between commas outside inner brackets; null for other text."""
    pattern = r"^([^<]+)<(.+)>$"
    return F.when(s.rlike(pattern), F.struct(strip(F.regexp_extract(s, pattern, 1)).alias("base"), split_arguments(strip(F.regexp_extract(s, pattern, 2))).alias("arguments")))


def split_arguments(s: Column) -> Column:
    """Parts between commas outside angle brackets, trimmed; an empty last part is left out."""
    depth = lambda x: F.length(F.regexp_replace(x, "[^<]", "")) - F.length(F.regexp_replace(x, "[^>]", ""))
    # a part begins a new argument if the brackets before it are closed
    before = lambda depths: F.transform(depths, lambda x, i: F.aggregate(F.slice(depths, 1, i), F.lit(0), lambda n, y: n + y))

    def joined(parts: Column, starts: Column) -> Column:
        ends = F.transform(starts, lambda x, k: F.coalesce(F.get(starts, k + 1), F.size(parts)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: strip(F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), ",")))

    def cut(parts: Column) -> Column:
        open_ = bound(F.transform(parts, depth), before)
        starts = bound(open_, lambda found: F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(found, i) == 0))
        return bound(starts, lambda found: bound(joined(parts, found), lambda all_: F.filter(all_, lambda x, i: (x != "") | (i < F.size(all_) - 1))))

    return bound(F.split(s, ","), cut)


def is_date_text(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{3})?Z)?$")


def property_comment(comment: Column) -> Column:
    """``(format, example, description)`` of a property's comment; the example is text (JSON or not), each null if missing."""
    lines = F.filter(F.transform(F.split(comment, "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*\*\s?", ""))), lambda x: x != "")
    none = F.lit("")

    def rest(said: Column) -> Column:
        text = strip(F.regexp_replace(said["text"], r"^(.*?)@example\s+.+?(?=\s*@\w|$)", "$1"))
        example = strip(F.regexp_extract(said["text"], r"@example\s+(.+?)(?=\s*@\w|$)", 1))
        left = strip(F.regexp_replace(text, r"@\w+(?:\s+\S+)*", ""))
        return F.struct(F.nullif(said["kind"], none).alias("format"), F.nullif(example, none).alias("example"), F.nullif(left, none).alias("description"))

    def without_format(text: Column) -> Column:
        return bound(F.struct(F.regexp_extract(text, r"@format\s+(\S+)", 1).alias("kind"), strip(F.regexp_replace(text, r"^(.*?)@format\s+\S+", "$1")).alias("text")), rest)

    return bound(strip(F.array_join(lines, " ")), without_format)


def schema_variable(type_name: Column) -> Column:
    """``Item`` as ``itemSchema``; null for names that don't begin upper case or end so already."""
    return F.when(type_name.rlike("^[A-Z]") & ~type_name.endswith("Schema"), F.concat(F.lower(F.left(type_name, F.lit(1))), F.substr(type_name, F.lit(2)), F.lit("Schema")))


def field_type(field: Column) -> Column:
    """``(type, format)`` by what a field's name contains."""
    s = F.lower(field)
    kind = lambda t, f=None: F.struct(F.lit(t).alias("type"), F.lit(f).cast("string").alias("format") if not isinstance(f, Column) else f.alias("format"))
    text = F.when(_has(s, "email"), "email").when(_has(s, "url", "uri"), "uri").when(_has(s, "uuid"), "uuid")
    return (
        F.when(_has(s, "title", "name", "description", "content", "text", "slug", "email", "url", "phone"), kind("string", text))
        .when(_has(s, "id", "count", "stock", "quantity", "age", "year"), kind("integer"))
        .when(_has(s, "price", "amount", "rate", "percent"), kind("number"))
        .when(s.startswith("is") | s.startswith("has") | _has(s, "active", "enabled", "published"), kind("boolean"))
        .when(_has(s, "date", "time", "createdat", "updatedat", "deletedat"), kind("string", "date-time"))
        .when(s.isNotNull(), kind("string"))
    )
