"""Registries of media types, formats, tag kinds, namespaces and extensions as Columns. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of media types in their order; a star stands for any rest.
MEDIA_GROUPS = {
    "binary": ("application/octet-stream", "audio/*", "image/*", "video/*"),
    "forms": ("application/x-www-form-urlencoded", "multipart/form-data"),
    "linksets": ("application/linkset", "application/linkset+json"),
    "sequential-json": ("application/jsonl", "application/json-seq", "application/x-ndjson"),
    "sequential-multipart": ("multipart/*", "multipart/mixed", "multipart/alternative", "multipart/related", "multipart/byteranges"),
    "sse": ("text/event-stream",),
    "text": ("text/*", "text/plain"),
    "toon": ("text/toon",),
    "xml": ("application/xml",),
}

#: Registered formats, and those of them that are deprecated.
FORMATS = (
    "base64url", "binary", "byte", "char", "commonmark", "date-time-local", "date-time", "date", "decimal", "decimal128", "double-int", "double", "duration", "email", "float",
    "hostname", "html", "http-date", "idn-email", "idn-hostname", "int16", "int32", "int64", "int8", "ipv4-cidr", "ipv4", "ipv6-cidr", "ipv6", "iri-reference", "iri", "json-pointer",
    "language", "media-range", "password", "regex", "relative-json-pointer", "sf-binary", "sf-boolean", "sf-decimal", "sf-integer", "sf-string", "sf-token", "time-local", "time",
    "uint16", "uint32", "uint64", "uint8", "unixtime", "uri-reference", "uri-template", "uri", "uuid",
)
DEPRECATED_FORMATS = ("base64url", "binary", "byte")

#: Kinds of tags, reserved namespaces, versions in their rank.
TAG_KINDS = ("audience", "badge", "nav")
NAMESPACES = ("x-fdx-", "x-jsonschema-", "x-ms-", "x-oai-", "x-oas-draft-", "x-oas-", "x-sap-", "x-scalar-")
VERSIONS = ("3.0", "3.1", "3.2", "3.3-preview")

#: Fields that older versions hold as extensions, by the version that has the field.
JSON_SCHEMA_FIELDS = (
    "$anchor", "contains", "contentEncoding", "contentMediaType", "contentSchema", "dependentSchemas", "else", "examples", "if", "maxContains", "minContains", "patternProperties",
    "propertyNames", "then", "unevaluatedProperties",
)
OAI_FIELDS = (
    "$self", "additionalOperations", "dataValue", "deprecated", "deviceAuthorization", "deviceAuthorizationUrl", "encoding", "itemEncoding", "itemSchema", "name", "prefixEncoding",
    "serializedValue", "summary",
)
EXTENSIONS = {f: (f"x-jsonschema-{f}", "3.1") for f in JSON_SCHEMA_FIELDS} | {f: (f"x-oai-{f}", "3.2") for f in OAI_FIELDS} | {"identifier": ("x-oai-license-identifier", "3.1")}


def media_group(media_type: Column) -> Column:
    """``json``, a registered group, ``text`` or ``unknown``."""
    s = F.lower(media_type)
    out = F.when((s == "application/json") | s.endswith("+json"), "json")
    for group, patterns in MEDIA_GROUPS.items():
        tests = [s.startswith(p[:-1]) if p.endswith("/*") else s == p for p in patterns]
        hit = tests[0]
        for test in tests[1:]:
            hit = hit | test
        out = out.when(hit, group)
    return out.when(s.isNotNull(), "unknown")


def is_sequential(media_type: Column) -> Column:
    """Whether a media type is a sequence of items."""
    return media_group(media_type).isin("sequential-json", "sequential-multipart", "sse")


def is_registered_format(s: Column) -> Column:
    return s.isin(*FORMATS)


def is_deprecated_format(s: Column) -> Column:
    return s.isin(*DEPRECATED_FORMATS)


def is_tag_kind(s: Column) -> Column:
    return s.isin(*TAG_KINDS)


def is_reserved_namespace(name: Column) -> Column:
    """Whether an extension's name begins with a reserved prefix."""
    out = F.lit(False)
    for prefix in NAMESPACES:
        out = out | name.startswith(prefix)
    return out


def extension_of(field: Column, version: Column | str) -> Column:
    """The extension that holds a field in a version that lacks it; null if the version has the field or nothing is registered."""
    table = F.create_map(*[F.lit(x) for f, (name, since) in EXTENSIONS.items() for x in (f, F.struct(F.lit(name).alias("name"), F.lit(VERSIONS.index(since)).alias("since")))])
    found = F.try_element_at(table, field)
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(VERSIONS) for x in (v, i)])
    rank = F.try_element_at(ranks, F.lit(version) if isinstance(version, str) else version)
    return F.when(rank < found["since"], found["name"])


def field_of(extension: Column) -> Column:
    """The field that an extension stands for; null if none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for f, (name, _) in EXTENSIONS.items() for x in (name, f)]), extension)


def move_fields(entries: Column, version: str) -> Column:
    """A string-keyed map with fields that the version lacks under their extensions' names; a field takes the place of an entry that has this name already."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.struct(F.coalesce(extension_of(e["key"], version), e["key"]).alias("key"), e["value"].alias("value"), extension_of(e["key"], version).isNotNull().alias("moved")))
    kept = F.filter(pairs, lambda e: e["moved"] | ~F.exists(pairs, lambda x: x["moved"] & (x["key"] == e["key"])))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def promote_fields(entries: Column, version: str) -> Column:
    """A string-keyed map with extensions under the names of the fields that the version has, unless the field is there too."""
    native = lambda k: F.when(extension_of(field_of(k), version).isNull() & ~F.map_contains_key(entries, F.coalesce(field_of(k), k)), field_of(k))
    return F.map_from_entries(F.transform(F.map_entries(entries), lambda e: F.struct(F.coalesce(native(e["key"]), e["key"]), e["value"])))
