"""Tags in comments, as Column expressions over one comment string. A tag that isn't there gives an empty string, array or map, or null where a docstring says so; a null comment gives null or none."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import camel_case

#: Schemes that a requirement names by keyword, and status tokens besides three digits.
AUTH_PRESETS = {"bearer": "BearerAuth", "basic": "BasicAuth", "apikey": "ApiKeyAuth"}
STATUS_TOKEN = r"^(\d{3}|[1-5]XX|default)$"


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _re(s: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)


def _some(s: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(s, F.lit(""))


def _all(comment: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(comment, F.lit(pattern), F.lit(group)), strip)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda is given is a variable, while an expression is written out, and computed again, wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def last_by_key(entries: Column, key: str) -> Column:
    """Entries (structs) of which no later one has the same key."""
    return bound(entries, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda x: x[key] == e[key])))


def clean_comment(comment: Column) -> Column:
    """Without the stars and the white space behind them."""
    return strip(F.regexp_replace(comment, r"\*\s*", ""))


def line_tag(comment: Column, tag: str) -> Column:
    """The rest of the line behind a tag; of the next one if the tag's line ends there."""
    return strip(F.regexp_extract(comment, rf"(?m){_re(tag)}\s*(.*)", 1))


def token_tag(comment: Column, tag: str) -> Column:
    """The first word behind a tag."""
    return F.regexp_extract(comment, rf"{_re(tag)}\s+(\S+)", 1)


def _bounded(tag: str) -> str:
    return rf"(?m)^\s*\*?\s*{_re(tag)}(?![A-Za-z0-9_-])\s*([^\n\r]*)"


def bounded_tag(comment: Column, *tags: str) -> Column:
    """The line behind the first of the tags that has one, where no word character or hyphen follows the tag itself."""
    return F.coalesce(*[_some(strip(F.regexp_extract(comment, _bounded(tag), 1))) for tag in tags], F.when(comment.isNotNull(), F.lit("")))


def list_tag(comment: Column, tag: str) -> Column:
    """Parts of a tag's line between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(line_tag(comment, tag), ","), strip), lambda x: x != "")


def type_tag(comment: Column, *tags: str) -> Column:
    """The type (word characters, ``<>,[]`` and white space) behind the first of the tags that has one."""
    return F.coalesce(*[_some(strip(F.regexp_extract(comment, rf"(?m)^\s*\*?\s*{tag}\s+([\w<>,\s\[\]]+)", 1))) for tag in tags], F.when(comment.isNotNull(), F.lit("")))


def has_tag(comment: Column, tag: str) -> Column:
    return F.contains(comment, F.lit(tag))


def is_internal(comment: Column) -> Column:
    """Whether a cleaned comment marks its schema as internal."""
    return clean_comment(comment).rlike(r"@internal\b|@schema\s+false\b")


def schema_id(comment: Column) -> Column:
    """The component name that a comment gives; null if none."""
    return _some(token_tag(clean_comment(comment), "@id"))


def deprecation_reason(comment: Column) -> Column:
    """What follows the tag on its line; null if nothing."""
    return _some(strip(F.regexp_extract(comment, r"(?m)^[ \t]*\*?[ \t]*@deprecated[ \t]+([^\n\r]+)", 1)))


def summary(comment: Column) -> Column:
    """The tag's line, or else the comment's first line if that is no tag."""
    first = strip(F.element_at(F.split(comment, "\n"), 1))
    return F.coalesce(_some(line_tag(comment, "@summary")), F.when(first.startswith("@"), "").otherwise(first))


def required_flag(raw: Column) -> Column:
    """``(rest, required)``: a value without the flag at its end, and whether it is required (null: not said)."""
    yes, no = r"(?i)(^|\s+)required(\s*=\s*true)?$", r"(?i)(^|\s+)(optional|required\s*=\s*false)$"
    made = lambda s, pattern, flag: F.struct(strip(F.regexp_replace(s, pattern, "")).alias("rest"), F.lit(flag).alias("required"))
    return bound(strip(raw), lambda s: F.when(s.rlike(yes), made(s, yes, True)).when(s.rlike(no), made(s, no, False)).otherwise(F.struct(s.alias("rest"), F.lit(None).cast("boolean").alias("required"))))


def request_body(comment: Column) -> Column:
    """``(type, required)``: the last ``@requestBody`` with a type, or else the first ``@body`` with one; required if any of them says so."""
    bodies = lambda tag: F.transform(_all(comment, _bounded(tag)), required_flag)
    typed = lambda items: F.filter(items, lambda x: x["rest"] != "")["rest"]

    def made(both: Column) -> Column:
        names = F.concat(F.reverse(typed(both["first"])), typed(both["second"]))
        return F.struct(F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("type"), F.exists(F.concat(both["first"], both["second"]), lambda x: F.coalesce(x["required"], F.lit(False))).alias("required"))

    return bound(F.struct(bodies("@requestBody").alias("first"), bodies("@body").alias("second")), made)


def media_target(raw: Column) -> Column:
    """``(target, value)`` of ``request: value`` or ``response: value``; the response by default."""
    pattern = r"^(request|response)\s*:\s*([\s\S]+)$"
    return F.when(raw.rlike(pattern), F.struct(F.regexp_extract(raw, pattern, 1).alias("target"), strip(F.regexp_extract(raw, pattern, 2)).alias("value"))).otherwise(F.struct(F.lit("response").alias("target"), raw.alias("value")))


def _targeted(comment: Column, tags: Sequence[str]) -> Column:
    raws = F.filter(F.concat(*[_all(comment, _bounded(tag)) for tag in tags]), lambda x: x != "")
    return F.transform(raws, media_target)


def _of_target(items: Column, target: str) -> Column:
    return F.try_element_at(F.filter(items, lambda x: x["target"] == target), F.lit(-1))["value"]


def item_types(comment: Column, tags: Sequence[str] = ("@itemSchema", "@responseItem")) -> Column:
    """``(request, response)``: the types of a sequence's items; the last of a target counts, null if none."""
    items = F.transform(_targeted(comment, tags), lambda x: F.struct(x["target"].alias("target"), F.regexp_extract(x["value"], r"^(\S*)", 1).alias("value")))
    return bound(items, lambda found: F.struct(*[_of_target(found, t).alias(t) for t in ("request", "response")]))


def item_encodings(comment: Column, tags: Sequence[str]) -> Column:
    """``(request, response)``: a target's last JSON value as VARIANT; text that isn't JSON is a string."""
    found = _targeted(comment, tags)
    return F.struct(*[F.coalesce(F.try_parse_json(_of_target(found, t)), _text_variant(_of_target(found, t))).alias(t) for t in ("request", "response")])


def _text_variant(s: Column) -> Column:
    """A string as a VARIANT string."""
    quoted = F.regexp_replace(F.to_json(F.struct(s.alias("v"))), r'^\{"v":|\}$', "")
    return F.when(s.isNotNull(), F.try_parse_json(quoted))


def response_summaries(comment: Column) -> Column:
    """``(primary, by_status)``: the last summary without a status (null if none), and the last of each status."""
    pattern = r"^(\S+)\s+([\s\S]+)$"
    lines = F.filter(_all(comment, _bounded("@responseSummary")), lambda x: x != "")
    split = F.transform(lines, lambda x: F.struct(x.alias("raw"), F.regexp_extract(x, pattern, 1).alias("k"), strip(F.regexp_extract(x, pattern, 2)).alias("v")))

    def made(raws: Column) -> Column:
        named = F.transform(F.filter(raws, lambda x: x["k"].rlike(STATUS_TOKEN)), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
        plain = F.filter(raws, lambda x: ~x["k"].rlike(STATUS_TOKEN))
        return F.struct(F.try_element_at(plain, F.lit(-1))["raw"].alias("primary"), F.map_from_entries(last_by_key(named, "k")).alias("by_status"))

    return bound(split, made)


def _url_and_text(raw: Column) -> Column:
    text = F.regexp_replace(strip(F.regexp_extract(raw, r"^[^ ]* ([\s\S]*)$", 1)), r"""^["']|["']$""", "")
    return F.struct(F.regexp_extract(raw, r"^([^ ]*)", 1).alias("url"), _some(text).alias("description"))


def servers(comment: Column) -> Column:
    """``(url, description)`` of every server; descriptions without quotes, null if none."""
    return F.transform(_all(comment, r"(?m)^\s*\*?\s*@servers?\s+([^\n\r]+)"), _url_and_text)


def external_docs(comment: Column) -> Column:
    """``(url, description)``; null if there is no such tag."""
    raw = strip(F.regexp_extract(comment, r"(?m)^\s*\*?\s*@externalDocs\s+([^\n\r]+)", 1))
    return F.when(raw != "", _url_and_text(raw))


def security_requirements(raw: Column) -> Column:
    """Alternatives between commas, each a map from scheme to scopes; a semicolon adds a scheme to the same one. Behind a scheme's colon all is scopes (between ``,`` or ``|``) up to the next semicolon.

    What begins no scheme is skipped up to the next separator; other text behind a scheme ends the list. Of a scheme's repeats in one alternative the last counts.
    """
    name = r"\s*([A-Za-z][A-Za-z0-9._-]*)"
    tokens = F.regexp_extract_all(raw, F.lit(rf"{name}\s*(?::[^;]*)?(?:[,;]|)|[^,;]*[,;]|[^,;]+$"), F.lit(0))
    cut = F.transform(
        tokens,
        lambda t: F.struct(
            F.regexp_extract(t, rf"^{name}", 1).alias("scheme"),
            F.filter(F.transform(F.split(F.regexp_extract(t, r"^[^:]*:([^;]*)", 1), r"[,|]"), strip), lambda s: s != "").alias("scopes"),
            F.regexp_extract(t, r"([,;])$", 1).alias("sep"),
            F.contains(t, F.lit(":")).alias("scoped"),
        ),
    )
    ends = lambda x: (x["scheme"] != "") & ((x["sep"] == "") | (x["scoped"] & (x["sep"] == ",")))
    opened = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, 1, i), ends) & (x["scheme"] != ""))
    number = lambda open_, i: F.size(F.filter(F.slice(open_, 1, i), lambda x: (x["sep"] == ",") & ~x["scoped"]))
    numbered = lambda open_: F.transform(open_, lambda x, i: F.struct(number(open_, i).alias("n"), x["scheme"].alias("scheme"), x["scopes"].alias("scopes")))

    def maps(placed: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(placed, lambda x: x["n"])), F.lit(-1))
        of = lambda k: last_by_key(F.filter(placed, lambda x: x["n"] == k), "scheme")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.map_from_entries(F.transform(of(k), lambda x: F.struct(x["scheme"], x["scopes"]))))

    found = bound(cut, lambda all_: bound(opened(all_), lambda open_: bound(numbered(open_), maps)))
    return F.when(raw.isNotNull(), F.filter(found, lambda m: F.size(m) > 0))


def apply_auth_presets(requirements: Column, presets: dict[str, str] = AUTH_PRESETS) -> Column:
    """Schemes renamed by their lower-cased keyword; of two that come to one name the last counts."""
    names = F.create_map(*[F.lit(x) for pair in presets.items() for x in pair])
    renamed = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(F.coalesce(F.try_element_at(names, F.lower(e["key"])), e["key"]).alias("k"), e["value"].alias("v")))
    return F.transform(requirements, lambda m: F.map_from_entries(last_by_key(renamed(m), "k")))


def auth_preset_text(raw: Column, presets: dict[str, str] = AUTH_PRESETS) -> Column:
    """The names between ``,`` and ``;`` replaced by keyword; separators and unknown names stay, white space around names goes."""
    names = F.create_map(*[F.lit(x) for pair in presets.items() for x in pair])
    tokens = F.regexp_extract_all(raw, F.lit(r"[^,;]+|[,;]"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, F.lower(strip(t))), strip(t))), "")


def security(comment: Column) -> Column:
    """Requirements of all ``@security`` lines, one after another."""
    return F.flatten(F.transform(_all(comment, r"(?m)^\s*\*?\s*@security\s+([^\n\r]+)"), security_requirements))


def type_token(token: Column) -> Column:
    """``(type, ref)``: a primitive type, or else a reference to a component; both null if it is neither."""
    primitive = F.lower(token).isin("string", "number", "integer", "boolean")
    ref = F.when(~primitive & token.rlike(r"^[A-Za-z_$][\w$]*$"), F.concat(F.lit("#/components/schemas/"), token))
    return F.struct(F.when(primitive, F.lower(token)).alias("type"), ref.alias("ref"))


def response_headers(comment: Column) -> Column:
    """``(status, name, type, ref, description)`` of every header line with at least three words."""
    words = F.filter(F.transform(_all(comment, r"(?m)^\s*\*?\s*@responseHeader\s+([^\n\r]+)"), lambda r: F.split(r, r"\s+")), lambda w: F.size(w) >= 3)
    of = lambda w: type_token(w[2])
    return F.transform(words, lambda w: F.struct(w[0].alias("status"), w[1].alias("name"), of(w)["type"].alias("type"), of(w)["ref"].alias("ref"), _some(F.array_join(F.slice(w, F.lit(4), F.size(w)), " ")).alias("description")))


def links(comment: Column) -> Column:
    """``(status, name, operation_id, operation_ref, parameters)``: a target with a slash in front is a reference; parameters are a JSON object's text, null if there is none."""
    pattern = r"^(\S+)\s+(\S+)\s+(\S+)(?:\s+(\{[\s\S]*\}))?$"
    raws = F.filter(_all(comment, r"(?m)^\s*\*?\s*@link\s+([^\n\r]+)"), lambda r: r.rlike(pattern))
    part = lambda r, k: F.regexp_extract(r, pattern, k)
    is_ref = lambda r: part(r, 3).rlike("^#?/")
    parameters = lambda r: F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(part(r, 4))).startswith("OBJECT"), F.lit(False)), part(r, 4))
    return F.transform(raws, lambda r: F.struct(part(r, 1).alias("status"), part(r, 2).alias("name"), F.when(~is_ref(r), part(r, 3)).alias("operation_id"), F.when(is_ref(r), part(r, 3)).alias("operation_ref"), parameters(r).alias("parameters")))


def callbacks(comment: Column) -> Column:
    """``(name, expression, reference)`` of every callback line with at least two words; the reference may be null."""
    words = F.filter(F.transform(_all(comment, r"(?m)^\s*\*?\s*@callback\s+([^\n\r]+)"), lambda r: F.split(r, r"\s+")), lambda w: F.size(w) >= 2)
    return F.transform(words, lambda w: F.struct(w[0].alias("name"), w[1].alias("expression"), F.get(w, F.lit(2)).alias("reference")))


def override(comment: Column) -> Column:
    """The JSON object of the override tag as VARIANT; null if it is none."""
    value = F.try_parse_json(F.regexp_extract(comment, r"@openapi-override\s+(\{[\s\S]*?\})\s*(?=(?:\n\s*(?:\*\s*)?@|\n?\z))", 1))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def querystring(comment: Column) -> Column:
    """``(type, name)``; the name is the type's in camel case unless one is given; null without the tag."""
    pattern = r"@querystring\s+(\S+)(?:\s+as\s+(\S+))?"
    kind = F.regexp_extract(comment, pattern, 1)
    name = F.coalesce(_some(F.regexp_extract(comment, pattern, 2)), camel_case(F.regexp_replace(kind, "<.*>", "")))
    return F.when(kind != "", F.struct(kind.alias("type"), name.alias("name")))


def response_value(raw: Column) -> Column:
    """``(code, type, description)`` of ``code``, ``code:type``, ``code:type:description``, ``type`` or ``type:description``; a type in braces or brackets is all that follows."""
    parts = F.transform(F.split(raw, ":"), strip)
    coded = parts[0].rlike(STATUS_TOKEN)
    rest = F.when(coded, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    whole = F.when(coded, strip(F.array_join(rest, ":"))).otherwise(raw)
    inline = whole.rlike(r"^\s*[\[{]")
    code = F.when(coded, parts[0]).otherwise("")
    return F.when(inline, F.struct(code.alias("code"), whole.alias("type"), F.lit("").alias("description"))).otherwise(
        F.struct(code.alias("code"), F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("type"), strip(F.array_join(F.slice(rest, F.lit(2), F.greatest(F.size(rest), F.lit(1))), ":")).alias("description"))
    )


def response(comment: Column) -> Column:
    """``response_value`` of the first response tag; null if there is none."""
    raw = strip(F.regexp_extract(comment, r"@response\s+([^\n\r@]+)", 1))
    return F.when(raw != "", response_value(raw))


def responses(comment: Column) -> Column:
    """``response_value`` of every response tag."""
    return F.transform(F.filter(_all(comment, r"@response\s+([^\n\r@]+)"), lambda r: r != ""), response_value)


#: Where an example can stand.
EXAMPLE_TARGETS = ("request", "response", "querystring", "query", "header", "cookie")


def examples(comment: Column, tag: str = "@examples") -> Column:
    """``(target, name, kind, payload)`` of every example line ``target:payload``, ``target:name:payload`` or ``target:name:ref:source``.

    ``kind`` is ``json`` (an object or array, whose parts ``expand_examples`` turns into rows), ``external`` (a URL), ``serialized``, ``ref`` (a name to look up) or ``text``.
    """
    raws = F.filter(_all(comment, rf"{_re(tag)}\s+([^\n\r@]+)"), lambda r: r.rlike(r"^[^:]*:\s*\S"))
    parts = F.transform(raws, lambda r: F.struct(strip(F.regexp_extract(r, r"^([^:]*):", 1)).alias("target"), strip(F.regexp_extract(r, r"^[^:]*:([\s\S]*)$", 1)).alias("rest")))
    parts = F.transform(parts, lambda p: F.struct(F.when(p["target"] == "body", "request").otherwise(p["target"]).alias("target"), p["rest"].alias("rest")))
    parts = F.filter(parts, lambda p: p["target"].isin(*EXAMPLE_TARGETS))
    made = lambda p, name, kind, payload: F.struct(p["target"].alias("target"), name.alias("name"), F.lit(kind).alias("kind"), payload.alias("payload"))
    none = F.lit(None).cast("string")

    def one(p: Column) -> Column:
        rest = p["rest"]
        name, payload = strip(F.regexp_extract(rest, r"^([^:]*):", 1)), strip(F.regexp_extract(rest, r"^[^:]*:([\s\S]*)$", 1))
        return (
            F.when(rest.rlike(r"^[\[{]"), made(p, F.lit("example"), "json", rest))
            .when(rest.rlike(r"^https?://"), made(p, F.lit("example"), "external", rest))
            .when(rest.startswith("serialized:"), made(p, F.lit("example"), "serialized", strip(F.regexp_replace(rest, "^serialized:", ""))))
            .when(~F.contains(rest, F.lit(":")), made(p, none, "ref", rest))
            .when((name == "") | (payload == ""), F.lit(None))
            .when(payload.startswith("ref:"), made(p, name, "ref", strip(F.regexp_replace(payload, "^ref:", ""))))
            .when(payload.rlike(r"^https?://"), made(p, name, "external", payload))
            .when(payload.startswith("serialized:"), made(p, name, "serialized", strip(F.regexp_replace(payload, "^serialized:", ""))))
            .when(payload.rlike(r"^[\[{]"), made(p, name, "json", payload))
            .otherwise(made(p, name, "text", payload))
        )

    return F.filter(F.transform(parts, one), lambda x: x.isNotNull())


def deprecation_text(description: Column, deprecated: Column, reason: Column) -> Column:
    """A description with the reason for deprecation behind it, unless it holds that reason already."""
    note = F.concat(F.lit("Deprecated: "), reason)
    missing = deprecated & (F.coalesce(reason, F.lit("")) != "") & ~F.coalesce(F.contains(description, reason), F.lit(False))
    return F.when(F.coalesce(missing, F.lit(False)), F.when(F.coalesce(description, F.lit("")) == "", note).otherwise(F.concat(description, F.lit("\n\n"), note))).otherwise(description)


def parse_block(comment: Column) -> Column:
    """A comment's tags as one struct."""
    c = clean_comment(comment)
    body, items, summaries = request_body(c), item_types(c), response_summaries(c)
    return F.struct(
        has_tag(c, "@openapi").alias("is_openapi"), has_tag(c, "@ignore").alias("is_ignored"), has_tag(c, "@deprecated").alias("deprecated"), deprecation_reason(c).alias("deprecation_reason"),
        c.rlike(r"@webhook(\s|$)").alias("is_webhook"), F.when(c.rlike(r"@webhook(\s|$)"), _some(line_tag(c, "@webhook"))).alias("webhook_name"),
        summary(c).alias("summary"), line_tag(c, "@description").alias("description"), line_tag(c, "@tagSummary").alias("tag_summary"), line_tag(c, "@tagDescription").alias("tag_description"),
        line_tag(c, "@tagKind").alias("tag_kind"), line_tag(c, "@tagParent").alias("tag_parent"), strip(F.regexp_extract(c, r"@tag\s+([^\n\r@]*)", 1)).alias("tag"),
        bounded_tag(c, "@requestBodyDescription", "@bodyDescription").alias("body_description"), bounded_tag(c, "@requestContentType", "@contentType").alias("content_type"),
        line_tag(c, "@responseContentType").alias("response_content_type"), line_tag(c, "@responseDescription").alias("response_description"), line_tag(c, "@responseSet").alias("response_set"),
        token_tag(c, "@operationId").alias("operation_id"), F.upper(token_tag(c, "@method")).alias("method"),
        type_tag(c, "@query", "@queryParams", "@params").alias("params_type"), type_tag(c, "@path", "@pathParams").alias("path_params_type"), type_tag(c, "@header").alias("header_type"), type_tag(c, "@cookie").alias("cookie_type"),
        querystring(c).alias("querystring"), body["type"].alias("body_type"), body["required"].alias("body_required"), items["request"].alias("request_item_type"), items["response"].alias("response_item_type"),
        response(c).alias("response"), summaries["primary"].alias("response_summary"), summaries["by_status"].alias("response_summaries"), servers(c).alias("servers"), external_docs(c).alias("external_docs"), security(c).alias("security"),
        response_headers(c).alias("response_headers"), links(c).alias("links"), callbacks(c).alias("callbacks"), override(c).alias("override"), examples(c).alias("examples"),
    )
