"""Scalar functions on names, categories, hosts, paths and texts, as Spark columns.

Everything here is a built-in expression: nothing leaves whole-stage codegen
for Python, and null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Category prefixes that mean credentials.
CREDENTIAL = ("user.authorization", "system.authentication")
#: Special categories of personal data (Art. 9 and 10) by public taxonomy keys.
SPECIAL = (
    "user.biometric",
    "user.criminal_history",
    "user.demographic.ethnic_group",
    "user.demographic.political_opinion",
    "user.demographic.race_ethnicity",
    "user.demographic.religious_belief",
    "user.demographic.sexual_orientation",
    "user.genetic",
    "user.health_and_medical",
    "user.workplace.trade_union",
)
#: Sink classes whose data stays on the machine or device.
LOCAL_CLASSES = ("log", "browser_storage", "device_storage")
#: Words that name a thing, and what ends its identifier.
ENTITIES = ("account_type", "brand", "catalog", "category", "event", "item", "order", "page", "part", "product", "region", "nation", "type")
ENTITY_SUFFIXES = ("id", "ids", "key")
#: Headers that carry credentials to the host they are for.
AUTH_FIELDS = ("headers", "authorization", "auth", "x-api-key", "api-key", "proxy-authorization")
#: Built-in containers of the browser language.
CONTAINERS = ("Map", "Set", "WeakMap", "WeakSet", "Array", "Object", "Promise")


def starts_below(value: Column, prefix: Column | str) -> Column:
    """Equal to the dotted prefix or below it."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (value == p) | value.startswith(F.concat(p, F.lit(".")))


def covers(prefix: Column, category: Column) -> Column:
    """`*`, the category itself or one of its dotted ancestors."""
    return (prefix == "*") | starts_below(category, prefix)


def _any_below(category: Column, prefixes: tuple[str, ...]) -> Column:
    anchored = "|".join(p.replace(".", r"\.") for p in prefixes)
    return category.rlike(rf"^(?:{anchored})(?:\.|$)")


def is_credential(category: Column) -> Column:
    return _any_below(category, CREDENTIAL)


def is_special(category: Column) -> Column:
    return _any_below(category, SPECIAL)


def is_external(sink_class: Column) -> Column:
    return ~sink_class.isin(*LOCAL_CLASSES)


def table_key(name: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one `_`, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def snake(name: Column) -> Column:
    """Words of a camel-case name joined by `_`; an acronym is one word."""
    acronym = F.regexp_replace(name, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1_")
    return F.lower(F.regexp_replace(acronym, r"([\p{Ll}0-9])(?=\p{Lu})", "$1_"))


def name_keys(name: Column) -> Column:
    """The keys a name is looked up by, in order."""
    return F.array_distinct(F.array(table_key(name), table_key(snake(name))))


def _choice(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def entity_pattern(entities: tuple[str, ...] = ENTITIES, suffixes: tuple[str, ...] = ENTITY_SUFFIXES) -> str:
    """One regex for keys that are entity words and an identifier suffix, set off or glued."""
    return f"^(?:(?:{_choice(entities)})_)*(?:{_choice(entities)})_?(?:{_choice(suffixes)})$"


def entity_identifier(key: Column) -> Column:
    return key.rlike(entity_pattern())


def host_kind(prefix: Column, complete: Column) -> Column:
    """literal, relative or dynamic: what a URL's known start says of its host."""
    absolute = prefix.rlike("^(?:https?:)?//")
    rest = F.regexp_replace(prefix, "^(?:https?:)?//", "")
    literal = rest.rlike("^[^/?#:]+[/?#:]") | (complete & rest.rlike("^[^/?#:]+$"))
    relative = prefix.startswith("/") | (complete & ~prefix.contains("://") & (prefix != ""))
    return F.when(absolute, F.when(literal, "literal").otherwise("dynamic")).when(relative, "relative").otherwise("dynamic")


def host_value(prefix: Column, complete: Column) -> Column:
    """The host in lower case where its kind is literal, else null."""
    rest = F.regexp_replace(prefix, "^(?:https?:)?//", "")
    return F.when(host_kind(prefix, complete) == "literal", F.lower(F.regexp_extract(rest, "^[^/?#:]+", 0)))


def authority(url: Column) -> Column:
    """Host of a URL of any scheme: no user info, port or trailing dots; null where there is none."""
    raw = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(raw, "^.*@", "")
    bare = F.when(host.startswith("["), F.concat(F.regexp_extract(host, r"^[^\]]*", 0), F.lit("]"))).otherwise(F.regexp_extract(host, "^[^:]*", 0))
    return F.nullif(F.lower(F.regexp_replace(bare, r"\.+$", "")), F.lit(""))


def is_local_host(host: Column) -> Column:
    """Hosts that only this machine or its network reaches."""
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    private = rf"^(?:(?:127|10|0)\.{byte}|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.{byte}\.{byte}$"
    return host.isin("localhost", "[::1]") | host.endswith(".localhost") | host.rlike(private)


def config_key(key: Column) -> Column:
    return F.lower(F.replace(key, F.lit("__"), F.lit(":")))


def fides_slug(name: Column) -> Column:
    """Key of a processor: other characters than letters, digits, `.` and `_` become single `_`."""
    inner = F.regexp_replace(F.regexp_replace(name, r"^[^A-Za-z0-9._]+|[^A-Za-z0-9._]+$", ""), r"[^A-Za-z0-9._]+", "_")
    return F.coalesce(F.nullif(F.lower(inner), F.lit("")), F.lit("unknown_processor"))


def top_module(module: Column, lang: Column) -> Column:
    """What a specifier belongs to: package, scoped package, or two namespace segments."""
    scoped = F.when(module.startswith("@"), F.regexp_extract(module, "^[^/]*(?:/[^/]*)?", 0)).otherwise(F.regexp_extract(module, "^[^/]*", 0))
    return F.when(lang == "python", F.regexp_extract(module, r"^[^.]*", 0)).when(lang == "csharp", F.regexp_extract(module, r"^[^.]*(?:\.[^.]*)?", 0)).otherwise(scoped)


def split_package(spec: Column) -> tuple[Column, Column]:
    """(package, path inside it) of an import specifier."""
    return F.regexp_extract(spec, "^(?:@[^/]*/)?[^/]*", 0), F.regexp_replace(spec, "^(?:@[^/]*/)?[^/]*/?", "")


def callee_text(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"^[^(]*", 0)), F.lit("")), F.lit("<call>"))


def receiver_name(text: Column, method: Column) -> Column:
    """The identifier before the first `.method`; empty where there is none."""
    call = F.concat(F.lit("."), method)
    return F.when(F.contains(text, call), F.regexp_extract(F.split_part(text, call, F.lit(1)), r"[\p{L}\p{N}_$]*$", 0)).otherwise(F.lit(""))


def receiver_ident(text: Column) -> Column:
    """The name that a field read reads from, its index brackets left out; null where there is none."""
    head = F.regexp_extract(text, r"^(.*)[.\[][^.\[]*$", 1)
    bare = F.regexp_replace(head, r"(?:\[[^\[]*\])+$", "")
    return F.nullif(F.regexp_extract(bare, r"[\p{L}\p{N}_]*$", 0), F.lit(""))


def is_runtime_global(path: Column, lang: Column) -> Column:
    return (lang == "javascript") & ~path.contains(":")


def is_container_path(path: Column, lang: Column) -> Column:
    return is_runtime_global(path, lang) & F.regexp_extract(path, r"^[^.(]*", 0).isin(*CONTAINERS)


def normalize_path(path: Column) -> Column:
    """`/`-separated path without empty, `.` and, where something precedes them, `..` segments."""
    step = lambda acc, seg: F.when(seg.isin("", "."), acc).when((seg == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).when(seg == "..", acc).otherwise(F.concat(acc, F.array(seg)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """Directories above a file, nearest first, the root ('') last."""
    parts = F.split(dirname(path), "/")
    deep = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(deep, F.array(F.lit(""))))


def anchor_key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def json_string(value: Column) -> Column:
    """A string as canonical JSON; null as null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""), F.lit("null"))


def json_array(*items: Column) -> Column:
    """Canonical JSON of a list of parts that are already JSON."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def excerpt(text: Column, length: int = 80) -> Column:
    """One line of at most `length` characters; `…` marks a cut."""
    line = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(line) > length, F.concat(F.substring(line, 1, length - 1), F.lit("…"))).otherwise(line)


def yaml_quoted(text: Column) -> Column:
    """A double-quoted YAML scalar."""
    out = text
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), out, F.lit('"'))


def fides_key(name: Column) -> Column:
    """Key of a project: words in lower case joined by `_`."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def system_key(root: Column) -> Column:
    """Key of a system from its root directory; the repository itself is `root`."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(root), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("root"))


def collection_key(name: Column) -> Column:
    """A collection's name in lower-case letters and digits, in the singular."""
    bare = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    return F.when(bare.rlike("[a-z0-9]ies$"), F.regexp_replace(bare, "ies$", "y")).when(bare.rlike("(?:s|x|z|ch|sh)es$"), F.regexp_replace(bare, "es$", "")).when(bare.rlike("[^s]s$"), F.regexp_replace(bare, "s$", "")).otherwise(bare)


def class_label(sink_class: Column) -> Column:
    """A sink class as people read it."""
    named = {"llm": "language model", "http": "HTTP", "log": "logs", "third_party": "third party"}
    out = F.when(F.lit(False), F.lit(""))
    for k, v in named.items():
        out = out.when(sink_class == k, F.lit(v))
    return out.otherwise(F.translate(sink_class, "_", " "))


def api_member(path: Column, member: Column, most: int = 16) -> Column:
    """An API path one member on; null beyond `most` segments."""
    longer = F.concat(path, F.when(path.endswith(":"), F.lit("")).otherwise(F.lit(".")), member)
    return F.when(F.size(F.split(path, r"\.")) < most, longer)


def api_call(path: Column, most: int = 8) -> Column:
    """An API path called; null once it holds `most` calls."""
    return F.when(F.regexp_count(path, F.lit(r"\(\)")) < most, F.concat(path, F.lit("()")))


def gap_detail(detail: Column) -> Column:
    """An API chain without consecutive repeats; over 8 segments keep the outer three."""
    module = F.regexp_extract(detail, "^[^:]*:", 0)
    segments = F.split(F.regexp_replace(detail, "^[^:]*:", ""), r"\.")
    once = F.filter(segments, lambda s, k: ~s.eqNullSafe(F.get(segments, k - 1)))
    outer = F.concat(F.slice(once, 1, 3), F.array(F.lit("…")), F.slice(once, -3, 3))
    return F.concat(module, F.array_join(F.when(F.size(once) > 8, outer).otherwise(once), "."))


def is_date(text: Column) -> Column:
    """A calendar date written YYYY-MM-DD; false for null."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


#: Wrappers that a type's name is looked for inside.
WRAPPERS = ("Promise", "Array", "ReadonlyArray", "List", "IList", "IEnumerable", "ICollection", "Task", "ValueTask", "ActionResult", "Optional", "Sequence", "Iterable", "Set", "Awaited", "Partial", "Readonly", "Nullable")


def reduced_type(text: Column, depth: int = 4) -> Column:
    """The type that a type expression is about: no wrappers, arrays, null alternatives or type arguments; null where none is left.

    A wrapper may stand around a wrapper, to `depth` levels.
    """
    out = F.regexp_replace(text, r"\s+", "")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\|(?:null|undefined|None)|(?:null|undefined|None)\||\?$|(?:\[\])+$", "")
        out = F.regexp_replace(out, rf"^(?:\w+\.)*(?:{'|'.join(WRAPPERS)})[<\[](.*)[>\]]$", "$1")
    bare = F.regexp_replace(out, r"[<\[].*$", "")
    return F.nullif(F.regexp_extract(bare, r"^(?:\w+\.)*(\w+)$", 1), F.lit(""))


def unquoted(text: Column) -> Column:
    """A string literal without its quotes; other texts as they are."""
    return F.regexp_replace(text, r"""^(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|`([^`]*)`)$""", "$1$2$3")
