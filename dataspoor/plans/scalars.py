"""Scalar functions and predicates over the tables' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.globs import any_glob, glob_regex
from .registry import plan
from .relations import gaps, names, sinks, sources, table, with_

_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_')"
_SNAKE = r"lower(regexp_replace(regexp_replace({0}, '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g'), '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'))"
_BELOW = "({0} = '{1}' OR starts_with({0}, '{1}.'))"


def key_sql(x: str) -> str:
    return _KEY.format(x)


def snake_sql(x: str) -> str:
    return _SNAKE.format(x)


def below_sql(x: str, prefixes) -> str:
    return "(" + " OR ".join(_BELOW.format(x, p) for p in prefixes) + ")"


def entity_sql(x: str) -> str:
    return f"regexp_matches({x}, '{N.entity_pattern()}')"


@plan(with_(f"SELECT n, name, {key_sql('name')} AS key FROM names", "names"))
def j1_table_key(spark, sf):
    return names(spark, sf).select("n", "name", N.table_key(F.col("name")).alias("key"))


@plan(with_(f"SELECT n, name, {snake_sql('name')} AS words FROM names", "names"))
def j2_snake(spark, sf):
    return names(spark, sf).select("n", "name", N.snake(F.col("name")).alias("words"))


@plan(with_(f"SELECT n, CASE WHEN a = b THEN a ELSE a || ',' || b END AS keys FROM (SELECT n, {key_sql('name')} AS a, {key_sql(snake_sql('name'))} AS b FROM names)", "names"))
def j3_keys(spark, sf):
    return names(spark, sf).select("n", F.array_join(N.name_keys(F.col("name")), ",").alias("keys"))


@plan(with_(f"SELECT n, {entity_sql(key_sql(snake_sql('name')))} AS thing FROM names", "names"))
def j5_entity_segmentation(spark, sf):
    return names(spark, sf).select("n", N.entity_identifier(N.table_key(N.snake(F.col("name")))).alias("thing"))


@plan(with_(f"SELECT n, {entity_sql(key_sql('name'))} OR {entity_sql(key_sql(snake_sql('name')))} AS not_personal FROM names WHERE NOT list_contains(['product', 'brand_id'], {key_sql('name')})", "names"))
def c31_not_personal(spark, sf):
    """Things' identifiers, less the names that a project declares itself."""
    key = N.table_key(F.col("name"))
    declared = spark.createDataFrame([("product",), ("brand_id",)], "declared string")
    thing = N.entity_identifier(key) | N.entity_identifier(N.table_key(N.snake(F.col("name"))))
    return names(spark, sf).join(F.broadcast(declared), key == F.col("declared"), "left_anti").select("n", thing.alias("not_personal"))


@plan(with_(f"SELECT n, {entity_sql(key_sql(snake_sql('name')))} AS thing, {key_sql(snake_sql('name'))} AS key FROM names WHERE {entity_sql(key_sql(snake_sql('name')))}", "names"))
def c32_thing_identifier(spark, sf):
    key = N.table_key(N.snake(F.col("name")))
    return names(spark, sf).filter(N.entity_identifier(key)).select("n", F.lit(True).alias("thing"), key.alias("key"))


_CUT = ", ".join(f"(url[:{k}], false)" for k in (4, 9, 16))
_HOST_IN = "SELECT page_id, p, done FROM (SELECT page_id, unnest([url[:4], url[:9], url[:16], url, url[6:], '/api/' || page_id, 'api/' || page_id, '']) AS p, unnest([false, false, false, true, true, true, true, true]) AS done FROM pages)"


def _prefixes(spark, sf):
    url, k = F.col("url"), F.col("page_id")
    made = [(F.substring(url, 1, 4), False), (F.substring(url, 1, 9), False), (F.substring(url, 1, 16), False), (url, True), (F.expr("substring(url, 6)"), True), (F.concat(F.lit("/api/"), k), True), (F.concat(F.lit("api/"), k), True), (F.lit(""), True)]
    return table(spark, sf, "pages").select("page_id", F.inline(F.array(*[F.struct(p.alias("p"), F.lit(done).alias("done")) for p, done in made])))


_ABS, _REST = "regexp_matches(p, '^(https?:)?//')", "regexp_replace(p, '^(https?:)?//', '')"
_LIT = f"(regexp_matches({_REST}, '^[^/?#:]+[/?#:]') OR (done AND regexp_matches({_REST}, '^[^/?#:]+$')))"
_HOST_KIND = f"CASE WHEN {_ABS} THEN CASE WHEN {_LIT} THEN 'literal' ELSE 'dynamic' END WHEN starts_with(p, '/') THEN 'relative' WHEN done AND NOT contains(p, '://') AND p <> '' THEN 'relative' ELSE 'dynamic' END"


@plan(f"SELECT page_id, p, done, {_HOST_KIND} AS kind, CASE WHEN {_HOST_KIND} = 'literal' THEN lower(regexp_extract({_REST}, '^[^/?#:]+')) END AS host FROM ({_HOST_IN})")
def j6_host_of(spark, sf):
    p, done = F.col("p"), F.col("done")
    return _prefixes(spark, sf).select("page_id", "p", "done", N.host_kind(p, done).alias("kind"), N.host_value(p, done).alias("host"))


_URLS = "SELECT page_id, unnest([url, upper(url), 'https+http://user:pw@' || split_part(url, '/', 3) || '.:8080/x', '//[::1]:80/' || page_id, 'no host', 'mailto:a@b']) AS u FROM pages"


def _urls(spark, sf):
    url = F.col("url")
    host = F.split_part(url, F.lit("/"), F.lit(3))
    made = F.array(url, F.upper(url), F.concat(F.lit("https+http://user:pw@"), host, F.lit(".:8080/x")), F.concat(F.lit("//[::1]:80/"), F.col("page_id")), F.lit("no host"), F.lit("mailto:a@b"))
    return table(spark, sf, "pages").select("page_id", F.explode(made).alias("u"))


_AUTH = r"nullif(lower(regexp_replace(CASE WHEN starts_with(h, '[') THEN regexp_extract(h, '^[^\]]*') || ']' ELSE regexp_extract(h, '^[^:]*') END, '\.+$', '')), '')"
_AUTH_IN = rf"SELECT page_id, u, regexp_replace(regexp_extract(trim(u), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', '') AS h FROM ({_URLS})"


@plan(f"SELECT page_id, u, {_AUTH} AS authority FROM ({_AUTH_IN})")
def j7_authority(spark, sf):
    return _urls(spark, sf).select("page_id", "u", N.authority(F.col("u")).alias("authority"))


_HOSTS = "SELECT c_custkey AS k, unnest(['10.' || (c_custkey % 300) || '.0.1', '172.' || (c_custkey % 40) || '.1.1', '192.168.0.' || (c_custkey % 256), 'host' || c_custkey || '.localhost', 'localhost', 'db' || c_custkey || '.example.com', '169.254.1.1', '8.8.8.8']) AS host FROM customer"


@plan(
    f"""SELECT k, host, host IN ('localhost', '[::1]') OR host LIKE '%.localhost' OR (regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')
    AND list_max([x::INT FOR x IN regexp_extract_all(host, '[0-9]+')]) < 256 AND (split_part(host, '.', 1) IN ('127', '10', '0') OR starts_with(host, '192.168.') OR starts_with(host, '169.254.')
    OR (split_part(host, '.', 1) = '172' AND try_cast(split_part(host, '.', 2) AS INT) BETWEEN 16 AND 31))) AS local FROM ({_HOSTS})"""
)
def c30_local_host(spark, sf):
    k = F.col("c_custkey")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    made = F.array(cat("10.", k % 300, ".0.1"), cat("172.", k % 40, ".1.1"), cat("192.168.0.", k % 256), cat("host", k, ".localhost"), F.lit("localhost"), cat("db", k, ".example.com"), F.lit("169.254.1.1"), F.lit("8.8.8.8"))
    return table(spark, sf, "customer").select(k.alias("k"), F.explode(made).alias("host")).select("k", "host", N.is_local_host(F.col("host")).alias("local"))


@plan("SELECT event_id, lower(replace('Services__' || event_type || '__' || props, '__', ':')) AS key FROM events")
def j8_config_key(spark, sf):
    return table(spark, sf, "events").select("event_id", N.config_key(F.concat(F.lit("Services__"), "event_type", F.lit("__"), "props")).alias("key"))


_SLUG_IN = "CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN ' Post Hog (EU)' WHEN 2 THEN 'api.Example.com' ELSE '##' END"


@plan(rf"SELECT s_suppkey, coalesce(nullif(lower(regexp_replace(regexp_replace({_SLUG_IN}, '^[^A-Za-z0-9._]+|[^A-Za-z0-9._]+$', '', 'g'), '[^A-Za-z0-9._]+', '_', 'g')), ''), 'unknown_processor') AS slug FROM supplier")
def j9_fides_slug(spark, sf):
    k = F.col("s_suppkey") % 4
    given = F.when(k == 0, F.col("s_name")).when(k == 1, " Post Hog (EU)").when(k == 2, "api.Example.com").otherwise("##")
    return table(spark, sf, "supplier").select("s_suppkey", N.fides_slug(given).alias("slug"))


_SPEC = "CASE p_partkey % 5 WHEN 0 THEN '@scope/' || replace(p_name, ' ', '/') WHEN 1 THEN replace(p_name, ' ', '/') || '/x' WHEN 2 THEN replace(p_name, ' ', '.') || '.c' WHEN 3 THEN p_type ELSE '@only' END"


def _spec():
    k, under = F.col("p_partkey") % 5, lambda c: F.replace(F.col("p_name"), F.lit(" "), F.lit(c))
    return F.when(k == 0, F.concat(F.lit("@scope/"), under("/"))).when(k == 1, F.concat(under("/"), F.lit("/x"))).when(k == 2, F.concat(under("."), F.lit(".c"))).when(k == 3, F.col("p_type")).otherwise("@only")


@plan(
    f"""SELECT p_partkey, lang, CASE lang WHEN 'python' THEN split_part(s, '.', 1)
    WHEN 'csharp' THEN split_part(s, '.', 1) || CASE WHEN contains(s, '.') THEN '.' || split_part(s, '.', 2) ELSE '' END
    ELSE split_part(s, '/', 1) || CASE WHEN starts_with(s, '@') AND contains(s, '/') THEN '/' || split_part(s, '/', 2) ELSE '' END END AS module
    FROM (SELECT p_partkey, {_SPEC} AS s, unnest(['python', 'csharp', 'javascript']) AS lang FROM part)"""
)
def j10_top_module(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", _spec().alias("s"), F.explode(F.array(*map(F.lit, ("python", "csharp", "javascript")))).alias("lang"))
    return rows.select("p_partkey", "lang", N.top_module(F.col("s"), F.col("lang")).alias("module"))


@plan(
    f"""SELECT p_partkey, CASE WHEN starts_with(s, '@') AND contains(s, '/') THEN array_to_string(string_split(s, '/')[:2], '/') ELSE split_part(s, '/', 1) END AS package,
    array_to_string(string_split(s, '/')[(CASE WHEN starts_with(s, '@') AND contains(s, '/') THEN 3 ELSE 2 END):], '/') AS inside FROM (SELECT p_partkey, {_SPEC} AS s FROM part)"""
)
def j17_split_package(spark, sf):
    package, inside = N.split_package(F.col("s"))
    return table(spark, sf, "part").select("p_partkey", _spec().alias("s")).select("p_partkey", package.alias("package"), inside.alias("inside"))


_READ = "CASE c_custkey % 5 WHEN 0 THEN 'address.' || c_mktsegment WHEN 1 THEN 'order.billing_address[\"state\"]' WHEN 2 THEN 'order.tax[' || c_custkey || '][\"x\"]' WHEN 3 THEN 'plain' ELSE 'f(x)…é_' || c_custkey || '.name' END"


@plan(rf"SELECT c_custkey, nullif(regexp_extract(regexp_replace(regexp_extract(t, '^(.*)[.\[][^.\[]*$', 1), '(?:\[[^\[]*\])+$', ''), '[\p{{L}}\p{{N}}_]*$'), '') AS receiver FROM (SELECT c_custkey, {_READ} AS t FROM customer)")
def j11_receiver_ident(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("address."), "c_mktsegment")).when(k % 5 == 1, 'order.billing_address["state"]').when(k % 5 == 2, F.concat(F.lit("order.tax["), k, F.lit(']["x"]'))).when(k % 5 == 3, "plain").otherwise(F.concat(F.lit("f(x)…é_"), k, F.lit(".name")))
    return table(spark, sf, "customer").select("c_custkey", N.receiver_ident(text).alias("receiver"))


_CALL = "CASE event_id % 4 WHEN 0 THEN 'this.' || event_type || '_log.info(' || value || ')' WHEN 1 THEN 'console.info(x)' WHEN 2 THEN 'info(x)' ELSE '(f)(x)' END"


def _call():
    k = F.col("event_id") % 4
    return F.when(k == 0, F.concat(F.lit("this."), "event_type", F.lit("_log.info("), F.col("event_type"), F.lit(")"))).when(k == 1, "console.info(x)").when(k == 2, "info(x)").otherwise("(f)(x)")


_CALL = _CALL.replace("|| value ||", "|| event_type ||")


@plan(rf"SELECT event_id, CASE WHEN contains(t, '.info') THEN regexp_extract(split_part(t, '.info', 1), '[\p{{L}}\p{{N}}_$]*$') ELSE '' END AS receiver FROM (SELECT event_id, {_CALL} AS t FROM events)")
def j12_receiver_name(spark, sf):
    return table(spark, sf, "events").select("event_id", N.receiver_name(_call(), F.lit("info")).alias("receiver"))


@plan(f"SELECT event_id, coalesce(nullif(trim(split_part({_CALL}, '(', 1)), ''), '<call>') AS callee FROM events")
def j13_callee_text(spark, sf):
    return table(spark, sf, "events").select("event_id", N.callee_text(_call()).alias("callee"))


_PATHS = "SELECT page_id, unnest(['src/./a/../' || page_id || '//x.ts', '../up/' || page_id, 'a/b/../../c' || page_id, './' || page_id || '/.', 'a/../../b' || page_id]) AS path FROM pages"


@plan(
    f"""WITH RECURSIVE p AS (SELECT page_id, path, string_split(path, '/') AS seg FROM ({_PATHS})),
    walk AS (SELECT page_id, path, seg, 1 AS i, []::VARCHAR[] AS acc FROM p
      UNION ALL SELECT page_id, path, seg, i + 1, CASE WHEN seg[i] IN ('', '.') THEN acc WHEN seg[i] = '..' THEN acc[:len(acc) - 1] ELSE list_append(acc, seg[i]) END FROM walk WHERE i <= len(seg))
    SELECT page_id, path, array_to_string(acc, '/') AS normal FROM walk WHERE i = len(seg) + 1"""
)
def j15_normalize_path(spark, sf):
    k = F.col("page_id")
    made = [("src/./a/../", "//x.ts"), ("../up/", ""), ("a/b/../../c", ""), ("./", "/."), ("a/../../b", "")]
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in made])).alias("path"))
    return rows.select("page_id", "path", N.normalize_path(F.col("path")).alias("normal"))


@plan(with_("SELECT id, sha256(path || chr(31) || category || chr(31) || text) AS anchor FROM sources", "sources"))
def j16_anchor_key(spark, sf):
    return sources(spark, sf).select("id", F.sha2(N.anchor_key(F.col("path"), F.col("category"), F.col("text")), 256).alias("anchor"))


@plan(r"SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def j18_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.excerpt(F.col("text")).alias("excerpt"))


@plan("SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(CASE WHEN page_id % 5 = 0 THEN '' ELSE 'services/Web-App.' || page_id END), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'root') AS system FROM pages")
def j19_system_key(spark, sf):
    root = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("services/Web-App."), "page_id"))
    return table(spark, sf, "pages").select("page_id", N.system_key(root).alias("system"))


@plan(with_("SELECT id, CASE class WHEN 'llm' THEN 'language model' WHEN 'http' THEN 'HTTP' WHEN 'log' THEN 'logs' WHEN 'third_party' THEN 'third party' ELSE replace(class, '_', ' ') END AS label FROM sinks", "sinks"))
def j21_class_label(spark, sf):
    return sinks(spark, sf).select("id", N.class_label(F.col("class")).alias("label"))


@plan("SELECT event_id, '\"' || replace(replace(replace(props || chr(9) || event_type, '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\t') || '\"' AS scalar FROM events")
def b15_yaml_scalar(spark, sf):
    return table(spark, sf, "events").select("event_id", N.yaml_quoted(F.concat("props", F.lit("\t"), "event_type")).alias("scalar"))


@plan("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM part")
def b16_fides_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.fides_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("key"))


@plan("SELECT doc_id, '[' || to_json(text) || ',' || to_json(lang) || ',' || coalesce(to_json(CASE WHEN doc_id % 2 = 0 THEN source END), 'null') || ']' AS json FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')")
def b2_canonical_json(spark, sf):
    """Canonical JSON of a list of strings and nulls."""
    docs = table(spark, sf, "documents").filter(~F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    third = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return docs.select("doc_id", N.json_array(N.json_string(F.col("text")), N.json_string(F.col("lang")), N.json_string(third)).alias("json"))


@plan("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def b3_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.digest(F.col("text")).alias("digest"))


@plan(with_("SELECT id, 'gap-' || substr(sha256('[\"' || id || '\",\"' || category || '\"]'), 1, 16) AS short FROM sources", "sources"))
def b4_short_id(spark, sf):
    key = N.json_array(N.json_string(F.col("id")), N.json_string(F.col("category")))
    return sources(spark, sf).select("id", F.concat(F.lit("gap-"), N.short_hash(key)).alias("short"))


_FILES = "SELECT doc_id, 'src/' || lang || '/' || source || '/f' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.cs' WHEN 3 THEN '.test.js' WHEN 4 THEN '.go' WHEN 5 THEN '' ELSE '.d.TSX' END AS path FROM documents"


def _files(spark, sf):
    ext = F.get(F.array(*map(F.lit, (".py", ".ts", ".cs", ".test.js", ".go", "", ".d.TSX"))), (F.col("doc_id") % 7).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit("/f"), F.col("doc_id"), ext).alias("path"))


_GLOBS = ("src/{en,de}/**/*.py", "**/*.test.js", "src/fr/src?/f*.ts", "src/es/**")


@plan(f"SELECT path FROM ({_FILES}) WHERE NOT regexp_matches(path, '{'|'.join(glob_regex(g, '/') for g in _GLOBS)}')")
def a5_exclusion(spark, sf):
    return _files(spark, sf).filter(~any_glob(F.col("path"), list(_GLOBS), "/")).select("path")


@plan("SELECT p_partkey, regexp_matches(replace(p_name, ' ', '.') || '.' || p_type, '^[^.]*[.](?:ring|widget)[.].*$') AS one, regexp_matches(replace(p_name, ' ', '.') || '.' || p_type, '^(?:.*[.])?SMALL$') AS any_depth FROM part")
def c1_glob(spark, sf):
    api = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.lit("."), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", api.rlike(glob_regex("*.{ring,widget}.**")).alias("one"), api.rlike(glob_regex("**.SMALL")).alias("any_depth"))


@plan(f"SELECT path, regexp_matches(path, '^src/(?:en|de)/(?:.*/)?[^/]*[.]py$') AS matches FROM ({_FILES})")
def c2_glob_match(spark, sf):
    return _files(spark, sf).select("path", F.col("path").rlike(glob_regex(_GLOBS[0], "/")).alias("matches"))


@plan("SELECT p_partkey, replace(p_name, ' ', '.') IN ('red.widget', 'blue.bolt') OR regexp_matches(replace(p_name, ' ', '.'), '^hot[.][^.]*$') AS matches FROM part")
def c3_any_pattern(spark, sf):
    return table(spark, sf, "part").select("p_partkey", any_glob(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), ["red.widget", "blue.bolt", "hot.*"]).alias("matches"))


_PREFIXES = ("*", "user", "user.contact", "user.contact.email", "user.contact.e", "unknown")


@plan(with_("SELECT id, p AS prefix, p = '*' OR category = p OR starts_with(category, p || '.') AS covered FROM sources, (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PREFIXES) + "]) AS p)", "sources"))
def c4_covers(spark, sf):
    rows = sources(spark, sf).select("id", "category", F.explode(F.array(*map(F.lit, _PREFIXES))).alias("prefix"))
    return rows.select("id", "prefix", N.covers(F.col("prefix"), F.col("category")).alias("covered"))


@plan(with_(f"SELECT id, {below_sql('category', N.SPECIAL)} AS special FROM sources", "sources"))
def c5_special(spark, sf):
    return sources(spark, sf).select("id", N.is_special(F.col("category")).alias("special"))


@plan(with_(f"SELECT id, {below_sql('category', N.CREDENTIAL)} AS credential FROM sources", "sources"))
def c6_credential(spark, sf):
    return sources(spark, sf).select("id", N.is_credential(F.col("category")).alias("credential"))


@plan(with_("SELECT id FROM sources WHERE category IN ('user.contact.email', 'user.authorization.password', 'user')", "sources"))
def c7_taxonomy(spark, sf):
    keys = spark.createDataFrame([("user.contact.email",), ("user.authorization.password",), ("user",)], "category string")
    return sources(spark, sf).join(F.broadcast(keys), "category", "left_semi").select("id")


@plan(with_("SELECT id, class NOT IN ('log', 'browser_storage', 'device_storage') AS is_external FROM sinks", "sinks"))
def c8_external(spark, sf):
    return sinks(spark, sf).select("id", N.is_external(F.col("class")).alias("is_external"))


@plan("SELECT p_partkey, lang, lang = 'javascript' AND NOT contains(path, ':') AS global FROM (SELECT p_partkey, p_type || CASE WHEN p_partkey % 2 = 0 THEN ':' ELSE '.' END || p_name AS path, CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'javascript' END AS lang FROM part)")
def c20_runtime_global(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k, F.concat("p_type", F.when(k % 2 == 0, ":").otherwise("."), "p_name").alias("path"), F.when(k % 3 == 0, "python").otherwise("javascript").alias("lang"))
    return rows.select("p_partkey", "lang", N.is_runtime_global(F.col("path"), F.col("lang")).alias("global"))


_BOX = "CASE p_partkey % 5 WHEN 0 THEN 'Map().' || p_type WHEN 1 THEN 'Array.from()' WHEN 2 THEN 'Mapper.x' WHEN 3 THEN 'Object' ELSE 'lib:Set.add' END"


@plan(f"SELECT p_partkey, NOT contains({_BOX}, ':') AND regexp_extract({_BOX}, '^[^.(]*') IN ('Map', 'Set', 'WeakMap', 'WeakSet', 'Array', 'Object', 'Promise') AS container FROM part")
def c21_container_path(spark, sf):
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, F.concat(F.lit("Map()."), "p_type")).when(k == 1, "Array.from()").when(k == 2, "Mapper.x").when(k == 3, "Object").otherwise("lib:Set.add")
    return table(spark, sf, "part").select("p_partkey", N.is_container_path(path, F.lit("javascript")).alias("container"))


_CHAIN = "'m:' || array_to_string([p_type FOR i IN range(p_partkey % 20 + 1)], '.')"


def _chain():
    return F.concat(F.lit("m:"), F.array_join(F.array_repeat(F.col("p_type"), (F.col("p_partkey") % 20 + 1).cast("int")), "."))


@plan(f"SELECT p_partkey, CASE WHEN p_partkey % 20 + 1 < 16 THEN {_CHAIN} || '.next' END AS path FROM part")
def e17_api_member(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.api_member(_chain(), F.lit("next")).alias("path"))


@plan("SELECT p_partkey, CASE WHEN p_partkey % 12 < 8 THEN 'm:f' || repeat('()', (p_partkey % 12)::INT) || '()' END AS path FROM part")
def e18_api_call(spark, sf):
    path = F.concat(F.lit("m:f"), F.repeat(F.lit("()"), (F.col("p_partkey") % 12).cast("int")))
    return table(spark, sf, "part").select("p_partkey", N.api_call(path).alias("path"))


_SEG = "list_filter(string_split(d, '.'), lambda s, i: i = 1 OR s <> string_split(d, '.')[i - 1])"
_LONG = "CASE WHEN user_id % 2 = 0 THEN 'pkg:a.a.b' ELSE 'where()' END || repeat('.' || event_type || '.x' || (event_id % 3), (event_id % 6)::INT) || '.z'"


@plan(
    f"""SELECT event_id, m || array_to_string(CASE WHEN len(s) > 8 THEN list_concat(list_concat(s[:3], ['…']), s[len(s) - 2:]) ELSE s END, '.') AS detail
    FROM (SELECT event_id, m, {_SEG} AS s FROM (SELECT event_id, regexp_extract(t, '^[^:]*:') AS m, regexp_replace(t, '^[^:]*:', '') AS d FROM (SELECT event_id, {_LONG} AS t FROM events)))"""
)
def g5_gap_detail(spark, sf):
    step = F.repeat(F.concat(F.lit("."), "event_type", F.lit(".x"), F.col("event_id") % 3), (F.col("event_id") % 6).cast("int"))
    text = F.concat(F.when(F.col("user_id") % 2 == 0, "pkg:a.a.b").otherwise("where()"), step, F.lit(".z"))
    return table(spark, sf, "events").select("event_id", N.gap_detail(text).alias("detail"))


_COLL = "CASE p_partkey % 6 WHEN 0 THEN 'Users' WHEN 1 THEN 'user_addresses' WHEN 2 THEN 'Categories' WHEN 3 THEN 'boss' WHEN 4 THEN replace(p_name, ' ', '_') || 's' ELSE p_type END"


@plan(
    f"""SELECT p_partkey, CASE WHEN regexp_matches(b, '[a-z0-9]ies$') THEN regexp_replace(b, 'ies$', 'y') WHEN regexp_matches(b, '(?:s|x|z|ch|sh)es$') THEN regexp_replace(b, 'es$', '')
    WHEN regexp_matches(b, '[^s]s$') THEN regexp_replace(b, 's$', '') ELSE b END AS collection FROM (SELECT p_partkey, lower(regexp_replace({_COLL}, '[^A-Za-z0-9]', '', 'g')) AS b FROM part)"""
)
def a19_collection_key(spark, sf):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Users").when(k == 1, "user_addresses").when(k == 2, "Categories").when(k == 3, "boss").when(k == 4, F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("s"))).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", N.collection_key(name).alias("collection"))


@plan(with_("SELECT kind, detail, CASE kind WHEN 'unresolved_callee' THEN 0 WHEN 'dynamic_call' THEN 1 ELSE 2 END AS rank FROM gaps", "gaps"))
def c18_impact_rank(spark, sf):
    rank = F.when(F.col("kind") == "unresolved_callee", 0).when(F.col("kind") == "dynamic_call", 1).otherwise(2)
    return gaps(spark, sf).select("kind", "detail", rank.alias("rank"))
