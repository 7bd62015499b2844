"""Project files, prior documents, data maps and renderings made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import datamap, datasets, outputs
from ..operators import graph as G
from ..sources import catalogue, files, manifests, python
from .engine import _PTS, _RING_DEPTH, _closed, _points, _ring, _tree
from .registry import plan
from .relations import dealt, flows, sinks, sources, table, with_
from .reports import _ALL, _CTES, _findings
from .topology import _ATTR, _attributed

_cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])


@plan()
def a2_directory_walk(spark, sf):
    """Files below the tables' folder, by their paths in it."""
    return files.walk(spark, sf).select("path", "length")


def _made(spark, sf, ending, text):
    return dealt(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size").select(_cat("p", F.col("p_partkey"), ending).alias("path"), text.alias("text"))


def _manifest(spark, sf, ending, text):
    return manifests.manifest_rows(_made(spark, sf, ending, text)).select("path", "kind", "name", "value")


@plan("SELECT 'p' || p_partkey || '/package.json' AS path, kind, name, value FROM part, LATERAL (VALUES ('package', 'name', p_name), ('dependency', lower(p_type), '^' || p_size), ('workspace', 'packages/' || p_partkey, '')) t(kind, name, value)")
def a23_package_files(spark, sf):
    """Facts of package files, parsed on executors."""
    text = _cat('{"name": "', F.col("p_name"), '", "dependencies": {"', F.lower("p_type"), '": "^', F.col("p_size"), '"}, "workspaces": ["packages/', F.col("p_partkey"), '"]}')
    return _manifest(spark, sf, "/package.json", text)


@plan("SELECT 'p' || p_partkey || '.csproj' AS path, kind, name, value FROM part, LATERAL (VALUES ('sdk', '', 'Sdk.' || p_type), ('PackageReference', p_type, p_size::VARCHAR), ('property', 'RootNamespace', 'Ns' || p_partkey)) t(kind, name, value)")
def a24_csharp_projects(spark, sf):
    text = _cat('<Project Sdk="Sdk.', F.col("p_type"), '"><ItemGroup><PackageReference Include="', F.col("p_type"), '" Version="', F.col("p_size"), '"/></ItemGroup><PropertyGroup><RootNamespace>Ns', F.col("p_partkey"), "</RootNamespace></PropertyGroup></Project>")
    return _manifest(spark, sf, ".csproj", text)


def _schema(spark, sf):
    return _made(spark, sf, ".prisma", _cat("model M", F.col("p_partkey"), " {\n  id Int @id\n  email String? @unique\n  n", F.col("p_size"), " Int\n  @@map(\"", F.lower("p_type"), "\")\n}\n"))


@plan("SELECT 'p' || p_partkey || '.prisma' AS path, kind, name, value FROM part, LATERAL (VALUES ('model', 'M' || p_partkey, lower(p_type)), ('field', 'M' || p_partkey || '.id', 'Int @id'), ('field', 'M' || p_partkey || '.email', 'String? @unique'), ('field', 'M' || p_partkey || '.n' || p_size, 'Int')) t(kind, name, value)")
def a26_prisma_schemas(spark, sf):
    return manifests.manifest_rows(_schema(spark, sf)).select("path", "kind", "name", "value")


@plan("SELECT 'p' || p_partkey || '/compose.yml' AS path, kind, name, value FROM part, LATERAL (VALUES ('service', 'web', ''), ('image', 'web', lower(p_type)), ('environment', 'web.SIZE', p_size::VARCHAR), ('service', 'db', '')) t(kind, name, value)")
def a27_compose_services(spark, sf):
    return _manifest(spark, sf, "/compose.yml", _cat("services:\n  web:\n    image: ", F.lower("p_type"), "\n    environment:\n      SIZE: ", F.col("p_size"), "\n  db:\n"))


@plan("SELECT 'p' || p_partkey || '.py' AS path, 'parse_error' AS kind, 1 AS line FROM part WHERE p_size > 25")
def a34_parse_errors(spark, sf):
    """Files that don't parse are gaps with their line."""
    text = F.when(F.col("p_size") > 25, "def (:").otherwise("x = 1")
    return python.lower_files(_made(spark, sf, ".py", text), ("parse_error",)).filter("kind = 'parse_error'").select("path", "kind", "line")


@plan("SELECT 'p' || p_partkey || '.py' AS path, 'C' || p_partkey AS collection, field, category FROM part, LATERAL (VALUES ('email', 'user.contact.email'), ('size', NULL)) t(field, category)")
def d32_class_datasets(spark, sf):
    """Classified fields of mapped classes."""
    text = _cat("from django.db import models\nclass C", F.col("p_partkey"), "(models.Model):\n    email = models.CharField()\n    size = models.IntegerField()\n    other = ", F.col("p_size"), "\n")
    return datasets.datasets(G.store(datasets.class_fields(python.lower_files(_made(spark, sf, ".py", text), ("member",))))).select("path", "collection", "field", "category")


@plan("SELECT 'p' || p_partkey || '.prisma' AS path, lower(p_type) AS collection, field, category FROM part, LATERAL (VALUES ('email', 'user.contact.email'), ('id', 'user.unique_id.pseudonymous'), ('n' || p_size, NULL)) t(field, category)")
def d33_schema_datasets(spark, sf):
    """Classified fields of schema files."""
    return datasets.datasets(datasets.schema_fields(manifests.manifest_rows(_schema(spark, sf)))).select("path", "collection", "field", "category")


@plan("SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'Map' WHEN 5 THEN NULL ELSE p_type END AS type FROM part")
def j14_type_name(spark, sf):
    """The type that a type expression is about."""
    k, t = F.col("p_partkey") % 6, F.col("p_type")
    text = F.when(k == 0, _cat("Promise<", t, "[]>")).when(k == 1, _cat("Optional[", t, "]")).when(k == 2, _cat(t, " | null")).when(k == 3, _cat("Map<string, ", t, ">")).when(k == 4, _cat("models.List<Task<", t, ">>?")).otherwise("{ a: 1 }")
    return table(spark, sf, "part").select("p_partkey", N.reduced_type(text).alias("type"))


@plan("SELECT p_partkey, p_name AS text FROM part")
def j20_unquote(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", N.unquoted(F.when(k == 0, _cat('"', n, '"')).when(k == 1, _cat("'", n, "'")).when(k == 2, _cat("`", n, "`")).otherwise(n)).alias("text"))


@plan(_tree("up") + " SELECT start, string_agg(node, '>' ORDER BY depth) AS path FROM r GROUP BY start")
def e9_paths(spark, sf):
    """Paths put together again from steps; a path is bounded by the closure's depth."""
    steps = _closed(spark, sf).groupBy("start").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("s"))
    return steps.select("start", F.array_join(F.transform("s", lambda x: x["node"].cast("string")), ">").alias("path"))


@plan(_RING_DEPTH.format(3) + " SELECT start, node, 'hit' AS kind FROM m UNION ALL SELECT DISTINCT start, e.b, 'depth_bound' FROM m JOIN e ON m.node = e.a WHERE m.depth = 3 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.start = m.start AND x.node = e.b)")
def e5_bounded_search(spark, sf):
    """What a search within a bound reaches, and what it was cut short of."""
    edges = G.cut(_ring(spark, sf))
    reached = G.cut(G.closure(edges, edges.select(F.col("a").alias("start"), F.col("a").alias("node")), 3))
    cut_short = G.depth_gaps(reached, edges, 3)
    return reached.select("start", "node", F.lit("hit").alias("kind")).unionByName(cut_short.select("start", "node", F.lit("depth_bound").alias("kind")))


@plan(_tree("down") + " SELECT start AS fn, p_brand AS hit, min(depth) AS depth FROM r JOIN part ON p_partkey = node WHERE p_size > 40 GROUP BY start, p_brand")
def e6_summaries(spark, sf):
    """What entering a function reaches, with the fewest calls: the fixpoint over its callees."""
    hits = table(spark, sf, "part").filter("p_size > 40").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("hit"))
    return _closed(spark, sf, up=False).join(hits, "node").groupBy(F.col("start").alias("fn"), "hit").agg(F.min("depth").alias("depth"))


@plan(f"{_PTS} SELECT var, p_type || ':' || p_brand AS prov FROM (SELECT var, p_type, p_brand, dense_rank() OVER (PARTITION BY var ORDER BY p_type || ':' || p_brand) AS k FROM pts JOIN part ON p_partkey = site) WHERE k <= 16 GROUP BY ALL")
def e13_provenance(spark, sf):
    """What a variable may be, through copies to a fixpoint, its 16 smallest paths kept."""
    from pyspark.sql import Window

    paths = table(spark, sf, "part").select(F.col("p_partkey").alias("site"), F.concat("p_type", F.lit(":"), "p_brand").alias("prov"))
    found = _points(spark, sf).join(paths, "site").select("var", "prov").distinct()
    return found.withColumn("k", F.row_number().over(Window.partitionBy("var").orderBy("prov"))).filter("k <= 16").select("var", "prov")


@plan("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '.' || p_brand WHEN 1 THEN p_type || '()' WHEN 2 THEN p_type END AS prov FROM part")
def e14_statement_transfer(spark, sf):
    """What a statement makes of a value's path: a member, a call, a copy, or nothing."""
    k, t = F.col("p_partkey") % 4, F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", F.when(k == 0, N.api_member(t, F.col("p_brand"))).when(k == 1, N.api_call(t)).when(k == 2, t).alias("prov"))


@plan("SELECT 'pf-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id ELSE 'f' || doc_id || ',g' END AS flows FROM documents")
def a21_prior_findings(spark, sf):
    """Findings of earlier documents, attested or plain, of this version or the one before."""
    k = F.col("doc_id")
    old = k % 3 == 0
    body = _cat('{"schema_version":"', F.when(old, "0.1").otherwise("0.2"), '","id":"pf-', k, '",', F.when(old, _cat('"flow":"f', k, '"')).otherwise(_cat('"flows":["f', k, '","g"]')), "}")
    raw = table(spark, sf, "documents").select(F.when(k % 2 == 0, _cat('{"predicate":', body, "}")).otherwise(body).alias("json"))
    shape = "struct<schema_version:string,id:string,flow:string,flows:array<string>>"
    doc = raw.select(F.from_json("json", f"predicate {shape}").alias("a"), F.from_json("json", shape).alias("b")).select(F.coalesce("a.predicate", "b").alias("d"))
    return doc.select("d.id", F.array_join(F.coalesce("d.flows", F.array("d.flow")), ",").alias("flows"))


@plan("SELECT 'pf-' || doc_id AS id, 'f' || doc_id AS flow FROM documents WHERE doc_id % 3 = 0")
def a22_legacy_documents(spark, sf):
    return a21_prior_findings(spark, sf).filter(~F.col("flows").contains(",")).select("id", F.col("flows").alias("flow"))


@plan("SELECT DISTINCT p_type AS collection, p_brand || '.' || p_name AS field, 'user.x' AS category FROM part")
def a16_datamap_ingest(spark, sf):
    """Fields of a nested data map, from its leaves."""
    p = F.concat(F.lit(".dataset\x1f[d]\x1f.collections\x1f["), "p_type", F.lit("]\x1f.fields\x1f["), "p_brand", F.lit("]\x1f.fields\x1f["), "p_name", F.lit("]\x1f.data_categories\x1f[=\"user.x\"]"))
    leaves = table(spark, sf, "part").select(F.lit("m").alias("map"), p.alias("path"), F.lit('"user.x"').alias("value")).distinct()
    return datamap.fields(leaves).select("collection", "field", "category")


@plan("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN p_type ELSE p_name END AS value, p_partkey % 3 = 0 AND p_size > 10 AS decided FROM part")
def a20_manifest_decisions(spark, sf):
    """Decisions put over what was generated, while they hold."""
    k = F.col("p_partkey").cast("string").alias("path")
    p = table(spark, sf, "part")
    until = F.when(F.col("p_size") > 10, "2024-12-31").otherwise("2024-01-01")
    manifest = p.filter("p_partkey % 3 = 0").select(k, F.col("p_type").alias("value"), until.alias("until"))
    return datamap.decide(p.select(k, F.col("p_name").alias("value")), manifest, "2024-06-30")


@plan(with_("SELECT id, 'sha256:' || sha256('{\"digest\":\"\",\"id\":\"' || id || '\",\"severity\":\"' || severity || '\"}') AS digest FROM exposed", *_ALL, **_CTES))
def b5_document_seal(spark, sf):
    """Digest of a document whose own digest is empty."""
    doc = F.to_json(F.struct(F.lit("").alias("digest"), "id", "severity"))
    return _findings(spark, sf).select("id", outputs.seal(doc).alias("digest"))


@plan(with_("SELECT id, true AS intact FROM exposed", *_ALL, **_CTES))
def b6_digest_check(spark, sf):
    """Digests made anew from sealed documents."""
    sealed = _findings(spark, sf).select("id", "severity").withColumn("digest", outputs.seal(F.to_json(F.struct(F.lit("").alias("digest"), "id", "severity"))))
    return sealed.select("id", (F.col("digest") == outputs.seal(F.to_json(F.struct(F.lit("").alias("digest"), "id", "severity")))).alias("intact"))


@plan(with_("SELECT rule_id, path, line, id, '{\"level\":\"' || CASE severity WHEN 'high' THEN 'error' WHEN 'info' THEN 'note' ELSE 'warning' END || '\",\"ruleId\":\"' || rule_id || '\"}' AS result FROM exposed", *_ALL, **_CTES))
def b8_sarif(spark, sf):
    """Level and rule of the SARIF result of each finding."""
    rows = outputs.sarif_results(_findings(spark, sf).withColumn("repo", F.lit("")))
    short = F.to_json(F.struct(F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", "$.ruleId").alias("ruleId")))
    return rows.select("rule_id", "path", "line", "id", short.alias("result"))


@plan()
def b10_fides_fragment(spark, sf):
    from ..operators import exposure as X
    from .relations import processors

    return outputs.fides_lines(X.egress(flows(spark, sf), sinks(spark, sf), processors(spark, sf)))


@plan(with_("SELECT id, '{\"_type\":\"https://in-toto.io/Statement/v1\",\"predicateType\":\"p\",\"subject\":[{\"name\":\"repo\",\"digest\":{\"gitCommit\":\"' || line || '\"}}],\"predicate\":{\"id\":\"' || id || '\"}}' AS statement FROM sources", "sources"))
def b11_statement(spark, sf):
    body = F.to_json(F.struct("id"))
    return sources(spark, sf).select("id", outputs.statement(body, F.col("line").cast("string"), F.lit("repo"), "p").alias("statement"))


@plan(with_("SELECT id, CASE WHEN line % 2 = 0 THEN '{\"id\":\"' || id || '\"}' END AS predicate FROM sources", "sources"))
def b12_unwrap(spark, sf):
    """Predicates of statements whose subject is the commit."""
    own = F.col("line").cast("string")
    asked = F.when(F.col("line") % 2 == 0, own).otherwise("other")
    return sources(spark, sf).withColumn("s", outputs.statement(F.to_json(F.struct("id")), own, F.lit("repo"), "p")).select("id", outputs.unwrap(F.col("s"), asked).alias("predicate"))


@plan()
def b14_terminal_table(spark, sf):
    return outputs.table(_findings(spark, sf))


@plan(with_("SELECT system, string_agg(DISTINCT endpoint, ',' ORDER BY endpoint) AS endpoints, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM attributed GROUP BY system", "sources", "sinks", "flows", "processors", declared=_CTES["declared"], attributed=_ATTR))
def b17_generated_map(spark, sf):
    """Systems of a data map with what they send where."""
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return _attributed(spark, sf).groupBy("system").agg(sets("endpoint").alias("endpoints"), sets("category").alias("categories"))


@plan("SELECT p_type AS key, p_type || ': ' || to_json(max(p_name)) AS yaml FROM part GROUP BY p_type")
def b19_yaml_lines(spark, sf):
    """Lines of a data map, quoted as YAML."""
    g = table(spark, sf, "part").groupBy(F.col("p_type").alias("key")).agg(F.max("p_name").alias("v"))
    return g.select("key", F.concat("key", F.lit(": "), N.yaml_quoted(F.col("v"))).alias("yaml"))
