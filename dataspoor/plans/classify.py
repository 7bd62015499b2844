"""Classification of names made of the tables' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import classification as K
from .registry import plan
from .relations import names, sources, table, with_
from .scalars import entity_sql, key_sql, snake_sql

_EXTRA = (("product", "user.behavior", "config"), ("email_id", "user.contact.email", "datamap"), ("email_id", "user.unique_id", "config"))
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_HAS = lambda xs: f"list_has_any(ks, {_LIST(xs)})"
_HOLDS = lambda o, s: f"(regexp_matches(object, '{o}') OR list_has_any(siblings, {_LIST(s)}))"
_STATE, _PERSON = K.CONTEXT
_EXACT = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in K.EXACT.items()) + ") t(key, category)"
_EXTRAS = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _EXTRA) + ") t(key, category, origin)"
_KEYED = f"SELECT *, CASE WHEN k1 = k2 THEN [k1] ELSE [k1, k2] END AS ks FROM (SELECT *, {key_sql('name')} AS k1, {key_sql(snake_sql('name'))} AS k2 FROM names)"
_GENERAL = f"""SELECT n, CASE WHEN {_HAS(K.OPERATIONAL)} AND NOT ({_HAS(_PERSON[1])} AND {_HOLDS(_PERSON[3], _PERSON[4])}) OR {entity_sql('k1')} OR {entity_sql('k2')} THEN NULL
    WHEN {_HAS(_STATE[1])} AND NOT {_HOLDS(_STATE[3], _STATE[4])} THEN NULL
    WHEN {_HAS(_PERSON[1])} AND {_HOLDS(_PERSON[3], _PERSON[4])} THEN ['{_PERSON[2]}', 'false', 'catalogue:{_PERSON[0]}']
    WHEN coalesce(e1.category, e2.category) IS NOT NULL THEN [coalesce(e1.category, e2.category), 'false', 'classification-table']
    WHEN {_HAS(K.MAYBE)} THEN ['unknown', 'true', 'classification-table:maybe_pii'] END AS c
    FROM keyed LEFT JOIN {_EXACT.replace(' t(', ' e1(')} ON e1.key = k1 LEFT JOIN {_EXACT.replace(' t(', ' e2(')} ON e2.key = k2"""
_CLASSIFIED = f"""SELECT DISTINCT n, category, false AS needs_review, origin AS by FROM keyed JOIN {_EXTRAS} ON list_contains(ks, key)
    UNION ALL SELECT n, c[1], c[2] = 'true', c[3] FROM general WHERE c IS NOT NULL AND n NOT IN (SELECT n FROM keyed JOIN {_EXTRAS} ON list_contains(ks, key))"""


@plan(with_("SELECT * FROM classified", "names", keyed=_KEYED, general=_GENERAL, classified=_CLASSIFIED))
def j4_classify(spark, sf):
    """Names in their context, by the first rung that answers."""
    extra = spark.createDataFrame(list(_EXTRA), "key string, category string, by string")
    return K.classify(names(spark, sf), extra).select("n", "category", "needs_review", "by")


@plan(with_("SELECT n, category FROM classified WHERE \"by\" = 'config'", "names", keyed=_KEYED, general=_GENERAL, classified=_CLASSIFIED))
def a12_config_fields(spark, sf):
    """Names that the project's own declarations classify."""
    return j4_classify(spark, sf).filter("by = 'config'").select("n", "category")


@plan(with_(f"SELECT n, {_HOLDS(_STATE[3], _STATE[4])} AS holds FROM names", "names"))
def c33_context_holds(spark, sf):
    _, _, _, objects, siblings = K.CONTEXT[0]
    holds = F.col("object").rlike(objects) | F.arrays_overlap("siblings", F.array(*map(F.lit, siblings)))
    return names(spark, sf).select("n", holds.alias("holds"))


@plan(with_("SELECT n, category FROM classified WHERE needs_review", "names", keyed=_KEYED, general=_GENERAL, classified=_CLASSIFIED))
def k4_field_reads(spark, sf):
    """Field reads that need review."""
    return j4_classify(spark, sf).filter("needs_review").select("n", "category")


@plan(with_("SELECT n, category FROM (SELECT * FROM classified) WHERE n % 2 = 0 AND category <> 'unknown'", "names", keyed=_KEYED, general=_GENERAL, classified=_CLASSIFIED))
def k6_param_names(spark, sf):
    """Parameters that are sources by their names and siblings."""
    return j4_classify(spark, sf).filter("n % 2 = 0 and category <> 'unknown'").select("n", "category")


# A data map: datasets of suppliers' nations, collections of part types, fields of brands.
_MAP = "SELECT 'dataset_' || (p_partkey % 5) AS dataset, p_type || 's' AS collection, p_brand AS field, 'user.x' || (p_size % 3) AS category FROM part"


@plan(f"SELECT DISTINCT field, category FROM ({_MAP}) ORDER BY field, category")
def a17_datamap_fields(spark, sf):
    """All (field, category) pairs of nested data maps: three levels exploded."""
    p = table(spark, sf, "part").select(F.concat(F.lit("dataset_"), F.col("p_partkey") % 5).alias("dataset"), F.concat("p_type", F.lit("s")).alias("collection"), F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("user.x"), F.col("p_size") % 3).alias("category")).alias("field"))
    return p.select("field.*").distinct().select(F.col("name").alias("field"), "category").orderBy("field", "category")


@plan(f"SELECT DISTINCT t.type, field, category FROM ({_MAP}) JOIN (VALUES ('economys'), ('Small'), ('none')) t(type) ON regexp_replace(lower(t.type), 's$', '') = regexp_replace(lower(collection), 's$', '')")
def a18_collection_fields(spark, sf):
    """Fields of the collection that a type's name means."""
    types = spark.createDataFrame([("economys",), ("Small",), ("none",)], "type string").withColumn("key", N.collection_key(F.col("type")))
    p = table(spark, sf, "part").select(N.collection_key(F.concat("p_type", F.lit("s"))).alias("key"), F.col("p_brand").alias("field"), F.concat(F.lit("user.x"), F.col("p_size") % 3).alias("category"))
    return p.join(F.broadcast(types), "key").select("type", "field", "category").distinct()


@plan(with_("SELECT category, count(*) AS n FROM sources GROUP BY category", "sources"))
def m_category_counts(spark, sf):
    return sources(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
