"""Datasets of a repository: collections and classified fields of mapped classes and schema files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.globs import glob_regex
from . import classification as K

#: Columns of object-relational mappers.
COLUMNS = ("django.db.models.*Field", "django.contrib.postgres.fields.*", "sqlalchemy.**{Column,mapped_column}", "{flask_sqlalchemy,app}.**Column", "sqlmodel.**Field")


def class_fields(ir: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(repo, path, collection, field, line) of mapped classes: those with an attribute that is a column."""
    hit = F.col("callee").rlike("|".join(glob_regex(c) for c in columns))
    return ir.filter((F.col("kind") == "member") & hit).select("repo", "path", F.col("obj").alias("collection"), "field", "line")


def schema_fields(manifests: DataFrame) -> DataFrame:
    """(repo, path, collection, field, line) of schema files, collections by the name they are mapped to."""
    models = manifests.filter("kind in ('model', 'type', 'view')").select("repo", "path", "name", F.col("value").alias("collection"))
    parts = F.split("name", r"\.")
    fields = manifests.filter("kind = 'field'").select("repo", "path", F.get(parts, 0).alias("name"), F.get(parts, 1).alias("field"))
    return fields.join(models, ["repo", "path", "name"]).select("repo", "path", "collection", "field", F.lit(None).cast("int").alias("line"))


def datasets(fields: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """fields with category, needs_review and by where their name classifies, else null; siblings are the collection's other fields.

    A collection's field names are gathered, since a class or table has few.
    """
    keys = F.collect_set(N.table_key(F.col("field"))).alias("siblings")
    whole = fields.groupBy("repo", "path", "collection").agg(keys)
    rows = fields.join(whole, ["repo", "path", "collection"]).withColumns({"name": F.col("field"), "object": F.lower("collection")})
    found = K.classify(rows, extra).select("repo", "path", "collection", "field", "category", "needs_review", "by")
    return fields.join(found, ["repo", "path", "collection", "field"], "left")


def context_datasets(declared: DataFrame, contexts: tuple[str, ...] = ("DbContext", "IdentityDbContext"), sets: tuple[str, ...] = ("DbSet", "IDbSet")) -> DataFrame:
    """(repo, context, table, entity, field, type): what database contexts keep, from C# declarations (see sources.csharp).

    A context extends one of `contexts`; its tables are its members of a type in
    `sets`, whose type argument names the entity. The entity's properties are the
    fields, of all parts of the class; a class of the context's namespace goes
    before others of that name. Static members and those marked NotMapped aren't
    kept.
    """
    simple = lambda c: F.substring_index(F.regexp_replace(c, "<.*$", ""), ".", -1)
    types = declared.filter(F.col("kind").isin("class", "record")).select("repo", "namespace", "fqn", "name", "bases")
    found = types.filter(F.exists("bases", lambda b: simple(b).isin(*contexts))).select("repo", F.col("fqn").alias("owner_fqn"), F.col("namespace").alias("near")).distinct()
    members = declared.filter(F.col("kind").isin("property", "field")).withColumn("owner_fqn", F.concat_ws(".", F.nullif("namespace", F.lit("")), "owner"))
    tables = members.filter(simple(F.col("type")).isin(*sets)).select("repo", "owner_fqn", F.col("name").alias("table"), F.regexp_extract("type", "<(.*)>", 1).alias("of"))
    wanted = found.join(tables, ["repo", "owner_fqn"]).withColumn("name", simple(F.col("of")))
    entities = wanted.join(types.select("repo", "name", F.col("fqn").alias("entity"), "namespace").distinct(), ["repo", "name"])
    near = entities.groupBy("repo", "owner_fqn", "table").agg(F.min_by("entity", F.struct((F.col("namespace") != F.col("near")), "entity")).alias("entity"))
    left_out = F.array_contains("modifiers", "static") | F.exists("attributes", lambda a: simple(a).isin("NotMapped", "NotMappedAttribute"))
    fields = members.filter((F.col("kind") == "property") & ~left_out).select("repo", F.col("owner_fqn").alias("entity"), F.col("name").alias("field"), "type")
    return near.join(fields, ["repo", "entity"]).select("repo", F.col("owner_fqn").alias("context"), "table", "entity", "field", "type").distinct()
