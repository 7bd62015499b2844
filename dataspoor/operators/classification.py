"""What a name is: a ladder of declared, contextual and general tables.

Rows hold keys, not names, so each rung is an equi-join; the first rung that
answers wins. Tables are dimension tables, and no rung collects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

#: Keys of names and their public taxonomy categories.
EXACT = {
    "username": "user.account.username",
    "user_name": "user.account.username",
    "api_key": "user.authorization.credentials",
    "apikey": "user.authorization.credentials",
    "password": "user.authorization.password",
    "password_hash": "user.authorization.password",
    "state": "user.contact.address.state",
    "street": "user.contact.address.street",
    "city": "user.contact.address.city",
    "email": "user.contact.email",
    "email_address": "user.contact.email",
    "phone": "user.contact.phone_number",
    "phone_number": "user.contact.phone_number",
    "phonenumber": "user.contact.phone_number",
    "religion": "user.demographic.religious_belief",
    "cardnumber": "user.financial.credit_card",
    "card_number": "user.financial.credit_card",
    "health_record_id": "user.health_and_medical.record_id",
    "ip_address": "user.device.ip_address",
    "first_name": "user.name",
    "last_name": "user.name",
    "full_name": "user.name",
    "date_of_birth": "user.demographic.date_of_birth",
    "ssn": "user.government_id",
    "user_id": "user.unique_id.pseudonymous",
    "customer_id": "user.unique_id.pseudonymous",
}
#: Names that may be personal, and names that never are.
MAYBE = ("name", "value", "contact", "address")
OPERATIONAL = ("id", "count", "quantity", "created_at", "updated_at", "status")
#: Fixed values: (rule, names, category or none, object globs as a regex, sibling names).
CONTEXT = (
    ("address-state", ("state",), None, "(?:^|_)address$", ("city", "street", "zip")),
    ("person-identifiers", ("id",), "user.unique_id.pseudonymous", "^(?:user|customer|person)$", ("email", "first_name")),
)


def classify(names: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """names (name, object, siblings array, others kept) with category, needs_review and by; unclassified rows go.

    extra: (key, category, by): declared names, all of whose categories count. Then
    operational names and identifiers of things are nothing; then the contextual
    rules that add a category; those that restrict a name; the exact table; the
    table of maybes.
    """
    spark = names.sparkSession
    keys = N.name_keys(F.col("name"))
    rows = names.withColumns({"__keys": keys, "__id": F.struct("name", "object", "siblings")})
    distinct = rows.select("__id", "__keys", F.col("name"), F.col("object"), F.col("siblings")).distinct()
    has = lambda words: F.exists("__keys", lambda k: k.isin(*words))
    thing = F.exists("__keys", N.entity_identifier)
    rung, none = [], F.lit(None).cast("string")
    answer = lambda category, review, by: F.struct(category.alias("category"), F.lit(review).alias("needs_review"), F.lit(by).alias("by"))
    nothing = F.struct(none.alias("category"), F.lit(False).alias("needs_review"), F.lit("").alias("by"))
    rung.append((has(OPERATIONAL) & ~_added() | thing, nothing))
    for rule, words, category, objects, siblings in CONTEXT:
        holds = F.coalesce(F.col("object").rlike(objects), F.lit(False)) | F.coalesce(F.arrays_overlap("siblings", F.array(*map(F.lit, siblings))), F.lit(False))
        rung.append((has(words) & (holds if category else ~holds), answer(F.lit(category), False, f"catalogue:{rule}") if category else nothing))
    table = F.create_map(*[F.lit(x) for kv in EXACT.items() for x in kv])
    found = F.filter(F.transform("__keys", lambda k: F.try_element_at(table, k)), lambda c: c.isNotNull())
    rung.append((F.size(found) > 0, answer(F.get(found, 0), False, "classification-table")))
    rung.append((has(MAYBE), answer(F.lit(N.UNKNOWN), True, "classification-table:maybe_pii")))
    out = None
    for cond, what in rung:
        out = (F if out is None else out).when(cond, what)
    general = distinct.withColumn("c", out).filter("c.category is not null").select("__id", "c.*")
    if extra is not None:
        own = distinct.select("__id", F.explode("__keys").alias("key")).join(extra, "key").select("__id", "category", F.lit(False).alias("needs_review"), "by").distinct()
        general = general.join(own.select("__id").distinct(), "__id", "left_anti").unionByName(own)
    return rows.drop("__keys").join(general, "__id").drop("__id")


def _added():
    """Whether a contextual rule that adds a category names the key and holds."""
    out = F.lit(False)
    for _, words, category, objects, siblings in CONTEXT:
        if category:
            holds = F.coalesce(F.col("object").rlike(objects), F.lit(False)) | F.coalesce(F.arrays_overlap("siblings", F.array(*map(F.lit, siblings))), F.lit(False))
            out = out | (F.arrays_overlap("__keys", F.array(*map(F.lit, words))) & holds)
    return out
