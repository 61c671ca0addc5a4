"""Problem 3, deeply nested semi-structured records: flat tables by higher-order projection.

A payload is parsed once into a variant. Nested transforms walk its arrays and attach the ancestor's place to every record, flatten
joins the arrays, and one inline per target table emits the rows: no join, no shuffle, no schema inference.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    entity: str
    camel: str


@dataclass(frozen=True)
class Entity:
    entity: str
    root: str
    camel: str
    children: tuple[Child, ...] = field(default=())


#: The nested collections of a brain document.
BRAIN = (
    Entity("domain", "model", "domains", (Child("domain_path", "paths"),)),
    Entity("entrypoint", "model", "entrypoints"),
    Entity("dependency", "model", "dependencies", (Child("dependency_evidence", "evidence"),)),
    Entity("relationship", "model", "relationships"),
    Entity("architecture", "model", "architectures", (Child("architecture_rule", "matchedRules"),)),
    Entity("component", "brain", "components", (Child("component_dependency", "dependencyIds"), Child("component_evidence", "evidenceIds"))),
    Entity("claim", "brain", "claims", (Child("claim_evidence", "evidenceIds"), Child("claim_contradiction", "contradictionIds"))),
    Entity("evidence", "brain", "evidence"),
)


def snake(camel: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in camel)


def _present(v: Column) -> Column:
    """A JSON null is an absent value."""
    return F.when(~F.is_variant_null(v), v)


def member(v: Column, camel: str, kind: str = "variant") -> Column:
    """A field under its camel or its snake name."""
    names = dict.fromkeys([camel, snake(camel)])
    return F.coalesce(*[F.try_variant_get(_present(F.try_variant_get(v, f"$.{n}", "variant")), "$", kind) for n in names])


def elements(v: Column) -> Column:
    """The elements of an array; any other value is its own only element, null and absent have none."""
    v = _present(v)
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))


def text(v: Column) -> Column:
    """Scalars as text, objects and arrays as JSON."""
    return F.try_variant_get(v, "$", "string")


def strict_json(text: Column | str) -> Column:
    """A JSON text as a variant; null if it is none. Spark's parser stops at the end of the first value, so a value with something behind
    it would pass: it is parsed as the only element of an array and as the only field of an object, of which one shows any rest."""
    text = F.col(text) if isinstance(text, str) else text
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    field = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(field.isNotNull() & (F.size(items) == 1), items[0])


def parsed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``brain`` and ``model`` (variants, null where there is none) to rows with a JSON text.

    Null, broken and non-object payloads have no brain. A wrapper's object ``brain`` goes before the payload itself; a model given as
    JSON text is parsed in turn. Of a field that comes twice the last counts (a setting of the session, made here).
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    df = df.withColumn("__v", strict_json(payload))
    df = df.withColumn("__inner", F.try_variant_get("__v", "$.brain", "variant"))
    df = df.withColumn("brain", F.when(is_object(F.col("__inner")), F.col("__inner")).when(is_object(F.col("__v")), F.col("__v")))
    df = df.withColumn("__model", F.try_variant_get("brain", "$.model", "variant"))
    model = F.when(is_object(F.col("__model")), F.col("__model")).otherwise(strict_json(F.try_variant_get("__model", "$", "string")))
    return df.withColumn("model", model).drop("__v", "__inner", "__model")


def _row(entity: str, parent: Column, pos: Column, item: Column) -> Column:
    kind = lambda c: c.cast("long")
    return F.struct(F.lit(entity).alias("entity"), kind(parent).alias("parent_pos"), kind(pos).alias("pos"), item.alias("item"))


def _records(e: Entity):
    return lambda r, i: F.when(_present(r).isNotNull(), _row(e.entity, F.lit(-1), i, F.coalesce(member(r, "id", "string"), F.lit(""))))


def _strings(c: Child):
    return lambda r, i: F.transform(elements(member(r, c.camel)), lambda x, j: F.when(_present(x).isNotNull(), _row(c.entity, i, j, text(x))))


def flat_items(df: DataFrame, key: str, payload: str = "payload", spec: tuple[Entity, ...] = BRAIN) -> DataFrame:
    """Every record and every string below it as a row: key, entity, parent_pos, pos, item.

    A null element is no record but keeps its place; a record's item is its id ('' if absent or null), a string's item the string.
    Payloads that are null, empty or broken give no rows.
    """
    df = parsed(df.select(key, payload), payload)
    lists = {f"l_{e.entity}": elements(F.try_variant_get(e.root, f"$.{e.camel}", "variant")) for e in spec}
    df = df.select(key, *[c.alias(n) for n, c in lists.items()])
    arrays = []
    for e in spec:
        arrays.append(F.transform(f"l_{e.entity}", _records(e)))
        # A null element of the outer array, or no array in it, contributes nothing.
        arrays.extend(F.flatten(F.filter(F.transform(f"l_{e.entity}", _strings(c)), lambda a: a.isNotNull())) for c in e.children)
    rows = F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
    return df.select(key, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def flat_table(df: DataFrame, key: str, entity: str, fields: dict[str, str], payload: str = "payload", spec: tuple[Entity, ...] = BRAIN) -> DataFrame:
    """One target table: key, pos and the given scalar fields (name of the output column: camel name, with :double behind it for a number)
    of each record of an entity."""
    e = next(x for x in spec if x.entity == entity)
    df = parsed(df.select(key, payload), payload).select(key, elements(F.try_variant_get(e.root, f"$.{e.camel}", "variant")).alias("__l"))
    rows = F.transform(
        "__l",
        lambda r, i: F.when(
            _present(r).isNotNull(), F.struct(i.cast("long").alias("pos"), *[member(r, c.partition(":")[0], c.partition(":")[2] or "string").alias(n) for n, c in fields.items()])
        ),
    )
    return df.select(key, F.inline(F.filter(rows, lambda r: r.isNotNull())))
