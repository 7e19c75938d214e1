"""Categories: user rules first, then the default of the payment method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..schemas import RULES

# Default category of each payment method: fixed values.
DEFAULT_CATEGORIES = {
    "transferencia_recibida": "Ingresos",
    "credito_inmediato": "Ingresos",
    "pago_movil": "Pagos móviles",
    "comision_pago_movil": "Comisiones",
    "comision_credito_inmediato": "Comisiones",
    "comision": "Comisiones",
    "transferencia_enviada": "Transferencias",
    "punto_de_venta": "Consumos con tarjeta",
    "tarjeta_debito": "Consumos con tarjeta",
    "pago_terceros": "Pagos a terceros",
    "pago_servicios": "Servicios",
    "mantenimiento": "Cargos bancarios",
    "emision_estado": "Cargos bancarios",
    "mensajeria": "Cargos bancarios",
    "impuesto": "Impuestos",
    "cheque": "Cheques",
    "otro": "Otros",
}
OTHER = "Otros"


def default_category(method):
    pairs = F.create_map(*[F.lit(x) for kv in DEFAULT_CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, method), F.lit(OTHER))


#: Letters of a pattern's beginning.
LETTERS = 3
#: Patterns of so many bytes at most (some 400,000 rules) are broadcast; more are shuffled, and the substrings to them.
BROADCAST = 32 << 20


def rule_hits(ops: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """For each operation (by id and search_key) that a rule matches, the first rule by priority, then id: column _rule.

    Patterns are looked up whole: of a key's substrings those are joined by equality that are as long as some pattern which begins with
    the same LETTERS letters (the whole pattern, if it is shorter). So work follows the keys and the lengths of patterns, for five rules as
    for fifty thousand. Joins say which side moves: Spark takes a key's substrings for no larger than the key, and would broadcast them.
    """
    rules = rules.select("id", "category", F.coalesce("priority", F.lit(100)).alias("priority"), normalize_key(F.col("pattern")).alias("_key")).filter("_key <> ''")
    found = rules.select(F.collect_set(F.least(F.length("_key"), F.lit(LETTERS))), F.sum(F.length("_key") + F.coalesce(F.octet_length("category"), F.lit(0)) + 64)).first()
    patterns = rules.groupBy("_key").agg(F.min(F.struct("priority", F.col("id").alias("rule"), "category")).alias("_rule"))
    lengths = rules.groupBy(F.substring("_key", 1, LETTERS).alias("_begin")).agg(F.collect_set(F.length("_key")).alias("_lengths"))  # 48,000 beginnings at the most
    keys = ops.select(id_col, "search_key", F.explode(F.when(F.length("search_key") > 0, F.sequence(F.lit(1), F.length("search_key")))).alias("_at"))
    begins = [F.substring("search_key", F.col("_at"), F.lit(k)) for k in sorted(found[0])]  # three at the most
    keys = keys.withColumn("_begin", begins[0] if len(begins) == 1 else F.explode(F.array(*begins).cast("array<string>")))
    keys = keys.join(F.broadcast(lengths), "_begin").select(id_col, "search_key", "_at", F.explode("_lengths").alias("_length"))
    keys = keys.filter("_at + _length <= length(search_key) + 1").select(id_col, "search_key", F.substring("search_key", F.col("_at"), F.col("_length")).alias("_key"))
    hits = keys.join(patterns.hint("broadcast" if (found[1] or 0) <= BROADCAST else "merge"), "_key")
    return hits.groupBy(id_col, "search_key").agg(F.min("_rule").alias("_rule"))


def categorize(ops: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """ops (id, method, search_key) with column category.

    rules (id, pattern, category, priority): the first by priority, then id, whose normalised pattern
    is part of the search key wins; without one the payment method's default counts.
    """
    hits = rule_hits(ops, rules, id_col).withColumnsRenamed({id_col: "_id", "search_key": "_search"})
    out = ops.join(hits.hint("merge"), (F.col(id_col) == F.col("_id")) & (F.col("search_key") == F.col("_search")), "left")
    return out.withColumn("category", F.coalesce("_rule.category", default_category(F.col("method")))).drop("_rule", "_id", "_search")


def listed_rules(rules: DataFrame) -> DataFrame:
    """Rules in the order in which they are tried."""
    return rules.orderBy("priority", "id")


def add_rule(rules: DataFrame, pattern: str, category: str, priority: int = 100) -> DataFrame:
    """rules with one more, after validation of its fields. Categories follow when they are next derived."""
    if not 1 <= len(pattern) <= 200 or not 1 <= len(category) <= 60 or not 0 <= priority <= 999:
        raise ValueError("pattern of 1-200, category of 1-60 letters, priority of 0-999")
    last = rules.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return rules.select("id", "pattern", "category", "priority").unionByName(rules.sparkSession.createDataFrame([(last + 1, pattern, category, priority)], RULES))


def remove_rule(rules: DataFrame, rule_id: int) -> DataFrame:
    """rules without the one of an id; an unknown id is an error."""
    if rules.filter(F.col("id") == rule_id).isEmpty():
        raise KeyError(f"no rule {rule_id}")
    return rules.filter(F.col("id") != rule_id)


def category_list(ops: DataFrame) -> DataFrame:
    """Categories in use and default ones, sorted."""
    spark = ops.sparkSession
    defaults = spark.createDataFrame([(c,) for c in sorted(set(DEFAULT_CATEGORIES.values()))], "category string")
    return ops.select("category").filter("category is not null").unionByName(defaults).distinct().orderBy("category")
