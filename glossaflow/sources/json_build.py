"""JSON documents put together from their leaves, and merged, by aggregation and joins.

Leaves are those of json_walk.steps(): (file, path, json), path an array of (key, pos). Objects are written with their keys in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import json_walk


def _quoted(key: Column) -> Column:
    """A string as JSON text."""
    one = F.to_json(F.array(key))
    return one.substr(F.lit(2), F.length(one) - 2)


def assembled(leaves: DataFrame) -> DataFrame:
    """(file, text) of documents from their leaves, from the deepest level up: the parts of each object or array are joined in order."""
    rows = checkpoint(leaves.select("file", "path", "json"))
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        last = F.element_at("path", -1)
        parts = rows.where(F.size("path") == depth).select("file", F.slice("path", 1, depth - 1).alias("path"), last["pos"].alias("pos"), last["key"].alias("key"), "json")
        held = parts.groupBy("file", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "json"))).alias("parts"))
        array = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["json"]), ","), F.lit("]"))
        thing = F.concat(F.lit("{"), F.array_join(F.transform("parts", lambda p: F.concat(_quoted(p["key"]), F.lit(":"), p["json"])), ","), F.lit("}"))
        joined = held.select("file", "path", F.when(F.col("parts")[0]["key"].isNull(), array).otherwise(thing).alias("json"))
        rows = rows.where(F.size("path") < depth).unionByName(joined)
        if depth % 8 == 1:
            rows = checkpoint(rows)
    return rows.select("file", F.col("json").alias("text"))


def _nodes(leaves: DataFrame) -> DataFrame:
    """(file, path, leaf, json, node, kind): each leaf with every node on the way to it, itself last; kind is object, array or scalar."""
    own = F.when(F.col("json") == "{}", "object").when(F.col("json") == "[]", "array").otherwise("scalar")
    below = lambda k: F.when(F.get("path", k)["key"].isNotNull(), "object").otherwise("array")
    ways = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.struct(F.slice("path", F.lit(1), k).alias("node"), F.when(k == F.size("path"), own).otherwise(below(k)).alias("kind")))
    return leaves.select("file", "path", "json", F.explode(ways).alias("x")).select("file", "path", "json", "x.*")


def merged(base: DataFrame, override: DataFrame) -> DataFrame:
    """The leaves of base documents with those of override documents put over them: where both have an object, their keys are
    merged, at any depth; anywhere else the override holds. A file in only one of them stays as it is."""
    over, under = _nodes(override), _nodes(base)
    told = over.select("file", "node", F.col("kind").alias("_kind")).distinct()
    meets = F.col("_kind").isNull() | ((F.col("kind") == "object") & (F.col("_kind") == "object"))
    # an empty object of the base goes where the override has one too, as that brings its own leaf or parts
    itself = (F.size("node") == F.size("path")) & F.col("_kind").isNotNull()
    kept = under.join(told, ["file", "node"], "left").groupBy("file", "path", "json").agg(F.bool_and(meets & ~itself).alias("stays")).where("stays").drop("stays")
    # an empty object of the override adds nothing to an object with parts
    full = under.where((F.col("kind") == "object") & (F.size("path") > F.size("node"))).select("file", F.col("node").alias("path")).distinct()
    bare = override.where("json = '{}'").join(full, ["file", "path"], "left_semi").select("file", "path")
    return kept.unionByName(override.join(bare, ["file", "path"], "left_anti").select("file", "path", "json"))


def merge_documents(base: DataFrame, override: DataFrame) -> DataFrame:
    """(file, text) of documents (file, text) with override documents put over them; malformed ones count as missing."""
    parsed = lambda d: json_walk.steps(d.select("file", json_walk.parsed(F.col("text")).alias("value")))
    return assembled(merged(parsed(base), parsed(override)))
