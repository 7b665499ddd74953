"""Typedef chains and the owners of object chains, for batches: every hop is one join."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import PRIMITIVE_NAMES
from ..functions.tags import SUFFIXES
from ..storage import settled
from .lookup import typedef_targets


#: Typedef hops in all up to which chains are followed on the driver and broadcast; beyond it, one join follows each hop.
FEW_HOPS = 200_000


def typedef_closure(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(tag, hop, depth): each distinct ``tags(tag)`` and the typedef targets it leads to; cycles end."""
    targets = settled(typedef_targets(aliases), "targets")
    known = tags.select("tag").distinct()
    chains = _chains(targets)
    if chains is None:
        return _closure_by_joins(known, targets)
    here = known.sparkSession.createDataFrame(chains, "name string, hops array<string>")
    hops = known.join(F.broadcast(here), F.col("tag") == F.col("name"), "left")
    return hops.select("tag", F.posexplode(F.concat(F.array("tag"), F.coalesce("hops", F.array().cast("array<string>")))).alias("depth", "hop")).select("tag", "hop", "depth")


def _chains(targets: DataFrame) -> list[tuple[str, list[str]]] | None:
    """The hops of every typedef name, or None if there are more of them than a driver should hold."""
    if targets.count() > FEW_HOPS:
        return None
    to = {r["name"]: r["target"] for r in targets.collect()}
    out, held = [], 0
    for name in to:
        path = [name]
        while (nxt := to.get(path[-1])) is not None and nxt not in path:
            path.append(nxt)
            held += 1
            if held > FEW_HOPS:
                return None
        out.append((name, path[1:]))
    return out


def _closure_by_joins(known: DataFrame, targets: DataFrame) -> DataFrame:
    level = settled(known, "tags").select("tag", F.col("tag").alias("hop"), F.lit(0).alias("depth"), F.array("tag").alias("path"))
    out = level
    for depth in count(1):
        step = level.join(targets, F.col("hop") == F.col("name")).where(~F.array_contains("path", F.col("target")))
        level = settled(step.select("tag", F.col("target").alias("hop"), F.lit(depth).alias("depth"),
                                    F.concat("path", F.array("target")).alias("path")), "tag-hops")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("path")


def candidate_tags(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(tag, candidate, prio): hops in order, then the one-letter suffix variants of every hop; the earliest place wins."""
    hops = typedef_closure(tags, aliases)
    base = F.regexp_extract("hop", r"(?s)^(.*)_[a-z]\z", 1)
    has = F.col("hop").rlike(r"(?s)^.*_[a-z]\z")
    forms = F.when(has, F.array(*(F.concat(base, F.lit(s)) for s in SUFFIXES))).otherwise(F.array().cast("array<string>"))
    variants = hops.select("tag", "depth", F.posexplode(forms).alias("nth", "candidate"))
    ranked = hops.select("tag", F.col("hop").alias("candidate"), F.struct(F.lit(0).alias("late"), "depth", F.lit(0).alias("nth")).alias("place")).unionByName(
        variants.select("tag", "candidate", F.struct(F.lit(1).alias("late"), "depth", "nth").alias("place")))
    return ranked.groupBy("tag", "candidate").agg(F.min("place").alias("prio"))


def aggregate_tag(text) -> F.Column:
    """Aggregate that a type text names, in built-in functions; null for primitives."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?s)^([^<]*)", 1), r"[*&]", " "), r"\s+", " "))
    words = F.filter(F.split(bare, " "), lambda w: (w != "") & ~w.isin("const", "volatile"))
    at = F.array_position(F.transform(words, lambda w: w.isin("struct", "union", "enum", "class")), True)
    primitives = sorted(PRIMITIVE_NAMES)
    named = F.when(at > 0, F.get(words, at.cast("int"))).otherwise(
        F.when(F.exists(words, lambda w: ~w.isin(*primitives)), F.element_at(words, -1)))
    last = F.element_at(F.split(named, "::"), -1)
    return F.when((at == 0) & last.isin(*primitives), None).otherwise(last)


def fields_of_type(rows: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Of ``rows(key..., tag, scope, ...)`` those owned by the first candidate of their tag that owns any."""
    c = candidates.select(F.col("tag").alias("tag_"), F.col("candidate").alias("scope"), "prio")
    matched = rows.join(c, (rows["tag"] == F.col("tag_")) & (rows["scope"] == c["scope"])).drop(c["scope"]).drop("tag_")
    best = matched.groupBy(*key).agg(F.min("prio").alias("best_"))
    return matched.join(best, key).where(F.col("prio") == F.col("best_")).drop("prio", "best_")


def chain_owners(chains: DataFrame, symbols: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``chain_owner`` to distinct ``chains(file, func, chain array)``: the aggregate that the chain leads to, or null.

    The root is a marked type, the return type of a marked call, a local of the function, or a defined global variable;
    every further element is a field of what came before. One join for each hop, up to the longest chain.
    """
    # The key is the place itself, as a struct: a hash would mix up places among very many, and its nulls compare equal.
    keyed = chains.select("file", "func", "chain").distinct().withColumn("k", F.struct("file", "func", "chain"))
    root = F.get("chain", F.lit(0))
    place = F.struct("file", "ord")
    local_types = local_rows.where("data_type <> ''").groupBy("file", "func", "name").agg(F.min_by("data_type", "ord").alias("local_type"))
    global_types = symbols.where("kind = 'global_variable' and is_definition and data_type <> ''").groupBy("name").agg(
        F.min_by("data_type", place).alias("global_type"))
    returns = symbols.where("kind in ('function', 'prototype') and return_type <> ''").groupBy("name").agg(
        F.min_by("return_type", F.struct(~F.col("is_definition"), place)).alias("return_type"))
    named = keyed.withColumn("root", root).withColumn("called", F.when(root.startswith("@call:"), F.substr(root, F.lit(7))))
    typed = (named.join(local_types.withColumnsRenamed({"file": "f_", "func": "g_", "name": "n_"}),
                        (F.col("file") == F.col("f_")) & (F.col("func") == F.col("g_")) & (F.col("root") == F.col("n_")), "left")
             .join(global_types.withColumnRenamed("name", "v_"), F.col("root") == F.col("v_"), "left")
             .join(returns.withColumnRenamed("name", "c_"), F.col("called") == F.col("c_"), "left"))
    tag = (F.when(root.startswith("@type:"), F.substr(root, F.lit(7))).when(F.col("called").isNotNull(), aggregate_tag(F.col("return_type")))
           .otherwise(F.coalesce("local_type", "global_type")))
    state = settled(typed.select("k", tag.alias("tag")), "chains")
    longest = state.agg(F.max(F.size("k.chain"))).first()[0] or 0
    fields = symbols.where("kind = 'field' and is_definition").select(F.col("file").alias("ff"), "ord", "name", "scope", "data_type")
    for hop in range(1, longest):
        element = F.get("k.chain", F.lit(hop))
        going = state.where((F.size("k.chain") > hop) & F.col("tag").isNotNull())
        candidates = candidate_tags(going, aliases)
        owned = fields_of_type(going.join(fields, element == F.col("name")).select("k", "tag", "scope", "ff", "ord", "data_type"), candidates, ["k"])
        reached = owned.where("data_type <> ''").groupBy("k").agg(F.min_by("data_type", F.struct("ff", "ord")).alias("next_"))
        state = settled(state.join(reached, "k", "left").select(
            "k", F.when(F.size("k.chain") > hop, F.col("next_")).otherwise(F.col("tag")).alias("tag")), "chains")
    return state.select("k.*", F.col("tag").alias("chain_owner"))
