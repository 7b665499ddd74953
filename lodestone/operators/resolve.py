"""Resolution of cursors, in batches: definitions, declarations, references, narrowed by role, owner, arity and text.

A request is a row with ``req_id``; every narrowing is a flag over the candidates of a request and a window that asks
whether any candidate has it. What cannot be resolved is kept: a narrowing that would leave nothing leaves its input, save
that a member access never resolves to what cannot be a member. A single cursor is a batch of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..session import ship_package
from ..storage import settled
from .lookup import ROLE_KINDS, ref_at
from .types import candidate_tags, chain_owners

FUNCTION_KINDS = ("function", "prototype", "method")
MEMBER_KINDS = ("field", "member")
HIT_COLUMNS = ["file", "line", "col", "kind", "name"]


def known_role(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLE_KINDS), F.lit(False))


def role_admits(role: Column, kind: Column) -> Column:
    """True if a role admits a kind; an unknown role admits all."""
    out = F.lit(True)
    for r, kinds in ROLE_KINDS.items():
        out = F.when(role == r, kind.isin(*kinds)).otherwise(out)
    return out


def keep_if_any(rows: DataFrame, flag: Column, keys: list[str] | None = None) -> DataFrame:
    """The flagged rows of each request that has any; all rows of the others."""
    w = Window.partitionBy(*(keys or ["req_id"]))
    flag = F.coalesce(flag, F.lit(False))
    return rows.withColumn("flag_", flag).withColumn("any_", F.max("flag_").over(w)).where("flag_ or not any_").drop("flag_", "any_")


def narrow_by_arity(rows: DataFrame) -> DataFrame:
    """With a known ``call_arity`` and two functions or more, drops functions of another count, unless that drops all."""
    w = Window.partitionBy("req_id")
    fn = F.col("kind").isin(*FUNCTION_KINDS)
    fits = F.col("arity").isNull() | F.when(F.col("param_types").endswith("..."), F.col("call_arity") >= F.col("arity")).otherwise(
        F.col("call_arity") == F.col("arity"))
    counted = rows.withColumns({"fn_": fn, "fit_": fn & fits}).withColumns(
        {"n_fn_": F.sum(F.col("fn_").cast("int")).over(w), "n_fit_": F.sum(F.col("fit_").cast("int")).over(w)})
    drop = F.col("call_arity").isNotNull() & (F.col("n_fn_") > 1) & (F.col("n_fit_") > 0) & F.col("fn_") & ~F.col("fit_")
    return counted.where(~drop).drop("fn_", "fit_", "n_fn_", "n_fit_")


def narrow_by_member_access(rows: DataFrame, access: Column) -> DataFrame:
    """A member access takes members and macros only; a bare name takes no members if there is anything else."""
    member = F.col("kind").isin(*MEMBER_KINDS)
    kept = rows.where(~access | member | (F.col("kind") == "macro"))
    return keep_if_any(kept, access | ~member)


def narrow_call_target(rows: DataFrame, called: Column) -> DataFrame:
    """A called bare name takes no fields if there is anything else."""
    return keep_if_any(rows, ~called | (F.col("kind") != "field"))


def self_guard(rows: DataFrame) -> DataFrame:
    """Candidates at the cursor's own line, if there are any."""
    return keep_if_any(rows, (F.col("file") == F.col("req_file")) & (F.col("line") == F.col("req_line")))


def _owned(rows: DataFrame, tag: str, tags: DataFrame, name: str) -> DataFrame:
    """Adds flag ``name``: the row's scope is the first candidate of the request's ``tag`` that owns any candidate."""
    tags = tags.select(F.col("tag").alias("tag_"), F.col("candidate").alias("candidate_"), F.col("prio").alias("prio_"))
    w = Window.partitionBy("req_id")
    joined = rows.join(tags, (F.col(tag) == F.col("tag_")) & (F.col("scope") == F.col("candidate_")), "left")
    return joined.withColumn(name, F.coalesce(F.col("prio_") == F.min("prio_").over(w), F.lit(False))).drop("tag_", "candidate_", "prio_")


def request_chain() -> Column:
    """Object chain of a request: that of its reference, or else of the text if the function is known."""
    texts = F.when(F.size("member_chain") > 0, F.col("member_chain")).when(F.col("object_name").isNotNull(), F.array("object_name"))
    return F.when(F.size("obj_chain") > 0, F.col("obj_chain")).when(F.col("func").isNotNull(), texts)


def with_chain_owner(requests: DataFrame, symbols: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``chain_owner`` to field requests with an object chain, each distinct chain resolved once."""
    keyed = settled(requests, "requests").withColumn("chain_", F.when(F.col("role") == "field", request_chain()))
    chains = keyed.where("chain_ is not null").select(F.col("req_file").alias("file"), "func", F.col("chain_").alias("chain"))
    owners = chain_owners(chains, symbols, local_rows, aliases).select(
        F.col("file").alias("f_"), F.col("func").alias("g_"), F.col("chain").alias("c_"), "chain_owner")
    return settled(keyed.join(owners, (F.col("req_file") == F.col("f_")) & F.col("func").eqNullSafe(F.col("g_")) & (F.col("chain_") == F.col("c_")),
                              "left").drop("f_", "g_", "c_", "chain_"), "requests")


def candidates_at(requests: DataFrame, symbols: DataFrame, local_rows: DataFrame, aliases: DataFrame, definition: bool) -> DataFrame:
    """Definitions (or declarations) of ``requests``, narrowed by role, member access and arity.

    Requests have req_id, word, role, req_file, req_line, func, owner, obj_chain, member_chain, object_name,
    is_member_access and call_arity, and ``chain_owner`` from ``with_chain_owner``.
    """
    rows = requests.join(symbols.where(F.col("is_definition") == definition), F.col("word") == F.col("name")).where(
        role_admits(F.col("role"), F.col("kind")))
    is_field = F.col("role") == "field"
    unknown_access = ~known_role(F.col("role")) & F.coalesce("is_member_access", F.lit(False))
    rows = rows.where(~unknown_access | F.col("kind").isin(*MEMBER_KINDS, "macro"))
    tags = candidate_tags(requests.where("role = 'field'").select(F.explode(F.array("owner", "chain_owner")).alias("tag")).where("tag <> ''"), aliases)
    rows = _owned(_owned(rows, "owner", tags, "by_owner"), "chain_owner", tags, "by_chain")
    w = Window.partitionBy("req_id")
    flagged = rows.withColumns({"any_owner": F.max("by_owner").over(w), "any_chain": F.max("by_chain").over(w), "n_": F.count("*").over(w)})
    keep = F.when(F.col("any_owner"), F.col("by_owner")).when((F.col("n_") > 1) & F.col("any_chain"), F.col("by_chain")).otherwise(True)
    return narrow_by_arity(flagged.where(~F.coalesce(is_field, F.lit(False)) | keep).drop("by_owner", "by_chain", "any_owner", "any_chain", "n_"))


def cursor_contexts(cursors: DataFrame) -> DataFrame:
    """``cursors(req_id, file, line, character, line_text)`` with what the text says: word, place, access, chain, arity, tags."""
    ship_package(cursors.sparkSession)

    @F.pandas_udf("word string, start int, end int, is_member_access boolean, object_name string, member_chain array<string>, call_arity int, "
                  "tag_kinds array<string>, called boolean, guard boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lines, cols in batches:
            rows = []
            for line, col in zip(lines, cols, strict=True):
                c = lexical.symbol_context(line or "", int(col))
                before, after = (line or "")[: max(c.start, 0)], (line or "")[max(c.end, 0) :]
                rows.append((c.word or None, c.start, c.end, c.is_member_access, c.object_name, c.member_chain, c.call_arity,
                             lexical.tag_kinds_before(before), lexical.is_call_target(before, after), lexical.is_macro_guard(line or "", c.word)))
            out = pd.DataFrame(rows, columns=["word", "start", "end", "is_member_access", "object_name", "member_chain", "call_arity", "tag_kinds",
                                              "called", "guard"])
            yield out.assign(call_arity=out["call_arity"].astype("Int32"))

    at = cursors.withColumn("ctx", of("line_text", "character"))
    return at.select("req_id", F.col("file").alias("req_file"), F.col("line").alias("req_line"), "ctx.*")


def requests_of(contexts: DataFrame, refs: DataFrame) -> DataFrame:
    """Contexts with the reference row at their place: role, scope and owner facts."""
    cursors = contexts.where("word is not null").select(
        "req_id", F.col("req_file").alias("file"), F.col("req_line").alias("line"), F.col("start").alias("col"), F.col("word").alias("name"))
    at = ref_at(refs, cursors).select("req_id", F.col("enclosing_func").alias("func"), F.coalesce("is_local", F.lit(False)).alias("is_local"),
                                      F.coalesce("role", F.lit("")).alias("role"), F.coalesce("owner", F.lit("")).alias("owner"), "obj_chain",
                                      "ref_source", (F.col("ref_source").isNotNull()).alias("has_ref"))
    return contexts.join(at, "req_id")


def local_hits(requests: DataFrame, local_rows: DataFrame) -> DataFrame:
    """Locals that local requests denote."""
    rows = local_rows.select("file", "name", "func", "line", "col", "kind", "ord", "data_type", "decl_type")
    mine = requests.where("is_local and func is not null").select("req_id", "word", "req_file", F.col("func").alias("f_"))
    return mine.join(rows, (F.col("word") == F.col("name")) & (F.col("req_file") == F.col("file")) & (F.col("f_") == F.col("func"))).drop("f_")


def _by_text(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolution without a role: tag keyword, own line, call target and member access, definitions before declarations."""
    rows = requests.join(symbols, F.col("word") == F.col("name"))
    tagged = rows.where("tag_kinds is not null").where(F.expr("array_contains(tag_kinds, kind)"))
    tagged = keep_if_any(tagged, F.col("is_definition")).select("req_id", *HIT_COLUMNS)
    plain = rows.where("tag_kinds is null")
    own = (F.col("file") == F.col("req_file")) & (F.col("line") == F.col("req_line"))
    ranked = None
    for rank, definition in ((1, True), (3, False)):
        part = plain.where(F.col("is_definition") == definition)
        fits = narrow_by_member_access(narrow_call_target(part, F.col("called")), F.col("is_member_access"))
        for step, some in ((rank, part.where(own)), (rank + 1, fits)):
            one = some.select("req_id", *HIT_COLUMNS, F.lit(step).alias("step"))
            ranked = one if ranked is None else ranked.unionByName(one)
    best = Window.partitionBy("req_id")
    chosen = ranked.withColumn("best_", F.min("step").over(best)).where("step = best_").select("req_id", *HIT_COLUMNS)
    return tagged.unionByName(chosen)


def goto_definition(cursors: DataFrame, symbols: DataFrame, refs: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(req_id, word, file, line, col, kind, name, status) of ``cursors(req_id, file, line, character, line_text)``.

    status: ``hit``; ``blocked`` for an undefined upper-case macro on a conditional line; ``none``; ``abstain`` where
    there is no word to look up.
    """
    contexts = cursor_contexts(cursors)
    requests = settled(requests_of(contexts, refs), "requests")
    found = local_hits(requests, local_rows).select("req_id", *HIT_COLUMNS)
    rest = requests.join(found.select("req_id").distinct(), "req_id", "left_anti")
    structural = (F.coalesce("ref_source", F.lit("")) != "grep") & known_role(F.col("role"))
    by_role = with_chain_owner(rest.where(structural).withColumn("is_member_access", F.lit(False)), symbols, local_rows, aliases)
    defs = self_guard(candidates_at(by_role, symbols, local_rows, aliases, True)).select("req_id", *HIT_COLUMNS, F.lit(1).alias("step"))
    decls = self_guard(candidates_at(by_role, symbols, local_rows, aliases, False)).select("req_id", *HIT_COLUMNS, F.lit(2).alias("step"))
    w = Window.partitionBy("req_id")
    found = found.unionByName(defs.unionByName(decls).withColumn("best_", F.min("step").over(w)).where("step = best_").select("req_id", *HIT_COLUMNS))
    found = found.unionByName(_by_text(rest.where(~structural), symbols))
    status = (F.when(F.col("name").isNotNull(), "hit").when(F.col("word").isNull(), "abstain").when(F.col("guard"), "blocked").otherwise("none"))
    return contexts.select("req_id", "word", "guard").join(found, "req_id", "left").select("req_id", "word", *HIT_COLUMNS, status.alias("status"))


def resolved_symbols(requests: DataFrame, symbols: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Definitions and declarations that requests denote, those at the cursor's own line if there are any."""
    ready = requests if "chain_owner" in requests.columns else with_chain_owner(requests, symbols, local_rows, aliases)
    both = candidates_at(ready, symbols, local_rows, aliases, True).unionByName(candidates_at(ready, symbols, local_rows, aliases, False))
    return self_guard(both)


def references_at(requests: DataFrame, symbols: DataFrame, refs: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(req_id, file, line, col, role) of what requests refer to: within the function for locals; for a field, without
    the references that are known to belong to another aggregate."""
    ready = requests if "chain_owner" in requests.columns else with_chain_owner(requests, symbols, local_rows, aliases)
    is_local = F.col("is_local") & F.col("func").isNotNull()
    r = refs.select("file", "line", "col", "name", F.col("role").alias("ref_role"), F.col("is_local").alias("ref_local"), "enclosing_func",
                    F.col("owner").alias("ref_owner"), F.col("obj_chain").alias("ref_chain"))
    local = ready.where(is_local).select("req_id", "word", "req_file", "func").join(
        r, (F.col("word") == F.col("name")) & (F.col("req_file") == F.col("file")) & (F.col("func") == F.col("enclosing_func")) & F.col("ref_local"))
    out = local.select("req_id", "file", "line", "col", F.col("ref_role").alias("role"))
    admits = F.when(F.col("role") == "field", F.col("ref_role") == "field").when(known_role(F.col("role")), F.col("ref_role").isin("")
                                                                               | (F.col("ref_role") == F.col("role"))).otherwise(True)
    wide = ready.where(~is_local)
    unique = candidates_at(wide.where("role = 'field'"), symbols, local_rows, aliases, True).where("scope <> ''").groupBy("req_id").agg(
        F.collect_set("scope").alias("scopes_"))
    target = F.coalesce(F.nullif("owner", F.lit("")), "chain_owner", F.when(F.size("scopes_") == 1, F.get("scopes_", F.lit(0))))
    aimed = wide.join(unique, "req_id", "left").select("req_id", "word", "role", F.when(F.col("role") == "field", target).alias("target"))
    pairs = settled(aimed.join(r.where(~F.col("ref_local")), F.col("word") == F.col("name")).where(admits), "pairs")
    chains = pairs.where("target is not null and coalesce(ref_owner, '') = '' and size(ref_chain) > 0").select(
        "file", F.col("enclosing_func").alias("func"), F.col("ref_chain").alias("chain"))
    owners = chain_owners(chains, symbols, local_rows, aliases).select(
        F.col("file").alias("f_"), F.col("func").alias("g_"), F.col("chain").alias("c_"), F.col("chain_owner").alias("late_owner"))
    owned = pairs.join(owners, (F.col("file") == F.col("f_")) & F.col("enclosing_func").eqNullSafe(F.col("g_")) & (F.col("ref_chain") == F.col("c_")),
                       "left").withColumn("own_", F.coalesce(F.nullif("ref_owner", F.lit("")), "late_owner"))
    owned = settled(owned, "pairs")
    # Every name that an owner or a target may go by: a pair matches if either is among the other's.
    tags = candidate_tags(owned.where("target is not null").select(F.explode(F.array_compact(F.array("own_", "target"))).alias("tag")), aliases).select(
        F.col("tag").alias("t_"), F.col("candidate").alias("n_"))
    questions = owned.where("target is not null and own_ is not null").select("own_", "target").distinct()
    one = questions.join(tags, F.col("own_") == F.col("t_")).where("n_ = target").select("own_", "target")
    two = questions.join(tags, F.col("target") == F.col("t_")).where("n_ = own_").select("own_", "target")
    same = one.unionByName(two).distinct().withColumn("match_", F.lit(True))
    kept = owned.join(same, ["own_", "target"], "left").where("target is null or own_ is null or match_")
    return out.unionByName(kept.select("req_id", "file", "line", "col", F.col("ref_role").alias("role")))


def resolve_references(cursors: DataFrame, symbols: DataFrame, refs: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """References of cursors, with columns never below 0."""
    requests = requests_of(cursor_contexts(cursors), refs)
    return references_at(requests, symbols, refs, local_rows, aliases).withColumn("col", F.greatest("col", F.lit(0)))
