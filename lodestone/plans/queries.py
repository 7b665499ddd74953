"""Registered queries of the code index, each over its whole relation, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.file_index import content_hash
from ..operators import graph, lookup, maintenance, report, resolve, search, text, types
from ..session import ship_package
from ..sources import exclusion
from ..storage import settled, shared_folder
from ..streaming.change_feed import replay
from . import fixtures, golden
from .relations import FILES, PREFIX, relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = PREFIX + sql
        return f

    return register


def _(spark: SparkSession, sf_dir: str, *names: str):
    got = [relation(spark, sf_dir, n) for n in names]
    return got[0] if len(got) == 1 else got


_SYM = "id, file, name, kind, line, col, is_definition"
_COLS = _SYM.split(", ")


@query("find_symbols", f"select s.{_SYM.replace(', ', ', s.')}, f.path from symbols s join files f on s.file_id = f.id where s.name = 'small_ring'")
def _find_symbols(spark, sf):
    symbols, files = _(spark, sf, "symbols", "files")
    named = lookup.find_symbols(symbols, "small_ring")
    return named.join(files.select(F.col("id").alias("fid"), "path"), F.col("file_id") == F.col("fid")).select(*_COLS, "path")


@query("find_definitions_by_kind", f"select {_SYM} from symbols where name = 'small_ring' and is_definition and kind in ('field', 'macro')")
def _find_definitions(spark, sf):
    return lookup.find_definitions(_(spark, sf, "symbols"), "small_ring", ["field", "macro"]).select(*_COLS)


@query("find_declarations", f"select {_SYM} from symbols where name = 'small_ring' and not is_definition")
def _find_declarations(spark, sf):
    return lookup.find_declarations(_(spark, sf, "symbols"), "small_ring").select(*_COLS)


_REF = "ord, file, name, line, col, role, owner"
_RCOLS = _REF.split(", ")
for _name, _role, _where in (("references_role_exact_field", "field", "role = 'field'"), ("references_role_best_effort", "value", "role in ('value', '')"),
                             ("references_no_role", None, "true")):
    query(_name, f"select {_REF} from refs where name = 'small_ring' and not is_local and {_where}")(
        lambda spark, sf, role=_role: lookup.find_references(_(spark, sf, "refs"), "small_ring", role).select(*_RCOLS))


@query("local_references", f"select {_REF} from refs where name = 'small_ring' and is_local and file = 'f4.c' and enclosing_func is not null")
def _local_references(spark, sf):
    return lookup.find_local_references(_(spark, sf, "refs"), "small_ring", "f4.c").select(*_RCOLS)


_CALL = "ord, file, caller, callee, line, col"
_CCOLS = _CALL.split(", ")
query("callers", f"select {_CALL} from calls where callee = 'fn7'")(lambda s, d: lookup.find_callers(_(s, d, "calls"), "fn7").select(*_CCOLS))
query("callees", f"select {_CALL} from calls where caller = 'fn7'")(lambda s, d: lookup.find_callees(_(s, d, "calls"), "fn7").select(*_CCOLS))


@query("callers_file_scope", "select coalesce(caller, '(file scope)') as caller, count(*) as n from calls where callee = 'fn7' group by 1")
def _callers_file_scope(spark, sf):
    rows = lookup.find_callers(_(spark, sf, "calls"), "fn7")
    return rows.groupBy(F.coalesce("caller", F.lit(graph.FILE_SCOPE)).alias("caller")).agg(F.count("*").alias("n"))


_CURSOR = """cur as (select distinct p_partkey as req_id, 'f' || cast(p_partkey % 97 as string) || '.c' as file, replace(p_name, ' ', '_') as name, p_size % 9 as line,
  cast(p_partkey % 50 as int) as col from part)"""


def _cursors(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select(F.col("p_partkey").alias("req_id"), F.concat(F.lit("f"), (F.col("p_partkey") % 97).cast("string"), F.lit(".c")).alias("file"),
                       F.regexp_replace("p_name", " ", "_").alias("name"), (F.col("p_size") % 9).alias("line"),
                       (F.col("p_partkey") % 50).cast("int").alias("col"))


_AT = """, at_ as (select req_id, {cols} from (select cur.req_id, r.*, row_number() over (partition by cur.req_id order by r.ord) as rn from cur left join refs r
  on cur.file = r.file and cur.name = r.name and cur.line = r.line and cur.col = r.col) where rn = 1)"""


def _with_chain(refs):
    return refs.withColumn("obj_chain", F.when(F.col("root") != "", F.array("root")).otherwise(F.array().cast("array<string>")))


def _first_refs(spark, sf):
    """References with their place in the table: numbers repeat there, and the first row of the table is the first of equals."""
    return _with_chain(relation(spark, sf, "refs", placed="lineitem"))


@query("ref_at_batch", ", " + _CURSOR + _AT.format(cols="ord, enclosing_func, is_local, role, owner") + " select * from at_")
def _ref_at(spark, sf):
    return lookup.ref_at(_first_refs(spark, sf), _cursors(spark, sf), ("place",)).select("req_id", "ord", "enclosing_func", "is_local", "role", "owner")


@query("scope_at_batch", ", " + _CURSOR + _AT.format(cols="enclosing_func, coalesce(is_local, false) as is_local, coalesce(role, '') as role, coalesce(owner, '') as owner")
       + " select * from at_")
def _scope_at(spark, sf):
    return lookup.scope_at(_first_refs(spark, sf), _cursors(spark, sf), ("place",)).select("req_id", "enclosing_func", "is_local", "role", "owner")


_PARENT = """, parents as (select name, id as parent_id from (select name, id, row_number() over (partition by name order by kind = 'typedef', id) as rn from symbols
  where kind in ('struct', 'union', 'class', 'enum', 'typedef') and is_definition and name <> '') where rn = 1)"""


@query("parent_link", _PARENT + " select s.id, s.scope, p.parent_id from symbols s left join parents p on s.scope <> '' and s.scope = p.name")
def _parent_link(spark, sf):
    return maintenance.parent_links(_(spark, sf, "symbols")).select("id", "scope", "parent_id")


@query("parent_link_prefers_aggregate", _PARENT + """ select p.name, p.parent_id, s.kind from parents p join symbols s on s.id = p.parent_id
  where p.name in (select name from symbols where kind = 'typedef' and is_definition)""")
def _parent_prefers(spark, sf):
    symbols = _(spark, sf, "symbols")
    typed = symbols.where("kind = 'typedef' and is_definition").select(F.col("name").alias("scope")).distinct()
    linked = maintenance.parent_links(typed.withColumn("id", F.lit(0)), known=symbols).where("parent_id is not null")
    return linked.join(symbols.select(F.col("id").alias("parent_id"), "kind"), "parent_id").select(F.col("scope").alias("name"), "parent_id", "kind")


@query("replace_by_file", f"select {_SYM} from symbols where file not in (select file from symbols where id % 10 = 0) union all "
       f"select id + 1000000, file, name || '_new', kind, line, col, is_definition from symbols where id % 10 = 0")
def _replace_by_file(spark, sf):
    symbols = _(spark, sf, "symbols").select(*_COLS)
    new = symbols.where("id % 10 = 0").withColumns({"id": F.col("id") + 1000000, "name": F.concat("name", F.lit("_new"))})
    return maintenance.replace_by_file(symbols, new, new.select("file"))


@query("remove_files", f"select {_SYM} from symbols where file not in ('f3.c', 'f5.c', 'f7.c')")
def _remove_files(spark, sf):
    gone = spark.createDataFrame([("f3.c",), ("f5.c",), ("f7.c",), ("unknown.c",)], "path string")
    return maintenance.remove_files(_(spark, sf, "symbols").select(*_COLS), gone)


_CLOSURE = """, targets as (select name, target from (select name, target, row_number() over (partition by name order by file, ord) as rn from aliases) where rn = 1),
 tags as (select distinct data_type as tag from symbols where data_type <> '' union select name from aliases),
 closure(tag, hop, depth, path) as (select tag, tag, 0, [tag] from tags union all
  select c.tag, t.target, c.depth + 1, list_append(c.path, t.target) from closure c join targets t on c.hop = t.name where not list_contains(c.path, t.target)),
 cands as (select tag, candidate, min(late * 1000000 + depth * 1000 + nth) as prio from (
   select tag, hop as candidate, 0 as late, depth, 0 as nth from closure union all
   select tag, regexp_extract(hop, '^(.*)_[a-z]$', 1) || s, 1, depth, n from closure, (values ('_s', 0), ('_e', 1), ('_u', 2), ('', 3)) v(s, n)
   where regexp_matches(hop, '^.*_[a-z]$')) group by tag, candidate)"""


def _tags(spark, sf):
    symbols, aliases = _(spark, sf, "symbols", "aliases")
    return symbols.where("data_type <> ''").select(F.col("data_type").alias("tag")).union(aliases.select("name")).distinct()


def _prio(rows: DataFrame) -> DataFrame:
    return rows.select("tag", "candidate", (F.col("prio.late") * 1000000 + F.col("prio.depth") * 1000 + F.col("prio.nth")).cast("long").alias("prio"))


@query("typedef_closure", _CLOSURE + " select tag, hop, depth from closure")
def _typedef_closure(spark, sf):
    return types.typedef_closure(_tags(spark, sf), _(spark, sf, "aliases"))


@query("candidate_tags", _CLOSURE + " select tag, candidate, cast(prio as bigint) as prio from cands")
def _candidate_tags(spark, sf):
    return _prio(types.candidate_tags(_tags(spark, sf), _(spark, sf, "aliases")))


# Requests of the narrowing queries: some for each name, so their candidates grow with the symbols and no faster.
_ASKED = """select req_id, word, case g % 4 when 0 then 'value' when 1 then 'field' when 2 then '' else 'type' end as role,
  'f' || cast(req_id % 97 as string) || '.c' as req_file, cast(req_id % 50 as int) + 1 as req_line, case when g % 5 = 0 then null else g % 3 end as call_arity,
  g % 2 = 0 as access from (select min(p_partkey) as req_id, replace(p_name, ' ', '_') as word, cast(p_partkey % 20 as int) as g from {part} group by 2, 3)"""
_REQ = ", req as (" + _ASKED.format(part="part") + ")"


def _requests(spark, sf):
    return spark.sql(_ASKED, part=spark.read.parquet(f"{sf}/part.parquet"))


def _candidates(spark, sf):
    return _requests(spark, sf).join(_(spark, sf, "symbols"), F.col("word") == F.col("name"))


_CAND = _REQ + ", cand as (select * from req join symbols on word = name)"
_ADMITS = """case role when 'value' then kind in ('function', 'prototype', 'global_variable', 'enumerator', 'method', 'macro')
  when 'type' then kind in ('struct', 'union', 'enum', 'class', 'typedef', 'macro') when 'field' then kind in ('field', 'macro') else true end"""


@query("role_kind_filter", _CAND + f" select req_id, id from cand where {_ADMITS}")
def _role_kind_filter(spark, sf):
    return _candidates(spark, sf).where(resolve.role_admits(F.col("role"), F.col("kind"))).select("req_id", "id")


@query("arity_narrow", _CAND + """, f as (select *, kind in ('function', 'prototype', 'method') as fn, kind in ('function', 'prototype', 'method') and (arity is null or
  case when param_types like '%...' then call_arity >= arity else call_arity = arity end) as fit from cand),
  g as (select *, sum(cast(fn as int)) over (partition by req_id) as nfn, sum(cast(coalesce(fit, false) as int)) over (partition by req_id) as nfit from f)
  select req_id, id from g where not coalesce(call_arity is not null and nfn > 1 and nfit > 0 and fn and not coalesce(fit, false), false)""")
def _arity_narrow(spark, sf):
    return resolve.narrow_by_arity(_candidates(spark, sf)).select("req_id", "id")


@query("member_access_narrow", _CAND + """, f as (select *, bool_or(kind not in ('field', 'member')) over (partition by req_id) as other from cand)
  select req_id, id from f where case when access then kind in ('field', 'member', 'macro') else kind not in ('field', 'member') or not other end""")
def _member_narrow(spark, sf):
    return resolve.narrow_by_member_access(_candidates(spark, sf), F.col("access")).select("req_id", "id")


@query("self_guard", _CAND + """, f as (select *, file = req_file and line = req_line as here from cand), g as (select *, bool_or(here) over (partition by req_id) as any_here from f)
  select req_id, id from g where here or not any_here""")
def _self_guard(spark, sf):
    return resolve.self_guard(_candidates(spark, sf)).select("req_id", "id")


@query("call_target_narrow", _CAND + """, f as (select *, bool_or(kind <> 'field') over (partition by req_id) as other from cand)
  select req_id, id from f where not access or kind <> 'field' or not other""")
def _call_target(spark, sf):
    return resolve.narrow_call_target(_candidates(spark, sf), F.col("access")).select("req_id", "id")


_OWNED = """, asked as (select distinct data_type as tag from symbols where data_type <> ''),
  m as (select a.tag, s.id, c.prio from asked a join cands c on a.tag = c.tag join symbols s on s.scope = c.candidate where s.kind = 'field' and s.is_definition)
  select tag, id from (select *, min(prio) over (partition by tag) as best from m) where prio = best"""


@query("fields_of_type", _CLOSURE + _OWNED)
def _fields_of_type(spark, sf):
    symbols, aliases = _(spark, sf, "symbols", "aliases")
    asked = symbols.where("data_type <> ''").select(F.col("data_type").alias("tag")).distinct()
    fields = symbols.where("kind = 'field' and is_definition").select("id", "scope")
    candidates = types.candidate_tags(asked, aliases)
    return types.fields_of_type(asked.join(candidates, "tag").select("tag", F.col("candidate").alias("scope")).join(fields, "scope"), candidates, ["tag"]).select("tag", "id")


_CHAIN_ROOT = """, ch as (select distinct file, enclosing_func as func, root, name as hop from refs where root <> ''),
  lt as (select file, func, name, data_type from (select *, row_number() over (partition by file, func, name order by ord) as rn from locals_ where data_type <> '') where rn = 1),
  gt as (select name, data_type from (select *, row_number() over (partition by name order by file, ord) as rn from symbols
     where kind = 'global_variable' and is_definition and data_type <> '') where rn = 1),
  rt as (select ch.file, ch.func, ch.root, ch.hop, coalesce(lt.data_type, gt.data_type) as tag from ch left join lt on ch.file = lt.file and ch.func = lt.func and ch.root = lt.name
     left join gt on ch.root = gt.name)"""


def _owner_query(spark, sf, chain):
    symbols, refs, local_rows, aliases = _(spark, sf, "symbols", "refs", "locals_", "aliases")
    chains = refs.where("root <> ''").select("file", F.col("enclosing_func").alias("func"), chain.alias("chain")).distinct()
    return types.chain_owners(chains, symbols, local_rows, aliases)


@query("object_chain_1hop", _CHAIN_ROOT + " select distinct file, func, root, tag from rt")
def _chain1(spark, sf):
    return _owner_query(spark, sf, F.array("root")).select("file", "func", F.get("chain", F.lit(0)).alias("root"), F.col("chain_owner").alias("tag"))


_HOP = """, fm as (select rt.file, rt.func, rt.root, rt.hop, s.data_type, s.file as ff, s.ord, c.prio from rt join cands c on rt.tag = c.tag join symbols s
     on s.scope = c.candidate and s.name = rt.hop where s.kind = 'field' and s.is_definition),
  fb as (select *, min(prio) over (partition by file, coalesce(func, ''), root, hop) as best from fm),
  fo as (select file, func, root, hop, data_type from (select *, row_number() over (partition by file, coalesce(func, ''), root, hop order by ff, ord) as rn from fb
     where prio = best and data_type <> '') where rn = 1)"""


@query("object_chain_2hop", _CLOSURE + _CHAIN_ROOT + _HOP + """ select rt.file, rt.func, rt.root, rt.hop, fo.data_type as tag from rt left join fo
  on rt.file = fo.file and rt.func is not distinct from fo.func and rt.root = fo.root and rt.hop = fo.hop""")
def _chain2(spark, sf):
    return _owner_query(spark, sf, F.array("root", "name")).select("file", "func", F.get("chain", F.lit(0)).alias("root"), F.get("chain", F.lit(1)).alias("hop"),
                                                                 F.col("chain_owner").alias("tag"))


@query("field_refs_owner_narrowed", _CLOSURE + _CHAIN_ROOT + """, q as (select r.ord, coalesce(nullif(r.owner, ''), rt.tag) as own from refs r left join (select distinct file, func, root, tag from rt) rt
    on r.file = rt.file and r.enclosing_func is not distinct from rt.func and r.root = rt.root where r.name = 'small_ring' and r.role = 'field' and not r.is_local)
  select ord, own from q where own is null or own = 'T4' or own in (select candidate from cands where tag = 'T4') or 'T4' in (select candidate from cands where tag = own)""")
def _field_refs(spark, sf):
    symbols, refs, local_rows, aliases = _(spark, sf, "symbols", "refs", "locals_", "aliases")
    asked = spark.range(1).select(F.lit(0).alias("req_id"), F.lit("small_ring").alias("word"), F.lit("field").alias("role"), F.lit("x.c").alias("req_file"),
                                  F.lit(0).alias("req_line"), F.lit(None).cast("string").alias("func"), F.lit(False).alias("is_local"), F.lit("T4").alias("owner"),
                                  F.array().cast("array<string>").alias("obj_chain"), F.array().cast("array<string>").alias("member_chain"),
                                  F.lit(None).cast("string").alias("object_name"), F.lit(False).alias("is_member_access"), F.lit(None).cast("int").alias("call_arity"))
    # What a reference is asked for stands in for its line, so that the operator's own columns carry it: numbers (``ord``) repeat.
    carried = _with_chain(refs).withColumn("line", F.struct("ord", "owner", F.col("file").alias("in_file"), F.col("enclosing_func").alias("in_func"), "root"))
    got = resolve.references_at(asked, symbols, carried, local_rows, aliases).select("line.*")
    roots = _owner_query(spark, sf, F.array("root")).select(F.col("file").alias("f_"), F.col("func").alias("g_"), F.get("chain", F.lit(0)).alias("r_"), "chain_owner")
    owned = got.join(roots, (F.col("in_file") == F.col("f_")) & F.col("in_func").eqNullSafe(F.col("g_")) & (F.col("root") == F.col("r_")), "left")
    return owned.select("ord", F.coalesce(F.nullif("owner", F.lit("")), "chain_owner").alias("own"))


_NEIGH = """, edges as (select callee as parent, coalesce(caller, '(file scope)') as name, file, line, col from (select *, row_number() over
  (partition by callee, coalesce(caller, '(file scope)') order by file, ord) as rn from calls) where rn = 1)"""


@query("call_children", _NEIGH + " select parent, name, file, line, col, name = '(file scope)' or name = parent as recursive from edges")
def _call_children(spark, sf):
    calls = _(spark, sf, "calls")
    parents = calls.select(F.col("callee").alias("parent")).distinct().withColumn("ancestors", F.array().cast("array<string>"))
    return graph.call_children(calls, "callers", parents).select("parent", "name", "file", "line", "col", "recursive")


@query("has_call_children", "select distinct callee as name from calls where caller is not null")
def _has_children(spark, sf):
    calls = _(spark, sf, "calls")
    names = calls.where("caller is not null").select(F.col("callee").alias("name")).distinct()
    return graph.has_children(calls, "callers", names)


@query("call_relations", _NEIGH + """ , q as (select distinct callee as word, callee < 'fn3' as is_local from calls) select q.word, e.name, e.file, e.line, e.col,
  e.name = '(file scope)' or e.name = q.word as recursive from q join edges e on q.word = e.parent where not q.is_local""")
def _call_relations(spark, sf):
    calls = _(spark, sf, "calls")
    asked = calls.select(F.col("callee").alias("req_id"), F.col("callee").alias("word"), (F.col("callee") < "fn3").alias("is_local")).distinct()
    return graph.call_relations(calls, "callers", asked).withColumnRenamed("req_id", "word")


@query("find_local", "select ord, file, name, kind, func, line, col, data_type from locals_ where name = 'v7' and file = 'f7.c' and func = 'fn7'")
def _find_local(spark, sf):
    return lookup.find_locals(_(spark, sf, "locals_"), "v7", "f7.c", "fn7").select("ord", "file", "name", "kind", "func", "line", "col", "data_type")


@query("typedef_targets", "select name, target from (select name, target, row_number() over (partition by name order by file, ord) as rn from aliases) where rn = 1")
def _typedef_targets(spark, sf):
    return lookup.typedef_targets(_(spark, sf, "aliases"))


@query("file_meta", "select path, hash, mtime, parsed_by from files")
def _file_meta(spark, sf):
    return _(spark, sf, "files").select("path", "hash", "mtime", "parsed_by")


@query("enclosing_func_at", "select enclosing_func from refs where file = 'f11.c' and name = (select min(name) from refs where file = 'f11.c') and line = 1 "
       "and col = (select min(col) from refs where file = 'f11.c' and line = 1 and name = (select min(name) from refs where file = 'f11.c')) order by ord limit 1")
def _enclosing_func_at(spark, sf):
    refs = _(spark, sf, "refs")
    first = refs.where("file = 'f11.c'").agg(F.min("name")).first()[0]
    col = refs.where((F.col("file") == "f11.c") & (F.col("line") == 1) & (F.col("name") == first)).agg(F.min("col")).first()[0]
    return lookup.enclosing_func_at(refs, "f11.c", first, 1, -1 if col is None else col)


_TREE = _NEIGH + """, tree(depth, path, name, recursive) as (select 1, [parent], name, name = '(file scope)' or name = parent from edges where parent in ({roots})
  union all select t.depth + 1, list_append(t.path, t.name), e.name, e.name = '(file scope)' or list_contains(list_append(t.path, t.name), e.name)
  from tree t join edges e on e.parent = t.name where not t.recursive and t.depth < {depth})"""


@query("call_tree_depth3", _TREE.format(roots="'fn7'", depth=3) + " select depth, array_to_string(path, '>') as path, name, recursive from tree")
def _call_tree(spark, sf):
    roots = spark.createDataFrame([("fn7",)], "root string")
    return graph.call_tree(_(spark, sf, "calls"), "callers", roots, 3).select("depth", F.array_join("path", ">").alias("path"), "name", "recursive")


@query("call_tree_cycles", _TREE.format(roots="'fn1', 'fn2', 'fn3'", depth=2) + " select path[1] as root, count(*) as n, sum(cast(recursive as int)) as n_recursive from tree group by 1")
def _call_cycles(spark, sf):
    roots = spark.createDataFrame([("fn1",), ("fn2",), ("fn3",)], "root string")
    tree = graph.call_tree(_(spark, sf, "calls"), "callers", roots, 2)
    return tree.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("recursive").cast("int")).alias("n_recursive"))


_CANDS = """, sc as (select name, kind, data_type, file, line, col, is_definition, id from (select *, row_number() over (partition by name, kind order by is_definition desc, id) as rn
  from symbols where name <> '' and name ilike '{like}'{kinds}) where rn = 1 order by length(name), name, kind limit 2000)"""


@query("search_candidates", _CANDS.format(like="%r%g%", kinds="") + " select * from sc")
def _search_candidates(spark, sf):
    return search.candidates(_(spark, sf, "symbols"), "rg")


_FUZZY = """, names as (select distinct name from sc), chars as (select name, i, substr(name, i, 1) as c, case when i = 1 then '' else substr(name, i - 1, 1) end as pc
    from names, range(1, 64) r(i) where i <= length(name)),
  bon as (select name, i, lower(c) as c, case when i = 1 then 8 when not regexp_matches(pc, '^[A-Za-z0-9]$') then 8 when pc between 'a' and 'z' and c between 'A' and 'Z' then 7
    when not (pc between '0' and '9') and c between '0' and '9' then 7 else 0 end as bn from chars),
  dp as (select 1 as k, name, i, 16 + 2 * bn + case when i = 1 then 0 else -3 - (i - 2) end as sc from bon where c = substr('{p}', 1, 1)
    union all select k, name, i, max(sc) from (select d.k + 1 as k, d.name, b.i, d.sc + 16 + case when b.i = d.i + 1 then greatest(b.bn, 6) else -3 - (b.i - d.i - 2) + b.bn end as sc
    from dp d join bon b on b.name = d.name and b.i > d.i and b.c = substr('{p}', d.k + 1, 1) where d.k < length('{p}')) group by k, name, i),
  scored as (select name, max(sc) as score from dp where k = length('{p}') group by name)"""


@query("fuzzy_score", _CANDS.format(like="%w%d%g%", kinds="") + _FUZZY.format(p="wdg") + " select name, cast(score as int) as score from scored")
def _fuzzy_score(spark, sf):
    rows = search.candidates(_(spark, sf, "symbols"), "wdg").select("name").distinct()
    return rows.select("name", search.score_column("wdg", F.col("name"), spark).alias("score"))


@query("fuzzy_topk", _CANDS.format(like="%r%g%", kinds="") + _FUZZY.format(p="rg") + """ select sc.name, kind, id, cast(score as int) as score from sc join scored on sc.name = scored.name
  order by score desc, length(sc.name), sc.name, kind limit 20""")
def _fuzzy_topk(spark, sf):
    return search.fuzzy_filter(search.candidates(_(spark, sf, "symbols"), "rg"), "rg", 20).select("name", "kind", "id", "score")


query("search_exact", _CANDS.format(like="%s%m%a%l%l%\\_%r%i%n%g%' escape '\\", kinds="") + " select name, kind, id from sc where lower(name) = 'small_ring'")(
    lambda s, d: search.search(_(s, d, "symbols"), "'SMALL_ring").select("name", "kind", "id"))
query("search_prefix", _CANDS.format(like="%r%e%d%", kinds="") + " select name, kind, id from sc where lower(name) like 'red%' order by length(name), lower(name), name, kind limit 200")(
    lambda s, d: search.search(_(s, d, "symbols"), "^red").select("name", "kind", "id"))
query("search_kind_prefix", _CANDS.format(like="%r%g%", kinds=" and kind in ('field', 'method')") + _FUZZY.format(p="rg") + """ select sc.name, kind, id, cast(score as int) as score
  from sc join scored on sc.name = scored.name order by score desc, length(sc.name), sc.name, kind limit 200""")(
    lambda s, d: search.search(_(s, d, "symbols"), "m: rg").select("name", "kind", "id", "score"))


@query("refs_by_file", """select file, count(*) as n_refs, string_agg(cast(line as varchar) || ':' || cast(col as varchar), ' ' order by line, col) as refs
  from refs where name = 'small_ring' and not is_local group by file""")
def _refs_by_file(spark, sf):
    rows = report.group_references(lookup.find_references(_(spark, sf, "refs"), "small_ring"))
    joined = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["line"].cast("string"), r["col"].cast("string"))), " ")
    return rows.select("file", "n_refs", joined.alias("refs"))


@query("ref_snippets", """, p as (select distinct path as file, line from files, (values (0), (1), (40)) v(line))
  select p.file, p.line, coalesce(nullif(trim(string_split_regex(f.text, '\\r\\n|\\r|\\n')[p.line + 1], ' \t\r\n'), ''), 'line ' || cast(p.line + 1 as varchar)) as snippet
  from p join files f on p.file = f.path""")
def _ref_snippets(spark, sf):
    files = _(spark, sf, "files")
    places = files.select(F.col("path").alias("file"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(40))).alias("line")).distinct()
    return report.snippets(places, files).select("file", "line", "snippet")


@query("dedupe_locations", "select distinct file, line, col from refs")
def _dedupe(spark, sf):
    return report.dedupe_locations(_(spark, sf, "refs").select("file", "line", "col"))


@query("kind_label", _CAND + """, ks as (select req_id, kind, min(id) as first_id from cand group by 1, 2) select req_id, string_agg(case kind when 'prototype' then 'function prototype'
  when 'global_variable' then 'global variable' else kind end, ', ' order by first_id) as kind_label from ks group by 1""")
def _kind_label(spark, sf):
    return report.kinds_label(_candidates(spark, sf), ["id"])


_PLAN = """, prev as (select path, mtime - case when id % 7 = 0 then 1 else 0 end as mtime, case when id % 3 = 0 then '' else hash end as hash from files where id % 10 <> 0),
  cur as (select path, mtime, hash from files where id % 11 <> 0)
  select coalesce(c.path, p.path) as path, case when c.path is null then 'remove' when {force} or p.path is null then 'index' when c.mtime = p.mtime {hash} then 'unchanged'
  else 'index' end as action from cur c full outer join prev p on c.path = p.path"""


def _plan(spark, sf, **options):
    files = _(spark, sf, "files")
    prev = files.where("id % 10 <> 0").select("path", (F.col("mtime") - F.expr("case when id % 7 = 0 then 1 else 0 end")).alias("mtime"),
                                              F.expr("case when id % 3 = 0 then '' else hash end").alias("hash"))
    return maintenance.index_plan(files.where("id % 11 <> 0").select("path", "mtime", "hash"), prev, **options)


query("index_plan_mtime", _PLAN.format(force="false", hash=""))(lambda s, d: _plan(s, d))
query("index_plan_hash", _PLAN.format(force="false", hash="or c.hash = p.hash"))(lambda s, d: _plan(s, d, verify_hash=True))
query("index_plan_force", _PLAN.format(force="true", hash=""))(lambda s, d: _plan(s, d, force=True))

# Paths of the rule queries: page addresses without their scheme.
_PAGES = "select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages"


def _paths(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def _rule_case(rules, forms):
    out = "false"
    for r in rules:
        hit = " or ".join(f"regexp_matches({f}, '{exclusion.glob_regex(r.pattern)}')" for f in forms)
        out = f"case when {hit} then {'false' if r.negated else 'true'} else {out} end"
    return out


for _name, _rules, _folder in (
        ("exclude_globs", exclusion.rules_of((), ("**/en/**", "*.example.org/??/1*")), None),
        ("exclude_then_include", exclusion.rules_of(("**/en/1*", "www.*/**"), ("**/en/**", "**/fr/*")), None),
        ("exclude_folder_forms", exclusion.rules_of(("*/en/1*",), ("site/**",)), "site")):
    query(_name, f", p as ({_PAGES}) select page_id, path, {_rule_case(_rules, ['path'] + ([f'''{chr(39)}{_folder}/{chr(39)} || path'''] if _folder else []))} as excluded from p")(
        lambda s, d, rules=_rules, folder=_folder: _paths(s, d).withColumn("excluded", exclusion.excluded(F.col("path"), rules, F.lit(folder) if folder else None)))


@query("identifier_tokens", """, l as (select path, unnest(string_split(text, chr(10))) as value, unnest(range(0, len(string_split(text, chr(10))))) as line from files),
  t as (select path, cast(line as int) as line, unnest(regexp_extract_all(value, '\\b[A-Za-z_][A-Za-z0-9_]*')) as name from l)
  select path, line, name, count(*) as n from t where name not in (""" + ", ".join(f"'{w}'" for w in sorted(text.SCANNER)) + ") group by 1, 2, 3")
def _identifier_tokens(spark, sf):
    return text.identifier_tokens(_(spark, sf, "files").select("path", "text"))


# A line is cut into comments, literals, words and other signs in order; what comes before a piece gives its column.
_OCC = """, l as (select path, unnest(string_split(text, chr(10))) as value, unnest(range(0, len(string_split(text, chr(10))))) as line from files where contains(text, 'the')),
  t as (select path, line, value, regexp_extract_all(value, '//.*|"(?:\\\\.|[^"\\\\])*"?|''(?:\\\\.|[^''\\\\])*''?|[A-Za-z0-9_]+|.') as ts from l where contains(value, 'the')),
  u as (select path, line, value, unnest(ts) as tok, unnest(range(0, len(ts))) as i from t),
  c as (select *, coalesce(sum(length(tok)) over (partition by path, line order by i rows between unbounded preceding and 1 preceding), 0) as col from u),
  occ as (select path, cast(line as int) as line, cast(col as int) as col, trim(value, ' ' || chr(9) || chr(13)) as snippet from c where tok = 'the')"""


@query("word_occurrences", _OCC + " select path, line, col, snippet from occ")
def _word_occurrences(spark, sf):
    return text.word_occurrences(_(spark, sf, "files").select("path", "text"), "the")


@query("occurrences_by_file", _OCC + """, b as (select path as file, line, snippet, string_agg(cast(col as varchar), ',' order by col) as cols, count(*) as n from occ group by 1, 2, 3)
  select file, cast(sum(n) as bigint) as n_refs, string_agg(cast(line as varchar) || ':' || cols || ': ' || snippet, chr(10) order by line) as refs from b group by file""")
def occurrences_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every whole-word occurrence of a term, grouped by file: one text line for each source line, with columns and the line."""
    found = text.word_occurrences(relation(spark, sf_dir, "files").select("path", "text"), "the")
    by_line = found.groupBy(F.col("path").alias("file"), "line").agg(F.array_sort(F.collect_list("col")).alias("cols"), F.first("snippet").alias("snippet"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("line", "cols", "snippet"))), lambda r: F.concat(
        r["line"].cast("string"), F.lit(":"), F.array_join(r["cols"].cast("array<string>"), ","), F.lit(": "), r["snippet"]))
    return by_line.groupBy("file").agg(F.sum(F.size("cols")).alias("n_refs"), F.array_join(shown, "\n").alias("refs"))


@query("enclosing_range_join", """, pts as (select distinct file, line + col as line from refs), j as (select p.file, p.line, r.name, row_number() over
  (partition by p.file, p.line order by r.start_line desc, r.name desc) as rn from pts p join ranges r on p.file = r.file and p.line between r.start_line and r.end_line)
  select p.file, p.line, j.name as func from pts p left join j on p.file = j.file and p.line = j.line and j.rn = 1""")
def _enclosing(spark, sf):
    refs, ranges = _(spark, sf, "refs", "ranges")
    return text.enclosing_functions(refs.select("file", (F.col("line") + F.col("col")).alias("line")).distinct(), ranges)


@query("content_hash", "select path, hash from files")
def _content_hash(spark, sf):
    """The hash that the indexer gives a text, worked out by its own function."""
    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(content_hash, na_action="ignore")

    ship_package(spark)
    return _(spark, sf, "files").select("path", hashed("text").alias("hash"))


@query("symbol_counts", "select file, count(*) as n_symbols from symbols group by file")
def _symbol_counts(spark, sf):
    return maintenance.counts(_(spark, sf, "symbols"))


@query("keyword_filter", "select name, n from (select name, count(*) as n from (select unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*')) as name from files) group by 1) "
       "where name in (" + ", ".join(f"'{w}'" for w in ("for", "this", "or", "and", "auto", "not", "using", "new", "with")) + ") and name <> 'with'")
def _keyword_filter(spark, sf):
    from ..functions.keywords import is_hard_keyword

    words = _(spark, sf, "files").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return words.where(is_hard_keyword(F.col("name")) & F.col("name").isin("for", "this", "or", "and", "auto", "not", "using", "new", "with")).groupBy(
        "name").agg(F.count("*").alias("n"))


_FEED = """, ev as (select 'u' || cast(user_id as varchar) || '.c' as path, event_id as seq, case when event_type = 'error' then 'delete' else 'upsert' end as op,
  event_type || ' ' || props as text, cast(floor(value * 100) as bigint) as mtime from events)
  select path, seq, op, text, mtime from (select *, row_number() over (partition by path order by seq desc) as rn from ev) where rn = 1"""


@query("stream_change_feed", _FEED)
def _stream(spark, sf):
    import uuid

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # The table may be one file; dealt into several, it comes as several micro-batches, each with older and newer changes of a path.
    dealt = settled(spark.read.parquet(f"{sf}/events.parquet").repartition(4, "event_id"), "events")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(dealt.settled_path)
    changes = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".c")).alias("path"), F.col("event_id").alias("seq"),
                            F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
                            F.concat_ws(" ", "event_type", "props").alias("text"), F.floor(F.col("value") * 100).cast("long").alias("mtime"))
    base = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    return replay(spark, changes, f"{base}/state", f"{base}/checkpoint").select("path", "seq", "op", "text", "mtime")


# Queries over a fixture corpus of sources; the rows of their twins are in ``golden``.
def _fixture(name: str, f: Query) -> None:
    QUERIES[name] = f
    if name in golden.ROWS:
        ORACLE[name] = golden.sql(name)


for _part in ("symbols", "refs", "calls", "locals", "aliases"):
    _fixture(f"extract_fixture_{_part}", lambda s, d, part=_part: fixtures.facts(s, part))
for _part in ("symbols", "refs", "calls", "locals", "aliases"):
    _fixture(f"extract_repairs_{_part}", lambda s, d, part=_part: fixtures.facts(s, part, sources=fixtures.REPAIRS).where(
        F.lit(part != "refs") | (F.col("file") == "pot.cpp")))
for _part in ("symbols", "refs", "calls"):
    _fixture(f"grep_fixture_{_part}", lambda s, d, part=_part: fixtures.facts(s, part, grep=True))
_fixture("macro_wrapped_vars", lambda s, d: fixtures.facts(s, "symbols").where("file = 'wrapped.c'"))
_fixture("goto_definition_fixture", lambda s, d: fixtures.run(s, "goto"))
_fixture("references_fixture", lambda s, d: fixtures.run(s, "references"))
_fixture("code_insight_fixture", lambda s, d: fixtures.run(s, "insight"))
_fixture("symbol_info_fixture", lambda s, d: fixtures.run(s, "symbol_info"))
_fixture("category_counts_fixture", lambda s, d: report.category_counts(fixtures.run(s, "insight")))
_fixture("type_info_fixture", lambda s, d: fixtures.run(s, "type_info"))

__all__ = ["FILES", "ORACLE", "QUERIES", "occurrences_by_file", "settled"]
