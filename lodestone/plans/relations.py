"""Index relations as projections of the test tables: the same SQL text for Spark and for DuckDB.

The test tables hold no source code, so names, scopes, types and calls are derived from keys by modulo. Only what both
dialects read alike is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = """select doc_id as id, source || '/' || lang || '/d' || cast(doc_id as string) || '.c' as path, sha1(text) as hash, n_chars as mtime,
  case when n_chars > 2048 then 'grep' else 'ts' end as parsed_by, text from documents"""

SYMBOLS = """select p_partkey as id, p_partkey as ord, 'f' || cast(p_partkey % 97 as string) || '.c' as file, p_partkey % 199 as file_id,
  case when p_partkey % 9 in (4, 7) then 'T' || cast(p_size % 12 as string) when p_partkey % 9 = 5 then 'T' || cast(p_size % 12 as string) || '_t'
       when p_partkey % 9 = 0 then 'fn' || cast(p_partkey % 60 as string) when p_partkey % 9 = 2 then 'v' || cast(p_partkey % 20 as string)
       else replace(p_name, ' ', '_') end as name,
  case p_partkey % 9 when 0 then 'function' when 1 then 'prototype' when 2 then 'global_variable' when 3 then 'field' when 4 then 'struct'
       when 5 then 'typedef' when 6 then 'macro' when 7 then 'union' else 'field' end as kind,
  p_size as line, cast(p_partkey % 40 as int) as col, p_partkey % 7 < 5 as is_definition, 'ts' as source,
  case when p_partkey % 9 in (3, 8) then 'T' || cast(p_partkey % 12 as string) else '' end as scope,
  case when p_partkey % 9 in (2, 3, 8) then case when p_size % 5 = 0 then '' else 'T' || cast(p_size % 12 as string) || case when p_size % 2 = 0 then '_t' else '' end end
       else '' end as data_type,
  case when p_partkey % 9 in (0, 1) then case when p_size % 6 = 0 then null else p_size % 4 end end as arity,
  case when p_size % 7 = 0 then 'int,...' else 'int' end as param_types,
  case when p_partkey % 9 in (0, 1) then 'struct T' || cast(p_size % 12 as string) || ' *' else '' end as return_type
  from part"""

REFS = """select l_orderkey * 10 + l_linenumber as ord, 'f' || cast(l_partkey % 97 as string) || '.c' as file, replace(p_name, ' ', '_') as name,
  l_linenumber as line, cast(l_orderkey % 50 as int) as col,
  case when l_suppkey % 5 = 0 then null else 'fn' || cast(l_suppkey % 40 as string) end as enclosing_func,
  l_orderkey % 11 = 0 as is_local,
  case l_orderkey % 6 when 0 then 'value' when 1 then 'type' when 2 then 'field' when 3 then 'label' when 4 then 'field' else '' end as role,
  case when l_orderkey % 6 in (2, 4) and l_partkey % 3 = 0 then 'T' || cast(l_partkey % 12 as string) else '' end as owner,
  case when l_orderkey % 6 in (2, 4) then 'v' || cast(l_suppkey % 20 as string) else '' end as root,
  case when l_orderkey % 5 = 0 then 'grep' else 'ts' end as source
  from lineitem join part on l_partkey = p_partkey"""

CALLS = """select l_orderkey * 10 + l_linenumber as ord, 'f' || cast(l_partkey % 97 as string) || '.c' as file,
  case when l_suppkey % 9 = 0 then null else 'fn' || cast(l_suppkey % 60 as string) end as caller, 'fn' || cast(l_partkey % 60 as string) as callee,
  l_linenumber as line, cast(l_orderkey % 50 as int) as col from lineitem"""

LOCALS = """select o_orderkey as ord, 'f' || cast(o_orderkey % 97 as string) || '.c' as file, 'v' || cast(o_custkey % 20 as string) as name,
  case when o_custkey % 3 = 0 then 'parameter' else 'local_variable' end as kind, 'fn' || cast(o_custkey % 40 as string) as func,
  cast(o_orderkey % 300 as int) as line, cast(o_custkey % 30 as int) as col,
  case when o_orderkey % 3 = 0 then '' else 'T' || cast(o_orderkey % 12 as string) || case when o_orderkey % 2 = 0 then '_t' else '' end end as data_type
  from orders"""

ALIASES = """select n_nationkey as ord, 'a.h' as file, 'T' || cast(n_nationkey % 12 as string) || '_t' as name,
  case when n_nationkey % 4 = 0 then 'T' || cast((n_nationkey + 1) % 12 as string) || '_t' else 'T' || cast((n_nationkey * 5) % 12 as string) end as target
  from nation
  union all select 100 + r_regionkey, 'b.h', 'X' || cast(r_regionkey as string), 'X' || cast((r_regionkey + 1) % 5 as string) from region"""

RANGES = """select distinct 'f' || cast(o_orderkey % 97 as string) || '.c' as file, 'fn' || cast(o_custkey % 40 as string) as name,
  cast(o_orderkey % 250 as int) as start_line, cast(o_orderkey % 250 + o_custkey % 90 as int) as end_line from orders"""

ALL = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "calls": CALLS, "locals_": LOCALS, "aliases": ALIASES, "ranges": RANGES}
_TABLES = ("documents", "part", "lineitem", "orders", "nation", "region")

#: Common table expressions of all relations, for the SQL twins.
PREFIX = "with recursive " + ",\n".join(f"{name} as ({sql})" for name, sql in ALL.items()) + "\n"


def relation(spark: SparkSession, sf_dir: str, name: str, placed: str | None = None) -> DataFrame:
    """One relation over the tables of a data folder; with ``place``, the file and row of the table ``placed`` in it, if that is given."""
    import re

    sql = ALL[name]
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if placed:
        tables[placed] = tables[placed].select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
        text = text.replace("select ", "select place, ", 1)
    return spark.sql(text, **tables)
