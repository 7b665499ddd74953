"""Reports on symbols: grouped references, snippets, symbol and type info, and the seven categories of a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import call_relations
from .resolve import candidates_at, cursor_contexts, local_hits, references_at, requests_of, resolved_symbols, self_guard, with_chain_owner
from .types import candidate_tags

# How kinds are shown, and the categories of a report in order.
KIND_LABELS = {"function": "function", "prototype": "function prototype", "global_variable": "global variable", "typedef": "typedef", "struct": "struct",
               "union": "union", "enum": "enum", "enumerator": "enumerator", "macro": "macro", "label": "label", "class": "class",
               "namespace": "namespace", "method": "method", "field": "field", "parameter": "parameter", "local_variable": "local variable"}
CATEGORIES = ("Symbol", "Type", "Definition", "Declaration", "Called by", "Calls", "References")
AGGREGATES = ("struct", "union", "enum", "class")


def kind_label(kind: Column) -> Column:
    out = F.regexp_replace(kind, "_", " ")
    for k, label in KIND_LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def basename(file: Column) -> Column:
    return F.element_at(F.split(file, r"[\\/]"), -1)


def place_label(file: Column, line: Column) -> Column:
    return F.concat(basename(file), F.lit(":"), (line + 1).cast("string"))


def group_references(refs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """References by file, each list in order of place; files in order of letters without case."""
    keys = keys or []
    grouped = refs.groupBy(*keys, "file").agg(F.array_sort(F.collect_list(F.struct("line", "col"))).alias("refs"), F.count("*").alias("n_refs"))
    return grouped.orderBy(*keys, F.lower("file"), "file")


def snippets(places: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``snippet`` to ``places(file, line)``: the trimmed source line of ``files(path, text)``, or ``line N``.

    Places are gathered by file first: a text meets the list of its lines once, and is split once.
    """
    wanted = places.groupBy("file").agg(F.collect_set("line").alias("lines_"))
    joined = wanted.join(files.select(F.col("path").alias("p_"), "text"), F.col("file") == F.col("p_"))

    def cut(lines: Column) -> Column:
        return F.transform("lines_", lambda n: F.struct(n.alias("l_"), F.regexp_replace(F.get(lines, n.cast("int")), r"^\s+|\s+$", "").alias("cut_")))

    # The split text is bound as a lambda's variable: named twice in a plan, it could be split again for each line.
    cuts = F.flatten(F.transform(F.array(F.split("text", r"\r\n|\r|\n")), cut))
    shown = joined.select(F.col("file").alias("f_"), F.explode(cuts).alias("row")).select("f_", "row.*")
    at = places.join(shown, (F.col("file") == F.col("f_")) & (F.col("line") == F.col("l_")), "left")
    return at.withColumn("snippet", F.coalesce(F.nullif("cut_", F.lit("")), line_label(F.col("line")))).drop("f_", "l_", "cut_")


def line_label(line: Column) -> Column:
    return F.concat(F.lit("line "), (line + 1).cast("string"))


def call_site_cursors(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Cursors at the call sites of ``rows(name, file, line, col)``, numbered by place."""
    lines = F.split("text", r"\r\n|\r|\n")
    sites = rows.select("file", "line", "col").distinct().join(files.select(F.col("path").alias("file"), "text"), "file")
    return sites.select(F.xxhash64("file", "line", "col").alias("req_id"), "file", "line", F.col("col").alias("character"),
                        F.coalesce(F.get(lines, F.col("line").cast("int")), F.lit("")).alias("line_text"))


def dedupe_locations(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.dropDuplicates([*(keys or []), "file", "line", "col"])


def kinds_label(rows: DataFrame, order: list[str]) -> DataFrame:
    """(req_id, kind_label): the distinct kinds of a request's rows in the order of their first row."""
    first = rows.groupBy("req_id", "kind").agg(F.min(F.struct(*order)).alias("first_"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("first_", kind_label(F.col("kind")).alias("label")))), lambda x: x["label"])
    return first.groupBy("req_id").agg(F.array_join(shown, ", ").alias("kind_label"))


def _requests(cursors: DataFrame, symbols: DataFrame, refs: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    return with_chain_owner(requests_of(cursor_contexts(cursors), refs), symbols, local_rows, aliases)


def symbol_info(requests: DataFrame, symbols: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(req_id, pos, label, value, file, line, col) rows of what each request denotes: kind, signature or storage, places."""
    place = ["is_decl", "file", "ord"]
    wide = ["req_id", "kind", "is_decl", "file", "line", "col", "ord", "signature", "return_type", "storage"]
    mine = local_hits(requests, local_rows).withColumns({"is_decl": F.lit(True), "signature": F.lit(""), "return_type": F.lit(""), "storage": F.lit("")})
    others = resolved_symbols(requests.where("not (is_local and func is not null)"), symbols, local_rows, aliases).withColumn("is_decl", ~F.col("is_definition"))
    rows = others.select(*wide).unionByName(mine.select(*wide))
    none = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col")]
    kinds = requests.select("req_id").join(kinds_label(rows, place), "req_id", "left").select(
        "req_id", F.lit(0).alias("pos"), F.lit("Kind").alias("label"), F.coalesce("kind_label", F.lit("not found")).alias("value"), *none)
    fn = rows.where(F.col("kind").isin("function", "prototype", "method") & ((F.col("signature") != "") | (F.col("return_type") != "")))
    text = F.array_join(F.filter(F.array("storage", "return_type", "signature"), lambda x: x != ""), " ")
    sign = fn.groupBy("req_id").agg(F.min_by(text, F.struct(*place)).alias("value")).where("value <> ''").select(
        "req_id", F.lit(1).alias("pos"), F.lit("Signature").alias("label"), "value", *none)
    stored = rows.where("storage <> ''").join(fn.select("req_id").distinct(), "req_id", "left_anti").groupBy("req_id").agg(
        F.min_by("storage", F.struct(*place)).alias("value")).select("req_id", F.lit(1).alias("pos"), F.lit("Storage").alias("label"), "value", *none)
    order = Window.partitionBy("req_id").orderBy("is_decl", "file", "line", "col")
    places = rows.select("req_id", "is_decl", "file", "line", "col").distinct().select(
        "req_id", (F.row_number().over(order) + 1).alias("pos"), F.when(F.col("is_decl"), "Declared in").otherwise("Defined in").alias("label"),
        place_label(F.col("file"), F.col("line")).alias("value"), "file", "line", "col")
    return kinds.unionByName(sign).unionByName(stored).unionByName(places)


def type_defs(tags: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(tag, file, line, col, kind, name): aggregates of the first candidate that has any, or else all typedefs met."""
    cand = candidate_tags(tags, aliases).select("tag", "candidate", "prio")
    defs = symbols.where(F.col("is_definition") & F.col("kind").isin(*AGGREGATES, "typedef")).select("name", "kind", "file", "line", "col")
    met = cand.join(defs, F.col("candidate") == F.col("name"))
    w = Window.partitionBy("tag")
    aggregate = F.col("kind").isin(*AGGREGATES)
    ranked = met.withColumn("first_", F.min(F.when(aggregate, F.col("prio"))).over(w))
    keep = F.when(F.col("first_").isNotNull(), aggregate & (F.col("prio") == F.col("first_"))).otherwise(True)
    return ranked.where(keep).select("tag", "file", "line", "col", "kind", "name")


def type_info(requests: DataFrame, symbols: DataFrame, local_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(req_id, text, tag) of requests for something typed; the names of unnamed aggregates are hidden."""
    typed = (F.col("decl_type") != "") | (F.col("data_type") != "")
    pick = F.struct("decl_type", "data_type")
    order = F.struct("file", "ord")
    local = local_hits(requests, local_rows).where(typed).groupBy("req_id").agg(F.min_by(pick, "ord").alias("t"))
    rest = requests.where("not (is_local and func is not null)")
    at = self_guard(candidates_at(rest.where("has_ref"), symbols, local_rows, aliases, True)).where(typed).groupBy("req_id").agg(F.min_by(pick, order).alias("t"))
    bare = rest.where("not has_ref").join(symbols.where(F.col("kind").isin("global_variable", "field")), F.col("word") == F.col("name")).where(typed).groupBy(
        "req_id").agg(F.min_by(pick, order).alias("t"))
    found = local.unionByName(at).unionByName(bare)
    tag = F.when(F.col("t.data_type").startswith("@anon:"), "").otherwise(F.col("t.data_type"))
    return found.select("req_id", F.coalesce(F.nullif("t.decl_type", F.lit("")), tag).alias("text"), tag.alias("tag")).where("text <> ''")


def code_insight(cursors: DataFrame, symbols: DataFrame, refs: DataFrame, local_rows: DataFrame, aliases: DataFrame, calls: DataFrame,
                 hidden: frozenset[str] = frozenset(), hide_empty: bool = True) -> DataFrame:
    """(req_id, category, label, value, file, line, col) of all seven categories of each cursor.

    Empty categories give no rows, or without ``hide_empty`` one row of nulls.
    """
    req = _requests(cursors, symbols, refs, local_rows, aliases)
    shape = ["req_id", "category", "label", "value", "file", "line", "col"]

    def places(rows: DataFrame, category: str, value: Column) -> DataFrame:
        return rows.select("req_id", F.lit(category).alias("category"), place_label(F.col("file"), F.col("line")).alias("label"), value.alias("value"),
                           "file", "line", "col")

    info = symbol_info(req, symbols, local_rows, aliases).withColumn("category", F.lit("Symbol")).select(*shape)
    types = type_info(req, symbols, local_rows, aliases)
    defs = type_defs(types.where("tag <> ''").select("tag"), symbols, aliases)
    type_rows = places(types.join(defs, "tag"), "Type", F.col("kind"))
    rest = req.where("not (is_local and func is not null)")
    definitions = places(candidates_at(rest, symbols, local_rows, aliases, True), "Definition", F.col("kind")).unionByName(
        places(local_hits(req, local_rows), "Definition", F.col("kind")))
    declarations = places(candidates_at(req.where(~F.col("is_local")), symbols, local_rows, aliases, False), "Declaration", F.col("kind"))
    out = info.unionByName(type_rows).unionByName(definitions).unionByName(declarations)
    for category, direction in (("Called by", "callers"), ("Calls", "callees")):
        rows = call_relations(calls, direction, req)
        out = out.unionByName(rows.select("req_id", F.lit(category).alias("category"), F.col("name").alias("label"),
                                          F.when(F.col("recursive"), "recursive").otherwise("").alias("value"), "file", "line", "col"))
    out = out.unionByName(places(references_at(req, symbols, refs, local_rows, aliases), "References", F.col("role")))
    out = out.where(~F.col("category").isin(*hidden)) if hidden else out
    if hide_empty:
        return out
    every = cursors.select("req_id", F.explode(F.array(*(F.lit(c) for c in CATEGORIES if c not in hidden))).alias("category"))
    return every.join(out, ["req_id", "category"], "left").select(*shape)


def category_counts(insight: DataFrame) -> DataFrame:
    return insight.groupBy("req_id", "category").agg(F.count("*").alias("n_rows"))
