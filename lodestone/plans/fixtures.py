"""A small corpus of C sources and cursors, for queries that need real code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..extract.file_index import extract, relation
from ..operators import report, resolve
from ..options import IndexOptions
from ..sources.scan import buffers
from ..storage import settled

SOURCES = {
    "point.h": "#ifndef POINT_H\n#define POINT_H\nstruct point { int x; int y; struct point *next; };\ntypedef struct point point_t;\nextern point_t origin;\n"
               "int area(const point_t *p, int scale);\n#endif\n",
    "point.c": "#include \"point.h\"\npoint_t origin = { .x = 0, .y = 0 };\nint area(const point_t *p, int scale)\n{\n    int total = p->x * p->y;\n    total += p->next->x;\n"
               "    return total * scale;\n}\n",
    "main.c": "#include \"point.h\"\nenum mode { FAST, SLOW };\nstatic int run(point_t *p) {\n    if (!p) goto done;\n    return area(p, SLOW) + run(p->next);\ndone:\n    return origin.x;\n}\n"
              "int main(void) { return run(&origin); }\n",
    "wrapped.c": "U32 SECTION_VAR(gCounter, 4);\npoint_t PLACED(ALIGNED(gTable[8], 4), FAST);\nvoid RESET(void);\n",
    "odd.c": "typedef void (*hook_t)(int code);\nvoid (*on_exit)(int);\nextern int level;\n"
             "struct reg { unsigned on : 1; unsigned : 3; union { int raw; struct { char lo; } half; }; } __packed;\nstruct reg bank = { .on = 1, .half = { .lo = 2 } };\n"
             "static int __init probe(struct reg *r, ...) {\n  return ((struct reg *)r)->half.lo + pick(r)->on;\n}\n",
    "geo.hpp": "namespace geo {\nclass Shape {\npublic:\n  int sides() { return this->n; }\n  bool operator==(const Shape& o);\n  int n;\n};\nusing Count = unsigned;\n"
               "template<typename T> T twice(T v) { return v + v; }\n}\nextern \"C\" { int c_api(int a); }\ngeo::Shape::~Shape() { release(this); }\n",
}
#: Names that macros, old parameter lists, constructors and scopes stand around.
REPAIRS = {
    "old.c": "int fold(xs, n)\nint *xs; long n;\n{\n  return xs[n];\n}\ntypedef struct { int lid; } SEALED jar_t;\ntypedef struct jar BOXED jar_alias;\n"
             "typedef long CDECL (*pour_t)(jar_t *);\n",
    "pot.cpp": "class Pot {\npublic:\n  Pot(int n) : held(n) { fill(n); }\n  virtual ~Pot();\n  int held;\n};\n"
               "int shop::shelf::Pot::weigh(int by) { return held + by; }\nnamespace shop::shelf { int count; }\n",
}
CURSORS = [("point.c", 4, "x *"), ("point.c", 5, "next"), ("main.c", 4, "area"), ("main.c", 6, "origin"), ("point.h", 2, "y"), ("main.c", 3, "done"), ("main.c", 8, "run")]


def _indexed(spark: SparkSession, grep: bool = False, sources: dict[str, str] = SOURCES) -> DataFrame:
    rows = buffers(spark, [(p, t, 1) for p, t in sources.items()])
    return extract(rows, IndexOptions(max_file_size_kb=0 if grep else 2048))


#: Columns of the fixture queries; object chains are shown as text.
COLUMNS = {
    "symbols": "file, name, kind, line, col, is_definition, scope, data_type, decl_type, signature, return_type, storage, arity, param_types",
    "refs": "file, line, col, name, role, is_local, enclosing_func, owner, obj_chain",
    "calls": "file, line, col, caller, callee",
    "locals": "file, func, name, kind, line, col, data_type, decl_type",
    "aliases": "file, name, target",
}


def facts(spark: SparkSession, part: str, grep: bool = False, sources: dict[str, str] = SOURCES) -> DataFrame:
    from pyspark.sql import functions as F

    rows = relation(_indexed(spark, grep, sources), part)
    if part == "refs":
        rows = rows.withColumn("obj_chain", F.array_join("obj_chain", " "))
    return rows.select(*COLUMNS[part].split(", "))


def run(spark: SparkSession, what: str) -> DataFrame:
    from pyspark.sql import functions as F

    indexed = settled(_indexed(spark), "fixture")
    symbols, refs, local_rows, aliases, calls = (relation(indexed, p) for p in ("symbols", "refs", "locals", "aliases", "calls"))
    symbols = symbols.withColumn("id", F.xxhash64("file", "ord"))
    lines = [(k, f, n, SOURCES[f].split("\n")[n].index(word), SOURCES[f].split("\n")[n]) for k, (f, n, word) in enumerate(CURSORS)]
    cursors = spark.createDataFrame(lines, "req_id int, file string, line int, character int, line_text string")
    if what == "goto":
        return resolve.goto_definition(cursors, symbols, refs, local_rows, aliases)
    if what == "references":
        return resolve.resolve_references(cursors, symbols, refs, local_rows, aliases)
    if what == "insight":
        return report.code_insight(cursors, symbols, refs, local_rows, aliases, calls)
    requests = resolve.with_chain_owner(resolve.requests_of(resolve.cursor_contexts(cursors), refs), symbols, local_rows, aliases)
    return (report.symbol_info if what == "symbol_info" else report.type_info)(requests, symbols, local_rows, aliases)
