"""Index builds, cursors and reports over small source trees."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, lookup, report, resolve, search
from lodestone.operators.maintenance import Index, index_plan, schema_version, store_name
from lodestone.operators.types import candidate_tags, chain_owners, typedef_closure
from lodestone.sources.scan import buffers, scan_files
from lodestone.streaming.change_feed import CHANGES, apply_changes, replay

TREE = {
    "types.h": "struct A_s { int field; struct Inner_s *rtf; };\nstruct B_s { int field; };\nstruct Inner_s { int migrationType; };\n"
               "struct Other_s { int migrationType; };\ntypedef struct A_s A_t;\ntypedef A_t A2_t;\nextern A_t gA;\n",
    "use.c": "A_t gA;\nvoid use(A_t *a, struct B_s *b) {\n  a->field = 1;\n  b->field = 2;\n  a->rtf->migrationType = 3;\n  gA.field = 4;\n  doit(1, 2);\n}\n",
    "one.c": "static int doit(int x) { return helper(x); }\n",
    "two.c": "int doit(int x, int y) { return x; }\nint helper(int a) { int bitmap = a; return bitmap; }\nint bitmap(void) { return helper(1); }\n"
             "void loop(void) { loop(); use(0, 0); }\n#ifdef CONFIG_X\n#endif\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return Index.build(spark, str(tmp_path_factory.mktemp("index")), buffers(spark, [(p, t, 1) for p, t in TREE.items()]))


def relations(ix):
    return ix.symbols, ix.refs, ix.locals, ix.aliases


def cursor(spark, *places):
    """(file, line, text to stand on) -> cursors."""
    rows = []
    for k, (file, line, word) in enumerate(places):
        text = TREE[file].split("\n")[line]
        rows.append((k, file, line, text.index(word), text))
    return spark.createDataFrame(rows, "req_id int, file string, line int, character int, line_text string")


def hits(spark, ix, *places):
    out = {}
    for r in resolve.goto_definition(cursor(spark, *places), *relations(ix)).collect():
        out.setdefault(r.req_id, set()).add((r.file, r.line, r.status) if r.file else r.status)
    return [out.get(k) for k in range(len(places))]


def test_goto_definition(spark, index):
    got = hits(spark, index, ("use.c", 2, "field"), ("use.c", 3, "field"), ("use.c", 4, "migrationType"), ("use.c", 5, "field"), ("use.c", 6, "doit"),
               ("two.c", 1, "bitmap = a"), ("two.c", 4, "CONFIG_X"), ("use.c", 1, "void"), ("two.c", 2, "helper"))
    assert got == [{("types.h", 0, "hit")}, {("types.h", 1, "hit")}, {("types.h", 2, "hit")}, {("types.h", 0, "hit")}, {("two.c", 0, "hit")},
                   {("two.c", 1, "hit")}, {"blocked"}, {"abstain"}, {("two.c", 1, "hit")}]


def test_references_leave_out_other_owners(spark, index):
    got = resolve.resolve_references(cursor(spark, ("types.h", 0, "field"), ("types.h", 1, "field"), ("two.c", 1, "bitmap = a")), *relations(index)).collect()
    by = {k: sorted((r.file, r.line) for r in got if r.req_id == k) for k in range(3)}
    assert by[0] == [("types.h", 0), ("use.c", 2), ("use.c", 5)] and by[1] == [("types.h", 1), ("use.c", 3)]
    assert by[2] == [("two.c", 1), ("two.c", 1)]


def test_code_insight(spark, index):
    rows = report.code_insight(cursor(spark, ("use.c", 2, "a->"), ("two.c", 1, "helper"), ("two.c", 2, "bitmap")), *relations(index), index.calls).collect()
    by = {}
    for r in rows:
        by.setdefault((r.req_id, r.category), []).append((r.label, r.value))
    assert ("Kind", "parameter") in by[0, "Symbol"] and by[0, "Type"] == [("types.h:1", "struct")] and (0, "Called by") not in by
    assert ("Signature", "int helper(int a)") in by[1, "Symbol"] and {x[0] for x in by[1, "Called by"]} == {"doit", "bitmap"}
    assert by[2, "Calls"] == [("helper", "")] and ("Defined in", "two.c:3") in by[2, "Symbol"]


def test_symbol_info_of_nothing(spark, index):
    at = spark.createDataFrame([(0, "use.c", 0, 0, "missing_name x")], "req_id int, file string, line int, character int, line_text string")
    req = resolve.requests_of(resolve.cursor_contexts(at), index.refs)
    rows = report.symbol_info(resolve.with_chain_owner(req, index.symbols, index.locals, index.aliases), index.symbols, index.locals, index.aliases).collect()
    assert [(r.label, r.value) for r in rows] == [("Kind", "not found")]


def test_types(spark, index):
    tags = spark.createDataFrame([("A2_t",), ("Foo_t",)], "tag string")
    got = {}
    for r in sorted(candidate_tags(tags, index.aliases).collect(), key=lambda r: (r.tag, tuple(r.prio))):
        got.setdefault(r.tag, []).append(r.candidate)
    assert got["A2_t"] == ["A2_t", "A_t", "A_s", "A2_s", "A2_e", "A2_u", "A2", "A_e", "A_u", "A"] and got["Foo_t"] == ["Foo_t", "Foo_s", "Foo_e", "Foo_u", "Foo"]
    chains = spark.createDataFrame([("use.c", "use", ["a", "rtf"]), ("use.c", None, ["gA"]), ("use.c", None, ["@type:A_t", "rtf"]), ("x.c", "f", ["no"])],
                                   "file string, func string, chain array<string>")
    owners = {tuple(r.chain): r.chain_owner for r in chain_owners(chains, index.symbols, index.locals, index.aliases).collect()}
    assert owners == {("a", "rtf"): "Inner_s", ("gA",): "A_t", ("@type:A_t", "rtf"): "Inner_s", ("no",): None}


def test_parent_links_and_lookups(spark, index):
    rows = {(r["name"], r["scope"]): r["parent_id"] for r in index.symbols.where("kind = 'field'").collect()}
    ids = {r["name"]: r["id"] for r in index.symbols.where("kind = 'struct'").collect()}
    assert rows["field", "A_s"] == ids["A_s"] and rows["field", "B_s"] == ids["B_s"]
    assert lookup.find_definitions(index.symbols, "gA").count() == 1 == lookup.find_declarations(index.symbols, "gA").count()
    assert {r.caller for r in lookup.find_callers(index.calls, "helper").collect()} == {"doit", "bitmap"}


def test_call_tree(spark, index):
    roots = spark.createDataFrame([("loop",)], "root string")
    rows = {(r.depth, r.name, r.recursive) for r in graph.call_tree(index.calls, "callees", roots, 3).collect()}
    assert rows == {(1, "loop", True), (1, "use", False), (2, "doit", False), (3, "helper", False)}


def test_search(spark, index):
    rows = search.search(index.symbols.withColumn("id", F.col("id")), "f:do").collect()
    assert [r.label for r in rows] == ["doit"] and rows[0].description.startswith("function  —  ")
    assert search.search(index.symbols, "d").count() == 0
    assert {r.label for r in search.search(index.symbols, "'DOIT").collect()} == {"doit"}


def test_incremental_build(spark, tmp_path):
    path = str(tmp_path / "ix")
    first = Index.build(spark, path, buffers(spark, [("a.c", "int a(void) { return 1; }", 1), ("b.c", "int b(void) { return a(); }", 1)]))
    second = Index.build(spark, path, buffers(spark, [("a.c", "int a2(void) { return 1; }", 2), ("c.c", "int c;", 1)]))
    assert (first.version, second.version) == (1, 2)
    assert sorted(r["name"] for r in second.symbols.collect()) == ["a2", "c"] and sorted(r.path for r in second.files.collect()) == ["a.c", "c.c"]
    assert first.symbols.count() == 2  # readers of the old version keep it
    changes = spark.createDataFrame([("a.c", 1, "upsert", "int x;", 5), ("a.c", 3, "upsert", "int y;", 6), ("c.c", 2, "delete", None, None)], CHANGES)
    third = apply_changes(path, changes)
    assert sorted(r["name"] for r in third.symbols.collect()) == ["y"]
    assert Index.open(spark, path, "2.0.0") is None and Index.open(spark, str(tmp_path / "none")) is None


def test_plan(spark):
    old = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, None), ("d", 1, "h")], "path string, mtime long, hash string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "h"), ("c", 2, "h"), ("e", 1, "h")], "path string, mtime long, hash string")

    def plan(**k):
        return {r.path: r.action for r in index_plan(new, old, **k).collect()}

    assert plan() == {"a": "unchanged", "b": "index", "c": "index", "d": "remove", "e": "index"}
    assert plan(verify_hash=True)["b"] == "unchanged" and plan(verify_hash=True)["c"] == "index"
    assert plan(force=True) == {"a": "index", "b": "index", "c": "index", "d": "remove", "e": "index"}
    assert (schema_version("1.2.3"), schema_version("x")) == (1_002_003, 0) and len(store_name("p", "/r")) == 14


def test_scan_files(spark, tmp_path):
    for name, text in (("src/a.c", "int a;\n\nint b;\n"), ("src/b.txt", "no"), ("gen/c.h", "int c;"), ("my dir/d+e.cpp", "int d;")):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    from lodestone.options import IndexOptions

    rows = scan_files(spark, str(tmp_path / "tree"), IndexOptions(exclude=("gen/**",))).collect()
    assert sorted((r.path, r.text) for r in rows) == [("my dir/d+e.cpp", "int d;"), ("src/a.c", "int a;\n\nint b;\n")] and all(r.mtime > 10**12 for r in rows)


def test_snippets_and_groups(spark):
    refs = spark.createDataFrame([("b.c", 1, 2), ("a.c", 9, 0), ("a.c", 0, 4)], "file string, line int, col int")
    files = spark.createDataFrame([("a.c", "  int x;\r\ny"), ("b.c", "one\r   two ")], "path string, text string")
    got = {(r.file, r.line): r.snippet for r in report.snippets(refs, files).collect()}
    assert got == {("a.c", 0): "int x;", ("a.c", 9): "line 10", ("b.c", 1): "two"}
    assert [(r.file, r.n_refs, [tuple(x) for x in r.refs]) for r in report.group_references(refs).collect()] == [("a.c", 2, [(0, 4), (9, 0)]), ("b.c", 1, [(1, 2)])]


def test_typedef_chains_have_no_bound(spark):
    aliases = spark.createDataFrame([(f"t{k}", f"t{k + 1}", "a.h", k) for k in range(66)], "name string, target string, file string, ord long")
    got = typedef_closure(spark.createDataFrame([("t0",)], "tag string"), aliases).collect()
    assert {(r.hop, r.depth) for r in got} == {(f"t{k}", k) for k in range(67)}


def test_chains_outside_functions(spark, index):
    """A chain of no function is a place like any other, over several hops and beside one of a function."""
    chains = spark.createDataFrame([("use.c", None, ["gA", "rtf"]), ("use.c", "use", ["gA", "rtf"]), ("use.c", None, ["gA", "rtf"]), ("use.c", None, ["none", "rtf"]),
                                    (None, None, ["gA"])], "file string, func string, chain array<string>")
    got = {(r.file, r.func, *r.chain): r.chain_owner for r in chain_owners(chains, index.symbols, index.locals, index.aliases).collect()}
    assert got == {("use.c", None, "gA", "rtf"): "Inner_s", ("use.c", "use", "gA", "rtf"): "Inner_s", ("use.c", None, "none", "rtf"): None, (None, None, "gA"): "A_t"}


def names_of(ix):
    return sorted(r["name"] for r in ix.symbols.collect())


def test_failed_and_rival_builds_leave_the_index_usable(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    one = [("a.c", "int a;", 1)]
    (tmp_path / "ix" / "data" / "debris" / "plan").mkdir(parents=True)
    with monkeypatch.context() as m:
        m.setattr("lodestone.operators.maintenance.parent_links", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Index.build(spark, path, buffers(spark, one))
    assert Index.open(spark, path) is None and [p.name for p in (tmp_path / "ix" / "data").iterdir()] == ["debris"]
    Index.build(spark, path, buffers(spark, one))
    publish = Index._publish.__func__

    def late(cls, s, p, version, schema, folders):
        if not done:
            done.append(True)
            Index.build(spark, path, buffers(spark, [("b.c", "int b;", 1)]), partial=True)
        return publish(cls, s, p, version, schema, folders)

    done = []
    monkeypatch.setattr(Index, "_publish", classmethod(late))
    with pytest.raises(RuntimeError, match="another build"):
        Index.build(spark, path, buffers(spark, [("c.c", "int c;", 1)]), partial=True)
    assert names_of(Index.open(spark, path)) == ["a", "b"]
    assert Index.vacuum(spark, path, keep=1, older_than_s=0) == ["debris"] and names_of(Index.open(spark, path)) == ["a", "b"]


def test_stopped_build_keeps_what_is_parsed(spark, tmp_path):
    path, files = str(tmp_path / "ix"), [(f"f{k}.c", f"int v{k};", 1) for k in range(30)]
    asked = []
    part = Index.build(spark, path, buffers(spark, files), stop=lambda: asked.append(1) or len(asked) > 3)
    have = names_of(part)
    assert 0 < len(have) < 30 and part.files.count() == len(have)
    assert len(names_of(Index.build(spark, path, buffers(spark, files)))) == 30
    assert names_of(Index.build(spark, str(tmp_path / "none"), buffers(spark, files), stop=lambda: True)) == []


def test_deltas_and_their_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.operators.maintenance.MOST_DELTAS", 2)
    path = str(tmp_path / "ix")
    Index.build(spark, path, buffers(spark, [("s.h", "struct S { int f; };", 1), ("a.c", "int a0;", 1)]))
    sizes = []
    for k in range(1, 5):
        ix = Index.build(spark, path, buffers(spark, [("a.c", f"int a{k};\nstruct S {{ int g{k}; }};", k + 1)]), partial=True)
        sizes.append(len(ix.folders))
        assert names_of(ix) == sorted(["S", "S", f"a{k}", "f", f"g{k}"])
        ids = {r["file"]: r["id"] for r in ix.symbols.where("name = 'S'").collect()}
        assert {r["parent_id"] for r in ix.symbols.where("kind = 'field'").collect()} <= set(ids.values())
    assert sizes == [2, 3, 1, 2]


def test_late_changes_are_left_out(spark, tmp_path):
    path = str(tmp_path / "ix")

    def change(*rows):
        return apply_changes(path, spark.createDataFrame(list(rows), CHANGES))

    change(("a.c", 5, "upsert", "int newer;", 2), ("b.c", 5, "upsert", "int b;", 2))
    change(("b.c", 6, "delete", None, None))
    assert names_of(change(("a.c", 3, "upsert", "int older;", 1), ("b.c", 4, "upsert", "int b;", 1))) == ["newer"]
    assert names_of(change(("b.c", 7, "upsert", "int back;", 1))) == ["back", "newer"]


def test_replay_goes_on_after_a_restart(spark, tmp_path):
    rows = [("a", 1), ("b", 2), ("a", 3)]

    def feed(*some):
        spark.createDataFrame([(p, n, "upsert", f"{p}{n}", n) for p, n in some], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {r.path: r.text for r in replay(spark, changes, str(tmp_path / "state"), str(tmp_path / "checkpoint")).collect()}

    feed(*rows)
    assert run() == {"a": "a3", "b": "b2"} == run()
    feed(("c", 9), ("a", 2))
    assert run() == {"a": "a3", "b": "b2", "c": "c9"} == run()
