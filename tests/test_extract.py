"""Golden facts of source texts, by parser and by line scanner."""

import pytest

from lodestone.extract.file_index import index_file
from lodestone.options import IndexOptions, language_of

SOURCE = """#ifndef QUEUE_LIMIT
#define QUEUE_LIMIT (1 << 4)   /* hidden_in_block */
#endif
// hidden_in_line
typedef unsigned slot_t;
union Cell { slot_t raw; float real; };
enum Phase { IDLE = 1, BUSY };
slot_t next_slot(slot_t from);
slot_t next_slot(slot_t from) {
  if (from >= QUEUE_LIMIT)
    goto wrap;
  return from + 1;
wrap:
  return 0;
}
static void drain(union Cell *cells) {
  slot_t at = next_slot(QUEUE_LIMIT);
  cells[at].raw = BUSY;
}
#if 0
void never_built(void) {
}
#endif
"""
GARBLED = "float ]]] ] x;\n$$ no language at all $$ %%\nenum )( { {\n} } ) ] long ??? y (\n"


def index(text, path="/t.c", **options):
    return index_file(path, text, options=IndexOptions(**options))


def names(idx, kind=None):
    return [s["name"] for s in idx["symbols"] if kind in (None, s["kind"])]


def one(idx, name, kind=None, part="symbols"):
    return next((s for s in idx[part] if s["name"] == name and kind in (None, s.get("kind"))), None)


def owner(idx, name, line):
    return next(r["owner"] for r in idx["refs"] if r["name"] == name and r["role"] == "field" and r["line"] == line)


def test_source_by_parser():
    idx = index(SOURCE)
    assert idx["parsed_by"] == "ts"
    want = {"QUEUE_LIMIT": "macro", "slot_t": "typedef", "Cell": "union", "raw": "field", "Phase": "enum", "IDLE": "enumerator", "BUSY": "enumerator",
            "wrap": "label", "drain": "function", "never_built": "function"}
    assert {n: one(idx, n)["kind"] for n in want} == want
    assert not any("hidden" in n for n in names(idx) + [r["name"] for r in idx["refs"]])
    assert [s["is_definition"] for s in idx["symbols"] if s["name"] == "next_slot"] == [False, True]
    assert {(c["caller"], c["callee"]) for c in idx["calls"]} == {("drain", "next_slot")}


def test_source_by_scanner():
    idx = index(SOURCE, max_file_size_kb=0)
    assert idx["parsed_by"] == "grep" and {s["source"] for s in idx["symbols"]} == {"grep"}
    assert {"QUEUE_LIMIT", "slot_t", "Cell", "Phase", "next_slot", "wrap", "drain", "never_built"} <= set(names(idx))
    assert ("drain", "next_slot") in {(c["caller"], c["callee"]) for c in idx["calls"]} and not idx["locals"] + idx["aliases"]


def test_ladder():
    assert index(GARBLED, error_ratio_threshold=0)["parsed_by"] == "grep"
    assert index_file("/x.txt", SOURCE)["parsed_by"] == "grep"
    assert [language_of(x) for x in ("a.c", "b.H", "c.cpp", "d.HXX", "e.py", "noext", "d.c/x")] == ["c", "c", "cpp", "cpp", None, None, None]


def test_locals_and_fields():
    idx = index("struct point { int x; int y; };\nint add(int a, int b) {\n  int sum = a + b;\n  return sum + a;\n}\n")
    assert one(idx, "x", "field")["scope"] == "point"
    assert {(x["name"], x["kind"], x["func"]) for x in idx["locals"]} == {("a", "parameter", "add"), ("b", "parameter", "add"), ("sum", "local_variable", "add")}
    assert not {"sum", "a", "b"} & set(names(idx))
    assert all(r["is_local"] for r in idx["refs"] if r["name"] == "a")


def test_roles():
    idx = index("void test() {\n  struct frame *frame = bh->b_frame;\n  int b_frame = 1;\n}\n")
    refs = {(r["name"], r["line"], r["col"]): (r["role"], r["is_local"]) for r in idx["refs"]}
    assert refs["frame", 1, 9] == ("type", False)
    assert refs["frame", 1, 16] == ("value", True)
    assert refs["b_frame", 1, 28] == ("field", False)


@pytest.mark.parametrize("before", [
    "void __init", "int __exit", "long __cold", "static void __weak", "static unsigned __init", "struct lamp *__init", "asmstub void", "asmstub __seen int __init",
    "void __noinline __cold", "void __attribute__((cold))", "int", "void BANK_TWO", "INLINE int", "EXPORTED struct lamp *",
])
@pytest.mark.parametrize("after", ["(void) { light(); }", "(lamp_t* l, uint32_t n)\n{\n    uint32_t k = n;\n    light(l, k);\n}\n"])
def test_attribute_macros(before, after):
    idx = index(f"{before} switch_on{after}")
    assert names(idx, "function") == ["switch_on"]
    assert ("switch_on", "light") in {(c["caller"], c["callee"]) for c in idx["calls"]}


def test_signature_arity_and_storage():
    idx = index("static fs16 *bar(char *s, int n)\n{ return 0; }\nint foo(int a, char *b) { return 0; }\nvoid baz(void) {}\n"
                "int vp(const char *f, ...) { return 0; }\nint kr() { return 0; }")
    bar = one(idx, "bar")
    assert (bar["return_type"], bar["storage"], bar["signature"]) == ("fs16", "static", "bar(char *s, int n)")
    assert [(one(idx, n)["arity"], one(idx, n)["param_types"]) for n in ("foo", "baz", "vp", "kr")] == [(2, "int,char"), (0, ""), (1, "char,..."), (None, "")]


def test_function_pointers():
    idx = index("void (*op)(int, size_t, int, int, void **);")
    s = one(idx, "op")
    assert (s["kind"], s["is_definition"], s["decl_type"]) == ("global_variable", True, "void (*)(int, size_t, int, int, void **)")
    assert not one(index("extern void (*op)(int);"), "op")["is_definition"]
    assert one(index("void foo(int);"), "foo")["kind"] == "prototype"
    assert one(index("void *bar(int);"), "bar")["kind"] == "prototype"
    idx = index("void f(void) {\n  void (*cb)(int);\n}")
    assert not one(idx, "cb") and one(idx, "cb", "local_variable", "locals")
    assert one(index("int (*fp)(int) = 0;"), "fp")["decl_type"] == "int (*)(int)"
    assert one(index("void f(int (*cb)(int)) { }"), "cb", part="locals")["decl_type"] == "int (*)(int)"


def test_declared_types():
    assert one(index("void f(void) { uint32_t count; }"), "count", part="locals")["decl_type"] == "uint32_t"
    p = one(index("void f(struct lamp_state *rsp) { }"), "rsp", part="locals")
    assert (p["decl_type"], p["data_type"]) == ("struct lamp_state", "lamp_state")
    assert one(index("Lamp_Spec_t spec;"), "spec")["decl_type"] == "Lamp_Spec_t"
    s = one(index("struct S { void (*hook)(int, size_t); };"), "hook", "field")
    assert s["decl_type"] == "void (*)(int, size_t)"
    assert one(index("void f(MyNS::Config *cfg) { }", "/t.cpp"), "cfg", part="locals")["decl_type"] == "MyNS::Config"


def test_typedefs():
    idx = index("typedef struct {\n int x;\n} Point_t, *pPoint_t;\ntypedef unsigned long ULONG, *PULONG, **PPULONG;\ntypedef struct a_s A_t;\n"
                "typedef struct Foo { int z; } Foo;\ntypedef void (*Notify)(int x, int y);\ntypedef int* (*Maker)(size_t size);\n"
                "typedef void (*JumpTable[8])(uint32_t cmd);")
    assert {"Point_t", "pPoint_t", "ULONG", "PULONG", "PPULONG", "A_t", "Foo", "Notify", "Maker", "JumpTable"} <= set(names(idx, "typedef"))
    assert [(a["name"], a["target"]) for a in idx["aliases"]] == [("A_t", "a_s")]
    assert one(idx, "x", "field")["scope"] == "Point_t" and one(idx, "Foo", "struct")
    idx = index("struct lamp_state_s { int g; };\ntypedef struct lamp_state_s lamp_state_t;\nvoid f(lamp_state_t *rst) { rst->g; }")
    assert one(idx, "rst", part="locals")["data_type"] == "lamp_state_t"
    assert owner(idx, "g", 2) == "lamp_state_t"  # the chain gives the declared name; matching owners goes through aliases


def test_owners():
    idx = index("struct A { int head; };\nstruct B { int head; };\nvoid f(struct A *a) { a->head; }\nvoid g(struct B *b) { b->head; }")
    assert [owner(idx, "head", k) for k in range(4)] == ["A", "B", "A", "B"]
    idx = index("struct other { void (*hook)(int); };\nstruct pct { void (*hook)(int); };\nvoid f(void *p) {\n  ((struct other *)p)->hook;\n"
                "  ((struct pct *)p)->hook;\n}")
    assert [owner(idx, "hook", k) for k in (3, 4)] == ["other", "pct"]
    idx = index("struct pct { void (*hook)(int); };\nstruct pct *pick(void);\nvoid f(void) {\n  pick()->hook;\n}")
    use = next(r for r in idx["refs"] if r["name"] == "hook" and r["line"] == 3)
    assert use["obj_chain"] == ["@call:pick"] and use["owner"] == "pct"
    idx = index("struct Panel {\n  int tall;\n  int w() { return this->tall; }\n  int w2() { return (*this).tall; }\n};", "/t.cpp")
    assert [owner(idx, "tall", k) for k in (1, 2, 3)] == ["Panel"] * 3
    idx = index("struct X { int field; struct X *kids; };\nstruct Y { struct X xs[4]; struct X *xp; };\nvoid f(struct X arr[4], struct X *p, struct Y *y) {\n"
                "  arr[0]->field;\n  p[1].field;\n  y->xs[2].field;\n  (*p).field;\n}")
    assert [owner(idx, "field", k) for k in (3, 4, 5, 6)] == ["X"] * 4
    idx = index("struct S {\n  void (*hook)(int, size_t);\n  int *ptr;\n  char buf[8];\n};")
    assert [owner(idx, n, k) for n, k in (("hook", 1), ("ptr", 2), ("buf", 3))] == ["S"] * 3


def test_anonymous_aggregates_and_attributes():
    idx = index("struct io_req {\n\tunion {\n\t\tunsigned int raw;\n\t\tstruct {\n\t\t\tunsigned char cmd;\n\t\t\tunsigned char hook;\n\t\t} __packed burst;\n"
                "\t} __packed;\n\tunsigned long __reserved;\n\tint PACKED;\n};")
    assert not one(idx, "__packed")
    dma = one(idx, "burst", "field")
    assert dma["scope"] == one(idx, "raw")["scope"] == "io_req" == one(idx, "__reserved")["scope"] == one(idx, "PACKED")["scope"]
    assert dma["data_type"].startswith("@anon:") and one(idx, "hook")["scope"] == dma["data_type"]
    idx = index("struct frame_part {\n int id;\n union {\n struct {\n int x;\n } point;\n long bulk;\n } body;\n};")
    assert {"frame_part"} == set(names(idx, "struct")) and {"id", "x", "point", "bulk", "body"} == set(names(idx, "field"))
    idx = index("struct StatusWord {\n unsigned int enable : 1;\n unsigned int : 4;\n unsigned int value : 24;\n};")
    assert names(idx, "field") == ["enable", "value"]
    idx = index("struct __attribute__((packed)) Tight {\n char a;\n};\nvoid __attribute__((noreturn)) give_up(const char *msg) {\n while(1) {}\n}")
    assert one(idx, "Tight", "struct") and one(idx, "give_up", "function")
    assert names(index("enum {\n E_OK = 0,\n E_LATE\n};")) == ["E_OK", "E_LATE"]


def test_designated_initializers():
    idx = index("struct msg data = { .hook = 5 };\n")
    assert owner(idx, "hook", 0) == "msg"
    idx = index("struct Inner { int b; };\nstruct T { struct Inner a; };\nstruct T x = { .a.b = 5 };")
    assert (owner(idx, "a", 2), owner(idx, "b", 2)) == ("T", "Inner")
    idx = index("struct Inner { int hook; };\nstruct Outer { struct Inner inner; };\nstruct Outer o = { .inner = { .hook = 5 } };")
    assert (owner(idx, "inner", 2), owner(idx, "hook", 2)) == ("Outer", "Inner")
    idx = index("struct T arr[] = { { .hook = 5 } };\n")
    assert owner(idx, "hook", 0) == "" and not next(r for r in idx["refs"] if r["name"] == "hook")["obj_chain"]


def test_interpreter_and_swallowing_condition():
    idx = index("static unsigned short fold_byte(unsigned short v) { return v; }\nunsigned long step_all(unsigned char *pc, unsigned long *regs)\n{\n"
                "\tstatic void * const jt[256] = { [0 ... 255] = &&L_one, [7] = &&L_two, };\n\tgoto *jt[*pc];\nL_two:\n"
                "\tregs[0] = ({ unsigned short t = fold_byte(regs[1]); (unsigned long)t; });\n\tgoto *jt[*++pc];\nL_one:\n\treturn regs[0];\n}\n")
    assert idx["parsed_by"] == "ts" and one(idx, "step_all", "function")
    assert next(c for c in idx["calls"] if c["callee"] == "fold_byte")["caller"] == "step_all"
    idx = index("#define RAID_MOST_BANDS      (16U)\nvoid BANK_TWO RAID_Sweep(State_t* st, int lane)\n{\n    while (st->box.ready &&\n"
                "           st->box.counter < st->box.quota[lane] &&\n           st->used < st->most &&\n"
                "           (!IS_AWAKE(st->buf.id) || AT_REST((NEXT_OF(st->buf, K)), st->opId)))\n    {\n        RAID_Turn(st);\n    }\n}\n")
    assert one(idx, "RAID_MOST_BANDS", "macro") and one(idx, "RAID_Sweep", "function")
    assert ("RAID_Sweep", "RAID_Turn") in {(c["caller"], c["callee"]) for c in idx["calls"]}


def test_cpp():
    idx = index("class Vec {\npublic:\n    Vec operator+(const Vec& rhs);\n    bool operator==(const Vec& rhs);\n};\nSocket::~Socket() {\n    free(fd_);\n}\n", "/t.cpp")
    assert any("operator+" in n for n in names(idx)) and "~Socket" in names(idx, "function")
    idx = index('extern "C" {\n    void Boot(void) {\n        wake();\n    }\n    int Halt(int code);\n}\n', "/t.cpp")
    assert names(idx, "function") == ["Boot"] and names(idx, "prototype") == ["Halt"]
    idx = index("template<typename T>\nclass Holder {\npublic:\n    T* get();\n    void reset(T* p);\n};\ntemplate<typename T>\nT larger(T a, T b) {\n    return (a > b) ? a : b;\n}\n", "/t.cpp")
    assert names(idx, "class") == ["Holder"] and {s["name"] for s in idx["symbols"] if s["scope"] == "Holder"} == {"get", "reset"}
    assert names(idx, "function") == ["larger"]
    idx = index("using MyInt = int;\nusing Notify = void(*)(int, int);\nnamespace Engine {\n    class Driver {\n    public:\n        void init();\n    };\n}\nauto answer() -> int {\n return 42;\n}\n", "/t.cpp")
    assert names(idx, "typedef") == ["MyInt", "Notify"] and names(idx, "namespace") == ["Engine"] and names(idx, "class") == ["Driver"]
    assert one(idx, "init")["kind"] == "field" and one(idx, "answer")["kind"] == "function"
    idx = index("extern int g_total;\nextern const char* g_label;", "/t.c")
    assert [(s["kind"], s["is_definition"]) for s in idx["symbols"]] == [("global_variable", False)] * 2


def test_old_style_definitions():
    idx = index("struct cell *seek(from, key, same)\nregister struct cell *from; long key;\nint (*same)();\n{ return from->next; }\n"
                "main(argc, argv) char **argv; { return seek(argv); }\nint later(a, b);\nint after(void) { return 1; }\n")
    assert [(s["name"], s["kind"], s["arity"], s["param_types"]) for s in idx["symbols"]] == [
        ("seek", "function", 3, "struct cell,long,int"), ("main", "function", 2, "int,char"), ("later", "prototype", 2, "a,b"), ("after", "function", 0, "")]
    assert [(x["func"], x["name"]) for x in idx["locals"]] == [("seek", "from"), ("seek", "key"), ("seek", "same"), ("main", "argv")]
    assert owner(index("struct cell { int next; };\nint seek(c) struct cell *c; {\n return c->next; }\n"), "next", 2) == "cell"
    assert names(index("int f(a) NOTED; int x; struct s { int y; };\n")) == ["f", "x", "s", "y"]


@pytest.mark.parametrize("text", ["typedef struct { int a; } PACKED Told;", "typedef struct tag BOXED Told;", "typedef long lowered Told;",
                                  "typedef struct { int a; } ALIGN(4) Told;", "typedef unsigned FAR_CALL (*Told)(int);", "typedef struct { int a; }\nPACKED\nTold;"])
def test_macros_in_typedefs(text):
    assert names(index(text), "typedef") == ["Told"]


def test_constructors_and_scopes():
    idx = index("class Pot { public: Pot(int n) : held(n) { fill(n); } Pot(); virtual ~Pot(); int held; };\n"
                "Pot::~Pot() { drop(); }\nint shop::shelf::Pot::weigh(int by) { return by; }\n", "/t.cpp")
    assert [(s["name"], s["kind"], s["arity"]) for s in idx["symbols"]] == [
        ("Pot", "class", None), ("Pot", "function", 1), ("held", "field", None), ("~Pot", "function", None), ("weigh", "function", 1)]
    assert [(c["caller"], c["callee"]) for c in idx["calls"]] == [("Pot", "fill"), ("~Pot", "drop")]
    assert [r["role"] for r in idx["refs"] if r["name"] in ("shop", "shelf")] == ["namespace", "namespace"]
    assert sum(r["name"] == "Pot" for r in idx["refs"]) == 7
    assert [(r["role"], r["owner"]) for r in idx["refs"] if r["name"] == "held"] == [("field", ""), ("field", "Pot")]
    idx = index("struct Mug : Cup { Mug(int n) noexcept : Cup{n}, a::Lid<int>(make(n)), rest(n)... { } };\n", "/t.cpp")
    assert [c["callee"] for c in idx["calls"]] == ["make"]
    assert [(r["name"], r["role"]) for r in idx["refs"] if r["name"] in ("a", "Lid", "rest")] == [("a", "namespace"), ("Lid", "field"), ("rest", "field")]


def test_macro_wrapped_variables():
    for kb in (2048, 0):
        idx = index("U32 IN_BANK(gTicks, 4);\nFoo_t LAID(ALIGNED(gRows[8], 4), FAST);\nvoid RESET(void);\n", max_file_size_kb=kb)
        assert {"gTicks", "gRows"} <= set(names(idx, "global_variable")), kb
        assert not {"IN_BANK", "LAID"} & set(names(idx)) and not {"IN_BANK", "LAID"} & {c["callee"] for c in idx["calls"]}


def test_scanner_quirks():
    idx = index("struct Foo *p;\nreturn foo(x);\n\tp->hook = s.hook;\nextern void (*op)(int);\nvoid g(void)\n{\n}\n", max_file_size_kb=0)
    assert "Fo" in names(idx, "struct") and "foo" in names(idx, "prototype") and "g" not in names(idx, "function")
    assert [r["role"] for r in idx["refs"] if r["name"] == "hook"] == ["field", "field"]
    assert not one(idx, "op", "global_variable")["is_definition"]


def test_scanner_looks_back_over_the_whole_line():
    idx = index("\tp->" + " " * 300 + "far = s . near .. no;\n", max_file_size_kb=0)
    assert {r["name"]: r["role"] for r in idx["refs"]} == {"p": "", "far": "field", "s": "", "near": "field", "no": ""}


def test_scanner_bodies():
    idx = index("int a(int x) {\n  if (x) { b(); }\n  c();\n}\nd();\n", max_file_size_kb=0)
    assert [(c["caller"], c["callee"]) for c in idx["calls"]] == [("a", "a"), ("a", "b"), ("a", "c"), (None, "d")]


def test_parser_failures_are_told(monkeypatch):
    from lodestone.extract import file_index

    def fail(*_):
        raise IndexError("no such token")

    monkeypatch.setattr(file_index, "parse", fail)
    idx = index("int x;\n")
    assert idx["parsed_by"] == "grep" and "IndexError" in idx["parse_error"]
