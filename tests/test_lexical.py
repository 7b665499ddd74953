"""Lexical functions, rules, query grammar and fuzzy scores by example."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import lexical as lx
from lodestone.functions.fuzzy import bonus, fuzzy_score, gap
from lodestone.functions.tags import candidate_tags, suffix_tags
from lodestone.operators.search import parse_query
from lodestone.operators.types import aggregate_tag
from lodestone.sources.exclusion import excluded, glob_regex, is_excluded, parse_ignore, rules_of


def test_comments_and_masks():
    assert lx.strip_comments('a /* x\ny */ b // c\n"// no" \'"\' d') == 'a     \n     b     \n"// no" \'"\' d'
    assert lx.strip_comments('"open\n// still text" // gone') == '"open\n// still text"        '
    masks = lx.mask_lines(["a /* b", "c */ d", '"x', "y"])
    assert [bytes(m) for m in masks] == [b"\0\0\1\1\1\1", b"\1\1\1\1\0\0", b"\1\1", b"\0"]
    assert lx.is_inside_comment_or_string('f("x", y)', 3) and not lx.is_inside_comment_or_string('f("x", y)', 7) and not lx.is_inside_comment_or_string("a", 9)
    assert [lx.is_comment_or_string_line(x) for x in ("  // a", "/* b", " * c", "d // e")] == [True, True, True, False]


def test_grep_word():
    text = "\n/*\n * targetFunc() here\n */\nvoid caller() {\n    targetFunc(); notTargetFunc(); targetFuncEx();\n    printf(\"\\\"targetFunc\\\" now\"); x = 'a'; // targetFunc\n}\n"
    assert lx.grep_word(text, "targetFunc") == [(5, 4)] and lx.grep_word(text, "") == []
    assert lx.grep_word("targetFunc(); /* targetFunc */ targetFunc();", "targetFunc") == [(0, 0), (0, 31)]


@given(st.text(alphabet="ab \n\"'/*\\", max_size=40))
def test_grep_word_agrees_with_masks(text):
    lines = text.split("\n")
    want = [(k, m.start()) for k, (line, mask) in enumerate(zip(lines, lx.mask_lines(lines), strict=True)) for m in re.finditer(r"(?<!\w)a(?!\w)", line) if not mask[m.start()]]
    assert lx.grep_word(text, "a") == want
    assert len(lx.strip_comments(text)) == len(text) and lx.strip_comments(text).count("\n") == text.count("\n")


@pytest.mark.parametrize(("text", "want"), [("()", 0), ("(a)", 1), ("(a, b)", 2), ("(f(x, y), z, w)", 3), ('(a, "x, y")', 2), ("([a, b], {c, d}, e)", 3), (" x", None), ("(a, b", None),
                                            ("(\")\"", None), ("(',', x)", 2), ("(,)", 0), ("( , ,)", 0), ("(a,)", 2)])
def test_call_arguments(text, want):
    assert lx.count_call_args(text) == want


def test_chains():
    assert lx.object_name("(*p)") == "p" and lx.object_name("arr[0]") == "arr" and lx.object_name("getObj()") is None and lx.object_name("foo(x)") == "x"
    assert lx.member_chain("outer->rtf") == ["outer", "rtf"] and lx.member_chain("a") == ["a"] and lx.member_chain("x = y[1].z") == ["y", "z"]
    c = lx.symbol_context("  a->b.c(1, 2);", 7)
    assert (c.word, c.is_member_access, c.member_chain, c.object_name, c.call_arity) == ("c", True, ["a", "b"], "b", 2)
    assert lx.symbol_context("Foo::bar", 6).scope == "Foo" and lx.symbol_context("Foo::bar", 1).word == "bar" and lx.symbol_context("return x", 2).word == ""
    assert lx.is_call_target("x = ", " (a)") and not lx.is_call_target("p->", "(a)") and not lx.is_call_target("x = ", ";")
    assert lx.tag_kinds_before("  struct ") == ["struct", "class"] and lx.tag_kinds_before("my_struct ") is None and lx.tag_kinds_before("enum") is None


def test_function_headers():
    assert lx.looks_like_func_def(["int add(int a)", "{"], 0, "add") and lx.looks_like_func_def(["void MACRO f(int a) __attr {"], 0, "f")
    assert not lx.looks_like_func_def(["  return add(1);", "{"], 0, "add") and not lx.looks_like_func_def(["#define add(x) {"], 0, "add")
    assert not lx.looks_like_func_def(["int add(int);"], 0, "add") and lx.looks_like_func_def(["static int", "add(void)", "{"], 1, "add")
    r = lx.FuncRanges("int a(void)\n{\n  if (x) { }\n}\nint b(void);\nint c(void) { {\n", [("a", 0, 4), ("b", 4, 4), ("c", 5, 4), ("z", 99, 0)])
    assert [(x.name, x.start_line, x.end_line) for x in r.ranges] == [("a", 0, 3)] and r.at(2) == "a" and r.at(4) is None


def test_tags(spark):
    assert suffix_tags("Foo_t") == ["Foo_s", "Foo_e", "Foo_u", "Foo"] and suffix_tags("Foo") == [] == suffix_tags("Foo_tt")
    assert candidate_tags("A", {"A": "B", "B": "A"}) == ["A", "B"]
    texts = ["struct X *", "const unsigned long", "MyNS::Config &", "std::vector<int>", "int", "", "struct", "Foo_t", "class A::B", "unsigned foo", None, "enum  E"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", aggregate_tag(F.col("t")).alias("tag")).collect()
    assert [r.tag for r in rows] == [lx.aggregate_tag(t) for t in texts]
    assert [lx.aggregate_tag(t) for t in texts[:5]] == ["X", None, "Config", "vector", None]


def test_rules(spark):
    rules = rules_of(("src/**",), ("**/gen/**", "*.tmp", "a?c"))
    cases = ["gen/a.c", "x/gen/y/a.c", "a.tmp", "d/a.tmp", "abc", "a/c", "src/gen/a.c", "src\\gen\\b.c", "ok.c"]
    assert [is_excluded(c, rules) for c in cases] == [True, True, True, False, True, False, False, False, False]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert [r[0] for r in df.select(excluded(F.col("p"), rules)).collect()] == [is_excluded(c, rules) for c in cases]
    assert is_excluded("a.c", rules_of((), ("**/proj/**",)), "proj") and not is_excluded("a.c", rules_of((), ("**/proj/**",)))
    assert not is_excluded("src/foo.c", rules_of(("src/**",), ("proj/**",)), "proj")
    assert [(r.pattern, r.negated) for r in parse_ignore("# c\n\n!keep.c\n/root\nbuild/\n")] == [
        ("keep.c", True), ("**/keep.c", True), ("root", False), ("build/**", False), ("**/build/**", False)]
    assert glob_regex("a+b.c") == r"^a\+b\.c$"


def test_query_grammar():
    q = parse_query("t:io")
    assert (q.mode, q.term) == ("fuzzy", "io") and "struct" in q.kinds
    assert parse_query("f::bar").kinds is None and parse_query("l: again").term == "again" and parse_query("g:x").term == "g:x"
    assert (parse_query("f:'main").mode, parse_query("^ab").mode, parse_query("  x").term) == ("exact", "prefix", "x")


def test_fuzzy_scores_equal_plain_dynamic_programming():
    rng = random.Random(2)

    def plain(p, t):
        low = t.lower()
        best = {}
        for k, ch in enumerate(p.lower()):
            new = {}
            for j in range(len(t)):
                if low[j] != ch:
                    continue
                if k == 0:
                    new[j] = 16 + 2 * bonus(t, j) + gap(j)
                else:
                    c = [v + 16 + (max(bonus(t, j), 6) if i == j - 1 else gap(j - 1 - i) + bonus(t, j)) for i, v in best.items() if i < j]
                    if c:
                        new[j] = max(c)
            best = new
        return max(best.values(), default=None) if p else 0

    for _ in range(500):
        t = "".join(rng.choice("aAbB_1") for _ in range(rng.randint(0, 12)))
        p = "".join(rng.choice("ab1") for _ in range(rng.randint(1, 4)))
        assert fuzzy_score(p, t) == (plain(p, t) if len(p) <= len(t) else None), (p, t)
    assert fuzzy_score("svc", "SVC_IsMigration") > fuzzy_score("svc", "SomeVeryLongCall") and fuzzy_score("x", "abc") is None
