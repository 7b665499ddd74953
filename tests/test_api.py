"""The facade, latest-wins runs and folder rules."""

import threading

from lodestone.api import CodeIndex
from lodestone.sources.exclusion import excluded_in_folders, rules_of
from lodestone.streaming.runner import LatestRunner


def test_facade(spark, tmp_path):
    tree = tmp_path / "src"
    tree.mkdir()
    (tree / "a.c").write_text("int helper(int a) { return a; }\nint run(void) { return helper(1); }\n")
    ix = CodeIndex(spark, str(tmp_path / "ix"))
    assert ix.current() is None and ix.search("helper") is None and ix.definition("a.c", 0, 4, "int helper") is None
    assert ix.reindex(str(tree)).version == 1
    rows = ix.definition("a.c", 1, 25, "int run(void) { return helper(1); }").collect()
    assert [(r.file, r.line, r.status) for r in rows] == [("a.c", 0, "hit")]
    assert [r.label for r in ix.search("hel").collect()] == ["helper"] and [r.name for r in ix.calls("helper").collect()] == ["run"]
    files = spark.createDataFrame([("a.c", (tree / "a.c").read_text())], "path string, text string")
    again = ix.insight_of_calls("helper", files).collect()
    assert {r.label for r in again if r.category == "Definition"} == {"a.c:1"} and {r.label for r in again if r.category == "Called by"} == {"run"}
    ix.update_buffer("a.c", "int other;", 5)
    assert [r["name"] for r in ix.symbols("other").collect()] == ["other"] and ix.symbols("helper").count() == 0
    ix.remove("a.c")
    assert ix.current().files.count() == 0


def test_newest_request_wins(spark):
    runner = LatestRunner(spark)
    started, go, out = threading.Event(), threading.Event(), {}

    def slow():
        started.set()
        go.wait(10)
        raise RuntimeError("cancelled")

    first = threading.Thread(target=lambda: out.update(first=runner.request(slow)))
    first.start()
    started.wait(10)
    second = threading.Thread(target=lambda: out.update(second=runner.request(lambda: "done")))
    second.start()
    while runner._newest < 2:
        pass
    go.set()
    first.join(10)
    second.join(10)
    assert out == {"first": None, "second": "done"}


def test_folders():
    rules = rules_of((), ("**/inner/**",))
    assert excluded_in_folders("/w/inner/a.c", ["/w", "/w/inner"], rules) and not excluded_in_folders("/w/x/a.c", ["/w"], rules)
