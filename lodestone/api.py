"""One object for an index's users: build, refresh, remove, and the questions by cursor or by name."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from .operators import lookup, report, resolve, search
from .operators.graph import call_tree
from .operators.maintenance import STALE_S, Index
from .options import IndexOptions
from .sources.scan import buffers, scan_files
from .streaming.runner import LatestRunner

CURSOR = "req_id int, file string, line int, character int, line_text string"


class CodeIndex:
    """An index folder and its options. Questions are asked of the version that is current when they are asked."""

    def __init__(self, spark: SparkSession, path: str, options: IndexOptions | None = None):
        self.spark, self.path, self.options = spark, path, options or IndexOptions()
        self._runner = LatestRunner(spark)
        self._halt = threading.Event()

    # -- maintenance

    def reindex(self, root: str, force: bool = False, folder: str | None = None) -> Index | None:
        """Brings the index up to date with a tree; ``force`` parses everything anew. None if a newer request took over.

        After ``stop`` it ends with what is parsed by then.
        """
        self._halt.clear()
        return self._runner.request(lambda: Index.build(self.spark, self.path, scan_files(self.spark, root, self.options, folder), self.options, force,
                                                        stop=self._halt.is_set))

    def update_buffer(self, file: str, text: str, mtime: int) -> Index | None:
        """Indexes an unsaved text under its path; other files stay."""
        return self._runner.request(lambda: Index.build(self.spark, self.path, buffers(self.spark, [(file, text, mtime)]), self.options, partial=True))

    def remove(self, *files: str) -> Index | None:
        gone = self.spark.createDataFrame([(f,) for f in files], "path string")
        return self._runner.request(lambda: Index.build(self.spark, self.path, buffers(self.spark, []), self.options, partial=True, removed=gone))

    def stop(self) -> None:
        """Ends a running reindex at the next slice of its files; the index keeps what is parsed."""
        self._halt.set()

    def vacuum(self, keep: int = 2, older_than_s: float = STALE_S) -> list[str]:
        return Index.vacuum(self.spark, self.path, keep, older_than_s)

    def current(self) -> Index | None:
        """The current version, after a bounded wait for a running build."""
        self._runner.wait(self.options.defer_queries_ms)
        return Index.open(self.spark, self.path)

    # -- questions

    def _cursor(self, file: str, line: int, character: int, line_text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, file, line, character, line_text)], CURSOR)

    def _ask(self, question, file: str, line: int, character: int, line_text: str) -> DataFrame | None:
        index = self.current()
        if index is None:
            return None
        return question(self._cursor(file, line, character, line_text), index.symbols, index.refs, index.locals, index.aliases)

    def definition(self, file: str, line: int, character: int, line_text: str) -> DataFrame | None:
        return self._ask(resolve.goto_definition, file, line, character, line_text)

    def references(self, file: str, line: int, character: int, line_text: str) -> DataFrame | None:
        return self._ask(resolve.resolve_references, file, line, character, line_text)

    def insight(self, file: str, line: int, character: int, line_text: str) -> DataFrame | None:
        index = self.current()
        return None if index is None else self._ask(
            lambda *a: report.code_insight(*a, index.calls, self.options.hidden_categories, self.options.hide_empty), file, line, character, line_text)

    def insight_of_calls(self, name: str, files: DataFrame, direction: str = "callers") -> DataFrame | None:
        """The insight of each first call site of a name's neighbours, asked anew at the site; ``files(path, text)`` gives the lines."""
        index = self.current()
        if index is None:
            return None
        cursors = report.call_site_cursors(call_tree(index.calls, direction, self.spark.createDataFrame([(name,)], "root string"), 1), files)
        return report.code_insight(cursors, index.symbols, index.refs, index.locals, index.aliases, index.calls, self.options.hidden_categories,
                                   self.options.hide_empty)

    def search(self, text: str) -> DataFrame | None:
        index = self.current()
        return None if index is None else search.search(index.symbols, text, self.options)

    def symbols(self, name: str) -> DataFrame | None:
        index = self.current()
        return None if index is None else lookup.find_symbols(index.symbols, name)

    def calls(self, name: str, direction: str = "callers", depth: int = 1) -> DataFrame | None:
        index = self.current()
        return None if index is None else call_tree(index.calls, direction, self.spark.createDataFrame([(name,)], "root string"), depth)
