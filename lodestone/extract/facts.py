"""Fact rows of one source file, in the order they are found."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Facts:
    """The five fact relations of a file as rows of dicts."""

    source: str
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    locals: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)
    #: What kept the parser from reading the file, for facts of the line scanner.
    parse_error: str | None = None

    def symbol(self, name: str, kind: str, line: int, col: int, *, definition: bool = True, scope: str = "", data_type: str = "",
               decl_type: str = "", signature: str = "", return_type: str = "", storage: str = "", arity: int | None = None,
               param_types: str = "") -> None:
        self.symbols.append({
            "ord": len(self.symbols), "name": name, "kind": kind, "line": line, "col": col, "end_line": line, "end_col": col + len(name),
            "is_definition": definition, "source": self.source, "scope": scope, "data_type": data_type, "decl_type": decl_type,
            "signature": signature, "return_type": return_type, "storage": storage, "arity": arity, "param_types": param_types})

    def ref(self, name: str, line: int, col: int, *, func: str | None = None, role: str = "", owner: str = "",
            chain: list[str] | None = None) -> dict:
        row = {"ord": len(self.refs), "name": name, "line": line, "col": col, "enclosing_func": func, "is_local": False, "role": role,
               "owner": owner, "obj_chain": chain or [], "source": self.source}
        self.refs.append(row)
        return row

    def call(self, caller: str | None, callee: str, line: int, col: int) -> None:
        self.calls.append({"ord": len(self.calls), "caller": caller, "callee": callee, "line": line, "col": col, "source": self.source})

    def local(self, name: str, kind: str, func: str, line: int, col: int, data_type: str, decl_type: str) -> None:
        self.locals.append({"ord": len(self.locals), "name": name, "kind": kind, "func": func, "line": line, "col": col, "end_line": line,
                            "end_col": col + len(name), "data_type": data_type, "decl_type": decl_type})

    def alias(self, name: str, target: str) -> None:
        self.aliases.append({"ord": len(self.aliases), "name": name, "target": target})
