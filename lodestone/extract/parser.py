"""Tolerant parser of C and C++ declarations and expressions: source text to fact rows.

Not a compiler's parser: no preprocessing, no types, no overloads. It walks tokens in one pass, recognises declarations by
their shape (specifiers, then declarators, then a body or a semicolon), reads statements of bodies, and looks at
expressions only for calls, member accesses and designators. Whatever it cannot read it skips to the next semicolon or
block and counts as error, so unknown macros and extensions cost at most the declaration they stand in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.keywords import HARD
from ..functions.lexical import FuncRanges, aggregate_tag, root_marker
from ..functions.tags import candidate_tags
from .facts import Facts
from .tokens import Token, match_brackets, tokenize

# Words of declarations.
STORAGE = frozenset("extern static auto register inline thread_local _Thread_local __inline __inline__".split())
QUALIFIERS = frozenset("""const volatile restrict _Atomic constexpr constinit consteval mutable virtual explicit friend typename
__restrict __restrict__ __const __volatile__ __extension__ _Noreturn noexcept override final __signed__""".split())
PRIMITIVE = frozenset("""void bool _Bool char short int long float double signed unsigned wchar_t char8_t char16_t char32_t _Complex
__complex__ _Imaginary size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t
nullptr_t max_align_t __int128 _Decimal32 _Decimal64 _Decimal128""".split())
AGGREGATES = frozenset("struct union enum class".split())
ATTRIBUTE = frozenset("__attribute__ __attribute __declspec _Alignas alignas __asm__ asm __asm _Static_assert static_assert".split())
CONTROL = frozenset("if while switch for do else return goto break continue case default try catch".split())
NOT_CALLED = HARD - STORAGE
#: How far before the first token a look back may reach.
MARGIN = 8
MACRO_SHAPE = re.compile(r"__[a-z]\w*|[A-Z][A-Z0-9_]*[A-Z][A-Z0-9_]*")


@dataclass
class Spec:
    """Specifiers of a declaration."""

    start: int
    storage: list[str] = field(default_factory=list)
    type_text: str = ""
    tag: str = ""  # aggregate or type name, empty for primitives
    body: bool = False  # an aggregate with a body
    typedef: bool = False
    aggregate: str = ""  # keyword of an aggregate specifier
    named: bool = False
    fields: list[dict] = field(default_factory=list)  # symbols of an unnamed aggregate's own fields, to be promoted
    anonymous_at: tuple[int, int] | None = None


@dataclass
class Declarator:
    name: int = -1  # token index
    name_text: str = ""
    params: int = -1  # index of the parameter list's bracket, for a function
    pointer: bool = False  # the name lies in brackets with a star: pointer to function
    start: int = -1
    after: int = -1


class Parser:
    """One source file. ``facts`` holds its rows after ``run``; ``error_ratio`` the share of unread characters."""

    def __init__(self, text: str, path: str, lang: str):
        self.text, self.path, self.cpp = text, path, lang == "cpp"
        self.t, self.lines, self.errors = tokenize(text)
        # Texts and kinds by index, with empty ones on both sides: a negative index reads the end of the list.
        self.words = [t.text for t in self.t] + [""] * MARGIN
        self.ids = [t.kind == "id" for t in self.t] + [False] * MARGIN
        self.pair, lost = match_brackets(self.t)
        self.errors += lost
        self.facts = Facts(source="ts")
        self.refs: dict[int, dict] = {}
        self.func: str | None = None
        self.aggregate: str | None = None

    # -- small views of the token list

    def at(self, i: int) -> str:
        try:
            return self.words[i]
        except IndexError:
            return ""

    def is_id(self, i: int) -> bool:
        try:
            return self.ids[i]
        except IndexError:
            return False

    def close(self, i: int) -> int:
        return self.pair.get(i, i)

    def span(self, a: int, b: int) -> str:
        """Text of tokens a to b (not included), blanks collapsed."""
        if a >= b or a >= len(self.t):
            return ""
        return " ".join(self.text[self.t[a].pos : self.t[min(b, len(self.t)) - 1].end].split())

    def skipped(self, a: int, b: int) -> None:
        if a < b and a < len(self.t):
            self.errors += self.t[min(b, len(self.t)) - 1].end - self.t[a].pos

    # -- rows

    def ref(self, i: int, role: str, owner: str = "", chain: list[str] | None = None) -> None:
        t = self.t[i]
        self.refs[i] = {"name": t.text, "line": t.line, "col": t.col, "func": self.func, "role": role, "owner": owner, "chain": chain or []}

    def symbol(self, i: int, kind: str, name: str | None = None, **more) -> None:
        t = self.t[i]
        self.facts.symbol(name or t.text, kind, t.line, t.col, **more)

    # -- file

    def run(self) -> Parser:
        self.unit(0, len(self.t))
        self.directives()
        self.finish()
        return self

    @property
    def error_ratio(self) -> float:
        return min(1.0, self.errors / max(len(self.text.strip()), 1))

    def directives(self) -> None:
        for d in self.lines:
            body = re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: " " * len(m[0]), d.rest, flags=re.S)
            if d.word == "define" and (m := re.match(r"\s*([A-Za-z_]\w*)(\([^)]*\))?", body)):
                col = d.col + m.start(1)
                self.facts.symbol(m[1], "macro", d.line, col)
                words = [(m[1], col)] + [(p[0], d.col + m.start(2) + p.start()) for p in re.finditer(r"[A-Za-z_]\w*", m[2] or "")]
            elif d.word in ("if", "ifdef", "ifndef", "elif", "undef"):
                words = [(p[0], d.col + p.start()) for p in re.finditer(r"[A-Za-z_]\w*", body.partition("\n")[0])]
            else:
                continue
            for k, (word, col) in enumerate(words):
                if word not in HARD:
                    self.refs[-1 - len(self.refs) - k] = {"name": word, "line": d.line, "col": col, "func": None, "role": "value", "owner": "", "chain": []}

    def unit(self, i: int, end: int) -> None:
        """Declarations of a file, a namespace or a linkage block."""
        while i < end:
            i = max(self.external(i, end), i + 1)

    def external(self, i: int, end: int) -> int:
        word = self.at(i)
        if word in (";", "}"):
            return i + 1
        if word == "extern" and self.t[i + 1 : i + 2] and self.t[i + 1].kind == "str":
            if self.at(i + 2) == "{":
                self.unit(i + 3, min(self.close(i + 2), end))
                return self.close(i + 2) + 1
            return self.external(i + 2, end)
        if self.cpp:
            done = self.cpp_external(i, end)
            if done:
                return done
        if word in ATTRIBUTE and self.at(i + 1) == "(" and word in ("_Static_assert", "static_assert", "asm", "__asm__", "__asm"):
            return self.close(i + 1) + 1
        return self.declaration(i, end)

    def cpp_external(self, i: int, end: int) -> int:
        word = self.at(i)
        if word == "inline" and self.at(i + 1) == "namespace":
            i, word = i + 1, "namespace"
        if word == "namespace":
            k = i + 1
            while self.is_id(k) or self.at(k) == "::":
                if self.is_id(k):
                    self.ref(k, "namespace")
                    if self.at(k + 1) in ("{", "::"):
                        self.symbol(k, "namespace")
                k += 1
            if self.at(k) == "{":
                self.unit(k + 1, min(self.close(k), end))
                return self.close(k) + 1
            return self.to_semicolon(k, end) + 1
        if word == "template" and self.at(i + 1) == "<":
            k = self.angle(i + 1)
            for j in range(i + 2, k - 1):
                if self.is_id(j) and self.at(j) not in HARD:
                    self.ref(j, "type")
            return self.external(k, end)
        if word == "using":
            stop = self.to_semicolon(i, end)
            if self.is_id(i + 1) and self.at(i + 2) == "=":
                self.symbol(i + 1, "typedef")
                self.ref(i + 1, "type")
                self.types(i + 3, stop)
            else:
                for j in range(i + 1, stop):
                    if self.is_id(j) and self.at(j) not in HARD:
                        self.ref(j, "namespace" if self.at(j - 1) == "namespace" or self.at(j + 1) == "::" else "value")
            return stop + 1
        if word in ("public", "private", "protected") and self.at(i + 1) == ":":
            return i + 2
        return 0

    def angle(self, i: int) -> int:
        """Index after the angle bracket that closes the one at i."""
        depth = 0
        while i < len(self.t):
            x = self.at(i)
            depth += {"<": 1, ">": -1, ">>": -2, "<<": 2}.get(x, 0) if x in ("<", ">", ">>", "<<") else 0
            if x in (";", "{", "}"):
                return i
            i = self.close(i) + 1 if x in ("(", "[") else i + 1
            if depth <= 0:
                return i
        return i

    def to_semicolon(self, i: int, end: int) -> int:
        """Index of the semicolon that ends a statement, or of the block's end."""
        while i < end and self.at(i) not in (";", "}"):
            i = self.close(i) + 1 if self.at(i) in ("(", "[", "{") else i + 1
        return min(i, end)

    # -- specifiers

    def types(self, a: int, b: int) -> None:
        """References of a stretch that holds types."""
        for j in range(a, min(b, len(self.t))):
            if self.is_id(j) and self.at(j) not in HARD and self.at(j) not in PRIMITIVE:
                self.ref(j, "namespace" if self.at(j + 1) == "::" else "type")

    def attribute(self, i: int) -> int:
        """Index after an attribute at i, or i."""
        if self.at(i) in ATTRIBUTE:
            return self.close(i + 1) + 1 if self.at(i + 1) == "(" else i + 1
        if self.at(i) == "[" and self.at(i + 1) == "[" and self.close(i) == self.close(i + 1) + 1:
            return self.close(i) + 1
        return i

    def specifiers(self, i: int, end: int) -> tuple[Spec, int]:
        """Specifiers from i; stops at the first declarator token."""
        s = Spec(i)
        names: list[tuple[int, int]] = []  # type-like names seen: token range
        primitive: list[str] = []
        fixed = False  # an aggregate, or a primitive, is the type
        while i < end:
            word, k = self.at(i), self.attribute(i)
            if k != i:
                i = k
            elif word == "typedef":
                s.typedef, i = True, i + 1
            elif word in STORAGE:
                if not (word == "auto" and self.cpp):
                    s.storage.append(word)
                i += 1
            elif word in QUALIFIERS:
                i += 1
            elif word in AGGREGATES:
                i = self.aggregate_specifier(i, end, s)
                fixed = True
            elif word in PRIMITIVE and self.t[i].kind == "id":
                primitive.append(word)
                fixed, i = True, i + 1
            elif word in ("typeof", "__typeof__", "decltype", "_BitInt") and self.at(i + 1) == "(":
                self.expression(i + 2, self.close(i + 1))
                fixed, i = True, self.close(i + 1) + 1
            elif self.is_id(i) and word not in HARD:
                stop = self.qualified(i)
                nxt = self.at(stop)
                pointer = nxt == "(" and self.at(stop + 1) in ("*", "^")  # a name before (*f)(…) is a type or a macro
                more = self.is_id(stop) or nxt in ("*", "&", "&&") or (pointer and (not fixed and not names or self.at(self.close(stop) + 1) == "("))
                more = more or nxt == "operator" or (self.attribute(stop) != stop and not self.ends_declarator(self.attribute(stop)))
                if not more or (nxt in QUALIFIERS and self.at(stop + 1) in ("{", ";")):
                    break
                if self.is_id(stop) and nxt in CONTROL:
                    break
                names.append((i, stop))
                i = stop
            elif self.is_id(i) and word == "operator":
                break
            else:
                break
        self.settle_type(s, names, primitive, fixed)
        return s, i

    def ends_declarator(self, i: int) -> bool:
        return self.at(i) in (";", "=", ",", "{", "[", ":", ")", "(") or i >= len(self.t)

    def qualified(self, i: int) -> int:
        """Index after a possibly qualified, possibly templated type name."""
        k = i + 1
        while True:
            if self.cpp and self.at(k) == "<":
                stop = self.angle(k)
                if self.at(stop - 1) not in (">", ">>"):
                    return k
                k = stop
            elif self.at(k) == "::" and self.is_id(k + 1):
                k += 2
            else:
                return k

    def settle_type(self, s: Spec, names: list[tuple[int, int]], primitive: list[str], fixed: bool) -> None:
        if s.aggregate:
            for a, b in names:
                self.types(a, b)
            return
        if primitive:
            s.type_text = " ".join(primitive)
            return
        if fixed or not names:
            return
        plain = [x for x in names if not MACRO_SHAPE.fullmatch(self.at(x[0]))]
        a, b = plain[-1] if plain else names[0]
        s.type_text = self.span(a, b)
        s.tag = aggregate_tag(s.type_text) or ""
        for x, y in names:
            self.types(x, y)

    def aggregate_specifier(self, i: int, end: int, s: Spec) -> int:
        """struct, union, class or enum at i: its symbol, its members, its references."""
        word, first = self.at(i), i
        i += 1
        if word == "enum" and self.at(i) in ("class", "struct"):
            i += 1
        name = -1
        while i < end:
            k = self.attribute(i)
            if k != i:
                i = k
            elif self.is_id(i) and self.at(i) not in HARD:
                stop = self.qualified(i)
                follows = self.at(stop)
                name = i
                if self.is_id(stop) and follows not in HARD and self.names_tag(stop):
                    i = stop  # an attribute macro stood before the tag
                    continue
                i = stop
                break
            else:
                break
        s.aggregate, s.named = word, name >= 0
        k = i
        if self.at(k) == "final":
            k += 1
        if self.at(k) == ":" and (word in ("class", "struct", "enum") and self.body_follows(k, end)):
            stop = k
            while stop < end and self.at(stop) != "{":
                stop += 1
            self.types(k + 1, stop)
            k = stop
        tag = self.at(i - 1) if name >= 0 else ""
        if name >= 0:
            last = max(j for j in range(name, i) if self.is_id(j))
            tag = self.at(name) if "<" in self.span(name, i) else self.at(last)
            self.types(name, i)
            at_name = name if "<" in self.span(name, i) else last
        if self.at(k) == "{":
            s.body = True
            stop = min(self.close(k), end)
            if name >= 0:
                self.symbol(at_name, word, scope="")
            s.anonymous_at = (self.t[first].line, self.t[first].col)
            typedef_name = "" if name >= 0 or not s.typedef else self.typedef_name(stop + 1, end)
            s.tag = tag or typedef_name or f"@anon:{self.path}:{self.t[first].line}:{self.t[first].col}"
            if word == "enum":
                self.enumerators(k + 1, stop)
            else:
                before = len(self.facts.symbols)
                self.members(k + 1, stop, s.tag)
                s.fields = [x for x in self.facts.symbols[before:] if x["kind"] == "field" and x["scope"] == s.tag]
            s.type_text = self.span(first, stop + 1)
            return stop + 1
        s.tag, s.type_text = tag, self.span(first, i)
        if name >= 0 and (word == "class" or self.at(i) == ";") and not s.typedef and first == s.start:
            self.symbol(at_name, word, definition=word == "class")
        return i

    def names_tag(self, i: int) -> bool:
        """True if what is at i is the tag itself: a body or a base list comes after it."""
        stop = self.qualified(i)
        return self.at(stop) in ("{", ":") or (self.at(stop) == "final" and self.at(stop + 1) in ("{", ":"))

    def body_follows(self, i: int, end: int) -> bool:
        while i < end and self.at(i) not in (";", "{", "}", "=", "("):
            i += 1
        return i < end and self.at(i) == "{"

    def typedef_name(self, i: int, end: int) -> str:
        stop = self.to_semicolon(i, end)
        ids = [j for j in range(i, stop) if self.is_id(j) and self.at(j) not in HARD and self.at(j) not in ATTRIBUTE]
        head = [j for j in ids if "," not in [self.at(q) for q in range(i, j)] and self.at(j - 1) != "*"]
        return self.at(head[-1]) if head else ""

    def enumerators(self, i: int, end: int) -> None:
        fresh = True
        while i < end:
            if fresh and self.is_id(i):
                self.symbol(i, "enumerator")
                self.ref(i, "value")
                stop = i + 1
                while stop < end and self.at(stop) != ",":
                    stop = self.close(stop) + 1 if self.at(stop) in ("(", "[", "{") else stop + 1
                self.expression(i + 1, stop)
                i = stop
            fresh = self.at(i) == ","
            i += 1

    def members(self, i: int, end: int, owner: str) -> None:
        outer, self.aggregate = self.aggregate, owner
        while i < end:
            i = max(self.external_member(i, end, owner), i + 1)
        self.aggregate = outer

    def external_member(self, i: int, end: int, owner: str) -> int:
        if self.at(i) in (";", "}"):
            return i + 1
        if self.cpp:
            done = self.cpp_external(i, end)
            if done:
                return done
        return self.declaration(i, end, owner)

    # -- declarators

    def declarator(self, i: int, end: int) -> Declarator:
        d = Declarator(start=i)
        while i < end:
            k = self.attribute(i)
            if k != i:
                i = k
            elif self.at(i) in ("*", "&", "&&", "^") or self.at(i) in QUALIFIERS:
                i += 1
            elif self.is_id(i) and MACRO_SHAPE.fullmatch(self.at(i)) and self.is_id(i + 1) and self.at(i + 1) not in HARD:
                i += 1  # an attribute macro before the name
            else:
                break
        d.start = i
        word = self.at(i)
        if word == "(" and (self.at(i + 1) in ("*", "^", "&") or self.is_id(i + 1) and self.at(self.close(i) + 1) in ("(", "[", ";", "=", ",", ")")
                            and self.at(i + 1) not in HARD and self.at(i + 1) not in PRIMITIVE):
            stop = self.close(i)
            inner = self.declarator(i + 1, stop)
            d.name, d.name_text = inner.name, inner.name_text
            starred = self.at(i + 1) in ("*", "^", "&")
            i = stop + 1
            if inner.params >= 0:
                d.params, d.pointer = inner.params, inner.pointer
            elif self.at(i) == "(" and starred:
                d.pointer, d.params = True, i
            elif self.at(i) == "(":
                d.params = i
        elif word == "~" and self.is_id(i + 1):
            d.name, d.name_text, i = i + 1, "~" + self.at(i + 1), i + 2
        elif word == "operator" or (self.is_id(i) and word not in HARD):
            i = self.name(i, d)
        else:
            d.after = i
            return d
        while i < end:
            if self.at(i) == "(" and d.params < 0:
                d.params = i
                i = self.close(i) + 1
            elif self.at(i) == "(" and (d.pointer or i == d.params):
                i = self.close(i) + 1
            elif self.at(i) == "[":
                self.expression(i + 1, self.close(i))
                i = self.close(i) + 1
            else:
                k = self.attribute(i)
                if k == i:
                    break
                i = k
        d.after = i
        return d

    def name(self, i: int, d: Declarator) -> int:
        """Reads a declarator's name, possibly qualified, an operator or a destructor."""
        while self.is_id(i) and self.at(i) != "operator":
            stop = i + 1
            if self.cpp and self.at(stop) == "<" and self.at(self.angle(stop)) == "::":
                stop = self.angle(stop)
            if self.at(stop) != "::":
                d.name, d.name_text = i, self.at(i)
                return i + 1
            self.ref(i, "namespace")
            i = stop + 1
        if self.at(i) == "~":
            d.name, d.name_text = i + 1, "~" + self.at(i + 1)
            return i + 2
        if self.at(i) == "operator":
            d.name, k = i, i + 1
            if self.at(k) == "(" and self.at(k + 1) == ")":
                k += 2
            else:
                while k < len(self.t) and self.at(k) != "(":
                    k += 1
            d.name_text = "operator" + "".join(("" if not x.isalpha() or n == 0 and not x.isalpha() else " ") + x for n, x in enumerate(self.at(j) for j in range(i + 1, k)))
            return k
        return i

    # -- declarations

    def declaration(self, i: int, end: int, owner: str | None = None) -> int:
        """A declaration at file scope, in an aggregate (owner) or in a function; returns the index after it."""
        begin = i
        s, i = self.specifiers(i, end)
        local = self.func is not None and owner is None
        if i == begin and not local and self.is_id(i) and self.at(i + 1) == "(" and self.at(i) not in HARD:
            stop = self.close(i + 1)
            if self.at(stop + 1) not in ("{", ":", "->", "const", "noexcept") and owner is None and self.old_body(i + 1, stop + 1, end) < 0:
                # No type: a macro invocation, which may lack its semicolon.
                self.expression(i, stop + 1)
                return stop + 2 if self.at(stop + 1) == ";" else stop + 1
        if self.at(i) == ";":
            if s.body and not s.named and owner is not None and s.aggregate != "enum":
                self.promote(s, owner)
            return i + 1
        if i >= end:
            return end
        first = True
        while i < end:
            d = self.declarator(i, end)
            after = d.after
            if first and d.name >= 0 and d.params >= 0 and not d.pointer and not s.typedef:
                body = self.body_of(after, end)
                if body >= 0:
                    return self.function(s, d, body, begin)
                body = self.old_body(d.params, after, end) if not local and owner is None else -1
                if body >= 0:
                    return self.function(s, d, body, begin, old=True)
            if d.name < 0 and not (owner is not None and self.at(after) == ":"):
                if self.at(i) == "{" or self.at(after) == "{":
                    k = i if self.at(i) == "{" else after
                    self.skipped(begin, k)
                    self.unit(k + 1, min(self.close(k), end)) if not local else self.statements(k + 1, min(self.close(k), end))
                    return self.close(k) + 1
                stop = self.to_semicolon(after, end)
                if begin == i or not s.body:
                    self.skipped(begin, stop)
                return stop + 1
            if s.body and self.is_id(d.name) and MACRO_SHAPE.fullmatch(d.name_text) and d.name == i:
                if self.is_id(after) and self.at(after) not in HARD:
                    i = after  # an attribute macro between the body and the name
                    continue
                if self.at(after) == ";" and not s.typedef:
                    if owner is not None and not s.named and s.aggregate != "enum":
                        self.promote(s, owner)
                    return after + 1
            while self.is_id(after) and self.at(after) not in HARD and d.params < 0 and self.is_id(d.name):
                if s.typedef or MACRO_SHAPE.fullmatch(d.name_text):
                    d2 = self.declarator(after, end)
                    if d2.name < 0:
                        break
                    d, after = d2, d2.after
                else:
                    after += 1
                    if self.at(after) == "(":
                        after = self.close(after) + 1
            if self.at(after) == ":" and owner is not None:  # bit-field
                stop = after
                while stop < end and self.at(stop) not in (",", ";"):
                    stop += 1
                self.expression(after + 1, stop)
                after = stop
            value = after if self.at(after) in ("=", "{") and d.name >= 0 else -1
            if d.name >= 0:
                self.declared(s, d, owner, value >= 0)
            if value >= 0:
                after = self.initializer(s, value, end)
            elif d.params >= 0:
                after = self.after_params(after, end)
            first = False
            if self.at(after) == ",":
                i = after + 1
                continue
            if self.at(after) == ";":
                return after + 1
            stop = self.to_semicolon(after, end)
            if self.at(after) != "}" and after < end:
                self.skipped(after, stop)
            return stop + 1
        return i

    def after_params(self, i: int, end: int) -> int:
        while i < end and self.at(i) not in (",", ";", "=", "{", "}"):
            i = self.close(i) + 1 if self.at(i) in ("(", "[") else i + 1
        return self.to_semicolon(i, end) if self.at(i) == "=" else i

    def body_of(self, i: int, end: int) -> int:
        """Index of the brace that opens a function's body after its parameters, or -1."""
        while i < end:
            word = self.at(i)
            if word == "{":
                return i
            if word in (";", "=", ",", "}", ")"):
                return -1
            if word == ":" and self.cpp:  # constructor initializers: name(…) or name{…}, with commas
                i += 1
                while i < end and self.at(i) not in (";", "}"):
                    if self.at(i) == "{" and not (self.is_id(i - 1) or self.at(i - 1) == ">"):
                        return i
                    i = self.close(i) + 1 if self.at(i) in ("(", "{", "[") else i + 1
                return -1
            i = self.close(i) + 1 if word in ("(", "[") else i + 1
        return -1

    def old_body(self, open_: int, i: int, end: int) -> int:
        """Index of the body's brace of ``f(a, b) int a; char b; {``, a list of names with declarations of them after it, or -1."""
        inside = [self.at(j) for j in range(open_ + 1, min(self.close(open_), end))]
        names = set(inside[::2])
        if self.cpp or not names or set(inside[1::2]) - {","} or not all(self.is_id(j) for j in range(open_ + 1, self.close(open_), 2)):
            return -1
        while self.is_id(i) and i < end:
            stop = self.to_semicolon(i, end)
            if self.at(stop) != ";" or not any(self.at(j) in names for j in range(i + 1, stop)):
                return -1
            i = stop + 1
            if self.at(i) == "{":
                return i
        return -1

    def promote(self, s: Spec, owner: str) -> None:
        """Fields of an unnamed, nameless member belong to the aggregate around it."""
        for row in s.fields:
            row["scope"] = owner
        for r in self.refs.values():
            if r["owner"] == s.tag:
                r["owner"] = owner

    def function_type(self, s: Spec, d: Declarator) -> str:
        return f"{s.type_text} (*){self.span(d.params, self.close(d.params) + 1)}" if d.pointer and d.params >= 0 else s.type_text

    def parameters(self, open_: int, declare: bool) -> tuple[int | None, str]:
        """Arity and type list of a parameter list; its names become locals of the current function if ``declare``."""
        stop = self.close(open_)
        if stop <= open_ + 1:
            return None, ""
        if stop == open_ + 2 and self.at(open_ + 1) == "void":
            return 0, ""
        kinds, count, i = [], 0, open_ + 1
        while i < stop:
            k = i
            while k < stop and self.at(k) != ",":
                k = self.close(k) + 1 if self.at(k) in ("(", "[", "{") else self.angle(k) if self.cpp and self.at(k) == "<" else k + 1
            k = min(max(k, i + 1), stop)
            if self.at(i) == "...":
                kinds.append("...")
            else:
                count += 1
                kinds.append(self.parameter(i, k, declare))
            i = k + 1
        return count, ",".join(kinds)

    def parameter(self, i: int, end: int, declare: bool) -> str:
        s, k = self.specifiers(i, end)
        if not s.type_text and self.is_id(k) and self.at(k) not in HARD:
            stop = self.qualified(k)
            self.types(k, stop)
            s.type_text, s.tag, k = self.span(k, stop), aggregate_tag(self.span(k, stop)) or "", stop
        d = self.declarator(k, end)
        if d.name >= 0 and d.name < end:
            self.ref(d.name, "value")
            if declare and self.func is not None:
                t = self.t[d.name]
                self.facts.local(t.text, "parameter", self.func, t.line, t.col, s.tag, self.function_type(s, d))
        if d.params >= 0:
            self.parameters(d.params, declare)
        if self.at(d.after) == "=":
            self.expression(d.after + 1, end)
        return s.type_text

    def old_parameters(self, open_: int, body: int) -> tuple[int, str]:
        """Arity and types of a list of names by the declarations between it and the body; undeclared ones are int."""
        names = [j for j in range(open_ + 1, self.close(open_)) if self.is_id(j)]
        kinds: dict[str, str] = {}
        for j in names:
            self.ref(j, "value")
        i = self.close(open_) + 1
        while i < body:
            s, k = self.specifiers(i, body)
            while k < body and (d := self.declarator(k, body)).name >= 0:
                t = self.t[d.name]
                kinds[t.text] = s.type_text
                self.ref(d.name, "value")
                self.facts.local(t.text, "parameter", self.func, t.line, t.col, s.tag, self.function_type(s, d))
                if d.params >= 0:
                    self.parameters(d.params, False)
                k = d.after + 1 if self.at(d.after) == "," else body
            i = self.to_semicolon(i, body) + 1
        return len(names), ",".join(kinds.get(self.at(j), "int") for j in names)

    def initializers(self, i: int, end: int) -> None:
        """Members and bases that a constructor sets, ``name(…)`` or ``name{…}``: no calls, but their values may hold some."""
        while i < end:
            stop = self.qualified(i)
            names = [j for j in range(i, stop) if self.is_id(j) and self.at(j) not in HARD and self.at(j) not in PRIMITIVE]
            outer = [j for j in names if self.at(j + 1) in ("::", "<", "(", "{")]
            for j in names:
                self.ref(j, "type" if j not in outer else "namespace" if self.at(j + 1) == "::" else "field")
            self.expression(stop + 1, self.close(stop))
            i = max(self.close(stop), stop) + 1
            while i < end and self.at(i) in (",", "..."):
                i += 1

    def function(self, s: Spec, d: Declarator, body: int, begin: int, old: bool = False) -> int:
        outer, self.func = self.func, d.name_text
        for j in range(begin, d.params):
            if j in self.refs:
                self.refs[j]["func"] = self.func
        arity, kinds = self.old_parameters(d.params, body) if old else self.parameters(d.params, True)
        self.symbol(d.name, "function", d.name_text, signature=self.span(d.start, self.close(d.params) + 1), return_type=s.type_text,
                    storage=" ".join(s.storage), arity=arity, param_types=kinds)
        if self.is_id(d.name) and self.at(d.name) != "operator":
            self.ref(d.name, "value")
        if not old:
            k = colon = self.close(d.params) + 1
            while self.cpp and colon < body and self.at(colon) != ":":
                colon = self.close(colon) + 1 if self.at(colon) in ("(", "[") else colon + 1
            self.expression(k, colon if self.cpp else body)
            if self.cpp:
                self.initializers(colon + 1, body)
        stop = min(self.close(body), len(self.t))
        self.statements(body + 1, stop)
        self.func = outer
        return stop + 1

    def declared(self, s: Spec, d: Declarator, owner: str | None, has_value: bool) -> None:
        """Rows of one declarator of a declaration without body."""
        name, kind_text = d.name_text, self.function_type(s, d)
        storage = " ".join(s.storage)
        is_name = self.is_id(d.name) and self.at(d.name) != "operator"
        if s.typedef:
            self.symbol(d.name, "typedef", name)
            self.ref(d.name, "type")
            if d.params >= 0:
                self.parameters(d.params, False)
            elif s.tag and s.tag != name and not s.tag.startswith("@") and not (s.body and not s.named):
                self.facts.alias(name, s.tag)
            return
        function = d.params >= 0 and not d.pointer
        if owner is not None:
            if not s.type_text and not s.tag and function:  # constructors and destructors in their class
                if is_name:
                    self.ref(d.name, "value")
                self.parameters(d.params, False)
                return
            if is_name:
                self.ref(d.name, "field", owner=owner)
            self.symbol(d.name, "field", name, scope=owner, data_type=s.tag, decl_type=kind_text, storage=storage)
            if d.params >= 0:
                self.parameters(d.params, False)
            return
        if is_name:
            self.ref(d.name, "value")
        arity, kinds = self.parameters(d.params, False) if d.params >= 0 else (None, "")
        if function and not has_value:
            if self.func is None:
                self.symbol(d.name, "prototype", name, definition=False, signature=self.span(d.start, self.close(d.params) + 1),
                            return_type=s.type_text, storage=storage, arity=arity, param_types=kinds)
        elif self.func is not None:
            t = self.t[d.name]
            self.facts.local(name, "local_variable", self.func, t.line, t.col, s.tag, kind_text)
        else:
            self.symbol(d.name, "global_variable", name, definition=has_value or "extern" not in s.storage, data_type=s.tag, decl_type=kind_text,
                        storage=storage)

    def initializer(self, s: Spec, i: int, end: int) -> int:
        """An initializer at ``=`` or a brace; returns the index of the comma or semicolon after it."""
        stop = i if self.at(i) == "{" else i + 1
        k = stop
        while k < end and self.at(k) not in (",", ";", "}"):
            k = self.close(k) + 1 if self.at(k) in ("(", "[", "{") else k + 1
        if self.at(stop) == "{":
            self.braced(stop, [f"@type:{s.tag}"] if s.tag else None)
            self.expression(self.close(stop) + 1, k)
        else:
            self.expression(stop, k)
        return min(k, end)

    def braced(self, open_: int, base: list[str] | None) -> None:
        """A braced initializer list; ``base`` is the object chain of what it initializes, None if unknown."""
        stop, i = self.close(open_), open_ + 1
        while i < stop:
            chain = base
            here = i
            while self.at(i) in (".", "[") and i < stop:
                if self.at(i) == "." and self.is_id(i + 1):
                    self.ref(i + 1, "field", chain=chain)
                    chain = None if chain is None else [*chain, self.at(i + 1)]
                    i += 2
                elif self.at(i) == "[":
                    self.expression(i + 1, self.close(i))
                    i = self.close(i) + 1
                    chain = None
                else:
                    break
            designated = i > here
            if self.at(i) == "=" and designated:
                i += 1
            k = i
            while k < stop and self.at(k) != ",":
                k = self.close(k) + 1 if self.at(k) in ("(", "[", "{") else k + 1
            if self.at(i) == "{":
                self.braced(i, chain if designated else None)
                self.expression(self.close(i) + 1, k)
            else:
                self.expression(i, k)
            i = k + 1

    # -- statements

    def starts_declaration(self, i: int, end: int) -> bool:
        word = self.at(i)
        if not self.is_id(i) or word in CONTROL:
            return False
        if word in STORAGE or word in AGGREGATES or word in ("typedef", "const", "volatile", "__extension__", "constexpr", "_Atomic", "typename"):
            return True
        if word in PRIMITIVE:
            return self.at(i + 1) != "(" or self.at(i + 2) == "*"
        if word in ("typeof", "__typeof__", "decltype"):
            return self.at(i + 1) == "(" and (self.is_id(self.close(i + 1) + 1) or self.at(self.close(i + 1) + 1) == "*")
        if word in HARD:
            return False
        k = self.qualified(i)
        if self.is_id(k):
            return self.at(k) not in HARD or self.at(k) in QUALIFIERS or self.at(k) in PRIMITIVE
        stars = k
        while self.at(k) in ("*", "&", "&&") or self.at(k) in QUALIFIERS:
            k += 1
        return k > stars and self.is_id(k) and self.at(k) not in HARD and self.at(k + 1) in ("=", ";", ",", "[", ")", ":")

    def statements(self, i: int, end: int) -> None:
        while i < end:
            i = max(self.statement(i, end), i + 1)

    def statement(self, i: int, end: int) -> int:
        word = self.at(i)
        if word in ("{",):
            self.statements(i + 1, min(self.close(i), end))
            return self.close(i) + 1
        if word in ("if", "while", "switch", "for", "catch") and self.at(i + 1) in ("(", "constexpr"):
            open_ = i + 1 if self.at(i + 1) == "(" else i + 2
            stop = min(self.close(open_), end)
            if word == "for" or self.cpp:
                if self.starts_declaration(open_ + 1, stop):
                    k = self.to_semicolon(open_ + 1, stop)
                    colon = next((j for j in range(open_ + 1, k) if self.at(j) == ":"), -1)
                    self.declaration(open_ + 1, colon if colon > 0 and word == "for" else k)
                    self.expression(colon if colon > 0 else k, stop)
                    return stop + 1
            self.expression(open_ + 1, stop)
            return stop + 1
        if word in ("else", "do", "try"):
            return i + 1
        if word == "case":
            k = i + 1
            while k < end and self.at(k) not in (":", ";"):
                k = self.close(k) + 1 if self.at(k) in ("(", "[", "{") else k + 2 if self.at(k) == "::" else k + 1
            self.expression(i + 1, k)
            return k + 1
        if word == "default" and self.at(i + 1) == ":":
            return i + 2
        if word == "goto" and self.is_id(i + 1):
            self.ref(i + 1, "label")
            return self.to_semicolon(i, end) + 1
        if self.is_id(i) and self.at(i + 1) == ":" and word not in HARD:
            self.symbol(i, "label")
            self.ref(i, "label")
            return i + 2
        if self.cpp and word in ("using", "namespace", "template"):
            done = self.cpp_external(i, end)
            if done:
                return done
        if self.starts_declaration(i, end):
            return self.declaration(i, end)
        stop = self.to_semicolon(i, end)
        self.expression(i, stop)
        return stop + 1

    # -- expressions

    def expression(self, i: int, end: int) -> None:
        """Calls and references of an expression."""
        end = min(end, len(self.t))
        while i < end:
            word = self.at(i)
            if word == "{":
                if self.at(i - 1) == ")" and (tag := self.cast_tag(self.close(i - 1), i - 1)):
                    self.braced(i, [f"@type:{tag}"])
                elif self.at(i - 1) in ("(", ")", ";", "else", "do", "]", "mutable"):
                    self.statements(i + 1, min(self.close(i), end))
                else:
                    self.braced(i, None)
                i = self.close(i) + 1
                continue
            if word in AGGREGATES and self.is_id(i + 1):
                s = Spec(-1)
                i = max(self.aggregate_specifier(i, end, s), i + 1)
                continue
            if self.is_id(i) and word not in HARD and word not in PRIMITIVE:
                self.identifier(i)
            i += 1

    def identifier(self, i: int) -> None:
        before, after = self.at(i - 1), self.at(i + 1)
        called = after == "("
        if before in (".", "->"):
            self.ref(i, "field", chain=self.base_chain(i - 2))
        elif before == "&&" and self.at(i - 2) in ("=", ",", "(", "{", "return") and not called:
            self.ref(i, "label")  # address of a label
        elif after == "::":
            self.ref(i, "namespace")
        elif self.in_cast(i) or before == "new":
            self.ref(i, "type")
        else:
            self.ref(i, "value")
        if called and not (before == "new"):
            t = self.t[i]
            self.facts.call(self.func, t.text, t.line, t.col)

    def in_cast(self, i: int) -> bool:
        """True for the name of a type in ``(Name *)x`` or ``sizeof(Name *)``."""
        if self.at(i - 1) not in ("(", "const", "<"):
            return False
        k = i + 1
        while self.at(k) == "*" or self.at(k) in QUALIFIERS:
            k += 1
        if self.at(k) not in (")", ">"):
            return False
        nxt = self.t[k + 1] if k + 1 < len(self.t) else None
        return k > i + 1 or (self.at(k) == ")" and nxt is not None and nxt.kind in ("id", "num", "str") and not self.is_id(i - 2) and nxt.text not in HARD)

    def cast_tag(self, open_: int, stop: int) -> str:
        """Aggregate that a bracketed type names, or nothing."""
        inner = [self.at(j) for j in range(open_ + 1, stop)]
        if not inner or not all(re.fullmatch(r"\w+|::|\*", x) for x in inner):
            return ""
        if inner[0] in AGGREGATES or inner[-1] == "*" or self.at(stop + 1) == "{" or len([x for x in inner if x not in QUALIFIERS]) == 1:
            return aggregate_tag(self.span(open_ + 1, stop)) or ""
        return ""

    def base_chain(self, j: int) -> list[str]:
        """Object chain, root first, of the expression that ends at token j; empty if it has none."""
        word = self.at(j)
        if word == "]":
            return self.base_chain(self.pair.get(j, 0) - 1)
        if word == ")":
            open_ = self.pair.get(j, -1)
            if open_ < 0:
                return []
            if self.is_id(open_ - 1) and self.at(open_ - 1) not in HARD:
                return [f"@call:{self.at(open_ - 1)}"]
            k = open_ + 1
            while self.at(k) in ("*", "&"):
                k += 1
            if self.at(k) == "(" and self.close(k) < j - 1 and (tag := self.cast_tag(k, self.close(k))):
                return [f"@type:{tag}"]
            return self.base_chain(j - 1) if k <= j - 1 else []
        if word == "this":
            return [f"@type:{self.aggregate}"] if self.aggregate else []
        if self.is_id(j) and word not in HARD:
            if self.at(j - 1) in (".", "->"):
                root = self.base_chain(j - 2)
                return [*root, word] if root else []
            return [word]
        return []

    # -- tail: what needs the whole file

    def finish(self) -> None:
        f = self.facts
        functions = [x for x in f.symbols if x["kind"] == "function"]
        rows = sorted(self.refs.values(), key=lambda r: (r["line"], r["col"]))
        if any(r["func"] is None for r in rows) or any(c["caller"] is None for c in f.calls):
            ranges = FuncRanges(self.text, [(x["name"], x["line"], x["col"]) for x in functions])
            for r in rows:
                r["func"] = r["func"] or ranges.at(r["line"])
            for c in f.calls:
                c["caller"] = c["caller"] or ranges.at(c["line"])
        f.symbols.sort(key=lambda x: (x["line"], x["col"]))
        f.calls.sort(key=lambda x: (x["line"], x["col"]))
        f.locals.sort(key=lambda x: (x["line"], x["col"]))
        for part in (f.symbols, f.calls, f.locals):
            for k, x in enumerate(part):
                x["ord"] = k
        scoped = {(x["func"], x["name"]) for x in f.locals}
        owners = Owners(f)
        for r in rows:
            row = f.ref(r["name"], r["line"], r["col"], func=r["func"], role=r["role"], owner=r["owner"], chain=r["chain"])
            row["is_local"] = r["role"] == "value" and (r["func"], r["name"]) in scoped
            if r["role"] == "field" and r["chain"] and not r["owner"]:
                row["owner"] = owners.of(r["chain"], r["func"])


class Owners:
    """Owner of a member access within one file: the chain's root has a type, every hop a field of that type."""

    def __init__(self, f: Facts):
        self.targets: dict[str, str] = {}
        for a in f.aliases:
            self.targets.setdefault(a["name"], a["target"])
        self.locals: dict[tuple[str, str], str] = {}
        for x in f.locals:
            if x["data_type"]:
                self.locals.setdefault((x["func"], x["name"]), x["data_type"])
        self.globals: dict[str, str] = {}
        self.returns: dict[str, str] = {}
        self.fields: dict[tuple[str, str], str] = {}
        for x in f.symbols:
            if x["kind"] == "global_variable" and x["data_type"]:
                self.globals.setdefault(x["name"], x["data_type"])
            elif x["kind"] in ("function", "prototype") and x["return_type"]:
                self.returns.setdefault(x["name"], x["return_type"])
            elif x["kind"] == "field" and x["data_type"]:
                self.fields.setdefault((x["scope"], x["name"]), x["data_type"])

    def of(self, chain: list[str], func: str | None) -> str:
        marker = root_marker(chain[0])
        if marker is None:
            tag = self.locals.get((func, chain[0])) or self.globals.get(chain[0], "")
        elif marker[0] == "type":
            tag = marker[1]
        else:
            tag = aggregate_tag(self.returns.get(marker[1])) or ""
        for hop in chain[1:]:
            if not tag:
                return ""
            tag = next((self.fields[(c, hop)] for c in candidate_tags(tag, self.targets) if (c, hop) in self.fields), "")
        return tag


def parse(text: str, path: str, lang: str) -> Parser:
    return Parser(text, path, lang).run()


__all__ = ["Parser", "Token", "parse"]
