"""C# declarations and mentions from source text.

The extractor reads one file's tokens and knows no other file: it says what is declared and which names are mentioned
where. What a mention means is found later, by joins over the declarations of all files (resolve()).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions import ids
from symgraph.plans.schema import FLAGS, PARAMETER
from symgraph.session import broadcast_if, in_batches, materialise
from symgraph.session import rows as count_of

TOKEN = re.compile(
    r'//[^\n]*|/\*.*?\*/|\#[^\n]*|\$*"""+.*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|@?[^\W\d]\w*|\d[\w.]*|=>|::|\?\?|\?\.|&&|\|\||[-+*/%=!<>&|^]=|\S', re.S
)
#: Types without a declaration of their own.
BUILT_IN = {"int", "string", "bool", "float", "double", "long", "object", "char", "byte", "decimal", "uint", "short", "ulong", "dynamic"}
#: What may stand before a type in a declaration of a local.
BEFORE_LOCAL = {"out", "in", "ref", "is", "not", "using", "await", "case", "const", "static", "readonly", "else", "do", "fixed", "and", "or", "scoped"}
MODIFIERS = {"public", "internal", "protected", "private", "static", "abstract", "sealed", "virtual", "override", "async", "readonly", "const", "volatile", "partial", "new", "extern", "unsafe", "required", "file", "ref"}
TYPES = {"class": "Class", "struct": "Struct", "interface": "Interface", "record": "Record", "enum": "Enum"}
#: Attributes of types whose first argument is kept as metadata.
SPOKEN = {"RequireComponent", "AddComponentMenu"}
KEYWORDS = {
    "if", "else", "for", "foreach", "while", "do", "switch", "case", "default", "return", "new", "throw", "try", "catch", "finally", "using", "lock", "var", "await", "is", "as", "in", "out", "ref", "null", "true", "false", "this", "base", "typeof",
    "nameof", "sizeof", "yield", "break", "continue", "int", "string", "bool", "void", "float", "double", "long", "object", "char", "byte", "decimal", "when", "and", "or", "not", "get", "set", "init", "value", "where", "params", "static", "const", "async", "uint", "short", "ulong", "checked", "unchecked", "stackalloc", "goto", "dynamic",
}
ROWS = (
    "file_path string, row string, name string, full_name string, kind string, type_name string, owner string, namespace string, start_line int, end_line int, access string, flags array<string>, return_type string, "
    f"parameters array<{PARAMETER}>, bases array<string>, attributes array<string>, metadata map<string,string>, qualifier string, line int, column int, call boolean, context string, key string, arguments int, chain array<string>"
)


@dataclass
class Reader:
    """Walks the tokens of one file: their texts, each kept once, lines, columns, and whether they are words.

    members() yields after each member, so that rows can be taken away as they come. Mentions are read if wanted is calls
    (those alone) or all."""

    path: str
    text: str
    wanted: str = "all"
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.texts, self.line, self.column, self.word = [], array("i"), array("i"), bytearray()
        line, start, last, known = 0, 0, 0, {}
        for m in TOKEN.finditer(self.text):
            skipped = self.text.count("\n", last, m.start())
            if skipped:
                line, start = line + skipped, self.text.rfind("\n", 0, m.start()) + 1
            t = m.group()
            kind = known.get(t)
            if kind is None:
                kind = (t, not t.startswith(("//", "/*", "#")), bool(re.match(r"@?[^\W\d]", t)) and not t.startswith(('@"', '@$')))
                if len(t) <= 64:
                    known[t] = kind
            if kind[1]:
                self.texts.append(kind[0])
                self.line.append(line)
                self.column.append(m.start() - start)
                self.word.append(kind[2])
            last = m.start()

    def at(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def close(self, i: int, opening: str = "{", closing: str = "}") -> int:
        """Index of the bracket that closes the one at i, or the end."""
        depth = 0
        while i < len(self.texts):
            depth += (self.at(i) == opening) - (self.at(i) == closing)
            if not depth:
                return i
            i += 1
        return len(self.texts) - 1

    def angles(self, i: int) -> int:
        """Index after a list of type arguments that begins at i, or i."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.texts) and self.at(j) not in ("{", "}", ";"):
            depth += self.at(j).count("<") - (self.at(j).count(">") if self.at(j) != "=>" else 0)
            j += 1
            if depth <= 0:
                return j
        return i

    def type_at(self, i: int) -> int:
        """Index after the type that begins at i, or i if none does."""
        j = i
        if self.at(j) == "(":
            j = self.close(j, "(", ")") + 1
        else:
            if not (j < len(self.texts) and self.word[j]):
                return i
            j = self.angles(j + 1)
            while self.at(j) in (".", "::") and j + 1 < len(self.texts):
                j = self.angles(j + 2)
        while self.at(j) in ("?", "*") or self.at(j) == "[" and self.at(j + 1) in ("]", ","):
            j = self.close(j, "[", "]") + 1 if self.at(j) == "[" else j + 1
        return j

    def words(self, i: int, j: int) -> str:
        return re.sub(r"\s*([<>\[\](),.?:]+)\s*", r"\1", " ".join(self.texts[i:j])).replace(",", ", ")

    def declare(self, kind: str, name: str, owner: str, space: str, first: int, last: int, mods: list[str], signature: str = "", **more) -> str:
        """Adds a declaration; returns its key: the full name and, of a method, what tells it from its overloads."""
        full = f"{owner}.{name}" if owner else f"global::{name}"
        vis = {m for m in mods if m in ("public", "internal", "protected", "private")}
        access = {frozenset({"protected", "internal"}): "ProtectedInternal", frozenset({"private", "protected"}): "PrivateProtected"}.get(frozenset(vis), next(iter(vis), "NotApplicable" if kind == "Namespace" else "Private" if owner != space and kind != "Type" else "Internal").capitalize() if vis or kind != "Namespace" else "NotApplicable")
        self.rows.append({"row": "declaration", "name": name, "full_name": full, "key": full + signature, "kind": kind, "owner": owner, "namespace": space, "start_line": self.line[first], "end_line": self.line[min(last, len(self.texts) - 1)], "access": access, "flags": sorted({m for m in mods if m in ("static", "abstract", "sealed", "virtual", "override", "async", "readonly", "const", "volatile", "generic")})} | more)
        return full + signature

    def mention(self, first: int, last: int, source: str, space: str, known: dict[str, list[str]] | None = None) -> None:
        """Names between two tokens, with the member or type that they are in.

        known has what is known of the parameters; locals are added as they are declared, and forgotten with their block.
        A name of either is no mention. Each mention has the chain of what it is taken from: names, calls (), elements [],
        this, base, types (:Name), or ? for what can't be told; a parameter or local stands as what it was declared as.
        """
        if self.wanted not in ("calls", "all"):
            return
        scopes = [dict(known or {})]
        for i in range(first, last):
            t = self.texts[i]
            if t == "{":
                scopes.append(scopes[-1].copy())
            elif t == "}" and len(scopes) > 1:
                scopes.pop()
            local = self.local(i, last, scopes[-1])
            if local:
                scopes[-1][local[0]] = local[1]
            if not self.word[i] or t in KEYWORDS or t in MODIFIERS:
                continue
            after = self.angles(i + 1)
            call = self.at(after) == "(" and self.at(i - 1) != "new"
            member = self.at(i - 1) in (".", "?.", "!.")
            if not call and self.wanted == "calls" or not member and t in scopes[-1]:
                continue
            qualifier = self.at(i - 2) if member and i >= 2 else None
            chain = self.chain(i - 2, first, scopes[-1])[0] if member else []
            self.rows.append({"row": "mention", "name": t, "owner": source, "namespace": space, "qualifier": qualifier, "line": self.line[i], "column": self.column[i], "call": call, "arguments": self.arguments(after) if call else None, "chain": chain})

    def local(self, i: int, last: int, scope: dict[str, list[str]]) -> tuple[str, list[str]] | None:
        """Name and chain of the local that is declared by a type at i or, of a lambda, at i."""
        t, before, word_before = self.at(i), self.at(i - 1), bool(i and self.word[i - 1])
        if self.word[i] and self.at(i + 1) == "=>" and t not in KEYWORDS and self.at(i - 1) not in (".", "?."):
            return t, ["?"]
        if not self.word[i] or t in KEYWORDS - BUILT_IN - {"var"} or before in (".", "?.", "::", "<") or word_before and before not in BEFORE_LOCAL:
            return None
        j = self.type_at(i)
        if j == i or j >= last or not self.word[j] or self.at(j) in KEYWORDS or self.at(j) in MODIFIERS or self.at(j + 1) not in ("=", ";", ",", "in", ")", ":", "when", "&&", "||", "}", "=>"):
            return None
        name, of = self.at(j), self.words(i, j)
        if t != "var":
            return name, [":" + of]
        if self.at(j + 1) == "in":
            stop = self.close(self.opens(i), "(", ")")
            return name, [*self.value(j + 2, stop, scope), "[]"]
        return name, self.value(j + 2, self.ends(j + 2, self.field_end(j + 2, last))[0], scope) if self.at(j + 1) == "=" else ["?"]

    def opens(self, i: int) -> int:
        """Index of the nearest opening bracket before i."""
        while i and self.at(i) != "(":
            i -= 1
        return i

    def back(self, k: int, first: int) -> int:
        """Index of the bracket that the closing one at k closes, or first - 1."""
        depth = 0
        for n in range(k, first - 1, -1):
            depth += (self.at(n) in (")", "]", "}")) - (self.at(n) in ("(", "[", "{"))
            if not depth:
                return n
        return first - 1

    def value(self, i: int, stop: int, scope: dict[str, list[str]]) -> list[str]:
        """The chain of an expression between two tokens; ["?"] if it isn't one of names, calls, elements or a new object."""
        if i >= stop:
            return ["?"]
        if self.at(i) == "await":
            return [*self.value(i + 1, stop, scope), "await"]
        if self.at(i) == "new":
            j = self.type_at(i + 1)
            kind = self.words(i + 1, j)
            if j > i + 1 and self.at(j) == "[" and self.close(j, "[", "]") + 1 <= stop:
                return [f":{kind}[]"]
            if j > i + 1 and (self.at(j) == "(" and self.close(j, "(", ")") + 1 == stop or self.at(j) == "{" or self.at(j) == "(" and self.at(self.close(j, "(", ")") + 1) == "{"):
                return [":" + kind]
        if self.at(i) == "(" and (close := self.close(i, "(", ")")) + 1 < stop and self.type_at(i + 1) == close and (self.word[close + 1] or self.at(close + 1) == "("):
            return [":" + self.words(i + 1, close)]  # a cast
        as_ = [n for n in range(i, stop) if self.at(n) == "as"]
        if as_ and self.type_at(as_[-1] + 1) == stop:
            return [":" + self.words(as_[-1] + 1, stop)]
        found, start = self.chain(stop - 1, i, scope)
        return found if start == i else ["?"]

    def chain(self, k: int, first: int, scope: dict[str, list[str]]) -> tuple[list[str], int]:
        """The chain of the expression that ends at k, and where it starts."""
        out: list[str] = []
        while True:
            if self.at(k) == "!" and k > first:
                k -= 1
            t, call = self.at(k), ""
            if t == "]":
                out.append("[]")
                k = self.back(k, first) - 1
                if k < first:
                    return ["?"], first
                continue
            if t == ")":
                k, call = self.back(k, first) - 1, "()"
                closed = k + 1
                if self.at(k) == ">":
                    k = self.angle_back(k, first) - 1
                if k < first or not self.word[k] or self.at(k) in KEYWORDS - {"this", "base"}:
                    if closed < first:
                        return ["?"], first
                    return [*self.value(closed + 1, self.close(closed, "(", ")"), scope), *reversed(out)], closed
            elif t == ">":
                k = self.angle_back(k, first) - 1
            if k < first or not self.word[k]:
                return ([":string", *reversed(out)] if t[:1] in '"$@' and '"' in t else ["?"]), k
            n = k
            while self.at(n - 1) in (".", "::") and n - 2 >= first and self.word[n - 2]:
                n -= 2
            if call and self.at(n - 1) == "new" and n - 1 >= first:
                return [":" + self.words(n, k + 1), *reversed(out)], n - 1
            name = self.at(k)
            if name in KEYWORDS - BUILT_IN - {"this", "base"}:
                return ["?"], k
            if self.at(k - 1) in (".", "?.", "::") and k - 2 >= first:
                out.append(name + call)
                k -= 2
                continue
            if name in scope:
                return [*(["?"] if call else scope[name]), *reversed(out)], k
            return [(":" if name in BUILT_IN else "") + name + call, *reversed(out)], k

    def angle_back(self, k: int, first: int) -> int:
        """Index of the < whose list of type arguments ends at k."""
        n = k
        while n > first and not (self.at(n) == "<" and self.angles(n) == k + 1):
            n -= 1
        return n

    def arguments(self, i: int) -> int:
        """How many arguments are in the brackets that open at i."""
        stop, depth, k = self.close(i, "(", ")"), 0, i + 1
        n = int(stop > k)
        while k < stop:
            t = self.at(k)
            if t == "<" and self.at(after := self.angles(k)) in ("(", ")", ",", ".", "[", "{") and after > k:
                k = after  # type arguments
                continue
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            n += t == "," and not depth
            k += 1
        return n

    def members(self, i: int, end: int, owner: str, space: str, kind: str) -> Iterator[None]:
        while i < end:
            i = yield from self.member(i, end, owner, space, kind)
            yield

    def member(self, i: int, end: int, owner: str, space: str, kind: str) -> Generator[None, None, int]:
        first, mods, attributes, said = i, [], [], {}
        while self.at(i) == "[":
            j = self.close(i, "[", "]")
            for k in range(i + 1, j):
                if self.word[k] and self.at(k - 1) in ("[", ","):
                    attributes.append(self.at(k))
                    if self.at(k) in SPOKEN and self.at(k + 1) == "(":
                        until = self.ends(k + 2, self.close(k + 1, "(", ")"))[0]
                        said.setdefault(self.at(k), []).append(re.sub(r'^typeof\((.*)\)$|^@?"(.*)"$', r"\1\2", self.words(k + 2, until)))
            i = j + 1
        while self.at(i) in MODIFIERS:
            mods.append(self.at(i))
            i += 1
        if kind == "Interface" and not {"public", "internal", "protected", "private"} & {*mods}:
            mods.append("public")
        t = self.at(i)
        if t in ("using", "extern", "delegate"):
            j = i
            while j < end and self.at(j) != ";":
                j += 1
            if t == "using" and "=" not in (words := self.texts[i + 1 : j]) and "static" not in words:
                self.rows.append({"row": "using", "name": "global::" + "".join(words).removeprefix("global::")})
            return j + 1
        if t == "namespace":
            j = i + 1
            while self.at(j) not in ("{", ";") and j < end:
                j += 1
            name = "".join(self.texts[i + 1 : j])
            stop = self.close(j) if self.at(j) == "{" else end
            parent = f"{owner}.{name}" if owner else f"global::{name}"
            self.declare("Namespace", name, owner, owner, first, stop, [])
            yield from self.members(j + 1, stop, parent, parent, "Namespace")
            return stop + 1
        if t in TYPES and self.word[min(i + 1, len(self.texts) - 1)]:
            return (yield from self.type_declaration(first, i, end, owner, space, mods, attributes, {k: ",".join(v) for k, v in said.items()}))
        if t == "event":
            j = self.type_at(i + 1)
            name, stop = self.at(j), j + 1
            handler = self.words(i + 1, j)
            field_like = self.at(stop) != "{"
            while not field_like and self.at(stop) != "{" or field_like and stop < end and self.at(stop) != ";":
                stop += 1
            stop = self.close(stop) if self.at(stop) == "{" else stop
            if not field_like:
                self.declare("Event", name, owner, space, first, stop, mods, type_name=handler, attributes=attributes, metadata={"HandlerType": handler})
            return stop + 1
        if kind in ("Namespace", "Enum", "") or t in (";", ",", "}"):
            return i + 1
        return self.plain_member(first, i, end, owner, space, mods, attributes)

    def type_declaration(self, first: int, i: int, end: int, owner: str, space: str, mods: list[str], attributes: list[str], said: dict[str, str]) -> Generator[None, None, int]:
        what = TYPES[self.at(i)]
        i += 1 + (self.at(i) == "record" and self.at(i + 1) in ("class", "struct"))
        name, j = self.at(i), self.angles(i + 1)
        generic = j > i + 1
        if self.at(j) == "(":
            j = self.close(j, "(", ")") + 1
        bases = []
        if self.at(j) == ":":
            j += 1
            while j < end and self.at(j) not in ("{", ";", "where"):
                k = self.type_at(j)
                if k == j:
                    j += 1
                    continue
                bases.append(self.words(j, k))
                j = self.close(k, "(", ")") + 1 if self.at(k) == "(" else k
                j += self.at(j) == ","
        while j < end and self.at(j) not in ("{", ";"):
            j += 1
        stop = self.close(j) if self.at(j) == "{" else j
        meta = {"TypeKind": what, "Namespace": space.removeprefix("global::")} | ({"BaseType": bases[0]} if bases else {}) | ({"Interfaces": ",".join(bases)} if bases else {}) | said
        full = self.declare("Type", name, owner, space, first, stop, mods + ["generic"] * generic, type_name=what, bases=bases, attributes=attributes, metadata=meta)
        if what != "Enum" and self.at(j) == "{":
            yield from self.members(j + 1, stop, full, space, "Interface" if what == "Interface" else "Type")
        return stop + 1

    def parameters(self, i: int, j: int) -> list[dict]:
        out, depth, start = [], 0, i
        for k in range(i, j + 1):
            depth += self.at(k) in ("(", "[", "<", "{")
            depth -= self.at(k) in (")", "]", ">", "}")
            if k == j or self.at(k) == "," and not depth:
                part = self.texts[start:k]
                if part:
                    default = " ".join(part[part.index("=") + 1 :]) if "=" in part else None
                    head = part[: part.index("=")] if "=" in part else part
                    how = [x for x in head if x in ("params", "this", "ref", "out", "in")]
                    head = [x for x in head if x not in how]
                    out.append({"name": head[-1], "type_name": " ".join(head[:-1]), "has_default": default is not None, "default_value": default, "is_params": "params" in how, "is_this": "this" in how, "is_ref": "ref" in how, "is_out": "out" in how, "is_in": "in" in how})
                start = k + 1
        return out

    def body(self, j: int, end: int) -> int:
        """Index of the last token of a member whose name ends before j: its block, or what is before the semicolon."""
        while j < end and self.at(j) not in ("{", ";", "=>"):
            j = self.close(j, "(", ")") + 1 if self.at(j) == "(" else j + 1
        if self.at(j) == "{":
            return self.close(j)
        while j < end and self.at(j) != ";":
            j = self.close(j) + 1 if self.at(j) == "{" else j + 1
        return j

    def ends(self, j: int, stop: int) -> list[int]:
        """Places of the commas outside brackets between two tokens, and the last."""
        out, depth = [], 0
        for n in range(j, stop):
            depth += (self.at(n) in ("(", "{", "[")) - (self.at(n) in (")", "}", "]"))
            if self.at(n) == "," and not depth and self.angles_closed(j, n):
                out.append(n)
        return [*out, stop]

    def angles_closed(self, j: int, n: int) -> bool:
        """True if no list of type arguments that begins after j is open at n."""
        return not any(self.at(k) == "<" and k + 1 <= n < self.angles(k) for k in range(j, n))

    def plain_member(self, first: int, i: int, end: int, owner: str, space: str, mods: list[str], attributes: list[str]) -> int:
        j = self.type_at(i)
        if self.at(i) == "~" or j == i or self.at(j) == "(" and self.word[j - 1] or "operator" in (self.at(i), self.at(j), self.at(j + 1)) or self.at(j) == "this":
            stop = self.body(i + (j == i), end)  # constructors, destructors, operators, indexers: mentions go to the type
            k = self.angles(i + 1) if self.at(i + 1) == "(" else i + (j == i)
            while k < stop and self.at(k) not in ("(", "[", "{"):
                k += 1
            ps = self.parameters(k + 1, self.close(k, self.at(k), {"(": ")", "[": "]"}[self.at(k)])) if self.at(k) in ("(", "[") and k < stop else []
            self.mention(j, stop, owner, space, {p["name"]: [":" + p["type_name"]] for p in ps})
            return stop + 1
        of, name = self.words(i, j), self.at(j)
        k = self.angles(j + 1)
        while self.at(k) == ".":  # an explicit implementation
            name, k = self.at(k + 1), self.angles(k + 2)
        if self.at(k) == "(":
            close = self.close(k, "(", ")")
            stop = self.body(close + 1, end)
            ps = self.parameters(k + 1, close)
            how = "Extension" if ps and ps[0]["is_this"] else "Static" if "static" in mods else "Regular"
            meta = {"MethodKind": how, "ReturnType": of, "ParameterCount": str(len(ps))}
            generic = sum(self.at(n) == "," for n in range(j + 1, k)) + 1 if self.at(k - 1) == ">" else 0
            ways = [" ".join([w for w in ("ref", "out", "in") if p[f"is_{w}"]] + [p["type_name"]]) for p in ps]
            signature = f"`{generic}" * (generic > 0) + "(" + ",".join(ways) + ")"
            full = self.declare("Method", name, owner, space, first, stop, mods + ["generic"] * (k > j + 1), signature, type_name=of, return_type=of, parameters=ps, attributes=attributes, metadata=meta)
            self.mention(close + 1, stop, full, space, {p["name"]: [":" + p["type_name"]] for p in ps})
            return stop + 1
        if self.at(k) in ("{", "=>"):
            stop = self.close(k) if self.at(k) == "{" else self.body(k, end)
            words = {*self.texts[k : stop + 1]}
            read = self.at(k) == "=>" or not words & {"set", "init"}
            full = self.declare("Property", name, owner, space, first, stop, mods, type_name=of, return_type=of, attributes=attributes, metadata={"Type": of, "IsReadOnly": str(read), "IsWriteOnly": str(self.at(k) == "{" and "get" not in words)})
            self.mention(k, stop, full, space)
            if self.at(stop + 1) == "=":
                last = self.body(stop + 1, end)
                self.mention(stop + 1, last, owner, space)
                stop = last
            return stop + 1
        stop, start = self.field_end(k, end), j
        for n in self.ends(j, stop):
            value = self.words(start + 2, n) if self.at(start + 1) == "=" else None
            meta = {"Type": of, "IsReadOnly": str("readonly" in mods), "IsConst": str("const" in mods), "IsVolatile": str("volatile" in mods)} | ({"ConstantValue": value} if value and "const" in mods else {})
            self.declare("Field", self.at(start), owner, space, first, n, mods + ["sealed"] * ("readonly" in mods), type_name=of, return_type=of, attributes=attributes, metadata=meta)
            self.mention(start + 1, n, owner, space)
            start = n + 1
        return stop + 1

    def field_end(self, k: int, end: int) -> int:
        """Index of the semicolon that ends a field, past blocks and brackets in its value."""
        while k < end and self.at(k) != ";":
            opening = self.at(k)
            k = self.close(k, opening, {"{": "}", "(": ")", "[": "]"}[opening]) + 1 if opening in ("{", "(", "[") else k + 1
        return k


def read_file(path: str, text: str) -> list[dict]:
    """Rows of one file; what can't be read is skipped to the next member."""
    r, lines = Reader(path, text), text.split("\n")
    for _ in r.members(0, len(r.texts), "", "", ""):
        pass
    return [{"file_path": path} | row | ({"context": lines[row["line"]].strip()} if row["row"] == "mention" else {}) for row in r.rows]


#: Rows of a file that are held as objects at a time, and characters of lines that leave it at a time with them.
ROWS_AT_ONCE, CHARACTERS_AT_ONCE = 2_000, 4 << 20


def read_parts(path: str, text: str, schema: pa.Schema, wanted: str = "all") -> Iterator[pa.RecordBatch]:
    """read_file() in parts of some ROWS_AT_ONCE rows: declarations, and mentions if wanted is calls (without their lines) or
    all. A file's parts are kept, without the lines of mentions, until it is read to its end, as one that can't be read has
    no rows; a line with many mentions is so never held as often as it has mentions."""
    r, parts = Reader(path, text, wanted), []

    def cut(rows: list[dict]) -> None:
        parts.append(pa.RecordBatch.from_pylist([{"file_path": path} | row for row in rows], schema))
        rows.clear()

    for _ in r.members(0, len(r.texts), "", "", ""):
        if len(r.rows) >= ROWS_AT_ONCE:
            cut(r.rows)
    cut(r.rows)
    del r
    lines, at = text.split("\n") if wanted == "all" else [], schema.get_field_index("context")
    for part in parts:
        if not lines:
            yield part
            continue
        said = [None if n is None else lines[n].strip() for n in part.column(schema.get_field_index("line")).to_pylist()]
        first = size = 0
        for k, line in enumerate([*said, None]):
            size += len(line or "")
            if k == len(said) or size > CHARACTERS_AT_ONCE and k > first:
                some = part.slice(first, k - first)
                yield some.set_column(at, schema.field(at), pa.array(said[first:k], pa.string()))
                first, size = k, len(line or "")


def arrow_schema() -> pa.Schema:
    """ROWS in Arrow's terms; needs a session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ROWS))


def extract(files: DataFrame, wanted: str = "all") -> DataFrame:
    """Rows of all .cs files (file_path, content); a file that can't be read gives one, an error.

    Null and empty contents give no rows. Where no mentions are needed, wanted is declarations; where only calls are, calls:
    then they come without their lines (context). Texts come to a worker some megabytes at a time."""

    schema = arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1), strict=True):
                path = p.as_py()
                try:
                    yield from read_parts(path, t.as_py() or "", schema, wanted)
                except (IndexError, RecursionError, ValueError) as e:
                    yield pa.RecordBatch.from_pylist([{"file_path": path, "row": "error", "name": type(e).__name__, "context": str(e)[:200]}], schema)

    return in_batches(files.where(F.lower("file_path").endswith(".cs")).select("file_path", "content")).mapInArrow(run, ROWS)


def extract_shared(files: DataFrame, store: str, buckets: int = 64) -> DataFrame:
    """extract() of files (file_path, content) by way of a store of what was extracted before, by content.

    The store is a managed table, bucketed by content_hash, which any number of repositories share: a text is read once,
    whatever its paths, and one that the store has isn't read at all. Joins with the store leave it where it lies. Texts that
    can't be read leave their error in it; those without rows leave one that says so, and is dropped here.
    """
    spark = files.sparkSession
    named = files.where(F.lower("file_path").endswith(".cs") & F.col("content").isNotNull()).withColumn("content_hash", F.sha2("content", 256))
    known = spark.table(store) if spark.catalog.tableExists(store) else None
    new = named.select("content_hash", "content").dropDuplicates(["content_hash"])
    if known is not None:
        new = new.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    new = materialise(new, "csharp-new", True)
    if count_of(new):
        made = extract(new.select(F.concat("content_hash", F.lit(".cs")).alias("file_path"), "content")).withColumn("content_hash", F.regexp_replace("file_path", r"\.cs$", "")).drop("file_path")
        none = new.select("content_hash").join(made.select("content_hash").distinct(), "content_hash", "left_anti").withColumn("row", F.lit("none"))
        every = made.unionByName(none, allowMissingColumns=True)
        every.write.mode("append").format("parquet").bucketBy(buckets, "content_hash").sortBy("content_hash").saveAsTable(store)
        spark.catalog.refreshTable(store)
    if not spark.catalog.tableExists(store):
        return extract(files.where("false"))
    rows = named.select("file_path", "content_hash").join(spark.table(store).where("row != 'none'"), "content_hash").drop("content_hash")
    return rows.select([c.split(" ")[0] for c in re.split(r", (?![^<]*>)", ROWS)])


def errors_of(rows: DataFrame) -> DataFrame:
    """file_path, error, message of the files that could not be read."""
    return rows.where("row = 'error'").select("file_path", F.col("name").alias("error"), F.col("context").alias("message"))


def symbols_of(rows: DataFrame, identity: str = "qualified") -> DataFrame:
    """Symbols of declarations (X1 to X13). Overloads are symbols of their own, told apart by key; a type's parts are one,
    which has the bases of all. identity simple names members by their names alone, as one may be used to."""
    d = rows.where("row = 'declaration'")
    whole = F.col("kind").isin("Type", "Namespace")
    full = F.when(whole, F.col("full_name")).otherwise(F.col("name") if identity == "simple" else F.col("full_name"))
    flag = lambda f: F.array_contains("flags", f.removeprefix("is_")).alias(f)
    owner = F.when(F.col("owner") != "", ids.node_id(F.col("owner")))
    out = d.select(
        ids.node_id(full if identity == "simple" else F.col("key")).alias("id"), "name", full.alias("full_name"), "kind", "type_name", F.when(F.col("kind") == "Type", owner).alias("container_id"), F.when(~whole, owner).alias("declaring_type_id"), "file_path", "start_line", "end_line",
        F.lit(True).alias("is_definition"), "access", *[flag(f) for f in FLAGS], "return_type", "parameters", "metadata", "bases", "attributes", "owner", "namespace", "key",
    )
    if identity == "simple":
        return out.dropDuplicates(["id"])
    same = Window.partitionBy("id")
    every = F.array_distinct(F.flatten(F.collect_list("bases").over(same)))
    out = out.withColumn("bases", F.when(F.col("kind") == "Type", every)).withColumn("_n", F.row_number().over(same.orderBy("file_path", "start_line")))
    return out.where("_n = 1").drop("_n")


def nodes_of(symbols: DataFrame) -> DataFrame:
    """Nodes of types, methods, properties and fields."""
    kind = F.when(F.col("kind") == "Type", F.col("type_name")).otherwise(F.col("kind"))
    return symbols.where("kind in ('Type', 'Method', 'Property', 'Field')").select("id", "full_name", F.col("name").alias("label"), kind.alias("kind"), F.map_from_arrays(F.array(F.lit("FilePath")), F.array("file_path")).alias("metadata"))


def visible(projects: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects (file_path, project), and project, seen: itself and what it references (project, target), at any depth."""
    from symgraph.operators.graph import bfs

    direct = references.select(F.col("project").alias("source_id"), F.col("target").alias("target_id"), F.lit("References").alias("kind"))
    reached = bfs(direct, direct.select(F.col("source_id").alias("seed")), None, "out").select(F.col("seed").alias("project"), F.col("node").alias("seen"))
    own = projects.select("project", F.col("project").alias("seen"))
    return projects.select("file_path", "project").dropDuplicates(["file_path"]), materialise(own.unionByName(reached).distinct(), "csharp-visible", True)


def seen_only(hits: DataFrame, scope: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Those of hits (file_path, in_file) whose in_file is in a project that file_path's project sees; files without a project
    see all, and are seen by all."""
    if scope is None:
        return hits.drop("in_file")
    projects, seen = scope
    of, to = projects.select("file_path", F.col("project").alias("_of")), projects.select(F.col("file_path").alias("in_file"), F.col("project").alias("_to"))
    both = hits.join(of, "file_path", "left").join(to, "in_file", "left").join(broadcast_if(seen.select(F.col("project").alias("_of"), F.col("seen").alias("_to"), F.lit(True).alias("_sees")), 300_000), ["_of", "_to"], "left")
    return both.where("_of is null or _to is null or _sees").drop("in_file", "_of", "_to", "_sees")


def named_types(asked: DataFrame, rows: DataFrame, symbols: DataFrame, scope: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """asked (of, file_path, written) with target_id: the type of the repository that a name means where it is written.

    of is the full name of the type it is written in. The name is sought, in this order, in that type and what encloses it
    (the nearest first), in the namespaces that the file uses, and as it is; each place is a full name to look up, so no
    join is on a simple name. A name that is left counts if one type only has it. With a scope (visible()), types in projects
    that the file's project doesn't see are passed over.
    """
    types = symbols.where("kind = 'Type'").select(F.col("id").alias("target_id"), "name", "full_name", F.col("file_path").alias("in_file")).dropDuplicates(["target_id"])
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("written", r"<.*", ""), r"^global::", ""), r"[?\[\], *]+$", "")
    asked = asked.select("of", "file_path", "written").distinct().withColumn("plain", plain).where("plain != ''")
    used = rows.where("row = 'using'").groupBy("file_path").agg(F.sort_array(F.collect_set("name")).alias("spaces"))
    parts = F.split(F.regexp_replace("of", "^global::", ""), r"\.")
    around = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.struct((F.size(parts) - n).alias("near"), F.concat(F.lit("global::"), F.array_join(F.slice(parts, F.lit(1), n), "."), F.when(n > 0, ".").otherwise(""), "plain").alias("full_name")))
    by_using = F.transform(F.coalesce("spaces", F.array().cast("array<string>")), lambda s: F.struct((F.size(parts) - F.lit(0.5)).alias("near"), F.concat(s, F.lit("."), "plain").alias("full_name")))
    places = F.concat(F.transform(around, lambda p: F.struct(p["near"].cast("double").alias("near"), p["full_name"].alias("full_name"))), by_using)
    sought = asked.join(used, "file_path", "left").withColumn("place", F.explode(places)).select("of", "file_path", "written", "place.*")
    found = seen_only(sought.join(types.drop("name"), "full_name"), scope).groupBy("of", "file_path", "written").agg(F.min_by("target_id", F.struct("near", "target_id")).alias("target_id"))
    last = F.regexp_extract("plain", r"([^.:]+)$", 1)
    only = types.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("target_id").alias("target_id"), F.first("full_name").alias("full_name"), F.first("in_file").alias("in_file")).where("n = 1").drop("n")
    rest = asked.join(found, ["of", "file_path", "written"], "left_anti").withColumn("name", last).join(only, "name").where(F.endswith("full_name", F.concat(F.lit("."), "plain")) | F.endswith("full_name", F.concat(F.lit(":"), "plain")))
    return found.unionByName(seen_only(rest.select("of", "file_path", "written", "target_id", "in_file"), scope))


def closure_of(rows: DataFrame, symbols: DataFrame, scope: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """type, base, depth: each type, its bases of all levels and, for names without a receiver (outer), those of the types around it.

    Interfaces count for interfaces only: a class's members don't include those of the interfaces it implements."""
    from symgraph.operators.graph import bfs

    types = symbols.where("kind = 'Type'").select(F.col("id").alias("type"), "owner", (F.col("type_name") == "Interface").alias("asks")).dropDuplicates(["type"])
    direct = materialise(bases_of(rows, symbols, scope).select("source_id", "target_id", F.lit("Up").alias("kind")), "csharp-bases")
    up = bfs(direct, direct.select(F.col("source_id").alias("seed")), None, "out").where("node != seed").select(F.col("seed").alias("type"), F.col("node").alias("base"), "depth")
    up = up.join(types.select("type", "asks"), "type").join(types.select(F.col("type").alias("base"), F.col("asks").alias("asked")), "base").where("asks or not asked").select("type", "base", "depth")
    up = materialise(types.select("type", F.col("type").alias("base"), F.lit(0).alias("depth")).unionByName(up), "csharp-closure")
    nested = types.select(F.col("type").alias("source_id"), ids.node_id(F.col("owner")).alias("target_id"), F.lit("In").alias("kind")).join(types.select(F.col("type").alias("target_id")), "target_id", "left_semi")
    nested = materialise(nested, "csharp-nested")
    around = bfs(nested, nested.select(F.col("source_id").alias("seed")), None, "out").select(F.col("seed").alias("type"), F.col("node").alias("at"), (F.col("depth") * 1000).alias("far"))
    outer = around.join(up.select(F.col("type").alias("at"), "base", "depth"), "at").select("type", "base", (F.col("depth") + F.col("far")).alias("depth"))
    return up.withColumn("outer", F.lit(False)).unionByName(outer.withColumn("outer", F.lit(True)))


def receivers(asked: DataFrame, rows: DataFrame, symbols: DataFrame, closure: DataFrame, scope: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """asked (in_type, of, file_path, chain) with type_id: the type that a chain of names, calls and elements has in the end,
    null if it is none of the repository's, and told: whether the chain's type is known to be none of it.

    Chains are typed element by element, all at once: what is known so far is a type as it is written and where; an element
    or await unwraps it, any other name is looked up as a member of the type it means and its bases, nearest first.
    """
    members = symbols.where("kind in ('Method', 'Property', 'Field', 'Event')").select(
        F.col("declaring_type_id").alias("base"), F.concat("name", F.when(F.col("kind") == "Method", "()").otherwise("")).alias("step"), F.col("type_name").alias("next"), F.col("owner").alias("next_of"), F.col("file_path").alias("next_file"), F.col("key").alias("member")
    )
    # a base class's members are asked for with base.name, the type's own with anything else
    head = F.get("chain", F.lit(0))
    now = asked.withColumn("id", F.xxhash64("in_type", "file_path", "chain")).select("id", "in_type", "of", "file_path", "chain", head.alias("head"))
    written = F.when(F.startswith("head", F.lit(":")), F.substring("head", 2, 1 << 30))
    begun = now.select("id", "of", "file_path", "chain", "in_type", F.lit(1).alias("at"), written.alias("written"), F.when(F.col("head").isin("this", "base"), F.col("in_type")).alias("type_id"), (F.col("head") == "base").alias("above"), F.col("head").isin("?").alias("lost"), "head")
    # a head that is a name: a member in scope, else a type, else a type with its namespace before it
    named = begun.where("written is null and type_id is null and not lost")
    hit = named.join(closure.select(F.col("type").alias("in_type"), "base", "depth"), "in_type").join(members, (F.col("head") == F.col("step")) & (closure["base"] == members["base"]))
    hit = hit.groupBy("id").agg(F.min_by(F.struct("next", "next_of", "next_file"), F.struct("depth", "member")).alias("m"))
    named = named.join(hit, "id", "left")
    whole = F.when(~F.exists("chain", lambda c: c.rlike(r"[()\[\]:?]|^await$")), F.array_join("chain", "."))
    named = named.withColumn("prefix", whole)
    spelt = materialise(named, "csharp-heads")
    loose = spelt.where("m is null")
    asks = loose.select("of", "file_path", F.col("head").alias("written")).unionByName(loose.where("prefix is not null").select("of", "file_path", F.col("prefix").alias("written"))).where("written not like '%()'")
    means = materialise(named_types(asks, rows, symbols, scope), "csharp-named")
    one, two = (means.select("of", "file_path", F.col("written").alias(c), F.col("target_id").alias(t)) for c, t in (("head", "as_type"), ("prefix", "as_whole")))
    spelt = spelt.join(one, ["of", "file_path", "head"], "left").join(two, ["of", "file_path", "prefix"], "left")
    unknown = F.col("m").isNull() & F.col("as_type").isNull() & F.col("as_whole").isNull()
    spelt = spelt.select(
        "id", F.when(F.col("m").isNotNull(), F.col("m.next_of")).otherwise(F.col("of")).alias("of"), F.when(F.col("m").isNotNull(), F.col("m.next_file")).otherwise(F.col("file_path")).alias("file_path"), "chain",
        F.when(F.col("m").isNull() & F.col("as_type").isNull() & F.col("as_whole").isNotNull(), F.size("chain")).otherwise(F.lit(1)).alias("at"), F.col("m.next").alias("written"), F.when(F.col("m").isNull(), F.coalesce("as_type", "as_whole")).alias("type_id"), F.lit(False).alias("above"), unknown.alias("lost"),
    )
    state = begun.where("written is not null or type_id is not null or lost").select(spelt.columns).unionByName(spelt)
    done = None
    for _ in range(1000):
        # unwrap what is written, then see what it means
        step = F.get("chain", F.col("at"))
        inner = F.when(F.endswith("written", F.lit("[]")), F.expr("left(written, length(written) - 2)")).otherwise(F.regexp_extract("written", r"^[^<]*<(?:.*,)?\s*([^<>]+(?:<.*>)?)\s*>\??$", 1))
        task = F.regexp_extract("written", r"^(?:.*\.)?(?:Task|ValueTask)<(.*)>$", 1)
        state = materialise(state, "csharp-typing", True)
        if not count_of(state):
            break
        unwrapped = state.where((F.coalesce(step, F.lit("")).isin("[]", "await")) & F.col("written").isNotNull())
        unwrapped = unwrapped.withColumn("written", F.when(step == "[]", inner).otherwise(F.when(task != "", task).otherwise(F.col("written")))).withColumn("at", F.col("at") + 1).withColumn("lost", F.col("lost") | (F.col("written") == ""))
        rest = state.where(~(F.coalesce(step, F.lit("")).isin("[]", "await") & F.col("written").isNotNull()))
        asked_types = named_types(rest.where("written is not null"), rows, symbols, scope).withColumnRenamed("target_id", "means")
        rest = materialise(rest.join(asked_types, ["of", "file_path", "written"], "left").withColumn("type_id", F.coalesce("type_id", "means")).drop("means"), "csharp-typed")
        ended = rest.where((F.col("at") >= F.size("chain")) | F.col("type_id").isNull())
        whole_chain = F.col("at") >= F.size("chain")
        ended = ended.select("id", F.when(whole_chain, F.col("type_id")).alias("type_id"), F.when(whole_chain, F.col("above")).otherwise(False).alias("above"), (F.col("written").isNotNull() & F.col("type_id").isNull() & ~F.col("lost")).alias("told"))
        done = ended if done is None else done.unionByName(ended)
        going = rest.where((F.col("at") < F.size("chain")) & F.col("type_id").isNotNull()).withColumn("step", step)
        looked = going.join(closure.where("not outer").select(F.col("type").alias("type_id"), "base", "depth"), "type_id").where("not above or depth > 0").join(members, ["base", "step"])
        best = looked.groupBy("id").agg(F.min_by(F.struct("next", "next_of", "next_file"), F.struct("depth", "member")).alias("m"))
        moved = going.join(best, "id").select("id", F.col("m.next_of").alias("of"), F.col("m.next_file").alias("file_path"), "chain", (F.col("at") + 1).alias("at"), F.col("m.next").alias("written"), F.lit(None).cast("string").alias("type_id"), F.lit(False).alias("above"), F.lit(False).alias("lost"))
        # a type in a type, taken by its name; else the chain leaves what is known
        failed = going.join(best, "id", "left_anti")
        inner_type = failed.join(symbols.where("kind = 'Type'").select(F.col("container_id").alias("type_id"), F.col("name").alias("step"), F.col("id").alias("inner_id")), ["type_id", "step"])
        nested = inner_type.select("id", "of", "file_path", "chain", (F.col("at") + 1).alias("at"), F.lit(None).cast("string").alias("written"), F.col("inner_id").alias("type_id"), F.lit(False).alias("above"), F.lit(False).alias("lost"))
        gone = failed.join(inner_type, "id", "left_anti").select("id", F.lit(None).cast("string").alias("type_id"), F.lit(False).alias("above"), F.lit(False).alias("told"))
        done = done.unionByName(gone)
        state = unwrapped.select(state.columns).unionByName(moved.select(state.columns)).unionByName(nested.select(state.columns))
    return now.select("id", "in_type", "file_path", "chain").join(done, "id", "left") if done is not None else now.select("id", "in_type", "file_path", "chain", F.lit(None).cast("string").alias("type_id"), F.lit(False).alias("above"), F.lit(False).alias("told"))


def resolve(rows: DataFrame, symbols: DataFrame, closure: DataFrame | None = None, scope: tuple[DataFrame, DataFrame] | None = None, places: bool = True) -> DataFrame:
    """target_id, source_id, kind, line and place of each mention that is understood.

    A mention after a receiver is a member of the receiver's type or the nearest of its bases (receivers() types chains of
    parameters, locals, fields, calls, elements, casts, this and base); one without is a member of the type it stands in,
    of its bases, or of the types around it, else a type as named_types() finds it. Calls go to methods, of overloads to
    one that takes as many arguments (the nearest, then the first by its key; argument types are not looked at). What is
    left after a receiver that can't be told is the only symbol of that name, if there is only one; after a type of
    another repository, only if it is an extension method. All joins are on a type and a name, or on a name that one symbol
    has, so frequent names don't meet. With a scope (visible()), only projects that a file's own project sees count (S6).

    Mentions of one form (name, chain and arguments, in one type and file) mean the same, so each form is resolved once and
    its mentions take that over. Without places, only target_id, source_id and kind of calls are given, each once.
    """
    closure = closure_of(rows, symbols, scope) if closure is None else closure
    closure = materialise(closure, "csharp-scopes")
    o = symbols.select(F.col("key").alias("owner"), F.when(F.col("kind") == "Type", F.col("id")).otherwise(F.col("declaring_type_id")).alias("in_type"), F.when(F.col("kind") == "Type", F.col("full_name")).otherwise(F.col("owner")).alias("of"))
    said = rows.where("row = 'mention'" if places else "row = 'mention' and call").drop("of", "in_type")
    said = said.select("name", "file_path", "line", "column", "call", "arguments", "chain", "owner", *(["context"] if places else []))
    said = said.join(o, "owner").withColumnRenamed("owner", "source").withColumn("mention", F.xxhash64("in_type", "of", "file_path", "name", "call", F.coalesce("arguments", F.lit(-1)), "chain"))
    said = materialise(said, "csharp-mentions")
    m = said.groupBy("mention").agg(*[F.first(c).alias(c) for c in ("name", "file_path", "call", "arguments", "chain", "in_type", "of")])
    m = materialise(m, "csharp-forms")
    after = m.where(F.size("chain") > 0)
    typed = receivers(after.select("in_type", "of", "file_path", "chain").distinct(), rows, symbols, closure, scope)
    after = after.join(typed.drop("id"), ["in_type", "file_path", "chain"], "left")
    after = materialise(after, "csharp-received")
    s = symbols.where("kind not in ('Namespace', 'Type')").select("declaring_type_id", F.col("id").alias("target_id"), "name", F.col("kind").alias("target_kind"), F.col("full_name").alias("target_name"), F.col("key").alias("target_key"), "parameters", (F.col("kind") == "Method").alias("call"), F.col("file_path").alias("in_file"))
    place = ["mention", "name", "call", "arguments", "file_path"]
    of_type = after.where("type_id is not null").join(closure.where("not outer").select(F.col("type").alias("type_id"), "base", "depth"), "type_id").where("not above or depth > 0").select(*place, "base", "depth")
    bare = m.where(F.size("chain") == 0).join(closure.select(F.col("type").alias("in_type"), "base", "depth"), "in_type").select(*place, "base", "depth")
    found = of_type.unionByName(bare).join(s.withColumnRenamed("declaring_type_id", "base"), ["base", "name", "call"]).drop("base", "in_file")
    found = materialise(found, "csharp-members")
    # types by their names; after a receiver, types in types and, with the namespace before them, whole names
    left = m.where(~F.col("call")).join(found.select("mention").distinct(), "mention", "left_anti")
    dotted = left.where(~F.exists("chain", lambda c: c.rlike(r"[()\[\]:?]|^(await|this|base)$"))).withColumn("written", F.concat_ws(".", "chain", "name"))
    t = named_types(dotted, rows, symbols, scope).withColumnRenamed("target_id", "type_target")
    of_types = dotted.join(t, ["of", "file_path", "written"]).select(*place, F.col("type_target").alias("target_id"))
    # the only symbol of a name
    unsure = after.where("type_id is null").join(found.select("mention").distinct(), "mention", "left_anti").join(of_types.select("mention"), "mention", "left_anti")
    extends = F.exists("parameters", lambda p: p["is_this"])
    only = s.groupBy("name", "call").agg(F.size(F.collect_set("target_name")).alias("n")).where("n = 1").select("name", "call")
    alone = s.join(only, ["name", "call"]).withColumn("extends", F.coalesce(extends, F.lit(False))).drop("declaring_type_id")
    known = after.where("type_id is not null").join(found.select("mention").distinct(), "mention", "left_anti").withColumn("told", F.lit(True))
    lone = seen_only(unsure.unionByName(known).join(alone, ["name", "call"]), scope).where("extends or not coalesce(told, false)").drop("extends")
    every = found.unionByName(lone.select(*place, F.lit(9000).alias("depth"), "target_id", "target_kind", "target_name", "target_key", "parameters"))
    shift = F.when(F.exists("parameters", lambda p: p["is_this"]) & (F.col("depth") == 9000), 1).otherwise(0)
    n = F.coalesce(F.size("parameters"), F.lit(0)) - shift
    least = F.size(F.filter("parameters", lambda p: ~p["has_default"] & ~p["is_params"] & ~p["is_this"]))
    fits = F.coalesce(F.col("arguments").between(least, F.when(F.exists("parameters", lambda p: p["is_params"]), F.lit(1 << 30)).otherwise(n)), F.lit(False))
    order = F.struct((~fits).alias("a"), "depth", (~F.coalesce(n == F.col("arguments"), F.lit(False))).alias("b"), "target_name", "target_key")
    best = every.groupBy("mention").agg(F.min_by(F.struct("target_id", "target_kind"), order).alias("m")).select("mention", "m.*")
    source, kind = ids.node_id(F.col("source")).alias("source_id"), F.when(F.col("target_kind") == "Method", "Call").when(F.col("target_kind") == "Type", "Type").otherwise("Read").alias("kind")
    if not places:
        calls = materialise(best.where("target_kind = 'Method'"), "csharp-best", True)
        return said.join(broadcast_if(calls, 300_000), "mention").select("target_id", source, kind).distinct()
    best, of_types = materialise(best, "csharp-best", True), materialise(of_types.select("mention", "target_id", F.lit("Type").alias("target_kind")), "csharp-types", True)
    once = said.join(broadcast_if(best, 300_000), "mention").dropDuplicates(["file_path", "line", "column", "source"])
    return once.unionByName(said.join(broadcast_if(of_types, 300_000), "mention")).select("target_id", source, kind, "file_path", "line", "column", "context")


def refs_of(resolved: DataFrame) -> DataFrame:
    """References; calls twice, as their name and as a call (Q8)."""
    rows = resolved.select(F.col("target_id").alias("symbol_id"), F.col("source_id").alias("source_symbol_id"), "file_path", "line", "column", "kind", "context")
    return rows.unionByName(rows.where("kind = 'Call'"))


def bases_of(rows: DataFrame, symbols: DataFrame, scope: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """source_id, target_id, base_kind: each base that a type names and the type of the repository that it means.

    Of several types of that name, in this order: one whose full name ends with the name as it is written with its
    qualifier; one in the outer types, the namespace, or an enclosing one (the nearest); one of a namespace that the file
    uses; one without a namespace. A name that is left counts if only one type has it.
    """
    types = symbols.where("kind = 'Type'")
    asked = types.select(F.col("id").alias("source_id"), F.col("owner").alias("of"), "file_path", F.explode("bases").alias("written"))
    target = types.select(F.col("id").alias("target_id"), F.col("type_name").alias("base_kind")).dropDuplicates(["target_id"])
    found = asked.join(named_types(asked, rows, symbols, scope), ["of", "file_path", "written"]).where("source_id != target_id")
    return found.join(target, "target_id").select("source_id", "target_id", "base_kind").distinct()


def edges_of(symbols: DataFrame, resolved: DataFrame, rows: DataFrame, scope: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Declares, Inherits, Implements (of all interfaces), Overrides, Calls among the repository's symbols.

    An override goes to the nearest base's method of its name with the same parameter types, else with as many parameters,
    as type arguments may be written for type parameters.
    """
    from symgraph.operators.graph import bfs

    types = symbols.where("kind = 'Type'").select("id", "type_name")
    direct = materialise(bases_of(rows, symbols, scope), "bases")
    inherits = direct.where("base_kind != 'Interface'").select("source_id", "target_id", F.lit("Inherits").alias("kind"))
    every = bfs(direct.select("source_id", "target_id", F.lit("Up").alias("kind")), direct.select(F.col("source_id").alias("seed")), None, "out").where("node != seed")
    implements = every.join(types.where("type_name = 'Interface'"), F.col("node") == F.col("id"), "left_semi").select(F.col("seed").alias("source_id"), F.col("node").alias("target_id"), F.lit("Implements").alias("kind"))
    declares = symbols.where("kind in ('Method', 'Property', 'Field')").select(F.col("declaring_type_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("Declares").alias("kind"))
    methods = symbols.where("kind = 'Method'").select("id", "name", "declaring_type_id", "is_override", F.size("parameters").alias("n"), F.regexp_extract("key", r"(\(.*)$", 1).alias("signature"))
    base = every.join(types.where("type_name != 'Interface'"), F.col("node") == F.col("id"), "left_semi").select(F.col("seed").alias("declaring_type_id"), F.col("node").alias("base_id"), "depth")
    above = methods.select(F.col("id").alias("target_id"), "name", "n", F.col("declaring_type_id").alias("base_id"), F.col("signature").alias("other"))
    over = methods.where("is_override").join(base, "declaring_type_id").join(above, ["name", "n", "base_id"])
    over = over.groupBy(F.col("id").alias("source_id")).agg(F.min_by("target_id", F.struct((F.col("signature") != F.col("other")).alias("unlike"), "depth", "target_id")).alias("target_id")).withColumn("kind", F.lit("Overrides"))
    calls = resolved.where("kind = 'Call'").select("source_id", "target_id", F.lit("Calls").alias("kind"))
    found = declares.unionByName(inherits).unionByName(implements).unionByName(over.select("source_id", "target_id", "kind")).unionByName(calls).distinct()
    return found.select(ids.edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")).alias("id"), "source_id", "target_id", "kind", F.lit(1.0).alias("weight"))


def design_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Contains (namespace to type), Uses (symbol to the type of its attribute) and Implements (method to the method
    of an interface that its type implements, with as many parameters)."""
    spaces = symbols.where("kind = 'Namespace'").select(F.col("id").alias("container_id"))
    contains = symbols.where("kind = 'Type'").join(spaces, "container_id").select(F.col("container_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("Contains").alias("kind"))
    types = symbols.where("kind = 'Type'").select(F.regexp_replace("name", "Attribute$", "").alias("attribute"), F.col("id").alias("target_id"))
    named = symbols.select(F.col("id").alias("source_id"), F.explode("attributes").alias("attribute")).withColumn("attribute", F.regexp_replace("attribute", "Attribute$", ""))
    uses = named.join(types, "attribute").select("source_id", "target_id", F.lit("Uses").alias("kind"))
    methods = symbols.where("kind = 'Method'").select("id", "name", "declaring_type_id", F.size("parameters").alias("n"))
    of = edges.where("kind = 'Implements'").select(F.col("source_id").alias("declaring_type_id"), F.col("target_id").alias("interface_id"))
    asked = methods.select(F.col("id").alias("target_id"), "name", "n", F.col("declaring_type_id").alias("interface_id"))
    implements = methods.join(of, "declaring_type_id").join(asked, ["name", "n", "interface_id"]).select(F.col("id").alias("source_id"), "target_id", F.lit("Implements").alias("kind"))
    rows = contains.unionByName(uses).unionByName(implements).distinct()
    return rows.select(ids.edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")).alias("id"), "source_id", "target_id", "kind", F.lit(1.0).alias("weight"))
