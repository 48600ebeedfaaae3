"""Source code of the C family: tokens, scopes, renaming, redaction, shape, restoration.

A file is read by a small hand-written scanner, one file at a time, inside Arrow batches; what can be
said of names, numbers and mappings as tables is left to Spark. A file that doesn't scan to balanced
brackets, or has more lines than allowed, passes through untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

KEYWORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function "
    "get if implements import in infer instanceof interface is keyof let module namespace never new null number object of package private protected public readonly require "
    "return set static string super switch symbol this throw true try type typeof undefined unique unknown var void while with yield".split()
)
#: A token and the white space after it.
_LEX = re.compile(
    r"(?:(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")"
    r"|(?P<number>0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?n?)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)"
    r"|(?P<mark>=>|===|!==|==|!=|<=|>=|\?\?|\?\.|&&|\|\||\+\+|--|\+=|-=|\*=|\.\.\.|[-+*/%=<>!&|^~?:;,.(){}\[\]@#]))\s*",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_CONDITIONAL = frozenset(("if", "while", "for", "with"))
#: Names of the language and its hosts: never renamed, never a file's own.
GLOBALS = frozenset(
    "Array ArrayBuffer BigInt Boolean Buffer DataView Date Error EvalError Float32Array Float64Array Function Infinity Int16Array Int32Array Int8Array Intl JSON Map Math NaN Number Object Partial Pick "
    "Promise Proxy RangeError Readonly ReadonlyArray Record ReferenceError Reflect RegExp Required Set String Symbol SyntaxError TypeError URL Uint16Array Uint32Array Uint8Array WeakMap WeakSet "
    "arguments clearInterval clearTimeout console decodeURIComponent document encodeURIComponent exports fetch global globalThis isFinite isNaN module parseFloat parseInt process require setInterval "
    "setTimeout structuredClone window".split()
)
#: Keywords that begin a statement: an arrow's expression ends before them.
_STATEMENTS = frozenset("const let var class interface enum import export return if for while switch throw try do break continue".split())


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    text: str


def scan(source: str) -> list[Token] | None:
    """All tokens but white space; null if the source doesn't scan or its brackets don't balance.
    Templates are cut into static parts and the code between them."""
    out: list[Token] = []
    open_: list[str] = []
    conditions: list[bool] = []  # of each open bracket, whether it holds a statement's condition
    condition = False  # whether the last token closed one
    at = 0
    while at < len(source):
        c = source[at]
        if c == "`" or (c == "}" and open_ and open_[-1] == "${"):
            if c == "}":
                open_.pop()
                conditions.pop()
            end = at + 1
            while True:
                if end >= len(source):
                    return None
                if source[end] == "\\":
                    end += 2
                elif source[end] == "`":
                    end += 1
                    break
                elif source.startswith("${", end):
                    end += 2
                    open_.append("${")
                    conditions.append(False)
                    break
                else:
                    end += 1
            out.append(Token("template", at, end, source[at:end]))
            at, condition = end, False
            continue
        if c == "/" and not source.startswith(("//", "/*"), at):
            last = out[-1] if out else None
            value = last and not condition and (last.kind in ("number", "string", "template") or last.text in (")", "]", "}") or (last.kind == "name" and last.text not in ("return", "typeof", "case", "in", "of")))
            if not value and (m := _REGEX.match(source, at)):
                out.append(Token("regex", at, m.end(), m[0]))
                at, condition = m.end(), False
                continue
        m = _LEX.match(source, at)
        if m is None:
            return None
        kind = m.lastgroup
        if kind != "space":
            text = m[kind]
            if kind == "mark":
                if text in "([{":
                    conditions.append(text == "(" and bool(out) and out[-1].text in _CONDITIONAL)
                    open_.append(text)
                    condition = False
                elif text in _PAIRS:
                    if not open_ or open_.pop() != _PAIRS[text]:
                        return None
                    condition = conditions.pop()
                else:
                    condition = False
            elif kind != "comment":
                condition = False
            out.append(Token(kind, at, at + len(text), text))
        at = m.end()
    return None if open_ else out


@dataclass
class Scope:
    parent: Scope | None
    kind: str  # block, object, interface, class
    names: dict[str, Declaration | None] = field(default_factory=dict)  # None: opaque

    def find(self, name: str) -> tuple[bool, Declaration | None]:
        scope: Scope | None = self
        while scope:
            if name in scope.names:
                return True, scope.names[name]
            scope = scope.parent
        return False, None


@dataclass
class Declaration:
    name: str
    kind: str
    role: str | None
    start: int


@dataclass
class Analysis:
    declarations: list[Declaration]
    sites: list[tuple[int, int, Declaration, bool]]  # start, end, declaration, shorthand
    unresolved: list[tuple[int, int, str]]


_OBJECT_BEFORE = frozenset(("=", "(", ",", ":", "[", "?", "&&", "||", "??", "return", "=>(", "..."))


def _role(tokens: list[Token], i: int, name: str, mutated: set[str]) -> str:
    """What a variable is, from its first value: accumulator, clamped, difference, boolean or passthrough."""
    value, depth = [], 0
    for j in range(i, len(tokens)):
        t = tokens[j]
        if t.text in ("(", "[", "{"):
            depth += 1
        elif t.text in (")", "]", "}"):
            depth -= 1
        if depth < 0 or (depth == 0 and t.text in (";", ",")):
            break
        value.append(t)
    texts = [t.text for t in value]
    if name in mutated and value and (value[0].kind == "number" or texts[0] in ("[", '""', "''")):
        return "accumulator"
    joined = "".join(texts)
    if re.match(r"Math\.(max|min|floor|ceil|round)\(", joined):
        return "clamped"
    if "-" in texts or "%" in texts:
        return "difference"
    if any(x in texts for x in ("==", "===", "!=", "!==", "<", ">", "<=", ">=", "!", "true", "false")):
        return "boolean"
    return "passthrough"


def analyze(tokens: list[Token], everything: bool = False) -> Analysis:
    """Declarations and the sites that refer to them, innermost binding first.

    Functions, classes, types, interface properties and plain variables can be renamed. Imports,
    parameters, destructured, caught and loop names are opaque: they are never renamed and still hide
    outer names. With ``everything`` they are renamed too.
    """
    code = [t for t in tokens if t.kind not in ("comment", "regex")]
    mutated = {code[i].text for i in range(len(code) - 1) if code[i].kind == "name" and code[i + 1].text in ("+=", "-=", "*=", "++", "--", "=") and (i == 0 or code[i - 1].text not in ("const", "let", "var"))}
    mutated |= {code[i].text for i in range(len(code) - 2) if code[i].kind == "name" and code[i + 1].text == "." and code[i + 2].text == "push"}
    close: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(code):
        if t.kind == "mark" and t.text in "([{":
            stack.append(i)
        elif t.kind == "mark" and t.text in _PAIRS and stack:
            close[stack.pop()] = i
    declared: list[Declaration] = []
    properties: dict[str, Declaration] = {}
    top = Scope(None, "block")
    scope_at: list[Scope] = []
    pending: dict[int, tuple[str, list[tuple[Token, str | None]], tuple[int, int]]] = {}
    none = (0, 0)

    def declare(scope: Scope, t: Token, kind: str | None, role: str | None = None) -> None:
        if kind is None and not everything:
            scope.names.setdefault(t.text, None)
            return
        d = Declaration(t.text, kind or "variable", role, t.start)
        if t.text not in scope.names:
            scope.names[t.text] = d
            declared.append(d)

    def names_in(lo: int, hi: int) -> Iterator[Token]:
        """Binding names of a parameter list or pattern: no types, defaults or keys."""
        depth, skip = 0, False
        for j in range(lo, hi):
            t = code[j]
            if t.text in ("(", "[", "{"):
                depth += 1
                skip = False if depth == 1 else skip
            elif t.text in (")", "]", "}"):
                depth -= 1
            elif t.text == ",":
                skip = False
            elif t.text in (":", "="):
                follows = code[j + 1].kind == "name" if j + 1 < hi else False
                skip = not (t.text == ":" and depth and follows)
            elif t.kind == "name" and t.text not in KEYWORDS and not skip:
                if j + 1 < hi and code[j + 1].text == ":" and depth:
                    continue
                yield t

    # first pass: scopes and declarations
    scopes: list[Scope] = [top]
    ends: list[int] = []

    def arrow(at: int, after: int, own: list[Token], body: int) -> None:
        """An arrow's parameters are its own: of its block, or from here to the end of its expression."""
        if body in close and code[body].text == "{":
            pending[body] = ("block", [(x, None) for x in own], (at, after))
            return
        end = body
        while end < len(code):
            x = code[end]
            if x.text in (",", ";") or (x.kind == "mark" and x.text in _PAIRS) or (end > body and x.kind == "name" and x.text in _STATEMENTS and code[end - 1].text != "."):
                break
            end = close[end] + 1 if end in close else end + 1
        inner = Scope(scopes[-1], "block")
        for x in own:
            declare(inner, x, None)
        scopes.append(inner)
        ends.append(end - 1)
        scope_at[at] = inner

    for i, t in enumerate(code):
        while ends and i > ends[-1]:
            ends.pop()
            scopes.pop()
        scope = scopes[-1]
        before = code[i - 1].text if i else ""
        if t.text == "{" and t.kind == "mark" and i in close:
            kind = "block"
            if i in pending:
                kind = pending[i][0]
            elif before in _OBJECT_BEFORE:
                kind = "object"
            inner = Scope(scope, kind)
            scopes.append(inner)
            ends.append(close[i])
            _, own, (lo, hi) = pending.pop(i, ("", [], none))
            for name in own:
                declare(inner, *name)
            for k in range(lo, hi):  # a parameter list belongs to its function's scope, arrows in it keep theirs
                if scope_at[k] is scope:
                    scope_at[k] = inner
                elif scope_at[k].parent is scope:
                    scope_at[k].parent = inner
            scope = inner
        scope_at.append(scope)
        if t.kind == "mark" and t.text == "(" and i in close:
            j = close[i] + 1
            if j < len(code) and code[j].text == ":":
                while j < len(code) and code[j].text not in ("=>", ";", "{", ",", ")"):
                    j += 1
            if j < len(code) and code[j].text == "=>":
                arrow(i, close[i] + 1, list(names_in(i + 1, close[i])), j + 1)
        if t.kind != "name":
            continue
        following = code[i + 1] if i + 1 < len(code) else Token("end", 0, 0, "")
        if t.text == "import":
            j = i + 1
            while j < len(code) and code[j].kind != "string" and code[j].text != ";":
                if code[j].kind == "name" and code[j].text not in KEYWORDS and not (j + 1 < len(code) and code[j + 1].text == "as"):
                    declare(scope, code[j], None)
                j += 1
        elif t.text == "function" or (following.text == "(" and scope.kind == "class" and t.text not in ("if", "for", "while", "switch", "return")):
            k = i + 1
            own: list[tuple[Token, str | None]] = []
            if t.text == "function":
                if k < len(code) and code[k].text == "*":
                    k += 1
                if k < len(code) and code[k].kind == "name":
                    if before in _OBJECT_BEFORE:
                        own.append((code[k], "function"))
                    else:
                        declare(scope, code[k], "function")
                    k += 1
            while k < len(code) and code[k].text != "(":
                k += 1
            if k in close:
                own += [(x, None) for x in names_in(k + 1, close[k])]
                j = close[k] + 1
                while j < len(code) and code[j].text not in ("{", ";", "}"):
                    j += 1
                if j in close:
                    pending[j] = ("block", own, (k, close[k] + 1))
        elif t.text in ("class", "interface") and following.kind == "name":
            declare(scope, following, "class" if t.text == "class" else "type")
            j = i + 1
            while j < len(code) and code[j].text != "{":
                j += 1
            if j in close:
                pending[j] = (t.text, [], none)
        elif t.text == "type" and following.kind == "name" and i + 2 < len(code) and code[i + 2].text in ("=", "<"):
            declare(scope, following, "type")
        elif t.text in ("const", "let", "var"):
            j = i + 1
            loop = before == "("
            while j < len(code):
                if code[j].text in ("{", "[") and j in close:
                    for x in names_in(j + 1, close[j]):
                        declare(scope, x, None)
                    j = close[j] + 1
                elif code[j].kind == "name":
                    k, value = j + 1, None
                    while k < len(code) and code[k].text not in ("=", ";", ",", "of", "in", ")", "}"):
                        k = close[k] + 1 if k in close else k + 1
                    if k < len(code) and code[k].text == "=":
                        value = k + 1
                    if loop and k < len(code) and code[k].text in ("of", "in"):
                        declare(scope, code[j], None)
                    else:
                        declare(scope, code[j], "variable", _role(code, value, code[j].text, mutated) if value else "passthrough")
                    j = k
                while j < len(code) and code[j].text not in (",", ";", "of", "in", ")", "}"):
                    j = close[j] + 1 if j in close else j + 1
                    if j < len(code) and code[j].kind == "name" and code[j].text in KEYWORDS | {"if"} and code[j].text not in ("as", "await", "new", "typeof", "null", "true", "false", "undefined", "function", "async", "this", "number", "string", "boolean", "in", "of"):
                        break
                if j < len(code) and code[j].text == ",":
                    j += 1
                    continue
                break
        elif t.text == "catch" and following.text == "(" and i + 1 in close:
            pending[close[i + 1] + 1] = ("block", [(x, None) for x in names_in(i + 2, close[i + 1])], (i + 1, close[i + 1] + 1))
        elif scope.kind == "interface" and before in ("{", ";", ",", "readonly", "") or (scope.kind == "interface" and i and "\n" in _gap(code, i)):
            if following.text in (":", "?") and t.text not in ("readonly",):
                if t.text not in properties:
                    j = i + 2 if following.text == ":" else i + 3
                    kind = "".join(x.text for x in code[j : j + 1])
                    role = {"number": "number", "boolean": "boolean"}.get(kind, "enum" if kind[:1] in "'\"" and kind else "other")
                    properties[t.text] = Declaration(t.text, "property", role, t.start)
                    declared.append(properties[t.text])
        if following.text == "=>" and t.text not in KEYWORDS:
            arrow(i, i + 1, [t], i + 2)
    # second pass: sites
    sites: list[tuple[int, int, Declaration, bool]] = []
    unresolved: list[tuple[int, int, str]] = []
    for i, t in enumerate(code):
        if t.kind != "name" or t.text in KEYWORDS:
            continue
        before = code[i - 1].text if i else ""
        after = code[i + 1].text if i + 1 < len(code) else ""
        scope = scope_at[i]
        if before in (".", "?."):
            if t.text in properties:
                sites.append((t.start, t.end, properties[t.text], False))
            continue
        key = (scope.kind == "object" and after == ":" and before in ("{", ",")) or (scope.kind == "interface" and after in (":", "?") and t.text in properties)
        if key:
            if t.text in properties:
                sites.append((t.start, t.end, properties[t.text], False))
            continue
        if scope.kind == "class" and after == "(" and before in ("{", "}", ";", "async", "static", "get", "set", "private", "public", "protected"):
            continue  # a method's name
        found, d = scope.find(t.text)
        short = scope.kind == "object" and before in ("{", ",") and after in (",", "}")
        if d:
            sites.append((t.start, t.end, d, short))
        elif short and t.text in properties and not found:
            sites.append((t.start, t.end, properties[t.text], False))
        elif not found:
            unresolved.append((t.start, t.end, t.text))
    return Analysis(declared, sites, unresolved)


def _gap(code: list[Token], i: int) -> str:
    return "\n" if code[i].start > code[i - 1].end else ""


def forbidden_tokens(source: str) -> set[str]:
    """Identifiers and numbers of a text: names that no synthetic may take."""
    return set(re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*|\d+", source))


class Names:
    """Synthetics of one session, minted in order of first sight; none is met twice."""

    def __init__(self, style: str = "compact", theme: int = 0):
        self.style, self.theme = style, theme
        self.of: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.counts: Counter[tuple[str, str | None]] = Counter()
        self.met: dict[str, str] = {}  # names minted or met again; whoever wants them of a part empties it before

    def known(self, name: str) -> str:
        """The synthetic of a name that has one."""
        self.met[name] = self.of[name]
        return self.of[name]

    def get(self, d: Declaration, forbidden: set[str]) -> str:
        return self.named(d.name, d.kind, d.role if self.style == "stealth" else None, forbidden)

    def named(self, name: str, kind: str, role: str | None, forbidden: set[str]) -> str:
        if name in self.of:
            return self.known(name)
        self.counts[kind, role] += 1
        n = self.counts[kind, role]
        for candidate in self._candidates(kind, role, n):
            if candidate != name and candidate not in forbidden and candidate not in self.back and candidate not in self.of:
                self.of[name], self.back[candidate] = candidate, name
                return self.known(name)
        raise AssertionError("candidates never end")

    def _candidates(self, kind: str, role: str | None, n: int) -> Iterator[str]:
        from .mapping import pooled_names

        if self.style == "compact":
            while True:
                yield f"{P.KIND_PREFIX[kind]}_{_base36(n)}"
                n += 1
        pool = pooled_names(kind, self.theme)
        if role in ("clamped", "difference", "boolean", "accumulator", "number", "enum"):
            pool = [role + x[0].upper() + x[1:] for x in pool]
        for k in range(len(pool)):
            yield pool[(n - 1 + k) % len(pool)]
        while True:
            for k in range(len(pool)):
                yield f"{pool[(n - 1 + k) % len(pool)]}{_base36(n)}"
            n += 1


def _base36(n: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out or "0"


@dataclass
class Result:
    output: str
    changed: bool
    declarations: list[Declaration]
    comments: int = 0
    strings: int = 0
    constants: int = 0
    hidden: list[tuple[str, str]] = field(default_factory=list)  # category and value of all that was protected


def _splice(source: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, text in sorted(edits):
        if start < at:
            continue
        out += [source[at:start], text]
        at = end
    return "".join(out) + source[at:]


def _fingerprint(text: str) -> int:
    h = 0
    for c in text:
        h = (h * P.FINGERPRINT_BASE + ord(c)) % P.FINGERPRINT_MODULUS
    return h


def placeholder(comment: str, ordinal: int, style: str) -> str:
    """The phrase that stands for a comment; line breaks stay."""
    block = not comment.startswith("//")
    size = len(comment) - (4 if block else 2)
    bucket = "short" if size <= P.SHORT_MOST else "medium" if size <= P.MEDIUM_MOST else "long"
    pool = P.PHRASES[style, bucket]
    phrase = pool[(_fingerprint(comment) + ordinal) % len(pool)]
    if not block:
        return f"// {phrase}"
    breaks = comment.count("\n")
    return f"/* {phrase} */" if not breaks else f"/* {phrase}{chr(10) * (breaks - 1)}\n*/"


def _prose(content: str) -> bool:
    return len(content) >= P.MIN_STRING and not re.search(P.MACHINE_TOKEN, content) and len([w for w in re.split("[ _]+", content) if w]) >= 2


_COMPARE = frozenset(("==", "===", "!=", "!==", "<", ">", "<=", ">="))


def _structural(code: list[Token], i: int) -> bool:
    """Strings whose very value counts: import sources, keys, attributes, compared and case values."""
    before = code[i - 1].text if i else ""
    after = code[i + 1].text if i + 1 < len(code) else ""
    key = after == ":" and before in ("{", ",")
    attribute = before == "=" and i > 2 and code[i - 2].kind == "name" and code[i - 3].kind == "name" and after in (">", "/", "name") and "<" in [t.text for t in code[max(0, i - 8) : i]]
    return before in ("from", "import", "case") or before in _COMPARE or after in _COMPARE or key or attribute


def redact(source: str, names: Names, comments: bool = True, strings: bool = True) -> Result:
    """Comments become phrases, long prose in strings becomes names; lengths folded from a redacted
    constant become numbers, and short literals of a declared union are replaced wherever they occur."""
    tokens = scan(source)
    if tokens is None:
        return Result(source, False, [])
    edits, forbidden = [], forbidden_tokens(source)
    code = [t for t in tokens if t.kind != "comment"]
    out = Result(source, True, [])
    if comments:
        for k, t in enumerate(t for t in tokens if t.kind == "comment"):
            edits.append((t.start, t.end, placeholder(t.text, k, names.style)))
            out.comments += 1
            out.hidden.append(("comment", t.text))
    if strings:
        contract = {t.text[1:-1] for i, t in enumerate(code) if t.kind == "string" and (i and code[i - 1].text == "|" or i + 1 < len(code) and code[i + 1].text == "|")}
        lengths: dict[str, int] = {}
        for i, t in enumerate(code):
            if t.kind != "string" or "\\" in t.text:
                continue
            content = t.text[1:-1]
            if content in contract:
                new = names.named(content, "literal", None, forbidden)
            elif _prose(content) and not _structural(code, i):
                new = names.named(content, "string", None, forbidden)
                if i >= 3 and code[i - 1].text == "=" and code[i - 3].text == "const":
                    lengths[code[i - 2].text] = len(content)
            else:
                continue
            edits.append((t.start, t.end, t.text[0] + new + t.text[0]))
            out.strings += 1
            out.hidden.append(("string", content))
        for i in range(len(code) - 2):
            if code[i].text in lengths and code[i + 1].text == "." and code[i + 2].text == "length" and i and code[i - 1].text == "=":
                edits.append((code[i].start, code[i + 2].end, str(lengths[code[i].text])))
                out.constants += 1
    out.output = _splice(source, edits)
    return out


def obfuscate(source: str, names: Names, comments: bool = True, strings: bool = True, max_lines: int = 5000, known: bool = True) -> Result:
    """Redaction, then renaming of declared names and of names that the session knows already."""
    if source.count("\n") + 1 > max_lines:
        return Result(source, False, [])
    first = redact(source, names, comments, strings)
    tokens = scan(first.output) if first.changed else None
    if tokens is None:
        return Result(source, False, [])
    found = analyze(tokens)
    forbidden = forbidden_tokens(first.output)
    edits = []
    for start, end, d, short in found.sites:
        new = names.get(d, forbidden)
        edits.append((start, end, f"{d.name}: {new}" if short else new))
    if known:
        edits += [(s, e, names.known(n)) for s, e, n in found.unresolved if n in names.of]
    hidden = [("identifier", d.name) for d in found.declarations] + first.hidden
    return Result(_splice(first.output, edits), True, found.declarations, first.comments, first.strings, first.constants, hidden)


def obfuscate_known(text: str, names: Names) -> str:
    """Names that are mapped already, in any text, whole words only."""
    if not names.of:
        return text
    words = "|".join(sorted(map(re.escape, names.of), key=len, reverse=True))
    return re.sub(rf"(?<![A-Za-z0-9_$])(?:{words})(?![A-Za-z0-9_$])", lambda m: names.known(m[0]), text)


def restore(text: str, back: dict[str, str]) -> str:
    """Synthetics back to originals, whole words only; ``a: synthetic`` made from a shorthand folds back."""
    if not back:
        return text
    words = "|".join(sorted(map(re.escape, back), key=len, reverse=True))
    text = re.sub(rf"(?<![A-Za-z0-9_$])([A-Za-z_$][A-Za-z0-9_$]*): ({words})(?![A-Za-z0-9_$])", lambda m: m[1] if back[m[2]] == m[1] else m[0], text)
    return re.sub(rf"(?<![A-Za-z0-9_$])(?:{words})(?![A-Za-z0-9_$])", lambda m: back[m[0]], text)


SHAPE = ("functions", "classes", "interfaces", "branches", "loops", "returns", "numbers", "booleans", "strings", "imports", "returned_fields", "enum_arity")


def shape(source: str) -> dict[str, int] | None:
    """Structural counts of a file."""
    return _shape(scan(source))


def _shape(tokens: list[Token] | None) -> dict[str, int] | None:
    if tokens is None:
        return None
    code = [t for t in tokens if t.kind != "comment"]
    c = Counter(t.text for t in code if t.kind == "name")
    fields = 0
    for i in range(len(code) - 1):
        if code[i].text == "return" and code[i + 1].text == "{":
            depth, n, j = 0, 1, i + 1
            while j < len(code):
                depth += code[j].text in ("{", "(", "[")
                depth -= code[j].text in ("}", ")", "]")
                if depth == 0:
                    break
                n += depth == 1 and code[j].text == "," and code[j + 1].text != "}"
                j += 1
            fields = max(fields, n if j > i + 2 else 0)
    union = {t.text for i, t in enumerate(code) if t.kind == "string" and (i and code[i - 1].text == "|" or i + 1 < len(code) and code[i + 1].text == "|")}
    return {
        "functions": c["function"] + sum(t.text == "=>" for t in code), "classes": c["class"], "interfaces": c["interface"], "branches": c["if"] + c["case"],
        "loops": c["for"] + c["while"], "returns": c["return"], "numbers": sum(t.kind == "number" for t in code), "booleans": c["true"] + c["false"],
        "strings": sum(t.kind == "string" for t in code), "imports": c["import"], "returned_fields": fields, "enum_arity": len(union),
    }


#: Counts that a disguise must keep.
COMPARED = tuple(k for k in SHAPE if k not in ("numbers", "booleans", "strings"))
#: Domains of whole-file disguises: nouns that names are built from, by rule.
DOMAINS = {
    "scheduling": ("slot", "calendar", "shift", "booking"),
    "inventory": ("shelf", "parcel", "stock", "depot"),
    "routing": ("route", "segment", "junction", "lane"),
    "publishing": ("article", "draft", "column", "edition"),
    "forecasting": ("signal", "sample", "season", "trend"),
}


def choose_domain(s: dict[str, int], preferred: str | None = None) -> str:
    """A domain by the file's shape: classes, then choices, then many numbers with flags, then strings."""
    if preferred in DOMAINS:
        return preferred
    if s["classes"]:
        return "inventory"
    if s["enum_arity"] >= 4 or s["branches"] >= 3:
        return "routing"
    if s["numbers"] >= 5 and s["booleans"]:
        return "scheduling"
    return "publishing" if s["strings"] else "forecasting"


@dataclass
class Disguise:
    """``mapping`` is original to new names; ``strings`` and ``comments`` are new to original texts."""

    output: str
    domain: str
    mapping: dict[str, str]
    valid: bool
    reason: str | None
    strings: dict[str, str] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    glossary: dict[str, str] = field(default_factory=dict)

    def restore(self, text: str) -> str:
        """Comments first, then strings, then names; what the disguise doesn't know stays."""
        for made, original in sorted([*self.comments.items(), *self.strings.items()], key=lambda x: -len(x[0])):
            text = text.replace(made, original)
        return restore(text, {new: old for old, new in self.mapping.items()})


def _own_names(code: list[Token], declarations: list[Declaration]) -> dict[str, str]:
    """Names that a file gives itself, with their kinds: declarations, members of classes and enums, and
    type parameters. The language's own names aren't among them."""
    out = {d.name: d.kind for d in declarations}
    text = lambda i: code[i].text if 0 <= i < len(code) else ""
    name = lambda i: 0 <= i < len(code) and code[i].kind == "name" and code[i].text not in KEYWORDS
    i = 0
    while i < len(code):
        if name(i) and text(i - 1) in ("{", ";", "}", "private", "public", "protected", "readonly", "static", "async", "get", "set") and text(i + 1) in ("(", ":", "?"):
            out.setdefault(code[i].text, "member")
        if text(i) == "as" and name(i - 1) and text(i - 2) in ("{", ","):
            out.setdefault(text(i - 1), "variable")  # an import's name where it comes from
        if text(i) == "enum" and name(i + 1) and text(i + 2) == "{":
            out.setdefault(text(i + 1), "type")
            depth, j = 1, i + 3
            while j < len(code) and depth:
                if depth == 1 and text(j - 1) in ("{", ",") and name(j):
                    out.setdefault(text(j), "member")
                depth += (text(j) in ("{", "(", "[")) - (text(j) in ("}", ")", "]"))
                j += 1
        opens = text(i) == "<" and ((name(i - 1) and (text(i - 2) in ("function", "class", "interface", "type", "*") or text(i - 1) in out)) or text(i - 1) in ("=", "(", ","))
        if opens and name(i + 1) and text(i + 2) in (",", ">", "extends", "="):
            j, depth, found = i + 1, 1, []
            while j < len(code) and depth and text(j) not in (";", "{", "}"):
                if depth == 1 and text(j - 1) in ("<", ",") and name(j):
                    found.append(text(j))
                depth += (text(j) == "<") - (text(j) == ">")
                j += 1
            # types that a call or a base is given are no parameters of its own
            if not depth and (text(i - 2) in ("function", "class", "interface", "type", "*") or text(j) == "("):
                for x in found:
                    if x not in out and (len(x) > 0 and text(i - 2) != "new"):
                        out[x] = "type"
        i += 1
    return {k: v for k, v in out.items() if k not in GLOBALS and k not in KEYWORDS}


_LETTERS = re.compile(r"[^\W\d_]{2}")


def _template_parts(t: Token) -> tuple[str, str, str]:
    """A template token's delimiter, static text and delimiter."""
    end = "${" if t.text.endswith("${") else "`"
    return t.text[0], t.text[1 : len(t.text) - len(end)], end


def glossary(domain: str, declarations: list[Declaration]) -> dict[str, str]:
    """What a domain's words stand for: its things for the file's first type, its doing for the first
    function, its state for the first property or variable."""
    nouns = DOMAINS[domain]
    first = lambda *kinds: next((d.name for d in declarations if d.kind in kinds), None)
    thing, doing, state = first("type", "class"), first("function"), first("property", "variable")
    out: dict[str, str] = {}
    if thing:
        out |= {nouns[0]: thing, f"{nouns[0]}s": thing, nouns[3]: thing}
    if doing:
        out |= {f"{nouns[1]}{x}": doing for x in ("", "ing", "ed", "s")}
    if state:
        out |= {nouns[2]: state, f"{nouns[2]}s": state}
    return out


def disguise(source: str, preferred: str | None = None) -> Disguise:
    """The whole file retold in one domain: every name of its own, every comment, local import path,
    prose string and static part of a template. The result is valid if it scans, keeps its shape, and
    neither a name of the source that isn't the language's own, nor one of its texts, nor another domain's
    noun is left. Members of values from elsewhere stay, as their names are no part of the file."""
    tokens = scan(source)
    own = _shape(tokens)
    if own is None:
        return Disguise(source, "", {}, False, "does not scan")
    domain = choose_domain(own, preferred)
    nouns = DOMAINS[domain]
    taken = forbidden_tokens(source)
    found = analyze(tokens, everything=True)
    code = [t for t in tokens if t.kind != "comment"]
    mapping: dict[str, str] = {}
    counts: Counter[str] = Counter()

    def named(name: str, kind: str) -> str:
        if name not in mapping:
            while True:
                counts[kind] += 1
                n = counts[kind]
                stem = nouns[(n - 1) % len(nouns)] + kind.capitalize() + (str((n - 1) // len(nouns) + 1) if n > len(nouns) else "")
                new = stem[0].upper() + stem[1:] if kind in ("class", "type") else stem
                if new not in taken and new not in mapping.values():
                    mapping[name] = new
                    break
        return mapping[name]

    edits: list[tuple[int, int, str]] = []
    strings: dict[str, str] = {}
    comments: dict[str, str] = {}
    texts: list[str] = []
    renamed = _own_names(code, found.declarations)
    for i, t in enumerate(code):
        if t.kind == "name" and t.text in renamed:
            edits.append((t.start, t.end, named(t.text, renamed[t.text])))
        elif t.kind == "string":
            content, q = t.text[1:-1], t.text[0]
            if i and code[i - 1].text in ("from", "import") and content.startswith("."):
                made = f"{q}./{nouns[len(strings) % len(nouns)]}Module{len(strings) + 1}{q}"
            elif _prose(content):
                made = f"{q}the {nouns[0]} and {nouns[1]} note {len(strings) + 1}{q}"
                texts.append(content)
            else:
                continue
            strings[made] = t.text
            edits.append((t.start, t.end, made))
        elif t.kind == "template":
            lead, static, end = _template_parts(t)
            if not _LETTERS.search(static):
                continue
            head, tail = static[: len(static) - len(static.lstrip())], static[len(static.rstrip()) :]
            made = f"{lead}{head}the {nouns[2]} and {nouns[3]} text {len(strings) + 1}{tail}{end}"
            texts.append(static.strip())
            strings[made] = t.text
            edits.append((t.start, t.end, made))
    for k, t in enumerate(t for t in tokens if t.kind == "comment"):
        phrase = f"keeps {nouns[k % len(nouns)]} {k + 1} in step"
        made = f"// {phrase}" if t.text.startswith("//") else f"/* {phrase}" + "\n" * t.text.count("\n") + " */"
        comments[made] = t.text
        texts.append(t.text.strip("/* \n"))
        edits.append((t.start, t.end, made))
    output = _splice(source, edits)
    other = {n for d, ns in DOMAINS.items() if d != domain for n in ns}
    again = scan(output)
    left = [t for t in again or [] if t.kind != "comment"]
    words = {t.text for t in left if t.kind == "name"}
    # names of the source that stand free in the result, not as members of values from elsewhere
    free = {t.text for i, t in enumerate(left) if t.kind == "name" and (i == 0 or left[i - 1].text not in (".", "?."))}
    before = {t.text for t in code if t.kind == "name"}
    keys = {t.text for i, t in enumerate(code) if t.kind == "name" and i + 1 < len(code) and code[i + 1].text == ":" and i and code[i - 1].text in ("{", ",")}
    after = _shape(again)
    reason = (
        "does not scan" if after is None
        else "real name left" if any(n in words for n in mapping if n not in mapping.values()) or (free & before) - GLOBALS - KEYWORDS - keys
        else "real text left" if any(x and _LETTERS.search(x) and x in output for x in texts)
        else "other vocabulary" if (other & words) - forbidden_tokens(source)
        else "shape changed" if any(own[k] != after[k] for k in COMPARED)
        else None
    )
    return Disguise(output, domain, mapping, reason is None, reason, strings, comments, glossary(domain, found.declarations))


#: Source that one session's group may hold: it is held in a task's memory.
SESSION_BYTES = 256 << 20
EVENTS = "events array<struct<category:string,value_hash:string>>"
EVENTS_TYPE = pa.list_(pa.struct([("category", pa.string()), ("value_hash", pa.string())]))


def hashed(hidden: list[tuple[str, str]]) -> list[dict[str, str]]:
    """Audit entries of protected values: their category and SHA-256."""
    return [{"category": c, "value_hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for c, v in hidden]


def check_size(table: pa.Table, session) -> None:
    if table.nbytes > SESSION_BYTES:
        raise ValueError(f"session {session!r} holds {table.nbytes} bytes of source, more than {SESSION_BYTES}")


def obfuscate_files(df: DataFrame, session: str, path: str, source: str, style: str = "compact", max_lines: int = 5000) -> DataFrame:
    """(session, path, output, changed, mapping, comments, strings, constants, events) of each file.

    Names of a session depend on those before, so a session's files are one group; groups are sessions,
    never the corpus, and one of over ``SESSION_BYTES`` of source is an error. Files go in order of their
    path. ``events`` has a category and a value's hash for each declaration, comment and string.
    """
    schema = f"{session} string, {path} string, output string, changed boolean, mapping map<string,string>, comments long, strings long, constants long, {EVENTS}"

    def run(key, table: pa.Table) -> pa.Table:
        names = Names(style)
        rows = []
        check_size(table, key[0].as_py())
        for r in sorted(table.select([path, source]).to_pylist(), key=lambda r: r[path] or ""):
            x = obfuscate(r[source] or "", names, max_lines=max_lines)
            own = {d.name: names.of[d.name] for d in x.declarations if d.name in names.of}
            rows.append((key[0].as_py(), r[path], x.output, x.changed, list(own.items()), x.comments, x.strings, x.constants, hashed(x.hidden)))
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.int64(), EVENTS_TYPE]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[session, path, "output", "changed", "mapping", "comments", "strings", "constants", "events"])

    return df.select(F.col(session).cast("string").alias(session), path, source).groupBy(session).applyInArrow(lambda key, table: run(key, table), schema)


def disguise_files(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, output, domain, valid, reason, restored) of each file, told in a domain of its own. Files are
    dealt over all tasks first: a table of small rows is read by few, whatever its files cost here."""
    text = F.lit(None).cast("string")
    schema = df.select(F.col(key), text.alias("output"), text.alias("domain"), F.lit(None).cast("boolean").alias("valid"), text.alias("reason"), text.alias("restored")).schema
    names = schema.names

    def run(batches):
        for batch in batches:
            made = [disguise(x or "") for x in batch.column(1).to_pylist()]
            columns = [[d.output for d in made], [d.domain for d in made], [d.valid for d in made], [d.reason for d in made], [d.restore(d.output) for d in made]]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.select(key, source).repartition(tasks).mapInArrow(run, schema)


def declarations_of(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, name, kind, role): what the files that scan declare, in order of first sight."""
    text = F.lit(None).cast("string")
    schema = df.select(F.col(key), text.alias("name"), text.alias("kind"), text.alias("role")).schema

    def run(batches):
        for batch in batches:
            scanned = [scan(x or "") for x in batch.column(1).to_pylist()]
            found = [(i, d.name, d.kind, d.role) for i, tokens in enumerate(scanned) if tokens for d in analyze(tokens).declarations]
            at, *columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return df.select(key, source).mapInArrow(run, schema)


def shapes_of(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, part, n): structural counts of files that scan."""
    schema = df.select(F.col(key), F.lit("").alias("part"), F.lit(0).cast("long").alias("n")).schema

    def run(batches):
        for batch in batches:
            found = [(i, k, n) for i, x in enumerate(batch.column(1).to_pylist()) for k, n in (shape(x or "") or {}).items()]
            at, parts, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(parts, pa.string()), pa.array(n, pa.int64())], names=schema.names)

    return df.select(key, source).mapInArrow(run, schema)


def tokens_of(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, kind, start, end, text): a row for each token of files that scan."""
    schema = df.select(F.col(key), F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text")).schema

    def run(batches):
        for batch in batches:
            at, kinds, starts, ends, texts = [], [], [], [], []
            for i, s in enumerate(batch.column(1).to_pylist()):
                for t in scan(s or "") or ():
                    at.append(i), kinds.append(t.kind), starts.append(t.start), ends.append(t.end), texts.append(t.text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())],
                names=[key, "kind", "start", "end", "text"],
            )

    return df.select(key, source).mapInArrow(run, schema)
