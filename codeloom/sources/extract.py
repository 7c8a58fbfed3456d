"""Symbols and raw edges of source texts, one language plug-in for each of six languages.

Python is read by its own parser. The others are read by a scanner that blanks comments and literals, follows
braces and matches declarations in what is left; it is not a full parser, and rare declarations escape it.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field


@dataclass
class Found:
    """Symbols (name, kind, line, column, end_line, signature, namespace, parent) and raw edges (caller, token, kind, line)."""

    symbols: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)

    def symbol(self, name: str, kind: str, line: int, column: int = 0, end: int = 0, signature: str = "", namespace: str = "", parent: str = "") -> None:
        self.symbols.append((name, kind, line, column, max(end, line), signature, namespace, parent))

    def edge(self, caller: str, token: str, kind: str, line: int) -> None:
        self.edges.append((caller, token, kind, line))


def cut_signature(text: str) -> str:
    head = re.split(r"[{;]", text, maxsplit=1)[0].rstrip()
    data = head.encode()
    return head if len(data) <= 200 else data[:200].decode(errors="ignore") + "..."


class LanguagePlugin:
    """What a language gives: its name, its extensions, a pass over the bytes before parsing, and the extraction."""

    language = ""
    extensions: tuple[str, ...] = ()

    def preprocess(self, text: str) -> str:
        return text

    def extract(self, text: str, path: str) -> Found:
        raise NotImplementedError


class Registry:
    def __init__(self, plugins: list[LanguagePlugin]):
        self.by_extension: dict[str, LanguagePlugin] = {}
        languages = set()
        for plugin in plugins:
            if plugin.language in languages:
                raise ValueError(f"language given twice: {plugin.language}")
            languages.add(plugin.language)
            for extension in plugin.extensions:
                if not extension.startswith("."):
                    raise ValueError(f"extension without a dot: {extension}")
                if extension in self.by_extension:
                    raise ValueError(f"extension given twice: {extension}")
                self.by_extension[extension] = plugin

    def find(self, path: str) -> LanguagePlugin | None:
        found = re.search(r"\.[^./]+$", path)
        return self.by_extension.get(found.group().lower()) if found else None


class PythonPlugin(LanguagePlugin):
    language, extensions = "python", (".py", ".pyi")

    def extract(self, text: str, path: str) -> Found:
        found = Found()
        tree = ast.parse(text)
        lines = text.split("\n")

        def visit(node: ast.AST, parent: str, caller: str, top: bool) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    found.symbol(child.name, "method" if parent else "function", child.lineno, child.col_offset, child.end_lineno, lines[child.lineno - 1].strip().rstrip(":"), "", parent)
                    visit(child, parent, f"{path}:{parent}::{child.name}" if parent else f"{path}:{child.name}", False)
                elif isinstance(child, ast.ClassDef):
                    found.symbol(child.name, "class", child.lineno, child.col_offset, child.end_lineno, lines[child.lineno - 1].strip().rstrip(":"), "", parent)
                    for base in child.bases:
                        name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
                        if name:
                            found.edge(child.name, name, "inherits", child.lineno)
                    visit(child, child.name, caller, False)
                else:
                    if isinstance(child, ast.Call):
                        target = child.func
                        name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
                        if name:
                            found.edge(caller, name, "calls", child.lineno)
                    elif top and isinstance(child, ast.Import):
                        for alias in child.names:
                            found.edge(path, alias.name, "includes", child.lineno)
                    elif top and isinstance(child, ast.ImportFrom):
                        dots = "." * child.level
                        for name in [dots + child.module] if child.module else [dots + a.name for a in child.names]:
                            found.edge(path, name, "includes", child.lineno)
                    visit(child, parent, caller, top and isinstance(child, (ast.Expr, ast.Import, ast.ImportFrom)))

        visit(tree, "", path, True)
        return found


_LITERALS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`[^`]*`", re.S)


def blank(text: str) -> str:
    """The text with comments and the insides of literals as spaces, of the same length and lines."""

    def spaces(m: re.Match) -> str:
        s = m.group()
        inner = re.sub(r"[^\n]", " ", s)
        return s[0] + inner[1:-1] + s[-1] if s[0] in "\"'`" else inner

    return _LITERALS.sub(spaces, text)


@dataclass
class _Scope:
    kind: str  # namespace, type, function or block
    name: str
    parent: str
    start: int


class BracePlugin(LanguagePlugin):
    """A scanner for languages with braces. Subclasses say how the head before a brace or semicolon reads."""

    keywords = frozenset("if for while switch catch return sizeof new delete else do case throw using namespace try lock foreach fixed unsafe checked match loop defer go select func fn synchronized assert super this".split())
    call = re.compile(r"(?<![\w$])((?:[A-Za-z_]\w*\s*(?:::|\.|->)\s*)*~?[A-Za-z_]\w*)\s*(?:<[\w\s,:*&<>]*>)?\s*!?\s*\(")

    def head(self, text: str, scopes: list[_Scope], opens: bool) -> tuple[str, str, str, list[str]] | None:
        """(scope kind, symbol kind or empty, name, bases) of a declaration's head; None if it declares nothing."""
        raise NotImplementedError

    def extract(self, text: str, path: str) -> Found:
        found, clean = Found(), blank(text)
        line_at = [m.start() for m in re.finditer("\n", clean)]
        import bisect

        def line(at: int) -> int:
            return bisect.bisect_left(line_at, at) + 1

        scopes: list[_Scope] = []
        pending: list[int | None] = []
        self.imports(text, clean, path, found, line)
        start = 0
        for m in re.finditer(r"[{};]", clean):
            head, at = clean[start : m.start()], start + len(clean[start : m.start()]) - len(clean[start : m.start()].lstrip())
            inside = any(s.kind == "function" for s in scopes)
            declared = None if m.group() == "}" else self.head(head.strip(), scopes, m.group() == "{")
            if declared and inside and declared[0] == "function":
                declared = None
            if declared:
                kind, symbol, name, bases = declared
                owner = next((s.name for s in reversed(scopes) if s.kind == "type"), "")
                space = self.joined([s.name for s in scopes if s.kind == "namespace"])
                if "::" in name and kind == "function":
                    *path_parts, name = name.split("::")
                    owner = path_parts[-1]
                at = start + max(0, clean[start : m.start()].rfind(name)) if name else at
                first = start + len(clean[start : m.start()]) - len(clean[start : m.start()].lstrip())
                if symbol:
                    shown = "method" if symbol == "function" and owner else symbol
                    found.symbol(name, self.shown_kind(shown, owner, scopes, m.group() == "{"), line(at), first - (clean.rfind("\n", 0, first) + 1), line(at), cut_signature(text[first : m.start()]), space, owner)
                    for base in bases:
                        found.edge(name, base, "inherits", 0)
            if m.group() == "{":
                if declared:
                    scopes.append(_Scope(declared[0], name, owner, len(found.symbols) - 1 if declared[1] else -1))
                else:
                    scopes.append(_Scope("block", "", "", -1))
                    self.calls(head, start, path, scopes, found, line)
            elif m.group() == "}":
                self.calls(head, start, path, scopes, found, line)
                if scopes:
                    gone = scopes.pop()
                    if gone.start >= 0:
                        s = found.symbols[gone.start]
                        found.symbols[gone.start] = (*s[:4], line(m.start()), *s[5:])
            elif not declared:
                self.calls(head, start, path, scopes, found, line)
            start = m.end()
        return found

    def joined(self, names: list[str]) -> str:
        return "::".join(n for n in names if n)

    def shown_kind(self, kind: str, owner: str, scopes: list[_Scope], opens: bool) -> str:
        return kind

    def imports(self, text: str, clean: str, path: str, found: Found, line) -> None:
        """Adds the file's import edges."""

    def calls(self, text: str, start: int, path: str, scopes: list[_Scope], found: Found, line) -> None:
        own = next((s for s in reversed(scopes) if s.kind == "function"), None)
        if own is None:
            return
        caller = f"{path}:{own.parent}::{own.name}" if own.parent else f"{path}:{own.name}"
        for m in self.call.finditer(text):
            token = re.sub(r"\s", "", m.group(1))
            short = re.split(r"\.|->", token)[-1]
            if short.split("::")[-1] not in self.keywords:
                found.edge(caller, short, "calls", line(start + m.start(1)))


def _bases(text: str) -> list[str]:
    """Comma-separated names at the top level of angle brackets."""
    made, depth, held = [], 0, ""
    for c in text:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            made.append(held)
            held = ""
        else:
            held += c
    return [x.strip() for x in [*made, held] if x.strip()]


class CppPlugin(BracePlugin):
    language, extensions = "cpp", (".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx")

    def __init__(self, strip_macros: tuple[str, ...] = (), strip_with_args: tuple[str, ...] = ()):
        self.strip_macros, self.strip_with_args = strip_macros, strip_with_args

    def preprocess(self, text: str) -> str:
        """Blanks the named macros, some with their argument lists, keeping every offset and line."""
        for name in self.strip_macros:
            text = re.sub(rf"\b{re.escape(name)}\b", lambda m: " " * len(m.group()), text)
        for name in self.strip_with_args:
            clean = blank(text)
            for m in re.finditer(rf"\b{re.escape(name)}\b\s*\(", clean):
                end, depth = m.end(), 1
                while end < len(clean) and depth:
                    depth += (clean[end] == "(") - (clean[end] == ")")
                    end += 1
                if not depth:
                    text = text[: m.start()] + re.sub(r"[^\n]", " ", text[m.start() : end]) + text[end:]
        return text

    def imports(self, text, clean, path, found, line) -> None:
        for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*([\"<])([^\">\n]+)[\">]", text):
            found.edge(path, m.group(2), "includes", line(m.start(1)))

    def head(self, text, scopes, opens):
        text = re.sub(r"(?m)^\s*#.*$", "", text)
        text = re.sub(r"^(?:\s*(?:public|private|protected)\s*:)+", "", text).strip()
        if m := re.match(r"(?:inline\s+)?namespace\s*([\w:]*)$", text):
            return ("namespace", "", m.group(1), []) if opens else None
        body = re.sub(r"^template\s*<[^{}]*?>\s*(?=class|struct|enum|[\w:~])", "", text)
        if m := re.match(r"(?:typedef\s+)?(class|struct|enum(?:\s+class|\s+struct)?|union)\s+(?:[A-Z_]+\s+)*(\w+)\s*(?:final\s*)?(?::\s*([^{]*))?$", body):
            kind = m.group(1).split()[0]
            if not opens or kind == "union":
                return None
            bases = [] if kind == "enum" else [re.sub(r"<.*", "", re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", b)).strip() for b in _bases(m.group(3) or "")]
            return ("type", kind, m.group(2), bases)
        if not opens:
            if m := re.match(r"using\s+(\w+)\s*=", body):
                return ("alias", "typedef", m.group(1), [])
            if m := re.match(r"typedef\b.*?\(\s*\*\s*(\w+)\s*\)", body, re.S):
                return ("alias", "typedef", m.group(1), [])
            if m := re.match(r"typedef\b.*?(\w+)(?:\s*\[[^\]]*\])*$", body, re.S):
                return ("alias", "typedef", m.group(1), [])
            return None
        m = re.search(r"((?:\w+(?:<[^<>]*>)?::)*(?:~?\w+|operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+)))\s*\(", body)
        if m and not body.startswith(("if", "for", "while", "switch", "return", "else", "do")) and "=" not in body[: m.start()] and m.group(1).split("::")[-1] not in self.keywords:
            return ("function", "function", re.sub(r"<[^<>]*>", "", m.group(1)), [])
        return None

    def shown_kind(self, kind, owner, scopes, opens):
        return kind


class RustPlugin(BracePlugin):
    language, extensions = "rust", (".rs",)

    def imports(self, text, clean, path, found, line) -> None:
        for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+([^;]+)|extern\s+crate\s+(\w+)|mod\s+(\w+))\s*;", clean):
            for token in self.expand(re.sub(r"\s+", " ", m.group(1))) if m.group(1) else [m.group(2) or m.group(3)]:
                found.edge(path, token, "includes", line(m.start(1) if m.group(1) else m.start(2) if m.group(2) else m.start(3)))
            if m.group(3):  # the file of a module: its name, and the path that an attribute gives
                given = re.search(r"#\[\s*path\s*=\s*\"([^\"]+)\"\s*\]\s*(?:#\[[^\]]*\]\s*)*$", text[: m.start()].rstrip() + "\n")
                found.edge(path, f"{m.group(3)}={given.group(1)}" if given else m.group(3), "mod", line(m.start(3)))

    def expand(self, tree: str) -> list[str]:
        tree = tree.strip()
        if (at := tree.find("{")) >= 0:
            return [tree[:at] + x for part in _bases(tree[at + 1 : tree.rfind("}")].replace("{", "<").replace("}", ">")) for x in self.expand(part.replace("<", "{").replace(">", "}"))]
        return [re.sub(r"\s+as\s+\w+$", "", tree)]

    def head(self, text, scopes, opens):
        text = re.sub(r"#!?\[[^\]]*\]", "", text).strip()
        text = re.sub(r"^(?:pub(?:\([^)]*\))?|async|unsafe|const|default|extern(?:\s*\"[^\"]*\")?)\s+", "", text)
        while (shorter := re.sub(r"^(?:pub(?:\([^)]*\))?|async|unsafe|const|default|extern(?:\s*\"[^\"]*\")?)\s+", "", text)) != text:
            text = shorter
        if m := re.match(r"fn\s+(\w+)", text):
            return ("function", "function", m.group(1), [])
        if m := re.match(r"(struct|enum|trait|type)\s+(\w+)([^=]*)", text):
            kind = {"type": "typedef"}.get(m.group(1), m.group(1))
            if kind == "typedef" and any(s.kind == "type" for s in scopes):
                return None
            above = re.match(r"(?:<[^>]*>)?\s*:\s*(.*?)(?:\bwhere\b|$)", m.group(3), re.S) if kind == "trait" else None
            return ("type" if kind == "trait" else "alias", kind, m.group(2), [x.strip() for x in above.group(1).split("+") if x.strip() and not x.strip().startswith("'")] if above else [])
        if m := re.match(r"impl\b\s*(?:<[^{]*?>\s*)?(?:(.+?)\s+for\s+)?(.+?)(?:\s+where\b.*)?$", text, re.S):
            self.impl = (m.group(2).strip(), m.group(1))
            return ("type", "", m.group(2).strip(), []) if opens else None
        if m := re.match(r"mod\s+(\w+)$", text):
            return ("namespace", "", m.group(1), []) if opens else None
        return None

    def extract(self, text, path):
        found = super().extract(text, path)
        for m in re.finditer(r"(?m)^\s*(?:unsafe\s+)?impl\b\s*(?:<[^{>]*>\s*)?([\w:<>, ]+?)\s+for\s+([\w:<>, ]+?)\s*(?:where[^{]*)?\{", blank(text)):
            found.edge(m.group(2), m.group(1).split("::")[-1], "inherits", text.count("\n", 0, m.start(1)) + 1)
        return found


class GoPlugin(BracePlugin):
    language, extensions = "go", (".go",)

    def imports(self, text, clean, path, found, line) -> None:
        for m in re.finditer(r"(?m)^import\s*(?:\(([^)]*)\)|(?:\w+\s+)?\"([^\"]+)\")", text):
            for token in [m.group(2)] if m.group(2) else re.findall(r"\"([^\"]+)\"", m.group(1)):
                found.edge(path, token, "includes", line(m.start()))

    def head(self, text, scopes, opens):
        text = re.sub(r"^package\s+\w+", "", re.sub(r"\bimport\s*(?:\([^)]*\)|\"[^\"]*\")", "", text)).strip()
        if m := re.search(r"(?:^|\n)\s*func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", text):
            return ("function", "function", f"{m.group(1)}::{m.group(2)}" if m.group(1) else m.group(2), []) if opens else None
        if m := re.search(r"(?:^|\n)\s*type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)$", text):
            return ("block", m.group(2), m.group(1), []) if opens else None
        return None

    def extract(self, text, path):
        found = super().extract(text, path)
        package = re.search(r"(?m)^package\s+(\w+)", text)
        space = package.group(1) if package else ""
        clean = blank(text)
        for m in re.finditer(r"(?m)^type\s+(\w+)\s*(=?)\s*(?!struct\b|interface\b)([\w\[\]*.]+(?:\([^)]*\))?)[^\n{]*$", clean):
            found.symbol(m.group(1), "typedef", clean.count("\n", 0, m.start()) + 1, 0, 0, m.group().strip())
        found.symbols = [(*s[:6], space, s[7]) for s in found.symbols]
        return found


class CSharpPlugin(BracePlugin):
    language, extensions = "csharp", (".cs",)
    import_pattern = r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"
    types = r"(class|interface|struct|enum|record(?:\s+class|\s+struct)?)\s+(\w+)(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*(?::\s*(.*?))?(?:\bwhere\b.*)?$"

    def imports(self, text, clean, path, found, line) -> None:
        for m in re.finditer(self.import_pattern, clean):
            found.edge(path, m.group(1), "includes", line(m.start(1)))

    def joined(self, names):
        return ".".join(n for n in names if n)

    def head(self, text, scopes, opens):
        text = re.sub(r"^(?:\[[^\]]*\]\s*)+", "", text).strip()
        if m := re.match(r"namespace\s+([\w.]+)$", text):
            return ("namespace", "", m.group(1), [])
        if m := re.search(r"(?:^|\s)" + self.types, text, re.S):
            kind = "class" if m.group(1).startswith("record") else m.group(1)
            return ("type", kind, m.group(2), [] if kind == "enum" else [re.sub(r"\(.*", "", b).strip() for b in _bases(m.group(3) or "")])
        own = next((s for s in reversed(scopes) if s.kind in ("type", "function")), None)
        if own is not None and own.kind == "type" and (m := re.search(r"(?:^|[\s>\]?])(~?\w+)\s*(?:<[^>]*>)?\s*\(", text)) and "=" not in text[: m.start()] and m.group(1) not in self.keywords:
            return ("function", "function", m.group(1), [])
        return None


class JavaPlugin(CSharpPlugin):
    language, extensions = "java", (".java",)
    import_pattern = r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"
    types = r"(class|interface|enum|record|@interface)\s+(\w+)(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*((?:extends|implements|permits)\b.*)?$"

    def head(self, text, scopes, opens):
        text = re.sub(r"@\w+(?:\([^)]*\))?\s*(?!interface)", "", text).strip()
        if m := re.search(r"(?:^|\s)" + self.types, text, re.S):
            kind = {"record": "class", "@interface": "interface"}.get(m.group(1), m.group(1))
            above = re.sub(r"\bpermits\b.*", "", m.group(3) or "", flags=re.S)
            return ("type", kind, m.group(2), [b for part in re.split(r"\b(?:extends|implements)\b", above) for b in _bases(part)]) if opens else None
        found = super().head(text, scopes, opens)
        return found if opens and found and found[0] == "function" else None

    def joined(self, names):
        return ""


def default_registry(strip_macros: tuple[str, ...] = (), strip_with_args: tuple[str, ...] = (), extensions: dict[str, str] | None = None) -> Registry:
    """The six languages; ``extensions`` gives further extensions to languages, or takes them from others."""
    plugins = [CppPlugin(strip_macros, strip_with_args), RustPlugin(), GoPlugin(), PythonPlugin(), CSharpPlugin(), JavaPlugin()]
    made = Registry(plugins)
    made.by_extension |= {e: p for e, language in (extensions or {}).items() for p in plugins if p.language == language}
    return made
