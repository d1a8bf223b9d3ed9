"""Symbols and raw references of source files: one Python function per language inside mapInPandas.

Python files go through the standard library's syntax tree. Rust and TypeScript files are scanned:
strings and comments are blanked first, so that braces match and words are code; then declarations
are recognised by their keywords and their extent by the braces.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "path string, name string, kind string, visibility string, line_start long, line_end long, signature string, doc_comment string, body string, attributes string, impl_type string, is_test int"
RAW_REFS = "path string, source string, source_impl string, target string, target_context string, target_file string, kind string, ref_line long"
_NAMES = [c.split()[0] for c in SYMBOLS.split(", ")]
_REFS = [c.split()[0] for c in RAW_REFS.split(", ")]

_LEX = {
    "rs": r'//[^\n]*|/\*.*?\*/|b?r#*".*?"#*|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\]|\\.)\'',
    "ts": r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`',
}


def blank(text: str, language: str) -> str:
    """Comments and string contents replaced by blanks, line feeds kept."""
    return re.sub(_LEX[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _extent(code: str, at: int) -> int:
    """End of a declaration that begins at `at`: its matching brace, or the first semicolon before one."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c == ";" and not depth:
            return i + 1
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
    return len(code)


def _rows(text: str, start: int, end: int) -> tuple[int, int]:
    return text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1


def _head(text: str) -> str:
    return re.sub(r"\s+", " ", re.split(r"[{;]", text, maxsplit=1)[0]).strip()


def _above(lines: list[str], row: int, doc: str, attribute: str) -> tuple[str | None, list[str]]:
    """Doc comment lines and attributes right above a 1-based row."""
    docs, attributes = [], []
    for line in reversed(lines[: row - 1]):
        bare = line.strip()
        if bare.startswith(doc):
            docs.append(bare[len(doc) :].strip())
        elif re.match(attribute, bare):
            attributes.append(re.sub(r"^#\[|\]$|^@", "", bare))
        else:
            break
    return "\n".join(reversed(docs)) or None, attributes[::-1]


_RUST = re.compile(r"^[ \t]*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+(?=fn|unsafe|async|extern)|extern\s+(?:\"[^\"]*\"|\s*)\s*(?=fn))*(?P<key>fn|struct|enum|trait|impl|mod|const|static|type|union|use|macro_rules!)\b\s*(?P<rest>[^\n]*)", re.M)
_RUST_KINDS = {"fn": "function", "type": "type_alias", "macro_rules!": "macro"}


def rust_visibility(vis: str | None) -> str:
    vis = (vis or "").strip()
    if not vis:
        return "private"
    if vis == "pub":
        return "public"
    return "pub(crate)" if vis == "pub(crate)" else "restricted"


def rust_symbols(path: str, text: str) -> list[dict]:
    code, lines, out = blank(text, "rs"), text.split("\n"), []
    impls: list[tuple[int, int, str]] = []
    traits: list[tuple[int, int]] = []
    bodies: list[tuple[int, int]] = []
    for m in _RUST.finditer(code):
        start, key = m.start("vis") if m["vis"] else m.start("key"), m["key"]
        if any(a < start < b for a, b in traits + bodies):
            continue
        end = _extent(code, m.start("key"))
        rest = text[m.start("rest") : m.end("rest")].strip()
        if key == "impl":
            head = _head(text[m.start("key") : end])
            name = re.sub(r"^impl\s*(<.*?>\s*(?=\w))?", "", head).split(" where ")[0].strip()
            type_name = re.sub(r"<.*", "", name.rpartition(" for ")[2]).strip()
            impls.append((start, end, type_name))
        elif key == "use":
            name = rest.rstrip(";").strip()
        else:
            found = re.match(r"(?:mut\s+)?([A-Za-z_][A-Za-z0-9_]*)", rest)
            if not found:
                continue
            name = found[1]
        if key == "trait":
            traits.append((start, end))
        if key == "fn":
            bodies.append((start, end))
        owner = next((t for a, b, t in impls if a < start < b), None) if key == "fn" else None
        first, last = _rows(text, start, end)
        doc, attributes = _above(lines, first, "///", r"#\[")
        tested = any(re.match(r"(test|.*::test|rstest|test_case)\b", a) for a in attributes)
        out.append(dict(zip(_NAMES, (path, name, _RUST_KINDS.get(key, key), rust_visibility(m["vis"]), first, last, _head(text[start:end]), doc, text[start:end], ", ".join(attributes) or None, owner, int(tested)), strict=True)))
        if key == "enum":
            inside = code[code.find("{", start) + 1 : end - 1]
            at = code.find("{", start) + 1
            depth = 0
            for v in re.finditer(r"[{}()\[\]]|#\[[^\]]*\]|[A-Za-z_]\w*", inside):
                if v[0] in "{([":
                    depth += 1
                elif v[0] in "})]":
                    depth -= 1
                elif not depth and v[0][0].isupper() and re.search(r"(^|[,\]}])\s*$", inside[: v.start()]):
                    row = _rows(text, at + v.start(), at + v.end())[0]
                    out.append(dict(zip(_NAMES, (path, v[0], "enum_variant", rust_visibility(m["vis"]), row, row, v[0], None, None, None, name, 0), strict=True)))
    return out


def rust_impls(symbols: list[dict]) -> list[dict]:
    """(type_name, trait_name, path, line_start, line_end) from impl blocks and derives."""
    out = []
    for s in symbols:
        if s["kind"] == "impl" and " for " in s["name"]:
            trait, _, type_name = s["name"].rpartition(" for ")
            out.append((re.sub(r"<.*", "", type_name).strip(), re.sub(r"<.*", "", trait).strip(), s["path"], s["line_start"], s["line_end"]))
        for group in re.findall(r"derive\(([^)]*)\)", s["attributes"] or ""):
            for d in filter(None, (x.strip().rpartition("::")[2] for x in group.split(","))):
                out += [(s["name"], t, s["path"], s["line_start"], s["line_end"]) for t in (("Error", "Display") if d == "Error" else (d,))]
    return [dict(zip(("type_name", "trait_name", "path", "line_start", "line_end"), x, strict=True)) for x in out]


_TS = re.compile(r"^[ \t]*(?P<exp>export\s+(?:default\s+)?)?(?:declare\s+|abstract\s+|async\s+)*(?P<key>function\*?|class|interface|type|enum|const|let|var|namespace|import)\b\s*(?P<rest>[^\n]*)", re.M)
_TS_METHOD = re.compile(r"^[ \t]+(?P<mod>(?:public|private|protected|static|async|readonly|override)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;{]*\)[^;{\n]*\{", re.M)
_TS_KINDS = {"function": "function", "function*": "function", "type": "type_alias", "namespace": "mod", "import": "use"}


def ts_symbols(path: str, text: str) -> list[dict]:
    code, lines, out = blank(text, "ts"), text.split("\n"), []
    is_test = int(bool(re.search(r"\.(test|spec)\.[jt]sx?$|(^|/)__tests__/", path)))
    inner: list[tuple[int, int]] = []

    def add(name: str, kind: str, vis: str, start: int, end: int, owner: str | None) -> None:
        first, last = _rows(text, start, end)
        doc, attributes = _above(lines, first, "*", r"@")
        out.append(dict(zip(_NAMES, (path, name, kind, vis, first, last, _head(text[start:end]), doc, text[start:end], ", ".join(attributes) or None, owner, is_test), strict=True)))

    for m in _TS.finditer(code):
        start, key = m.start() + len(m[0]) - len(m[0].lstrip()), m["key"]
        if any(a < start < b for a, b in inner):
            continue
        rest = text[m.start("rest") : m.end("rest")]
        if key == "import":
            end = code.find("\n", m.start())
            end = len(code) if end < 0 else end
            add(rest.strip().rstrip(";"), "use", "private", start, end, None)
            continue
        found = re.match(r"([A-Za-z_$][\w$]*)", rest)
        if not found:
            continue
        end = _extent(code, m.start("key"))
        kind = _TS_KINDS.get(key, key)
        if key in ("const", "let", "var"):
            kind = "function" if "=>" in code[m.start("key") : end].split("{")[0] else "const" if key == "const" else "static"
        add(found[1], kind, "public" if m["exp"] else "private", start, end, None)
        if key in ("function", "function*", "class", "const", "enum", "interface"):
            inner.append((start, end))
        if key == "class":
            for v in _TS_METHOD.finditer(code, start, end):
                if v["name"] in ("if", "for", "while", "switch", "catch", "function", "return"):
                    continue
                at = v.start("mod") if v["mod"] else v.start("name")
                vis = "private" if "private" in v[0] else "restricted" if "protected" in v[0] else "public" if m["exp"] else "private"
                add(v["name"], "function", vis, at, _extent(code, at), found[1])
        if key == "enum":
            at = code.find("{", start)
            for v in re.finditer(r"([A-Za-z_$][\w$]*)\s*(?:=[^,}]*)?[,}]", code[at:end]):
                add(v[1], "enum_variant", "public" if m["exp"] else "private", at + v.start(), at + v.end(), found[1])
    return out


def py_symbols(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return []
    lines, out = text.split("\n"), []
    file_is_test = bool(re.search(r"(^|/)(tests?/|test_[^/]*\.py$|[^/]*_test\.py$)", path))

    def add(node: ast.AST, name: str, kind: str, owner: str | None, first: int | None = None) -> None:
        first = first or node.lineno
        body = "\n".join(lines[first - 1 : node.end_lineno])
        decorators = [ast.unparse(d) for d in getattr(node, "decorator_list", [])]
        vis = "private" if name.startswith("_") and not name.startswith("__") else "public"
        doc = ast.get_docstring(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        tested = kind == "function" and (file_is_test and name.startswith("test_") or any("pytest.mark" in d for d in decorators))
        head = re.sub(r"\s+", " ", "\n".join(lines[node.lineno - 1 : node.end_lineno]).split(":\n")[0]).strip()
        out.append(dict(zip(_NAMES, (path, name, kind, vis, first, node.end_lineno, head, doc, body, ", ".join(decorators) or None, owner, int(tested)), strict=True)))

    def visit(nodes: list[ast.stmt], owner: str | None, variants: bool) -> None:
        for n in nodes:
            first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                add(n, n.name, "function", owner, first)
            elif isinstance(n, ast.ClassDef):
                is_enum = any(ast.unparse(b).rpartition(".")[2] in ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag") for b in n.bases)
                add(n, n.name, "enum" if is_enum else "class", owner, first)
                visit(n.body, n.name, is_enum)
            elif isinstance(n, (ast.Import, ast.ImportFrom)) and owner is None:
                add(n, ast.unparse(n), "use", None)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and (variants or owner is None):
                        add(n, t.id, "enum_variant" if variants else "const", owner)
            elif hasattr(ast, "TypeAlias") and isinstance(n, ast.TypeAlias):
                add(n, n.name.id, "type_alias", owner)

    visit(tree.body, None, False)
    return out


def py_refs(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return []
    out = []

    def walk(node: ast.AST, owner: str | None, function: str, seen: set) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    name, ctx = f.id, None
                elif isinstance(f, ast.Attribute):
                    base = f.value.id if isinstance(f.value, ast.Name) else None
                    name, ctx = f.attr, owner if base in ("self", "cls") else base if base and base[:1].isupper() else None
                else:
                    continue
                if (ctx, name) not in seen and name != function:
                    seen.add((ctx, name))
                    out.append(dict(zip(_REFS, (path, function, owner, name, ctx, path, "call", n.lineno), strict=True)))
        for a in [*node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None:
                for t in re.findall(r"[A-Z]\w*", ast.unparse(a.annotation)):
                    out.append(dict(zip(_REFS, (path, function, owner, t, None, path, "type_ref", a.lineno), strict=True)))

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            walk(n, None, n.name, set())
        elif isinstance(n, ast.ClassDef):
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    walk(m, n.name, m.name, set())
    return out


def scanned_refs(path: str, text: str, symbols: list[dict], language: str) -> list[dict]:
    """Calls and capitalised type words of function bodies, first occurrence per function."""
    out = []
    for s in symbols:
        if s["kind"] != "function" or not s["body"]:
            continue
        code, seen = blank(s["body"], language), set()
        for m in re.finditer(r"(?:(?P<ctx>[A-Za-z_]\w*)\s*(?:::|\.)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?P<call>!?\()?", code):
            name, ctx = m["name"], m["ctx"]
            kind = "call" if m["call"] == "(" else "type_ref" if name[0].isupper() else None
            if kind is None or name == s["name"]:
                continue
            ctx = s["impl_type"] if ctx in ("self", "this", "Self") else ctx if ctx and ctx[0].isupper() else None
            if (ctx, name) in seen:
                continue
            seen.add((ctx, name))
            out.append(dict(zip(_REFS, (path, s["name"], s["impl_type"], name, ctx, path, kind, s["line_start"] + code.count("\n", 0, m.start())), strict=True)))
    return out


def file_symbols(path: str, text: str) -> list[dict]:
    if path.endswith(".py"):
        return py_symbols(path, text)
    return rust_symbols(path, text) if path.endswith(".rs") else ts_symbols(path, text)


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, content) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [s for p, t in zip(b["path"], b["content"], strict=True) for s in file_symbols(p, t or "")]
            yield pd.DataFrame(rows, columns=_NAMES)

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def extract_refs(files: DataFrame) -> DataFrame:
    """Raw references of (path, content) rows, before they are resolved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["content"], strict=True):
                t = t or ""
                rows += py_refs(p, t) if p.endswith(".py") else scanned_refs(p, t, file_symbols(p, t), "rs" if p.endswith(".rs") else "ts")
            yield pd.DataFrame(rows, columns=_REFS)

    return files.select("path", "content").mapInPandas(run, RAW_REFS)


def with_ids(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("id", F.xxhash64("path", "name", "kind", "line_start", F.coalesce("impl_type", F.lit(""))))


def resolve_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges by tiers: (name, type), (name, file), (name, x.rs or x/mod.rs) are sure, the name alone is not.

    The first symbol of a key (by path and line) stands for it; edges without both ends are dropped.
    """
    known = symbols.where(~F.col("kind").isin("use", "mod"))
    first = F.min(F.struct("path", "line_start", "id")).getField("id")
    by_impl = known.where("impl_type IS NOT NULL").groupBy(F.col("name").alias("target"), F.col("impl_type").alias("target_context")).agg(first.alias("id1"))
    by_file = known.groupBy("name", "path").agg(first.alias("fid"))
    by_name = known.groupBy("name").agg(first.alias("nid"))
    other = F.when(F.endswith("target_file", F.lit("/mod.rs")), F.regexp_replace("target_file", "/mod\\.rs$", ".rs")).otherwise(F.regexp_replace("target_file", "\\.rs$", "/mod.rs"))
    rows = refs.join(by_impl, ["target", "target_context"], "left")
    rows = rows.join(by_file.toDF("target", "target_file", "id2"), ["target", "target_file"], "left").withColumn("other", other)
    rows = rows.join(by_file.toDF("target", "other", "id3"), ["target", "other"], "left").join(by_name.toDF("target", "id4"), "target", "left")
    rows = rows.join(by_file.toDF("source", "path", "s1"), ["source", "path"], "left").join(by_name.toDF("source", "s2"), "source", "left")
    sure = F.coalesce("id1", "id2", "id3")
    out = rows.select(F.coalesce("s1", "s2").alias("source_symbol_id"), F.coalesce(sure, F.col("id4")).alias("target_symbol_id"), "kind", F.when(sure.isNotNull(), "high").otherwise("low").alias("confidence"), "ref_line")
    return out.where("source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, file) of relative imports (path, module): first of the extensions, then index files."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    joined = F.concat(folder, F.col("module"))
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin(".", ""), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    tails = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ""]
    tried = imports.where(F.startswith("module", F.lit("."))).withColumn("stem", F.array_join(parts, "/")).select("path", "module", "stem", F.posexplode(F.array(*[F.lit(t) for t in tails])).alias("rank", "tail"))
    hit = tried.withColumn("file", F.concat("stem", "tail")).join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return hit.groupBy("path", "module").agg(F.min_by("file", "rank").alias("file"))
