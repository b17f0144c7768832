"""Chunks of files, as a table function's rows, and what is read out of source code.

Character windows are closed-form column expressions.  Markdown and Python need a
reader, so they go through an Arrow map; languages without a reader here fall
back to windows and say so in ``mode``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.shipping import ship

SIZE, OVERLAP = 1200, 120
STEP = SIZE - OVERLAP
CHUNK = "path string, ordinal int, text string, start_line int, end_line int, heading_path array<string>, mode string"
DECLARATION = "path string, ordinal int, name string, kind string, start_line int, end_line int"
CONTAINER = "path string, container string"
RELATION = "path string, kind string, name string, receiver string, receiver_type string, construction boolean, line int"


def window_chunks(df: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Overlapping windows as columns only.  A window ends at a newline when one
    stands at or behind the next window's start, so no text falls between two.

    A text is first cut into blocks of one step, in one pass, so a long text costs
    in proportion to its length; windows and line numbers come from the blocks.
    """
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    n = F.length(text)
    cut = df.where(n > 0).select(
        F.col(path).alias("path"),
        n.alias("n"),
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STEP}}}"), F.lit(0)).alias("blocks"),
    )
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("at"))
    run = F.aggregate(
        F.transform("blocks", lines), start, lambda a, x: F.struct((a["line"] + x).alias("line"), F.array_append(a["at"], a["line"]).alias("at")), lambda a: a["at"]
    )
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - SIZE) / F.lit(STEP))).cast("int")
    window = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("ordinal"),
            F.concat(F.get("blocks", i), F.coalesce(F.left(F.get("blocks", i + 1), F.lit(OVERLAP)), F.lit(""))).alias("window"),
            F.get("starts", i).alias("start_line"),
        ),
    )
    at = cut.withColumn("starts", run).select("path", "n", F.inline(window))
    tail = F.substring("window", STEP + 1, F.lit(OVERLAP))
    newline = F.length(tail) - F.instr(F.reverse(tail), "\n")
    full = F.col("ordinal") * STEP + SIZE < F.col("n")
    body = F.when(full & (F.instr(tail, "\n") > 0), F.left("window", F.lit(STEP) + newline)).otherwise(F.col("window"))
    out = at.select("path", "ordinal", body.alias("text"), "start_line", F.lit("CHARACTER").alias("mode"))
    return out.where(F.col("text").rlike(r"\S")).withColumn("end_line", (F.col("start_line") + lines(F.col("text"))).cast("int"))


@dataclass
class Piece:
    text: str
    start: int
    end: int
    headings: list[str]
    mode: str


def windows(text: str, first_line: int = 1) -> list[Piece]:
    """``window_chunks`` of one text."""
    out, at = [], 0
    while True:
        end = min(len(text), at + SIZE)
        if end < len(text):
            newline = text.rfind("\n", at + STEP, end)
            end = newline if newline >= 0 else end
        body = text[at:end]
        if body.strip():
            start = first_line + text.count("\n", 0, at)
            out.append(Piece(body, start, start + body.count("\n"), [], "CHARACTER"))
        if at + SIZE >= len(text):
            return out
        at += STEP


def markdown(text: str) -> list[Piece]:
    """One piece a section; headings inside fences don't count; long sections are windowed."""
    lines = text.split("\n")
    sections: list[tuple[int, list[tuple[int, str]]]] = [(0, [])]
    fenced, chain = False, []
    for i, line in enumerate(lines):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*)$", line)
        if m:
            chain = [h for h in chain if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            sections.append((i, chain))
    out = []
    for (begin, chain), (end, _) in zip(sections, [*sections[1:], (len(lines), [])], strict=True):
        body, titles = "\n".join(lines[begin:end]), [t for _, t in chain]
        if not body.strip():
            continue
        if len(body) <= SIZE:
            out.append(Piece(body, begin + 1, end, titles, "MARKDOWN_HEADING"))
        else:
            out += [Piece(p.text, p.start, p.end, titles, "MARKDOWN_HEADING_SPLIT") for p in windows(body, begin + 1)]
    return out


def _definitions(source: str) -> list[tuple[str, str, int, int]]:
    """(qualified name, kind, first line, last line) of Python declarations; the first of a name counts."""
    found: dict[str, tuple[str, str, int, int]] = {}

    def visit(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{x.name}" if owner else x.name
                kind = "class_definition" if isinstance(x, ast.ClassDef) else "function_definition"
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                found.setdefault(name, (name, kind, first, x.end_lineno or x.lineno))
                visit(x, name)
            elif not owner and isinstance(x, ast.Assign):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        found.setdefault(t.id, (t.id, "variable", x.lineno, x.end_lineno or x.lineno))
            elif isinstance(x, ast.If | ast.Try | ast.With):
                visit(x, owner)

    visit(ast.parse(source), "")
    return list(found.values())


#: How declarations look in languages with braces, for the fallback reader.
_BRACED = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|sealed|override|open|pub(?:\([a-z]+\))?)\s+)*"
    r"(class|interface|struct|enum|trait|record|object|function|func|fun|fn|def)\s+([A-Za-z_$][\w$]*)",
    re.M,
)
READERS = {"py": "python", "pyi": "python"}
BRACED = frozenset("ts tsx js jsx mjs cjs go rs java cs kt scala swift dart php".split())


def declarations(path: str, source: str) -> list[tuple[str, str, int, int]]:
    ending = path.rpartition(".")[2].lower()
    if ending in READERS:
        try:
            return _definitions(source)
        except (SyntaxError, ValueError):
            return []
    if ending in ENDED:
        return _ended(source)
    if ending == "vue":
        script, before = _script_of(source)
        return [(n, k, a + before, b + before) for n, k, a, b in declarations("x.ts", script)]
    if ending not in BRACED:
        return []
    return _braced(_bare(source))


#: Words before a parenthesis that call nothing.
NO_CALL = frozenset(
    "if for foreach while switch catch return new throw function func fun fn def sizeof typeof await in of do else match when using lock super this "
    "constructor synchronized assert delete void instanceof yield elif and or not import require".split()
)
_QUOTED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TYPES = frozenset("class interface struct enum trait record object".split())
_METHOD = re.compile(
    r"^[ \t]+(?:(?:public|private|protected|internal|static|final|abstract|async|override|readonly|virtual|suspend|open|get|set)\s+)*"
    r"(?:[A-Za-z_$][\w$<>\[\],.?]*\s+)?([A-Za-z_$#][\w$]*)\s*(?:<[^>\n(]*>)?\(([^;{}()]*)\)\s*(?::\s*[^{};=\n]+|throws\s+[\w., ]+)?\s*\{",
    re.M,
)
_OF_TYPE = re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)[^)\n]*\)\s*([A-Za-z_]\w*)\s*\(", re.M)


def _bare(source: str) -> str:
    """The source with comments and strings blanked, at their places and lines."""
    return _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _braced(source: str) -> list[tuple[str, str, int, int]]:
    """Declarations of a source with braces: types and functions, and methods by their type."""
    out: dict[str, tuple[str, str, int, int]] = {}

    def line(at: int) -> int:
        return source.count("\n", 0, at) + 1

    for m in _BRACED.finditer(source):
        out.setdefault(m[2], (m[2], f"{m[1]}_declaration", line(m.start(2)), line(_block_end(source, m.end()))))
    for m in re.finditer(r"^type\s+([A-Za-z_]\w*)\s+(struct|interface)\b", source, re.M):
        out.setdefault(m[1], (m[1], f"{m[2]}_declaration", line(m.start(1)), line(_block_end(source, m.end()))))
    types = [x for x in out.values() if x[1].partition("_")[0] in _TYPES]
    for m in _OF_TYPE.finditer(source):
        name = f"{m[1]}.{m[2]}"
        out.setdefault(name, (name, "method_declaration", line(m.start(2)), line(_block_end(source, m.end()))))
    for m in _METHOD.finditer(source):
        at = line(m.start(1))
        around = [x for x in types if x[2] < at <= x[3]]
        if m[1] not in NO_CALL and around:
            owner = min(around, key=lambda x: x[3] - x[2])[0]
            name = f"{owner}.{m[1]}"
            out.setdefault(name, (name, "method_declaration", at, line(_block_end(source, m.end() - 1))))
    return list(out.values())


_CALL = re.compile(r"(?:\b(new)\s+)?(?:([A-Za-z_$][\w$]*)\s*(?:\?\.|\.|::|->)\s*)?(?<![\w$])([A-Za-z_$][\w$]*)\s*(?:<[\w$, .\[\]]*>)?\(")
_DECLARES = re.compile(r"(?:\b(?:function|func|fun|fn|def|class)\b\s*\*?|\bfunc\s*\([^)\n]*\))\s*$")
_HERITAGE = re.compile(r"\b(?:class|interface|record|struct|trait|object)\s+([A-Za-z_$][\w$]*)(?:<[^>{\n]*>)?(?:\([^)\n]*\))?\s*((?::|extends\b|implements\b|with\b)[^{;\n]*)")
_BINDINGS = (
    re.compile(r"\b(?:const|let|var|val|auto)\s+\$?([A-Za-z_]\w*)\s*(?::\s*[\w<>\[\]. ]+)?=\s*(?:new\s+|&)?([A-Z]\w*)\s*(?:<[^>\n]*>)?[({]"),
    re.compile(r"\b([A-Za-z_]\w*)\s*:=\s*&?([A-Z]\w*)\s*[{(]"),
    re.compile(r"\b([a-z_]\w*)\s*\??:\s*([A-Z]\w*)\b"),
    re.compile(r"\b(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?\s+(?P<name>[a-z_]\w*)\s*(?=[=;,)])"),
    re.compile(r"[(,]\s*(?P<name>[a-z_]\w*)\s+\*?(?P<type>[A-Z]\w*)\s*(?=[,)])"),
)


def _braced_relations(source: str) -> list[tuple[str, str, str | None, str | None, bool, int]]:
    """Calls and heritage of a source with braces, by pattern."""
    bare = _bare(source)
    own = {n.rpartition(".")[2] for n, k, _, _ in _braced(bare) if k == "method_declaration"}
    headers = {m.start(1) for m in _METHOD.finditer(bare)}
    types: dict[str, set[str]] = {}
    for pattern in _BINDINGS:
        for m in pattern.finditer(bare):
            name, kind = (m["name"], m["type"]) if "name" in pattern.groupindex else (m[1], m[2])
            types.setdefault(name, set()).add(kind)
    out: list[tuple[str, str, str | None, str | None, bool, int]] = []
    for m in _CALL.finditer(bare):
        name, receiver = m[3], m[2] if m[2] not in ("this", "self", "super") else None
        if name in NO_CALL or _DECLARES.search(bare, max(0, m.start() - 80), m.start()) or m.start(3) in headers and name in own:
            continue
        known = types.get(receiver or "", set())
        kind = next(iter(known)) if len(known) == 1 else None
        out.append(("call", name, receiver, kind, bool(m[1]), bare.count("\n", 0, m.start(3)) + 1))
    for m in _HERITAGE.finditer(bare):
        line = bare.count("\n", 0, m.start(1)) + 1
        for part in re.split(r",|\bextends\b|\bimplements\b|\bwith\b|:", re.sub(r"<[^<>]*>|\([^()]*\)", "", m[2])):
            base = re.match(r"\s*(?:\w+\.)*([A-Za-z_$][\w$]*)", part)
            if base and base[1] not in ("public", "private", "protected", "where"):
                out.append(("inherits", base[1], m[1], None, False, line))
    return out


#: How declarations look in languages whose blocks end with a word.
_ENDED = re.compile(r"^([ \t]*)(?:local\s+)?(class|module|defmodule|defp|def|function)\s+([A-Za-z_][\w.:!?]*)", re.M)
ENDED = frozenset("rb rake lua ex exs".split())


def _ended(source: str) -> list[tuple[str, str, int, int]]:
    """Declarations up to the "end" of the same indentation."""
    lines, out = source.split("\n"), {}
    for m in _ENDED.finditer(source):
        first = source.count("\n", 0, m.start(2)) + 1
        stop = re.compile(rf"{re.escape(m[1])}end\b")
        last = next((i for i in range(first, len(lines)) if stop.match(lines[i])), first - 1) + 1
        out.setdefault(m[3], (m[3], f"{m[2]}_declaration", first, last))
    return list(out.values())


def _script_of(source: str) -> tuple[str, int]:
    """The script of a single-file component, and the lines before it."""
    m = re.search(r"<script\b[^>]*>(.*?)</script\s*>", source, re.S | re.I)
    return (m[1], source.count("\n", 0, m.start(1))) if m else ("", 0)


#: How imports and containers are written, by the ending of the file.
_IMPORTS = {
    "js": r"""(?:from|import|require\()\s*["']([^"'\n]+)["']""",
    "c": r"""^\s*#\s*(?:include|import)\s*["<]([^">\n]+)[">]""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "cs": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "php": r"^\s*use\s+([\w\\\\]+)",
    "rs": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""",
    "rb": r"""^\s*require(?:_relative)?\s*\(?["']([^"'\n]+)["']""",
    "lua": r"""require\s*\(?\s*["']([^"'\n]+)["']""",
}
_CONTAINER = re.compile(r"^\s*(?:package|namespace|module)\s+([\w.\\]+)", re.M)
_SAME = {
    "ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "cjs": "js", "vue": "js", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "m": "c", "mm": "c",
    "kt": "java", "scala": "java", "swift": "java", "dart": "js",
}


def imports_of(path: str, source: str) -> list[tuple[str, int]]:
    """(module, line) of each import that a pattern finds."""
    ending = path.rpartition(".")[2].lower()
    pattern = _IMPORTS.get(_SAME.get(ending, ending))
    return [(m[1], source.count("\n", 0, m.start(1)) + 1) for m in re.finditer(pattern, source, re.M)] if pattern else []


def container_of(path: str, source: str) -> str | None:
    """The package or namespace that a file declares."""
    if path.rpartition(".")[2].lower() not in ("java", "kt", "scala", "cs", "php", "go", "ex"):
        return None
    m = _CONTAINER.search(source)
    return m[1].replace("\\", ".") if m else None


def _block_end(source: str, at: int) -> int:
    """Where the braces that open behind a declaration close; its line's end if none do."""
    line = source.find("\n", at)
    line = len(source) if line < 0 else line
    depth = 0
    for m in re.compile(r"[{}]").finditer(source, at):
        if not depth and m.start() > line + 200:
            break
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            return m.start()
    return line


def relations(path: str, source: str) -> list[tuple[str, str, str | None, str | None, bool, int]]:
    """(kind, name, receiver, receiver type, construction, line): calls, imports and heritage,
    exact for Python and by pattern for languages with braces; of others, imports only."""
    ending = path.rpartition(".")[2].lower()
    if ending not in READERS:
        found = [("import", m, None, None, False, line) for m, line in imports_of(path, source)]
        if ending == "vue":
            script, before = _script_of(source)
            found += [(*r[:5], r[5] + before) for r in _braced_relations(script)]
        elif ending in BRACED:
            found += _braced_relations(source)
        return sorted(found, key=lambda r: (r[5], r[0], r[1]))
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    types: dict[str, set[str]] = {}
    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Name):
            for t in x.targets:
                if isinstance(t, ast.Name) and x.value.func.id[:1].isupper():
                    types.setdefault(t.id, set()).add(x.value.func.id)
        elif isinstance(x, ast.arg | ast.AnnAssign) and isinstance(x.annotation, ast.Name):
            name = x.arg if isinstance(x, ast.arg) else x.target.id if isinstance(x.target, ast.Name) else None
            if name:
                types.setdefault(name, set()).add(x.annotation.id)
    for x in ast.walk(tree):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
            out.append(("call", x.func.id, None, None, x.func.id[:1].isupper(), x.lineno))
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute):
            receiver = x.func.value.id if isinstance(x.func.value, ast.Name) else None
            known = types.get(receiver or "", set())
            out.append(("call", x.func.attr, receiver, next(iter(known)) if len(known) == 1 else None, False, x.lineno))
        elif isinstance(x, ast.Import):
            out += [("import", a.name, None, None, False, x.lineno) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out.append(("import", "." * x.level + (x.module or ""), None, None, False, x.lineno))
        elif isinstance(x, ast.ClassDef):
            out += [("inherits", b.id, x.name, None, False, x.lineno) for b in x.bases if isinstance(b, ast.Name)]
    return sorted(out, key=lambda r: (r[5], r[0], r[1]))


def pieces(path: str, text: str) -> list[Piece]:
    """Chunks of one file: whole, by heading, by declaration, or windows."""
    if len(text) <= SIZE:
        return [Piece(text, 1, text.count("\n") + 1, [], "WHOLE")] if text.strip() else []
    ending = path.rpartition(".")[2].lower()
    if ending in ("md", "markdown", "mdx"):
        return markdown(text)
    top = [x for x in declarations(path, text) if "." not in x[0] and x[1] != "variable"]
    if not top:
        return windows(text)
    lines, out, at = text.split("\n"), [], 0
    for _, _, first, last in sorted(top, key=lambda x: x[2]):
        if first - 1 < at:
            continue
        begin = first - 1
        while begin > at and re.match(r"\s*(#|//|/?\*)", lines[begin - 1]):  # comments travel with what follows
            begin -= 1
        for s, e, mode in ((at, begin, "AST_FILLER"), (begin, last, "AST")):
            body = "\n".join(lines[s:e])
            if body.strip():
                out += [Piece(p.text, p.start, p.end, [], mode) for p in windows(body, s + 1)]
        at = last
    body = "\n".join(lines[at:])
    return out + ([Piece(p.text, p.start, p.end, [], "AST_FILLER") for p in windows(body, at + 1)] if body.strip() else [])


def _mapped(files: DataFrame, rows_of, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                rows = [r for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for r in rows_of(p, t)]
                columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, kind)


def chunk_files(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, t: [(p, i, c.text, c.start, c.end, c.headings, c.mode) for i, c in enumerate(pieces(p, t))], CHUNK)


def declaration_rows(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, t: [(p, i, *d) for i, d in enumerate(declarations(p, t))], DECLARATION)


def container_rows(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, t: [(p, container_of(p, t))], CONTAINER)


def relation_rows(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, t: [(p, *r) for r in relations(p, t)], RELATION)


def symbols_of(declared: DataFrame) -> DataFrame:
    """Symbol rows; of overloads, the first in the file."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("path", "name").orderBy("ordinal"))
    return declared.withColumn("k", first).where("k = 1").select(
        F.concat(F.lit("Symbol:"), "path", F.lit(":"), "name").alias("id"),
        F.element_at(F.split("name", r"\."), -1).alias("name"),
        F.col("path").alias("file_path"),
        "kind",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
    )


#: Words that tell a decision, and words that tell what it rejected (on folded text).
CHOSE = (
    r"(?i)(?<![A-Za-z0-9_])(?:chose|chosen|choosing|decided|decision|deliberate|deliberately|intentionally|settled on|went with|on purpose)(?![A-Za-z0-9_])"
    r"|quyet dinh|chot|co y|chu y"
)
REJECTED = (
    r"(?i)(?<![A-Za-z0-9_])(?:instead of|rather than|as opposed to|in preference to|dropped|rejected|avoided|abandoned|ruled out|would have)(?![A-Za-z0-9_])"
    r"|thay vi|thay cho|da bo|loai bo|khong dung|dang le"
)


def decision_excerpts(chunks: DataFrame, key: str = "id", text: str = "folded") -> DataFrame:
    """(key, excerpt) of texts that name a choice and what it rejected; text is folded."""
    flat = lambda s: F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(160))
    sentences = F.split(text, r"(?<=[.!?])\s+|\n{2,}")
    one = F.filter(sentences, lambda s: s.rlike(CHOSE) & s.rlike(REJECTED))
    other = F.filter(sentences, lambda s: s.rlike(REJECTED))
    both = F.col(text).rlike(CHOSE) & F.col(text).rlike(REJECTED)
    found = chunks.where(both).select(key, F.coalesce(F.get(one, F.lit(0)), F.get(other, F.lit(0))).alias("s"))
    return found.where("s is not null").select(key, flat(F.col("s")).alias("excerpt"))
