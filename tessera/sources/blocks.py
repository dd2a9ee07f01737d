"""Block extraction: source files become token blocks.

Python is read with the standard library's tokenizer and syntax tree; JavaScript and TypeScript with a lexer and matched
braces. A definition of at least ``min_tokens`` is a block, and its inside is not searched further; what is left is cut
greedily into chunks of statements.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TOKENS, MAX_TOKENS = 40, 120
SCHEMA = "file_path string, lang string, start_line int, end_line int, start_byte long, end_byte long, tokens array<string>, raw_content string, node_type string"
LEX = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>===|!==|\*\*|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|[-+*/%&|^]=|<<|>>|\.\.\.|.)""", re.S)
LOOSE = re.compile(LEX.pattern.replace(r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\#[^\n]*"), re.S)
# Kinds of blocks by the word that opens them.
DEFINES = {"function": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "type": "type_alias_declaration"}
#: Nesting beyond which a script's braces are not followed; what lies deeper belongs to the statement around it.
DEEPEST = 200


def _python_tokens(text: str) -> list[tuple[int, str]]:
    out = []
    skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type not in skip and t.string.strip():
                out.append((t.start[0], t.string))
    except (tokenize.TokenError, IndentationError, SyntaxError, RecursionError, MemoryError):
        return _loose_tokens(text, LOOSE)
    return out


def _loose_tokens(text: str, lex=LEX) -> list[tuple[int, str]]:
    """Tokens by pattern alone, for scripts and for Python that the tokenizer refuses."""
    out, line = [], 1
    for m in lex.finditer(text):
        if m.lastgroup != "skip":
            out.append((line, m.group()))
        line += m.group().count("\n")
    return out


def _line_units(text: str):
    """For Python that does not parse: every run of lines at the left margin or below it is a statement, and a ``def`` or
    ``class`` at any depth is a definition as far as its indentation goes."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]

    def end_of(i: int) -> int:
        last = i
        for j in range(i + 1, len(lines)):
            if depth[j] is None:
                continue
            if depth[j] <= depth[i]:
                break
            last = j
        return last

    out, i = [], 0
    while i < len(lines):
        if depth[i] is None:
            i += 1
            continue
        last = end_of(i)
        m = re.match(r"\s*(?:async\s+)?(def|class)\b", lines[i])
        kind = {"def": "function_definition", "class": "class_definition"}[m[1]] if m else ""
        out.append((i + 1, last + 1, kind, []))
        i = last + 1
    return out


def _python_units(text: str):
    """(definitions outermost first as a tree, statements): each (first line, last line, kind, children)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _line_units(text)
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    roots: list[tuple] = []
    stack = [(n, roots) for n in reversed(tree.body)]
    while stack:
        node, into = stack.pop()
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        inner: list[tuple] = []
        into.append((first, node.end_lineno, kinds.get(type(node), ""), inner))
        below = [c for body in ("body", "orelse", "finalbody", "handlers", "cases") for c in getattr(node, body, []) or [] if hasattr(c, "lineno")]
        stack += [(c, inner) for c in reversed(below) if isinstance(c, ast.stmt | ast.ExceptHandler)]
    return roots


def _kind(words: list[str], tokens: list[str], body: bool) -> str:
    """The kind of a script's statement, by its first words and its tokens before the body."""
    if words[:1] == ["export"]:
        return "export_statement"
    lead = next((w for w in words if w not in ("default", "async", "abstract", "declare")), "")
    if lead == "type":
        return DEFINES["type"] if "=" in tokens else ""
    if lead in DEFINES:
        return DEFINES[lead]
    if not body:
        return ""
    if "=>" in tokens:
        return "arrow_function"
    if "function" in tokens:
        return "function_expression"
    named = lead and re.match(r"[A-Za-z_$#]", lead) and lead not in ("if", "for", "while", "switch", "try", "do", "else", "return", "const", "let", "var", "import")
    return "method_definition" if named and "(" in tokens else ""


def _script_units(tokens: list[tuple[int, str]]):
    """Statements end at ';' or a closing brace of their own depth; definitions are told by their first words. An explicit
    stack holds the bodies that wait, so deep nesting needs no recursion."""
    roots: list[tuple] = []
    waiting = [(0, len(tokens), roots, 0)]
    while waiting:
        i, end, into, level = waiting.pop()
        while i < end:
            start, depth, body = i, 0, None
            while i < end:
                t = tokens[i][1]
                if t in "([{":
                    if t == "{" and not depth and body is None:
                        body = i
                    depth += 1
                elif t in ")]}" and depth:
                    depth -= 1
                    if t == "}" and not depth and not (i + 1 < end and tokens[i + 1][1] in (";", ",", ")", ".", "(", "else", "catch", "finally", "while")):
                        i += 1
                        break
                elif t == ";" and not depth:
                    i += 1
                    break
                i += 1
            head = [tokens[k][1] for k in range(start, min(body + 1 if body is not None else i, start + 400))]
            inner: list[tuple] = []
            into.append((tokens[start][0], tokens[i - 1][0], _kind(head[:5], head, body is not None), inner))
            if body is not None and body + 1 < i - 1 and level < DEEPEST:
                waiting.append((body + 1, i - 1, inner, level + 1))
    return roots


def extract(path: str, lang: str, text: str, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> list[tuple]:
    """The blocks of one text, in the order of ``SCHEMA``."""
    text = text or ""
    tokens = _python_tokens(text) if lang == "python" else _loose_tokens(text)
    units = _python_units(text) if lang == "python" else _script_units(tokens)
    lines = text.split("\n")
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode("utf-8")) + 1)
    total = len(text.encode("utf-8"))
    by_line: dict[int, list[str]] = {}
    for n, t in tokens:
        by_line.setdefault(n, []).append(t)

    def inside(a: int, b: int) -> list[str]:
        return [t for n in range(a, b + 1) for t in by_line.get(n, ())]

    out, taken = [], []

    def emit(a: int, b: int, toks: list[str], kind: str) -> None:
        out.append((path, lang, a, b, at[a - 1], min(at[b] - 1, total), toks, "\n".join(lines[a - 1 : b]), kind))

    stack = list(reversed(units))
    while stack:
        a, b, kind, inner = stack.pop()
        toks = inside(a, b) if kind else []
        if kind and len(toks) >= min_tokens:
            emit(a, b, toks, kind)
            taken.append((a, b))
        else:
            stack += reversed(inner)

    held: list[tuple[int, int, list[str]]] = []

    def flush(least: int) -> None:
        toks = [t for _, _, ts in held for t in ts]
        if toks and len(toks) >= least:
            emit(held[0][0], held[-1][1], toks, "chunk")
        held.clear()

    for a, b, _, _ in units:
        if any(s <= b and a <= e for s, e in taken):
            continue
        toks = inside(a, b)
        if held and sum(len(x[2]) for x in held) + len(toks) > max_tokens:
            flush(0)
        held.append((a, b, toks))
        if sum(len(x[2]) for x in held) >= max_tokens:
            flush(0)
    flush(min_tokens)
    return out


def extract_blocks(files: DataFrame, languages: list[str] | None = None, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Blocks of ``files`` (path, lang, content); a file that cannot be read has none."""
    kept = files.where(F.col("lang").isNotNull() if languages is None else F.col("lang").isin(languages))

    def run(batches):
        for pdf in batches:
            rows = [b for p, g, c in zip(pdf["path"], pdf["lang"], pdf["content"]) for b in extract(p, g, c, min_tokens, max_tokens)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return kept.select("path", "lang", "content").mapInPandas(run, SCHEMA)


def useful(blocks: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    return blocks.where((F.size("tokens") >= min_tokens) & (F.col("end_line") > F.col("start_line")))
