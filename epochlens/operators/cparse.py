"""Whole-file parsing of C text that line expressions cannot do, as Arrow functions: masking, type definitions, function spans."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\.|[^\'\\])*(?:\'|\Z)', re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_CONTROL = frozenset("if for while switch return sizeof do else case catch defined alignof decltype typeof static_assert".split())
#: Words that end a declaration without naming anything.
_NO_ALIAS = frozenset("char const double enum float int long register restrict short signed static struct union unsigned void volatile typedef class".split())
_REJECTED = re.compile(r"\b(?:template|operator)\b")
_SCOPE = re.compile(r"^\s*(?:(?:inline\s+)?namespace\b|extern\s*$|(?:template\b.*)?(?:class|struct|union)\b(?![^{]*\)))", re.S)
_TRAILER = re.compile(r"\)\s*(?:(?:const|noexcept|override|final|volatile|&{1,2}|__attribute__\s*\(\(.*?\)\))\s*|->\s*[\w:<>\s*&]+)*$", re.S)
_BRACES, _MARKS, _BRACKETS = re.compile("[{}]"), re.compile("[{};]"), re.compile(r"[\[\](){};]")
LOOKAHEAD = 1024


def mask(source: str) -> str:
    """Comments and literals as blanks; offsets and line ends stay."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _closing(text: str, at: int) -> int:
    """Index of the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in _BRACES.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(text)


class _Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str) -> None:
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def number(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1


def _declaration_end(masked: str, at: int) -> int | None:
    """Offset of the semicolon that ends a declaration; none where brackets do not fit or the text ends first."""
    depth = 0
    for m in _BRACKETS.finditer(masked, at):
        c = m[0]
        if c == ";":
            if depth == 0:
                return m.start()
        elif c in "([{":
            depth += 1
        else:
            depth -= 1
            if depth < 0:
                return None
    return None


def typedefs(source: str) -> list[tuple[str, int, str]]:
    """(alias, line, text) of each type definition; one without a top-level end is left out."""
    masked, out = mask(source), []
    lines, upto = _Lines(masked), 0
    for m in re.finditer(r"\btypedef\b", masked):
        if m.start() < upto:
            continue
        end = _declaration_end(masked, m.end())
        if end is None:
            # Nothing below closes it either, unless another definition begins within.
            continue
        body = masked[m.end():end]
        if "{" in body and not re.match(r"\s*(?:const\s+|volatile\s+)*(?:struct|union|enum|class)\b[^{]*\{", body) or "typedef" in _WORD.findall(body):
            continue
        upto = end
        alias = _alias(body)
        if alias:
            out.append((alias, lines.number(m.start()), " ".join(source[m.start():end + 1].split())))
    return out


def _last_name(text: str) -> str | None:
    names = _WORD.findall(text)
    return names[-1] if names and names[-1] not in _NO_ALIAS else None


def _alias(body: str) -> str | None:
    """What a definition names: the pointer to a function, what stands behind the last brace, or the last word before array bounds."""
    close = body.rfind("}")
    rest = body[close + 1:]
    pointer = re.search(r"\(\s*(?:\w+\s+)*\*+\s*(?:const\s+)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*\)\s*[(\[]", rest)
    if pointer:
        return pointer[1]
    plain = re.sub(r"(?:\s*\[[^\[\]]*\])+\s*$", "", rest)
    plain = re.sub(r"\s*\([^()]*\)\s*$", "", plain)
    if close < 0 and len(_WORD.findall(plain)) < 2:
        return None
    return _last_name(plain)


def functions(source: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of each function definition. Namespaces, linkage blocks and classes are entered."""
    masked = mask(source)
    masked = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), masked)
    lines, out, begin, at = _Lines(masked), [], 0, 0
    for m in iter(lambda: _MARKS.search(masked, at), None):
        i, at = m.start(), m.end()
        if m[0] in ";}":
            begin = at
            continue
        start = max(begin, i - LOOKAHEAD)
        header = masked[start:i]
        name = _function_name(header)
        if name:
            end = _closing(masked, i)
            first = lines.number(start + len(header) - len(header.lstrip()))
            out.append((name, first, lines.number(min(end, len(masked) - 1))))
            begin = at = end + 1
        elif _SCOPE.search(header) or re.search(r"\bextern\s*$", header):
            begin = at
        else:
            at = _closing(masked, i) + 1
    return out


def parts(body: str, first: int, max_lines: int = 10_000, max_chars: int = 20_000) -> list[tuple[int, int, int, str]]:
    """(part, first line, last line, text): a body in parts within the limits, cut where the next line would pass one."""
    lines = body.splitlines(keepends=True)
    out, held, chars, begin = [], [], 0, first
    for i, line in enumerate(lines):
        if held and (len(held) + 1 > max_lines or chars + len(line) > max_chars):
            out.append((len(out) + 1, begin, first + i - 1, "".join(held)))
            held, chars, begin = [], 0, first + i
        held.append(line)
        chars += len(line)
    return [*out, (len(out) + 1, begin, first + len(lines) - 1, "".join(held))] if held else out


def _has_initialisers(header: str) -> bool:
    """Whether a single colon follows parameters outside all brackets, as before a constructor's initialisers."""
    depth, after = 0, False
    for i, c in enumerate(header):
        if c in "([<":
            depth += c != "<"
        elif c in ")]":
            depth -= 1
            after = depth == 0 and c == ")"
        elif c == ":" and after and depth == 0 and header[i + 1 : i + 2] != ":" and header[i - 1] != ":":
            return True
        elif not c.isspace():
            after = after and c.isalnum() or False
    return False


def _function_name(header: str) -> str | None:
    found = _TRAILER.search(header)
    if not found or _REJECTED.search(header) or _has_initialisers(header):
        return None
    depth, close = 0, found.start()
    for i in range(close, -1, -1):
        depth += (header[i] == ")") - (header[i] == "(")
        if depth == 0:
            name = re.search(r"((?:[A-Za-z_]\w*\s*::\s*)*~?[A-Za-z_]\w*)\s*$", header[:i])
            if not name or "=" in header[:i]:
                return None
            word = re.sub(r"\s", "", name[1])
            return None if word.rsplit("::", 1)[-1] in _CONTROL else word
    return None


def _per_file(files: DataFrame, parse, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in parse(s or "")]
            columns = list(zip(*rows, strict=True)) or [[]] * (1 + len(names))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string(), *types], strict=True)], ["path", *names])

    return files.select("path", "content").mapInArrow(run, f"path string, {schema}")


def scan_typedefs(files: DataFrame) -> DataFrame:
    return _per_file(files, typedefs, ["alias", "line", "text"], [pa.string(), pa.int32(), pa.string()], "alias string, line int, text string")


def scan_functions(files: DataFrame) -> DataFrame:
    return _per_file(files, functions, ["name", "start_line", "end_line"], [pa.string(), pa.int32(), pa.int32()], "name string, start_line int, end_line int")


def split_bodies(source: str, max_lines: int = 10_000, max_chars: int = 20_000):
    """(name, first line, last line, part, text) of each function, large ones in parts."""
    lines = source.splitlines(keepends=True)
    for name, first, last in functions(source):
        found = parts("".join(lines[first - 1 : last]), first, max_lines, max_chars)
        yield from ((name, a, b, n if len(found) > 1 else 0, body) for n, a, b, body in found)


def scan_bodies(files: DataFrame, max_lines: int = 10_000, max_chars: int = 20_000) -> DataFrame:
    """Functions with their text, large ones in parts: path, name, start_line, end_line, part (0 where it is whole), body."""
    return _per_file(files, lambda source: split_bodies(source, max_lines, max_chars), ["name", "start_line", "end_line", "part", "body"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()], "name string, start_line int, end_line int, part int, body string")


def masked_files(files: DataFrame) -> DataFrame:
    return _per_file(files, lambda s: [(mask(s),)], ["masked"], [pa.string()], "masked string")


_STRUCT = r"(?s)struct\s+\w+\s*\{[^}]*\}\s*;"
NEEDS = ("typedefs", "structs", "macros", "callees", "headers")


def typedef_statements(source: str, reach: int = 10) -> list[str]:
    """Type definitions that begin a line and hold no parenthesis before their semicolon, over up to ``reach`` lines, each once."""
    lines, out = [x.strip() for x in source.split("\n")], {}
    for i, line in enumerate(lines):
        if line.startswith("typedef "):
            text = ""
            for more in lines[i : i + reach]:
                text = f"{text} {more}"
                if ";" in more:
                    break
            whole = " ".join(text.split())
            if ";" in whole and "(" not in whole.split(";")[0]:
                out[whole] = None
    return list(out)


def context_items(files: DataFrame) -> DataFrame:
    """Per file its type definitions, structures, macros, called words and include lines."""
    lines = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n", -1)
    flat = lambda a: F.transform(a, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    whole = flat(F.regexp_extract_all("content", F.lit(_STRUCT), F.lit(0)))
    short = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("struct ")) & F.contains(x, F.lit("{")) & F.contains(x, F.lit("}")))
    begins = lambda word: F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.startswith(word))
    calls = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1)))
    native = files.select("path", F.array_distinct(F.concat(whole, short)).alias("structs"), begins("#define ").alias("macros"), F.array_except(calls, F.array(*map(F.lit, sorted(_CONTROL)))).alias("callees"), begins("#include ").alias("headers"))
    statements = _per_file(files, lambda s: [(typedef_statements(s),)], ["typedefs"], [pa.list_(pa.string())], "typedefs array<string>")
    return native.join(statements, "path").select("path", *NEEDS)


def wanted_context(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Only those lists of a file that were asked for: ``needs`` has path and needs (array); path, context (a map)."""
    every = F.map_from_arrays(F.array(*map(F.lit, NEEDS)), F.array(*NEEDS))
    return items.join(needs, "path").select("path", F.map_filter(every, lambda k, _: F.array_contains("needs", k)).alias("context"))


def leading_context(files: DataFrame, items: DataFrame, lines: int = 50) -> DataFrame:
    """The first lines of each file with its type definitions, structures and macros."""
    head = F.array_join(F.slice(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n", -1), 1, lines), "\n")
    return files.select("path", head.alias("leading_lines")).join(items.select("path", "typedefs", "structs", "macros"), "path")
