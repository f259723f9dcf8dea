"""Scalar functions over source text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS, REASON_CHARS = 240, 200


def strip_simple(text: Column) -> Column:
    """Cut a line comment, then collapse quoted text to empty quotes; block comments stay."""
    cut = F.regexp_replace(text, r"//.*$", "")
    marks = F.contains(text, F.lit("//")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("'"))
    return F.when(marks, F.regexp_replace(F.regexp_replace(cut, r'"[^"]*"', '""'), r"'[^']*'", "''")).otherwise(text)


def words(text: Column) -> Column:
    """Identifier tokens in order."""
    return F.regexp_extract_all(text, F.lit(r"\b([_A-Za-z]\w*)\b"), 1)


def bigrams(tokens: Column) -> Column:
    """Adjacent tokens joined by a blank."""
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.slice(tokens, 1, F.size(tokens) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(tokens, i + 1))))


def is_called(text: Column, symbol: Column) -> Column:
    """Whether the symbol stands as a word before an opening parenthesis."""
    return F.regexp_like(text, F.concat(F.lit(r"\b\Q"), symbol, F.lit(r"\E\b\s*\(")))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def normalize_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def bound_snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    """One line of at most ``most`` characters."""
    ends = F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\n"))
    flat = F.trim(F.when(ends, F.regexp_replace(text, r"[\r\n]+", " ")).otherwise(text))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def bound_reason(text: Column, most: int = REASON_CHARS) -> Column:
    """Words with single blanks, of at most ``most`` characters."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), " +", " ")
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def candidate_id(path: Column, line: Column, col_start: Column, col_end: Column, risk: Column, symbol: Column) -> Column:
    """Identity as text; missing columns count as 0."""
    zero = F.lit(0)
    return F.concat_ws(":", path, line.cast("string"), F.coalesce(col_start, zero).cast("string"), F.coalesce(col_end, zero).cast("string"), risk, symbol)


def function_id(path: Column, symbol: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s@%s:%d-%d", path, symbol, start, end)


def function_id_start(fid: Column) -> Column:
    return F.nullif(F.regexp_extract(fid, r":(\d+)-\d+(?::part\d+)?$", 1), F.lit("")).cast("int")


def function_hash(body: Column, hint: Column, rules: Column) -> Column:
    """Sixteen digits that tell whether a function was judged before under the same scenario and rules."""
    return F.left(F.sha2(F.concat_ws("|", body, hint, rules), 256), F.lit(16))


def redact_paths(text: Column) -> Column:
    """Absolute and home paths become a mark."""
    return F.regexp_replace(text, r"""(?<![A-Za-z0-9_])(?:/[^\s"']+|[A-Za-z]:\\[^\s"']+)|(?:^|[\s"'(])~/[^\s"']+""", "<path>")


def redact_credentials(url: Column) -> Column:
    """User information in web addresses becomes a mark; with other schemes the name stays and the password goes."""
    web = F.regexp_replace(url, r"(?i)\b(https?://)[^/@\s]+@", "$1***@")
    return F.regexp_replace(web, r"\b((?!(?i)https?:)[A-Za-z][A-Za-z0-9+.-]*://[^/@\s:]*):[^/@\s]+@", "$1:***@")


def carries_credentials(url: Column) -> Column:
    """User information on http(s), or a password on any other scheme."""
    return F.regexp_like(url, F.lit(r"^https?://[^/@\s]+@")) | F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/@\s:]*:[^/@\s]+@"))


def sanitize_token(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def ref_label(ref: Column) -> Column:
    """Twelve digits of a commit id, else the sanitised name."""
    return F.when(F.regexp_like(ref, F.lit(r"^[0-9a-fA-F]{16,}$")), F.lower(F.left(ref, F.lit(12)))).otherwise(sanitize_token(ref))


def truncate_utf8(text: Column, most: int, marker: str = "...") -> Column:
    """At most ``most`` bytes, cut between characters, the marker included."""
    room = most - len(marker.encode())
    raw = F.substring(F.encode(text, "UTF-8"), 1, room + 1)
    # Step back over continuation bytes at the cut.
    sizes = F.reverse(F.sequence(F.lit(max(0, room - 3)), F.lit(room)))
    keep = F.element_at(F.filter(sizes, lambda n: ~F.conv(F.hex(F.substring(raw, n + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)), 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), keep), "UTF-8"), F.lit(marker)))


def canonical_rule(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(F.trim(name)), "- ", "__"), r"[^A-Z0-9_]", "")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def script_json(text: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = text
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_fence(text: Column) -> Column:
    """The inside of a response that is one fenced block."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```[\w+-]*\s*\n(.*?)\n?```$", 1)
    return F.when(F.regexp_like(F.trim(text), F.lit(r"(?s)^```[\w+-]*\s*\n.*\n?```$")), inner).otherwise(text)
