"""Names of files for results and reports, as Column expressions. Paths are compared as text; links are resolved where trees are listed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of headers and of implementations.
HEADERS = ("h", "hh", "hpp", "hxx")
IMPLEMENTATIONS = ("c", "cc", "cpp", "cxx")


def _folder(root: str) -> str:
    return root.rstrip("/") + "/"


def is_within(path: Column, root: str) -> Column:
    """Whether a canonical path lies under the root."""
    return (path == root.rstrip("/")) | path.startswith(_folder(root))


def relative(path: Column, root: str) -> Column:
    """The path below the root; the root itself is a dot, and others stay as they are."""
    folder = _folder(root)
    return F.when(path == root.rstrip("/"), ".").when(path.startswith(folder), F.substring(path, F.lit(len(folder) + 1), F.length(path))).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display(path: Column, cwd: str) -> Column:
    """Relative paths as they are, those below the working folder relative to it, others by their last part alone."""
    return F.when(path.isNull(), "").when(~path.startswith("/"), path).when(is_within(path, cwd), relative(path, cwd)).otherwise(base_name(path))


def display_rules(path: Column, cwd: str, package: str = "epochlens/rules/") -> Column:
    """As ``display``, but rules of the package by their place in it."""
    at = F.instr(path, f"/{package}")
    return F.when(at > 0, F.substring(path, at + 1, F.length(path))).otherwise(display(path, cwd))


def display_root(path: Column, cwd: str) -> Column:
    """As ``display``, but a dot for working copies in a cache."""
    return F.when(F.contains(path, F.lit(".gitwork")) | F.contains(path, F.lit("/.repo_cache/")), ".").otherwise(display(path, cwd))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_header(path: Column) -> Column:
    return suffix(path).isin(*HEADERS)


def is_implementation(path: Column) -> Column:
    return suffix(path).isin(*IMPLEMENTATIONS)


def relative_definition(definition: Column, root: str) -> Column:
    """``path:line: text`` with the path below the root."""
    pattern = r"^([^:]*):(\d+):(.*)$"
    return F.when(definition.rlike(f"(?s){pattern}"), F.concat(relative(F.regexp_extract(definition, f"(?s){pattern}", 1), root), F.lit(":"), F.regexp_extract(definition, f"(?s){pattern}", 2), F.lit(":"), F.regexp_extract(definition, f"(?s){pattern}", 3))).otherwise(definition)


def host_of(url: Column) -> Column:
    """The host of an address, or of a bare host with or without a port; empty where there is none."""
    whole = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    return F.lower(F.regexp_replace(F.regexp_extract(whole, r"^(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"\.$", ""))


def is_host_or_subdomain(url: Column, domain: str) -> Column:
    host = host_of(url)
    return (host == domain) | host.endswith(f".{domain}")
