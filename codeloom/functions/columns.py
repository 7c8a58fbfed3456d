"""Column functions of symbols, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
LANGUAGES = ("cpp", "rust", "go", "python", "csharp", "java")
KINDS = ("function", "method", "class", "struct", "enum", "typedef", "interface", "trait")
CALLABLE = ("function", "method")
CLASS_LIKE = ("class", "struct", "interface", "trait")
EXTENSIONS = {
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".rs": "rust", ".go": "go", ".py": "python", ".pyi": "python", ".cs": "csharp", ".java": "java",
}
SYNTHETIC_PREFIX = "/* synthesized by [cpp].macro_define_function"
TEMPLATE_PREFIX = "/* template */"


def qualified(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("::"), name))


def symbol_id(file: Column, parent: Column, name: Column) -> Column:
    return F.concat(file, F.lit(":"), qualified(parent, name))


def id_file(symbol: Column) -> Column:
    """The file of an id: what stands before the last colon that has no colon beside it."""
    return F.regexp_extract(symbol, "^(.*?)(?<!:):(?!:)((?:[^:]|::)*)$", 1)


def id_parent(symbol: Column) -> Column:
    """The parent in an id: after the last lone colon, what stands before the first double one; else empty."""
    return F.regexp_extract(F.regexp_extract(symbol, "^(.*?)(?<!:):(?!:)((?:[^:]|::)*)$", 2), "^(.*?)::", 1)


def id_basename(symbol: Column) -> Column:
    """What stands after the last double colon, else after the last colon."""
    return F.when(symbol.contains("::"), F.substring_index(symbol, "::", -1)).otherwise(F.substring_index(symbol, ":", -1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def under(path: Column, prefix: str) -> Column:
    """Whether a path is ``prefix`` or lies below it, segment by segment. Both parts reach the Parquet scan."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)


def language_of(path: Column, extensions: dict[str, str] | None = None, disabled: tuple[str, ...] = ()) -> Column:
    """The language of a path's extension, in lower case; null if none. ``extensions`` adds to or overrides the built-in ones."""
    table = {k: v for k, v in (EXTENSIONS | (extensions or {})).items() if k not in disabled and v not in disabled}
    found = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), found) if table else F.lit(None).cast("string")


def is_virtual(signature: Column) -> Column:
    return signature.startswith("virtual ") | signature.contains(" virtual ")


def truncated_signature(text: Column) -> Column:
    """Up to the first brace or semicolon, trimmed at the right; beyond 200 characters cut off with dots."""
    head = F.rtrim(F.regexp_extract(text, "^([^{;]*)", 1))
    return F.when(F.octet_length(head) > 200, F.concat(F.substring(head, 1, 200), F.lit("..."))).otherwise(head)


def adaptive_distance(query: str) -> int:
    """How many edits a near search of ``query`` allows, by its bytes."""
    size = len(query.encode())
    return 0 if size < 2 else 1 if size < 12 else 2 if size < 18 else 3


def common_prefix(column: Column, query: str) -> Column:
    """How many leading characters a column has in common with ``query``."""
    made = F.lit(0)
    for i in range(1, len(query) + 1):
        made = F.when(column.startswith(query[:i]), F.lit(i)).otherwise(made)
    return made


def rfc3339(nanos: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(nanos / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
