"""One line that tells the shape of a file's text, by its kind, as Column functions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions import scalars as S

NAMES, NAME_CHARS, LINE_CHARS, NESTED = 12, 60, 80, 3
# What languages are called.
LANGUAGES = {
    "TypeScript": ("ts", "tsx", "mts", "cts"),
    "JavaScript": ("js", "jsx", "mjs", "cjs"),
    "Python": ("py",),
    "Rust": ("rs",),
    "Go": ("go",),
    "Java": ("java",),
    "Ruby": ("rb",),
    "Shell": ("sh",),
    "SQL": ("sql",),
    "CSS": ("css",),
    "HTML": ("html",),
    "YAML": ("yml", "yaml"),
    "TOML": ("toml",),
    "Markdown": ("md",),
}
# Words that may stand before a declaration, those that begin one, and statements that create something.
MODIFIERS = "export|default|declare|abstract|async|public|private|protected|static|readonly"
DECLARATIONS = "function|class|interface|type|enum|const|let|var|def|fn|struct|impl|trait|func|module|namespace|package"
CREATED = "TABLE|INDEX|VIEW|TRIGGER|FUNCTION"
_BEFORE = rf"^(?:(?:{MODIFIERS})\s+|pub(?:\s*\([^)]*\))?\s+)*"
DECLARATION = rf"{_BEFORE}({DECLARATIONS})\s+([A-Za-z_$][A-Za-z0-9_$]*)"
SHELL_FUNCTION = r"^(?:function\s+)?([A-Za-z_][A-Za-z0-9_-]*)\s*\(\s*\)\s*\{"
STATEMENT = rf"(?i){_BEFORE}CREATE\s+(?:OR\s+REPLACE\s+)?({CREATED})\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z0-9_\".]+)"
HEADING = r"^(#{1,6})\s+(.+)$"


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("…")))


def name_list(names: Column) -> Column:
    """The first names, long ones clipped, and how many more there are."""
    more = F.size(names) - NAMES
    shown = F.array_join(F.transform(F.slice(names, 1, NAMES), lambda n: clip(n, NAME_CHARS)), ", ")
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: S.trimmed(x) != "")


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(_lines(text))).cast("string")


def _kind(value: Column) -> Column:
    """Array, object, null, string, boolean or number, of a VARIANT."""
    shape = F.schema_of_variant(value)
    named = F.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").when(shape == "VOID", "null")
    return named.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")


def _shape(value: Column) -> Column:
    """Of an array its length and what its first element is, of an object the number of its keys."""
    items = F.try_variant_get(value, "$", "array<variant>")
    first = _kind(F.get(items, F.lit(0)))
    noun = F.when(first == "array", "arrays").when(first == "null", "values").otherwise(F.concat(first, F.lit("s")))
    array = F.when(F.size(items) == 0, F.lit("empty array")).otherwise(F.concat(F.lit("array of "), F.size(items).cast("string"), F.lit(" "), noun))
    keys = F.size(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    kind = _kind(value)
    return F.when(kind == "array", array).when(kind == "object", F.concat(F.lit("object with "), keys.cast("string"), F.lit(" key(s)"))).otherwise("object")


def json_structure(text: Column) -> Column:
    """An array's length and its first object's keys; an object's keys in the order of the text, and the shapes of three nested values at most."""
    whole = F.try_parse_json(text)
    kind = _kind(whole)
    first = F.get_json_object(text, "$[0]")
    first_keys = F.when(_kind(F.try_parse_json(first)) == "object", F.concat(F.lit(", keys: "), name_list(F.json_object_keys(first)))).otherwise("")
    keys = F.json_object_keys(text)
    values = F.try_variant_get(whole, "$", "map<string,variant>")
    deep = F.filter(keys, lambda k: _kind(values[k]).isin("array", "object", "null"))
    shown = F.array_join(F.transform(F.slice(deep, 1, NESTED), lambda k: F.concat(k, F.lit(": "), _shape(values[k]))), "; ")
    nested = F.when(F.size(deep) > 0, F.concat(F.lit("; nested "), shown)).otherwise("")
    as_object = F.concat(F.lit("object with "), F.size(keys).cast("string"), F.lit(" key(s): "), name_list(keys), nested)
    unread = F.concat(line_count(text), F.lit(" lines of unparsed JSON"))
    return F.when(whole.isNull(), unread).when(kind == "array", F.concat(_shape(whole), first_keys)).when(kind == "object", as_object).otherwise(F.concat(F.lit("JSON "), F.when(kind == "null", "object").otherwise(kind)))


def jsonl_structure(text: Column) -> Column:
    rows = _filled(text)
    first = S.trimmed(F.get(rows, F.lit(0)))
    kind = _kind(F.try_parse_json(first))
    places = F.transform(F.sequence(F.lit(0), F.json_array_length(first) - 1), lambda k: k.cast("string"))
    keys = F.when(kind == "object", F.json_object_keys(first)).when((kind == "array") & (F.json_array_length(first) > 0), places).when(kind == "array", F.array().cast("array<string>"))
    count = F.concat(F.size(rows).cast("string"), F.lit(" JSON rows"))
    return F.when(keys.isNull(), count).otherwise(F.concat(count, F.lit("; first row keys: "), name_list(keys)))


def table_structure(text: Column) -> Column:
    rows = _filled(text)
    header = F.coalesce(F.get(rows, F.lit(0)), F.lit(""))
    columns = F.transform(F.when(F.contains(text, F.lit("\t")), F.split(header, "\t")).otherwise(F.split(header, ",")), S.trimmed)
    return F.concat(F.size(rows).cast("string"), F.lit(" rows, "), F.size(columns).cast("string"), F.lit(" columns: "), name_list(columns))


def _found(text: Column, name: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(_lines(text), name))


def code_structure(path: Column, text: Column) -> Column:
    """The language, the number of lines, and what stands at the top level: declarations, statements that create, or headings."""
    ext = S.extension(path)
    language = F.coalesce(*[F.when(ext.isin(*ends), name) for name, ends in LANGUAGES.items()], F.lit("code"))
    two = lambda x, pattern, low=False: F.concat((F.lower if low else lambda c: c)(F.regexp_extract(x, pattern, 1)), F.lit(" "), F.regexp_extract(x, pattern, 2))

    def declaration(x: Column) -> Column:
        in_shell = (language == "Shell") & x.rlike(SHELL_FUNCTION)
        return F.when(x.rlike(r"^\s") | (x == ""), None).when(x.rlike(DECLARATION), two(x, DECLARATION)).when(in_shell, F.concat(F.lit("function "), F.regexp_extract(x, SHELL_FUNCTION, 1)))

    statements = _found(text, lambda x: F.when(x.rlike(STATEMENT), two(x, STATEMENT, True)))
    headings = _found(text, lambda x: F.when(x.rlike(HEADING), F.concat(F.regexp_extract(x, HEADING, 1), F.lit(" "), S.trimmed(F.regexp_extract(x, HEADING, 2)))))
    names = F.when(language == "Markdown", headings).when(language == "SQL", statements).otherwise(_found(text, declaration))
    what = F.when(language == "Markdown", " heading(s): ").when(language == "SQL", " statement(s): ").otherwise(" top-level declaration(s): ")
    head = F.concat(language, F.lit(", "), line_count(text), F.lit(" lines"))
    return F.when(F.size(names) == 0, head).otherwise(F.concat(head, F.lit("; "), F.size(names).cast("string"), what, name_list(names)))


def text_structure(text: Column) -> Column:
    paragraphs = F.size(F.filter(F.split(text, r"\n\s*\n"), lambda x: S.trimmed(x) != ""))
    first = F.coalesce(F.get(_filled(text), F.lit(0)), F.lit(""))
    return F.concat(line_count(text), F.lit(" lines, "), paragraphs.cast("string"), F.lit(" paragraph(s); first line: "), clip(S.trimmed(first), LINE_CHARS))


def structure_of(kind: Column, path: Column, text: Column) -> Column:
    """The line for a file of ``kind`` (as ``file_kind`` tells it); null for a null text."""
    by_kind = F.when(kind == "json", json_structure(text)).when(kind == "jsonl", jsonl_structure(text)).when(kind.isin("csv", "tsv"), table_structure(text))
    return by_kind.when(kind == "code", code_structure(path, text)).otherwise(text_structure(text))
