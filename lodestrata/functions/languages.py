"""Languages by file extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language, category, typed, compiled, extensions, aliases.
LANGUAGES = (
    ("c", "systems", True, True, "c h", ""),
    ("cpp", "systems", True, True, "cpp cc cxx hpp hxx h++", "c++ cplusplus"),
    ("rust", "systems", True, True, "rs", ""),
    ("javascript", "web_frontend", False, False, "js jsx mjs cjs", "js ecmascript"),
    ("typescript", "web_frontend", True, False, "ts tsx mts cts", "ts"),
    ("vue", "web_frontend", False, False, "vue", ""),
    ("svelte", "web_frontend", False, False, "svelte", ""),
    ("php", "web_backend", False, False, "php phtml php3 php4 php5 phps", ""),
    ("ruby", "web_backend", False, False, "rb rake gemspec", "rb"),
    ("python", "general", False, False, "py pyw pyi pyx", "py python3"),
    ("java", "general", True, True, "java", ""),
    ("go", "general", True, True, "go", "golang"),
    ("csharp", "general", True, True, "cs csx", "c# cs"),
    ("haskell", "functional", True, True, "hs lhs", "hs"),
    ("clojure", "functional", False, False, "clj cljs cljc edn", "clj"),
    ("elm", "functional", True, True, "elm", ""),
    ("ocaml", "functional", True, True, "ml mli", "ml"),
    ("fsharp", "functional", True, True, "fs fsi fsx", "f#"),
    ("scala", "functional", True, True, "scala sc", ""),
    ("swift", "mobile", True, True, "swift", ""),
    ("kotlin", "mobile", True, True, "kt kts", "kt"),
    ("dart", "mobile", True, False, "dart", ""),
    ("r", "data_science", False, False, "r rmd", ""),
    ("julia", "data_science", False, False, "jl", "jl"),
    ("lua", "scripting", False, False, "lua", ""),
    ("perl", "scripting", False, False, "pl pm t", "pl"),
    ("shell", "scripting", False, False, "sh bash zsh fish", "bash sh zsh"),
    ("powershell", "scripting", False, False, "ps1 psm1 psd1", "ps1"),
    ("html", "markup", False, False, "html htm xhtml", ""),
    ("css", "markup", False, False, "css scss sass less", ""),
    ("yaml", "markup", False, False, "yaml yml", "yml"),
    ("json", "markup", False, False, "json jsonc json5", ""),
    ("xml", "markup", False, False, "xml xsd xsl xslt svg", ""),
    ("toml", "markup", False, False, "toml", ""),
    ("markdown", "markup", False, False, "md markdown mdown mkd", "md"),
    ("sql", "query", False, False, "sql", ""),
    ("graphql", "query", True, False, "graphql gql", "gql"),
)

#: Categories whose files are not program code.
NOT_CODE = ("markup", "query", "other")

EXTENSION_LANGUAGE = {ext: name for name, _, _, _, extensions, _ in LANGUAGES for ext in extensions.split()}
ALIAS_LANGUAGE = {alias: name for name, _, _, _, _, aliases in LANGUAGES for alias in aliases.split()} | {name: name for name, *_ in LANGUAGES}
CODE_EXTENSIONS = tuple(ext for _, category, _, _, extensions, _ in LANGUAGES if category not in NOT_CODE for ext in extensions.split())


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def detect_language(path: Column) -> Column:
    """Language of a path by its extension, 'unknown' without a known one, null for null."""
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(literal_map(EXTENSION_LANGUAGE), extension(path)), F.lit("unknown")))


def normalize_language(name: Column) -> Column:
    """Canonical name of a language name or alias; unknown names stay as they are."""
    return F.coalesce(F.try_element_at(literal_map(ALIAS_LANGUAGE), F.lower(name)), name)


def is_code_path(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS)


def extensions_of(language: str) -> list[str]:
    """Extensions of a language or alias, for building file globs."""
    name = ALIAS_LANGUAGE.get(language.lower())
    return next((extensions.split() for n, _, _, _, extensions, _ in LANGUAGES if n == name), [])


def registry(spark: SparkSession) -> DataFrame:
    """The languages as a table."""
    rows = [(n, c, t, k, e.split(), a.split()) for n, c, t, k, e, a in LANGUAGES]
    return spark.createDataFrame(rows, "name string, category string, typed boolean, compiled boolean, extensions array<string>, aliases array<string>")
