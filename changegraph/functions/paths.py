"""Paths: language, generated files, tests, modules, layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "html": "html", "htm": "html", "css": "css", "scss": "scss",
    "json": "json", "yml": "yaml", "yaml": "yaml", "xml": "xml", "properties": "properties", "sql": "sql", "md": "markdown", "rs": "rust", "py": "python",
    "go": "go", "sh": "shell", "bash": "shell", "zsh": "shell", "toml": "toml", "gradle": "groovy",
}
# Globs of generated files.
GENERATED = (
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lockb", "**/Cargo.lock", "**/gradle.lockfile", "**/gradle/wrapper/**", "**/gradlew",
    "**/gradlew.bat", "**/mvnw", "**/mvnw.cmd", "**/.mvn/wrapper/**", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.snap", "**/generated/**",
    "**/generated-sources/**", "**/__generated__/**", "**/*.generated.*", "**/*.g.dart", "**/*.pb.go",
)
# Directories of tests and endings of test file names.
TEST_DIRS = ("test", "tests", "__tests__", "e2e", "androidTest", "testFixtures", "integrationTest")
TEST_STEM = "(Test|Tests|IT|TestCase)$"
# Source sets below ``src``.
SOURCE_SETS = ("main", "test", "integrationTest", "testFixtures", "androidTest", "jmh")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ``**/`` any directories, ``*`` and ``?`` within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c
            i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether the path fits one of the globs: one alternation, one pass."""
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The directory, ``.`` at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """By lower-cased extension, else null."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(known, extension(path))


def is_test_path(path: Column) -> Column:
    name = file_name(path)
    stem = F.element_at(F.split(name, r"\."), 1)
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    in_dir = F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS)))
    longer = F.length(F.regexp_replace(stem, TEST_STEM, "")) > 0
    return in_dir | name.rlike(r"\.(spec|test)\.") | (stem.rlike(TEST_STEM) & longer)


def module_of(path: Column, package: Column) -> Column:
    return F.coalesce(package, directory(path))


def split_path(path: Column) -> Column:
    """STRUCT<module, source_set, code, dirs, name> of ``<module>/src/<set>/<lang>/<dirs>/<name>``; no known set: all dirs."""
    parts = F.split(path, "/")
    n = F.size(parts)
    at = F.array_max(F.filter(F.sequence(F.lit(1), n), lambda i: (F.get(parts, i - 1) == "src") & F.get(parts, i).isin(*SOURCE_SETS) & (n > i + 1)))
    has = at.isNotNull()
    return F.struct(
        F.when(has, F.array_join(F.slice(parts, 1, at - 1), "/")).alias("module"),
        F.when(has, F.get(parts, at)).alias("source_set"),
        F.when(has & (n > at + 2), F.get(parts, at + 1)).alias("code"),
        F.when(has, F.slice(parts, F.least(at + 3, n), F.greatest(n - at - 3, F.lit(0)))).otherwise(F.slice(parts, 1, n - 1)).alias("dirs"),
        F.element_at(parts, -1).alias("name"),
    )


# Layers of the lower-cased path; the first that fits wins. Parts of the path, then extensions, then whole file names.
LAYERS = (
    ("tests", ("test", "spec", "/e2e/", "fixture"), (), ()),
    ("persistence", ("migration", "changelog", "flyway", "liquibase", "repositor", "/dao"), ("sql",), ()),
    ("model", ("model", "entity", "entities", "domain", "dto"), (), ()),
    (
        "build", (".github/", ".gitlab-ci", "ci/"), ("cmake", "gradle", "kts"),
        ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "cargo.toml", "cmakelists.txt", "makefile", "dockerfile"),
    ),
    ("docs", ("docs/", "doc/"), ("md", "adoc", "rst", "txt"), ()),
    ("config", ("config",), ("yml", "yaml", "properties", "toml", "json", "xml", "ini", "conf", "env"), ()),
    ("api", ("controller", "/api/", "resource", "endpoint", "/rest/", "route"), (), ()),
    ("ui", ("component", "/ui/", "/pages/", "/views/"), ("html", "css", "scss", "less", "tsx", "jsx", "vue"), ()),
    ("service", ("service", "usecase", "use-case", "application"), (), ()),
)


def guess_layer(path: Column) -> Column:
    lower, out = F.lower(path), F.lit("core")
    name = file_name(lower)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    for layer, parts, extensions, names in reversed(LAYERS):
        fits = F.lit(False)
        for x in parts:
            fits = fits | lower.contains(x)
        out = F.when(fits | ext.isin(*extensions) | name.isin(*names), layer).otherwise(out)
    return out


# Ranks of layers by word prefix, the first that fits; others have rank 1.
LAYER_RANKS = (
    (3, ("test", "spec", "e2e", "fixture", "docs", "documentation", "example", "sample", "bench")),
    (2, ("api", "controller", "endpoint", "rest", "route", "web", "ui", "front", "view", "component", "page", "cli", "entry", "handler", "job", "consumer", "listener")),
    (0, ("model", "entit", "domain", "schema", "persist", "database", "db", "migration", "repositor", "dao", "config", "contract", "type", "dto", "build", "depend")),
)


def layer_rank(layer: Column) -> Column:
    words = F.split(F.lower(layer), "[^a-z0-9]+")
    out = F.lit(1)
    for rank, prefixes in reversed(LAYER_RANKS):
        out = F.when(_any_prefix(words, "|".join(prefixes)), rank).otherwise(out)
    return out


def _any_prefix(words: Column, prefixes: str) -> Column:
    return F.exists(words, lambda w: w.rlike(f"^({prefixes})"))
