"""Path and file predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language, what discovery takes, and what it passes over; the last name is the
# folder of our own cache.
LANGUAGE_EXTENSIONS = {"typescript": ("ts", "tsx"), "javascript": ("js", "jsx"), "python": ("py",), "rust": ("rs",)}
SUPPORTED_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "cpp", "c", "hpp", "h")
IGNORED_NAMES = ("node_modules", ".git", "dist", "build", ".next", "coverage", ".nyc_output", ".cache", "tmp", "temp", "fixtures", ".lucidgraph-cache")
# Ends of the names of test files, and the folders that hold tests. What begins with "/" must be a whole
# folder name below another folder.
TEST_ENDS = {
    "javascript": (".test.js", ".test.jsx", ".spec.js", ".spec.jsx", ".e2e.js", ".e2e.jsx", ".e2e-spec.js", ".integration.js", ".integration.jsx"),
    "typescript": (".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".e2e.ts", ".e2e.tsx", ".e2e-spec.ts", ".integration.ts", ".integration.tsx"),
    "python": ("_test.py",),
    "rust": ("_test.rs",),
}
TEST_FOLDERS = {"javascript": ("__tests__", "/tests", "/test"), "typescript": ("__tests__", "/tests", "/test"), "python": ("/tests", "/test"), "rust": ("/tests", "/benches")}


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def detect_language(path: Column) -> Column:
    """Language by extension; null for an unknown one."""
    out = F.lit(None).cast("string")
    for language, extensions in LANGUAGE_EXTENSIONS.items():
        out = F.when(extension(path).isin(*extensions), language).otherwise(out)
    return out


def is_supported_file(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED_EXTENSIONS) & ~path.endswith(".d.ts")


def should_ignore_path(relative: Column, patterns: Column | None = None) -> Column:
    """Names match anywhere in the path. Of the patterns one that ends in "*" matches as a prefix, any other as the whole
    path or anywhere after a "/"."""
    named = any_of(relative.contains(n) for n in (*IGNORED_NAMES, ".DS_Store"))
    if patterns is None:
        return named
    starts = lambda p: relative.startswith(F.substr(p, F.lit(1), F.length(p) - 1))
    return named | F.exists(patterns, lambda p: F.when(p.endswith("*"), starts(p)).otherwise((relative == p) | relative.contains(F.concat(F.lit("/"), p))))


def is_test_file(path: Column, language: Column) -> Column:
    """By the file's name or its folders; false for other languages."""
    name, folder = F.element_at(F.split(path, "/"), -1), F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    out = F.lit(False)
    for kind in LANGUAGE_EXTENSIONS:
        found = any_of(name.endswith(e) for e in TEST_ENDS[kind]) | any_of(folder.endswith(f) | folder.contains(f"{f}/") for f in TEST_FOLDERS[kind])
        if kind == "python":
            found |= (name.startswith("test_") & name.endswith(".py")) | (name == "conftest.py")
        out = F.when(language == kind, found).otherwise(out)
    return out


def paths_match(a: Column, b: Column) -> Column:
    """Equal, or one ends in the other at a path boundary."""
    ends = lambda x, y: x.endswith(F.concat(F.lit("/"), y)) | x.endswith(F.concat(F.lit("\\"), y))
    return (a == b) | ends(a, b) | ends(b, a)


def parse_symbol_ref(ref: Column) -> Column:
    """path, line, name of path:line#name, split at the last '#' and the last ':' before it; nulls where malformed."""
    ok = ref.rlike(r"^(.+):(\d+)#([^#]+)$")
    part = lambda i: F.when(ok, F.regexp_extract(ref, r"^(.+):(\d+)#([^#]+)$", i))
    return F.struct(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).alias("name"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")
