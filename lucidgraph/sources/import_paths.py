"""Where imports lead: candidate paths by the rules of each language, of which the first that exists counts.

Paths are relative to the project's root, "" being the root itself. All functions take imports: id, file, module; and
files: path. They give id, path, found; path is the place where the module would be expected if it isn't found.
Imports from elsewhere (no relative path in JavaScript and TypeScript, no such module in Rust) keep their name as path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidgraph.operators.recursion import written

# Fixed values, in the order of preference.
JS_ENDS, JS_INDEX = ("", ".js", ".jsx", ".mjs", ".cjs"), ("index.js", "index.jsx", "index.mjs", "index.cjs")
TS_ENDS, TS_INDEX = ("", ".ts", ".tsx", ".js", ".jsx"), ("index.ts", "index.tsx", "index.js")
TS_FOR_JS = {".js": (".ts", ".tsx"), ".mjs": (".ts", ".tsx"), ".jsx": (".tsx",)}
PYTHON_MARKERS = ("setup.py", "pyproject.toml", ".git", "requirements.txt", "Pipfile", "tox.ini", "poetry.lock", "Pipfile.lock", ".python-version")
#: Folders searched for a marker, and above the project's root for a module.
PYTHON_LEVELS = 3


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def joined(folder: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(folder == "", name).when(name == "", folder).otherwise(F.concat(folder, F.lit("/"), name))


def normal_path(path: Column) -> Column:
    """Without "." and with each ".." resolved; what leads above the root stops there."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _first(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: id, candidates, expected. id, path, found."""
    spread = wanted.select("id", F.posexplode("candidates").alias("_at", "path"))
    hit = spread.join(files.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.min_by("path", "_at").alias("_hit"))
    return wanted.join(hit, "id", "left").select("id", F.coalesce("_hit", "expected").alias("path"), F.col("_hit").isNotNull().alias("found"))


def _extension(path: Column) -> Column:
    """Of the last name, with its dot; empty where the name has none or only begins with one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def javascript_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    at = normal_path(F.concat_ws("/", folder_of(F.col("file")), "module"))
    near = imports.withColumn("_at", F.when(F.col("module").rlike(r"^\.\.?/"), at))
    ends = [F.concat("_at", F.lit(e)) for e in JS_ENDS] + [joined(F.col("_at"), i) for i in JS_INDEX]
    guess = F.when(_extension(F.col("_at")).isin(*JS_ENDS[1:]), F.col("_at")).otherwise(F.concat("_at", F.lit(".js")))
    return _scripts(near, F.array(*ends), guess, files)


def typescript_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    at = normal_path(F.concat_ws("/", folder_of(F.col("file")), "module"))
    near = imports.withColumn("_at", F.when(F.col("module").rlike(r"^\.\.?/"), at))
    end = _extension(F.col("_at"))
    bare = F.substr("_at", F.lit(1), F.length("_at") - F.length(end))
    none = F.array().cast("array<string>")
    swapped, folders, guess = none, none, F.when(end.isin(*TS_ENDS[1:]), F.col("_at")).otherwise(F.concat("_at", F.lit(".ts")))
    for script, kinds in TS_FOR_JS.items():
        swapped = F.when(end == script, F.array(*[F.concat(bare, F.lit(k)) for k in kinds])).otherwise(swapped)
        guess = F.when(end == script, F.concat(bare, F.lit(kinds[0]))).otherwise(guess)
        if len(kinds) == 2:
            folders = F.when(end == script, F.array(*[joined(bare, i) for i in TS_INDEX[:2]])).otherwise(folders)
    ends = F.array(*[F.concat("_at", F.lit(e)) for e in TS_ENDS], *[joined(F.col("_at"), i) for i in TS_INDEX])
    return _scripts(near, F.concat(swapped, ends, folders), guess, files)


def _scripts(near: DataFrame, candidates: Column, guess: Column, files: DataFrame) -> DataFrame:
    found = _first(near.filter("_at is not null").select("id", candidates.alias("candidates"), guess.alias("expected")), files)
    return found.unionByName(near.filter("_at is null").select("id", F.col("module").alias("path"), F.lit(False).alias("found")))


def folders_above(folder: Column) -> Column:
    """The folder, and each above it up to the root."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _marked(folders: DataFrame, files: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """folders: folder. folder, above (array), and for each mark whether each of those folders holds a file so named."""
    spread = folders.select("folder", F.posexplode(folders_above(F.col("folder"))).alias("at", "up"))
    held = files.select(folder_of(F.col("path")).alias("up"), F.element_at(F.split("path", "/"), -1).alias("name")).filter(F.col("name").isin(*{n for ns in names.values() for n in ns}))
    held = held.groupBy("up").agg(*[F.max(F.col("name").isin(*ns)).alias(k) for k, ns in names.items()])
    rows = spread.join(held, "up", "left").select("folder", F.struct("at", "up", *[F.coalesce(k, F.lit(False)).alias(k) for k in names]).alias("row"))
    sorted_ = rows.groupBy("folder").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # as many as the path is deep
    return sorted_.select("folder", F.col("rows.up").alias("above"), *[F.col(f"rows.{k}").alias(k) for k in names])


def python_roots(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folders: folder. folder, root: above the topmost package, else the nearest of PYTHON_LEVELS folders with a marker
    of a project, else null."""
    m = _marked(folders, files, {"package": ("__init__.py",), "marker": PYTHON_MARKERS})
    higher = F.slice("package", F.lit(2), F.size("package"))
    top = F.coalesce(F.nullif(F.array_position(higher, F.lit(False)), F.lit(0).cast("bigint")) - 1, F.size(higher).cast("bigint"))
    is_package = F.col("package")[0] | (top > 0)
    mark = F.array_position(F.slice("marker", 1, PYTHON_LEVELS), F.lit(True)).cast("int")
    above = F.when(is_package, F.get("above", F.least(top.cast("int") + 1, F.size("above") - 1))).when(mark > 0, F.get("above", mark - 1))
    return m.select("folder", above.alias("root"))


def python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative modules by their dots; others beside the file, below the project's root, or above it."""
    source = imports.select("id", "module", folder_of(F.col("file")).alias("folder"))
    ends = lambda p: [F.concat(p, F.lit(".py")), joined(p, "__init__.py")]
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    name = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/")
    base = F.get(folders_above(F.col("folder")), F.least(dots - 1, F.size(folders_above(F.col("folder"))) - 1))
    near = source.filter("startswith(module, '.')").select("id", joined(base, name).alias("_at"))
    near = near.select("id", F.array(*ends(F.col("_at"))).alias("candidates"), F.concat("_at", F.lit(".py")).alias("expected"))
    far = source.filter("not startswith(module, '.')")
    roots = written(python_roots(far.select("folder").distinct(), files))
    twice = F.split("module", r"\.")[0] == F.element_at(F.split("folder", "/"), -1)
    far = far.join(roots, "folder").withColumn("root", F.coalesce("root", F.when(twice, folder_of(F.col("folder"))).otherwise(F.col("folder"))))
    at = lambda folder: joined(folder, F.regexp_replace("module", r"\.", "/"))
    above = F.slice(folders_above(F.col("root")), 2, PYTHON_LEVELS)
    higher = F.flatten(F.transform(above, lambda f: F.array(*ends(at(f)))))
    far = far.select("id", F.concat(F.array(*ends(at(F.col("folder"))), *ends(at(F.col("root")))), higher).alias("candidates"), F.concat(at(F.col("root")), F.lit(".py")).alias("expected"))
    return _first(near.unionByName(far), files)


def rust_crate_roots(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folders: folder. folder, root: the nearest folder with lib.rs or main.rs, or with Cargo.toml (its src where that
    has one of them); the folder itself where there is none."""
    m = _marked(folders, files, {"crate": ("lib.rs", "main.rs"), "cargo": ("Cargo.toml",)})
    at = lambda c: F.nullif(F.array_position(c, F.lit(True)), F.lit(0).cast("bigint"))
    m = m.withColumn("_crate", at(F.col("crate"))).withColumn("_cargo", at(F.col("cargo")))
    home = F.coalesce(F.when(F.col("_cargo").isNull() | (F.col("_crate") <= F.col("_cargo")), F.get("above", F.col("_crate").cast("int") - 1)), F.get("above", F.col("_cargo").cast("int") - 1))
    by_cargo = F.col("_cargo").isNotNull() & (F.col("_crate").isNull() | (F.col("_crate") > F.col("_cargo")))
    m = m.select("folder", home.alias("home"), by_cargo.alias("by_cargo"))
    src = files.filter(F.col("path").rlike(r"(^|/)src/(lib|main)\.rs$")).select(folder_of(F.col("path")).alias("src")).distinct()
    m = m.withColumn("src", joined(F.col("home"), "src")).join(src.withColumn("_has", F.lit(True)), "src", "left")
    return m.select("folder", F.coalesce(F.when(F.col("by_cargo") & F.col("_has"), F.col("src")), "home", "folder").alias("root"))


def rust_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """crate:: from the crate's root, super:: and self:: and bare names from the file's folder; one segment a round, each
    a file or a folder with mod.rs. A segment that is neither is passed over, as long as the last one is found."""
    source = imports.select("id", "module", F.split("module", "::").alias("parts"), folder_of(F.col("file")).alias("folder"), F.element_at(F.split("file", "/"), -1).alias("name"))
    roots = written(rust_crate_roots(source.select("folder").distinct(), files))
    head = F.col("parts")[0]
    base = F.when(head == "crate", F.col("root")).when((head == "super") & (F.col("name") == "mod.rs"), folder_of(F.col("folder"))).otherwise(F.col("folder"))
    told = head.isin("crate", "super", "self")
    rest = F.when(told, F.slice("parts", F.lit(2), F.size("parts"))).otherwise(F.col("parts"))
    now = source.join(roots, "folder").select("id", base.alias("base"), base.alias("at"), rest.alias("parts"), rest.alias("all"), told.alias("told"), "module")
    expected = joined(F.col("base"), F.concat(F.array_join("all", "/"), F.lit(".rs")))
    now = written(now.withColumn("expected", F.when(F.col("told"), expected).otherwise(F.col("module"))))
    known = files.select("path").distinct()
    hits = now.filter("size(parts) = 0").select("id", F.col("expected").alias("path"), F.lit(False).alias("found"))
    now = now.filter("size(parts) > 0")
    while not now.isEmpty():
        part = joined(F.col("at"), F.col("parts")[0])
        step = now.withColumn("_file", F.concat(part, F.lit(".rs"))).withColumn("_mod", joined(part, "mod.rs")).withColumn("_inside", part)
        step = step.join(known.select(F.col("path").alias("_file"), F.lit(True).alias("_f")), "_file", "left").join(known.select(F.col("path").alias("_mod"), F.lit(True).alias("_m")), "_mod", "left")
        hit = F.when(F.col("_f"), F.col("_file")).when(F.col("_m"), F.col("_mod"))
        step = written(step.withColumn("_hit", hit))
        hits = hits.unionByName(step.filter("size(parts) = 1").select("id", F.coalesce("_hit", "expected").alias("path"), F.col("_hit").isNotNull().alias("found")))
        now = step.filter("size(parts) > 1").withColumn("at", F.when(F.col("_hit").isNull(), F.col("at")).otherwise(F.col("_inside"))).withColumn("parts", F.slice("parts", F.lit(2), F.size("parts")))
        now = now.drop("_file", "_mod", "_inside", "_f", "_m", "_hit")
    return hits


IMPORTS = {"javascript": javascript_imports, "typescript": typescript_imports, "python": python_imports, "rust": rust_imports}


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with their language: each by the rules of its own."""
    there = {r[0] for r in imports.select("language").distinct().collect()} & set(IMPORTS)  # four at most
    parts = [IMPORTS[k](imports.filter(F.col("language") == k).drop("language"), files) for k in sorted(there)]
    return reduce(DataFrame.unionByName, parts) if parts else _first(imports.select("id", F.array().cast("array<string>").alias("candidates"), "module").withColumnRenamed("module", "expected").limit(0), files)


def submodules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: id, path (of the module), name. id, path: the module of that name beside it, where there is one."""
    beside = joined(folder_of(F.col("path")), F.col("name"))
    wanted = imports.select("id", F.array(F.concat(beside, F.lit(".py")), joined(beside, "__init__.py")).alias("candidates"), F.lit(None).cast("string").alias("expected"))
    return _first(wanted, files).filter("found").select("id", "path")
