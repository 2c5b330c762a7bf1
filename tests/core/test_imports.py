"""Import resolution of four languages, and facts that outlive a session."""

import json
import os

import pytest

from lucidgraph.plans.project import Project
from lucidgraph.sources import files, import_paths, storage

FILES = [
    "src/a.js", "src/b.mjs", "src/dir/index.jsx", "src/t.ts", "src/u.tsx", "src/ui/index.ts", "src/both.js", "src/both.ts",
    "pkg/__init__.py", "pkg/sub/__init__.py", "pkg/sub/m.py", "pkg/util.py", "top.py", "app/setup.py", "app/x/y/main.py", "app/lib.py", "scripts/deep/er/run.py", "scripts/help.py", "alone/alone/h.py", "alone/h.py",
    "crate/Cargo.toml", "crate/src/lib.rs", "crate/src/net/mod.rs", "crate/src/net/tcp.rs", "crate/src/io.rs", "crate/src/io/file.rs", "bin/main.rs", "bin/cfg.rs", "loose/x.rs", "loose/y.rs",
]
CASES = {
    "javascript": [("src/a.js", "./b", "src/b.mjs"), ("src/a.js", "./dir", "src/dir/index.jsx"), ("src/dir/index.jsx", "../a.js", "src/a.js"), ("src/a.js", "./none", "src/none.js"), ("src/a.js", "./none.cjs", "src/none.cjs"), ("src/a.js", "react", "react"), ("src/a.js", "./x.css", "src/x.css.js")],
    "typescript": [("src/t.ts", "./u.js", "src/u.tsx"), ("src/t.ts", "./both.js", "src/both.ts"), ("src/t.ts", "./both", "src/both.ts"), ("src/t.ts", "./a.js", "src/a.js"), ("src/t.ts", "./ui", "src/ui/index.ts"), ("src/t.ts", "./ui.js", "src/ui/index.ts"), ("src/t.ts", "./no.js", "src/no.ts"), ("src/t.ts", "./no.jsx", "src/no.tsx"), ("src/t.ts", "./no", "src/no.ts"), ("src/t.ts", "@x/y", "@x/y")],
    "python": [
        ("pkg/sub/m.py", ".", "pkg/sub/__init__.py"), ("pkg/sub/m.py", "..util", "pkg/util.py"), ("pkg/sub/m.py", ".gone", "pkg/sub/gone.py"), ("pkg/sub/m.py", "pkg.util", "pkg/util.py"), ("pkg/sub/m.py", "top", "top.py"), ("pkg/util.py", "sub.m", "pkg/sub/m.py"),
        ("app/x/y/main.py", "lib", "app/lib.py"), ("app/x/y/main.py", "no.mod", "app/no/mod.py"), ("scripts/deep/er/run.py", "help", "scripts/help.py"), ("scripts/deep/er/run.py", "top", "top.py"), ("alone/alone/h.py", "alone.h", "alone/alone/h.py"), ("alone/h.py", "zzz", "alone/zzz.py"),
    ],
    "rust": [
        ("crate/src/net/tcp.rs", "crate::io::file", "crate/src/io/file.rs"), ("crate/src/net/mod.rs", "super::io", "crate/src/io.rs"), ("crate/src/net/tcp.rs", "super::mod", "crate/src/net/mod.rs"), ("crate/src/lib.rs", "self::net::tcp", "crate/src/net/tcp.rs"), ("crate/src/lib.rs", "net", "crate/src/net/mod.rs"),
        ("bin/main.rs", "cfg", "bin/cfg.rs"), ("bin/main.rs", "serde::Deserialize", "serde::Deserialize"), ("bin/main.rs", "crate::no::one", "bin/no/one.rs"), ("loose/x.rs", "crate::y", "loose/y.rs"), ("bin/main.rs", "crate::skip::cfg", "bin/cfg.rs"),
    ],
}


@pytest.mark.parametrize("language", CASES)
def test_imports(spark, language):
    known = spark.createDataFrame([(f,) for f in FILES], "path string")
    asked = spark.createDataFrame([(i, f, m, language) for i, (f, m, _) in enumerate(CASES[language])], "id int, file string, module string, language string")
    got = {r.id: (r.path, r.found) for r in import_paths.import_targets(asked, known).collect()}
    assert got == {i: (want, want in FILES) for i, (_, _, want) in enumerate(CASES[language])}


def test_store(spark, tmp_path):
    code = {"a.py": "def f():\n    pass\n", "b.py": "from a import f\ndef g():\n    f()\n", "c.py": ""}
    load = lambda now: files.with_header(spark.createDataFrame(list(now.items()), "path string, content string"))
    store = storage.FactStore(spark, str(tmp_path / "facts"))
    assert store.manifest().count() == 0 and store.facts()["scope"].count() == 0 and store.tree_hash() is None
    Project(load(code)).save(store, git_tree_hash="t1")
    assert {r.path for r in store.manifest().collect()} == {"a.py", "b.py"} and store.tree_hash() == "t1"
    now = code | {"b.py": "def h():\n    pass\n", "d.py": "x = 1\n"}
    del now["c.py"]
    facts, state = store.restore(load(now))
    assert {r.path: r.state for r in state.collect()} == {"a.py": "hit", "b.py": "stale", "d.py": "new"}
    whole = files.extract_facts(load(now))
    for k in storage.schema.FACT_TABLES:
        assert sorted(map(repr, facts[k].collect())) == sorted(map(repr, whole[k].select(*facts[k].columns).collect()))
    Project(load(now), facts).save(store)
    assert {r.path for r in store.manifest().collect()} == {"a.py", "b.py", "d.py"} and len([x for x in os.listdir(tmp_path / "facts") if x.startswith("facts-")]) == 1
    (tmp_path / "facts" / "manifest.json").write_text("{broken")
    os.remove(tmp_path / "facts" / ".manifest.json.crc")
    assert store.manifest().count() == 0
    store.clear()
    assert not (tmp_path / "facts").exists()


def test_cache_dir(monkeypatch, tmp_path):
    monkeypatch.setenv("LUCIDGRAPH_CACHE_DIR", " Off ")
    assert storage.cache_dir("/x") is None
    monkeypatch.setenv("LUCIDGRAPH_CACHE_DIR", str(tmp_path))
    assert storage.cache_dir("/x") == str(tmp_path)
    monkeypatch.delenv("LUCIDGRAPH_CACHE_DIR")
    assert storage.cache_dir("/w/My Project!").split("/")[-1].startswith("my-project-") and storage.cache_dir("/a/x") != storage.cache_dir("/b/x")


def test_facts_from_json(spark, tmp_path):
    spot = {"start_line": 1, "start_column": 1, "end_line": 1, "end_column": 9}
    doc = {"scope": [{"scope_id": "module:a.ts:1:1:9:1", "file_path": "a.ts", "name": "<module>", "type": "module", "ord": 1, **spot}], "definition": [{"symbol_id": "function:a.ts:1:1:1:9:f", "kind": "function", "name": "f", "file_path": "a.ts", "ord": 2, "is_exported": True, "parameters": [{"name": "x", "type": "number", "optional": False}], **spot}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{}")
    got = files.read_facts(spark, str(tmp_path))
    assert got["scope"].first().type == "module" and got["definition"].first().parameters[0].name == "x" and got["reference"].count() == 0


def test_gitignore(spark, tmp_path):
    assert files.parse_gitignore(spark, str(tmp_path / ".gitignore")) == []
    (tmp_path / "ignored").write_text("# c\n\n out/ \nfoo*\n")
    assert files.parse_gitignore(spark, str(tmp_path / "ignored")) == ["out/", "foo*"]
