"""Patterns, names, verbs, extraction, configuration, projects, states and snapshots on small fixtures."""

import ast
import hashlib
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quernel.functions import names, patterns
from quernel.operators import catalog, config, diffs, extract, graph, paging, project, search, states
from quernel.plans import response
from quernel.plans.api import Engine, RangeError, ReplayError, parse_target
from quernel.sources import archive, scip, workspace
from quernel.streaming import events

FILES = [
    ("src/a.py", "python", "class Box:\n    def open(self):\n        return helper(1)\n\ndef helper(v):\n    return v\n"),
    ("src/b.py", "python", "x = helper(2)\nhelper_two = 3\nHELPER = helper\n"),
    ("lib/c.go", "go", "package c\nfunc Run() { work(1) }\nfunc work(n int) int { return n }\n"),
    ("docs/é.md", "markdown", "caf\u00e9 a.b acb\nE é\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(*f, len(f[2])) for f in FILES], "path string, language string, content string, size long")


@pytest.fixture(scope="module")
def engine(files):
    return Engine(files, grams=catalog.gram_index(files))


def test_patterns():
    assert patterns.wildcard_regex("a*b?", "content") == r"a[^\n]*b[^\n]" and patterns.glob_regex("**/*.rs") == "^(?s:(?:.*/)?.*\\.rs)$"
    for bad in ("(", "(?=x)", r"(a)\1", "(?<!x)"):
        with pytest.raises(patterns.PatternError):
            patterns.Pattern(bad, "regex")
    assert patterns.broad_reason("files", "**/*") == "broad_path_pattern" and patterns.broad_reason("find", "x") and not patterns.broad_reason("find", "needle")
    assert patterns.broad_reason("grep", ".+", "regex") == "broad_regex_pattern" and patterns.broad_reason("refs", " export ") == "broad_literal_pattern"
    for free in ("data", "def", "Class", "get", "name", "test"):
        assert patterns.broad_reason("find", free) is None


def test_find_modes(engine):
    rows = lambda p: [(r.path, r.line, r.column) for r in p.results.collect()]
    assert len(rows(engine.find("a.b"))) == 1 and len(rows(engine.grep("a.b"))) == 2
    assert len(rows(engine.find("HELPER"))) == 6 and len(rows(engine.find("HELPER", case_sensitive=True))) == 1
    assert [r[2] for r in rows(engine.find("é"))] == [4, 3]
    assert rows(engine.grep("b*", scope=search.Scope(dirs=("docs",)))) != [] and rows(engine.find("nothing here")) == []
    assert engine.find("nothing").exit_code == 2


def test_refs_and_definitions(engine):
    refs = engine.refs("helper").results.collect()
    assert len(refs) == 5 and {(r.path, r.line): r.role for r in refs}[("src/a.py", 5)] == "definition"
    assert [r.path for r in engine.defs("helper").results.collect()] == ["src/a.py"] and engine.symbols("o", limit=0).total >= 3
    assert [r.callee for r in engine.calls("Run").results.collect()] == ["work"] and [r.caller for r in engine.callers("helper").results.collect()] == ["open"]


def test_pages_and_cursors(engine):
    one = engine.find("helper", limit=2, allow_broad=True)
    two = engine.find("helper", limit=2, allow_broad=True, cursor=one.next_cursor)
    seen = [(r.path, r.line, r.column) for p in (one, two) for r in p.results.collect()]
    assert one.truncated and len(set(seen)) == 4
    with pytest.raises(paging.CursorError):
        engine.find("helper", limit=3, cursor=one.next_cursor)
    broad = engine.find("e")
    assert broad.guard == "broad_literal_pattern" and broad.results.count() == 5 and broad.next_cursor is None
    assert paging.preview_chars(1, 1, 1) == 240 and paging.preview_chars(30, 1, 1) == 160 and paging.preview_chars(300, 1, 1) == 96


def test_paths_browse_read(engine):
    assert [r.path for r in engine.glob("src/*.py").results.collect()] == ["src/a.py", "src/b.py"]
    assert {r.path for r in engine.list().collect()} == {"src", "lib", "docs"}
    assert engine.read("src/a.py:2-3").first().content == "    def open(self):\n        return helper(1)" and engine.read("src/b.py:3-99").first().end == 3
    for bad in ("a:0", "a:3-2", "/etc/x", "../x"):
        with pytest.raises(RangeError):
            parse_target(bad)
    with pytest.raises(Exception, match="past the end"):
        engine.read("src/a.py:50").collect()


def test_names():
    assert names.style_key("getHTTPName") == "get_httpname" and names.style_key("-a1B--cD_") == "a1_b_c_d" and names.qualified_tail("a.B::run(x)") == "run(x)"
    found = names.variants(" pkg.Foo.bar(int) ")
    assert found[:5] == [(" pkg.Foo.bar(int) ", "raw"), ("pkg.Foo.bar(int)", "trimmed"), ("pkg.Foo.bar", "signature_base"), ("bar(int)", "qualified_tail"), ("bar", "signature_tail")]
    assert ("pkg_foo_bar", "style_key") in found and ("bar", "case_fold") in found and len(found) <= 13 and len(set(found)) == len(found)
    assert [names.needs_expansion(x) for x in ("Foo", "foo_bar", "a-b", " x", "f()", "a.b", "fooBar")] == [False, True, True, True, True, True, False]
    assert names.scip_symbol("s", "m", "p", "1", [names.Descriptor("a b", "type"), names.Descriptor("f", "method", "+1")]) == "s m p 1 `a b`#f(+1)."
    assert names.like_method("a_b") == r"a\_b(%" and names.last_identifier("x.y()") == "y"


def test_extraction():
    rows = list(extract.python_candidates(FILES[0][2]))
    assert [(r[0], r[2]) for r in rows] == [("class", "Box"), ("method", "open"), ("call", "helper"), ("definition", "helper")]
    java = list(extract.brace_candidates("import a.B;\nclass A {\n  public A() { go(); }\n  int f(int x) { return g(x); }\n}\n", "java"))
    assert {(r[1], r[2]) for r in java} >= {("import", "B"), ("class", "A"), ("function", "f"), ("call", "g"), ("call", "go")}
    assert {(r[2], r[7]) for r in java if r[0] == "call"} == {("go", "A"), ("g", "f")}
    assert list(extract.python_candidates("def (")) == []


def test_extraction_of_a_large_file():
    """Bodies are cut by offsets: time in proportion to the file, and the same digests as cutting the whole text again for each."""
    odd = "s = 'é\f'\r\nclass É:\r    def f(self): return 'é'; x = 1\n\f\ndef g(\n  a):\n    def h(): return '''é\n'''\n    return h"
    bodies = {n.name: ast.get_source_segment(odd, n) for n in ast.walk(ast.parse(odd)) if hasattr(n, "name")}
    assert {r[2]: r[8] for r in extract.python_candidates(odd) if r[8]} == {k: hashlib.sha256(v.encode()).hexdigest()[:16] for k, v in bodies.items()} and len(bodies) == 4
    began = time.time()
    rows = list(extract.python_candidates("".join(f"def f_{k}(x):\n    return g(x)\n" for k in range(10_000))))
    assert len(rows) == 20_000 and len({r[8] for r in rows if r[0] == "definition"}) == 10_000 and time.time() - began < 10


def test_config(spark):
    rows = [("a.json", '{"db": {"password": "x", "port": 5, "l": [1]}}'), ("b.toml", "[t]\nk = 1\n"), ("c.yaml", "a:\n  b: 1\n  items:\n  - n: x\n"), ("d.ini", "[s]\nk=v\n"), ("Dockerfile", "FROM x\nRUN y z\n"), ("Makefile", "all: x\n\tgo build\n"), ("e.sh", "#!/bin/sh\nf() {\n}\nA=1\nls -l\n"), ("bad.json", "{")]
    found = config.extract(spark.createDataFrame(rows, "path string, content string")).collect()
    by = {(r.path, r.key_path): r for r in found}
    assert by["a.json", "db.password"].preview == "***" and by["a.json", "db.port"].preview == "5" and ("a.json", "db.l[0]") in by
    assert ("b.toml", "t.k") in by and ("c.yaml", "a.b") in by and ("d.ini", "s.k") in by and ("Dockerfile", "RUN") in by
    assert {r.kind for r in found if r.path == "e.sh"} == {"entrypoint", "shell_function", "env_var", "shell_command"} and by["bad.json", None].kind == "source_fallback"


def test_project(spark):
    paths = ["go.mod", "svc/go.mod", "svc/main.go", "main.go", "web/package.json", "web/tsconfig.json", "web/x.gen.ts", "go.work", "Makefile", "svc/Dockerfile"]
    from quernel.functions.text import language_of

    f = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("language", language_of(F.col("path")))
    roots = project.discover_roots(f)
    assert {r.root_id: r.kind for r in roots.collect()} == {"go:.": "go_module", "go:svc": "go_module", "typescript:web": "typescript"}
    own = {r.path: (r.root_id, r.generated) for r in project.owners(f, roots).collect()}
    assert own["svc/main.go"] == ("go:svc", False) and own["main.go"][0] == "go:." and own["web/x.gen.ts"] == ("typescript:web", True)
    edges = {r.path: r for r in project.config_edges(f, roots).collect()}
    assert edges["Makefile"].all_roots and "svc/Dockerfile" not in edges and edges["go.work"].affected == ["go:."]
    more = spark.createDataFrame([(p,) for p in ("svc/go.sum", "web/yarn.lock", "lib/x.yml", "config/a.ini", "x.toml", "web/Cargo.lock")], "path string")
    got = {r.path: (r.kind, r.root_id, r.all_roots, r.unresolved) for r in project.config_edges(more, roots).collect()}
    assert got["svc/go.sum"] == ("dependency", "go:svc", False, False) and got["web/yarn.lock"][1] == "typescript:web" and got["web/Cargo.lock"][1] == "typescript:web"
    assert got["lib/x.yml"] == ("runtime", "go:.", False, False) and got["config/a.ini"][2] and got["x.toml"][2]
    env = {r.path: r.kind for r in project.environment_edges(spark.createDataFrame([(p,) for p in ("svc/Dockerfile", "a/.env.dev", "k8s/x.yml", "docker-compose.yaml", "env")], "path string"), roots).collect()}
    assert env == {"svc/Dockerfile": "container", "a/.env.dev": "dot_env", "k8s/x.yml": "kubernetes", "docker-compose.yaml": "compose"}
    none = project.discover_roots(f.limit(0))
    assert project.config_edges(more, none).where("not unresolved").count() == 0 and project.caveats(project.config_edges(more, none)).count() == 6
    assert {r.kind for r in project.dependency_edges(f, roots).collect()} == {"build_affects_root", "automation_affects_root", "environment_affects_root", "root_depends_on_root"}
    assert [(r.from_root, r.to_root) for r in project.root_edges(f, roots).collect()] == [("go:.", "go:svc")]


def test_events_and_states(spark):
    rows = [(1, "a", "create"), (2, "a", "modify"), (3, "a", "remove"), (4, "b", "modify"), (5, "c", "remove"), (6, "c", "create"), (7, "d", "rename"), (8, "d", "remove"), (9, "e", "create"), (10, "e", "remove"), (11, "f", "rename_to"), (12, "f", "touch")]
    df = spark.createDataFrame([(s, p, k, "old" if k == "rename" else None) for s, p, k in rows], "seq long, path string, kind string, previous_path string")
    assert {r.path: (r.state, r.previous_path) for r in events.fold(df).collect()} == {"a": ("modified", None), "b": ("modified", None), "c": ("deleted", None), "d": ("renamed", "old"), "f": ("added", None)}
    r = random.Random(1)
    many = [(k, f"p{r.randrange(40)}", r.choice(events.KINDS)) for k in range(1500)]
    state = {}
    for _, p, k in many:
        state[p] = events.step(state.get(p), k)
    df = spark.createDataFrame([(s, p, k, None) for s, p, k in many], "seq long, path string, kind string, previous_path string")
    assert {r.path: r.state for r in events.fold(df).collect()} == {p: s for p, s in state.items() if s}
    one = spark.range(300_000).select(F.col("id").alias("seq"), F.lit("x").alias("path"), F.when(F.col("id") % 2 == 0, "create").otherwise("remove").alias("kind"), F.lit(None).cast("string").alias("previous_path"))
    assert events.fold(one).count() == 0 and events.fold(one.where("seq < 299999")).first().state == "added"
    assert states.TRANSITIONS["retrying"] == ("ready", "partial") and sum(map(len, states.TRANSITIONS.values())) == 13
    m = spark.createDataFrame([("r", "go", "p", "fresh"), ("s", "go", "p", "stale")], "root_id string, language string, provider string, state string")
    assert states.gate(m).first().allows_precise is False and states.gate(states.query_manifests(m, root="r")).first().allows_precise is True
    assert states.semantic_budget_ms(0, 9) == 60_000 and states.semantic_budget_ms(1, 10) == 250_000


def test_snapshots(spark, files, tmp_path):
    e = Engine(files, snapshot="commit:abc")
    e.build(str(tmp_path))
    assert e.verify(str(tmp_path))[1] == 0
    changed = Engine(files.where("path <> 'lib/c.go'"), snapshot="commit:abc")
    diff, code = changed.verify(str(tmp_path))
    assert code == 6 and [tuple(r) for r in diff.collect()] == [("lib/c.go", "deleted")]
    scanned = catalog.scan(spark.createDataFrame([("a.rs", b"x"), ("target/b.rs", b"x"), ("c.bin", b"a\0b"), ("d", None)], "path string, content binary"))
    assert tuple(catalog.summary(scanned).first()) == (4, 1, 1, 1, 1) and catalog.included(scanned).first().language == "rust"


def test_scip(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text('{"documents": [{"relativePath": "a.go", "language": "go", "occurrences": [{"range": [0, 5, 8], "symbol": "s/Foo#", "symbolRoles": 1}, {"range": [2, 1, 3, 4], "symbol": "s/Foo#", "symbolRoles": 0}, {"range": [1, 0, 2], "symbol": "local 1"}], "symbols": [{"symbol": "s/Foo#", "displayName": "Foo", "kind": "Class"}]}]}')
    occ = graph.read_scip_json(spark, str(p)).cache()
    d = graph.occurrences_of(occ, "Foo", "definition").collect()
    assert [(r.line, r.column, r.end_line, r.end_column, r.kind) for r in d] == [(1, 6, 1, 9, "class")]
    assert [(r.line, r.end_line) for r in graph.precise(occ, "foo", "reference").collect()] == [(3, 4)]
    assert occ.where("symbol = 'local 1'").first().symbol_key == "a.go::local 1"


def test_workspace(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a").write_text("1")
    run("add", "a")
    run("commit", "-qm", "x")
    assert workspace.Workspace.open(str(tmp_path)).snapshot_id().startswith("commit:")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").write_text("3")
    assert {r.path: r.change_kind for r in workspace.git_status(spark, str(tmp_path)).collect()} == {"a": "unstaged", "b": "untracked"}
    assert [bytes(r.content) for r in workspace.staged_files(spark, str(tmp_path)).collect()] == [b"1"]
    workspace.save_query(str(tmp_path / "q"), "n", "find", {"text": "x"}, "s")
    assert workspace.load_query(str(tmp_path / "q"), "n")["args"] == {"text": "x"} and workspace.list_queries(str(tmp_path / "q")) == ["n"]


def test_scip_bytes(spark, tmp_path):
    two = scip.encode("a.go", "go", [{"range": [0, 5, 300], "symbol": "s/Foo#", "symbolRoles": 1}, {"range": [2, 1, 3, 4], "symbol": "local 1", "symbolRoles": 0}], [{"symbol": "s/Foo#", "kind": "7", "displayName": "Foo"}]) + scip.encode("b.go", "go", [], [])
    assert [d[0] for d in scip.decode(two)] == ["a.go", "b.go"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.scip").write_bytes(two)
    rows = {r.symbol: r for r in scip.read_scip(spark, str(tmp_path / "i")).collect()}
    assert (rows["s/Foo#"].line, rows["s/Foo#"].column, rows["s/Foo#"].end_column, rows["s/Foo#"].kind, rows["s/Foo#"].role) == (1, 6, 301, "class", "definition")
    assert (rows["local 1"].symbol_key, rows["local 1"].end_line, rows["local 1"].role) == ("a.go::local 1", 4, "reference")
    for bad in (two[:-3], b"\x0f", b"\x12\xff"):
        with pytest.raises(scip.ScipError):
            list(scip.decode(bad))
    fact = ("a.go", "go", 1, 2, 1, 3, "s", "S", "class", "definition", "provider_confirmed")
    schema = "path string, language string, start_line long, start_column long, end_line long, end_column long, symbol string, display_name string, kind string, role string, reliability string"
    made = scip.index_rows(spark.createDataFrame([fact, fact, (*fact[:10], "parser_fallback")], schema)).collect()
    assert len(made) == 1 and [len(d[2]) for d in scip.decode(bytes(made[0].document))] == [1]
    for wrong in ((fact[0], "rust", *fact[2:]), (*fact[:4], 0, 9, *fact[6:])):
        with pytest.raises(Exception, match="mixed languages|precedes"):
            scip.index_rows(spark.createDataFrame([fact, wrong], schema)).collect()
    (tmp_path / "l.json").write_text('{"path": "x.py", "language": "python", "symbols": [{"name": "A", "kind": 5, "range": {"start": {"line": 0, "character": 0}, "end": {"line": 3, "character": 0}}, "children": [{"name": "f", "kind": 6, "range": {"start": {"line": 1, "character": 4}, "end": {"line": 2, "character": 0}}}]}]}\n')
    assert [(r.name, r.kind, r.line, r.symbol) for r in scip.read_lsp(spark, str(tmp_path / "l.json")).orderBy("line").collect()] == [("A", "class", 1, "lsp x.py/A#"), ("f", "method", 2, "lsp x.py/A.f#")]


def test_archives(spark, files, tmp_path):
    top = str(tmp_path)
    Engine(files, snapshot="commit:a").build(f"{top}/i")
    archive.pack(spark, f"{top}/i", "commit:a", f"{top}/p", {"lang": ["go"]})
    assert archive.unpack(spark, f"{top}/p", f"{top}/j") == "commit:a"
    with pytest.raises(archive.ArchiveError, match="already exists"):
        archive.unpack(spark, f"{top}/p", f"{top}/j")
    assert archive.fallback(spark, f"{top}/j", "commit:b", "catalog", {"lang": ["go"]}).count() == 4 and archive.fallback(spark, f"{top}/j", "commit:b", "catalog") is None
    assert [r.snapshot_id for r in archive.remote_snapshots(spark, f"{top}/j").collect()] == ["commit:a"] and archive.fallback(spark, f"{top}/i", "commit:a", "catalog").first().source == "local"
    part = next((tmp_path / "p" / "data" / "catalog").glob("*.parquet"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    with pytest.raises(archive.ArchiveError, match="checksum mismatch"):
        archive.unpack(spark, f"{top}/p", f"{top}/k")


def test_engine_over_a_stored_index(spark, files, tmp_path):
    top = str(tmp_path / "i")
    e = Engine(files, snapshot="s")
    assert e.index_status(top) == {"exists": False, "fresh": False, "reason": "index_missing"} and e.update(top)["updated"]
    assert e.update(top)["reason"] == "index_fresh" and e.skipped(top).count() == 0
    moved = files.where("path <> 'lib/c.go'").withColumn("content", F.when(F.col("path") == "src/b.py", "new needle\n").otherwise(F.col("content")))
    now = Engine.open(moved.unionByName(spark.createDataFrame([("n.py", "python", "needle helper", 13)], files.schema)), top, "s")
    assert {(r.path, r.source_reason) for r in now.find("needle", limit=0).results.collect()} == {("src/b.py", "live_overlay"), ("n.py", "live_overlay")}
    assert {(r.path, r.source_reason) for r in now.find("helper", limit=0).results.collect()} == {("src/a.py", "index"), ("n.py", "live_overlay")}
    assert now.reconciled(top).count() == 3 and now.clean(top) and not now.index_status(top)["exists"]
    scoped = Engine(files, changed_paths=files.where("path like 'src%'").select("path"))
    assert {r.path for r in scoped.find("e", scope=search.Scope(changed=True), allow_broad=True, limit=0).results.collect()} == {"src/a.py", "src/b.py"}
    with pytest.raises(search.ScopeError):
        Engine(files).find("x", scope=search.Scope(changed=True))
    with pytest.raises(search.ScopeError):
        search.Scope(dirs=("../x",))
    assert {r.path for r in scoped.defs("helper", scope=search.Scope(dirs=("lib",))).results.collect()} == set()


def test_batches_and_replay(engine):
    q = [diffs.BatchQuery("b", "find", {"text": "helper"}, ("a",)), diffs.BatchQuery("a", "defs", {"name": "helper"})]
    assert list(engine.batch(q)) == ["a", "b"] and engine.batch(q)["a"].total == 1
    for bad in ([q[0]], [q[1], q[1]], [diffs.BatchQuery("a", "find", {}, ("b",)), diffs.BatchQuery("b", "find", {}, ("a",))]):
        with pytest.raises(ValueError, match="no query|one name|wait"):
            diffs.batch_order(bad)
    saved = {"name": "q", "verb": "find", "args": {"text": "helper", "scope": {"dirs": ["src"]}, "cursor": "v1:x:1"}, "snapshot": "commit:old"}
    page = engine.replay(saved)
    assert page.total > 0 and "replay_snapshot_mismatch" in page.caveats
    with pytest.raises(ReplayError):
        engine.replay(saved, strict=True)
    assert diffs.query_limit(0) == (1000, True) and diffs.query_limit(5) == (5, False) and diffs.query_limit(5000) == (1000, True)


def test_responses(engine):
    none = response.envelope("defs", {"name": "nothing"}, "s", "parser_fact", engine.defs("nothing"))
    assert none["warnings"][0]["code"] == "no_match" and [a["verb"] for a in none["nextActions"]] == ["find", "symbols", "defs"] and {c["code"]: c["severity"] for c in none["caveats"]} == {"no_match": "warning", "parser_fact": "info"}
    some = response.envelope("find", {"text": "helper"}, "s", "source_fact", engine.find("helper", limit=2))
    assert some["nextCursor"] and not some["truncated"] and "producer" not in some["results"][0] and some["suggestedReads"][0].startswith("src/a.py:")
    broad = response.envelope("find", {"text": "e"}, "s", "source_fact", engine.find("e"))
    assert broad["truncated"] and broad["caveats"][-1]["code"] == "broad_query_guard" and len(broad["results"]) == 5
    assert response.stable_code("precise_scip_index_unavailable; x") == "precise_scip_index_unavailable" and response.stable_code("Some Thing-x: y") == "some_thing_x"


def test_shapes_that_were_quadratic(spark):
    from quernel.functions import text as t

    df = spark.createDataFrame([("a\n" * 20000,), ("",), ("é\nx",), ("\n",)], "c string")
    got = [r.o for r in df.select(t.line_offsets(F.col("c")).alias("o")).collect()]
    assert got[0] == list(range(0, 40000, 2)) and got[1:] == [[], [0, 3], [0]]
    hits = spark.createDataFrame([("é the " * 5000,)], "c string").select(F.explode(search.hits_of(F.col("c"), "the")).alias("h")).select("h.at").collect()
    assert [r.at for r in hits] == list(range(2, 30000, 6))
    line = spark.createDataFrame([("aé\U0001f600b", 3, 1), ("aé\U0001f600b", 7, 4), ("aé\U0001f600b", 2, 3), ("", 0, 0)], "s string, b int, u int")
    assert [(r.x, r.y) for r in line.select(t.bytes_to_chars(F.col("s"), F.col("b")).alias("x"), t.utf16_to_chars(F.col("s"), F.col("u")).alias("y")).collect()] == [(2, 1), (3, 3), (None, None), (0, 0)]


def test_nested_definitions(spark):
    r = random.Random(3)
    defs = [("p", f"d{k}", a, a + r.randint(0, 60)) for k, a in enumerate(r.randrange(200) for _ in range(40))]
    refs = [("p", r.randrange(-5, 300)) for _ in range(120)] + [("q", 1)]
    got = {(x.path, x.pos): x.enclosing for x in graph.enclosing(spark.createDataFrame(refs, "path string, pos long"), spark.createDataFrame(defs, "path string, name string, pos long, until long")).collect()}
    for path, pos in refs:
        before = [d for d in defs if path == "p" and d[2] <= pos]
        best = max(before, key=lambda d: (d[3] >= pos, d[2], -d[3], d[1]), default=None)
        assert got[path, pos] == (best[1] if best else None)
