"""Readers on written files: a tree, a repository, manifests, settings, tools, logs and their stream."""

import json
import os
import subprocess

import pytest

from graphweft.operators import extract, routers
from graphweft.sources import commands, git, manifests, records, settings, stores, tools, tree
from graphweft.sources.files import read_texts
from graphweft.streaming import logs


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")

    def put(path, text):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("Cargo.toml", '[workspace]\nmembers = ["a", "b"]\n[workspace.dependencies]\nb = { path = "b" }\n')
    put("a/Cargo.toml", '[package]\nname = "a"\nversion = "0.1.0"\nedition = "2021"\n[dependencies]\nb = { workspace = true }\n[dev-dependencies]\nq = "1"\n[[bin]]\nname = "tool"\npath = "src/tool.rs"\n')
    put("a/src/lib.rs", "/// Adds.\npub fn add(a: i32) -> i32 { b::one() + a }\n#[test]\nfn works() {}\n")
    put("a/src/tool.rs", "fn main() { run(); }\n")
    put("a/tests/it.rs", "#[test]\nfn it() {}\n")
    put("b/Cargo.toml", '[package]\nname = "b"\nversion = "0.2.0"\n')
    put("b/src/lib.rs", "pub fn one() -> i32 { 1 }\n")
    put("bad/Cargo.toml", "[package\n")
    put("img/x.png", b"\x89PNG")
    put("img/raw.bin", b"ab\0cd")
    put("big.txt", "x" * 1_500_001)
    put(".gitignore", "# Build\n/out/\n*.tmp\n")
    put("out/o.txt", "o")
    put("n.tmp", "t")
    put("cache/CACHEDIR.TAG", "Signature: 8a477f597d28d172789f06886806bc55\n")
    put("cache/deep/file", "1234")
    put("fake/CACHEDIR.TAG", "no")
    put("fake/inner.txt", "x")
    put("schema/s.json", json.dumps({"$schema": "x", "title": "S", "type": "object", "required": ["a"], "properties": {"a": {"type": "string", "format": "date"}, "b": {"$ref": "#/$defs/c"}}, "$defs": {"c": {}}}))
    put("Makefile", "## top\nall: x ## Everything\n\tcc\n")
    put("justfile", "set shell := []\n# Go\nrun arg:\n  x\n")
    put("web/package.json", '{\n "name": "web",\n "scripts": {"dev": "vite"}\n}')
    put(".github/workflows/ci.yml", "name: CI\non: push\njobs:\n  build:\n    runs-on: x\n  test:\n    needs: build\n")
    put(".cargo/config.toml", '[alias]\nxt = ["run", "--package", "a", "--"]\n')
    os.symlink("a", root / "link")
    return root


def test_tree_keeps_every_entry(spark, project):
    rows = {r["path"]: r for r in tree.scan_tree(spark, str(project), ignored=["out/"]).collect()}
    assert rows["img/x.png"]["kind"] == "Image" and rows["img/raw.bin"]["kind"] == "Binary" and rows["big.txt"]["kind"] == "TooLarge"
    assert rows["link"]["kind"] == "Symlink" and "link/src" not in rows and rows["a/src/lib.rs"]["kind"] == "Text"
    assert rows["out"]["heavy"] == "ignored" and "out/o.txt" not in rows
    assert rows["cache"]["heavy"] == "build cache" and "cache/deep" not in rows and rows["fake"]["heavy"] is None and "fake/inner.txt" in rows
    inner = {r["path"] for r in tree.load_folder(spark, str(project), "cache").collect()}
    assert inner == {"cache/CACHEDIR.TAG", "cache/deep", "cache/deep/file"}
    entries = tree.scan_tree(spark, str(project))
    assert tree.disk_usage(entries).first()[0] > 0
    assert tree.tree_fingerprint(entries) == tree.tree_fingerprint(entries.repartition(3))


def test_runner_runs_what_is_listed(tmp_path):
    runner = commands.Runner()
    for words in (["git", "push"], ["rm", "x"], ["git", "worktree", "add", "x"], ["cargo", "build"]):
        with pytest.raises(commands.NotAllowed):
            runner.run(words, str(tmp_path))
    runner.cancel()
    with pytest.raises(subprocess.CalledProcessError):
        runner.run(["git", "status"], str(tmp_path))


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    env = os.environ | {f"GIT_{who}_{what}": value for who in ("AUTHOR", "COMMITTER") for what, value in (("NAME", "Ann"), ("EMAIL", "ann@x.org"), ("DATE", "2024-01-02T03:04:05Z"))}

    def run(*words):
        subprocess.run(["git", *words], cwd=root, check=True, env=env, capture_output=True)

    run("init", "-q", "-b", "main")
    (root / "src").mkdir()
    (root / "src/a.txt").write_text("1\n2\n3\n4\n5\n")
    (root / "b.bin").write_bytes(b"\0\1")
    (root / ".gitattributes").write_text("src/a.txt linguist-generated\n")
    (root / ".gitignore").write_text("*.tmp\nskip/\n")
    run("add", "-A")
    run("commit", "-qm", "First\n\nCo-authored-by: Bob Lee <bob@x.org>")
    run("mv", "src/a.txt", "src/c.txt")
    run("commit", "-qm", "Move")
    run("branch", "slice/T-1")
    (root / "x.tmp").write_text("t")
    (root / "skip").mkdir()
    (root / "skip/f").write_text("s")
    (root / "new.txt").write_text("n")
    (root / "b.bin").write_bytes(b"\0\2")
    return root


def test_git_tables(spark, repository):
    runner, root = commands.Runner(), str(repository)
    assert sorted(r["branch"] for r in git.read_branches(spark, runner, root).collect()) == ["main", "slice/T-1"]
    commits = git.read_commits(spark, runner, root)
    rows = commits.orderBy("pos").collect()
    assert [r["subject"] for r in rows] == ["Move", "First"] and rows[1]["co_authors"] == ["Bob Lee"] and rows[0]["time"] == 1704164645
    assert [tuple(r) for r in git.co_author_counts(commits).collect()] == [("Bob Lee", 1)]
    moved = git.read_commit_files(spark, runner, root, rows[0]["commit"]).collect()
    assert [(r["path"], r["old_path"], r["added"], r["deleted"]) for r in moved] == [("src/c.txt", "src/a.txt", 0, 0)]
    first = {r["path"]: r["added"] for r in git.read_commit_files(spark, runner, root, rows[1]["commit"]).collect()}
    assert first["src/a.txt"] == 5 and first["b.bin"] is None
    touched = git.read_touched(spark, runner, root)
    assert {(r["commit"], r["path"]) for r in touched.collect()} >= {(rows[0]["commit"], "src/c.txt"), (rows[1]["commit"], "b.bin")}
    assert git.read_worktrees(spark, runner, root).first()["branch"] == "main"
    ignored = {r["path"]: (r["line"], r["pattern"]) for r in git.read_ignored(spark, runner, root).collect()}
    assert ignored == {"skip/": (2, "skip/"), "x.tmp": (1, "*.tmp")}
    status = git.read_status(spark, runner, root).first()
    assert (status["modified"], status["untracked"], status["added"]) == (1, 1, 0)
    assert git.read_attributes(spark, runner, root).collect() == []
    assert git.read_head(str(repository / "src")) == ("main", rows[0]["commit"])


def test_packages_and_their_graph(spark, project):
    files = read_texts(spark, str(project), "Cargo.toml")
    packages = manifests.cargo_packages(files).cache()
    assert packages.where("error is not null").select("path").first()[0] == "bad/Cargo.toml"
    shared = manifests.workspace_deps(files)
    deps = manifests.package_deps(packages.where("error is null").unionByName(shared.where("error is null")))
    got = {(r["package"], r["name"], r["kind"], r["path"]) for r in deps.collect()}
    assert got == {("a", "b", "normal", "b"), ("a", "q", "dev", None)}
    paths = tree.scan_tree(spark, str(project)).select("path")
    found = {(r["package"], r["kind"], r["root"]) for r in manifests.discovered_targets(packages.where("error is null"), paths).collect()}
    assert found == {("a", "bin", "a/src/tool.rs"), ("a", "lib", "a/src/lib.rs"), ("a", "test", "a/tests/it.rs"), ("b", "lib", "b/src/lib.rs")}
    graph = manifests.crate_graph(packages.where("error is null"), deps).collect()
    assert [(r["package"], r["extern"], r["local"], r["gated"]) for r in graph] == [("a", "b", True, False)]
    answer = {"packages": [{"name": "a", "version": "9", "edition": "2024", "targets": [], "dependencies": [{"name": "z", "rename": "y", "kind": None}]}]}
    told = manifests.metadata_packages(spark.createDataFrame([("m", json.dumps(answer))], "path string, text string"))
    both = {r["package"]: r["version"] for r in manifests.with_fallback(told, packages).collect()}
    assert both == {"a": "9", "b": "0.2.0"}
    assert manifests.other_packages(read_texts(spark, str(project), "package.json")).first()["package"] == "web"


def test_settings_and_schemas(spark, project):
    facts = {(r["section"], r["key"], r["value"], r["line"]) for r in settings.settings_facts(read_texts(spark, str(project), "Cargo.toml")).where("path = 'a/Cargo.toml'").collect()}
    assert ("package", "edition", "2021", 4) in facts
    shape = settings.schema_shapes(read_texts(spark, str(project), "*.json")).where("title = 'S'").first()
    assert (shape["properties"], shape["required"], shape["definitions"], shape["refs"], shape["formats"]) == (2, 1, 1, 1, ["date"])


def test_tools(spark, project):
    files = tree.texts(tree.scan_tree(spark, str(project)), str(project))
    got = {(r["kind"], r["name"], r["description"]) for r in tools.discover_tools(files).where("error is null").collect()}
    assert got >= {("make", "all", "Everything"), ("just", "run", "Go"), ("npm", "dev", "vite"), ("workflow", "CI", None), ("job", "build", None), ("job", "test", None), ("cargo alias", "xt", "cargo run --package a --")}
    code = "#[derive(Subcommand)]\nenum Cmd {\n    /// Get it\n    RegistryGet(GetCmd),\n    List,\n}\n#[derive(Subcommand)]\nenum GetCmd { One }\n"
    variants = {(r["enum"], r["name"], r["holds"]) for r in tools.command_variants(spark.createDataFrame([("c.rs", code)], "path string, text string")).collect()}
    assert ("Cmd", "registry-get", "GetCmd") in variants and ("Cmd", "list", None) in variants
    e = spark.createDataFrame([("p", "A"), ("q", "A"), ("q", "B")], "package string, enum string")
    closure = spark.createDataFrame([("p", "p", 0), ("p", "q", 1)], "package string, on string, hop int")
    wanted = spark.createDataFrame([("p", "A"), ("p", "B"), ("p", "C")], "package string, type string")
    assert {(r["type"], r["found_in"]) for r in tools.find_enums(wanted, e, closure).collect()} == {("A", "p"), ("B", "q")}


def test_extraction_by_family(spark):
    files = {
        "a.ts": "import x from './y';\nexport class A extends B {\n  run(q: number) { z(q); }\n}\nexport const f = (a) => { g(a); };\nfunction h() { function inner() {} }\n",
        "b.go": 'package m\nimport "fmt"\n// Does.\nfunc (s *S) Do() { fmt.Println("func no() {}") }\ntype S struct { a int }\n',
        "c.java": "public class C extends D {\n  private int f(int x) { return g(x); }\n}\n",
        "d.c": "modded class M : Base\n{\n  override void OnInit() { super.OnInit(); }\n}\n",
        "e.lua": "local function one()\n  two()\nend\n",
        "min.js": "x" * 5000,
        "f.md": "# T\n~~~\n# no\n~~~\n[a](b.md)\n",
    }
    rows = extract.items(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    got = {(r["path"], r["kind"], r["name"], r["owner"]) for r in rows}
    assert got >= {("a.ts", "class", "A", None), ("a.ts", "fn", "run", "A"), ("a.ts", "fn", "f", None), ("a.ts", "fn", "h", None), ("a.ts", "use", "./y", None)} and ("a.ts", "fn", "inner", None) not in got
    assert got >= {("b.go", "fn", "Do", None), ("b.go", "struct", "S", None), ("c.java", "class", "C", None), ("c.java", "fn", "f", "C"), ("d.c", "class", "M", None), ("d.c", "fn", "OnInit", "M"), ("e.lua", "fn", "one", None), ("f.md", "heading", "T", "1")}
    assert not any(p == "min.js" or n == "no" for p, _, n, _ in got)
    assert next(r for r in rows if r["name"] == "A")["bases"] == ["B"]


def test_tag_owners(spark):
    found = extract.tags(spark.createDataFrame([("a.rs", "// @route GET /x\nfn h() {\n  //! @contract f.json\n}\n")], "path string, text string"))
    spans = spark.createDataFrame([("a.rs", 2, 4, "h")], "path string, line int, line_end int, name string")
    assert {(r["line"], r["owner"]) for r in extract.tag_owners(found, spans).collect()} == {(1, "h"), (3, "h")}


def test_routes_by_hand(spark):
    code = 'fn app() -> Router {\n    let mut r = Router::new().route("/a", get(h).post(p));\n    if on { r = r.route("/b", any(b)); }\n    r.nest("/api/", sub()).merge(Router::new().route(path, get(x)))\n}\nfn sub() -> Router<S> { Router::new().route("/s/:id", delete(d::e)) }\nfn again() -> Router { again() }\n'
    files = spark.createDataFrame([("k", "m.rs", code)], "crate string, path string, text string")
    got = {tuple(r)[1:6] for r in routers.evaluate(files).collect()}
    assert got == {("app", "GET", "/a", "h", None), ("app", "POST", "/a", "p", None), ("app", "ANY", "/b", "b", "on"), ("app", "DELETE", "/api/s/:id", "d::e", None)}
    assert {r["reason"] for r in routers.skipped(files).collect()} == {"a path that isn't a literal", "a router that holds itself"}


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    folder = f"file://{tmp_path}/cache"
    stores.save_graph({"nodes": df}, folder, 1, 42)
    assert stores.load_graph(spark, ["nodes"], folder, 1, 42)["nodes"].count() == 2
    assert stores.load_graph(spark, ["nodes"], folder, 2, 42) is None and stores.load_graph(spark, ["nodes", "edges"], folder, 1, 42) is None
    fresh = spark.createDataFrame([("a", 9), ("c", 3)], "path string, n int")
    assert sorted(map(tuple, stores.refreshed(df, fresh, ["a"]).collect())) == [("a", 9), ("b", 2)]
    target = tmp_path / "f.txt"
    target.write_text("old")
    target.chmod(0o640)
    stores.atomic_write(str(target), b"new")
    assert target.read_text() == "new" and target.stat().st_mode & 0o777 == 0o640 and len(list(tmp_path.glob("*.txt"))) == 1


def line(kind, call, **more):
    part = {"type": "tool_use", "id": call, "name": kind, "input": {"file_path": "f"}} if kind else {"type": "tool_result", "tool_use_id": call, **more}
    return json.dumps({"type": "x", "uuid": f"{kind}{call}", "message": {"content": [part]}}) + "\n"


def test_log_tail_in_batches_and_as_a_stream(spark, tmp_path):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    log = folder / "s.jsonl"
    log.write_text(line("Edit", "c1") + line("Read", "c2") + "not json\n" + '{"half":')
    spark.dataSource.register(records.LogTail)
    batch = spark.read.format("log_tail").option("path", str(tmp_path / "logs")).load()
    assert batch.count() == 3 and records.skim(batch).where("bad").count() == 1
    since = json.dumps({str(log): len(line("Edit", "c1"))})
    assert spark.read.format("log_tail").option("path", str(tmp_path / "logs")).option("since", since).load().count() == 2
    assert records.discover_logs(spark, str(tmp_path / "logs")).first()["session"] == "s"

    events = logs.tool_events(records.skim(logs.first_lines(logs.log_stream(spark, str(tmp_path / "logs")).withColumn("uuid", __import__("pyspark").sql.functions.get_json_object("line", "$.uuid")).where("uuid is not null"))))
    run = lambda: logs.pending_calls(events).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 0
    with open(log, "a") as f:
        f.write(' 1}\n' + line(None, "c1", is_error=False) + line(None, "c2", is_error=True) + line("Edit", "c1"))
    run()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r["call_id"], r["kind"]) for r in got] == [("c1", "edit")]


def test_complete_lines_and_missing_ends():
    assert list(records.complete_lines(b"a\nbb\n\nrest", 10)) == [(10, b"a"), (12, b"bb"), (15, b"")]
