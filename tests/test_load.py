"""Reading, publishing and caching of a small project."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeweft.__main__ import answer, parser
from codeweft.functions import embed as M
from codeweft.plans import load as L
from codeweft.plans import tools as T
from codeweft.sources import embed_service, files, git_state, graph_json
from codeweft.sources.store import Store
from codeweft.streaming.vectors import embed_stream


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/A.cs").write_bytes(b"// Adds up.\nint A() {\n  return 1;\xff\n}\n")
    nodes = [{"id": "a", "label": "A", "file_type": "code", "source_file": "src/A.cs", "source_location": "L2", "community": 3, "other": 1}, {"id": "b", "label": "B"}]
    (root / "graph.json").write_text(json.dumps({"nodes": nodes, "links": [], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "zz", "relation": "calls"}]}))
    (root / "labels.json").write_text(json.dumps({"3": "Sums"}))
    return root


def test_load(spark, project, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    options = {"labels_path": str(project / "labels.json"), "source_root": str(project / "src"), "graph_path": str(project / "graph.json")}
    assert store.graphs().isEmpty()
    options["source_root"] = str(project)
    out = L.load(store, "p", str(project), **options)
    assert (out["nodes"], out["edges"], out["reused"], out["computed"]) == (2, 1, 0, 2)
    nodes, edges = store.graph("p")
    rows = {r.id: r for r in nodes.collect()}
    assert rows["a"].text == "A | int A() {\n  return 1;\n} | Adds up. | src A cs | Sums | code" and rows["b"].text == "B" and len(rows["a"].embedding) == M.DIM
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "link", 1.0)]
    assert L.load(store, "p", str(project), **options)["skipped"]
    again = L.load(store, "p", str(project), force=True, **options)
    assert (again["reused"], again["computed"]) == (2, 0)
    assert [tuple(r) for r in store.graphs().collect()] == [("p", str(project))]
    with pytest.raises(ValueError):
        store.register("p", "/elsewhere")
    assert store.lock("load-p") and not store.lock("load-p")
    assert L.load(store, "p", str(project), **options) == {"graph": "p", "queued": True} and store.take_rerun("p") and not store.take_rerun("p")
    assert store.state("meta")["p"]["nodes"] == 2
    with pytest.raises(ValueError):
        M.check_model(store.state("config"), "other", None)


def test_files_and_golden(spark, project):
    row = files.source_files(spark, str(project), "*.cs").first()
    assert row.source_file == "src/A.cs" and row.lines == ["// Adds up.", "int A() {", "  return 1;", "}"] and row.sha == files.file_sha(spark, str(project / "src/A.cs"))
    (project / "golden.json").write_text(json.dumps([{"q": "sum", "expect": ["A.cs"]}]))
    assert [tuple(r) for r in graph_json.read_golden(spark, str(project / "golden.json")).collect()] == [("sum", ["a.cs"])]


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    texts = str(tmp_path / "texts")
    for _ in range(2):
        spark.createDataFrame([("h1", "one"), ("h2", "two"), ("h1", "one")], "hash string, text string").write.mode("append").parquet(texts)
        query = embed_stream(spark.readStream.schema("hash string, text string").parquet(texts), store, "m", M.embedder(), str(tmp_path / "cp"))
        assert query.awaitTermination(60)
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "store/emb_cache/model=m")).collect()) == ["h1", "h2"]


def test_freshness(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    assert git_state.freshness({})["reason"] == "no_meta"
    git("init")
    (tmp_path / "f").write_text("1")
    git("add", "-A"), git("commit", "-m", "1")
    meta = git_state.git_info(str(tmp_path)) | {"root": str(tmp_path)}
    assert git_state.freshness(meta)["state"] == "fresh"
    (tmp_path / "f").write_text("2")
    assert git_state.freshness(meta)["state"] == "dirty"
    git("commit", "-am", "2")
    late = git_state.freshness(meta)
    assert (late["state"], late["behind"]) == ("behind", 1) and "1 commits behind" in git_state.freshness_line(late)
    assert git_state.freshness(meta | {"commit": "0" * 40})["state"] == "diverged"


def test_freshness_tells_failures_apart(tmp_path, monkeypatch):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout.strip()
    assert git_state.freshness({"commit": "1" * 40}, str(tmp_path))["reason"] == "not_git"
    git("init", "-b", "main")
    assert git_state.git_info(str(tmp_path)) is None  # no commit yet
    for i in "123":
        (tmp_path / "f").write_text(i)
        git("add", "-A"), git("commit", "-m", i)
    newest = git_state.git_info(str(tmp_path))
    assert newest["branch"] == "main" and newest["committed_at"] and not newest["dirty"]
    git("checkout", "-q", "HEAD~1")
    assert git_state.git_info(str(tmp_path))["branch"] == "HEAD"
    assert git_state.freshness(newest, str(tmp_path))["state"] == "diverged"  # built on a later commit
    monkeypatch.setattr(git_state, "_ask", lambda root, *words: git_state.Answer(None, []))
    assert git_state.freshness(newest, str(tmp_path))["reason"] == "git_failed"
    assert "git gave no answer" in git_state.freshness_line(git_state.freshness(newest, str(tmp_path)))


def test_state_merges_and_locks(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.save_meta("g", nodes=1, model="m")
    two.save_meta("g", nodes=2, model=None)
    assert one.state("meta") == {"g": {"nodes": 2, "model": "m"}}
    assert one.lock("x") and not two.lock("x", wait=0.3)
    two.unlock("x")  # not its own
    assert not two.lock("x")
    one._held.clear()  # no more signs of life
    fs, path = one._path("locks/x")
    fs.setTimes(path, 1000, -1)
    assert two.lock("x") and not one.lock("x")
    one.unlock("x")
    assert not one.lock("x")
    two.unlock("x")
    assert one.lock("x")


def test_a_late_request_is_not_lost(spark, project, tmp_path, monkeypatch):
    store, runs = Store(spark, str(tmp_path / "store")), []
    unlock = store.unlock

    def let_go(name):
        if name == "load-p" and len(runs) == 1:
            store.request_rerun("p")  # after the last look
        unlock(name)

    monkeypatch.setattr(store, "unlock", let_go)
    monkeypatch.setattr(L, "_load_once", lambda *a: runs.append(1) or {"graph": "p"})
    L.load(store, "p", str(project))
    assert len(runs) == 2 and not store.pending("p")
    with pytest.raises(FileNotFoundError):
        L.load(store, "q", str(tmp_path / "nowhere"))


def test_embedding_service(spark):
    server = embed_service.serve()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert M.service_state(url) == {"status": "ok", "model": M.MODEL, "dim": M.DIM, "version": M.VERSION}
        embed, why = M.choose_embedder({"embed_url": url})
        assert why.startswith("service")
        rows = spark.createDataFrame([("pay a bill",), (None,)], "t string").select(embed("t").alias("v"), M.embedder()("t").alias("w")).collect()
        assert all(r.v == r.w for r in rows)
        assert M.choose_embedder({"embed_url": url}, "other")[1].startswith("the service has")
    finally:
        server.shutdown()
        server.server_close()
    assert M.service_state(url, 0.5) is None and M.choose_embedder({"embed_url": url})[1] == "the service does not answer"
    assert M.choose_embedder({})[1] == "no service configured"


def test_tools(spark, project, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    L.load(store, "p", str(project), source_root=str(project))
    assert len(T.TOOLS) == 10 and T.list_graphs(store) == [f"p\t{project}"]
    assert store.postings("p").where("term = 'return'").count() == 1
    told = T.search(store, "p", "adds up a return", hybrid=True, snippet=True)
    assert "load it again" in told[0] and any("src/A.cs" in x for x in told) and any("return 1" in x for x in told) and any("link" in x for x in told)
    for name, args in (("explain", ("A",)), ("find_path", ("A", "B")), ("tests", ("A",)), ("impact", ("B",)), ("similar", ("A",)), ("trace", ("A",)), ("dupes", ()), ("status", ())):
        assert len(T.TOOLS[name](store, "p", *args)) > 1, name
    assert "no symbol" in T.similar(store, "p", "Nothing")[1]
    parsed = parser().parse_args([str(tmp_path / "store"), "path", "p", "A", "B"])
    assert answer(spark, parsed)[-1].endswith("A  ─link→  B")
