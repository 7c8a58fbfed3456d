"""Extraction from small sources, discovery, indexing and the watch mode."""

import datetime

import pytest

from codeloom.sources.extract import CppPlugin, PythonPlugin, Registry, default_registry
from codeloom.sources.scan import discover, index, manifests
from codeloom.streaming.watch import EVENTS, Watcher, listing_events


def names(found, kind=None):
    return [(s[0], s[7]) for s in found.symbols if kind is None or s[1] == kind]


def edges(found, kind):
    return [(e[0], e[1]) for e in found.edges if e[2] == kind]


def extract(path, text):
    return default_registry().find(path).extract(text, path)


def test_cpp():
    got = extract("/a.cpp", '#include "b.h"\nnamespace n {\nclass A : public B {\n  void in() { f(); }\n};\nenum class E { X };\nusing T = int;\nint free(int x) { // g()\n  return h(x);\n}\nvoid A::out() { o.k(); std::move(1); }\n}\n')
    assert names(got) == [("A", ""), ("in", "A"), ("E", ""), ("T", ""), ("free", ""), ("out", "A")]
    assert {s[6] for s in got.symbols} == {"n"}
    assert edges(got, "inherits") == [("A", "B")] and edges(got, "includes") == [("/a.cpp", "b.h")]
    assert ("/a.cpp:free", "h") in edges(got, "calls") and ("/a.cpp:A::out", "k") in edges(got, "calls") and not any(t == "g" for _, t in edges(got, "calls"))


def test_rust():
    got = extract("/a.rs", "use a::{b, c};\nmod m;\npub struct S { x: i32 }\ntrait T: U { fn t(&self); }\nimpl T for S { fn t(&self) { go(); } }\nfn f() { S::new(); println!(\"x\"); }\n")
    assert names(got, "struct") == [("S", "")] and ("t", "S") in names(got) and ("t", "T") in names(got) and ("f", "") in names(got)
    assert edges(got, "includes") == [("/a.rs", "a::b"), ("/a.rs", "a::c"), ("/a.rs", "m")] and ("S", "T") in edges(got, "inherits") and ("T", "U") in edges(got, "inherits")


def test_go():
    got = extract("/a.go", 'package p\n\nimport (\n\t"fmt"\n\t"os"\n)\n\ntype S struct {\n\tx int\n}\n\ntype I interface {\n\tM()\n}\n\ntype N int\n\nfunc (s *S) M() { fmt.Println(s.x) }\n\nfunc main() { run() }\n')
    assert names(got, "struct") == [("S", "")] and names(got, "interface") == [("I", "")] and names(got, "typedef") == [("N", "")] and ("M", "S") in names(got, "method") and ("main", "") in names(got, "function")
    assert edges(got, "includes") == [("/a.go", "fmt"), ("/a.go", "os")] and ("/a.go:S::M", "Println") in edges(got, "calls") and {s[6] for s in got.symbols} == {"p"}


def test_python():
    got = extract("/a.py", "import os\nfrom . import x, y\nfrom .m import z\n\nclass A(B, c.D):\n    def m(self):\n        self.k()\n\ndef f():\n    import late\n    g()\n\nf()\n")
    assert names(got) == [("A", ""), ("m", "A"), ("f", "")] and edges(got, "inherits") == [("A", "B"), ("A", "D")]
    assert [t for _, t in edges(got, "includes")] == ["os", ".x", ".y", ".m"] and ("/a.py", "f") in edges(got, "calls") and ("/a.py:A::m", "k") in edges(got, "calls")
    with pytest.raises(SyntaxError):
        extract("/bad.py", "def (")


def test_csharp_and_java():
    got = extract("/a.cs", "using System;\nnamespace N.M {\n public class A : B, I<int> {\n  public A() { Go(); }\n  int F(int x) { return G(x); }\n }\n interface I<T> {}\n record R(int X);\n enum E { A }\n}\n")
    assert ("A", "") in names(got, "class") and ("F", "A") in names(got, "method") and {s[6] for s in got.symbols} == {"N.M"} and edges(got, "inherits") == [("A", "B"), ("A", "I<int>")]
    got = extract("/A.java", "import java.util.List;\nclass A extends B implements C, D<X> {\n  A() { super(); }\n  void f() { g(); }\n  abstract void h();\n}\ninterface I extends J {}\nenum E { X }\n")
    assert ("f", "A") in names(got) and ("h", "A") not in names(got) and edges(got, "inherits") == [("A", "B"), ("A", "C"), ("A", "D<X>"), ("I", "J")] and edges(got, "includes") == [("/A.java", "java.util.List")]


def test_registry():
    with pytest.raises(ValueError):
        Registry([PythonPlugin(), PythonPlugin()])
    assert CppPlugin(("API",)).preprocess("class API X") == "class     X" and default_registry().find("/x.txt") is None
    assert CppPlugin((), ("UP",)).preprocess('UP(a, (b), ")")\nint x;').split() == ["int", "x;"]
    assert default_registry(extensions={".inl": "cpp"}).find("/a.INL").language == "cpp"


def test_discover_index_watch(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    (tmp_path / ".gitignore").write_text("skip/\n")
    (tmp_path / "skip" / "s.py").write_text("x = 1\n")
    (tmp_path / "a.py").write_text("def f():\n    g()\n")
    (tmp_path / "b.py").write_text("def g():\n    pass\n")
    paths = discover(str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.py", "b.py"]

    def sources(of):
        rows = [(p, bytearray(open(p, "rb").read()), i, 1) for i, p in enumerate(of)]
        return spark.createDataFrame(rows, "path string, content binary, file_ord long, mtime long")

    graph, failed = index(sources(paths))
    assert failed.count() == 0 and [(r.dst, r.confidence) for r in graph.of_kind("calls").collect()] == [(f"{tmp_path}/b.py:g", "resolved")]
    _, before = listing_events({}, str(tmp_path))
    (tmp_path / "b.py").unlink()
    changed, _ = listing_events(before, str(tmp_path))
    assert changed == [(f"{tmp_path}/b.py", True)]
    watcher = Watcher(graph, lambda frame, graph: index(sources([r.path for r in frame.collect()]), base=graph)[0])
    now = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(f"{tmp_path}/b.py", True, now, 1)], EVENTS)
    events.write.parquet(str(tmp_path / "events"))
    query = watcher.start(spark, str(tmp_path / "events"), str(tmp_path / "check"))
    query.processAllAvailable()
    watcher.stop()
    assert watcher.graph.of_kind("calls").count() == 0 and [r.name for r in watcher.graph.symbols.collect()] == ["f"]


def write_tree(top, **files):
    for name, text in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def read_tree(spark, paths):
    rows = [(str(p), bytearray(open(p, "rb").read()), i, 1) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "path string, content binary, file_ord long, mtime long")


def test_a_delta_is_resolved_against_all_files(spark, tmp_path):
    write_tree(tmp_path, **{"a.h": "int helper(int);\n", "a.cpp": '#include "a.h"\nint helper(int x) {\n  return x;\n}\n', "b.cpp": '#include "a.h"\nint user() {\n  return helper(1);\n}\n'})
    graph, _ = index(read_tree(spark, discover(str(tmp_path))))
    want = sorted(map(tuple, graph.edges.select("src", "dst", "line").collect())), sorted(map(tuple, graph.includes.select("src_file", "dst_file").collect()))
    assert (f"{tmp_path}/b.cpp:user", f"{tmp_path}/a.cpp:helper", 3) in want[0] and (f"{tmp_path}/b.cpp", f"{tmp_path}/a.h") in want[1]
    watcher = Watcher(graph, lambda frame, held: index(read_tree(spark, [r.path for r in frame.collect()]), base=held)[0])
    event = lambda path, gone: spark.createDataFrame([(str(path), gone, datetime.datetime(2024, 1, 1), 1)], EVENTS)
    watcher.apply(event(tmp_path / "b.cpp", False))
    got = sorted(map(tuple, watcher.graph.edges.select("src", "dst", "line").collect())), sorted(map(tuple, watcher.graph.includes.select("src_file", "dst_file").collect()))
    assert got == want
    (tmp_path / "a.cpp").write_text("int other() {\n  return user();\n}\n")
    watcher.apply(event(tmp_path / "a.cpp", False))
    assert [(r.src, r.dst) for r in watcher.graph.edges.collect()] == [(f"{tmp_path}/a.cpp:other", f"{tmp_path}/b.cpp:user")]
    watcher.apply(event(tmp_path, True))
    assert watcher.graph.files.count() == watcher.graph.symbols.count() == watcher.graph.edges.count() == 0


def test_overrides_crates_and_modules(spark, tmp_path):
    write_tree(tmp_path, **{
        "base.h": "class Base {\n  virtual void run() { go(); }\n  void own() { go(); }\n};\nclass Middle : public Base {\n};\n", "derived.cpp": "class Derived : public Middle {\n};\nvoid Derived::run() {\n}\nvoid Derived::extra() {\n}\n",
        "crate/Cargo.toml": '[package]\nname = "my-crate"\n', "crate/src/lib.rs": 'mod util;\n#[path = "odd/place.rs"]\nmod named;\npub fn top() {}\n', "crate/src/util/mod.rs": "pub mod deep;\npub fn help() {}\nmod inner {\n  fn hidden() {}\n}\n",
        "crate/src/util/deep.rs": "pub fn far() {}\n", "crate/src/odd/place.rs": "pub fn odd() {}\n", "go/go.mod": "// module no\nmodule example.com/m\n", "go/main.go": "package main\n\nfunc main() {}\n", "go/pkg/p.go": "package pkg\n\nfunc F() {}\n", "bad.py": "def (",
    })
    paths = discover(str(tmp_path))
    assert sorted(manifests(paths)) == [(f"{tmp_path}/crate/src", "rust", "my_crate"), (f"{tmp_path}/go", "go", "example.com/m")]
    graph, failed = index(read_tree(spark, paths), owners=manifests(paths))
    assert [(r.src, r.dst) for r in graph.of_kind("overrides").collect()] == [(f"{tmp_path}/derived.cpp:Derived::run", f"{tmp_path}/base.h:Base::run")]
    spaces = {r.name: r.namespace for r in graph.symbols.where("language IN ('rust', 'go')").collect()}
    assert spaces == {"top": "my_crate", "help": "my_crate::util", "hidden": "my_crate::util::inner", "far": "my_crate::util::deep", "odd": "my_crate::odd::place", "main": "example.com/m", "F": "example.com/m/pkg"}
    src = f"{tmp_path}/crate/src"
    assert {(r.src_file, r.dst_file) for r in graph.includes.where("src_file LIKE '%.rs'").collect()} == {(f"{src}/lib.rs", f"{src}/util/mod.rs"), (f"{src}/lib.rs", f"{src}/odd/place.rs"), (f"{src}/util/mod.rs", f"{src}/util/deep.rs")}
    assert [r.path for r in failed.collect()] == [f"{tmp_path}/bad.py"]


def test_saved_filters_reach_the_files(spark, tmp_path):
    from codeloom.operators import lookup
    from codeloom.plans.store import GraphStore

    write_tree(tmp_path, **{"src/a.py": "def f():\n    pass\n\ndef f():\n    pass\n", "src/b.py": "class C:\n    pass\n"})
    index(read_tree(spark, discover(str(tmp_path / "src"))))[0].save(str(tmp_path / "store"))
    graph = GraphStore.load(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = lookup.search(graph, "f", kind="function", subtree=f"{tmp_path}/src")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "Exchange" not in plan and "PushedFilters: [IsNotNull" in plan and "EqualTo(kind,function)" in plan and "StringStartsWith(file" in plan
    graph.save(str(tmp_path / "store"))
    assert GraphStore.load(spark, str(tmp_path / "store")).symbols.count() == 2


def test_polling_makes_events(spark, tmp_path):
    import time

    write_tree(tmp_path / "tree", **{"a.py": "def f():\n    pass\n"})
    graph, _ = index(read_tree(spark, discover(str(tmp_path / "tree"))))
    watcher = Watcher(graph, lambda frame, held: index(read_tree(spark, [r.path for r in frame.collect()]), base=held)[0])
    watcher.poll(spark, str(tmp_path / "tree"), str(tmp_path / "events"), every=0.1)
    (tmp_path / "tree" / "b.py").write_text("def g():\n    f()\n")
    (tmp_path / "tree" / "notes.txt").write_text("no source")
    deadline = time.time() + 60
    while time.time() < deadline and not any(p.suffix == ".parquet" for p in (tmp_path / "events").glob("*")):
        time.sleep(0.2)
    query = watcher.start(spark, str(tmp_path / "events"), str(tmp_path / "check"))
    query.processAllAvailable()
    watcher.stop()
    assert [(r.src, r.dst) for r in watcher.graph.of_kind("calls").collect()] == [(f"{tmp_path}/tree/b.py:g", f"{tmp_path}/tree/a.py:f")]
