"""The query interface over a small source tree."""

import pytest

from codeloom.engine import Engine, QueryError
from codeloom.sources.config import Config, ConfigError, find_config, parse_config


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    (top / "engine.h").write_text('class Engine {\n};\nclass Debug : public Engine {\n};\n')
    (top / "engine.cpp").write_text('#include "engine.h"\n#include "utils.h"\nvoid Engine::update() { clamp(1); }\nvoid Engine::render() { update(); }\n')
    (top / "utils.h").write_text("int clamp(int);\n")
    (top / "utils.cpp").write_text('#include "utils.h"\nint clamp(int x) {\n  return x;\n}\n')
    made = Engine(spark)
    with pytest.raises(QueryError):
        made.get_orphans()
    made.top = str(top)
    made.first = made.analyze_codebase(str(top))
    return made


def test_index(engine):
    assert engine.first["files"] == 4 and engine.first["symbols"] == 5 and not engine.first["warnings"]
    assert engine.analyze_codebase(engine.top) == engine.first  # nothing is stale: the cached graph
    assert engine.get_status()["job"]["status"] == "completed" and engine.get_status()["nodes"] == 5
    with pytest.raises(QueryError):
        engine.analyze_codebase(engine.top + "/none")


def test_queries(engine):
    top = engine.top
    clamp = f"{top}/utils.cpp:clamp"
    assert [r["symbol_id"] for r in engine.get_callers(clamp, depth=2).results] == [f"{top}/engine.cpp:Engine::update", f"{top}/engine.cpp:Engine::render"]
    assert [r["name"] for r in engine.get_orphans().results] == ["render"]
    assert {r["file"].rsplit("/", 1)[1] for r in engine.get_dependencies(f"{top}/engine.cpp").results} == {"engine.h", "utils.h"}
    assert {r["file"].rsplit("/", 1)[1]: r["count"] for r in engine.get_coupling(f"{top}/engine.cpp").results} == {"utils.cpp": 1, "engine.h": 1, "utils.h": 1}
    assert engine.get_class_hierarchy("Engine")["tree"]["derived"][0]["name"] == "Debug"
    assert engine.search_symbols("^clam$")["suggestions"] == [clamp] and engine.search_symbols("CLAMP")["total"] == 1
    assert engine.get_symbol_detail(clamp)["line"] == 2 and engine.detect_cycles().total == 0
    assert engine.generate_diagram(symbol=clamp)["edges"] == [{"from": "Engine::update", "to": "clamp", "label": "calls"}]
    assert engine.generate_diagram(file=f"{top}/utils.h", format="mermaid").startswith("graph TD")
    for bad in (lambda: engine.get_symbol_detail("x"), lambda: engine.get_orphans(subtree="../x"), lambda: engine.search_symbols(), lambda: engine.generate_diagram()):
        with pytest.raises(QueryError):
            bad()


def test_config(tmp_path):
    got = parse_config('[extensions]\ncpp = [".INL"]\ndisabled = [".h"]\n[cpp]\nmacro_strip = ["API", ""]\n[response]\nmax_bytes = 9\n')
    assert got.extensions == {".inl": "cpp"} and got.disabled == (".h",) and got.macro_strip == ("API",) and got.max_bytes == 9
    for bad in ('[extensions]\ncpp = ["x"]', '[extensions]\ncpp = [".x"]\ngo = [".x"]', "[response]\nmax_bytes = 0", '[cpp]\nmacro_strip = ["A"]\nmacro_strip_with_args = ["A"]', "]"):
        with pytest.raises(ConfigError):
            parse_config(bad)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".codeloom.toml").write_text('[discovery]\nextra_ignore = ["gen/*"]\n')
    assert find_config(str(tmp_path / "a" / "b"))[0].extra_ignore == ("gen/*",) and isinstance(find_config("/")[0], Config)
