"""One snippet per rule of the parser stage."""

import itertools
import os
import textwrap

import pyarrow as pa

from codeloom.functions.lexicons import BRANCH_KINDS
import pytest

from codeloom.sources import extract
from codeloom.sources.extract import file_facts


def facts(source, module="m"):
    return list(file_facts(module, textwrap.dedent(source), ("function", "import", "error")))


def functions(source, module="m"):
    return [f for f in facts(source, module) if f["record_type"] == "function"]


def one(source):
    (found,) = functions(source)
    return found


def branches(source):
    return sum(n for _, n in one(source)["branch_kinds"])


def test_nested_functions_fold_into_the_outer_one():
    found = one(
        """
        def outer(a):
            def inner(b):
                if b:
                    call_inner(b)
            return lambda c: call_lambda(c)
        """
    )
    assert found["qname"] == "m.outer"
    assert found["calls"] == ["call_inner", "call_lambda"]
    assert "inner" not in found["idents"]
    assert found["idents"][-1] == "outer"
    assert found["branch_kinds"] == [("If", 1)]


def test_only_the_body_of_the_recorded_function_is_read():
    found = one(
        """
        @decorate(thing)
        def f(a=default()) -> result():
            pass
        """
    )
    assert found["calls"] == [] and found["idents"] == ["f"]


def test_decorators_and_defaults_of_nested_functions_are_read():
    found = one(
        """
        def f():
            @deco(x)
            def g(a=make()):
                pass
        """
    )
    assert found["calls"] == ["make", "deco"]


def test_functions_below_module_level_blocks_are_found_in_order():
    names = [
        f["qname"]
        for f in functions(
            """
            if A:
                def a(): pass
            else:
                def b(): pass
            try:
                def c(): pass
            except E:
                def d(): pass
            finally:
                async def e(): pass
            match x:
                case 1:
                    def g(): pass
            with w:
                for i in y:
                    def h(): pass
            """
        )
    ]
    assert names == ["m.a", "m.b", "m.c", "m.d", "m.e", "m.g", "m.h"]


def test_classes_stack_and_empty_modules_drop_out():
    source = """
    class A:
        class B:
            def f(self): pass
        def g(self): pass
    """
    assert [f["qname"] for f in functions(source)] == ["m.A.B.f", "m.A.g"]
    assert [f["qname"] for f in functions(source, module="")] == ["A.B.f", "A.g"]


def test_call_names():
    found = one(
        """
        def f():
            a.b().c()
            x[0].g()
            x[0].h.i()
            x[0]()
            k(1)(2)
            "text".join(y)
            (lambda: 1)()
        """
    )
    assert found["calls"] == ["a.b.c", "a.b", "g", "h.i", "k", "k", "join"]


def test_identifier_order():
    found = one(
        """
        def f(param):
            target.attr = value(key=arg)
            d = {k: v}
        """
    )
    assert found["idents"] == ["attr", "target", "value", "value", "arg", "d", "k", "v", "f"]


def test_branch_counts():
    assert branches("def f():\n    return a and b and c") == 1
    assert branches("def f():\n    return a and b or c") == 2
    assert branches("def f():\n    try:\n        pass\n    except A:\n        pass\n    except B:\n        pass") == 3
    assert branches("def f():\n    if a:\n        pass\n    elif b:\n        pass\n    else:\n        pass") == 2
    assert branches("def f():\n    match x:\n        case 1:\n            pass\n        case 2:\n            pass") == 1
    assert branches("def f():\n    return [i for i in a for j in b if j]") == 2
    assert branches("def f():\n    return 1 if a else 2") == 1
    assert branches("def f():\n    try:\n        pass\n    except* A:\n        pass") == 1  # the handler only
    assert branches("async def f():\n    async for i in a:\n        pass\n    async with b:\n        pass") == 2
    assert len(BRANCH_KINDS) == 12


def test_imports():
    found = facts(
        """
        import a.b, c
        from m import x, y
        from . import z
        from ..p import q
        class K:
            import inside_class
        def f():
            import hidden
        """
    )
    imported = [f["imported"] for f in found if f["record_type"] == "import"]
    assert imported == ["a.b", "c", "m.x", "m.y", "z", "p.q", "inside_class"]


def test_errors_are_rows():
    (problem,) = facts("def broken(:\n")
    assert problem["record_type"] == "error" and problem["error_line"] == 1
    (null,) = facts("x = 1\x00")
    assert null["record_type"] == "error"
    (deep,) = facts("x = " + "(" * 5000 + ")" * 5000)
    assert deep["record_type"] == "error"


def test_deep_chains_do_not_exhaust_the_walk():
    chain = "a" + ".b()" * 300
    assert one(f"def f():\n    return {chain}")["calls"][0].count("b") == 300


def test_only_wanted_records():
    source = "import a\ndef f():\n    g()\n"
    assert [f["record_type"] for f in file_facts("m", source)] == ["file", "import", "function"]
    assert [f["record_type"] for f in file_facts("m", source, ("import",))] == ["import"]
    assert [f["record_type"] for f in file_facts("m", "def (", ("file",))] == ["file"]
    assert [f["record_type"] for f in file_facts("m", "def (", ("function",))] == []


def test_columns_of_many_files(spark):
    rows = [("r", f"p{n}.py", f"p{n}", source) for n, source in enumerate([
        "import a\ndef f(x):\n    if x:\n        g.h(x)\n", "", "def (", "type X = int\ndef k():\n    type Y = Z\n    return [*a, {**b}]\n", "x = 1"])]
    frame = spark.createDataFrame(rows, "run_id string, path string, module string, text string")
    got = extract.extract_facts(frame).orderBy("file_path", "record_type", "ord").collect()
    assert [(r.file_path, r.record_type) for r in got] == [
        ("p0.py", "file"), ("p0.py", "function"), ("p0.py", "import"), ("p1.py", "file"), ("p2.py", "error"), ("p2.py", "file"),
        ("p3.py", "file"), ("p3.py", "function"), ("p4.py", "file")]
    f, k = (r for r in got if r.record_type == "function")
    assert (f.qname, f.calls, f.idents, f.branch_kinds) == ("p0.f", ["g.h"], ["x", "g.h", "h", "g", "x", "f"], {"If": 1})
    assert (k.calls, k.idents, k.branch_kinds) == ([], ["Y", "Z", "a", "b", "k"], {})
    assert all(r.calls is None and r.idents is None and r.branch_kinds is None for r in got if r.record_type != "function")
    with pytest.raises(ValueError):
        extract.extract_facts(frame, ("class",))


def _texts(first: int, count: int) -> pa.RecordBatch:
    texts = [f"def name_{k}(a_{k}):\n    b_{k}.c_{k}(d_{k})\n" for k in range(first, first + count)]
    return pa.RecordBatch.from_arrays(
        [pa.array(["r"] * count), pa.array([f"{k}.py" for k in range(count)]), pa.array(["m"] * count), pa.array(texts)],
        ["run_id", "path", "module", "text"],
    )


def _resident_mb() -> float:
    with open("/proc/self/statm") as numbers:
        return int(numbers.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_parsed_names_do_not_stay_in_the_worker():
    """Workers are reused: their memory must not grow with the names in all files they parse."""
    parse = worker_of(lambda files: extract.extract_facts(files, ("function",)))
    assert sum(b.num_rows for b in parse(iter([_texts(0, 2000)]))) == 2000
    before = _resident_mb()
    for part in range(1, 6):
        assert sum(b.num_rows for b in parse(iter([_texts(part * 20_000, 20_000)]))) == 20_000
    assert _resident_mb() - before < 15


def worker_of(query):
    """The function which ``query`` gives to ``mapInArrow``."""

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, function, schema):
            return function

    return query(Files())


def test_a_child_hands_over_rows_errors_and_its_end():
    of = lambda *rows: pa.RecordBatch.from_pydict({"x": list(rows)})

    def failing():
        yield of(1)
        raise ValueError("broken")

    assert [b.to_pydict() for b in extract._in_child(lambda: iter([of(1, 2), of(3)]))] == [{"x": [1, 2]}, {"x": [3]}]
    assert list(extract._in_child(lambda: iter([]))) == []
    with pytest.raises(RuntimeError):
        list(extract._in_child(failing))
    stopped = extract._in_child(lambda: (of(*range(100_000)) for _ in itertools.count()))
    next(stopped)
    stopped.close()  # returns: the child ends when nobody reads


def test_files_are_dealt_to_children_by_their_bytes(monkeypatch):
    monkeypatch.setattr(extract, "_CHILD_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 60, "b" * 60, "c" * 500, "", "d" * 20, "e" * 30]})
    assert [part.column("text").to_pylist() for part in extract._slices(batch)] == [["a" * 60], ["b" * 60], ["c" * 500], ["", "d" * 20, "e" * 30]]
    assert list(extract._slices(batch.slice(0, 0))) == []
