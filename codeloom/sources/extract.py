"""Syntax facts from source text: the only Python stage of the library.

The stage emits raw facts (names seen, calls, branch counts, line numbers); all
tagging and scoring happens later in native expressions.  It runs where the file
rows are: text is never shuffled for it.  Each batch of files is parsed in a child process,
because the interpreter never frees a name that it has parsed.
"""

from __future__ import annotations

import ast
import gc
import os
import traceback
from collections.abc import Callable, Collection, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexicons import BRANCH_KINDS

FACTS_SCHEMA = """
    run_id string, file_path string, record_type string, ord int,
    qname string, short_name string, line_start int, line_end int,
    calls array<string>, idents array<string>, branch_kinds map<string,int>,
    module string, imported string,
    error_line int, error_offset int, error_message string
"""

RECORD_TYPES = ("file", "function", "import", "error")

# Facts held back before a batch is sent on, so that one batch of large files
# does not become one huge result batch.
_FLUSH_ROWS = 2000

# Bytes of text which one child process parses.
_CHILD_BYTES = 8 * 1024 * 1024

_BRANCHES = frozenset(getattr(ast, name) for name in BRANCH_KINDS)
_BLOCKS = (ast.stmt, ast.ExceptHandler, ast.match_case)


@cache
def _child_fields(kind: type[ast.AST]) -> tuple[str, ...]:
    """Fields which may hold nodes, last one first, without the load/store markers."""
    return tuple(name for name in reversed(kind._fields) if name != "ctx")


def _dotted(node: ast.AST) -> str:
    """Dotted text of a called expression; '' when no name remains.

    Calls in the chain are transparent and an unnamed base (a subscript, a
    literal) drops out.
    """
    tail: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            tail.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        else:
            break
    if isinstance(node, ast.Name):
        tail.append(node.id)
    return ".".join(reversed(tail))


def _body_facts(function: ast.AST) -> tuple[list[str], list[str], dict[str, int]]:
    """Calls, names and branch counts of one function body in reading order.

    An explicit stack keeps the walk safe on deeply nested code.  Nested
    functions and lambdas belong to the function around them.  The most frequent kinds of
    node come first, with their fields written out.
    """
    calls: list[str] = []
    idents: list[str] = []
    kinds: dict[str, int] = {}
    pending = function.body[::-1]
    while pending:
        node = pending.pop()
        kind = type(node)
        if kind is ast.Name:
            idents.append(node.id)
        elif kind is ast.Attribute:
            idents.append(node.attr)
            pending.append(node.value)
        elif kind is ast.Call:
            name = _dotted(node.func)
            if name:
                calls.append(name)
                idents.append(name)
            pending += node.keywords[::-1]
            pending += node.args[::-1]
            pending.append(node.func)
        elif kind is ast.Expr:
            pending.append(node.value)
        elif kind is not ast.Constant:
            if kind in _BRANCHES:
                kinds[kind.__name__] = kinds.get(kind.__name__, 0) + 1
            for field in _child_fields(kind):
                value = getattr(node, field, None)
                if isinstance(value, list):
                    pending.extend(item for item in reversed(value) if isinstance(item, ast.AST))
                elif isinstance(value, ast.AST):
                    pending.append(value)
    idents.append(function.name)
    return calls, idents, kinds


def _unreadable(problem: Exception) -> dict:
    if isinstance(problem, SyntaxError):
        return {"ord": 0, "error_line": problem.lineno, "error_offset": problem.offset, "error_message": problem.msg}
    return {"ord": 0, "error_message": str(problem) or type(problem).__name__}


def file_facts(module: str, text: str, wanted: Collection[str] = RECORD_TYPES) -> Iterator[dict]:
    """The facts of one file: one about the file, and its functions and imports, or an error
    if it does not parse.  Only the wanted record types are looked for."""
    if "file" in wanted:
        yield {"record_type": "file", "ord": 0, "module": module}
    if not {"function", "import", "error"} & set(wanted):
        return
    try:
        tree = ast.parse(text)
    except (SyntaxError, RecursionError, ValueError, MemoryError) as problem:
        if "error" in wanted:
            yield {"record_type": "error", **_unreadable(problem)}
        return

    functions = imports = 0
    pending: list[tuple[ast.AST, tuple[str, ...]]] = [(node, ()) for node in reversed(tree.body)]
    while pending:
        node, scope = pending.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions += 1
            if "function" in wanted:
                calls, idents, kinds = _body_facts(node)
                yield {
                    "record_type": "function",
                    "ord": functions,
                    "qname": ".".join(part for part in (module, *scope, node.name) if part),
                    "short_name": node.name,
                    "line_start": node.lineno,
                    "line_end": node.end_lineno,
                    "calls": calls,
                    "idents": idents,
                    "branch_kinds": list(kinds.items()),
                }
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            if "import" not in wanted:
                continue
            base = (node.module or "") + "." if isinstance(node, ast.ImportFrom) else ""
            for alias in node.names:
                imports += 1
                yield {
                    "record_type": "import",
                    "ord": imports,
                    "module": module,
                    "imported": (base + alias.name).strip("."),
                }
        elif isinstance(node, ast.ClassDef):
            pending.extend((child, (*scope, node.name)) for child in reversed(node.body))
        else:
            inner = [child for child in ast.iter_child_nodes(node) if isinstance(child, _BLOCKS)]
            pending.extend((child, scope) for child in reversed(inner))


_TEXTS = ("run_id", "file_path", "record_type", "qname", "short_name", "module", "imported", "error_message")
_NUMBERS = ("ord", "line_start", "line_end", "error_line", "error_offset")
_ORDER = [field.split()[0] for field in FACTS_SCHEMA.replace("map<string,int>", "map").split(",")]


class _Columns:
    """Facts of many files, column by column; lists are kept flat with their offsets."""

    def __init__(self) -> None:
        self.plain: dict[str, list] = {name: [] for name in (*_TEXTS, *_NUMBERS)}
        self.flat: dict[str, list[str]] = {"calls": [], "idents": [], "branch_kinds": []}
        self.counts: list[int] = []
        self.offsets: dict[str, list[int | None]] = {name: [] for name in self.flat}
        self.rows = 0

    def add(self, run_id: str, path: str, fact: dict) -> None:
        self.rows += 1
        get = fact.get
        for name, column in self.plain.items():
            column.append(get(name))
        self.plain["run_id"][-1], self.plain["file_path"][-1] = run_id, path
        listed = "calls" in fact  # other records have no lists at all
        for name, values in self.flat.items():
            self.offsets[name].append(len(values) if listed else None)
        if listed:
            self.flat["calls"].extend(fact["calls"])
            self.flat["idents"].extend(fact["idents"])
            for kind, n in fact["branch_kinds"]:
                self.flat["branch_kinds"].append(kind)
                self.counts.append(n)

    def batch(self) -> pa.RecordBatch:
        def ends(name: str) -> pa.Array:
            return pa.array([*self.offsets[name], len(self.flat[name])], pa.int32())

        done = {name: pa.array(self.plain[name], pa.string()) for name in _TEXTS}
        done |= {name: pa.array(self.plain[name], pa.int32()) for name in _NUMBERS}
        done |= {name: pa.ListArray.from_arrays(ends(name), pa.array(self.flat[name], pa.string())) for name in ("calls", "idents")}
        kinds = pa.array(self.flat["branch_kinds"], pa.string())
        done["branch_kinds"] = pa.MapArray.from_arrays(ends("branch_kinds"), kinds, pa.array(self.counts, pa.int32()))
        return pa.RecordBatch.from_arrays([done[name] for name in _ORDER], _ORDER)


def _facts_of(batch: pa.RecordBatch, wanted: Collection[str]) -> Iterator[pa.RecordBatch]:
    """Facts of the files in (run_id, path, module, text) rows."""
    facts = _Columns()
    for run_id, path, module, text in zip(*(column.to_pylist() for column in batch.columns)):
        for fact in file_facts(module, text, wanted):
            facts.add(run_id, path, fact)
        if facts.rows >= _FLUSH_ROWS:
            yield facts.batch()
            facts = _Columns()
    if facts.rows:
        yield facts.batch()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of files with about ``_CHILD_BYTES`` of text, a single file at least."""
    start, held = 0, 0
    for row, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if held and held + (size or 0) > _CHILD_BYTES:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _in_child(work: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``work`` yields in a forked process, whose memory ends with it.

    The parser keeps every name it has seen until its process ends, so a reused worker would
    grow with all files of all its tasks.
    """
    source, sink = os.pipe()
    child = os.fork()
    if not child:
        status = 1
        try:
            os.close(source)
            gc.disable()  # syntax trees have no cycles, and the process is short
            with os.fdopen(sink, "wb") as out:
                stream = None
                for made in work():
                    stream = stream or pa.ipc.new_stream(out, made.schema)
                    stream.write_batch(made)
                if stream:
                    stream.close()
            status = 0
        except BrokenPipeError:  # nobody reads any more
            pass
        except BaseException:
            traceback.print_exc()
        finally:
            os._exit(status)
    os.close(sink)
    status = None
    try:
        with os.fdopen(source, "rb") as results:
            try:
                yield from pa.ipc.open_stream(results)
            except (pa.ArrowInvalid, OSError):  # no rows or cut short; the status tells which
                pass
    finally:  # a reader who stops early has closed the pipe, which ends the child
        status = os.waitstatus_to_exitcode(os.waitpid(child, 0)[1])
    if status:
        raise RuntimeError(f"the parser's process ended with {status}")


def extract_facts(files: DataFrame, wanted: Collection[str] = RECORD_TYPES) -> DataFrame:
    """Facts of files(run_id, path, module, text); see ``FACTS_SCHEMA``.  ``wanted`` names the
    record types to make; every file gives one ``file`` record, whatever is in it."""
    unknown = set(wanted) - set(RECORD_TYPES)
    if unknown:
        raise ValueError(f"unknown record types: {sorted(unknown)}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield from _in_child(lambda: _facts_of(part, wanted))

    return files.select("run_id", "path", "module", "text").mapInArrow(parse, FACTS_SCHEMA)


def extract_functions(facts: DataFrame) -> DataFrame:
    """One row per function or method, with its raw facts."""
    return facts.where(F.col("record_type") == "function").select(
        "run_id",
        "file_path",
        F.col("ord").alias("fn_ord"),
        "qname",
        "short_name",
        "line_start",
        "line_end",
        "calls",
        "idents",
        "branch_kinds",
    )


def extract_imports(facts: DataFrame) -> DataFrame:
    """One row per imported name; imports inside functions are not seen."""
    return facts.where(F.col("record_type") == "import").select(
        "run_id", "file_path", F.col("ord").alias("import_ord"), "module", "imported"
    )


def extract_parse_errors(facts: DataFrame) -> DataFrame:
    """One row per file which does not parse."""
    return facts.where(F.col("record_type") == "error").select(
        "run_id", "file_path", "error_line", "error_offset", "error_message"
    )
