"""Every global name that a registered query's module reads is defined there."""

import builtins
import dis
import inspect
from types import CodeType

from catalog import queries


def read_names(code):
    for step in dis.get_instructions(code):
        if step.opname == "LOAD_GLOBAL":
            yield step.argval
    for inner in code.co_consts:
        if isinstance(inner, CodeType):
            yield from read_names(inner)


def test_no_query_reads_an_unknown_name():
    known = set(vars(queries)) | set(vars(builtins))
    functions = [f for f in vars(queries).values() if inspect.isfunction(f) and f.__module__ == queries.__name__]
    assert {(f.__name__, n) for f in functions for n in read_names(f.__code__) if n not in known} == set()
