"""Which modules the registered queries need, and what happens where one is missing."""

import importlib

import pytest

import __spark_entry__ as entry


def raising(name, missing):
    def load(asked, *_):
        if asked == name:
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return importlib.__import__(asked)

    return load


@pytest.mark.parametrize(("missing", "absent"), [("public_tokenizers", True), ("loam.llm", True), ("loam.llm.queries", True), ("loam.sources.gone", False), ("loam.llm.gone", False)])
def test_missing_libraries_leave_queries_out_and_broken_ones_raise(monkeypatch, missing, absent):
    monkeypatch.setattr(entry.importlib, "import_module", raising("loam.llm.queries", missing))
    if absent:
        assert entry._llm_modules() == []
    else:
        with pytest.raises(ImportError):
            entry._llm_modules()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
