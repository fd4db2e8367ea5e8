"""The driver contract without the text operators."""

import importlib.abc
import sys

import __spark_entry__ as contract


class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("leafmill.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


def test_other_queries_stay_without_the_text_operators(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("leafmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    found = contract.queries()
    assert "leaf_statistics" in found and not any(n.startswith("op") or n == "pipeline" for n in found)
    assert set(contract.oracle_sql()) <= set(found)
