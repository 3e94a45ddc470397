import importlib
import sys

from marginflow.registry import oracles, registered


def test_entry_works_without_the_training_data_operators(monkeypatch):
    """The margin queries are registered whether or not the other operators can be imported."""
    for name in [m for m in sys.modules if m.startswith(("marginflow.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "marginflow.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registered())
    assert set(entry.oracle_sql()) == set(oracles()) <= set(registered())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
