import pytest

pytest.importorskip("kikitori.llm")
