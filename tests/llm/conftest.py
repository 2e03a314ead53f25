import pytest

pytest.importorskip("trowel.llm")
