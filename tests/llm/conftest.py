import pytest

pytest.importorskip("quarry.llm")
