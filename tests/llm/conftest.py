import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import EDGES, frame  # noqa: E402


@pytest.fixture
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture
def nothing(spark):
    return frame(spark, [])
