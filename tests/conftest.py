import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import get_session

    session = get_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sliced(monkeypatch):
    """Brackets that must be narrowed, and buckets of a few values."""
    from plumbline import thresholds

    monkeypatch.setattr(thresholds, "BRACKET_VALUES", 3)
    monkeypatch.setattr(thresholds, "SKETCH_SIZE", 200)
    monkeypatch.setattr(thresholds, "RANK_MARGIN", 0.1)
    monkeypatch.setattr(thresholds, "RANK_BUCKETS", 7)
