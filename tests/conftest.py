import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("codeloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def mini_repo(tmp_path_factory):
    """A small depot: a class, a nested function, ``async``, a test file, a package file, an
    ignored folder and a file that does not parse."""
    root = tmp_path_factory.mktemp("depot")
    for folder in ("stock", "dock", "tests", "build"):
        (root / folder).mkdir()
    (root / "stock" / "__init__.py").write_text("import json\n")
    (root / "stock" / "shelf.py").write_text(
        "from dock import gate\n\n\n"
        "class Shelf:\n"
        "    def load_product(self, sku):\n"
        "        for bay in self.bays:\n"
        "            while bay.busy(sku):\n"
        "                bay.turn()\n"
        "        return gate.open_gate(sku)\n\n"
        "    def sweep(self):\n"
        "        def drop(bay):\n"
        "            return bay.clear()\n\n"
        "        return [drop(b) for b in self.bays]\n"
    )
    (root / "dock" / "gate.py").write_text(
        "async def open_gate(sku):\n"
        "    try:\n"
        "        await ring(sku)\n"
        "    except OSError:\n"
        "        return save_shipment(sku)\n\n\n"
        "def ring(sku):\n"
        "    return sku\n\n\n"
        "def save_shipment(shipment):\n"
        "    return shipment.code\n"
    )
    (root / "dock" / "broken.py").write_text("def half(:\n")
    (root / "tests" / "test_gate.py").write_text("def test_ring():\n    assert ring(3) == 3\n")
    (root / "build" / "made.py").write_text("def made():\n    return 1\n")
    return root
