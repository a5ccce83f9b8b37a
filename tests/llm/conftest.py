import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def table(tmp_path_factory):
    """Writes tables of a test under one folder, as a query reads them."""
    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)
    return write
