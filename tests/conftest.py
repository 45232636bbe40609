import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from weftline.session import drop_all, local_session

    s = local_session(4, partitions=2, memory="4g")
    # tiny tables: compiling a plan takes longer than running it
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    yield s
    drop_all(s)
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
