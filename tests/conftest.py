from __future__ import annotations

import os
import random

import pytest

from calibra.session import build_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "calibra-tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def reports(spark):
    """600 rows, 13 classes: 45, 25, 16, 8 percent and nine rare ones."""
    rng = random.Random(42)
    shares = [0.45, 0.25, 0.16, 0.08] + [0.06 / 9] * 9
    counts = [max(2, round(600 * s)) for s in shares]
    rows = []
    for rank, count in enumerate(counts):
        for _ in range(count):
            rows.append(
                (
                    len(rows),
                    round(2.5 * rank + rng.gauss(0, 1.5), 1),
                    round(rng.gauss(10, 3) + 1.25 * rank, 1),
                    round(rng.expovariate(0.5), 1),
                    "ABCD"[(101 + rank) % 4] if rng.random() > 0.3 else rng.choice("ABCD"),
                    101 + rank,
                )
            )
    return spark.createDataFrame(rows, "id int, n1 double, n2 double, n3 double, cat string, code int").cache()
