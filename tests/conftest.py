import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from fraygraph.operators.graph_build import Graph  # noqa: E402
from fraygraph.session import local_session, settle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 2)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """Graph from edges 'a>b' (weight 1) or (a, b, weight), with source and target names."""

    def build(edges, sources, targets, extra=()):
        rows = [(*e.split(">"), 1) if isinstance(e, str) else e for e in edges]
        names = sorted({x for r in rows for x in r[:2]} | set(extra))
        vertices = settle(spark.createDataFrame([(n,) for n in names], "v string"))
        table = settle(spark.createDataFrame(rows, "src string, dst string, weight long"))
        roles = [(s, "S") for s in sources] + [(m, "M") for m in targets]
        return Graph(vertices, table, settle(spark.createDataFrame(roles, "v string, role string")))

    return build
