import random

import numpy as np
import pytest

from millrace.llm import kernels as K
from millrace.llm import storage
from millrace.llm.components import components
from millrace.llm.storage import Work


def brute(edges):
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)], "chain": [(i, i + 1) for i in range(40)], "hub": [(500, i) for i in range(300)] + [(7, 7)], "none": []}[kind]
    df = spark.createDataFrame([*edges, *edges[:3]], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df, Work(spark, "test")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_local_roots():
    rng = random.Random(2)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(40)]
    nodes, roots = K.local_roots(*(np.array(x) for x in zip(*edges)))
    assert dict(zip(nodes.tolist(), roots.tolist())) == brute(edges)


def test_runs_stop_at_documents_and_hashes_follow_bytes():
    texts = [b"ab cd", b"", b"cd", b" cd ef"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    start, end = K.runs(K.NOT_SPACE[data], offsets)
    words = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert words == [b"ab", b"cd", b"cd", b"cd", b"ef"]
    h = K.span_hash(K.prefix_sums(data), start, end)
    assert len(set(h.tolist())) == 3 and h[1] == h[2] == h[3]
    assert list(K.slices(offsets, 5)) == [(0, 2), (2, 3), (3, 4)]


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        applicationId, master = "app-x", "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
    Session.conf.get = staticmethod(lambda key, default: "hdfs://store/dir/")
    assert storage.shared_dir(Session()) == "hdfs://store/dir"
