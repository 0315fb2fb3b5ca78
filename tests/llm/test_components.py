"""Components of an edge list: right, and with few tables and files on the way."""

import os
import random

from lexforge.llm import _shared, components


def written(monkeypatch):
    """The part files of each table, as they are written."""
    seen, materialize = [], _shared.materialize

    def noted(df, label, **options):
        made = materialize(df, label, **options)
        seen.append(sum(f.startswith("part-") for f in os.listdir(made.shared_path.removeprefix("file://"))))
        return made

    monkeypatch.setattr(_shared, "materialize", noted)
    return seen


def test_stars_are_written_once(spark, monkeypatch):
    seen = written(monkeypatch)
    edges = [(9, 1), (1, 5), (7, 2), (3, 3), (None, 4), (1, 5)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == [(5, 1), (7, 2), (9, 1)] and len(seen) == 1


def test_rounds_write_few_files_and_find_all_components(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 200)] + [(rng.randint(300, 700), rng.randint(300, 700)) for _ in range(250)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    seen = written(monkeypatch)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("12", "false")):
            spark.conf.set(k, v)
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == sorted((x, r) for x, r in root.items() if x != r)
    assert len(seen) > 1 and max(seen[1:]) <= spark.sparkContext.defaultParallelism
