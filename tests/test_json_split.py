import json
import random

import pytest

from tablewright.sources import datasets
from tablewright.sources.json_split import json_elements


def files(tmp_path, roots, indent=None):
    for k, root in enumerate(roots):
        (tmp_path / f"f{k}.json").write_text(json.dumps(root, ensure_ascii=False, indent=indent) + "\n" * (k % 2), encoding="utf-8")
    return f"file://{tmp_path}/*.json"


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.path, r.ord)):
        out.setdefault(r.path.rsplit("/", 1)[1], []).append((r.ord, json.loads(r.json)))
    return out


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", '"pages": [', " "]) for _ in range(rng.randrange(9)))


def thing(rng, deep=0):
    kind = rng.randrange(6 if deep < 3 else 3)
    if kind == 0:
        return odd_text(rng)
    if kind == 1:
        return rng.choice([1, -2.5, True, None])
    if kind == 2:
        return {}
    if kind == 3:
        return [thing(rng, deep + 1) for _ in range(rng.randrange(3))]
    return {odd_text(rng) + str(k): thing(rng, deep + 1) for k in range(rng.randrange(4))} | ({"pages": [1, {"x": 2}]} if deep else {})


@pytest.mark.parametrize("indent,size", [(None, 150), (1, 1 << 20)])
def test_elements_equal_json_loads(spark, tmp_path, indent, size):
    rng = random.Random(size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lists = [[{"v": thing(rng)} for _ in range(rng.randrange(1, 12))] for _ in range(4)] + [[], [1, "a]}", None, {"x": 1}, True, {"y": [1, {}]}, "z", 3]]
        path = files(tmp_path, [{"schema": {"name": thing(rng)}, "other": [{"pages": [{"no": 1}]}], "pages": own, "after": [{"no": 2}]} for own in lists], indent)
        want = {f"f{k}.json": list(enumerate(own)) for k, own in enumerate(lists) if own}
        assert found(json_elements(spark, path, "pages")) == want
        (tmp_path / "roots").mkdir()
        path = files(tmp_path / "roots", lists, indent)
        assert found(json_elements(spark, path)) == want
        assert json_elements(spark, path, "pages").collect() == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_is_many_tasks_and_equals_whole_reading(spark, tmp_path):
    rows = [{"record_id": f"r{k}", "page": k, "parameter": f'p "{k}" }}', "values": {"a": [k, {"b": "}"}], "c": None}} for k in range(400)]
    (tmp_path / "one.json").write_text(json.dumps({"records": rows}))
    path = f"file://{tmp_path}/one.json"
    want = sorted(datasets.read_records(spark, path).collect(), key=lambda r: r.ord)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
        got = datasets.read_split_records(spark, path, "records")
        assert sorted(got.collect(), key=lambda r: r.ord) == want and got.columns == datasets.read_records(spark, path).columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
