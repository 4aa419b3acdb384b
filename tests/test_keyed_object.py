"""One giant keyed object read by many tasks, against json.loads."""

import json
import random

import pytest

from growthlens import schemas
from growthlens.sources import keyed_json as KJ
from pyspark.sql import types as T

TEXTS = ["plain", 'a "quoted" one', "back\\slash", "\\", '\\"', "}{", "]},{[", "tab\tnew\nline", "Ünï{", '","x":{"', ""]


def _entry(rng):
    return {"n": rng.choice(TEXTS) * rng.randint(0, 30), "i": rng.choice(TEXTS), "s": rng.random(),
            "c": [rng.choice(TEXTS) for _ in range(rng.randint(0, 3))]}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_objects_equal_json_loads(spark, tmp_path, small_splits, indent):
    rng = random.Random(3)
    files = [{f"{rng.choice(TEXTS)}{f}-{i}": _entry(rng) for i in range(n)} for f, n in enumerate((70, 1, 0))]
    for f, obj in enumerate(files):
        (tmp_path / f"f{f}.json").write_text(json.dumps(obj, indent=indent, ensure_ascii=f == 0) + "\n" * f)
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 8
    got = KJ.read_keyed_object(spark, str(tmp_path), schemas.INDEX_ENTRY, "p").collect()
    want = {k: v for obj in files for k, v in obj.items()}
    assert len(got) == len(want) and {r.p: r.value.asDict() for r in got} == want


def test_arrays_equal_json_loads(spark, tmp_path, small_splits):
    rng = random.Random(4)
    obj = {f"{rng.choice(TEXTS)}-{i}": [{"p": rng.choice(TEXTS), "s": rng.random()} for _ in range(rng.randint(0, 9))]
           for i in range(60)}
    (tmp_path / "ranks.json").write_text(json.dumps(obj))
    got = KJ.read_keyed_object(spark, str(tmp_path), T.ArrayType(schemas.RANK_ENTRY), "category", close="]").collect()
    assert {r.category: [x.asDict() for x in r.value] for r in got} == obj and len(got) == len(obj)


def test_no_entries(spark, tmp_path):
    (tmp_path / "a.json").write_text(" {} ")
    (tmp_path / "b.json").write_text("")
    assert KJ.read_keyed_object(spark, str(tmp_path), schemas.INDEX_ENTRY).count() == 0
