"""How the kernels are found and built, in sessions of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from geostrata.functions import kernels
from tests.conftest import DATA, ROOT

CODE = """
import json, os, sys
from pathlib import Path
import pyspark
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
cache = Path(os.environ["GEOSTRATA_CACHE"])
rows = entry.queries()["tpch_q1"](spark, sys.argv[1]).count()
before = [p.name for p in cache.iterdir()]
area = entry.queries()["st_area_length"](spark, sys.argv[1]).first()["z"]
print("RESULT", json.dumps([pyspark.__file__, rows, before, area, [str(p) for p in cache.rglob("*.jar")]]))
"""


def run(tmp_path, **more):
    home = Path(pyspark.__file__).parent
    lib = sorted((home / "python" / "lib").glob("*.zip")) if (home / "python" / "lib").is_dir() else sorted(home.parent.parent.glob("*.zip"))
    cache = tmp_path / "cache"
    cache.mkdir(mode=0o700)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*map(str, lib), str(ROOT)]), "GEOSTRATA_CACHE": str(cache), "SPARK_HOME": os.environ.get("SPARK_HOME") or str(home)} | more
    done = subprocess.run([sys.executable, "-c", CODE, DATA], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    line = next((x for x in done.stdout.splitlines() if x.startswith("RESULT ")), None)
    assert line, done.stderr[-3000:]
    return json.loads(line.removeprefix("RESULT "))


def test_pyspark_from_its_zip_and_an_empty_cache(tmp_path):
    """No kernel is built for a statement without spatial functions; then one is, though pyspark has no jars beside it."""
    where, rows, before, area, jars = run(tmp_path)
    assert rows > 0 and before == [] and area == 0.0 and len(jars) == 1
    if list((Path(pyspark.__file__).parent / "python" / "lib").glob("pyspark.zip")):
        assert "pyspark.zip" in where


def test_prebuilt_jar(geo, tmp_path):
    """A jar that is named is used as it is, and nothing is compiled."""
    out = tmp_path / "own.jar"
    kernels.build(geo, out)
    *_, area, jars = run(tmp_path, GEOSTRATA_KERNELS_JAR=str(out))
    assert area == 0.0 and jars == []


def test_errors_say_what_javac_said(geo, tmp_path, monkeypatch):
    monkeypatch.setattr(kernels, "sources", lambda: {"Broken.java": "class Broken { Missing x; }"})
    with pytest.raises(kernels.KernelsUnavailable, match="cannot find symbol"):
        kernels.build(geo, tmp_path / "x.jar")


def test_folders_of_others_are_not_trusted(geo, tmp_path, monkeypatch):
    monkeypatch.setenv("GEOSTRATA_CACHE", str(tmp_path))
    monkeypatch.setattr(kernels, "_built", {})
    first = Path(kernels.jar(geo))
    assert first.is_relative_to(tmp_path)
    first.parent.chmod(0o777)
    monkeypatch.setattr(kernels, "_built", {})
    assert not Path(kernels.jar(geo)).is_relative_to(tmp_path)
