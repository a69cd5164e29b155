"""The JVM kernels: built once from source, or taken from a prebuilt jar, and added to a session.

The kernels are stateless UDF classes over the JTS library that Spark ships. ``spark.geostrata.kernels.jar`` (or the
variable GEOSTRATA_KERNELS_JAR) names a prebuilt jar; without it javac (part of a JDK) builds one on first use into a
cache folder of the driver that only its owner can write. ADD JAR hands the jar to the executors. What javac compiles
against is asked of the running JVM, so it does not matter how Python found pyspark.

``python -m geostrata.functions.kernels out.jar`` builds a jar to keep."""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import subprocess
import sys
import tempfile
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from geostrata.java import generate

SOURCES = Path(__file__).resolve().parents[1] / "java" / "geostrata"
JAR = "spark.geostrata.kernels.jar"
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
SHAPE = T.StructType([T.StructField("plain", T.IntegerType()), *BOX.fields])
ANALYZE = T.StructType(
    [T.StructField("bytes", T.LongType()), T.StructField("points", T.LongType()), T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax"))]
)
_RESULTS = {"Double": T.DoubleType(), "Boolean": T.BooleanType(), "Long": T.LongType(), "String": T.StringType(), "G": T.BinaryType()}
#: A class of each library that the sources import.
_NEEDED = ("org.locationtech.jts.geom.Geometry", "org.apache.spark.sql.api.java.UDF1", "org.apache.spark.sql.RowFactory", "scala.Product")
#: Kernels by their hidden names.
BY_NAME = {f"__k_{k[0].lower()}": k for k in generate.KERNELS}
_built: dict[str, str] = {}


class KernelsUnavailable(RuntimeError):
    """The kernels can neither be found nor built here."""


def _origin(spark: SparkSession, name: str) -> str | None:
    """The jar that the JVM has a class from."""
    try:
        source = spark._jvm.java.lang.Class.forName(name).getProtectionDomain().getCodeSource()
        return unquote(urlparse(source.getLocation().toString()).path) if source is not None else None
    except Exception:  # noqa: BLE001 - a class that is elsewhere is looked for on the class path
        return None


def class_paths(spark: SparkSession) -> list[str]:
    """Class paths to try, best first: the folders that hold the classes needed, the JVM's own class path, SPARK_HOME."""
    found = [x for x in dict.fromkeys(_origin(spark, n) for n in _NEEDED) if x]
    folders = list(dict.fromkeys(str(Path(x).parent / "*") for x in found if x.endswith(".jar")))
    own = spark._jvm.java.lang.System.getProperty("java.class.path") or ""
    home = os.environ.get("SPARK_HOME") or spark.sparkContext.getConf().get("spark.home", None)
    tries = [os.pathsep.join([*found, *folders]), own, os.pathsep.join(x for x in (own, *folders, str(Path(home, "jars", "*")) if home else "") if x)]
    return [x for x in dict.fromkeys(tries) if x]


def sources() -> dict[str, str]:
    out = {p.name: p.read_text() for p in sorted(SOURCES.glob("*.java"))}
    return out | {"Kernels.java": generate.HEAD + "\n".join(generate.kernel(*k) for k in generate.KERNELS) + "}\n"}


def build(spark: SparkSession, out: Path) -> None:
    """Compile the sources and write the jar."""
    home = Path(spark._jvm.java.lang.System.getProperty("java.home") or "/", "bin")
    javac, jar_ = (shutil.which(x) or shutil.which(x, path=str(home)) for x in ("javac", "jar"))
    if not javac or not jar_:
        raise KernelsUnavailable(f"the spatial functions need javac and jar (a JDK) on the driver, or a prebuilt jar named by {JAR}")
    with tempfile.TemporaryDirectory() as work:
        src, classes, built = Path(work, "src"), Path(work, "classes"), Path(work, "kernels.jar")
        src.mkdir()
        for name, text in sources().items():
            (src / name).write_text(text)
        said = ""
        for path in class_paths(spark):
            shutil.rmtree(classes, ignore_errors=True)
            classes.mkdir()
            done = subprocess.run([javac, "-nowarn", "-encoding", "UTF-8", "-cp", path, "-d", str(classes), *map(str, sorted(src.glob("*.java")))], capture_output=True, text=True)
            if not done.returncode:
                break
            said = f"javac -cp {path[:300]}\n{done.stderr[-4000:]}"
        else:
            raise KernelsUnavailable(f"the kernels do not compile:\n{said}")
        done = subprocess.run([jar_, "cf", str(built), "-C", str(classes), "."], capture_output=True, text=True)
        if done.returncode:
            raise KernelsUnavailable(f"jar: {done.stderr[-2000:]}")
        part = Path(f"{out}.{os.getpid()}")
        shutil.copy(built, part)
        os.replace(part, out)


def _private(folder: Path) -> bool:
    """Whether only its owner, this user, can write a folder."""
    at = folder.lstat()
    return stat.S_ISDIR(at.st_mode) and at.st_uid == os.getuid() and not at.st_mode & 0o022


def jar(spark: SparkSession) -> str:
    """Path of the kernels' jar: the one that the session names, else one built from these sources before, else a new one."""
    named = spark.conf.get(JAR, None) or spark.sparkContext.getConf().get(JAR, None) or os.environ.get("GEOSTRATA_KERNELS_JAR")
    if named:
        return named
    mark = hashlib.sha256("".join(sources().values()).encode() + spark.version.encode()).hexdigest()[:16]
    if mark in _built and os.path.exists(_built[mark]):
        return _built[mark]
    folder = Path(os.environ.get("GEOSTRATA_CACHE", tempfile.gettempdir())) / f"geostrata-kernels-{mark}-{os.getuid()}"
    folder.mkdir(mode=0o700, parents=True, exist_ok=True)
    if not _private(folder):  # someone else's: what lies in it is not trusted
        folder = Path(tempfile.mkdtemp(prefix="geostrata-kernels-"))
    out = folder / "geostrata-kernels.jar"
    if not out.exists():
        build(spark, out)
    _built[mark] = str(out)
    return str(out)


def add(spark: SparkSession) -> None:
    """Add the jar to the session."""
    spark.sql(f"ADD JAR '{jar(spark)}'")


def register(spark: SparkSession, hidden: str) -> None:
    """Register one kernel under its hidden name, __k_<class>."""
    name, _, result, _ = BY_NAME[hidden]
    kind = _RESULTS.get(result) or {"Box2D": BOX, "Shape": SHAPE, "Analyze": ANALYZE}[name]
    spark.udf.registerJavaFunction(hidden, f"geostrata.Kernels$St{name}", kind)


if __name__ == "__main__":
    build(SparkSession.builder.getOrCreate(), Path(sys.argv[1]).resolve())
