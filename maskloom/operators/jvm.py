"""Functions in Java, for sequential searches that are too much work for Python workers, compiled by the Janino that Spark compiles its own code with."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

#: (application, class): the function's object on the driver, and the folder of its jar, which goes when the driver ends.
_COMPILED: dict[tuple[str, str], tuple[object, tempfile.TemporaryDirectory]] = {}


def registered(spark: SparkSession, name: str, returns: DataType) -> str:
    """The name for call_udf of the function in name.java beside this file; executors get its class in a jar from the driver."""
    sc, jvm = spark.sparkContext, spark._jvm
    key = (sc.applicationId, name)
    if key not in _COMPILED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jsc.sc().getClass().getClassLoader())
        compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
        folder = tempfile.TemporaryDirectory(prefix="maskloom-", ignore_cleanup_errors=True)
        jar = Path(folder.name).resolve() / f"{name}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for c, code in compiler.getBytecodes().items():
                z.writestr(f"{c.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(f"file:{jar}")
        _COMPILED[key] = compiler.getClassLoader().loadClass(f"maskloom.{name}").newInstance(), folder
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(returns.json())
    spark._jsparkSession.udf().register(f"maskloom_{name}", _COMPILED[key][0], kind)
    return f"maskloom_{name}"
