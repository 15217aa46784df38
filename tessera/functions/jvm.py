"""Similarities of whole texts in the JVM: Java sources beside this file, compiled once a session by the compiler that Spark has.

A ratio of texts of some thousand letters is some million steps of whole numbers, for which Python needs ten times as long.
"""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HERE = Path(__file__).resolve().parent
#: What takes the place of the two texts.
LIKENESS = ("addr_fuzz_ratio", "addr_token_sort_ratio", "addr_token_set_ratio", *[f"{of}_{x}" for x in ("addr_set", "addr_numbers") for of in ("a_count", "b_count", "a_shared")])


def _source(name: str) -> str:
    try:
        return (HERE / name).read_text(encoding="utf-8")
    except NotADirectoryError:  # in an archive
        return __loader__.get_data(str(HERE / name)).decode("utf-8")


def _compiled(jvm, vectors: bool) -> dict[str, bytes]:
    """Bytecodes by class; with vectors only where the JVM has those of four longs."""
    if vectors and jvm.java.lang.Class.forName("jdk.incubator.vector.LongVector").getField("SPECIES_PREFERRED").get(None).length() < 4:
        raise ValueError("short vectors")
    both = _source("Lanes.java" if vectors else "LanesPlain.java") + _source("Likeness.java") + _source("Packed.java")
    imports = dict.fromkeys(re.findall(r"(?m)^import .*;$", both))
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook("\n".join(imports) + re.sub(r"(?m)^import .*;$", "", both))
    codes = compiler.getBytecodes()
    return {name: bytes(codes[name]) for name in codes}


def _made(spark: SparkSession, name: str):
    """An instance of a class of the sources, whose jar every executor gets."""
    jvm, context = spark._jvm, spark.sparkContext
    if not hasattr(context, "_tessera_jar"):
        try:
            made = _compiled(jvm, True)
        except (Py4JError, ValueError):
            made = _compiled(jvm, False)
        path = f"{tempfile.mkdtemp(prefix='tessera-')}/tessera.jar"
        with zipfile.ZipFile(path, "w") as jar:
            for each, code in made.items():
                jar.writestr(f"{each.replace('.', '/')}.class", code)
        spark.sql(f"ADD JAR '{path}'")
        context._tessera_jar = spark._jsparkSession.sharedState().jarClassLoader()  # shared by all sessions of the context
    none = lambda kind: context._gateway.new_array(kind, 0)
    return context._tessera_jar.loadClass(name).getDeclaredConstructor(none(jvm.java.lang.Class)).newInstance(none(jvm.java.lang.Object))


def _encoder(spark: SparkSession, schema: T.StructType):
    return spark._jvm.org.apache.spark.sql.Encoders.row(spark._jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json()))


def packed(df: DataFrame, text: str) -> DataFrame:
    """df with a column of words with single blanks as likeness() takes it."""
    spark = df.sparkSession
    rows = df.select(*[c for c in df.columns if c != text], F.coalesce(text, F.lit("")).alias(text))
    return DataFrame(rows._jdf.map(_made(spark, "Packed"), _encoder(spark, rows.schema)), spark)


def likeness(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with LIKENESS in place of the packed columns a and b; fastest where rows of one a follow each other."""
    spark = df.sparkSession
    rows = df.select(*[c for c in df.columns if c not in (a, b)], F.coalesce(a, F.lit("")).alias(a), F.coalesce(b, F.lit("")).alias(b))
    made = T.StructType([*rows.schema.fields[:-2], *[T.StructField(c, T.DoubleType(), False) for c in LIKENESS]])
    return DataFrame(rows._jdf.mapPartitions(_made(spark, "Likeness"), _encoder(spark, made)), spark)
