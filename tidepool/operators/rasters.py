"""Decoding of image bytes inside the JVM: JPEG, PNG and GIF by Java's own readers, as a column expression.

One chain of calls a row reads the bytes once and hands out the samples as they lie in memory; `pixels.from_raster` brings
them into rows of RGB with what the image's header says. Bytes that cannot be read, and samples of more than 8 bits, give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "_raster"
#: How files of the formats begin.
SIGNATURES = {"JPEG": "FFD8FF", "PNG": "89504E470D0A1A0A", "GIF": "47494638"}


def raster(spark: SparkSession, content: str = "content") -> Column:
    """The samples of the image in a column of bytes, null where there is none."""
    jvm = spark._jvm
    types, trees = jvm.org.apache.spark.sql.types, jvm.org.apache.spark.sql.catalyst.expressions
    python, bridge = jvm.org.apache.spark.api.python.PythonUtils, jvm.org.apache.spark.sql.classic.ExpressionUtils
    java = lambda name: jvm.java.lang.Class.forName(name)

    def many(*items):
        out = jvm.java.util.ArrayList()
        for x in items:
            out.add(x)
        return python.toSeq(out)

    def call(target, name: str, kind):
        return trees.objects.Invoke(target, name, kind, many(), many(), True, True, True)

    of = lambda name: types.ObjectType(java(name))
    binary = types.DataType.fromDDL("binary")
    stream = trees.objects.NewInstance(java("java.io.ByteArrayInputStream"), many(bridge.expression(F.col(content)._jc)), many(), True, of("java.io.ByteArrayInputStream"), jvm.scala.Option.apply(None))
    image = trees.objects.StaticInvoke(java("javax.imageio.ImageIO"), of("java.awt.image.BufferedImage"), "read", many(stream), many(), True, True, True, jvm.scala.Option.apply(None))
    buffer = call(call(image, "getRaster", of("java.awt.image.WritableRaster")), "getDataBuffer", of("java.awt.image.DataBufferByte"))
    samples = Column(bridge.column(trees.TryEval(call(buffer, "getData", binary))))
    begins = F.hex(F.substring(content, 1, 8))
    known = F.lit(False)
    for s in SIGNATURES.values():
        known = known | begins.startswith(s)
    return F.when(known, samples)


def with_raster(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds the samples; sessions without a JVM of their own at hand get nulls, and the formats that Python reads."""
    spark = df.sparkSession
    made = raster(spark, content) if getattr(spark, "_jvm", None) is not None else F.lit(None).cast("binary")
    return df.withColumn(RASTER, made)
