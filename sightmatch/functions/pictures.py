"""Pictures out of the bytes of their files."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: where Spark's image source keeps its decoder.
_SCHEMA = "org.apache.spark.ml.image.ImageSchema"


def decoded(spark: SparkSession, origin: Column, content: Column) -> Column:
    """The picture in `content` as the struct of Spark's image source, by that source's decoder; null where it
    finds none.  `origin` is the address the struct names.

    The source generates the code of a serializer anew for each file, several milliseconds that are most of
    its time for small pictures; as an expression its decoder runs in code generated once a stage.  No API gives
    the decoder away, so the expression is put together from Spark's own parts."""
    jvm = spark.sparkContext._jvm
    catalyst = jvm.org.apache.spark.sql.catalyst
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()

    def kind(name: str):
        return jvm.org.apache.spark.sql.types.ObjectType(loader.loadClass(name))

    def constant(value, name: str):
        return catalyst.expressions.Literal.fromObject(value, kind(name))

    def call(on, method: str, returns, *args, nulls: bool = True):
        """on.method(args); with `nulls` null where an argument is."""
        listed, none = jvm.PythonUtils.toSeq(list(args)), jvm.PythonUtils.toSeq([])
        return catalyst.expressions.objects.Invoke(on, method, returns, listed, none, nulls, True, True)

    # The decoder is a method of a Scala object, which each executor has in a static field of its class.
    owner = constant(loader.loadClass(f"{_SCHEMA}$"), "java.lang.Class")
    name = constant("MODULE$", "java.lang.String")
    field = call(owner, "getField", kind("java.lang.reflect.Field"), name)
    decoder = call(field, "get", kind(f"{_SCHEMA}$"), constant(None, "java.lang.Object"), nulls=False)
    address = call(bridge.expression(origin._jc), "toString", kind("java.lang.String"))
    found = call(decoder, "decode", kind("scala.Option"), address, bridge.expression(content._jc))
    row = catalyst.expressions.objects.UnwrapOption(kind("org.apache.spark.sql.Row"), found)
    schema = jvm.org.apache.spark.ml.image.ImageSchema.imageSchema().asNullable()
    convert = constant(
        catalyst.CatalystTypeConverters.createToCatalystConverter(schema), "scala.Function1"
    )
    return _column(bridge.column(call(convert, "apply", schema, row)))["image"]


def _column(jc) -> Column:
    """A column of Spark's JVM side as one of Python's."""
    return type(F.lit(0))(jc)
