"""Extractions as table functions, for use in SQL: ``SELECT ... FROM files, LATERAL lua_functions(content)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusloom.operators.luafunctions import REGISTER_CALL, lua_functions

_FOUND = ("name", "body", "comment", "register")


@udtf
class LuaFunctions:
    """Functions of a text: (ord, name, body, comment, register), in order.

    Arguments: the text, and by name ``require_register`` and ``register_call`` as in ``extract_functions``. They are checked when the query
    is analysed, so a wrong call fails before a task starts.
    """

    @staticmethod
    def analyze(code: AnalyzeArgument, require_register: AnalyzeArgument | None = None, register_call: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(code.dataType, StringType):
            raise ValueError(f"lua_functions needs a text, not {code.dataType.simpleString()}")
        for name, given in (("require_register", require_register), ("register_call", register_call)):
            if given is not None and not given.isConstantExpression:
                raise ValueError(f"lua_functions needs a constant as {name}")
        schema = StructType().add("ord", IntegerType())
        for name in _FOUND:
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema=schema)

    def eval(self, code: str | None, require_register: bool = True, register_call: str = REGISTER_CALL) -> Iterator[tuple]:
        if code and "function" in code:
            for i, found in enumerate(lua_functions(code, require_register, register_call)):
                yield i, *found


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("lua_functions", LuaFunctions)
