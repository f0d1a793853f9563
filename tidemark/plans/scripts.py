"""SQL statements and scripts, and the outcome records of runs."""

from __future__ import annotations

import json
import traceback
from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import trace_lines
from tidemark.schemas import ENVELOPE
from tidemark.sources.delimited import read_delimited, result_columns, save_delimited

def run_statement(spark: SparkSession, statement: str) -> DataFrame:
    return spark.sql(statement)


_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"


def run_script(spark: SparkSession, script: str | Sequence[str]) -> DataFrame:
    """Runs statements in order and returns the result of the last one.

    A list is run one by one. A text is run as one SQL script block, so Spark itself finds
    where its statements end. A block gives the rows of its last query, whatever follows it;
    so Spark's parser is asked what the last statement is. One that lists something (SHOW,
    DESCRIBE, EXPLAIN, ...) is run by itself behind the others, and behind one that gives no
    rows (CREATE, INSERT, ...) the result is empty.
    """
    if not isinstance(script, str):
        result = None
        for statement in script:
            result = spark.sql(statement)
        if result is None:
            raise ValueError("the script is empty")
        return result
    block, statements = _parsed(spark, script) if script.strip("; \t\r\n") else ("", [])
    if not statements:
        raise ValueError("the script is empty")
    last = statements[-1]
    if last.getClass().getSimpleName() != "SingleStatement":
        return spark.sql(block)
    # The parser counts code points, as Python does.
    start, end = last.origin().startIndex().get(), last.origin().stopIndex().get() + 1
    if len(statements) == 1:
        return spark.sql(block[start:end])
    plan = last.parsedPlan()
    if not (_is(spark, plan, "Command") or _is(spark, plan, "ParsedStatement")):
        return spark.sql(block)
    if not plan.output().isEmpty():
        spark.sql(f"{block[:start]}\nEND")
        return spark.sql(block[start:end])
    spark.sql(block)
    return spark.createDataFrame([], "")


def _parsed(spark: SparkSession, script: str) -> tuple[str, list]:
    """The text as a block, and its statements as Spark's parser tells them apart."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    error = None
    # The last statement may or may not have its semicolon, also before a comment.
    for end in ("\n;\nEND", "\nEND"):
        block = f"BEGIN\n{script}{end}"
        try:
            found = parser.parsePlan(block).collection()
            return block, [found.apply(i) for i in range(found.size())]
        except ParseException as refused:
            error = error or refused
    raise error


def _is(spark: SparkSession, plan, kind: str) -> bool:
    return spark._jvm.java.lang.Class.forName(f"{_LOGICAL}.{kind}").isInstance(plan)


def save_result(df: DataFrame, path: str) -> None:
    """A result as tab-delimited text, its schema beside it."""
    save_delimited(df, path)
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
    schema.write.text(f"{path}.schema")


def load_result(spark: SparkSession, path: str) -> DataFrame:
    """A saved result with the columns and types it was saved with."""
    schema = spark.read.text(f"{path}.schema", wholetext=True).first()[0]
    return read_delimited(spark, path, T.StructType.fromJson(json.loads(schema)))


def run_and_save(
    spark: SparkSession, script: str | Sequence[str], root: str, handle: str, options=None
) -> DataFrame:
    """Runs a script, saves its last result under ``root/handle``, returns the outcome record.

    A statement without a result (DDL and the like) is not run again: its outcome holds
    an empty inline result instead of columns.
    """
    path = f"{root.rstrip('/')}/{handle}"
    try:
        result = run_script(spark, script)
        data = {"outputDir": path, "handle": handle}
        if result.columns:
            save_result(result, path)
            data["message"] = "saved, see load_result"
            data["columns"] = [row.asDict() for row in result_columns(result).collect()]
        else:
            data["message"] = "done, without a result"
            data["result"] = []
        return outcome(spark, handle, True, data, options)
    except Exception as error:
        return failure(spark, handle, error, options)


def outcome(spark: SparkSession, handle: str, success: bool, data: dict, options=None) -> DataFrame:
    """One outcome record (handle, success, data, options), the last two as JSON."""
    row = (handle, success, json.dumps(data), json.dumps(options or {}))
    return spark.createDataFrame([row], ENVELOPE)


def failure(spark: SparkSession, handle: str, error: Exception, options=None) -> DataFrame:
    """The outcome record of a failed run: the error and its trace as lines."""
    trace = "".join(traceback.format_exception(error))
    row = [(handle, str(error), trace, json.dumps(options or {}))]
    failed = spark.createDataFrame(row, "handle string, error string, trace string, options string")
    data = F.to_json(F.struct("error", trace_lines(F.col("trace")).alias("trace")))
    return failed.select("handle", F.lit(False).alias("success"), data.alias("data"), "options")
