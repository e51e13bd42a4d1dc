"""Answers for a batch of requests of which some make the plan fail.

A plan of JVM expressions fails as a whole when one row makes an expression raise. The batch is
then searched for the requests at fault: a part that fails is halved, by a hash of the
requests' data, until it holds a single data text, which is answered with the failure's message; all
others keep their answers. Equal texts fail alike and are found once. With k different texts
at fault among n, about ``2 k log2(n / k)`` small jobs run, ``PROBES`` at a time, over rows that the
caller has persisted; a batch without them costs nothing more.

Only failures that data can cause count: SQL states of data and of raised errors, and exceptions that
functions throw for their arguments. A lost executor, a full disk or memory is raised.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import TYPE_CHECKING, Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..plugins import ERROR_PREFIX

if TYPE_CHECKING:
    from ..plugins import Scorer

PROBES = 8

# Classes of SQL states (data exception, cardinality, a function's own failure, raised by the user), and
# what functions throw for bad arguments.
DATA_STATES = ("22", "21", "39", "P0")
DATA_EXCEPTIONS = (
    "java.util.regex.",
    "java.time.",
    "java.util.NoSuchElementException",
    "java.lang.ArithmeticException",
    "java.lang.ArrayIndexOutOfBoundsException",
    "java.lang.ClassCastException",
    "java.lang.IllegalArgumentException",
    "java.lang.IndexOutOfBoundsException",
    "java.lang.NegativeArraySizeException",
    "java.lang.NullPointerException",
    "java.lang.NumberFormatException",
    "java.lang.StringIndexOutOfBoundsException",
    "java.lang.UnsupportedOperationException",
)

KEY = "__key"


def data_fault(err: Exception) -> str | None:
    """The message of a failure that the data caused, on one line; None for any other."""
    if isinstance(err, PythonException):
        return str(err).strip().splitlines()[-1]
    if isinstance(err, PySparkException):
        state = err.getSqlState()
        return str(err).splitlines()[0] if state and state.startswith(DATA_STATES) else None
    if isinstance(err, Py4JJavaError):
        causes = _causes(err.java_exception)
        for i, cause in enumerate(causes):
            name = cause.getClass().getName()
            if name.startswith(DATA_EXCEPTIONS):
                return _line(cause)
            if name.startswith("org.apache.spark.Spark") and (cause.getSqlState() or "").startswith(DATA_STATES):
                return _line(causes[-1] if i + 1 < len(causes) else cause)
    return None


def _causes(error: Any) -> list[Any]:
    """A Java exception and what caused it, outermost first."""
    out: list[Any] = []
    while error is not None and len(out) < 20:
        out.append(error)
        error = error.getCause()
    return out


def _line(error: Any) -> str:
    message = (error.getMessage() or "").splitlines()
    return ": ".join([error.getClass().getName().rsplit(".", 1)[-1], *message[:1]])


def _failure(scorer: Scorer, requests: DataFrame) -> str | None:
    """What answering these requests fails with, if it does."""
    try:
        scorer.respond(requests).agg(F.bit_xor(F.xxhash64("request_id", "result"))).collect()
    except (PySparkException, Py4JJavaError) as err:
        fault = data_fault(err)
        if fault is None:
            raise
        return fault
    return None


def faults(scorer: Scorer, requests: DataFrame) -> list[tuple[int, str]]:
    """Key and message of each data text that cannot be answered."""
    keyed = requests.withColumn(KEY, F.xxhash64("data"))

    def part(low: int, high: int) -> DataFrame:
        return keyed.where(F.col(KEY).between(low, high))

    def judge(bounds: tuple[int, int]) -> tuple[str | None, int, int]:
        rows = part(*bounds)
        fault = _failure(scorer, rows.drop(KEY))
        if fault is None:
            return None, 0, 0
        low, high = rows.agg(F.min(KEY), F.max(KEY)).first()
        return fault, low, high

    found: list[tuple[int, str]] = []
    spark = requests.sparkSession
    with ThreadPoolExecutor(PROBES) as pool:
        open_ = [(-(2**63), 2**63 - 1)]
        while open_:
            ran = pool.map(inheritable_thread_target(spark)(judge), open_)
            open_ = []
            for fault, low, high in ran:
                if fault is None:
                    continue
                if low == high:
                    found.append((low, fault))
                    continue
                middle = low + (high - low) // 2
                open_ += [(low, middle), (middle + 1, high)]
    return found


def answered_apart(scorer: Scorer, requests: DataFrame) -> DataFrame:
    """``request_id, result`` of requests of which some make the plan fail."""
    found = faults(scorer, requests)
    if not found:
        return scorer.respond(requests)
    spark = requests.sparkSession
    bad = spark.createDataFrame([(key, ERROR_PREFIX + fault) for key, fault in found], f"{KEY} long, result string")
    keyed = requests.withColumn(KEY, F.xxhash64("data"))
    good = keyed.join(bad, KEY, "left_anti").drop(KEY)
    refused = keyed.join(bad, KEY).select("request_id", "result")
    return scorer.respond(good).unionByName(refused)
