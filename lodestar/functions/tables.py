"""Table functions for SQL: the extractors and the chunker as Python UDTFs, for LATERAL joins.

    register(spark)
    spark.sql("SELECT m.path, p.* FROM modules m, LATERAL code_rows(m.content, 'procedures') p")

``code_rows`` tells its columns from its second argument, a kind of ``code.SCHEMAS``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestar.functions import code, text


def _plain(value, kind):
    """Dicts as tuples in the order of their struct's fields, at any depth."""
    if isinstance(kind, StructType):
        return None if value is None else tuple(_plain(value[f.name], f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return None if value is None else [_plain(x, kind.elementType) for x in value]
    return value


def code_rows(schemas: dict[str, StructType]) -> type:
    """The class of ``code_rows``; it carries the schemas, which a worker cannot parse."""

    class CodeRows:
        """The rows of one kind (procedures, calls, references, queries, variables, complexity, issues) in a module's text."""

        @staticmethod
        def analyze(content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(content.dataType, StringType):
                raise ValueError("code_rows: the first argument is a module's text")
            if not kind.isConstantExpression or kind.value not in schemas:
                raise ValueError(f"code_rows: the second argument is one of {', '.join(sorted(schemas))}")
            return AnalyzeResult(schema=schemas[kind.value])

        def eval(self, content: str | None, kind: str) -> Iterator[tuple]:
            for row in code._READERS[kind](content) if content else []:
                yield _plain(row, schemas[kind])

    return CodeRows


class TextChunks:
    """chunk_index, chunk_total, start and chunk of a text, as the chunker cuts it."""

    @staticmethod
    def analyze(content: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, StringType):
            raise ValueError("text_chunks: the first argument is a text")
        numbers = [StructField(n, IntegerType()) for n in ("chunk_index", "chunk_total", "start")]
        return AnalyzeResult(schema=StructType([*numbers, StructField("chunk", StringType())]))

    def eval(self, content: str | None, size: int = text.CHUNK_SIZE, overlap: int = text.CHUNK_OVERLAP) -> Iterator[tuple]:
        spans = list(text.chunk_spans(content or "", size, overlap))
        for k, (a, b) in enumerate(spans):
            yield k, len(spans), a, content[a:b]


def register(spark: SparkSession) -> None:
    """``code_rows`` and ``text_chunks`` for this session's SQL."""
    spark.udtf.register("code_rows", udtf(code_rows({k: _parse_datatype_string(v) for k, v in code.SCHEMAS.items()})))
    spark.udtf.register("text_chunks", udtf(TextChunks))
