"""Named sources, sinks and parsers supplied by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from siltbed.plans.spec import PipelineSpec, RunContext

SourceFn = Callable[[SparkSession, PipelineSpec, RunContext], DataFrame]
SinkFn = Callable[[DataFrame, str], int | None]  # may return the number of rows written
ParserFn = Callable[[bytes], Iterable[tuple]]


@dataclass(frozen=True)
class GatedSink:
    """A sink that shows nothing until it is told to.

    ``write`` runs in every task with the destination, the number of the partition and its rows as Arrow batches, and
    returns what ``commit`` or ``abort`` need to know about them (anything that pickles). One of these two then runs once, with the
    destination and the answers of all tasks; a task that failed and was repeated has one answer.
    """

    write: Callable[[str, int, Iterator], object]
    commit: Callable[[str, list], None]
    abort: Callable[[str, list], None]


@dataclass(frozen=True)
class Parser:
    """Turns one file's bytes into rows (tuples in the order of ``schema``); raising rejects the file."""

    parse: ParserFn
    schema: T.StructType


_sources: dict[str, SourceFn] = {}
_sinks: dict[str, SinkFn | GatedSink] = {}
_parsers: dict[str, Parser] = {}


def source(name: str, fn: SourceFn) -> SourceFn:
    _sources[name] = fn
    return fn


def sink(name: str, fn: SinkFn) -> SinkFn:
    _sinks[name] = fn
    return fn


def gated_sink(name: str, write, commit, abort) -> GatedSink:
    _sinks[name] = GatedSink(write, commit, abort)
    return _sinks[name]


def parser(name: str, fn: ParserFn, schema: T.StructType | str) -> Parser:
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    _parsers[name] = Parser(fn, struct)
    return _parsers[name]


def _find(kind: str, table: dict, name: str):
    if name not in table:
        raise KeyError(f"no {kind} named {name!r}; available: {sorted(table)}")
    return table[name]


def get_source(name: str) -> SourceFn:
    return _find("source", _sources, name)


def get_sink(name: str) -> SinkFn | GatedSink:
    return _find("sink", _sinks, name)


def get_parser(name: str) -> Parser:
    return _find("parser", _parsers, name)


def write_gated(rows: DataFrame, path: str, target: GatedSink, check: Callable[[int], None]) -> None:
    """Write rows in one pass and commit them if ``check`` accepts their number; if it raises, or a task fails for good,
    the sink aborts."""

    class Written(WriterCommitMessage):
        def __init__(self, rows: int, answer: object) -> None:
            self.rows, self.answer = rows, answer

    class Writer(DataSourceArrowWriter):
        def write(self, batches: Iterator) -> WriterCommitMessage:
            seen = [0]

            def counted() -> Iterator:
                for batch in batches:
                    seen[0] += batch.num_rows
                    yield batch

            answer = target.write(path, TaskContext.get().partitionId(), counted())
            return Written(seen[0], answer)

        def commit(self, messages: list) -> None:
            check(sum(m.rows for m in messages))
            target.commit(path, [m.answer for m in messages])

        def abort(self, messages: list) -> None:
            target.abort(path, [m.answer for m in messages if m is not None])

    class Gated(DataSource):
        @classmethod
        def name(cls) -> str:
            return "gated_sink"

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
            return Writer()

    rows.sparkSession.dataSource.register(Gated)
    rows.write.format("gated_sink").mode("append").save()


def parse_bytes(spark: SparkSession, found: Parser, paths: list[str], file_column: str, error_column: str) -> DataFrame:
    """Run a parser over whole files. A file that raises yields one row holding the error text instead of its rows.

    Files reach Python one batch at a time; batches are cut by size, so keep ``max_file_bytes`` below task memory.
    """
    parse, width = found.parse, len(found.schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.as_py()
                try:
                    rows = [(*row, name, None) for row in parse(content.as_py())]
                except Exception as error:  # whatever the user's parser raises rejects this one file
                    rows = [(*[None] * width, name, str(error) or type(error).__name__)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in output]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=f.type) for values, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    output = T.StructType(
        [*found.schema.fields, T.StructField(file_column, T.StringType()), T.StructField(error_column, T.StringType())]
    )
    arrow = to_arrow_schema(output)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, output)
