"""Row-at-a-time transforms, for records that Column functions can't express.

A parse function gets one record and yields any number of rows as dictionaries:
none filters the record, several explode it.  It runs over Arrow batches, of which a
few records and the rows of one small output batch are Python objects at a time; Catalyst
can't look into it, so name the columns it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

RECORDS = 16  # of a batch that are Python objects at once
ROWS = 2_000  # of an output batch at most
CHARS = 4 << 20  # of an output batch, about

_ALLOWED = {StringType: str, LongType: int, IntegerType: int, DoubleType: float}
_ARROW = {StringType: pa.string(), LongType: pa.int64(), IntegerType: pa.int32(), DoubleType: pa.float64()}


class RowError(ValueError):
    """A parse function put a value that a row can't hold."""


def checked(row: Mapping[str, object], kinds: Mapping[str, type]) -> dict[str, object]:
    """The row, if each value is of its column's kind; an absent key is NULL, an explicit None is an error."""
    for name, value in row.items():
        if name not in kinds:
            raise RowError(f"{name!r} is no column of the report")
        wanted = kinds[name]
        if value is None or isinstance(value, bool) or not isinstance(value, (int, float) if wanted is float else wanted):
            raise RowError(f"{name!r} can't be {value!r}")
    return dict(row)


def emit_rows(df: DataFrame, parse: Callable[[dict], Iterable[Mapping[str, object]]], schema: str | StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that ``parse`` yields for each record of ``df`` (of ``columns`` only, if named)."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    for f in schema.fields:
        if type(f.dataType) not in _ALLOWED:
            raise RowError(f"{f.name}: rows hold strings, integers and doubles")
    kinds = {f.name: _ALLOWED[type(f.dataType)] for f in schema.fields}
    arrow = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in schema.fields])

    texts = [name for name, kind in kinds.items() if kind is str]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, RECORDS):
                for record in batch.slice(k, RECORDS).to_pylist():
                    for row in parse(record):
                        out.append(checked(row, kinds))
                        for name in texts:
                            chars += len(row.get(name, ""))
                        if len(out) >= ROWS or chars >= CHARS:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return (df.select(*columns) if columns else df).mapInArrow(run, schema)
