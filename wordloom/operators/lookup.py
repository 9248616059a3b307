"""Values for the strings in array columns: from a table (J3, J4, J8), or by a rule worked out once for each distinct string."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.runtime import BROADCAST_ROWS, write_stage

# Rows of a chunk: two to this power.
CHUNK_BITS = 9
# Strings in the rows that `each_distinct` takes together, about.
STRINGS_AT_A_TIME = 262_144
# Lists that are looked up together.
LISTS_AT_A_TIME = 1_024


def match_elements(
    df: DataFrame, elements: Column, table: DataFrame, out: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add the array `out`, which has for each string in `elements` the value that the
    table `(key, value)` gives for it, or NULL.  Keys are unique.  A column of that name is replaced.

    A table of up to `max_rows` rows is broadcast, and all elements of an Arrow batch are
    matched in one vectorised hash lookup; rows stay where they are.  A larger table is joined
    with the distinct elements of some rows at a time, and each such chunk of rows gets the part
    it needs.  So an element, however frequent, is joined once for each chunk.
    """
    table = table.select("key", "value")
    known = table.limit(max_rows + 1).toArrow()
    kind = table.schema["value"].dataType
    if len(known) <= max_rows:
        return df.withColumn(out, _lookup(df, known, kind.simpleString())(elements))

    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    rows = write_stage(df.withColumn("_keys", elements).drop(out).withColumn("_chunk", chunk))
    asked = rows.select(F.col("_chunk").alias("to"), F.explode(F.array_distinct("_keys")).alias("key")).distinct()
    found = asked.join(table, "key")
    schema = T.StructType([*rows.drop("_keys", "_chunk").schema.fields, T.StructField(out, T.ArrayType(kind))])
    return rows.groupBy("_chunk").cogroup(found.groupBy("to")).applyInArrow(_put(out), schema)


def _put(out: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def put(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys, values = (found.column(c).combine_chunks() for c in ("key", "value"))
        lists = pa.concat_arrays(rows.column("_keys").chunks)
        return rows.drop_columns(["_keys", "_chunk"]).append_column(out, _matched(lists, keys.cast(pa.string()), values))

    return put


def _matched(lists: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    # Few lists at a time, so that only the values found are as many as the strings.
    parts = [lists.slice(k, LISTS_AT_A_TIME).flatten() for k in range(0, len(lists), LISTS_AT_A_TIME)]
    found = pa.concat_arrays([values.take(pc.index_in(x.cast(pa.string()), keys)) for x in parts] or [values.slice(0, 0)])
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    missing = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends), found, mask=missing)


def _lookup(df: DataFrame, known: pa.Table, kind: str) -> Callable[[Column], Column]:
    keys, values = (known.column(c).combine_chunks() for c in ("key", "value"))
    shared = df.sparkSession.sparkContext.broadcast((keys.cast(pa.string()), values))

    @F.arrow_udf(f"array<{kind}>")
    def lookup(lists: pa.Array) -> pa.Array:
        return _matched(lists, *shared.value)

    return lookup


def each_distinct(
    df: DataFrame,
    columns: Sequence[str],
    rule: Callable[[str], Column],
    kind: str = "string",
    known: DataFrame | None = None,
    inside: str | None = None,
) -> DataFrame:
    """Put in the place of each string in the (nested) arrays `columns` what `rule` gives for it, of type `kind`.

    `rule` makes of an array of strings, given as SQL text, an array of as many values.  Rows stay where they are, and
    each distinct string of some rows is worked out once, however often it occurs there.  NULL stays NULL.

    `known (key, value)` counts before the rule, unless its value is NULL; it is broadcast.  With `inside` the arrays hold
    structs, and only that field of them is changed.
    """
    shared = None
    if known is not None:
        table = known.select("key", "value").toArrow()
        keys, values = (table.column(c).combine_chunks() for c in ("key", "value"))
        shared = df.sparkSession.sparkContext.broadcast((keys.cast(pa.string()), values))
    packed = df.mapInArrow(_packed(columns, inside, shared), f"rows binary, found array<{kind}>, words array<string>")
    packed = packed.select("rows", "found", rule("words").alias("values"))
    fields = [f if f.name not in columns else T.StructField(f.name, _changed(f.dataType, kind, inside)) for f in df.schema]
    return packed.mapInArrow(_unpacked(columns, inside), T.StructType(fields))


def _changed(kind: T.DataType, value: str, inside: str | None) -> T.DataType:
    """The type of an array column whose strings, or field `inside`, are of type `value` now."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_changed(kind.elementType, value, inside))
    new = T._parse_datatype_string(value)
    if inside is None:
        return new
    return T.StructType([T.StructField(f.name, new) if f.name == inside else f for f in kind])


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _ends(lists: pa.Array) -> np.ndarray:
    """Number of innermost elements before each row, and of all."""
    ends = np.concatenate(([0], np.cumsum(_lengths(lists))))
    inner = lists.flatten()
    return _ends(inner)[ends] if pa.types.is_list(inner.type) else ends


def _innermost(lists: pa.Array) -> pa.Array:
    return _innermost(lists.flatten()) if pa.types.is_list(lists.type) else lists


def _refilled(lists: pa.Array, elements: pa.Array) -> pa.Array:
    """Lists of the same shape with other innermost elements."""
    if not pa.types.is_list(lists.type):
        return elements
    ends = np.concatenate(([0], np.cumsum(_lengths(lists)))).astype(np.int32)
    missing = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends), _refilled(lists.flatten(), elements), mask=missing)


def _replaced(elements: pa.Array, inside: str | None, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Elements with `change` made to them, or to the field `inside` of structs."""
    if inside is None:
        return change(elements)
    if not len(elements):
        elements = pa.array([], elements.type)
    names = [f.name for f in elements.type]
    parts = [change(x) if n == inside else x for n, x in zip(names, elements.flatten())]
    return pa.StructArray.from_arrays(parts, names, mask=elements.is_null())


def _strings(elements: pa.Array, inside: str | None) -> pa.Array:
    if inside is not None:
        elements = elements.flatten()[elements.type.get_field_index(inside)]
    return elements.cast(pa.string())


def _packed(columns: Sequence[str], inside: str | None, shared):
    """Some rows at a time as one: the rows with codes for strings, what is known of the distinct strings, and the other ones."""

    def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
        held = [_innermost(rows.column(c)) for c in columns]
        # Arrays without elements may come without offsets, which Arrow does not join.
        strings = [_strings(x, inside) for x in held if len(x)]
        coded = pa.concat_arrays(strings or [pa.array([], pa.string())]).dictionary_encode()
        words, at = coded.dictionary, 0
        for c, x in zip(columns, held):
            codes, at = coded.indices.slice(at, len(x)), at + len(x)
            new = _refilled(rows.column(c), _replaced(x, inside, lambda _, codes=codes: codes))
            rows = rows.set_column(rows.schema.get_field_index(c), c, new)
        if shared is None:
            found, missing = pa.nulls(0), words
        else:
            keys, values = shared.value
            found = values.take(pc.index_in(words, keys))
            missing = words.filter(found.is_null())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()]), one(found), one(missing)], ["rows", "found", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = sum(_ends(batch.column(c)) for c in columns)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + STRINGS_AT_A_TIME, side="right")) - 1)
                yield pack(batch.slice(i, j - i))
                i = j

    return run


def _unpacked(columns: Sequence[str], inside: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values, found = batch.column("values")[k].values, batch.column("found")[k].values
                if len(found):
                    values = pc.replace_with_mask(found, found.is_null(), values.cast(found.type))
                rows = pa.ipc.open_stream(batch.column("rows")[k].as_buffer()).read_next_batch()
                for c in columns:
                    lists = rows.column(c)
                    new = _refilled(lists, _replaced(_innermost(lists), inside, values.take))
                    rows = rows.set_column(rows.schema.get_field_index(c), c, new)
                yield rows

    return run
