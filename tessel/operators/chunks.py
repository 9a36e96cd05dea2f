"""Sequences cut into time-ordered chunks, and scans over what chunks amount to.

A recursion along a sequence (a hidden Markov model, a Kalman filter, decaying excitation) is a
composition of maps of a small state. Rows are range-partitioned by (key, order) and cut into chunks
of at most `MOST` rows, one table row each, written once. A chunk's map is worked out without
knowing the state it starts from; the maps of a key are composed per partition, run through over the
few partitions of a key, and run through again inside each, which gives the state before (or after)
every chunk. Then all chunks run on their own. So a sequence that holds a third of all rows uses as
many tasks as it has partitions, and how a sequence is cut doesn't change the result. Whole
sequences inside a batch need no scan; only chunks marked `edge` do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.sources.shared import written

#: Rows of a chunk at most, and padded cells that a kernel works on at a time.
MOST, CELLS = 512, 1 << 21


def chunked(df: DataFrame, key: str, order: list[str], columns: list[str], most: int = MOST) -> DataFrame:
    """key, chunk, head, edge, n, and a list of each of `columns`: rows in order, at most `most` a chunk.

    Chunk numbers rise along each sequence; `head` is the first chunk of the key in its partition. A
    null key is a sequence of its own. Rows that tie in `order` keep any order among each other.
    """
    rows = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *columns)
    by = ["key", *[f"_o{i}" for i in range(len(order))]]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("key", *columns)
    kinds = dict(rows.dtypes)

    def cut(batches):
        part, number, head, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(np.diff(codes, prepend=-1))
            ends = np.append(runs[1:], len(codes))
            pieces = -(-(ends - runs) // most)
            run = np.repeat(np.arange(len(runs)), pieces)
            inside = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = runs[run] + inside * most
            ids = part + number + np.arange(len(run), dtype=np.int64)
            first_key, last_key = keys.dictionary[codes[0]].as_py(), keys.dictionary[codes[-1]].as_py()
            heads = ids - inside
            if last is not None and last[0] == first_key:
                heads[run == 0] = head
            edge = (pieces[run] > 1) | (run == 0) | (run == len(runs) - 1)
            offsets = pa.array(np.append(starts, len(codes)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i + 1)) for i in range(len(columns))]
            sizes = np.diff(np.append(starts, len(codes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(ids), pa.array(heads), pa.array(edge), pa.array(sizes), *lists], ["key", "chunk", "head", "edge", "n", *columns])
            number, head, last = number + len(run), int(heads[-1]), (last_key,)

    schema = f"key {kinds['key']}, chunk long, head long, edge boolean, n int, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns)
    return written(rows.mapInArrow(cut, schema))


Payload = np.ndarray


def scan(parts: DataFrame, compose: Callable[[Payload, Payload], Payload], apply: Callable[[np.ndarray, Payload], np.ndarray], start: np.ndarray, reverse: bool = False) -> DataFrame:
    """(chunk, state): the state before each chunk of `parts` (key, chunk, head, payload), or after it if `reverse`.

    `compose(a, b)` is the payload of a followed by b in time; `apply(state, payload)` carries a
    state through a payload, forwards or, if `reverse`, backwards. `start` is the state at the end
    that the scan begins at.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        maps = [np.array(p) for p in pdf.sort_values("chunk")["payload"]]
        whole = maps[0]
        for p in maps[1:]:
            whole = compose(whole, p)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "head": pdf["head"].iloc[:1], "payload": [whole.tolist()]})

    def through(name: str, begin: np.ndarray | None):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(name, ascending=not reverse)
            state = begin if begin is not None else np.array(pdf["_start"].iloc[0])
            out = []
            for p in pdf["payload"]:
                out.append(state.tolist())
                state = apply(state, np.array(p))
            return pd.DataFrame({name: pdf[name].to_numpy(), "state": out})

        return run

    parts = parts.select("key", "chunk", "head", "payload")
    kind = dict(parts.dtypes)["key"]
    heads = parts.groupBy("key", "head").applyInPandas(fold, f"key {kind}, head long, payload array<double>")
    begins = heads.groupBy("key").applyInPandas(through("head", start), "head long, state array<double>").withColumnRenamed("state", "_start")
    return parts.drop("key").join(begins, "head").groupBy("head").applyInPandas(through("chunk", None), "chunk long, state array<double>")


def with_states(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """Chunks with the columns of `states` (chunk, ...), null for whole sequences: only chunks at an edge are joined."""
    names = [f for f in states.schema.fields if f.name != "chunk"]
    whole = chunks.where("not edge").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    return chunks.where("edge").join(states, "chunk", "left").select(*whole.columns).unionByName(whole)


def sizes_before(chunks: DataFrame) -> DataFrame:
    """(chunk, before): the rows of its sequence that come before each chunk at an edge."""
    sizes = chunks.where("edge").select("key", "chunk", "head", F.array(F.col("n").cast("double")).alias("payload"))
    return scan(sizes, lambda a, b: a + b, lambda s, p: s + p, np.zeros(1)).select("chunk", F.col("state")[0].cast("long").alias("before"))


def entries(per_chunk: DataFrame, chunks: DataFrame, key: str, column: str) -> DataFrame:
    """(key, t, column): the entries of a list column of `per_chunk` (key, chunk, edge) with their place t in the sequence, from 0."""
    rows = with_states(per_chunk, sizes_before(chunks)).select("key", F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.posexplode(column).alias("_t", column))
    return rows.select(F.col("key").alias(key), (F.col("before") + F.col("_t")).alias("t"), column)


def blocks(n: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Indices of chunks in groups, longest first within a group, of bounded padded size (rows x width)."""
    order = np.argsort(-n, kind="stable")
    at = 0
    while at < len(order):
        most = max(1, CELLS // max(1, int(n[order[at]]) * width))
        yield order[at : at + most]
        at += most


def padded(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """(chunks, longest, ...) of the rows of the picked chunks; zeros beyond a chunk's end."""
    longest = int(n[pick].max(initial=0))
    place = starts[pick][:, None] + np.arange(longest)[None, :]
    live = np.arange(longest)[None, :] < n[pick][:, None]
    out = flat[np.where(live, place, 0)] if len(flat) else np.zeros((len(pick), longest, *flat.shape[1:]))
    out[~live] = 0
    return out


def alive(n: np.ndarray, t: int) -> int:
    """How many chunks, sorted longest first, have a row t."""
    return int(np.searchsorted(-n, -t, side="left"))


def numbers(column: pa.Array) -> np.ndarray:
    """The entries of a list column, lists in lists laid flat to one row each."""
    flat = column.flatten()
    if pa.types.is_list(flat.type):
        inner = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
        return inner.reshape(len(flat), -1) if len(flat) else inner.reshape(0, 1)
    return flat.to_numpy(zero_copy_only=False).astype(float)


def over_chunks(table: DataFrame, columns: list[str], kernel, fields: list[tuple[str, str]], states: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Run `kernel(n, starts, arrays, states)` on batches of chunks; it returns the arrow columns of `fields` (name, type).

    `arrays` are the flat entries of `columns`, `starts` the place of each chunk in them; `states` are
    columns of vectors or flags (null where there is none), as lists. The columns `carry` stay before the new ones.
    """
    keep = tuple(dict.fromkeys(("key", "chunk", *carry)))
    table = table.select(*dict.fromkeys((*keep, "n", *columns, *states)))
    kinds = dict(table.dtypes)
    names = [*keep, *[n for n, _ in fields]]
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{n} {t}" for n, t in fields])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(n) - n
            made = kernel(n, starts, [numbers(batch.column(c)) for c in columns], [batch.column(s).to_pylist() for s in states])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names)

    return table.mapInArrow(run, schema)


def lists_of(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """A list column of `n` entries a row from flat values; rows of a matrix become lists themselves."""
    entries = pa.array(values) if values.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), entries)


def rows_of(values: np.ndarray) -> pa.Array:
    """A list column with a row for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values, dtype=float).ravel()))
