"""BPE encoding and decoding with tree concatenation for long unsplit text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import wordbpe
from shelfmark.llm.common import slices

# Texts with more characters than this are cut and encoded by several tasks.
LONG_CHARS = 4 << 20
# Characters of one cut of such a text.
CUT_CHARS = 1 << 18


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, cut_chars: int = CUT_CHARS) -> DataFrame:
    """Ids of every whole text: ``(id_col, ids array<int>, decoded string)``, one row a row of ``docs``.

    Texts up to ``long_chars`` characters are encoded where they are read.  The pieces of
    a longer one are cut into leaves of ``cut_chars``, dealt over the cluster, encoded in
    parallel and joined again in order; its rows are told apart by a number of their own,
    so that repeated ids and texts stay separate rows.  A null or empty text has no ids
    and decodes to the empty text; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"id {id_type}, ids array<int>, decoded string"
    near = rows.where(F.length("text") <= long_chars).mapInArrow(lambda batches: _encode_texts(batches, path), out)
    # the same number for a row when its partition is computed again
    far = rows.where(F.length("text") > long_chars).withColumn("row", F.monotonically_increasing_id().cast("string"))
    cuts = far.mapInArrow(
        lambda batches: _cut(batches, path, cut_chars), f"id {id_type}, row string, seq long, part string, open boolean, last boolean"
    )
    leaves = cuts.repartition("row", "seq").mapInArrow(
        lambda batches: _encode_leaves(batches, path), f"id {id_type}, row string, seq long, ids array<int>, open boolean, last boolean"
    )
    joined = leaves.groupBy("row").applyInPandas(lambda group: _join(group, path), out)
    return near.unionByName(joined).withColumnRenamed("id", id_col)


def _strings(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()))


def _encode_texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = wordbpe.load(path)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, counts = bpe.encode(part.column(1).to_pylist())
            ends = np.cumsum(counts)
            decoded = [bpe.decode(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), _strings(ids, counts), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])


def _cut(batches: Iterator[pa.RecordBatch], path: str, cut_chars: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole pieces up to ``cut_chars``, and leaves of longer pieces (``open``)."""
    bpe = wordbpe.load(path)
    for batch in batches:
        for i, text, row in zip(batch.column(0).to_pylist(), *[batch.column(k).to_pylist() for k in (1, 2)], strict=True):
            seq = 0
            for part, is_open, last in _parts(bpe, text, cut_chars):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], batch.column(0).type), *map(pa.array, ([row], [seq], [part], [is_open], [last]))],
                    ["id", "row", "seq", "part", "open", "last"],
                )
                seq += 1


def _parts(bpe: wordbpe.WordBpe, text: str, cut_chars: int) -> Iterator[tuple[str, bool, bool]]:
    tokens = bpe.tokens(text)
    if tokens is None:  # holds an added token: the library encodes the text as a whole
        yield text, False, False
        return
    run, size = [], 0
    for m in (p for t in tokens for p in bpe.pieces(t)):
        if run and size + len(m) > cut_chars:
            yield " ".join(run), False, True
            run, size = [], 0
        if len(m) > cut_chars:
            for k in range(0, len(m), cut_chars):
                yield m[k : k + cut_chars], True, k + cut_chars >= len(m)
        else:
            run.append(m)
            size += len(m)
    if run:
        yield " ".join(run), False, True


def _encode_leaves(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = wordbpe.load(path)
    for batch in batches:
        names = batch.schema.names
        ids = []
        for part, is_open, last in zip(*(batch.column(names.index(c)).to_pylist() for c in ("part", "open", "last")), strict=True):
            if is_open:
                leaves = range(0, len(part), 128)
                small = [bpe.leaf(part[k : k + 128], last and k + 128 >= len(part)) for k in leaves]
                ids.append(bpe.join_all(small) if last else _join_open(bpe, small))
            elif not last:
                ids.append(bpe.library.encode(part, add_special_tokens=False).ids)
            else:
                ids.append([i for m in part.split(" ") for i in bpe.ids_of_piece(m)])
        at = [batch.column(names.index(c)) for c in ("id", "row", "seq")]
        yield pa.RecordBatch.from_arrays(
            [*at, pa.array(ids, pa.list_(pa.int32())), batch.column(names.index("open")), batch.column(names.index("last"))],
            ["id", "row", "seq", "ids", "open", "last"],
        )


def _join_open(bpe: wordbpe.WordBpe, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else []
        parts = [bpe.join(parts[i], parts[i + 1], False) for i in range(0, len(parts) - 1, 2)] + odd
    return parts[0]


def _join(group, path: str):
    """Ids of one long text from its encoded cuts, in order."""
    bpe = wordbpe.load(path)
    group = group.sort_values("seq")
    ids: list[int] = []
    waiting: list[list[int]] = []
    for part, is_open, last in zip(group["ids"], group["open"], group["last"], strict=True):
        if not is_open:
            ids.extend(map(int, part))
            continue
        waiting.append([int(x) for x in part])
        if last:
            ids.extend(bpe.join_all(waiting))
            waiting = []
    out = group[["id"]].head(1).copy()
    out["ids"] = [ids]
    out["decoded"] = [bpe.decode(np.array(ids, np.int64)) if ids else ""]
    return out
