"""Fill-in-middle examples, assembled by a secondary sort.

A text is cut into lines (``[^\\n]*\\n|[^\\n]+``). Two numbers drawn from the id choose the lines where
the prefix and the middle end; two more choose whether the text is transformed at all and in which
order. The output is never built as one value: every document gives pieces of a bounded size, keyed
by document and place in the output. ``repartition`` with ``sortWithinPartitions`` (the DataFrame form
of repartitionAndSortWithinPartitions) brings them into output order, and one pass over the sorted
stream digests each output and finds its sections by the marks in it. The same partitions are sorted
again by the place in the text that this pass read off, and a second pass digests the restored text.
Either pass holds a batch of pieces and one running digest, however long a document is.

Rows are keyed by the digest of id and text and by the task that cut them, so a lost task's rows get
the same keys again and copies of one row are dealt over tasks.

Defined cases: null text is empty and plain; a text that holds a mark is plain; a null id draws as an
empty one; rows of one id are rows of their own, also where they are equal; an empty table gives an
empty result. Other columns are not read. Bytes that are no UTF-8 pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Most bytes of a piece, and of the pieces of one batch.
PIECE, BATCH = 1 << 15, 1 << 22
#: Copies of one row are dealt over at most as many keys.
DEALS = 64

_HEAD = "struct<id:{kind},n:bigint,form:string>"
_SUMS = "struct<output:string,prefix:bigint,middle:bigint,copies:bigint>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Place of a section in the text; the sums of a document follow its pieces.
_SECTION = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_SUM_SECTION = 3


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers of 32 bits from the id."""
    sha = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(sha[i:i + 8], 16) for i in range(0, 32, 8)]


def plan(data: bytes, doc_id, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int, int]:
    """(number of lines, form, end of the prefix, end of the middle) in bytes of the text."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    n = len(breaks) + (0 if not data or data.endswith(b"\n") else 1)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or any(m in data for m in MARKS) or h3 % 100 >= rate:
        return n, PLAIN, len(data), len(data)

    def end(lines: int) -> int:
        return 0 if not lines else int(breaks[lines - 1]) + 1 if lines <= len(breaks) else len(data)

    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, SPM if h4 % 100 < spm else PSM, end(first), end(last)


def pieces(data: bytes, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output in order: marks, and chunks of whole lines where a line fits in one."""
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(data))}
    order = {PLAIN: [None], PSM: [PREFIX, SUFFIX, MIDDLE], SPM: [SUFFIX, PREFIX, MIDDLE]}[form]
    for mark in order:
        at, end = parts[mark] if mark else (0, len(data))
        if mark:
            yield mark
        while at < end:
            stop = min(end, at + PIECE)
            if stop < end:
                line = data.rfind(b"\n", at, stop) + 1
                stop = line if line > at else stop
            yield data[at:stop]
            at = stop


def _chars(piece: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return len(piece) - int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) == 0x80))


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held >= BATCH:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def cut(df: DataFrame, id_col: str, text_col: str, seed: int, rate: int, spm: int) -> DataFrame:
    """(key, deal, at, piece, head): the pieces of every row's output; the first one, which may be
    empty, carries the row's id, number of lines and form."""
    plain = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = plain.select("id", F.col("text").cast("binary").alias("text"),
                        F.pmod(F.spark_partition_id(), F.lit(DEALS)).alias("deal"))
    schema = f"key binary, deal int, at bigint, piece binary, head {_HEAD.format(kind=plain.schema['id'].dataType.simpleString())}"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(arrow)
        for batch in text_slices(batches, BATCH):
            columns = [batch.column(c).to_pylist() for c in ("id", "text", "deal")]
            for doc_id, data, deal in zip(*columns, strict=True):
                key = hashlib.blake2b(data, digest_size=16, person=b"" if doc_id is None else b"id",
                                      key=hashlib.md5(str(doc_id).encode()).digest()).digest()
                n, form, a, b = plan(data, doc_id, seed, rate, spm)
                head = {"id": doc_id, "n": n, "form": form}
                at = 0
                for piece in pieces(data, form, a, b):
                    yield from out.add((key, deal, at, piece, head), len(piece))
                    at, head = at + 1, None
                if head:
                    yield from out.add((key, deal, 0, b"", head), 0)
        yield out.flush()

    return rows.mapInArrow(run, schema)


def _documents(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a sorted stream, with whether a document begins there."""
    last = None
    for batch in batches:
        parts = [batch.column(c) for c in columns]
        for values in zip(*[p.to_pylist() for p in parts], strict=True):
            yield values[:2] != last, values
            last = values[:2]


def assembled(cut_pieces: DataFrame) -> DataFrame:
    """(key, deal, section, at, piece, head, sums): the pieces without marks, placed in the text by
    reading the output; a last row per document carries the output's digest."""
    kind = cut_pieces.schema["head"].dataType["id"].dataType.simpleString()
    schema = f"key binary, deal int, section int, at bigint, piece binary, head {_HEAD.format(kind=kind)}, sums {_SUMS}"
    arrow = _arrow(schema)
    ordered = cut_pieces.repartition("key", "deal").sortWithinPartitions("key", "deal", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = _Rows(arrow), None

        def ended() -> tuple:
            marked = state["form"] != PLAIN
            sums = {"output": state["sha"].hexdigest(), "copies": state["copies"],
                    "prefix": state["chars"][0] if marked else None, "middle": state["chars"][1] if marked else None}
            return (*state["key"], _SUM_SECTION, 0, b"", state["head"], sums)

        for begins, (key, deal, at, piece, head) in _documents(batches, ("key", "deal", "at", "piece", "head")):
            if begins:
                if state:
                    yield from out.add(ended(), 64)
                state = {"key": (key, deal), "sha": hashlib.sha256(), "head": head, "form": head["form"], "copies": 0,
                         "section": 0, "chars": [0, 0, 0], "at": -1}
            if at == 0:
                state["copies"] += 1
            if at == state["at"]:
                continue  # the same piece of an equal row
            state["at"] = at
            state["sha"].update(piece)
            if state["form"] != PLAIN and piece in _SECTION:
                state["section"] = _SECTION[piece]
                continue
            state["chars"][state["section"]] += _chars(piece)
            yield from out.add((key, deal, state["section"], at, piece, None, None), len(piece))
        if state:
            yield from out.add(ended(), 64)
        yield out.flush()

    return ordered.mapInArrow(run, schema)


def restored(placed: DataFrame) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) from the same
    partitions in the order of the text. Each document's sums come after its last piece."""
    kind = placed.schema["head"].dataType["id"].dataType.simpleString()
    schema = (f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
              "output_sha256 string, restored_sha256 string")
    arrow = _arrow(schema)
    ordered = placed.sortWithinPartitions("key", "deal", "section", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha = _Rows(arrow), None
        for begins, (_, _, _, piece, head, sums) in _documents(
                batches, ("key", "deal", "section", "piece", "head", "sums")):
            if begins:
                sha = hashlib.sha256()
            sha.update(piece)
            if sums is not None:
                row = (head["id"], head["n"], head["form"], sums["prefix"], sums["middle"], sums["output"], sha.hexdigest())
                for _ in range(sums["copies"]):
                    yield from out.add(row, 128)
        yield out.flush()

    return ordered.mapInArrow(run, schema)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
                   spm: int = 50) -> DataFrame:
    """One row per row of ``df``: id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256. ``rate`` of a hundred texts are transformed, ``spm`` of a hundred suffix first."""
    placed = assembled(cut(df, id_col, text_col, seed, rate, spm))
    return restored(placed).withColumnRenamed("id", id_col)


def outputs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
            spm: int = 50) -> DataFrame:
    """(key, id, form, at, piece): the outputs themselves, in pieces that stand in output order inside
    their partition, for a sink that appends. ``id`` and ``form`` stand on the first piece of an
    output; a row that a task reads several times is given once."""
    cut_pieces = cut(df, id_col, text_col, seed, rate, spm)
    ordered = cut_pieces.repartition("key", "deal").sortWithinPartitions("key", "deal", "at")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            places = list(zip(*[batch.column(c).to_pylist() for c in ("key", "deal", "at")], strict=True))
            new = [a != b for a, b in zip(places, [last, *places], strict=False)]
            last = places[-1] if places else last
            yield batch.filter(pa.array(new, pa.bool_()))

    return ordered.mapInArrow(once, ordered.schema).select(
        "key", F.col("head.id").alias(id_col), F.col("head.form").alias("form"), "at", F.col("piece").cast("string").alias("piece"))
