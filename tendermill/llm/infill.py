"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME`` code points (its units), with the running
count of units and of bytes after each frame, so that any range is read by decompressing the frames it touches.

1. :func:`framed` compresses every text once and notes whether it holds a marker.
2. :func:`moved` draws the two cuts from the doc_id and writes the transformed text as frames again. Only the frames
   that hold a cut are decompressed; frames that lie inside a part are copied as they are.
3. :func:`digests` streams the frames of the output in their order, finds the markers, and reads the parts back
   in the order of the text, one frame in memory at a time.

Texts are cut into prefix, middle and suffix. ``psm`` writes them as prefix, suffix, middle, ``spm`` as suffix, prefix,
middle, each after its marker; ``plain`` leaves the text alone. No marker can arise across a cut, because markers begin
with a sign that occurs in none of them later.

Defined results: null text counts as empty; empty texts and texts that hold a marker are plain; a null doc_id draws
like the text ``null``; repeated rows are separate and drawn alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.store import stored

#: Code points of a frame.
FRAME = 1 << 16
MARKERS = ("<P>", "<S>", "<M>")
#: Shares in hundredths: texts left plain, and of the others those written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Compressed bytes that a task returns at once.
_HELD = 8 << 20
_FRAMES = "units array<long>, ends array<long>, data binary"


class Reader:
    """Code points of a text from its frames; ``units`` and ``ends`` are counted up to the end of each frame."""

    def __init__(self, units: list[int], ends: list[int], data: memoryview, unpack) -> None:
        self.units, self.ends, self.data, self.unpack = [0, *units], [0, *ends], data, unpack
        self.last = (-1, "")

    def __len__(self) -> int:
        return self.units[-1]

    def packed(self, i: int) -> bytes:
        return bytes(self.data[self.ends[i]: self.ends[i + 1]])

    def frame(self, i: int) -> str:
        if self.last[0] != i:
            self.last = (i, self.unpack(self.packed(i)).decode("utf-8"))
        return self.last[1]

    def frames(self, start: int, end: int):
        """(frame, first and last place inside it) of all frames that hold a part of ``start`` to ``end``."""
        i = bisect_right(self.units, start) - 1
        while start < end:
            upto = min(end, self.units[i + 1])
            yield i, start - self.units[i], upto - self.units[i]
            start, i = upto, i + 1

    def read(self, start: int, end: int):
        for i, a, b in self.frames(start, end):
            yield self.frame(i)[a:b]

    def find(self, wanted: str) -> int:
        """The place of the first ``wanted``, also across frames."""
        tail, at = "", 0
        for i in range(len(self.units) - 1):
            text = tail + self.frame(i)
            if (found := text.find(wanted)) >= 0:
                return at - len(tail) + found
            at = self.units[i + 1]
            tail = text[-(len(wanted) - 1):]
        return -1


class Writer:
    """Frames of a text that is put together from strings and from whole frames."""

    def __init__(self, pack, frame: int) -> None:
        self.pack, self.size = pack, frame
        self.units, self.blobs, self.open, self.held = [], [], [], 0

    def text(self, piece: str) -> None:
        self.open.append(piece)
        self.held += len(piece)
        if self.held >= self.size:
            self.close()

    def whole(self, blob: bytes, units: int) -> None:
        self.close()
        self.blobs.append(blob)
        self.units.append(units)

    def close(self) -> None:
        text = "".join(self.open)
        for a in range(0, len(text), self.size):
            piece = text[a: a + self.size]
            self.blobs.append(self.pack(piece.encode("utf-8")))
            self.units.append(len(piece))
        self.open, self.held = [], 0

    def done(self) -> tuple[list[int], list[int], bytes]:
        self.close()
        return list(accumulate(self.units)), list(accumulate(map(len, self.blobs))), b"".join(self.blobs)


def _rows(columns: list[list], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _held_back(rows, schema: pa.Schema, data: int):
    """Batches of ``rows``, each of about ``_HELD`` bytes in the column ``data``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[data])
        if size > _HELD:
            yield _rows([list(c) for c in zip(*held)], schema)
            held, size = [], 0
    if held:
        yield _rows([list(c) for c in zip(*held)], schema)


def _frame_types() -> list:
    return [("units", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())]


def framed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frame: int = FRAME, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(doc_id, marked, units, ends, data) for every row; ``marked`` tells whether the text holds a marker."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        schema = pa.schema([("doc_id", pa.int64()), ("marked", pa.bool_()), *_frame_types()])

        def rows():
            for batch in batches:
                for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    content = value.as_py() or ""
                    out = Writer(pack, frame)
                    out.text(content)
                    yield i, any(m in content for m in markers), *out.done()

        yield from _held_back(rows(), schema, 4)

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, marked boolean, {_FRAMES}")


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four unsigned 32-bit numbers from the doc_id."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k: k + 8], 16) for k in range(0, 32, 8)]


def moved(frames: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, frame: int = FRAME,
          markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, units, ends, data): the transformed texts as frames."""
    for_prefix, for_suffix, for_middle = markers

    def run(batches):
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                            ("middle_chars", pa.int64()), *_frame_types()])

        def rows():
            for batch in batches:
                ids, marked, units, ends = (batch.column(k).to_pylist() for k in range(4))
                for row, i in enumerate(ids):
                    data = memoryview(batch.column(4)[row].as_buffer())
                    source = Reader(units[row], ends[row], data, unpack)
                    n = len(source)
                    first, second, third, fourth = draws(i, seed)
                    if not n or marked[row] or third % 100 >= 100 - plain:
                        yield i, n, "plain", None, None, units[row], ends[row], bytes(data)
                        continue
                    a, b = sorted((first % (n + 1), second % (n + 1)))
                    parts = [(for_prefix, 0, a), (for_suffix, b, n)]
                    form = "spm" if fourth % 100 < suffix_first else "psm"
                    out = Writer(pack, frame)
                    for marker, start, end in [*(parts[::-1] if form == "spm" else parts), (for_middle, a, b)]:
                        out.text(marker)
                        for k, x, y in source.frames(start, end):
                            if y - x == source.units[k + 1] - source.units[k] and y - x == frame:
                                out.whole(source.packed(k), y - x)
                            else:
                                out.text(source.frame(k)[x:y])
                    yield i, n, form, a, b - a, *out.done()

        yield from _held_back(rows(), schema, 7)

    frames = frames.select("doc_id", "marked", "units", "ends", "data")
    return frames.mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {_FRAMES}")


def _restored(output: Reader, form: str, markers: tuple[str, str, str]):
    """The text again, in pieces, from the output and its form alone."""
    if form == "plain":
        yield from output.read(0, len(output))
        return
    place = {m: output.find(m) for m in markers}
    begin = sorted(place.values())
    part = dict(zip(begin, pairwise([*begin, len(output)])))
    for m in (markers[0], markers[2], markers[1]):
        start, end = part[place[m]]
        yield from output.read(start + len(m), end)


def digests(output: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) from the frames of the output."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def digest(pieces) -> str:
            h = hashlib.sha256()
            for piece in pieces:
                h.update(piece.encode("utf-8"))
            return h.hexdigest()

        for batch in batches:
            found = []
            form, units, ends = (batch.column(k).to_pylist() for k in (2, 5, 6))
            for row in range(batch.num_rows):
                reader = Reader(units[row], ends[row], memoryview(batch.column(7)[row].as_buffer()), unpack)
                found.append((digest(reader.read(0, len(reader))), digest(_restored(reader, form[row], markers))))
            columns = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return output.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "units", "ends", "data").mapInArrow(run, schema)


def texts(frames: DataFrame) -> DataFrame:
    """``frames`` with the column ``text`` in place of its frames."""
    kept = [f for f in frames.schema.fields if f.name not in ("units", "ends", "data")]
    names = [f.name for f in kept]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            units, ends, data = (batch.column(k) for k in range(len(names), len(names) + 3))
            readers = (Reader(u, e, memoryview(d.as_buffer()), unpack) for u, e, d in zip(units.to_pylist(), ends.to_pylist(), data))
            text = pa.array(["".join(r.read(0, len(r))) for r in readers], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], text], names=[*names, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    return frames.select(*(f"`{c}`" for c in names), "units", "ends", "data").mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frame: int = FRAME, **how) -> DataFrame:
    """:func:`moved` over the frames of all texts, which are written once."""
    return moved(stored(framed(docs, doc_id, text, frame, how.get("markers", MARKERS)), "none"), frame=frame, **how)
