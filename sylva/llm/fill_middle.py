"""Fill-in-the-middle: texts cut at two random boundaries of units, the pieces put in another order between markers.

A text becomes an array of UTF-32 code points with a class for each; where neighbouring classes differ a unit ends, and
the cuts are the boundaries of the chosen ranks. Of a long text the classes and boundaries of one window at a time are
held, so that memory grows by four bytes a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Code points whose boundaries are held at once.
WINDOW = 1 << 20
UNITS = ("char", "word", "line")
_SPACE = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def decoded(raw: bytes) -> np.ndarray:
    """The code points; a byte that is no UTF-8 is one of its own, and comes back as it was."""
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def _classes(points: np.ndarray, unit: str) -> np.ndarray:
    if unit == "char":  # any two neighbours differ
        return np.arange(len(points), dtype=np.uint32) & 1
    if unit == "word":  # runs of ASCII white space, and runs of anything else
        return np.isin(points, _SPACE)
    return np.append(0, np.cumsum(points[:-1] == 0x0A))  # line: a line feed is its unit's last code point


def boundaries(points: np.ndarray, unit: str) -> Iterator[np.ndarray]:
    """The places between two units, window by window."""
    for at in range(0, len(points) - 1, WINDOW):
        c = _classes(points[at : at + WINDOW + 1], unit)
        yield np.flatnonzero(c[1:] != c[:-1]) + at + 1


def place(points: np.ndarray, unit: str, rank: int, units: int) -> int:
    """Where the first rank units end."""
    if rank in (0, units):
        return 0 if rank == 0 else len(points)
    for found in boundaries(points, unit):
        if rank <= len(found):
            return int(found[rank - 1])
        rank -= len(found)
    raise ValueError("no such unit")


def arranged(raw: bytes, draws: tuple[int, int, int, int], unit: str, rate: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of a text with its four random numbers."""
    points = decoded(raw)
    units = sum(len(b) for b in boundaries(points, unit)) + 1 if len(points) else 0
    if not units or any(m in raw for m in marks) or draws[2] % 100 >= rate:
        return units, "plain", None, None, raw
    ends = sorted(place(points, unit, d % (units + 1), units) for d in draws[:2])
    prefix, middle, suffix = (encoded(x) for x in np.split(points, ends))
    p, s, m = marks
    form = "spm" if draws[3] % 100 < spm else "psm"
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return units, form, ends[0], ends[1] - ends[0], b"".join(order)


def rebuilt(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _marks(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The markers; an error unless the first occurrence of each in an output is the marker itself."""
    made = tuple(m.encode() for m in marks)
    if len(made) != 3 or not all(made) or any(x in y for i, x in enumerate(made) for j, y in enumerate(made) if i != j) or any(x[:n] == y[-n:] for x in made for y in made for n in range(1, min(len(x), len(y)))):
        raise ValueError("three markers are needed that neither hold nor overlap each other or themselves")
    return made


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "char", rate: int = 90, spm: int = 20, seed: int = 1, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(id, n: its units, form: plain, psm or spm, prefix_chars, middle_chars: code points, output) of each row.

    unit: char (a code point), word (runs of white space and of anything else) or line. Of a hundred texts rate are
    rearranged, and of those spm have the suffix first. Texts that are null (read as empty), empty or hold a marker stay
    plain, with null for the two lengths. Cuts, rate and order hang on seed and id alone: reruns agree, rows that share an
    id share their draws, a null id draws as an empty one. Either cut may be at an end, and pieces empty. Long texts are
    never cut short. Repeated rows come back each, an empty table gives an empty one, other columns are not read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    sent = _marks(marks)
    kind = docs.schema[doc_id].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            draws = zip(*(b.column(f"h{i}").to_pylist() for i in range(4)), strict=True)
            rows = [arranged(t or b"", d, unit, rate, spm, sent) for t, d in zip(b.column("text").to_pylist(), draws, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    made = docs.select(F.col(doc_id).alias("id"), *draws, F.col(text).cast("binary").alias("text"))
    out = made.mapInArrow(run, f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of fill_in_middle with text, rebuilt from output and form alone."""
    sent = _marks(marks)
    columns = made.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "output"):
            texts = [rebuilt(o, f, sent) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*columns, "text"])

    held = made.withColumn("output", F.col("output").cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    out = held.mapInArrow(run, f"{schema}, text binary")
    return out.withColumns({c: F.col(c).cast("string") for c in ("output", "text")})


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; every row of documents comes back."""
    made = restored(fill_in_middle(read(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
