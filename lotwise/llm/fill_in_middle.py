"""Fill-in-the-middle: documents cut in three at unit bounds and reordered around sentinels.

A NumPy kernel works on the UTF-8 buffer of a whole Arrow batch. A table gives each byte a class, a mask
over adjacent bytes marks where a unit begins, its cumulative sum less the sum at the document's first
byte numbers the units of each document, and one search in that sum per cut finds the byte where every
row's unit begins, for all rows together. The draws that place the cuts are hashes of the ids, computed by
Spark, so a task that runs again writes the same rows. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The sentinels, the seed of the draws, the share of documents transformed, the share of those in suffix-first order.
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes of text the kernel works on at a time, unless a single text is longer.
SLICE_BYTES = 8 << 20


class Units(NamedTuple):
    """How texts fall into units: the class of each byte value (a table of 256), and the pairs of classes between which a unit begins."""

    classes: bytes
    begins: list[tuple[int, int]]

    @classmethod
    def of(cls, classes: dict[int, int], begins: list[tuple[int, int]]) -> Units:
        """``classes`` are those of the bytes that are not of class 0."""
        return cls(bytes(classes.get(byte, 0) for byte in range(256)), begins)


UNITS = {
    # A line ends after its line feed.
    "lines": Units.of({0x0A: 1}, [(1, 0), (1, 1)]),
    # A word goes with the white space after it.
    "words": Units.of({b: 1 for b in b" \t\n\v\f\r"}, [(1, 0)]),
    # A code point: class 1 are its continuation bytes.
    "characters": Units.of({b: 1 for b in range(0x80, 0xC0)}, [(0, 0), (1, 0)]),
}


def unit_numbers(data: np.ndarray, offsets: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Running count of units begun up to each byte of a batch, and that count before each document (and at the end).

    ``offsets`` bound the documents in ``data``; a document's first byte always begins a unit.
    """
    classes = np.frombuffer(data.tobytes().translate(units.classes), np.uint8)
    begins = np.zeros(len(data), bool)
    for left, right in units.begins:
        begins[1:] |= (classes[:-1] == left) & (classes[1:] == right)
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    numbers = np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    return numbers, np.where(offsets > 0, numbers[offsets - 1], 0) if len(data) else np.zeros(len(offsets), np.int64)


def cut_bytes(numbers: np.ndarray, before: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """First byte of the unit ``cuts`` of every document (its end for the count of its units): the place where the running count first exceeds it."""
    return np.minimum(np.searchsorted(numbers, before[:-1] + cuts + 1), offsets[1:])


def code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points in each [begin, end), which follow one another: bytes that continue none."""
    bounds = np.stack([begin, end], 1).ravel()
    starts = np.append((data & 0xC0) != 0x80, False)
    return np.where(begin < end, np.add.reduceat(starts, bounds, dtype=np.int64)[::2], 0)


def contains_any(data: np.ndarray, offsets: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Whether each document holds one of ``strings``, found in all documents at once."""
    found = np.zeros(len(offsets) - 1, bool)
    for string in strings:
        last = len(data) - len(string) + 1
        if last <= 0:
            continue
        at = np.flatnonzero(data[:last] == string[0])
        for k, byte in enumerate(string[1:], 1):
            at = at[data[at + k] == byte]
        row = np.searchsorted(offsets, at, side="right") - 1
        found[row[at + len(string) <= offsets[row + 1]]] = True
    return found


def reorder(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, units: Units, rate: int, spm_rate: int, sentinels: dict[str, str]) -> dict[str, np.ndarray | list]:
    """n, form, output, prefix_chars and middle_chars (-1 where plain) of a batch; ``draws`` has four columns of integers."""
    numbers, before = unit_numbers(data, offsets, units)
    n = (before[1:] - before[:-1]).astype(np.int64)
    places = draws[:, :2] % (n + 1)[:, None]
    first, second = (cut_bytes(numbers, before, offsets, cut) for cut in (places.min(1), places.max(1)))
    marks = {part: string.encode() for part, string in sentinels.items()}
    plain = (n == 0) | (draws[:, 2] % 100 >= rate) | contains_any(data, offsets, list(marks.values()))
    spm = draws[:, 3] % 100 < spm_rate
    view, output = memoryview(data), []
    for begin, one, two, end, is_plain, is_spm in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
        prefix, middle, suffix = (marks["prefix"], view[begin:one]), (marks["middle"], view[one:two]), (marks["suffix"], view[two:end])
        order = (suffix, prefix, middle) if is_spm else (prefix, suffix, middle)
        output.append(bytes(view[begin:end]) if is_plain else b"".join(x for part in order for x in part))
    lengths = {"prefix_chars": code_points(data, offsets[:-1], first), "middle_chars": code_points(data, first, second)}
    return {"n": n, "form": np.where(plain, "plain", np.where(spm, "spm", "psm")), "output": output} | {k: np.where(plain, -1, v) for k, v in lengths.items()}


def slices(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of at most ``most`` bytes together, or one row of more."""
    begin, total = 0, 0
    for k, length in enumerate(lengths.tolist()):
        if k > begin and total + length > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += length
    yield slice(begin, len(lengths))


def drawn(id_column: Column, seed: int = SEED) -> list[Column]:
    """Four integers of a document: the first four 8-digit groups of the SHA-256 of ``seed:id``; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


RESULT = "n long, form string, output string, prefix_chars long, middle_chars long"


def fill_in_middle(
    docs: DataFrame, unit: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, sentinels: dict[str, str] = SENTINELS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, output, prefix_chars, middle_chars of every document.

    ``rate`` percent of the documents are cut, ``spm_rate`` percent of these put the suffix first; ``unit`` is a
    name of UNITS. Null text counts as empty; empty texts and texts that hold a sentinel stay plain, with
    null lengths. Rows that repeat an id draw alike; a null id draws as the empty string; an empty table gives
    no rows; whole texts of any length are cut, with about ten bytes of memory for each byte of a slice (SLICE_BYTES, or one longer text); columns other than the two named are never looked at.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), *drawn(F.col(id_column), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            draws = np.stack([batch.column(f"h{k}").to_numpy() for k in range(1, 5)], 1)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for part in slices(np.diff(offsets), SLICE_BYTES):
                own = offsets[part.start : part.stop + 1]
                found = reorder(data[own[0] : own[-1]], own - own[0], draws[part], UNITS[unit], rate, spm_rate, sentinels)
                lengths = [pa.array(found[k], pa.int64(), mask=found[k] < 0) for k in ("prefix_chars", "middle_chars")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array(found["n"], pa.int64()), pa.array(found["form"], pa.string()), pa.array(found["output"], pa.binary()).cast(pa.string()), *lengths],
                    ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"],
                )

    return rows.mapInArrow(run, f"doc_id long, {RESULT}")


def restored(output: Column, form: Column, sentinels: dict[str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of. A transformed text holds no sentinel, and none can arise at a cut, so splitting at the sentinels is exact."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels.values()), -1)
    at = lambda *order: F.concat(*(F.get(parts, F.lit(k)) for k in order))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(shared.documents(spark, sf_dir).select("doc_id", "text"))
    sha256 = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE_SQL = {
    "op13_fill_in_middle": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS unit,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(unit) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS draw FROM d),
f AS (
  SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= {RATE} THEN 'plain'
              WHEN draw[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(unit[1:a], '') AS prefix, array_to_string(unit[a + 1:b], '') AS middle, array_to_string(unit[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
}
