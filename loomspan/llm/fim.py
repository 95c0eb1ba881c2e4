"""Fill-in-middle transformation of texts.

A text is divided into blocks of equally many bytes. A Fenwick tree over the blocks
holds how many units (characters, words or lines) and how many code points begin in
them; a descent by powers of two finds the block of a cut, and the bytes of that block
alone are searched for its place. The trees of many texts lie one after the other in
one array, and all descents advance together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import pieces, table, text_or_empty
from loomspan.llm._words import words

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_starts(data: np.ndarray, off: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit. A word takes the white space after it, the first word also what comes before; a line its ``\\n``."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    out = np.zeros(len(data), bool)
    if unit == "word":
        out[words(data, off)[0]] = True
    elif unit == "line":
        out[off[:-1][off[:-1] < off[1:]]] = True
        after = np.flatnonzero(data[:-1] == 10) + 1
        out[after] = True
    else:
        raise ValueError(f"unit {unit!r} is none of char, word and line")
    return out


class Blocks:
    """Fenwick trees over the blocks of several texts: units and code points of each text's blocks."""

    def __init__(self, data: np.ndarray, off: np.ndarray, unit: str = "char", block: int = BLOCK):
        self.off, self.block = off, block
        self.starts, self.lead = unit_starts(data, off, unit), (data & 0xC0) != 0x80
        self.count = -(-np.diff(off) // block)  # blocks of each text
        self.base = np.concatenate([[0], np.cumsum(self.count + 1)])[:-1]  # place 0 of each tree is empty
        owner = np.repeat(np.arange(len(self.count)), self.count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        begin = off[owner] + within * block
        place = self.base[owner] + within + 1
        self.units, self.points = (self._tree(m, begin, place, owner, within + 1) for m in (self.starts, self.lead))

    def _tree(self, mask, begin, place, owner, number) -> np.ndarray:
        tree = np.zeros(int(self.count.sum()) + len(self.count), np.int64)
        if not len(place):
            return tree
        tree[place] = np.add.reduceat(mask, begin, dtype=np.int64)
        low = number & -number
        step = 1
        while step <= number.max():  # each node passes its sum on to the next larger one
            at = np.flatnonzero((low == step) & (number + step <= self.count[owner]))
            tree[place[at] + step] += tree[place[at]]
            step *= 2
        return tree

    def total(self, tree: np.ndarray) -> np.ndarray:
        """The sum of each text's blocks."""
        left, out = self.count.copy(), np.zeros(len(self.count), np.int64)
        while left.any():
            out += np.where(left > 0, tree[self.base + left], 0)
            left &= left - 1
        return out

    def cuts(self, row: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where texts ``row`` are cut after so many ``units``: byte of the whole array, and code points before it.
        A cut after no unit is at the beginning, one after all units at the end."""
        most, all_points = self.total(self.units)[row], self.total(self.points)[row]
        byte, points = self.off[row].copy(), np.zeros(len(row), np.int64)
        end = units >= most
        byte[end & (units > 0)], points[end & (units > 0)] = self.off[row + 1][end & (units > 0)], all_points[end & (units > 0)]
        inner = np.flatnonzero((units > 0) & ~end)
        own = row[inner]
        at, want, before = np.zeros(len(inner), np.int64), units[inner] + 1, np.zeros(len(inner), np.int64)
        step = 1 << int(self.count.max(initial=0)).bit_length()
        while step and len(inner):
            next_ = at + step
            place = self.base[own] + np.minimum(next_, self.count[own])
            go = (next_ <= self.count[own]) & (self.units[place] < want)
            at, want, before = np.where(go, next_, at), want - np.where(go, self.units[place], 0), before + np.where(go, self.points[place], 0)
            step >>= 1
        begin = self.off[own] + at * self.block
        for low in range(0, len(inner), 4096):  # the bytes of some blocks at a time
            part = slice(low, low + 4096)
            there = begin[part, None] + np.arange(self.block)
            inside = there < self.off[own[part] + 1][:, None]
            there = np.minimum(there, len(self.starts) - 1)
            local = np.argmax(np.cumsum(self.starts[there] & inside, axis=1) >= want[part, None], axis=1)
            byte[inner[part]] = begin[part] + local
            points[inner[part]] = before[part] + ((self.lead[there] & inside) & (np.arange(self.block) < local[:, None])).sum(axis=1)
        return byte, points


def _transform(unit: str, marks: tuple[bytes, bytes, bytes]):
    p, s, m = marks

    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch, 1):
                index = Blocks(data, off, unit)
                units, points = index.total(index.units), index.total(index.points)
                draws = np.stack([part.column(i).to_numpy(zero_copy_only=False) % (units + 1) for i in (2, 3)])
                rows = np.arange(len(units))
                one, chars_one = index.cuts(rows, draws.min(axis=0))
                two, chars_two = index.cuts(rows, draws.max(axis=0))
                raw, out, plain = data.tobytes(), [], []
                for form, a, b, c, d in zip(part.column(4).to_pylist(), off[:-1], one, two, off[1:]):
                    plain.append(form == "plain")
                    if form == "plain":
                        out.append(raw[a:d])
                    elif form == "psm":
                        out.append(p + raw[a:b] + s + raw[c:d] + m + raw[b:c])
                    else:
                        out.append(s + raw[c:d] + p + raw[a:b] + m + raw[b:c])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(units), part.column(4), pa.array(chars_one, mask=np.array(plain)), pa.array(chars_two - chars_one, mask=np.array(plain)),
                     pa.array(points), pa.array(out, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "n_chars", "output"],
                )

    return run


def draws(id_: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``seed:id``; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", percent: int = 90, spm_percent: int = 20, seed: str = "1",
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """One row per row of ``docs``: its id, n (units of the text), form, prefix_chars, middle_chars, n_chars and output.

    Two cuts, drawn by a hash of the id, divide a text into prefix, middle and suffix. ``percent`` of
    the texts are written as mark and part, mark and part: prefix, suffix, middle (psm), or for ``spm_percent``
    of them suffix, prefix, middle (spm). The others stay plain, as do texts that are empty (null
    counts as empty) or hold a mark; their prefix_chars and middle_chars are null. Units are characters
    (code points), words or lines. Equal ids are drawn alike; other columns are ignored; an empty table gives none.
    """
    text = text_or_empty(text_col)
    h = draws(F.col(id_col), seed)
    plain = (text == "") | (h[2] % 100 >= percent)
    for mark in marks:
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    out = rows.mapInArrow(_transform(unit, tuple(x.encode() for x in marks)), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, n_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of. No part holds a mark, so the first of each kind is the one that was set."""
    p, s, m = marks

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    spm = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir):
    """Every whole text of ``documents`` in fill-in-middle form, and as rebuilt from it. Null and empty texts are plain with n 0;
    repeated rows have equal rows; a row without an id is drawn as if its id were an empty text."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t
), c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, substr(text, 1, a) AS x, substr(text, a + 1, b - a) AS y, substr(text, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
