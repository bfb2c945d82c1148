"""Delimited lines that may be broken: valid rows load, bad lines come out apart with the reason.

Every line is parsed at minimum cost: a dynamic program over its tokens (tab, quote, run of other characters) may insert
or delete quotes and delimiters. Cost 0 means that the line is well-formed; otherwise the edit operations of the
cheapest parse state the reason. A quote edit outweighs any number of delimiter edits, so that a line whose quoting is
sound is never blamed for its quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from varicohort.session import written

QUOTE_EDIT = 1 << 32  # more than a line can have delimiters
_SOUND = re.compile(r'(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*\Z')
_CELL = re.compile(r'(?:\A|\t)("(?:[^"]|"")*"|[^"\t]*)')
_TOKEN = re.compile(r'\t|"|[^\t"]+')
_START, _PLAIN, _QUOTED, _CLOSED = range(4)


def sound_cells(line: str) -> list[str] | None:
    """The cells of a line that parses without any edit (quotes taken off, doubled ones single), else None."""
    if not _SOUND.match(line):
        return None
    return [c[1:-1].replace('""', '"') if c[:1] == '"' else c for c in _CELL.findall(line)]


def cheapest_edits(line: str, width: int) -> tuple[int, list[str]]:
    """Least cost, and the operations, that make ``line`` a well-formed record of ``width`` cells.

    States are the place within a cell times the number of the cell. A delimiter is never inserted where it would touch
    a quote: that would mend quoting by delimiters.
    """
    width = max(1, width)
    cost: dict[tuple[int, int], tuple[int, tuple]] = {(_START, 0): (0, ())}

    def relax(into: dict, key: tuple[int, int], c: int, ops: tuple) -> bool:
        if key not in into or c < into[key][0]:
            into[key] = (c, ops)
            return True
        return False

    def insertions(front: dict, at: int, coming: str) -> None:
        todo = list(front)
        while todo:
            state, cell = key = todo.pop()
            c, ops = front[key]
            here = (ops, ("insert delimiter", at))
            touching = state == _PLAIN and coming == '"' or state == _CLOSED and coming not in ("\t", "")
            if state != _QUOTED and cell + 1 < width and not touching and relax(front, (_START, cell + 1), c + 1, here):
                todo.append((_START, cell + 1))
            after = {_START: _QUOTED, _QUOTED: _CLOSED, _CLOSED: _QUOTED}.get(state)
            if after is not None and relax(front, (after, cell), c + QUOTE_EDIT, (ops, ("insert quote", at))):
                todo.append((after, cell))

    at = 0
    for token in _TOKEN.findall(line):
        kind = token[0] if token[0] in '\t"' else "x"
        insertions(cost, at, kind)
        then: dict[tuple[int, int], tuple[int, tuple]] = {}
        for (state, cell), (c, ops) in cost.items():
            if kind == "\t":
                if state == _QUOTED:
                    relax(then, (state, cell), c, ops)
                    continue
                if cell + 1 < width:
                    relax(then, (_START, cell + 1), c, ops)
                # two cells become one; what follows is read as it would be without the edit
                relax(then, (_START, cell), c + 1, (ops, ("delete delimiter", at)))
            elif kind == '"':
                if state != _PLAIN:
                    relax(then, ({_START: _QUOTED, _QUOTED: _CLOSED, _CLOSED: _QUOTED}[state], cell), c, ops)
                relax(then, (state, cell), c + QUOTE_EDIT, (ops, ("delete quote", at)))
            elif state != _CLOSED:
                relax(then, (_PLAIN if state == _START else state, cell), c, ops)
        cost, at = then, at + len(token)
    insertions(cost, at, "")
    c, chain = min((v for (state, cell), v in cost.items() if state != _QUOTED and cell == width - 1), key=lambda v: v[0])
    edits = []
    while chain:
        chain, op = chain
        edits.append(f"{op[0]} at {op[1]}")
    return c, edits[::-1]


def _reader(columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("reason", "edits", *columns)}
            for line, header in zip(b["line_text"], b["header"]):
                cells = sound_cells(line)
                reason = edits = None
                if cells is None or len(cells) != len(header):
                    cost, ops = cheapest_edits(line, len(header))
                    reason, edits, cells = "quoting" if cost >= QUOTE_EDIT else "columns", "; ".join(ops), None
                named = dict(zip(header, cells)) if cells else {}
                out["reason"].append(reason)
                out["edits"].append(edits)
                for c in columns:
                    value = named.get(c)
                    out[c].append(value.strip(" ") if value is not None else None)
            yield pd.concat([b[["line_id", "batch_id", "line_no"]].reset_index(drop=True), pd.DataFrame(out, dtype=object)], axis=1)

    return run


def parse_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Parse raw lines (line_id, batch_id, line_no, line_text) by the header of their batch (its line_no 1).

    Gives line_id, batch_id, line_no, reason (null, ``quoting`` or ``columns``), edits and ``columns`` as text (null
    if the line is bad or the header lacks the column). Lines that are null or nothing but white space, and batches
    without header, hold no records. Of repeated header lines the least one counts. Extra columns are ignored.
    """
    raw = lines.select("line_id", "batch_id", "line_no", F.regexp_replace("line_text", r"\r\z", "").alias("line_text"))
    headers = raw.where("line_no = 1").groupBy("batch_id").agg(F.min("line_text").alias("h")).select("batch_id", F.split(F.regexp_replace("h", r"[^a-z_\t]", ""), "\t").alias("header"))
    records = raw.where("line_no > 1").where(F.col("line_text").rlike(r"(?U)\S")).join(headers, "batch_id")
    shape = T.StructType([*lines.select("line_id", "batch_id", "line_no").schema, *(T.StructField(c, T.StringType()) for c in ("reason", "edits", *columns))])
    return records.select("line_id", "batch_id", "line_no", "line_text", "header").mapInPandas(_reader(columns), shape)


def check_manifest_lines(lines: DataFrame) -> DataFrame:
    """Parsed manifest lines with ``reasons``, the array of everything that is wrong (empty for a row that loads).

    The parse is written to the shared folder once, as names are compared with the other lines of the batch.
    """
    p = written(parse_lines(lines, ["sample_name", "sex", "tech_name", "vcf_path", "phenotype_codes"]), "parsed-lines")
    sound = p.where(F.col("reason").isNull())
    first = sound.groupBy("batch_id", F.coalesce("sample_name", F.lit("")).alias("name")).agg(F.min("line_no").alias("first_no"))
    j = sound.withColumn("name", F.coalesce("sample_name", F.lit(""))).join(first, ["batch_id", "name"])
    path = F.coalesce("vcf_path", F.lit(""))
    wrong = F.array(
        F.when(~F.coalesce(F.col("sex").isin("male", "female"), F.lit(False)), "sex"),
        F.when((path == "") | path.contains(" ") | ~path.rlike(r"\.vcf(\.gz)?\z"), "vcf_path"),
        F.when((F.col("name") == "") | (F.col("line_no") > F.col("first_no")), "sample_name"),
    )
    fields = ["line_id", "batch_id", "line_no", "sample_name", "sex", "tech_name", "vcf_path", "phenotype_codes", "edits"]
    typed = j.select(*fields, F.filter(wrong, lambda r: r.isNotNull()).alias("reasons"))
    return typed.unionByName(p.where(F.col("reason").isNotNull()).select(*fields, F.array("reason").alias("reasons")))
