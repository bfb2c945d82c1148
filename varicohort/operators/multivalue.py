"""Several values packed in one field: one row per value, with its place.

A cell is split on its quote characters. A fold over them tells which open and close a literal, which are doubled inside
one, and which are ordinary characters; from then on odd pieces are literals, in which delimiters mean nothing, and even
pieces are split on delimiters. The values are put together from the array of pieces with their ordinals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The delimiters between values, and the shape of a code that lets a blank separate values too.
DELIMITERS = ",;|/\t\r\n"
CODE = r"[A-Z]{2}-?\d{2,3}(?:\.\d)?"

_MARK, _CUT = "\x01", "\x02"
STOPS = DELIMITERS + " \v\f"  # what may stand before an opening quote and after a closing one
_QUOTE = "[\"']"
# what is known of a quote character by its neighbours: it is a single one, may open, may close, is followed by its like
_SINGLE, _OPENS, _CLOSES, _PAIR = 1, 2, 4, 8
# states of the fold: outside, in a double or single literal, between the two halves of a doubled quote in either
_OUTSIDE, _DOUBLE_LITERAL, _SINGLE_LITERAL, _HALF = 0, 1, 2, 2


def _turn(state: int, quote: int) -> tuple[int, str]:
    """Next state and role of a quote: Open, Close, Plain within a literal, X (dropped half), Text outside."""
    single = bool(quote & _SINGLE)
    if state == _OUTSIDE:
        return (_SINGLE_LITERAL if single else _DOUBLE_LITERAL, "O") if quote & _OPENS else (state, "T")
    if state > _SINGLE_LITERAL:
        return state - _HALF, "X"
    if single != (state == _SINGLE_LITERAL):
        return state, "P"
    if quote & _PAIR:
        return state + _HALF, "P"
    return (_OUTSIDE, "C") if quote & _CLOSES else (state, "P")


_TURNS = [_turn(s, q) for s in range(5) for q in range(16)]


def _quote_facts(pieces: Column, quotes: Column) -> Column:
    """For each quote what its neighbours say of it; a quote only opens if one of its kind closes further on."""
    n = F.size(quotes)

    def local(q: Column, k: Column) -> Column:
        before, after = F.get(pieces, k), F.get(pieces, k + 1)
        stop = lambda c: F.instr(F.lit(STOPS), c) > 0
        opens = F.when(before == "", k == 0).otherwise(stop(F.substring(before, -1, 1)))
        closes = F.when(after == "", k + 1 == n).otherwise(stop(F.substring(after, 1, 1)))
        pair = (after == "") & F.coalesce(F.get(quotes, k + 1) == q, F.lit(False))
        bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
        return bit(q == "'", _SINGLE) + bit(opens, _OPENS) + bit(closes, _CLOSES) + bit(pair, _PAIR)

    return F.transform(quotes, local)


def _roles(facts: Column) -> Column:
    """The roles of the quotes, a character each, by a fold; in blocks, so that what a step appends to stays short."""
    n = F.size(facts)
    block = F.ceil(F.sqrt(n)).cast("int")
    nexts = F.lit("".join(str(s) for s, _ in _TURNS))
    roles = F.lit("".join(r for _, r in _TURNS))
    state = lambda s, r: F.struct(s.alias("s"), r.alias("r"))

    def step(a: Column, q: Column) -> Column:
        at = a["s"] * 16 + q + 1
        return state(F.substr(nexts, at, F.lit(1)).cast("int"), F.concat(a["r"], F.substr(roles, at, F.lit(1))))

    def of_block(a: Column, start: Column) -> Column:
        return F.aggregate(F.slice(facts, start + 1, block), state(a["s"], F.lit("")), step, lambda x: state(x["s"], F.concat(a["r"], x["r"])))

    end = F.aggregate(F.sequence(F.lit(0), n - 1, block), state(F.lit(0), F.lit("")), of_block)
    return end


def _mark_literals(df: DataFrame, cell: str, out: str) -> DataFrame:
    """``out``: the cell with a mark where a literal begins and ends, doubled quotes in it single; other quotes as they are."""
    d = df.withColumn(cell, F.translate(cell, _MARK + _CUT, ""))
    plain = ~F.col(cell).rlike(_QUOTE)
    quoted = F.when(~plain, F.col(cell))
    d = d.withColumn("__p", F.split(quoted, _QUOTE, -1)).withColumn("__q", F.regexp_extract_all(quoted, F.lit(f"({_QUOTE})"), F.lit(1)))
    d = d.withColumn("__f", _quote_facts(F.col("__p"), F.col("__q")))
    last = lambda odd: F.array_max(F.transform("__f", lambda f, k: F.when((f.bitwiseAND(_SINGLE) == odd) & (f.bitwiseAND(_CLOSES) != 0), k)))
    d = d.withColumn("__d", last(0)).withColumn("__s", last(1))
    # each place is named twice, so that the optimizer does not move its computation into the loop
    further = lambda k, c: F.col(c).isNotNull() & (k < F.col(c))
    closed = lambda f, k: F.when(f.bitwiseAND(_SINGLE) == 1, further(k, "__s")).otherwise(further(k, "__d"))
    d = d.withColumn("__f", F.transform("__f", lambda f, k: F.when(closed(f, k), f).otherwise(f.bitwiseAND(15 - _OPENS))))
    d = d.withColumn("__r", _roles(F.col("__f")))
    # a literal without end is none: what follows its opening quote is ordinary text
    r = F.col("__r.r")
    before = F.length(r) - F.locate("O", F.reverse(r))
    undone = F.concat(F.substr(r, F.lit(1), before), F.translate(F.substr(r, before + 1), "OPX", "TTT"))
    d = d.withColumn("__r", F.split(F.when(F.col("__r.s") == 0, r).otherwise(undone), ""))
    role = lambda i: F.get(F.col("__r"), i - 1)
    quote = lambda i: F.when(role(i).isin("O", "C"), F.lit(_MARK)).when(role(i) == "X", F.lit("")).otherwise(F.get(F.col("__q"), i - 1))
    joined = F.array_join(F.transform("__p", lambda p, i: F.when(i == 0, p).otherwise(F.concat(quote(i), p))), "")
    return d.withColumn(out, F.when(plain, F.col(cell)).otherwise(joined)).drop("__p", "__q", "__f", "__d", "__s", "__r")


def _split_plain(piece: Column, code: str) -> Column:
    """Delimiters become cuts; a blank beside a code is one as well."""
    p = F.regexp_replace(piece, r"[,;|/\t\r\n]", _CUT)
    p = F.regexp_replace(p, rf"(?<=^|[\s{_CUT}])({code})(?=$|[\s{_CUT}])", f"{_CUT}$1{_CUT}")
    return F.regexp_replace(p, r"\s+(?=$)|(?<=^)\s+", " ")


def split_packed(df: DataFrame, cell: str, keys: list[str], item: str = "item", item_no: str = "item_no", codes: list[str] | None = None) -> DataFrame:
    """One row per non-empty value of ``cell`` with ``keys`` and its place from 1; nulls and void cells give no row.

    Values are trimmed, and a quoted value loses its quotes; doubled quotes inside count once. A quote opens only at
    the cell's start or after a delimiter or blank, and closes only before one or at the end: an apostrophe within a
    word is an ordinary character, as is a quote that is never closed. ``codes``: values beside which a blank separates
    too, besides those of the usual shape (a bounded list). Repeated rows are kept as they are; other columns are not
    carried, so that names cannot clash.
    """
    code = "|".join([CODE, *(re.escape(c) for c in sorted(set(codes or []), key=lambda c: (-len(c), c)) if not re.fullmatch(CODE, c))])
    d = _mark_literals(df.select(*keys, F.col(cell).alias("__cell")), "__cell", "__marked")
    # even places are plain, odd ones literal; a literal is fenced by cuts so that it never joins its neighbours
    rebuilt = F.transform(F.split("__marked", _MARK), lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(_CUT), p, F.lit(_CUT))).otherwise(_split_plain(p, code)))
    values = F.transform(F.split(F.array_join(rebuilt, ""), _CUT), lambda v: F.regexp_replace(v, r"\A\s+|\s+\z", ""))
    parts = d.select(*keys, F.posexplode(F.filter(values, lambda v: v != "")).alias("__at", item))
    return parts.select(*keys, (F.col("__at") + 1).cast("int").alias(item_no), item)
