"""Inputs that queries generate from the driver's tables, as SQL that Spark and the oracle both read.

Tables stand in braces (``{customer}``): Spark gets frames for them, the oracle their names. ``h`` is a hash of the key in
hexadecimal digits, ``digit`` one of them, so values vary from row to row and are the same everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def digit(i: int) -> str:
    return f"(instr('0123456789abcdef', substr(h, {i}, 1)) - 1)"


def whole(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}.0) AS BIGINT)"


#: A table's name in braces, and no other braces, which texts may have.
TABLE = re.compile(r"\{(customer|events|lineitem|orders|part|supplier|documents|labels|conversations|pages)\}")


def oracle(sql: str) -> str:
    return TABLE.sub(r"\1", sql)


#: Tables of few columns and bytes, of which rows are made that take long to work on: however few groups of rows their files have, all tasks get some.
DEALT = ("customer", "supplier")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in some parts for each core, as one task reads a whole group of rows of a file."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def few(batches: Iterator[pd.DataFrame], n: int = 64) -> Iterator[pd.DataFrame]:
    """Batches of at most ``n`` rows, for functions that make far more of a row than it is, so a worker holds little at once."""
    for part in batches:
        for i in range(0, len(part), n):
            yield part.iloc[i : i + n]


def made(t, sql: str) -> DataFrame:
    """The rows of ``sql`` over the tables that ``t`` reads."""
    frames = {name: dealt(t(name)) if name in DEALT else t(name) for name in set(TABLE.findall(sql))}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"generated_{name}")
    return next(iter(frames.values())).sparkSession.sql(TABLE.sub(r"generated_\1", sql))


def named(*tables: str, select: str) -> str:
    return f"WITH {', '.join(tables)} {select}"


def _square(f: str, r: str) -> str:
    return f"substr('abcdefgh', CAST({f} AS INT) + 1, 1) || CAST({r} AS STRING)"


def _row(file: str, piece: str, here: str) -> str:
    """A placement's row with one piece at ``file`` (0 to 6), where ``here`` holds; else an empty one."""
    return f"CASE WHEN {here} THEN (CASE WHEN {file} = 0 THEN '' ELSE CAST({file} AS STRING) END) || '{piece}' || CAST(7 - {file} AS STRING) ELSE '8' END"


def _board(piece: str) -> str:
    return "'7k/' || " + " || '/' || ".join(_row("f1", piece, f"r1 = {r}") for r in range(7, 1, -1)) + " || '/7K'"


#: A puzzle for each customer: kings in the corners h1 and h8, a white rook (``fen``) or knight (``knight``) on square s1, two more squares s2
#: and s3 on files a to f and rows 2 to 7. A rook's move changes file or row, but not both; kings are never in its way, and it gives no check.
PUZZLES = f"""
keys AS (SELECT c_custkey AS k, md5(CAST(c_custkey AS STRING)) AS h FROM {{customer}}),
places AS (SELECT k, h, {', '.join(f'{digit(2 * i - 1)} % 6 AS f{i}, 2 + {digit(2 * i)} % 6 AS r{i}' for i in (1, 2, 3))}, {', '.join(f'{digit(i)} AS d{i}' for i in range(7, 14))} FROM keys),
puzzles AS (SELECT *, CAST(k AS STRING) AS id, {', '.join(f"{_square(f'f{i}', f'r{i}')} AS s{i}" for i in (1, 2, 3))}, {_board('R')} AS fen, {_board('N')} AS knight,
  (f1 = f2) <> (r1 = r2) AS go12, (f1 = f3) <> (r1 = r3) AS go13, (f2 = f3) <> (r2 = r3) AS go23, abs(f1 - f2) * abs(r1 - r2) = 2 AS hop12 FROM places)"""

#: Those with printed solutions: some without a number, some with a variation, some blank, some without a king, sides that may be wrong.
PRINTED = PUZZLES + """,
printed AS (SELECT *, CASE WHEN d7 = 0 THEN replace(fen, '7k/', '8/') ELSE fen END AS board, CASE WHEN d8 < 4 THEN 'b' ELSE 'w' END AS side,
  CASE WHEN d9 = 0 THEN NULL WHEN d9 = 1 THEN '' ELSE (CASE WHEN d10 < 4 THEN '' ELSE '1.' END) || 'R' || s2 || (CASE WHEN d11 < 8 THEN ' (1.R' || s3 || ')' ELSE '' END) END AS moves,
  d7 = 0 AS broken, d9 < 2 AS blank, d10 >= 4 AS numbered, go12 AS main_ok, go12 AND (d11 >= 8 OR go13) AS full_ok FROM puzzles)"""

#: A board of any pieces for each order: 64 letters, one king of each side or, in some, none.
BOARDS = f"""
keys AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS STRING)) AS h FROM {{orders}}),
places AS (SELECT k, h, 4 * {digit(1)} + {digit(2)} % 4 AS white, 4 * {digit(3)} + {digit(4)} % 4 AS black,
  translate(h || md5(h), '0123456789abcdef', CASE WHEN {digit(5)} < 8 THEN '....QRBN.....rbn' WHEN {digit(5)} < 12 THEN '.....R..........' ELSE '...P.RB..nq...pp' END) AS cells FROM keys),
kings AS (SELECT k, h, CASE WHEN {digit(6)} = 0 THEN cells ELSE substr(cells, 1, white) || 'K' || substr(cells, white + 2, 64) END AS cells, black FROM places),
boards AS (SELECT k, h, CASE WHEN {digit(7)} = 0 THEN cells ELSE substr(cells, 1, black) || 'k' || substr(cells, black + 2, 64) END AS cells FROM kings)"""


def placed(cells: str) -> str:
    """A placement from 64 letters: rows apart, then runs of dots as numbers, the longest first."""
    out = " || '/' || ".join(f"substr({cells}, {8 * i + 1}, 8)" for i in range(8))
    for n in range(8, 0, -1):
        out = f"replace({out}, '{'.' * n}', '{n}')"
    return out
