"""Boards as placements, as 64 letters from a8 to h1, and as maps from square to piece; all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardframe.functions.once import once

FILES, RANKS = "abcdefgh", "87654321"
SQUARES = [f + r for r in RANKS for f in FILES]


def _runs(text: Column, digits: range, back: bool) -> Column:
    for i in digits:
        dots = F.lit("." * i)
        text = F.replace(text, *((dots, F.lit(str(i))) if back else (F.lit(str(i)), dots)))
    return text


def rows(placement: Column) -> Column:
    """The eight rows, each with a letter or dot for a square."""
    return F.split(_runs(placement, range(1, 9), False), "/")


def decode(placement: Column) -> Column:
    return F.array_join(rows(placement), "")


def encode(cells: Column) -> Column:
    """64 letters to a placement."""

    def placed(cells: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(cells, i * 8 + 1, F.lit(8)))
        return _runs(F.array_join(parts, "/"), range(8, 0, -1), True)

    return once(placed, cells=cells)


def to_map(placement: Column) -> Column:
    cells, squares = F.split(decode(placement), ""), F.split(F.lit(" ".join(SQUARES)), " ")
    return F.map_from_entries(F.filter(F.zip_with(squares, cells, lambda s, p: F.struct(s.alias("key"), p.alias("value"))), lambda e: e["value"] != "."))


def from_map(board: Column) -> Column:
    """Pieces put on an empty board one by one."""
    place = lambda key: ((8 - F.substring(key, 2, 1).cast("int")) * 8 + F.instr(F.lit(FILES), F.left(key, F.lit(1))))
    cells = F.aggregate(F.map_entries(board), F.repeat(F.lit("."), F.lit(64)), lambda out, e: F.overlay(out, e["value"], place(e["key"]), F.lit(1)))
    return encode(cells)


def castling(placement: Column) -> Column:
    """Rights that kings and rooks at home allow, ``-`` without any."""
    all_rows = rows(placement)
    white, black = F.try_element_at(all_rows, F.lit(-1)), F.try_element_at(all_rows, F.lit(1))

    def rights(row: Column, king: str, rook: str, long: str) -> Column:
        home = (F.length(row) == 8) & (F.substring(row, 5, 1) == king)
        return F.concat(F.when(home & (F.substring(row, 8, 1) == rook), king).otherwise(""), F.when(home & (F.substring(row, 1, 1) == rook), long).otherwise(""))

    found = F.concat(rights(white, "K", "R", "Q"), rights(black, "k", "r", "q"))
    return F.when(placement.isNotNull(), F.coalesce(F.nullif(found, F.lit("")), F.lit("-")))


def placement(fen: Column) -> Column:
    return F.try_element_at(F.split(F.trim(fen), r"\s+"), F.lit(1))


def full_fen(fen: Column, turn: Column | None = None) -> Column:
    """All six fields; those given stay."""
    part = F.split(F.trim(fen), r"\s+")
    default = [None, turn if turn is not None else F.lit("w"), castling(part[0]), F.lit("-"), F.lit("0"), F.lit("1")]
    fields = [part[0]] + [F.coalesce(F.try_element_at(part, F.lit(i + 1)), d, F.lit("w")) for i, d in enumerate(default) if i]
    return F.when(fen.isNotNull(), F.concat_ws(" ", *fields))


def structural_reason(board: Column) -> Column:
    """Why a placement cannot be a position, or null: the first of grammar, kings, pawns on the last rows, and too many pawns."""

    def reason(board: Column, parts: Column, cells: Column) -> Column:
        count = lambda piece: F.length(cells) - F.length(F.replace(cells, F.lit(piece), F.lit("")))
        grammar = board.rlike(r"^[1-8KQRBNPkqrbnp]+(/[1-8KQRBNPkqrbnp]+){7}$") & ~board.rlike(r"\d\d") & F.forall(parts, lambda r: F.length(r) == 8)
        edge = F.concat(F.substring(cells, 1, 8), F.substring(cells, 57, 8))
        return (
            F.when(board.isNull() | ~grammar, "unparseable")
            .when((count("K") != 1) | (count("k") != 1), F.concat(F.lit("kings: "), count("K").cast("string"), F.lit(" white, "), count("k").cast("string"), F.lit(" black")))
            .when(edge.rlike("[Pp]"), "pawn on rank 1/8")
            .when((count("P") > 8) | (count("p") > 8), "more than 8 pawns")
        )

    return once(lambda board, parts: once(reason, board=board, parts=parts, cells=F.array_join(parts, "")), board=board, parts=rows(board))


def shifts(board: Column) -> Column:
    """All boards one square up, down, left or right that lose no piece: an array of (direction, placement)."""

    def found(parts: Column) -> Column:
        blank = F.lit("........")
        moved = {
            "up": (F.element_at(parts, 1) == blank, F.concat(F.slice(parts, 2, 7), F.array(blank))),
            "down": (F.element_at(parts, 8) == blank, F.concat(F.array(blank), F.slice(parts, 1, 7))),
            "left": (F.forall(parts, lambda r: r.startswith(".")), F.transform(parts, lambda r: F.concat(F.substring(r, 2, 7), F.lit(".")))),
            "right": (F.forall(parts, lambda r: r.endswith(".")), F.transform(parts, lambda r: F.concat(F.lit("."), F.substring(r, 1, 7)))),
        }
        whole = (F.size(parts) == 8) & F.forall(parts, lambda r: F.length(r) == 8)
        good = F.filter(F.array(*(F.when(ok, F.struct(F.lit(d).alias("direction"), encode(F.array_join(to, "")).alias("fen"))) for d, (ok, to) in moved.items())), lambda x: x.isNotNull())
        return F.when(whole, good).otherwise(F.array().cast("array<struct<direction:string,fen:string>>"))

    return once(found, parts=rows(board))


def mismatches(board: Column, mask: Column) -> Column:
    """Squares where a mask (square to occupied, empty or uncertain) and a board disagree; null without a mask."""
    return once(lambda board, mask: F.size(F.map_filter(mask, lambda s, v: (v != "uncertain") & (F.map_contains_key(board, s) != (v == "occupied")))).cast("int"), board=board, mask=mask)


def differing(boards: Column) -> Column:
    """Squares in which an array of placements is not of one mind."""

    def found(cells: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.size(F.array_distinct(F.transform(cells, lambda c: F.substring(c, i, F.lit(1))))) > 1)
        return F.transform(at, lambda i: F.concat(F.substring(F.lit(FILES), F.pmod(i - 1, F.lit(8)) + 1, F.lit(1)), F.substring(F.lit(RANKS), F.floor((i - 1) / 8).cast("int") + 1, F.lit(1))))

    return once(found, cells=F.transform(boards, decode))


def row_fits(rank: Column, cells: Column) -> Column:
    """Whether a row's glyphs, one for each square from a to h, match the colours of their squares: lower case and blanks on light ones."""
    def fits(c: Column, i: Column) -> Column:
        light = (rank + i + 1) % 2 == 1
        return F.when(c == " ", light).when(c == "+", ~light).otherwise((c == F.lower(c)) == light)

    return F.forall(F.transform(cells, fits), lambda x: x)
