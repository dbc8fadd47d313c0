"""A table function of plies: a row for each token of a main line, for lateral joins in DataFrames and SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardframe.kernel import movetext as m
from boardframe.kernel.columns import SAFE
from boardframe.kernel.rules import Position


class Plies:
    """(fen, turn, moves) to ply (from 1), token, san, board (the position after it, all fields) and options (how many moves the token may denote).

    The line ends with the first token that is not one legal move, whose san and board are null. Without tokens, or where the position cannot
    be read, there are no rows."""

    def eval(self, fen: str, turn: str, moves: str) -> Iterator[tuple]:
        try:
            at = Position.of(fen, turn)
        except (*SAFE, AttributeError):
            return
        for ply, token in enumerate(m.tokens(moves or ""), 1):
            options = len(at.fitting(m.shape(token)) if m.shape(token) and m.shape(token).castle else at.matching(token, strict=False))
            try:
                move = at.parse(token)
            except SAFE:
                yield ply, token, None, None, options
                return
            san, at = at.san(move), at.push(move)
            yield ply, token, san, at.fen, options


COLUMNS = "ply int, token string, san string, board string, options int"
plies = F.udtf(Plies, returnType=COLUMNS)


def register(spark: SparkSession, name: str = "plies") -> None:
    """Makes the function known to SQL: ``SELECT ... FROM puzzles, LATERAL plies(fen, turn, moves)``."""
    spark.udtf.register(name, plies)


def with_plies(rows: DataFrame, fen: str = "fen", turn: str = "turn", moves: str = "moves") -> DataFrame:
    """Each row of ``rows`` beside each ply of its line; rows without plies go."""
    return rows.lateralJoin(plies(F.col(fen).outer(), F.col(turn).outer(), F.col(moves).outer()))
