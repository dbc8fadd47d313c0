"""How moves are printed: one grammar of their parts. Patterns for native columns and the kernel's reading of words are built from it."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

# Fixed values of the notation: letters of the pieces, what ends a game, castling.
PIECES = "KQRBNP"
PROMOTED = "QRBN"
SQUARE = "[a-h][1-8]"
CASTLE = "O-O(?:-O)?"
RESULT = r"1-0|0-1|1/2-1/2|\*"
NUMBER = r"\d+\.(?:\.\.)?"
# Fixed values of older notation: its letters, and the files that a letter before a captured piece names.
OLD_LETTERS = {"K": "K", "Q": "Q", "R": "R", "B": "B", "S": "N", "N": "N", "P": "P"}
WING_FILES = {"R": "ah", "S": "bg", "N": "bg", "B": "cf", "Q": "d", "K": "e"}

HINTED = "[a-h]?[1-8]?"
# Fixed values of the notation: a printed move, and what only older notation prints.
#: A move of a main line alone in group 1; numbers and results match without it.
TOKEN = f"{NUMBER}|((?:{CASTLE}|[{PIECES}]?{HINTED}x?{SQUARE}(?:=[{PROMOTED}])?)[+#]?)[!?]*|{RESULT}"
#: What only older notation writes: a knight as S, a pawn by its letter, a captured piece by its.
OLDER = rf"\b[SP]{SQUARE}\b|\b[KQRBSP]x[KQRBSP]{{1,2}}\b"


class Shape(NamedTuple):
    """What a word says about its move; empty where it says nothing."""

    piece: str = "P"
    file: str = ""
    rank: str = ""
    takes: bool = False
    victim: str = ""
    to: str = ""
    promotion: str = ""
    castle: str = ""
    wing: str = ""


@lru_cache(1 << 16)
def shape(word: str, old: bool = False) -> Shape | None:
    """A word by its parts, or None if it is no move. ``old`` reads older notation: long forms, captured pieces, wings, no hints."""
    body = word.rstrip("!?").rstrip("+#")
    if (castle := body.replace("0", "O")) in ("O-O", "O-O-O") and not old:
        return Shape("K", castle=castle)
    letters = "".join(OLD_LETTERS) if old else PIECES
    body, mark, promotion = body.partition("=")
    if not mark and not old and len(body) > 2 and body[-1].upper() in PROMOTED and body[-2] in "12345678":
        body, promotion = body[:-1], body[-1]
    if promotion.upper() not in ("KQRBSN" if old else PROMOTED) or len(promotion) > 1 or (mark and not promotion):
        return None
    wing = body[0] if old and body[:1] in tuple("KQ") and body[1:2] in tuple(letters) else ""
    body = body[len(wing) :]
    piece = body[0] if body[:1] in tuple(letters) else ""
    body = body[len(piece) :]
    from_, sep, rest = ("", "", body)
    if found := re.search("[x-]", body):
        from_, sep, rest = body[: found.start()], found[0], body[found.end() :]
    else:
        from_, rest = body[:-2], body[-2:]
    victim = re.match(f"[{letters}]{{0,2}}", rest)[0] if old and sep == "x" else ""
    to = rest[len(victim) :]
    if not re.fullmatch(HINTED, from_) or not (re.fullmatch(SQUARE, to) or old and sep == "x" and not to):
        return None
    if old and (len(from_) == 1 or from_ and (not sep or wing) or sep == "-" and not from_):
        return None
    file, rank = (re.search(f"[{part}]", from_) for part in ("a-h", "1-8"))
    change = OLD_LETTERS if old else {}
    return Shape(change.get(piece, piece) or "P", file[0] if file else "", rank[0] if rank else "", sep == "x", victim, to, change.get(promotion, promotion.upper()), "", wing)
