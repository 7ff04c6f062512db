"""Column expressions on decks and archetypes.

A deck travels as one bigint: eight sorted card ids, first card in the highest
byte.  An archetype of k cards is packed the same way into the low k bytes.
"""

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECK_SIZE = 8


def check_k(k: int) -> int:
    """Return k if it is an archetype size, else raise ValueError."""
    if not 1 <= k <= DECK_SIZE:
        raise ValueError(f"k must be between 1 and {DECK_SIZE}, not {k}")
    return k


def card_ids(deck: Column) -> Column:
    """16 hex characters -> array of eight bigint card ids, in the order written."""
    return F.array(*[F.conv(F.substring(deck, 2 * i + 1, 2), 16, 10).cast("bigint") for i in range(DECK_SIZE)])


def is_hex_deck(deck: Column) -> Column:
    """True for exactly 16 hex characters of either case."""
    return F.coalesce(deck.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def pack(cards: list[Column]) -> Column:
    """Cards, highest byte first, as one bigint (eight cards may turn it negative)."""
    code = cards[0]
    for card in cards[1:]:
        code = F.shiftleft(code, 8).bitwiseOR(card)
    return code


def pack_deck(cards: Column) -> Column:
    """Array of eight card ids -> packed sorted deck."""
    ordered = F.array_sort(cards)
    return pack([ordered.getItem(i) for i in range(DECK_SIZE)])


def unpack(code: Column) -> list[Column]:
    """Packed deck -> its eight card ids."""
    return [F.shiftrightunsigned(code, 8 * (DECK_SIZE - 1 - i)).bitwiseAND(F.lit(255)) for i in range(DECK_SIZE)]


def archetypes(code: Column, k: int) -> Column:
    """Packed deck -> array of its C(8, k) packed archetypes; repeated cards give repeated entries."""
    cards = unpack(code)
    return F.array(*[pack([cards[i] for i in pick]) for pick in combinations(range(DECK_SIZE), check_k(k))])


def to_hex(code: Column, k: int) -> Column:
    """Packed archetype -> 2k lower-case hex characters."""
    return F.lower(F.lpad(F.hex(code), 2 * check_k(k), "0"))
