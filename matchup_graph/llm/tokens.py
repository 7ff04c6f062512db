"""Ids of the word tokenizer for batches of texts."""

from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .common import claim
from .transducer import SEPARATOR, Merges, Transducer, is_plain, word_pretokens

WORD_FILE = "word_bpe_49k.json"


class WordTokenizer:
    """Plain texts run through the compiled transducer together; the library takes all others, and those with special strings."""

    def __init__(self, path: str, limit: int = 200_000):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.merges = Merges(path)
        self.machine = Transducer(self.merges, limit)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each whole text."""
        plain, out = [], [None] * len(texts)
        for i, text in enumerate(texts):
            if is_plain(text) and not any(s in text for s in self.merges.special):
                plain.append(i)
            else:
                out[i] = np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
        if plain:
            data = np.frombuffer(b"".join([x for i in plain for x in (texts[i], SEPARATOR)]), np.uint8)
            data, starts, ends = word_pretokens(data)
            counts, ids = self.machine.run(data, starts, ends)
            borders = np.searchsorted(starts, np.cumsum([0, *(len(texts[i]) + 1 for i in plain)]))
            at = np.concatenate([[0], np.cumsum(counts)])[borders].tolist()
            for i, (lo, hi) in zip(plain, pairwise(at), strict=True):
                out[i] = ids[lo:hi]
        return out


@lru_cache(maxsize=2)
def _load(file: str) -> WordTokenizer:
    return WordTokenizer(public_tokenizers.path(file))


def word_tokenizer(file: str = WORD_FILE) -> WordTokenizer:
    """One per Python worker."""
    claim("word bpe", _load.cache_clear)
    return _load(file)
