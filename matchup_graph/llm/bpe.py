"""Byte-level BPE: encoding by the compiled transducer, decoding by a byte-to-text machine.

Batches of texts run through the transducer together; a text longer than BLOCK
is streamed: its blocks are split and run one after the other, a pretoken that
is longer than a block is fed to the transducer in parts, and what is emitted
goes on at once, so memory does not grow with the text or with any pretoken.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BLOCK, claim, text_batches, trim
from .transducer import SEPARATOR, Key, Merges, Transducer, byte_pretokens, is_plain

BYTE_FILE = "byte_bpe_50k.json"
_SPLIT = regex.compile(public_tokenizers.PATTERN)
_LAST_SYNC = regex.compile(r"(?r)\S(?=\s)")
#: The classes that a pretoken is a run of; white space is the first.
_RUNS = [regex.compile(p) for p in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]


class Utf8Machine:
    """Bytes -> text, one part at a time; its state is the start of a character that isn't complete."""

    #: Bytes of a character by its first byte's upper half.
    SIZE = [1] * 12 + [2, 2, 3, 4]

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                first = data[-back]
                if first & 0xC0 != 0x80:
                    if self.SIZE[first >> 4] > back:
                        cut -= back
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def text_blocks(data: bytes, size: int = BLOCK) -> Iterator[str]:
    """Text of UTF-8 bytes in blocks."""
    machine = Utf8Machine()
    for at in range(0, len(data), size):
        yield machine.feed(data[at : at + size], at + size >= len(data))


def pretokens(blocks: Iterator[str], size: int = BLOCK) -> Iterator[tuple[list[str], bool]]:
    """(pretokens, open), block by block: open means that the one pretoken given goes on in the next item.

    A block ends where a word is followed by white space, which no pretoken
    crosses.  Where there is no such place, all but the last two matches are
    final; a single match that fills half a block is a run of one class and is
    handed on in parts, so no more than some blocks are held.  size is 16 at least.
    """
    held, run = "", None
    for block in blocks:
        if run is not None:
            block, held = held + block, ""
            end = run.match(block).end()
            spaces = run is _RUNS[0]
            if end == len(block):
                held = block[end - spaces :]
                yield [block[: end - spaces]], True
                continue
            # the last white space belongs to what follows
            yield [block[: end - spaces]], False
            block, run = block[end - spaces :], None
        held += block
        if len(held) < size // 2:
            continue
        sync = _LAST_SYNC.search(held)
        if sync:
            yield _SPLIT.findall(held[: sync.end()]), False
            held = held[sync.end() :]
            continue
        found = _SPLIT.findall(held)
        if len(found) > 2:
            yield found[:-2], False
            held = "".join(found[-2:])
            continue
        if len(found) == 2 and len(found[0]) > 2:
            yield found[:1], False
            held = found[1]
            found = found[1:]
        if len(found) == 1 and len(held) >= size // 2:
            run = next(r for r in _RUNS if r.match(held, len(held) - 1).end() == len(held))
            spaces = run is _RUNS[0]
            yield [held[: len(held) - spaces]], True
            held = held[len(held) - spaces :]
    if run is not None:
        yield [held], False
    elif held:
        yield _SPLIT.findall(held), False


class ByteBPE:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.machine = Transducer(self.merges)
        top = max(self.merges.raw) + 1
        #: Bytes, and the decimal number, of each id.
        self.raw = [self.merges.raw.get(i, b"") for i in range(top)]
        self.names = [b"%d" % i for i in range(top)]

    def pieces(self, found: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The machine's run over given pretokens."""
        data = [w.encode() for w in found]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return self.machine.run(np.frombuffer(b"".join(data), np.uint8), starts[: len(data)], ends, ids)

    def batch(self, texts: list[bytes], ids: bool = True) -> list:
        """Ids of each text (or how many, with ids=False); all plain texts are one run, all others another."""
        plain, odd, out = [], [], [None] * len(texts)
        for i, text in enumerate(texts):
            (plain if is_plain(text) else odd).append(i)
        if plain:
            data = np.frombuffer(b"".join([x for i in plain for x in (texts[i], SEPARATOR)]), np.uint8)
            starts, ends = byte_pretokens(data)
            borders = np.searchsorted(starts, np.cumsum([0, *(len(texts[i]) + 1 for i in plain)]))
            self._deal(plain, borders, self.machine.run(data, starts, ends, ids), out)
        if odd:
            found = [_SPLIT.findall(texts[i].decode("utf-8", "replace")) for i in odd]
            borders = np.cumsum([0, *map(len, found)])
            self._deal(odd, borders, self.pieces([w for words in found for w in words], ids), out)
        return out

    @staticmethod
    def _deal(owners: list[int], borders: np.ndarray, result: tuple[np.ndarray, np.ndarray | None], out: list) -> None:
        counts, ids = result
        at = np.concatenate([[0], np.cumsum(counts)])[borders].tolist()
        for i, (lo, hi) in zip(owners, pairwise(at), strict=True):
            out[i] = hi - lo if ids is None else ids[lo:hi]

    def encode_texts(self, texts: list[bytes], ids: bool = True) -> list:
        """Ids (or their number) of whole texts of bounded size, special strings among them."""
        if not any(s in t for s in self.merges.special for t in texts):
            return self.batch(texts, ids)
        parts = [[*self.merges.segments(t)] for t in texts]
        found = iter(self.batch([data for part in parts for data, special in part if special is None], ids))
        if ids:
            return [np.concatenate([np.empty(0, np.int32), *(next(found) if special is None else [special] for _, special in part)]).astype(np.int32) for part in parts]
        return [sum(next(found) if special is None else 1 for _, special in part) for part in parts]

    def stream(self, text: bytes, size: int = BLOCK) -> Iterator[list[int]]:
        """Ids of a text of any length, in parts of bounded size, as soon as they are stable."""
        for data, special in self.merges.segments(text):
            if special is not None:
                yield [special]
                continue
            key: Key | None = None
            for found, more in pretokens(text_blocks(data, size), size):
                if not more and key is None:
                    yield self.pieces(found)[1].tolist()
                    continue
                key, out = self.machine.feed(key or self.machine.START, found[0].encode())
                if not more:
                    out += self.machine.finish(key)
                    key = None
                yield out

    def digests(self, parts: Iterator[list[int]]) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of them as decimals with commas, SHA-256 of the text that they decode to)."""
        ids_sha, text_sha, back = hashlib.sha256(), hashlib.sha256(), Utf8Machine()
        n, comma = 0, b""
        for ids in parts:
            if ids:
                ids_sha.update(comma + b",".join(map(self.names.__getitem__, ids)))
                text_sha.update(back.feed(b"".join(map(self.raw.__getitem__, ids))).encode())
                n, comma = n + len(ids), b","
        text_sha.update(back.feed(b"", True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


@lru_cache(maxsize=2)
def _load(file: str) -> ByteBPE:
    return ByteBPE(public_tokenizers.path(file))


def byte_bpe(file: str = BYTE_FILE) -> ByteBPE:
    """One per Python worker."""
    claim("byte bpe", _load.cache_clear)
    return _load(file)


def map_encoded(docs: DataFrame, schema: str, each: Callable[[ByteBPE, list[bytes]], list[list]], types: list[pa.DataType], file: str) -> DataFrame:
    """doc_id and the columns that each(bpe, texts) gives, over batches of texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(part.split()[0] for part in schema.split(", "))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file)
        for whole in batches:
            for part, texts in text_batches(whole):
                columns = [pa.array(c, t) for c, t in zip(each(bpe, texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)
        trim()

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, file: str = BYTE_FILE) -> DataFrame:
    """(doc_id, ids array<int>): a map over whole texts; NULL text gives no ids.

    Each row is mapped alone, so repeated rows give repeated rows; other columns
    are left out, whatever their names.
    """
    return map_encoded(docs, "ids array<int>", lambda bpe, texts: [bpe.encode_texts(texts) if len(texts) > 1 else [[i for p in bpe.stream(texts[0]) for i in p]]], [pa.list_(pa.int32())], file)


def decode(rows: DataFrame, file: str = BYTE_FILE) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): NULL ids give NULL text, ids outside the vocabulary nothing."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = byte_bpe(file).raw
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                machine = Utf8Machine()
                out.append(None if ids is None else machine.feed(b"".join([raw[i] for i in ids if 0 <= i < len(raw)]), True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, file: str = BYTE_FILE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs.

    A map over rows, no shuffle.  NULL and empty texts give no tokens and the
    digests of nothing; long texts are streamed in blocks.  Each row is mapped
    alone, so repeated rows give repeated rows; other columns are left out,
    whatever their names, and a NULL doc_id is carried.
    """

    def each(bpe: ByteBPE, texts: list[bytes]) -> list[list]:
        if len(texts) == 1:
            found = [bpe.digests(bpe.stream(texts[0]))]
        else:
            found = [bpe.digests([ids.tolist()]) for ids in bpe.encode_texts(texts)]
        return [*zip(*found, strict=True)]

    return map_encoded(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", each, [pa.int64(), pa.string(), pa.string()], file)


def op4(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
