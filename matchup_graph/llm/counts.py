"""Token counts by the compiled transducer and composable chunk maps.

Each transition of the transducer (see `transducer`) is annotated with the
number of tokens that it emits, so counting is a walk that sums.  Texts are cut
into chunks at fixed places, whatever stands there.  A chunk is a map from the
state in which it is entered to the state in which it is left and the tokens
between.  Behind any character that is followed by white space every state is
the start state, so a chunk's map is: what stands before its first such place
(to be run from the entry state), the tokens from there to its last such place,
and what stands behind it (the exit state).  Maps compose associatively, by a
parallel prefix scan over the chunks of a text.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _LAST_SYNC, BYTE_FILE, ByteBPE, byte_bpe
from .common import BLOCK, Memo, claim, trim

#: Characters of a chunk; longer texts have MAX_CHUNKS longer ones.
CHUNK = 2048
MAX_CHUNKS = 256
LIMIT = 512
_FIRST_SYNC = regex.compile(r"\S(?=\s)")


class CountTransducer:
    """Counts the tokens of pieces of text that begin in the start state and end at a pretoken's end."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.special = {s.decode(): i for s, i in bpe.merges.special.items()}
        self.short = Memo(lambda text: self.counts([text.encode()])[0], 50_000)

    def counts(self, texts: list[bytes]) -> list[int]:
        return self.bpe.encode_texts(texts, ids=False)

    def learn(self, texts: set[str]) -> None:
        """Count short texts together, so that `count` knows them."""
        new = [t for t in texts if t not in self.short]
        self.short.update(zip(new, self.counts([t.encode() for t in new]), strict=True))

    def count(self, text: str) -> int:
        """One text, as a rule a few characters where two chunks meet."""
        return self.short[text] if text else 0


@dataclass(frozen=True)
class ChunkMap:
    """head, tokens and tail of a chunk; tail is None if no state is certain inside it."""

    head: str
    tokens: int = 0
    tail: str | None = None


def cut_chunk(text: str) -> tuple[str, str, str | None]:
    """(head, body, tail): the body begins and ends in the start state.

    No place inside a special string (they have no white space) is certain to
    be the start state, and none is taken: white space follows each one.
    """
    first = _FIRST_SYNC.search(text)
    if first is None:
        return text, "", None
    last = _LAST_SYNC.search(text)
    return text[: first.end()], text[first.end() : last.end()], text[last.end() :]


def chunk_map(text: str, machine: CountTransducer) -> ChunkMap:
    head, body, tail = cut_chunk(text)
    return ChunkMap(head, machine.counts([body.encode()])[0] if body else 0, tail)


def compose(a: ChunkMap, b: ChunkMap, machine: CountTransducer) -> ChunkMap:
    """First a, then b."""
    if a.tail is not None:
        if b.tail is None:
            return settle(ChunkMap(a.head, a.tokens, a.tail + b.head), machine)
        return ChunkMap(a.head, a.tokens + machine.count(a.tail + b.head) + b.tokens, b.tail)
    joined = chunk_map(a.head + b.head, machine)
    if b.tail is None:
        return joined
    if joined.tail is None:
        return ChunkMap(joined.head, b.tokens, b.tail)
    return ChunkMap(joined.head, joined.tokens + machine.count(joined.tail) + b.tokens, b.tail)


def settle(m: ChunkMap, machine: CountTransducer) -> ChunkMap:
    """Count what a longer tail has made certain."""
    last = _LAST_SYNC.search(m.tail)
    return ChunkMap(m.head, m.tokens + machine.count(m.tail[: last.end()]), m.tail[last.end() :]) if last else m


def scan(maps: list[ChunkMap], machine: CountTransducer) -> list[ChunkMap]:
    """Inclusive prefix scan in a logarithmic number of rounds of independent compositions."""
    step = 1
    while step < len(maps):
        maps = [m if i < step else compose(maps[i - step], m, machine) for i, m in enumerate(maps)]
        step *= 2
    return maps


def certain(m: ChunkMap, machine: CountTransducer) -> int:
    """Tokens up to the last place of a prefix that is certain to be a pretoken's end."""
    return 0 if m.tail is None else machine.count(m.head) + m.tokens


def run(whole: ChunkMap, machine: CountTransducer) -> int:
    """Tokens of a whole text, from the start state."""
    return machine.count(whole.head) + whole.tokens + machine.count(whole.tail or "")


_machines: dict[str, CountTransducer] = {}


def transducer(file: str = BYTE_FILE) -> CountTransducer:
    """One per Python worker."""
    bpe = byte_bpe(file)
    claim("byte bpe", _machines.clear)
    if file not in _machines:
        _machines[file] = CountTransducer(bpe)
    return _machines[file]


def chunk_rows(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, n, text): the chunks of each row's text; NULL and empty texts have one empty chunk."""
    size = F.greatest(F.lit(chunk), F.ceil(F.length("text") / MAX_CHUNKS)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", size)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / F.col("size")).cast("int") - 1))
    return rows.select("row", "doc_id", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i * F.col("size") + 1, F.col("size")))).alias("n", "text"))


def token_counts(docs: DataFrame, file: str = BYTE_FILE, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks, tokens_before), one row per row of docs.

    Chunks are mapped as rows of their own; only the maps are brought together,
    a few dozen bytes each, at most MAX_CHUNKS a text.  tokens_before are the
    scan's values: the tokens that are certain before each further chunk's end.
    NULL and empty texts have no tokens.  Each row is counted alone, so repeated
    rows give repeated rows; other columns are left out, whatever their names,
    and a NULL doc_id is carried.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(file)
        for whole in batches:
            start, held, parts = 0, 0, []
            for i, text in enumerate(whole.column("text")):
                parts.append(text.as_py())
                held += len(parts[-1])
                if held < BLOCK and i + 1 < whole.num_rows:
                    continue
                batch = whole.slice(start, len(parts))
                heads, bodies, tails = zip(*map(cut_chunk, parts), strict=True)
                counts = machine.counts([b.encode() for b in bodies])
                sizes = [len(t.encode()) for t in parts]
                columns = [batch.column("row"), batch.column("doc_id"), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(heads, pa.string()), pa.array(counts, pa.int64()), pa.array(tails, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "bytes", "head", "tokens", "tail"])
                start, held, parts = i + 1, 0, []
        trim()

    mapped = chunk_rows(docs, chunk).mapInArrow(maps, f"row bigint, doc_id {kind}, n int, bytes bigint, head string, tokens bigint, tail string")
    gathered = mapped.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("n", "head", "tokens", "tail"))).alias("maps"))
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "tokens_before"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(file)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            all_maps = [[ChunkMap(m["head"], m["tokens"], m["tail"]) for m in maps] for maps in batch.column("maps").to_pylist()]
            machine.short.clear()
            machine.learn({m.head for maps in all_maps for m in maps[:1]} | {maps[-1].tail or "" for maps in all_maps} | {(a.tail or "") + b.head for maps in all_maps for a, b in pairwise(maps)})
            prefixes = [scan(maps, machine) for maps in all_maps]
            n = [run(p[-1], machine) for p in prefixes]
            before = [[certain(m, machine) for m in p[:-1]] for p in prefixes]
            columns = [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(map(len, prefixes), pa.int64()), pa.array(before, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)
        trim()

    return gathered.select("doc_id", "n_bytes", "maps").mapInArrow(totals, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, tokens_before array<bigint>")


def op6(docs: DataFrame) -> DataFrame:
    return token_counts(docs).drop("tokens_before")
