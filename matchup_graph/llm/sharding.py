"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised into cells of about equally many rows, in the column's
own order.  Rows are sorted by the place of their cells on a Hilbert curve and
the line is cut into runs, the shards.  Neighbours on the curve are neighbours
in every column, so each shard spans a small box, and the least and greatest
values that its Parquet files keep let a reader skip most of them for a filter
on any of the columns.  Everything is DataFrame operations.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checksum_sql import crc32_sql
from .common import cut
from .ranks import before, placed

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
SHARDS = 16
LAWS = ("rows", "bytes")
#: Types whose values are compared as numbers; all others are compared as text.
WHOLE = ("byte", "short", "integer", "long")


def sortable(docs: DataFrame, name: str) -> Column:
    """A column as text whose order is the column's own; NULL comes first."""
    if docs.schema[name].dataType.typeName() in WHOLE:
        value = F.col(name).cast("long")
        # the sign bit is turned over, so that text order is numeric order
        return F.coalesce(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def borders(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> dict[str, list[tuple[str, int]]]:
    """By dimension, the least value of each cell and the cell, ascending: at most 2**bits pairs each.

    A value's cell is the share of rows with smaller values, in 2**bits steps.
    Only the metadata columns are read, and values are counted before they are
    shuffled; sums over the sorted values give the cells.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("d"), sortable(docs, n).alias("value")) for i, n in enumerate(dimensions)])
    counted = cut(docs.select(F.inline(pairs)).groupBy("d", "value").agg(F.count("*").alias("n")))
    total = counted.where("d = 0").agg(F.sum("n")).first()[0] or 0
    if not total:
        return {n: [] for n in dimensions}
    sums = before(placed(counted, ["d", "value"]), "n")
    # each dimension counts all rows once, so those of earlier dimensions are d times the total
    cells = sums.select("d", "value", F.expr(f"cast((n_before - d * {total}) * {1 << bits} div {total} AS int)").alias("cell"))
    found = cells.groupBy("d", "cell").agg(F.min("value").alias("value")).collect()
    return {n: sorted((r["value"], r["cell"]) for r in found if r["d"] == i) for i, n in enumerate(dimensions)}


def cell(docs: DataFrame, name: str, starts: list[tuple[str, int]]) -> Column:
    """The cell of a row in one dimension: that of the greatest border not above its value; NULL lies in cell 0."""
    number = docs.schema[name].dataType.typeName() in WHOLE
    value, at = F.col(name).cast("long" if number else "string"), F.lit(0)
    for start, n in starts:
        if n:
            at = F.when(value >= F.lit(int(start, 16) - (1 << 63) if number else start), n).otherwise(at)
    return at


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of 2**bits cells a side.

    From the highest bit down each step mirrors or swaps the lower bits of the
    axes, a fold over the steps; then the bits are Gray-coded and interleaved.
    """
    n = len(cells)
    steps = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(n)]
    listed = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(axis).alias("axis")) for q, axis in steps])

    def step(x: Column, s: Column) -> Column:
        mine, first, low = F.get(x, s["axis"]), F.get(x, F.lit(0)), s["q"] - 1
        swapped = first.bitwiseXOR(mine).bitwiseAND(low)
        mirror = mine.bitwiseAND(s["q"]) != 0
        new_first, new_mine = first.bitwiseXOR(F.when(mirror, low).otherwise(swapped)), F.when(mirror, mine).otherwise(mine.bitwiseXOR(swapped))
        return F.transform(x, lambda v, i: F.when(i == 0, new_first).when(i == s["axis"], new_mine).otherwise(v))

    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluated once, however often it is used
    axes = F.array(*[c.cast("int") for c in cells])
    # Gray code over the axes: each axis is added to all behind it; a bit of the last one turns all lower bits of every axis
    gray = lambda x: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.aggregate(F.slice(x, F.lit(1), i), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    turns = F.array(*[F.lit(1 << b) for b in range(bits)])
    below = lambda last: F.aggregate(turns, F.lit(0), lambda a, bit: F.when(last.bitwiseAND(bit) != 0, a.bitwiseXOR(bit - 1)).otherwise(a))
    turn = lambda g: let(below(F.element_at(g, -1)), lambda t: F.transform(g, lambda v: v.bitwiseXOR(t)))
    digits = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(1 << b).alias("bit")) for b in range(bits - 1, -1, -1) for axis in range(n)])
    joined = lambda x: F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 2 + F.when(F.get(x, d["axis"]).bitwiseAND(d["bit"]) != 0, 1).otherwise(0))
    turned = F.aggregate(listed, axes, step) if steps else axes
    return let(let(let(turned, gray), turn), joined)


def shards(docs: DataFrame, carry: list[str], dimensions: tuple[str, ...] = DIMENSIONS, n_shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """The columns `carry` with size, text_crc32, curve, shard and slot, a row for each row of docs.

    size is the text's UTF-8 bytes plus 1 (NULL text: none, so 1), text_crc32
    the checksum of those bytes (of none for NULL).  Along the curve ties are
    ordered by checksum, size and doc_id, so equal texts of equal metadata lie
    side by side.  law `rows`: the line is cut so that shards' counts differ by one
    at most.  law `bytes`: a row goes where the middle of its bytes lies, so a
    shard's size is off its share by less than its two outer rows.  slot
    numbers a shard's rows along the curve from 0.  NULL metadata lies in the
    first cell, NULL doc_ids come first among ties, repeated rows get slots of
    their own, an empty table gives an empty one.  Texts are read once, as
    streams of rows, and leave the first task as size and checksum unless
    `carry` names them.  Further columns are left out, whatever their names.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}, not {law}")
    if bits * len(dimensions) > 62:
        raise ValueError("the curve has 62 bits at most")
    starts = borders(docs, dimensions, bits)
    text = F.coalesce(F.col("text"), F.lit(""))
    curve = hilbert([cell(docs, n, starts[n]) for n in dimensions], bits)
    measured = docs.select(F.struct(*carry).alias("row"), F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), curve.alias("curve"), F.monotonically_increasing_id().alias("nth"))
    rows = placed(cut(measured), ["curve", "crc", "size", "id", "nth"])
    if law == "bytes":
        rows = before(rows, "size")
        middle = (2 * F.col("size_before") + F.col("size")) * n_shards / (2 * F.col("size_total"))
        rows = rows.withColumn("shard", F.least(F.floor(middle), F.lit(n_shards - 1)).cast("int"))
        first = rows.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
        rows = rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first"))
    else:
        total = rows.agg(F.count("*").alias("total"))  # one row
        number = F.expr(f"cast(place * {n_shards} div total AS int)")
        # the first place p with p * n_shards >= shard * total
        rows = rows.crossJoin(F.broadcast(total)).withColumn("shard", number).withColumn("slot", F.col("place") - F.expr(f"(cast(shard AS bigint) * total + {n_shards - 1}) div {n_shards}"))
    return rows.select("row.*", "size", F.col("crc").alias("text_crc32"), "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS, n_shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> None:
    """Write docs' own columns as Parquet folders shard=0, 1, ..., each in its shard's order, replacing what is there.

    The sorted partitions are written as they are, so a shard has many files,
    each a stretch of the curve, and none of its rows is shuffled again.
    """
    numbered = shards(docs, docs.columns, dimensions, n_shards, law, bits)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    numbered.select(*own, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def spans(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """By shard: rows, and the least and greatest value of each dimension, which a reader skips shards by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(n).alias(f"{m}_{n}") for n in dimensions for m, f in (("least", F.min), ("greatest", F.max))])


def op11(docs: DataFrame) -> DataFrame:
    rows = shards(docs, ["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _curve_sql(dimensions: int, bits: int) -> str:
    """CTEs from cells(c0, c1, ...) to placed(c0, c1, ..., curve): the turns of the curve written out one by one."""
    names = [f"x{i}" for i in range(dimensions)]
    out, last = [f"t0 AS MATERIALIZED (SELECT DISTINCT {', '.join(f'c{i}' for i in range(dimensions))}, {', '.join(f'c{i} AS x{i}' for i in range(dimensions))} FROM cells)"], 0
    cells = ", ".join(f"c{i}" for i in range(dimensions))
    for bit in range(bits - 1, 0, -1):
        for axis in range(dimensions):
            q, low = 1 << bit, (1 << bit) - 1
            swap = f"(xor(x0, x{axis}) & {low})"
            new = {"x0": f"CASE WHEN x{axis} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"}
            if axis:
                new[f"x{axis}"] = f"CASE WHEN x{axis} & {q} <> 0 THEN x{axis} ELSE xor(x{axis}, {swap}) END"
            out.append(f"t{last + 1} AS MATERIALIZED (SELECT {cells}, {', '.join(f'{new.get(n, n)} AS {n}' for n in names)} FROM t{last})")
            last += 1
    sums = names[0]
    gray = [sums := names[0]] + [sums := f"xor({sums}, {n})" for n in names[1:]]
    out.append(f"g AS MATERIALIZED (SELECT {cells}, {', '.join(f'{e} AS {n}' for e, n in zip(gray, names, strict=True))} FROM t{last})")
    turn = "0"
    for bit in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN {names[-1]} & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    out.append(f"h AS MATERIALIZED (SELECT {cells}, {', '.join(f'xor({n}, {turn}) AS {n}' for n in names)} FROM g)")
    index = " + ".join(f"((({n} >> {bit}) & 1) << {bit * dimensions + dimensions - 1 - i})" for bit in range(bits) for i, n in enumerate(names))
    out.append(f"curved AS (SELECT {cells}, cast({index} AS bigint) AS curve FROM h)")
    return ",\n".join(out)


_VALUES = {"lang": "coalesce(lang, '')", "source": "coalesce(source, '')", "n_chars": "coalesce(n_chars, -9223372036854775808)"}
_CELLS = ",\n".join(
    f"v{i} AS (SELECT value, cast(before * {1 << BITS} // (SELECT count(*) FROM documents) AS int) AS cell FROM (SELECT value, sum(n) OVER (ORDER BY value) - n AS before FROM (SELECT {_VALUES[n]} AS value, count(*) AS n FROM documents GROUP BY 1)))"
    for i, n in enumerate(DIMENSIONS)
)
OP11_SQL = f"""WITH {_CELLS},
cells AS MATERIALIZED (SELECT doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 AS bigint) AS size, coalesce({crc32_sql("coalesce(text, '')")}, 0) AS text_crc32, v0.cell AS c0, v1.cell AS c1, v2.cell AS c2
  FROM documents JOIN v0 ON v0.value = {_VALUES["lang"]} JOIN v1 ON v1.value = {_VALUES["source"]} JOIN v2 ON v2.value = {_VALUES["n_chars"]}),
{_curve_sql(len(DIMENSIONS), BITS)},
lined AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id) - 1 AS place, count(*) OVER () AS total FROM cells JOIN curved USING (c0, c1, c2))
SELECT doc_id, size, text_crc32, 'rows' AS law, cast(place * {SHARDS} // total AS int) AS shard, place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS slot, cast(NULL AS int) AS grown_shard, curve FROM lined"""
