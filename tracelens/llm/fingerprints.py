"""Operator 1: document fingerprints as invertible Bloom lookup tables, in native SQL functions.

A text is cut into paragraphs: its lines, long lines cut after the last sentence end within
PARAGRAPH characters (or there); texts of up to SHORT characters are cut into words. The
fingerprint is a table of 3 x CELLS cells over the set of paragraph digests; a cell holds
how many digests fell into it, their XOR and the XOR of their check sums. Subtracting two
tables cancels what both texts hold, and peeling recovers the digests that differ: a cell
with a single digest gives it away and takes it out of its other cells.

Where a table is too small for a difference, peeling fails. The digests are then dealt by
hash into stripes, each stripe is subtracted and peeled for itself, and a stripe that fails
is retried with cells doubled. Only the documents' own digests take part; no text is
compared. Likeness is 1 - differing digests / all digests (Dice).

Null texts count as empty; two empty texts are alike (1). Equal texts have equal
fingerprints, whose head (paragraphs, digest of the whole text) sets apart texts that
differ only between paragraphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = 160
SHORT = 256
CELLS = 8
#: Digests of both texts that a stripe holds on average.
STRIPE = 12
ROUNDS = 16
#: Sizes tried for a stripe: CELLS << 0 .. CELLS << RETRIES - 1 in each third.
RETRIES = 7
#: Documents are laid out in runs of this many ids (as a power of two).
RUN_BITS = 6
GROUP_BITS = 14

CELL = "struct<n:bigint,x:bigint,c:bigint>"
ITEM = "struct<x:bigint,n:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """Set of the 64-bit paragraph digests of a text."""
    cut = F.regexp_extract_all(text, F.lit(rf"[^\n]{{0,{PARAGRAPH - 1}}}[.!?](?=\s|$)|[^\n]{{1,{PARAGRAPH}}}"), 0)
    words = F.regexp_extract_all(text, F.lit(r"\S+"), 0)
    return F.array_distinct(F.transform(F.when(F.length(text) <= SHORT, words).otherwise(cut), lambda u: F.xxhash64(u)))


def check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(-1))


def place(x: Column, third: int, salt: Column, cells: Column) -> Column:
    """The digest's cell within a third of the table."""
    return F.pmod(F.shiftright(F.xxhash64(x, salt), 20 * third), cells)


def xor_all(xs: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(of(x)))


def build(xs: Column, salt: Column, cells: Column) -> Column:
    """Table of 3 x ``cells`` cells (n, x, c) over digests."""

    def cell(inside: Column) -> Column:
        return let(inside, lambda z: F.struct(F.size(z).cast("bigint").alias("n"), xor_all(z).alias("x"), xor_all(z, check).alias("c")))

    def part(third: int) -> Column:
        return let(F.transform(xs, lambda x: place(x, third, salt, cells)), lambda at: F.transform(
            F.sequence(F.lit(0).cast("bigint"), cells - 1), lambda i: cell(F.filter(xs, lambda x, j: F.get(at, j) == i))))

    return F.concat(*map(part, range(3)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct(
        (p["n"] - q["n"]).alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["c"].bitwiseXOR(q["c"]).alias("c")))


def peel(table: Column, salt: Column, cells: Column) -> Column:
    """Struct (done, got): digests of a difference table with +1 (first text only) or -1."""
    start = F.struct(table.alias("cells"), F.array().cast(f"array<{ITEM}>").alias("got"), F.lit(False).alias("stuck"))

    def step(s: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == check(c["x"]))), lambda c: F.struct(c["x"].alias("x"), c["n"].alias("n"))))

        def without(ps: Column) -> Column:
            placed = F.transform(ps, lambda p: F.struct(
                p["x"].alias("x"), p["n"].alias("n"), *((place(p["x"], t, salt, cells) + t * cells).alias(f"at{t}") for t in range(3))))

            def cell(c: Column, inside: Column) -> Column:
                return F.when(F.size(inside) == 0, c).otherwise(F.struct(
                    (c["n"] - F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])).alias("n"),
                    c["x"].bitwiseXOR(xor_all(inside, lambda p: p["x"])).alias("x"),
                    c["c"].bitwiseXOR(xor_all(inside, lambda p: check(p["x"]))).alias("c")))

            def at(items: Column, i: Column) -> Column:
                return F.filter(items, lambda p: (p["at0"] == i) | (p["at1"] == i) | (p["at2"] == i))

            left = let(placed, lambda items: F.transform(s["cells"], lambda c, i: let(at(items, i.cast("bigint")), lambda z: cell(c, z))))
            out = F.struct(left.alias("cells"), F.concat(s["got"], ps).alias("got"), F.lit(False).alias("stuck"))
            return F.when(F.size(ps) == 0, F.struct(s["cells"].alias("cells"), s["got"].alias("got"), F.lit(True).alias("stuck"))).otherwise(out)

        return let(pure, without)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["stuck"], s).otherwise(step(s)))
    return let(end, lambda e: F.struct((~F.exists(e["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0))).alias("done"), e["got"].alias("got")))


def same_salt() -> Column:
    return F.lit(0)


def differing(xs: Column, ys: Column) -> Column:
    """Digests of one side only, as +1 / -1 items: a stripe's tables, larger until they peel."""
    start = F.struct(F.lit(False).alias("done"), F.array().cast(f"array<{ITEM}>").alias("got"))

    def attempt(s: Column, cells: Column) -> Column:
        return F.when(s["done"], s).otherwise(peel(subtract(build(xs, cells, cells), build(ys, cells, cells)), cells, cells))

    sizes = F.array(*(F.lit(CELLS << i).cast("bigint") for i in range(RETRIES)))
    end = F.aggregate(sizes, start, attempt)
    plain = F.concat(
        F.transform(F.array_except(xs, ys), lambda x: F.struct(x.alias("x"), F.lit(1).cast("bigint").alias("n"))),
        F.transform(F.array_except(ys, xs), lambda x: F.struct(x.alias("x"), F.lit(-1).cast("bigint").alias("n"))))
    return let(end, lambda e: F.when(e["done"], e["got"]).otherwise(plain))


def striped(xs: Column, ys: Column) -> Column:
    """Differing digests, stripe by stripe; stripes are cut in two steps, so that the work
    grows with digests times the root of their number."""
    number = F.greatest(F.lit(1.0), (F.size(xs) + F.size(ys)) / F.lit(float(STRIPE)))

    def part(zs: Column, seed: int, of: Column, i: Column) -> Column:
        return F.filter(zs, lambda x: F.pmod(F.xxhash64(x, F.lit(seed)), of) == i)

    def parts(a: Column, b: Column, seed: int, of: Column, body: Callable[[Column, Column], Column]) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), of - 1), lambda i: let(
            F.struct(part(a, seed, of, i).alias("a"), part(b, seed, of, i).alias("b")), lambda q: body(q["a"], q["b"]))))

    rows = F.ceil(F.sqrt(number)).cast("bigint")
    size = F.struct(rows.alias("rows"), F.ceil(number / rows).cast("bigint").alias("columns"))
    return let(size, lambda n: parts(xs, ys, -2, n["rows"], lambda a, b: parts(a, b, -3, n["columns"], differing)))


def difference(xs: Column, xt: Column, ys: Column, yt: Column) -> Column:
    """Differing digests of two texts, given their digests and tables."""
    first = peel(subtract(xt, yt), same_salt(), F.lit(CELLS).cast("bigint"))
    return let(first, lambda f: F.when(f["done"], f["got"]).otherwise(striped(xs, ys)))


def likeness(xs: Column, xt: Column, ys: Column, yt: Column) -> Column:
    total = F.size(xs) + F.size(ys)
    return F.when(total == 0, 1.0).otherwise(1.0 - F.size(difference(xs, xt, ys, yt)) / F.greatest(total, F.lit(1)))


def printed(text: Column, xs: Column, table: Column) -> Column:
    """The fingerprint as text: number of paragraphs, digest of the whole, then the cells."""
    cells = F.transform(table, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["x"]), F.hex(c["c"])))
    return F.concat_ws(":", F.size(xs).cast("string"), F.hex(F.xxhash64(text)), F.concat_ws(",", cells))


def with_next(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, t, next): every document with the text of the next larger id, the last with that
    of the first. Equal ids follow one another by text; a null id comes before all others.

    Ids are laid out in runs of 2 ** RUN_BITS, a window looks ahead within a run, and the
    first text of each run is handed to the run before: a run is never longer than the rows
    of its ids, whatever the sizes of sources or groups of copies."""
    low = -(1 << 63)
    rows = docs.select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
        F.coalesce(F.shiftright(F.col(key).cast("bigint"), RUN_BITS), F.lit(low)).alias("run"),
    )
    ahead = Window.partitionBy("run").orderBy(F.col("id").asc_nulls_first(), "t")
    rows = rows.select("run", "id", "t", F.lead("t").over(ahead).alias("next"), F.lag(F.lit(True)).over(ahead).isNull().alias("first"))

    runs = rows.select("run").distinct().withColumn("part", F.shiftright("run", GROUP_BITS))
    parts = runs.groupBy("part").agg(F.min("run").alias("first"))  # one row for 2 ** 20 ids
    after = parts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())).alias("beyond"))
    order = runs.join(after, "part").select(
        "run", F.coalesce(F.lead("run").over(Window.partitionBy("part").orderBy("run")), F.col("beyond")).alias("run_after"))
    heads = (
        rows.where("first").select(F.col("run").alias("run_after"), F.col("t").alias("head"))
        .join(order, "run_after").select("run", "head")
    )
    return rows.join(heads, "run").select("id", "t", F.coalesce("next", "head").alias("next"))


def edited(text: Column, follower: Column) -> Column:
    """The text with its last quarter replaced by the beginning of another."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(follower, F.lit(1), quarter))


def compare(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, its text ``t`` and edited text ``e``, both fingerprints, the
    likeness to the edited and to the next text, and the digests that the edit took away."""
    cells = F.lit(CELLS).cast("bigint")
    out = with_next(docs, text, key).withColumn("e", edited(F.col("t"), F.col("next")))
    out = out.withColumns({f"{n}_xs": digests(F.col(n)) for n in ("t", "e", "next")})
    out = out.withColumns({f"{n}_table": build(F.col(f"{n}_xs"), same_salt(), cells) for n in ("t", "e", "next")})
    side = lambda n: (F.col(f"{n}_xs"), F.col(f"{n}_table"))
    return out.select(
        F.col("id").alias(key), "t", "e",
        printed(F.col("t"), *side("t")).alias("fingerprint"), printed(F.col("e"), *side("e")).alias("edited_fingerprint"),
        likeness(*side("t"), *side("e")).alias("near_edited"), likeness(*side("t"), *side("next")).alias("near_next"),
    )
