"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are pairs of neighbouring words. Each occurrence of a term votes, so a term's weight is its frequency: where its hash has a
one bit it adds one, elsewhere it takes one away, and the signs of the sums are the fingerprint. A fingerprint has 256 bits (four
64-bit hashes), written as 64 hex digits. Vote counters are packed: runs of 127 terms are counted in lanes of 8 bits, eight to a long, so
32 sums count 256 bits; the runs of a text are then summed in lanes of 32 bits.

Empty and null texts have no terms and get the fingerprint of all zeros; equal texts have equal fingerprints; a tie of votes gives 0.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, shuffle_width, text_or_empty
from .order import bounds_of, with_next

BITS = 256
_WORDS = tuple(f"w{k}" for k in range(BITS // 64))
_HASHES = tuple(f"h{k + 1}" for k in range(BITS // 64))
#: Terms of a run: so many fit a lane of 8 bits, and the uppermost lane leaves the sign alone.
_RUN = 127
_LANES = 0x0101010101010101
_PAIR = 0x000000FF000000FF
_LOW = 0xFFFFFFFF
#: Blocks of a fingerprint, each half a word.
_BLOCKS = BITS // 32
#: Bits in which near fingerprints may differ, and fingerprints of a chunk that is compared within one row. Texts that share four fifths of their
#: runs of five words were found 11 to 39 bits apart, nineteen in twenty of them within 31; unrelated ones are some 127 bits apart.
RADIUS, CHUNK = 31, 256
#: Crowded values that are broadcast; more are joined by a shuffle.
_FEW = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def term_hashes(words: Column) -> Column:
    """One 64-bit hash for each pair of neighbouring words, and one for the last word alone."""
    return F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(""))))


def _run_votes() -> list[Column]:
    """Sums of bits k, k + 8 .. k + 56 of each hash over one run, in the bytes of one long."""
    return [F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(_LANES))).alias(f"_{h}_{k}") for h in _HASHES for k in range(8)]


def _votes() -> list[Column]:
    """Sums of bits k and k + 32 of each hash over all runs, in the halves of one long."""
    return [F.sum(F.shiftrightunsigned(F.col(f"_{h}_{k % 8}"), k - k % 8).bitwiseAND(F.lit(_PAIR))).alias(f"_{h}{k}") for h in _HASHES for k in range(32)]


def _word(name: str, n: Column) -> Column:
    """Sixteen hex digits from the vote sums of one hash."""
    bits = []
    for k in range(32):
        both = F.coalesce(F.col(f"_{name}{k}"), F.lit(0).cast("long"))
        for at, votes in ((k, both.bitwiseAND(F.lit(_LOW))), (k + 32, F.shiftrightunsigned(both, 32))):
            bits.append(F.shiftleft((votes * 2 > n).cast("long"), at))
    return F.lpad(F.lower(F.hex(reduce(lambda a, b: a.bitwiseOR(b), bits))), 16, "0")


def fingerprints(df: DataFrame, columns: dict[str, str], partitioned_by: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint several text columns of each row; ``columns`` maps a text column to the name of its fingerprint.

    The texts are dropped from the result. Words are exploded and summed inside the task that has the row. Where ``df`` is partitioned
    by some columns, grouping by them as well saves the shuffle of the sums; else one row of sums moves for each text. Rows that repeat
    stay apart.
    """
    names = list(columns)
    others = [c for c in df.columns if c not in names]
    by = [*partitioned_by, "_row", "_kept"]
    row = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_kept", F.struct(*others))
    long = row.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), words_of(F.col(c)).alias("w")) for i, c in enumerate(names)])).alias("_text"))
    # The hashes stand in a column before they are exploded, so that the explosion and the sums are one piece of generated code.
    hashed = long.select(*by, F.col("_text.i").alias("_i"), term_hashes(F.col("_text.w")).alias("_terms"))
    terms = hashed.select(*by, "_i", F.posexplode_outer("_terms").alias("_at", "h1"))
    more = {h: F.when(F.col("h1").isNotNull(), F.xxhash64(F.col("h1"), F.lit(k))) for k, h in enumerate(_HASHES[1:])}
    runs = terms.withColumns(more).groupBy(*by, "_i", F.expr(f"_at div {_RUN}").alias("_run")).agg(F.count("h1").alias("_n"), *_run_votes())
    votes = runs.groupBy(*by, "_i").agg(F.sum("_n").alias("_n"), *_votes())
    printed = votes.select(*by, "_i", F.concat(*[_word(h, F.col("_n")) for h in _HASHES]).alias("_print"))
    wide = printed.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_print"))).alias(columns[c]) for i, c in enumerate(names)])
    return wide.select("_kept.*", *[columns[c] for c in names])


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return reduce(lambda x, y: x + y, [F.bit_count(_long(a, k).bitwiseXOR(_long(b, k))) for k in range(BITS // 64)])


def _long(print_: Column, k: int) -> Column:
    """Word ``k`` of a fingerprint as a long."""
    part = lambda at: F.conv(F.substring(print_, at, 8), 16, 10).cast("long")
    return F.shiftleft(part(1 + 16 * k), 32).bitwiseOR(part(9 + 16 * k))


def _tables(radius: int) -> list[tuple[int, int, int]]:
    """Tables that two fingerprints within the radius cannot all miss: (block, mask of its bits that lead the table, mask of the first piece of these).

    Of eight blocks one differs in at most t = radius div 8 bits. It is cut into t + 3 pieces, of which at least three don't differ, so
    each choice of three pieces leads one table: 8 tables of 32 bits up to a radius of 7, 80 of some 19 bits to 23, 160 of 16 bits to 31.
    """
    if not 0 <= radius < 64:
        raise ValueError(f"radius must be below 64 of {BITS} bits: beyond it tables have so few bits that nearly all fingerprints share one")
    size = BITS // _BLOCKS
    n = radius // _BLOCKS + 3
    edges = [k * size // n for k in range(n + 1)]
    pieces = [(1 << b) - (1 << a) for a, b in pairwise(edges)]
    return [(block, sum(three), three[0]) for block in range(_BLOCKS) for three in combinations(pieces, 3)]


def _block(word: Column, block: int) -> Column:
    """The upper half of a word for an even block, the lower half for an odd one."""
    return F.shiftrightunsigned(word, 32 * (1 - block % 2)).bitwiseAND(F.lit(_LOW))


def _printed(words: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def _met(chunks: DataFrame, tables: list[tuple[int, int, int]], radius: int) -> DataFrame:
    """(x, y) of the fingerprints within the radius of those in the arrays ``a`` and ``b`` of a row, which are the same array where ``same``; each pair in the first ``table`` that it shares.

    The arrays are exploded and compared in one piece of generated code; only near pairs come out of it.
    """
    # A table's mask within its word, signed as longs are.
    masks = [(block // 2, mask << 32 * (1 - block % 2)) for block, mask, _ in tables]
    listed = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for w, m in masks])
    differ = [F.col("x")[w].bitwiseXOR(F.col("y")[w]) for w in _WORDS]
    bits = reduce(lambda at, d: at + d, [F.bit_count(d) for d in differ])
    of = lambda k: reduce(lambda rest, w: F.when(k == w, differ[w]).otherwise(rest), range(len(_WORDS) - 1), differ[-1])
    earlier = F.exists(F.slice(listed, F.lit(1), F.col("table")), lambda t: of(t["word"]).bitwiseAND(t["mask"]) == 0)
    pairs = chunks.select("table", "same", "b", F.posexplode("a").alias("i", "x")).select("table", "same", "i", "x", F.posexplode("b").alias("j", "y"))
    return pairs.where((~F.col("same") | (F.col("j") > F.col("i"))) & (bits <= radius)).where(~earlier).select("x", "y")


def near_fingerprints(prints: DataFrame, column: str, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """How many other fingerprints lie within ``radius`` bits of each different one: p, copies, n_near, near_rows, least.

    ``copies`` counts the rows that have the fingerprint, ``n_near`` the other fingerprints within the radius, ``near_rows`` the rows that have those, and
    ``least`` is the smallest fingerprint within the radius, itself included. Null fingerprints are left out, an empty table gives no rows; a radius of 64 or more is an error.

    Permuted block tables (``_tables``): each is led by some of the bits, and fingerprints that meet in it are compared in full. A pair
    counts in the first table that it shares. Copies are one row. A fingerprint is sent once for all tables of a block that begin with the same piece, to the
    task of that piece's bits, which has these tables to itself. A table's value that more than ``chunk`` fingerprints share is cut into chunks,
    which are gathered as arrays and compared in pairs of chunks inside one row, so only near pairs are rows and no task holds a whole group.
    """
    tables = _tables(radius)
    width = shuffle_width(prints.sparkSession)
    base = cut(prints.select(F.col(column).alias("p")).where(F.col("p").isNotNull()).groupBy("p").agg(F.count(F.lit(1)).alias("copies")))
    # With the sign turned round words are ordered as their digits are.
    turned = lambda w: w.bitwiseXOR(F.lit(-(1 << 63)))
    worded = base.select(F.struct(*[turned(_long(F.col("p"), k)).alias(w) for k, w in enumerate(_WORDS)], "copies").alias("x"))
    block_of = lambda block: _block(F.col("x")[_WORDS[block // 2]], block)
    routes = list(dict.fromkeys((block, first) for block, _, first in tables))
    led = [F.array(*[F.struct(F.lit(at).alias("at"), F.lit(mask).alias("mask")) for at, (block, mask, first) in enumerate(tables) if (block, first) == route]) for route in routes]
    sent = worded.select("x", F.posexplode(F.array(*[block_of(block).bitwiseAND(F.lit(first)) for block, first in routes])).alias("route", "lead")).repartition(width, "route", "lead")
    of_route = F.get(F.array(*[block_of(block) for block in range(_BLOCKS)]), F.get(F.array(*[F.lit(block) for block, _ in routes]), F.col("route")))
    rows = sent.select("x", "route", "lead", of_route.alias("bits"), F.explode(F.get(F.array(*led), F.col("route"))).alias("t"))
    keys = ["value", "table", "route", "lead"]
    rows = rows.select(F.col("bits").bitwiseAND(F.col("t.mask")).alias("value"), F.col("t.at").alias("table"), "route", "lead", "x")
    crowded = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > chunk))
    some = crowded.count()
    known = F.broadcast(crowded) if some <= _FEW else crowded
    few = rows.join(known.select(*keys), keys, "left_anti") if some else rows
    held = few.groupBy(*keys).agg(F.collect_list("x").alias("a")).where(F.size("a") > 1)
    met = _met(held.select("table", "a", F.col("a").alias("b"), F.lit(True).alias("same")), tables, radius)
    if some:
        dealt = rows.join(known, keys).withColumn("parts", F.ceil(F.col("size") / chunk).cast("int")).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
        parts = dealt.repartition(width, "table", "value", "part").groupBy("table", "value", "parts", "part").agg(F.collect_list("x").alias("held"))
        pair = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = pair.select("table", "value", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("second"), "held")
        both = pair.groupBy("table", "value", "i", "j").agg(F.first(F.when(~F.col("second"), F.col("held")), ignorenulls=True).alias("a"), F.first(F.when(F.col("second"), F.col("held")), ignorenulls=True).alias("b"))
        same = F.col("i") == F.col("j")
        both = both.select("table", "a", F.when(same, F.col("a")).otherwise(F.col("b")).alias("b"), same.alias("same")).where("a is not null and b is not null")
        met = met.unionByName(_met(both, tables, radius))
    ways = met.select(F.explode(F.array(F.struct(F.col("x").alias("own"), F.col("y").alias("other")), F.struct(F.col("y").alias("own"), F.col("x").alias("other")))).alias("s")).select("s.*")
    found = ways.groupBy(*[F.col("own")[w].alias(w) for w in _WORDS]).agg(F.count(F.lit(1)).alias("n_near"), F.sum("other.copies").alias("near_rows"), F.min("other").alias("o"))
    digits = lambda of: _printed([turned(of(w)) for w in _WORDS])
    found = found.select(digits(F.col).alias("p"), "n_near", "near_rows", digits(lambda w: F.col("o")[w]).alias("least"))
    out = base.join(found, "p", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("p", "copies", zero("n_near"), zero("near_rows"), F.coalesce(F.least("p", "least"), "p").alias("least"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Edited text: the last floor(n / 2) code points give way to the first as many of the next document by descending id (rows with
    the same id by text; null ids last; after the last the first). A table of one row is followed by itself; an empty one gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    bounds = bounds_of(base, "doc_id")
    followed = with_next(base, "doc_id", ["_text"], "_text", "_next", bounds, keep_range=True, rank="_at")
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = followed.select("_range", "doc_id", "_at", n.cast("long").alias("n_chars"), "_text", F.concat(F.expr("left(_text, char_length(_text) - cast(floor(char_length(_text) / 2) as int))"), F.substring("_next", F.lit(1), half)).alias("_edited"))
    hashed = edited.withColumn("_sha", F.unhex(F.sha2(F.col("_edited").cast("binary"), 256)))
    found = fingerprints(hashed, {"_text": "fingerprint", "_edited": "edited_fingerprint"}, ("_range",)).drop("_range")
    # Rows with the same id stand here as they stood there, so that both likenesses are to the same next document.
    out = with_next(found, "doc_id", ["_at"], "fingerprint", "_next_print", bounds)
    alike = lambda x: 1 - distance(F.col("fingerprint"), F.col(x)) / BITS
    return out.select("doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", alike("edited_fingerprint").cast("double").alias("near_edited"), alike("_next_print").cast("double").alias("near_next"))
