"""Line dedup: exact copies by hash, near copies by a segment-partition join with edit distance.

A line is split into ``MAX_EDITS + 1`` segments whose places follow from its length class: a head, a middle
and a tail. Of two lines within two edits, one has its head, its tail or (moved by at most one place, one edit
on either side) its middle in common with the other. Lines that share such a piece are compared, first by
counts of letters, then by edit distance with bit vectors over the diagonal band. Where very many lines share a piece,
what is left of them without it is split into segments in turn, as that is within as many edits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import cut_lineage, lookup, shuffle_partitions, table
from spanweave.llm.graph import components

MAX_EDITS = 2
#: By default, lines of fewer characters are never removed; nor, unless they are exact copies, those of fewer than MIN_NEAR.
MIN_EXACT, MIN_NEAR = 10, 40
#: Lengths are rounded down to this for the places of segments. Shorter lines have none, so this is the least for near copies.
LENGTH_CLASS = 16
#: What is left of a line without a common piece is split by finer classes of length.
REST_CLASS = 4
#: A piece of more lines than this is a common one, whose lines must share a further piece.
COMMON = 1000
#: A set of at most so many line hashes (8 bytes each) is broadcast; with a larger one the lines are shuffled.
BROADCAST_HASHES = 1_000_000
#: Letters that are counted (modulo 32) to compare lines cheaply; any would do.
LETTERS = ("etaoinhrsdlu", "mcfgpwbyvk q")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(line: Column, n: Column, base: Column, shifts: tuple[int, ...], within: Column | None = None) -> list[Column]:
    """Hashes of the head, the tail and the middle (at each of ``shifts``) of a line, for a length class; ``within`` is hashed with them."""
    edge = F.floor(base / 3).cast("int")
    pieces = [("h", F.substr(line, F.lit(1), edge)), ("t", F.substr(line, n - edge + 1, edge))]
    pieces += [("m", F.substr(line, edge + 1 + shift, base - 2 * edge)) for shift in shifts]
    more = [] if within is None else [within]
    return [F.xxhash64(*more, F.lit(tag), base, piece) for tag, piece in pieces]


#: Where the middle of a line may lie in another one.
SHIFTS = (0, -1, 1)


def _bases(n: Column, size: int) -> tuple[Column, Column]:
    """A line's length class, and that of lines that are ``MAX_EDITS`` shorter."""
    return n - n % size, F.greatest(n - MAX_EDITS - (n - MAX_EDITS) % size, F.lit(0))


def _keys(line: Column, n: Column, size: int, within: Column | None = None) -> Column:
    """The keys by which a line meets others; the first three are its own class's, by which it is found."""
    base, lower = _bases(n, size)
    below = F.when(lower != base, F.array(*segments(line, n, lower, SHIFTS, within))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(*segments(line, n, base, SHIFTS, within)), below)


def _rest(line: Column, n: Column, place: Column, size: int) -> Column:
    """What is left of a line without the piece at a place of ``_keys``."""
    per = 2 + len(SHIFTS)
    base, lower = _bases(n, size)
    base = F.when(place < per, base).otherwise(lower)

    def rest(x: Column) -> Column:
        edge, kind = x["edge"], x["kind"]
        at = edge + F.get(F.array(*map(F.lit, SHIFTS)), kind - 2)
        middle = F.concat(F.substr(line, F.lit(1), at), F.substr(line, at + x["base"] - 2 * edge + 1, n))
        return F.when(kind == 0, F.substr(line, edge + 1, n)).when(kind == 1, F.substr(line, F.lit(1), n - edge)).otherwise(middle)

    return _let(_let(base, lambda b: F.struct(b.alias("base"), F.floor(b / 3).cast("int").alias("edge"), (place % per).alias("kind"))), rest)


def letter_counts(line: Column, n: Column) -> Column:
    """Counts of letters, five bits each, and the length in the four bits above: an array with a number for each group of letters."""
    signs = []
    for group in LETTERS:
        sign = F.shiftleft(F.pmod(n, F.lit(16)).cast("long"), 60)
        for i, letter in enumerate(group):
            count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
            sign = sign.bitwiseOR(F.shiftleft(F.pmod(count, F.lit(32)).cast("long"), 5 * i))
        signs.append(sign)
    return F.array(*signs)


def counts_near(a: list[Column], b: list[Column], edits: int = MAX_EDITS) -> Column:
    """Whether lines with these counts can be within ``edits``: no two such lines are told apart.

    A replacement changes two counts by one, an insertion or deletion one count and the length.
    """
    longer = F.abs(F.shiftrightunsigned(a[0], 60) - F.shiftrightunsigned(b[0], 60))
    longer = F.least(longer, 16 - longer)
    total = F.lit(0).cast("long")
    for x, y, group in zip(a, b, LETTERS, strict=True):
        for i in range(len(group)):
            d = F.abs(F.shiftright(x, 5 * i).bitwiseAND(F.lit(31)) - F.shiftright(y, 5 * i).bitwiseAND(F.lit(31)))
            total = total + F.least(d, 32 - d)
    return (longer <= edits) & (total <= 2 * edits - longer)


def without_common_ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Takes what two texts have in common at the end, then at the start, off both; that leaves their edit distance as it is."""
    for _ in range(2):
        pairs = pairs.withColumns({a: F.reverse(a), b: F.reverse(b)}).withColumn("__n", F.least(F.length(a), F.length(b))).withColumn("__p", F.lit(0))
        for size in (1 << k for k in range(14, -1, -1)):
            alike = F.substr(a, F.col("__p") + 1, F.lit(size)) == F.substr(b, F.col("__p") + 1, F.lit(size))
            pairs = pairs.withColumn("__p", F.when((F.col("__p") + size <= F.col("__n")) & alike, F.col("__p") + size).otherwise(F.col("__p")))
        pairs = pairs.withColumns({a: F.substr(a, F.col("__p") + 1), b: F.substr(b, F.col("__p") + 1)})
    return pairs.drop("__n", "__p")


def within_edits(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Whether two texts are within ``edits`` insertions, deletions and replacements of code points.

    A bit-parallel edit distance over the band of diagonals: bit d of a column's vectors stands for the row
    ``column - edits + d``. The last diagonal's value is followed down to the last row, then along that row.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def last_value(rows: Column) -> Column:
        def equal_bits(char: Column, j: Column) -> Column:
            """``j``: the column, from 0. Bits of the rows (from 0) j - edits .. j + edits that have this character."""
            bits = F.lit(0)
            for d in range(width):
                i = j - edits + d
                bits = bits + F.when((i >= 0) & (F.get(rows, i) == char), 1 << d).otherwise(0)
            return F.struct(bits.alias("eq"), (F.size(rows) - j - 1 + edits).alias("row"))

        def step(acc: Column, x: Column) -> Column:
            eq, vp, vn = x["eq"], acc["vp"], acc["vn"]
            diagonal = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask))

            def after(d0: Column) -> Column:
                def both(up: Column) -> Column:
                    down, lower = d0.bitwiseAND(vp), F.shiftright(d0, 1)
                    row = x["row"]  # the last row's bit in this column
                    gone = F.when(row >= 2 * edits, 1 - F.shiftright(d0, 2 * edits)).otherwise(_bit(up, row) - _bit(down, row))
                    return F.struct(
                        down.bitwiseOR(F.bitwise_not(lower.bitwiseOR(up))).bitwiseAND(F.lit(mask)).alias("vp"),
                        lower.bitwiseAND(up).alias("vn"),
                        (acc["dist"] + gone).alias("dist"),
                    )

                return _let(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask)), both)

            return _let(diagonal, after)

        start = F.struct(F.lit(mask ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(edits), F.size(rows)).alias("dist"))
        return F.aggregate(F.transform(F.split(b, ""), equal_bits), start, step)["dist"]

    def chars(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))

    value = F.when(b == "", F.length(a)).otherwise(_let(chars(a), last_value))
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, value <= edits).otherwise(False)


def _bit(bits: Column, at: Column) -> Column:
    return F.call_function("shiftright", bits, F.greatest(at, F.lit(0))).bitwiseAND(F.lit(1))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, version, line_no, line, h, n`` for each line with a word."""
    split = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line")).withColumn("n", F.length("line"))


def _shared(keyed: DataFrame) -> DataFrame:
    """``h, key, place, common`` of the ``keys`` of ``h`` that another line has too, on either side as one that it is found by.

    ``common``: whether more than ``COMMON`` rows have the key.
    """
    pieces = keyed.select(*keyed.columns[:-1], F.posexplode("keys").alias("place", "key"))  # the first three are the index, all are looked up
    met = pieces.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("place").alias("first"), F.count("*").alias("m")).filter("lo <> hi and first < 3")
    return pieces.join(met.select("key", (F.col("m") > COMMON).alias("common")), "key")


def _candidates(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of lines that share a key and whose counts of letters are near."""
    signs = range(len(LETTERS))
    counted = pieces.select("h", "key", (F.col("place") < 3).alias("indexed")).join(texts.select("h", *[F.col("c")[i].alias(f"c{i}") for i in signs]), "h")
    index = counted.filter("indexed").select(F.col("h").alias("a"), *[F.col(f"c{i}").alias(f"ca{i}") for i in signs], "key")
    probe = counted.select(F.col("h").alias("b"), *[F.col(f"c{i}").alias(f"cb{i}") for i in signs], "key")
    on = (index["key"] == probe["key"]) & (F.col("a") != F.col("b")) & counts_near([F.col(f"ca{i}") for i in signs], [F.col(f"cb{i}") for i in signs])
    return index.join(probe, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_lines(lines: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """Pairs ``a, b`` (a < b) of hashes of different lines within ``MAX_EDITS`` edits, both of ``min_near`` characters or more.

    Few lines share a piece with another line; letters are counted, and texts are fetched, for those only. Lines that share a common
    piece (a licence's first words, a log's prefix) are not compared with each other: without the piece they are within as many
    edits, so what is left of them is split again, and again, until pieces are rare or too short to be split. No pair is lost.
    """
    if min_near < LENGTH_CLASS + MAX_EDITS:
        raise ValueError(f"lines of fewer than {LENGTH_CLASS + MAX_EDITS} characters have no segments to meet by")
    long = lines.select("h", "line", "n").filter(F.col("n") >= min_near)
    keyed = long.select("h", _keys(F.col("line"), F.col("n"), LENGTH_CLASS).alias("keys"))
    keyed = keyed.groupBy("h").agg(F.first("keys").alias("keys"))  # one row for all copies, made before the shuffle
    pieces = cut_lineage(_shared(keyed))

    wanted = pieces.select("h").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_HASHES else wanted
    texts = long.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    texts = cut_lineage(texts.select("h", "line", letter_counts(F.col("line"), F.length("line")).alias("c")))

    pairs = _candidates(pieces.filter("not common"), texts)
    left = pieces.filter("common").join(texts.select("h", "line"), "h").withColumn("n", F.length("line"))
    size = LENGTH_CLASS
    while left.limit(1).count():
        rests = left.select("h", F.col("key").alias("within"), _rest(F.col("line"), F.col("n"), F.col("place"), size).alias("line")).distinct().withColumn("n", F.length("line"))
        size = REST_CLASS
        pieces = cut_lineage(_shared(rests.withColumn("keys", _keys(F.col("line"), F.col("n"), size, F.col("within")))))
        base, lower = _bases(F.col("n"), size)
        empty = F.when(F.col("place") < 2 + len(SHIFTS), base).otherwise(lower) == 0  # nothing to take off
        pairs = pairs.union(_candidates(pieces.filter(~F.col("common") | empty), texts))
        left = pieces.filter(F.col("common") & ~empty)
    pairs = cut_lineage(pairs.distinct())
    texts = texts.drop("c")
    both = pairs.join(texts.withColumnsRenamed({"h": "a", "line": "la"}), "a").join(texts.withColumnsRenamed({"h": "b", "line": "lb"}), "b")
    both = without_common_ends(both.repartition(shuffle_partitions(both)), "la", "lb")
    # Written before it is filtered: a filter would be pushed through all those projections, and grow with each.
    return cut_lineage(both.select("a", "b", within_edits(F.col("la"), F.col("lb")).alias("near"))).filter("near").select("a", "b")


def line_classes(docs: DataFrame, min_exact: int = MIN_EXACT, min_near: int = MIN_NEAR) -> DataFrame:
    """One row for each line with a word: its class, whether it stays, and how many other lines its text links to.

    Columns ``doc_id, version, line_no, h, n_links, near, kept``. Equal lines of ``min_exact`` characters or more
    and lines that link, over any number of links, are one class; its first line by doc_id (null last) and line
    number stays, the others go (``near``: the one that stays is another text). Rows with the same doc_id
    and text are one document. ``version`` is a hash of the text. Lines count as equal if their 64-bit hashes are.
    """
    lines = _lines(docs)
    found = cut_lineage(lines.select("doc_id", "version", "line_no", "h", "n"))
    pairs = near_lines(lines, min_near)
    degree = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("n_links"))
    near = components(pairs).join(degree, F.col("node") == F.col("h")).select(F.col("node").alias("x"), "root", "n_links")

    # A place in the order of lines as one number, so that its minimum is combined before the shuffle.
    whole = "decimal(38,0)"
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast(whole) * F.lit(1 << 31).cast(whole) + F.col("line_no")
    long = found.filter(F.col("n") >= min_exact).withColumn("own", order.cast(whole))
    firsts = long.groupBy("h").agg(F.min("own").alias("at")).join(near, F.col("h") == F.col("x"), "left")
    firsts = cut_lineage(firsts.select("h", "at", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    chained = firsts.filter("root is not null")
    best = cut_lineage(chained.groupBy("root").agg(F.min("at").alias("best")))
    chained = lookup(chained, best, "root", "inner").select("h", "at", "best", "n_links")
    plain = firsts.filter("root is null").select("h", "at", F.col("at").alias("best"), "n_links")
    joined = lookup(long.select("doc_id", "version", "line_no", "h", "own"), plain.union(chained), "h", "inner")  # a line may be very common
    kept = F.col("own") == F.col("best")
    rest = found.filter(F.col("n") < min_exact).select("doc_id", "version", "line_no", "h", F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("near"), F.lit(True).alias("kept"))
    return joined.select("doc_id", "version", "line_no", "h", "n_links", (~kept & (F.col("at") != F.col("best"))).alias("near"), kept.alias("kept")).union(rest)


def dedup_rows(docs: DataFrame, min_exact: int = MIN_EXACT, min_near: int = MIN_NEAR) -> DataFrame:
    """``row`` (a struct of all columns of a document), ``text`` (without the lines that go) and ``counts`` (as ``line_dedup`` of ``dedup_lines``)."""
    marks = F.struct("line_no", "kept", "near", "n_links")
    flags = line_classes(docs, min_exact, min_near).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(marks)).alias("m"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), "text", F.xxhash64("text").alias("w"))
    both = rows.join(flags, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("w") == F.col("version")), "left")
    both = both.select("row", "text", F.coalesce("m", F.array().cast("array<struct<line_no:int,kept:boolean,near:boolean,n_links:bigint>>")).alias("m"))
    both = both.withColumn("gone", F.transform(F.filter("m", lambda m: ~m["kept"]), lambda m: m["line_no"]))
    lines = F.split("text", "\n")
    cut = F.array_join(F.transform(F.array_except(F.transform(lines, lambda x, i: i), F.col("gone")), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.size("gone") > 0, cut).otherwise(F.col("text"))
    near = F.size(F.filter("m", lambda m: m["near"]))
    links = F.aggregate("m", F.lit(0).cast("long"), lambda a, m: a + m["n_links"])
    counts = F.struct(F.size("m").cast("long").alias("n_lines"), (F.size("gone") - near).cast("long").alias("n_exact"), near.cast("long").alias("n_near"), links.alias("n_links"))
    return both.select("row", text.alias("text"), counts.alias("counts"))


def dedup_lines(docs: DataFrame, min_exact: int = MIN_EXACT, min_near: int = MIN_NEAR) -> DataFrame:
    """The documents without lines that repeat or nearly repeat an earlier line of any document.

    Lines of ``min_exact`` characters or more go if they are equal to an earlier one, those of ``min_near`` (at least
    ``LENGTH_CLASS + MAX_EDITS``) or more also if they are within ``MAX_EDITS`` edits of one.

    Uses ``doc_id, text``; all columns of ``docs`` come back, with the new ``text``, and a struct column
    ``line_dedup`` (n_lines, n_exact, n_near, n_links), which takes the place of a column of that name. Lines without a word
    stay where they are. Null and empty texts come back as they are, with counts of 0; very long texts are worked on whole.
    Repeated rows all come back, alike. An empty table gives no rows.
    """
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "line_dedup")]
    return dedup_rows(docs, min_exact, min_near).select(*others, "text", F.col("counts").alias("line_dedup"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT DISTINCT doc_id, text FROM documents
), o AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d
), w AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word,
    CAST(coalesce(doc_id, 9223372036854775807) AS HUGEINT) * 2147483648 + line_no AS pos FROM o
), f AS (
  SELECT line, length(line) AS n, min(pos) AS pos FROM w WHERE has_word AND length(line) >= {MIN_EXACT} GROUP BY line
), p AS (
  SELECT a.line AS a, b.line AS b FROM f a JOIN f b ON b.n = a.n AND a.line < b.line WHERE a.n >= {MIN_NEAR} AND levenshtein(a.line, b.line) <= {MAX_EDITS}
  UNION ALL SELECT a.line, b.line FROM f a JOIN f b ON b.n = a.n + 1 WHERE a.n >= {MIN_NEAR} AND levenshtein(a.line, b.line) <= {MAX_EDITS}
  UNION ALL SELECT a.line, b.line FROM f a JOIN f b ON b.n = a.n + 2 WHERE a.n >= {MIN_NEAR} AND levenshtein(a.line, b.line) <= {MAX_EDITS}
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT a AS line, a AS other FROM e UNION SELECT r.line, e.b FROM r JOIN e ON e.a = r.other
), c AS (
  SELECT f.line, f.pos, coalesce(min(g.pos), f.pos) AS best FROM f LEFT JOIN r ON r.line = f.line LEFT JOIN f g ON g.line = r.other GROUP BY f.line, f.pos
), k AS (
  SELECT w.*, coalesce(w.pos = c.best, true) AS kept, c.pos <> c.best AND NOT w.pos = c.best AS near, (SELECT count(*) FROM e WHERE e.a = w.line AND w.has_word) AS n_links
  FROM w LEFT JOIN c ON c.line = w.line AND w.has_word
), t AS (
  SELECT doc_id, text, CAST(count(*) FILTER (WHERE has_word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT kept AND NOT near) AS BIGINT) AS n_exact,
    CAST(count(*) FILTER (WHERE NOT kept AND near) AS BIGINT) AS n_near, CAST(sum(n_links) AS BIGINT) AS n_links,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kept), '') AS cut FROM k GROUP BY doc_id, text
)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(n_links, 0) AS n_links, sha256(coalesce(cut, '')) AS text_sha256
FROM documents x LEFT JOIN t ON x.doc_id IS NOT DISTINCT FROM t.doc_id AND x.text = t.text
"""
