"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups. DataFrame functions only.

Lines are normalised (lower case, runs of blanks, punctuation and other marks to one space). Lines of the same normal form are one
node. A node's SimHash has ``BLOCKS`` blocks of ``BITS`` bits. Every word belongs to one block, by its hash, and a block is the SimHash
of its words, beside their number; so a changed word touches two blocks at most, however short or long the line is, where
in a SimHash over all words it flips bits anywhere. Nodes that agree in ``MATCHING`` blocks which hold enough of a
line's words (one in ``SHARE``; two at least, three in lines of six and more) are candidates: every choice of that many blocks is a key. Lines that differ in one
word nearly always share a key; of those that differ in two, three or four words (replaced, 40 words a line) 81, 39 and 15 in 100 do, and
groups are connected through further members. Lines of one word have no near copies but equal ones.

Candidates of edit similarity ``SIMILARITY`` or more are linked: 1 - edits / longer length, in characters, or in words where
the longer line has over ``LONG`` characters (its lengths must allow the similarity in characters too). Linked nodes form groups, and of each
group's occurrences the first, by (doc_id, hash of the text, line number), stays.

No group's pairs are all emitted: members of buckets of over ``SMALL`` lines meet one lead each, members of a bucket's largest component
need no more, and what is open then is compared inside arrays of ``BLOCK`` lines, every pair of blocks a row; only links leave.
The components are those of all links among candidates.

Defined results: null texts pass unchanged and have no lines; blank lines (no letter or digit) are never dropped; a row repeated with
the same id and text is kept once; a null id takes part as the smallest; an empty table gives an empty result; further
columns are kept. ``dedup`` removes documents that have lost every line that was not blank.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .graph import components

BLOCKS, MATCHING = 5, 2
SIMILARITY = 0.8
#: A key holds one in so many of a line's words, and two words at least, three in lines of six and more: two words may be ones that very many lines have.
SHARE, SEVERAL = 4, 6
#: Characters beyond which similarity is counted in words.
LONG = 128
#: Buckets of up to so many lines are compared pair by pair; in larger ones, lines meet one lead, and what is open then is compared in arrays of so many lines.
SMALL, BLOCK = 16, 64
#: Rows that may be broadcast (lines or documents: a few numbers each); beyond, Spark shuffles.
BROADCAST_ROWS = 300_000
BROADCAST_POSITIONS = 3_000_000
BROADCAST_IDS = 1_000_000
#: A long holds a counter for every block; the lanes' highest bit stays free, so a line of more words is counted by block.
LANE = 64 // BLOCKS
BITS = 64 - LANE * (BLOCKS - 1)
MOST_WORDS = (1 << (LANE - 1)) - 1
LONG_LINE = MOST_WORDS
_ONES = sum(1 << (LANE * k) for k in range(BLOCKS))
_PLACE = ("doc_id", "h", "pos")
_OWN = (*_PLACE, "k1", "k2")


#: What stands between words: blanks, marks of ASCII and Latin-1 one by one (a set looked up by bit), and Unicode's blocks of punctuation, in one
#: range that a letter is outside of. The pattern is read once a line, so only what has a meaning in a set is escaped.
_MARKS = "".join("\\" * (chr(c) in r"[\]^-&") + chr(c) for c in (*range(32, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(161, 170), *range(171, 178), 180, *range(182, 185), 187, 191, 215, 247))
_BETWEEN = rf"[{_MARKS}\t\r\f\x0b\x85\xa0[\u2000-\u303f&&[\u2000-\u206f\u3000-\u303f]]]++"


def words_of(line: Column) -> Column:
    """A line's normal form: its words in lower case."""
    return F.array_remove(F.split(F.lower(line), _BETWEEN), "")


def _not_blank(line: Column) -> Column:
    """Whether there is a letter or digit; most lines begin with one of ASCII, which is told by bytes."""
    begins = [(line >= a) & (line < b) for a, b in (("a", "{"), ("A", "["), ("0", ":"))]
    return begins[0] | begins[1] | begins[2] | line.rlike(r"[\p{L}\p{N}]")


def lines(docs: DataFrame, least: int = 0) -> DataFrame:
    """(doc_id, h, pos, words, line): every line that is not blank (and has ``least`` bytes), h the hash of the whole text, line a number.

    The number is taken beside the words: conditions on words, given or inferred, stay above both, and a line is split once."""
    # hashes of texts are taken before the split, once a text
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    rows = own.select("doc_id", "h", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= least) if least else rows
    return rows.where(_not_blank(F.col("line"))).select(*_PLACE, words_of(F.col("line")).alias("words"), F.monotonically_increasing_id().alias("line"))


def _block_of(x: Column) -> Column:
    return F.pmod(x, F.lit(BLOCKS)).cast("int")


def _lane(k: int, value: Column) -> Column:
    return F.shiftrightunsigned(value, LANE * k).bitwiseAND(F.lit((1 << (LANE - 1)) - 1))


def _from_lanes() -> list[Column]:
    """Columns b0.. of blocks, from n (words of each block) and c0.. (how many of them have bit i), a lane a block."""
    half = F.shiftrightunsigned("n", 1).bitwiseAND(F.lit(_ones_times(MOST_WORDS)))
    # a lane's highest bit is set exactly if its count is over half of its words
    lift = F.lit(_ones_times(MOST_WORDS)) - half
    parts: list[Column] = []
    for i in range(BITS):
        bit = F.shiftleft(F.shiftrightunsigned(F.col(f"c{i}") + lift, LANE - 1).bitwiseAND(F.lit(_ONES)), i % (LANE - 1))
        if i % (LANE - 1):
            parts[-1] = parts[-1].bitwiseOR(bit)
        else:
            parts.append(bit)
    out = []
    for k in range(BLOCKS):
        block = F.shiftleft(_lane(k, F.col("n")), BITS)
        for p, part in enumerate(parts):
            block = block.bitwiseOR(F.shiftleft(_lane(k, part), p * (LANE - 1)))
        out.append(block.alias(f"b{k}"))
    return out


def _ones_times(x: int) -> int:
    return sum(x << (LANE * k) for k in range(BLOCKS))


def _place_hashes(x: str, at: str) -> list[Column]:
    """k1 and k2 of a line (or of some of its words; parts are joined by the same sum): exclusive-or of hashes of each word's hash and place."""
    return [F.bit_xor(F.xxhash64(x, at)).alias("k1"), F.bit_xor(F.xxhash64(at, x)).alias("k2")]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, k1, k2, b0..) of every line: k1 and k2 stand for its normal form, b0.. are the blocks of its SimHash.

    Words are exploded and added up by line in generated code: each adds its bits to its block's lane of sixteen numbers, and its hash with its
    place to k1 and k2, so a word is hashed once. A line's words are in one task, so the exchange has a row a line.
    """
    own = lines(docs).where(F.size("words") <= LONG_LINE)
    word = own.select("line", *_PLACE, F.posexplode("words").alias("at", "w")).select("line", *_PLACE, "at", F.xxhash64("w").alias("x"))
    word = word.withColumn("m", F.call_function("shiftleft", F.lit(1).cast("long"), _block_of(F.col("x")) * LANE))
    bits = (F.sum(F.shiftright("x", i).bitwiseAND(F.col("m"))).alias(f"c{i}") for i in range(BITS))
    place = [F.max(c).alias(c) for c in _PLACE]
    sums = word.groupBy("line").agg(*place, *_place_hashes("x", "at"), F.sum("m").alias("n"), *bits)
    short = sums.select(*_OWN, *_from_lanes())
    # the same for long lines, a row a block
    least = 2 * LONG_LINE  # bytes that more words have
    rest = lines(docs.where(F.octet_length("text") >= least), least).where(F.size("words") > LONG_LINE)
    rest = rest.select("line", *_PLACE, F.posexplode("words").alias("at", "w")).select("line", *_PLACE, "at", F.xxhash64("w").alias("x"))
    rest = rest.withColumn("k", _block_of(F.col("x"))).withColumn("m", F.call_function("shiftright", F.col("x"), F.col("k") * LANE))
    bits = (F.sum(F.shiftright("m", i).bitwiseAND(F.lit(1))).alias(f"c{i}") for i in range(BITS))
    counts = rest.groupBy("line", "k").agg(*place, *_place_hashes("x", "at"), F.count("*").alias("n"), *bits)
    block = F.shiftleft(F.least("n", F.lit(1 << 31)), BITS)
    for i in range(BITS):
        block = block + F.when(F.col(f"c{i}") * 2 > F.col("n"), 1 << i).otherwise(0)
    counts = counts.select("line", *_OWN, "k", block.alias("b"))
    blocks = (F.coalesce(F.max(F.when(F.col("k") == k, F.col("b"))), F.lit(0)).alias(f"b{k}") for k in range(BLOCKS))
    rare = counts.groupBy("line").agg(*place, F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), *blocks)
    return short.unionByName(rare.select(*_OWN, *(f"b{k}" for k in range(BLOCKS))))


def keyed(unique: DataFrame) -> DataFrame:
    """(id, key) of nodes (k1, b0..): a key for every choice of MATCHING blocks that hold enough of the line's words.

    Counts of words are columns before the keys are made: written into each key, they make a method of over 8,000 bytes, which the JVM doesn't compile."""
    names = [f"b{k}" for k in range(BLOCKS)]
    words = [F.shiftrightunsigned(b, BITS) for b in names]
    total = sum(words[1:], words[0])
    enough = F.greatest(F.when(total >= SEVERAL, 3).otherwise(2), F.ceil(total / SHARE))
    rows = unique.select(F.col("k1").alias("id"), *names, *(w.alias(f"n{k}") for k, w in enumerate(words)), enough.alias("enough"))
    out = []
    for j, choice in enumerate(combinations(range(BLOCKS), MATCHING)):
        own = sum((F.col(f"n{k}") for k in choice[1:]), F.col(f"n{choice[0]}"))
        out.append(F.when(own >= F.col("enough"), F.xxhash64(F.lit(j), *(F.col(f"b{k}") for k in choice))))
    return rows.select("id", F.explode(F.array(*out)).alias("key")).where("key is not null")


def _small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(df) if df.count() <= most else df


def _texts(docs: DataFrame, every: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, size, norm, codes) of lines by k1: norm where it may be compared in characters, codes where in words (a character a word).

    Texts meet a row a document, with the places of its wanted lines."""
    # any place of a line will do; the three columns are of one row
    places = (F.first(c).alias(w) for c, w in zip(_PLACE, ("w_id", "w_h", "w_pos"), strict=True))
    wanted = table(every.join(_small(ids), F.col("k1") == F.col("id"), "left_semi").groupBy(F.col("k1").alias("id")).agg(*places))
    n = wanted.count()
    small = n <= BROADCAST_IDS
    held = wanted.groupBy("w_id", "w_h").agg(F.collect_list(F.struct("id", "w_pos")).alias("places"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))
    rows = source.join(F.broadcast(held) if small else held, on).select("places", F.split("text", "\n").alias("lines"))
    found = rows.select("lines", F.explode("places").alias("x")).select("x.id", words_of(F.element_at("lines", F.col("x.w_pos") + 1)).alias("words"))
    found = found.withColumn("norm", F.array_join("words", " "))
    one = F.decode(F.unhex(F.array_join(F.transform("words", lambda w: F.hex(F.xxhash64(w).bitwiseAND(F.lit(0x3FFF)) + 0x4E00)), "")), "UTF-16BE")
    size = F.length("norm")
    found = found.select("id", size.alias("size"), F.when(size <= LONG, F.col("norm")).alias("norm"), F.when(size >= SIMILARITY * LONG, one).alias("codes"))
    found = table(found)
    return found if found.count() == n else table(found.dropDuplicates(["id"]))  # rows repeated with the same id and text have their lines twice


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Edit similarity of two (size, norm, codes) at the threshold or above; near ones are told by a narrow band, others by the full one."""

    def within(x: Column, y: Column, length: Column) -> Column:
        limit = F.floor(length * (1 - similarity) + 1e-9).cast("int")
        distance = lambda most: F.call_function("levenshtein", x, y, most)
        return (distance(F.least(limit, F.lit(12))) >= 0) | ((limit > 12) & (distance(limit) >= 0))

    size = F.greatest(a["size"], b["size"])
    lengths = F.abs(a["size"] - b["size"]) <= (1 - similarity) * size + 1e-9  # a difference in length is a lower bound of the edits
    by_words = within(a["codes"], b["codes"], F.greatest(F.length(a["codes"]), F.length(b["codes"])))
    return lengths & F.when(size > LONG, by_words).otherwise(within(a["norm"], b["norm"], size))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs of ids (a, b) that are similar, as (u, v)."""
    one = F.struct("size", "norm", "codes")
    left, right = (texts.select(F.col("id").alias(s), one.alias(f"text_{s}")) for s in "ab")
    return table(pairs.join(left, "a").join(right, "b").where(_alike(F.col("text_a"), F.col("text_b"), similarity)).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, id, c, active, n, n_active): members of buckets that still have pairs to be compared. c is the component; active are members
    outside of the bucket's largest component, but for the lead. Every open pair has an active member."""
    marked = members.join(_small(parts), F.col("id") == F.col("node"), "left")
    marked = table(marked.select("key", "id", "lead", F.coalesce("component", "id").alias("c")))
    by_part = marked.groupBy("key", "c").agg(F.count("*").alias("n"), F.count_if(~F.col("lead")).alias("n_active"))
    # the most of (n, c), as c occurs once a key
    sums = by_part.groupBy("key").agg(F.max(F.struct("n", "c", "n_active")).alias("m"), F.sum("n").alias("n"), F.sum("n_active").alias("n_active"))
    left = table(sums.select("key", F.col("m.c").alias("major"), "n", (F.col("n_active") - F.col("m.n_active")).alias("n_active")).where("n_active > 0"))
    rows = marked.join(_small(left), "key").withColumn("active", (F.col("c") != F.col("major")) & ~F.col("lead"))
    return table(rows.select("key", "id", "lead", "c", "n", "active", "n_active"))


def _in_blocks(open_: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links of all open pairs: active members of a bucket in arrays against all its members in arrays."""
    member = F.struct("id", "c", "active", "size", "norm", "codes").alias("x")
    rows = open_.join(texts, "id").withColumn("na", F.ceil(F.col("n_active") / block).cast("int")).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    ours = rows.where("active").groupBy("key", deal("na", 1).alias("i"), "nb").agg(F.collect_list(member).alias("xs"))
    ours = ours.select("key", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "xs")
    theirs = rows.groupBy("key", deal("nb", 2).alias("j"), "na").agg(F.collect_list(member).alias("ys"))
    theirs = theirs.select("key", "j", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "ys")

    # a pair of members a row, told in generated code; functions of arrays are interpreted
    pairs = ours.join(theirs, ["key", "i", "j"]).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    x, y = F.col("x"), F.col("y")
    meets = (x["c"] != y["c"]) & (~y["active"] | (x["id"] < y["id"])) & _alike(x, y, similarity)
    return pairs.where(meets).select(x["id"].alias("u"), y["id"].alias("v"))


def linked(docs: DataFrame, every: DataFrame, unique: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(node, component) of all nodes (by k1) with a link."""
    rows = keyed(unique)
    shared = table(rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("n > 1"))
    # a key of two lines has both at hand; only larger buckets look their members up
    sized = table(rows.join(_small(shared.where("n > 2").select("key", "lo", "n")), "key"))
    few, members = sized.where(F.col("n") <= small), sized.where(F.col("n") > small).withColumn("lead", F.col("id") == F.col("lo"))
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    pairs = pairs.unionByName(shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    pairs = table(pairs.unionByName(members.where("not lead").select(F.col("lo").alias("a"), F.col("id").alias("b"))).distinct())
    members = members.select("key", "id", "lead")
    texts = _texts(docs, every, table(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()))
    links = _verified(pairs, texts, similarity)
    parts = components(links)
    open_ = _open(members, parts)
    if open_.head(1):
        more = table(_in_blocks(open_, texts, similarity, block))
        if more.head(1):
            # what is connected so far goes on as stars
            parts = components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    return parts


def groups(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, h, pos, g1, g2, kept): every line that occurs again or is linked, and the place of the one that stays."""
    every = table(occurrences(docs))
    blocks = [F.max(f"b{k}").alias(f"b{k}") for k in range(BLOCKS)]
    unique = table(every.groupBy("k1", "k2").agg(F.count("*").alias("n"), *blocks))
    every = every.select(*_OWN)
    parts = linked(docs, every, unique, **parameters)
    again = unique.where("n > 1").select("k1", "k2")
    looked = unique.join(_small(parts.select(F.col("node").alias("k1"), "component")), "k1").select("k1", "k2", "component")
    own = F.when(F.col("component").isNull(), F.col("k2")).otherwise(0)
    nodes = table(again.join(looked, ["k1", "k2"], "full_outer").select("k1", "k2", F.coalesce("component", "k1").alias("g1"), own.alias("g2")))
    rows = table(every.join(_small(nodes), ["k1", "k2"]).select(*_PLACE, "g1", "g2"))
    kept = table(rows.groupBy("g1", "g2").agg(F.min(F.struct(*_PLACE)).alias("kept")))
    return rows.join(_small(kept), ["g1", "g2"])


def dropped_lines(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, h, drops): line numbers to drop of each document that loses lines."""
    again = groups(docs, **parameters).where(~F.struct(*_PLACE).eqNullSafe(F.col("kept")))
    return table(again.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("drops")))


def mark(docs: DataFrame, **parameters) -> DataFrame:
    """Every distinct (doc_id, text) row, all columns, with its ``_drops`` and, to take the rest from, its ``_lines`` (both null if no line goes)."""
    drops = dropped_lines(docs, **parameters)
    drops = drops.select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), F.col("drops").alias("_drops"))
    rows, positions = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("_drops")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and positions <= BROADCAST_POSITIONS
    own = docs.withColumn("_h", F.xxhash64("text"))
    # ids first: where they are unique, no text is read
    if docs.groupBy("doc_id").count().where("count > 1").head(1) and own.groupBy("doc_id", "_h").count().where("count > 1").head(1):
        own = own.dropDuplicates(["doc_id", "_h"])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("d_id")) & (F.col("_h") == F.col("d_h"))
    return own.join(F.broadcast(drops) if small else drops, on, "left").drop("d_id", "d_h", "_h").withColumn("_lines", F.when(F.col("_drops").isNotNull(), F.split("text", "\n")))


def _rest() -> Column:
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    return F.transform(F.array_except(every, "_drops"), lambda i: F.element_at(F.col("_lines"), i + 1))


def dedup(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with their dropped lines gone; documents without a line left that isn't blank go."""
    marked = mark(docs, **parameters).withColumn("_rest", F.when(F.col("_drops").isNotNull(), _rest()))
    return (
        marked.where(F.col("_drops").isNull() | F.exists("_rest", lambda x: x.rlike(r"[\p{L}\p{N}]")))
        .withColumn("text", F.when(F.col("_drops").isNull(), F.col("text")).otherwise(F.array_join("_rest", "\n")))
        .select(*docs.columns)
    )


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined) and the sha256 of the text that stays."""
    marked = mark(docs, **parameters).withColumn("_rest", F.when(F.col("_drops").isNotNull(), F.array_join(_rest(), "\n")).otherwise(F.col("text")))
    return marked.select(
        "doc_id",
        F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.array_sort("_drops"), ","), F.lit("")).alias("dropped"),
        F.sha2(F.coalesce("_rest", F.lit("")), 256).alias("kept_sha256"),
    )
