"""Line dedup: exact set-similarity join on the tokens of lines; DataFrame functions only.

A line's tokens are its distinct words. They are ordered by rarity: words are hashed into BUCKETS, the words of the
whole corpus are counted by bucket, and rarer classes of buckets come first (any total order keeps the join exact). Two lines of
Jaccard similarity SIMILARITY or more must share a token among their first ones (prefix filter), have similar numbers of
tokens (length filter), and have enough tokens left after the first shared one (positional filter). They also differ in no more
tokens than the similarity allows, and so do the 64-bit parities of their tokens. What passes is compared by longer parities of its
words, and then verified on the words themselves.
A line is removed when an earlier line matches, by (doc_id, position), nulls last; lines without words stay.

A prefix token of a bucket of HOT words or more would bring many chance partners together. Different lines that match share four
tokens or more, the second of them among one more than the prefix, so such a token is joined as a pair with each later token there.
Sets with such pairs carry these first tokens, so that two of them meet only at the first two that they share, and only if
what is left after them can be enough.

Lines of equal tokens are one set from the start, and only a set's first line can be kept. Sets that share a key, one of the rarest or
every other one, are first compared with the earliest of them and with their predecessor there, so that a large group of near copies
gives pairs in proportion to its members; only sets that this does not settle are compared with all earlier partners. The rarest keys alone
would not do: those of a copy are mostly its own edits.

Defined results: null and empty texts have one line without words; rows of equal doc_id and text are one document and get
equal results; ids that are no whole numbers count as null; lines of any length are compared whole; an empty table gives an empty
result; other columns, also of clashing names, pass through ``without_repeats`` unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.llm.common import broadcast_if_small, discard, materialize, release, settled

WORD = r"[^\x20\x09-\x0D]"
SIMILARITY = 0.8
#: Buckets in which words are counted, and classes of their counts, a factor apart: a byte for each bucket, a fixed size in all. A rare word that
#: shares its bucket with many others counts as frequent, so there are about as many buckets as a corpus of a GB has words.
BUCKETS, CLASSES, FACTOR, CHUNK = 1 << 22, 120, 1.3, 4096
#: Words of a bucket from which its tokens are joined in pairs, of a corpus of WORDS words or fewer; of a larger one as many times more. With a fixed
#: number most tokens of a large corpus would be in pairs, and the keys of a line many times as many.
HOT, WORDS = 1000, 100_000_000
#: Rarest keys by which a set meets its leaders, beside every other one.
LEADERS = 3
#: 64-bit parities of a line's words by which candidates are compared before their words are.
PARITIES = 4
#: Parts, by key, in which sets are compared with all their partners: the entries of one part lie on disk at a time.
PARTS = 3
#: Parts, by document, in which texts are shuffled where too many lines are wanted for a broadcast.
TEXT_PARTS = 4
#: A line's place in the corpus is one number where ids are distinct and below 2**ID_BITS and lines below 2**LINE_BITS.
ID_BITS, LINE_BITS = 40, 23
#: Tokens of a line from which it carries its further parities into the join: two lines that share nothing differ in about 32 of 64 bits,
#: which is too few to tell from the 2/9 of their tokens in which such long lines may differ.
LONG = 96
#: Sets to verify up to which they are broadcast to the texts; more of them are joined by shuffle.
BROADCAST_ROWS = 400_000


def _spaced(text: Column) -> Column:
    """The text with a space for every other white space of a line."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\x0b\x0c\r", text)


def _words(line: str) -> Column:
    """Words of a trimmed line without white space but spaces."""
    return F.when(F.contains(line, F.lit("  ")), F.array_remove(F.split(line, " "), "")).otherwise(F.split(line, " "))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _class(count: Column) -> Column:
    return F.least(F.floor(F.log(F.greatest(count, F.lit(1))) / math.log(FACTOR)), F.lit(CLASSES)).cast("tinyint")


def rarity(docs: DataFrame) -> DataFrame:
    """One row: the class of each bucket of words by its count in all texts, as an array of BUCKETS bytes."""
    words = F.split(F.replace(_spaced(_text()), F.lit("\n"), F.lit(" ")), " ")
    each = docs.select(F.explode(words).alias("w")).select(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("count"))
    counts = materialize(each.groupBy("b").count().union(every).groupBy("b").agg(F.sum("count").alias("n")))
    growth = max(1.0, counts.agg(F.sum("n")).first()[0] / WORDS)
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    chunks = counts.select("b", F.floor(F.col("b") / CHUNK).alias("c"), _class(F.col("n") / growth).alias("v")).groupBy("c").agg(in_order("b", "v").alias("v"))
    return materialize(chunks.agg(F.flatten(in_order("c", "v")).alias("places")))


def tokens(words: Column, places: Column) -> Column:
    """Sorted distinct tokens of a line: class of the word's bucket, then 56 bits of its hash. No bucket lacks a class; without the default
    the elements could be null, and Spark would sort objects."""
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.coalesce(F.get(places, h.bitwiseAND(BUCKETS - 1)), F.lit(0).cast("tinyint")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _need(a: Column, b: Column) -> Column:
    """Least number of shared tokens of sets of a and b tokens."""
    return F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (a + b) - 1e-9)


def _prefix(n: Column) -> Column:
    return (n - F.ceil(SIMILARITY * n - 1e-9) + 1).cast("int")


def _hot() -> Column:
    """The least token of a bucket of HOT words or more."""
    return F.lit(math.ceil(math.log(HOT) / math.log(FACTOR)) << 56)


def _head(k: str, n: Column) -> Column:
    """The tokens that are joined in pairs; null if none is hot."""
    return F.when(F.element_at(k, _prefix(n)) >= _hot(), F.slice(k, 1, _prefix(n) + 1))


def _keys(k: str, n: Column) -> Column:
    """The join keys of sorted tokens k: each prefix token, hot ones with each later token up to the next after the prefix. An entry is
    32 bits of hash, which can only add candidates, then the token's place."""
    prefix, hot = _prefix(n), _hot()
    wide = F.slice(k, 1, prefix + 1)
    single = lambda t, i: F.shiftleft(t, 32).bitwiseOR(i)
    paired = lambda t, i: F.when(t < hot, F.array(single(t, i))).otherwise(F.transform(F.slice(wide, i + 2, n), lambda u: single(F.xxhash64(t, u), i)))
    return F.when(F.element_at(k, prefix) < hot, F.transform(F.slice(k, 1, prefix), single)).otherwise(F.flatten(F.transform(F.slice(k, 1, prefix), paired)))


def _parity(k: str | Column) -> Column:
    return F.aggregate(k, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))


def _parities(hashes: str) -> Column:
    """Parities of the hashes, dealt to PARITIES of them by further bits: sets differ in no fewer elements than their parities in bits."""
    return F.array(*(_parity(F.filter(hashes, lambda h: F.shiftright(h, 6).bitwiseAND(PARITIES - 1) == q)) for q in range(PARITIES)))


def _key(entry: str | Column) -> Column:
    return F.shiftright(entry, 32).cast("int")


def _of_part(keys: str, part: int) -> Column:
    return F.filter(keys, lambda e: F.pmod(_key(e), F.lit(PARTS)) == part)


def _packed(n: str, entry: str, open_: Column) -> Column:
    """Size, place and whether the set is open, in one number."""
    return F.shiftleft(F.col(n).cast("long"), 32) + 2 * F.col(entry).bitwiseAND(0x7FFFFFFF) + open_.cast("long")


def _passes(xp: Column, xb: Column, yp: Column, yb: Column) -> Column:
    """Length, positional and parity filter for two entries of a key."""
    n, m = F.shiftright(xp, 32), F.shiftright(yp, 32)
    i, j = (F.shiftright(p.bitwiseAND(0xFFFFFFFF), 1) for p in (xp, yp))
    need = _need(n, m)
    return (F.least(n, m) >= F.ceil(SIMILARITY * F.greatest(n, m) - 1e-9)) & (F.bit_count(xb.bitwiseXOR(yb)) <= n + m - 2 * need) & (F.least(n - i, m - j) >= need)


def _meets(key: str, n: Column, m: Column) -> Column:
    """Whether a pair key holds the first two shared tokens of heads xh and yh, and enough can be shared with what is behind the shorter head."""
    both = F.array_intersect("xh", "yh")
    first = F.shiftright(F.shiftleft(F.xxhash64(F.slice(both, 1, 2)), 32), 32).cast("int") == F.col(key)  # an array's hash is that of its elements in turn
    return first & (F.size(both) + F.greatest(n - F.size("xh"), m - F.size("yh")) >= _need(n, m))


def _row_keys(docs: DataFrame) -> DataFrame:
    """Adds did, the id with null last, and tk, a hash of the text: rows equal in both are one document."""
    did = F.coalesce(F.col("doc_id").try_cast("long"), F.lit((1 << 63) - 1))
    return docs.withColumn("did", did).withColumn("tk", F.xxhash64(_text()))


def _with_places(lines: DataFrame) -> DataFrame:
    """Adds sid, a number in the order of (did, tk, pos) that is distinct for each."""
    lo, hi, last = lines.agg(F.min("did"), F.max("did"), F.max("pos")).first()
    packs = lo is None or (lo >= 0 and hi < 1 << ID_BITS and last < 1 << LINE_BITS)
    if packs and not lines.select("did", "tk").distinct().groupBy("did").count().where("count > 1").limit(1).count():
        return lines.withColumn("sid", F.shiftleft("did", LINE_BITS) + F.col("pos"))
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = lines.select("did", "tk", "pos").distinct().repartitionByRange(parts, "did", "tk", "pos").sortWithinPartitions("did", "tk", "pos")
    places = materialize(places.withColumn("sid", F.monotonically_increasing_id()))
    return materialize(lines.join(places, ["did", "tk", "pos"]))


def _set_words(rows: DataFrame, by_row: DataFrame) -> DataFrame:
    """(sid, k, n, b): the words of the wanted lines of by_row (did, tk, w), their number and parities."""
    each = rows.select("did", "tk", "text").join(by_row, ["did", "tk"]).select(F.split(_text(), "\n").alias("ls"), "w")
    each = each.select(F.explode(F.transform("w", lambda x: F.struct(x["sid"].alias("sid"), F.element_at("ls", x["pos"] + 1).alias("line")))).alias("w"))
    each = each.select("w.sid", F.trim(_spaced(F.col("w.line"))).alias("line"))
    found = each.select("sid", F.array_distinct(_words("line")).alias("k")).dropDuplicates(["sid"]).withColumn("h", F.transform("k", lambda w: F.xxhash64(w)))
    return found.select("sid", "k", F.size("k").alias("n"), _parities("h").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct sid x of the pairs (x, y) of sets whose words are similar."""
    pairs = materialize(pairs)
    release(rows.sparkSession)  # the entries of the join that made the pairs are not needed beside the words
    wanted = materialize(pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct().join(sets.select("sid", "did", "tk", "pos"), "sid"))
    by_row = wanted.groupBy("did", "tk").agg(F.collect_set(F.struct("sid", "pos")).alias("w"))
    if wanted.count() <= BROADCAST_ROWS:
        found = materialize(_set_words(rows, F.broadcast(by_row)))
    else:  # beside the tables that lie there, texts are too much to be on disk at a time
        found = []
        for part in range(TEXT_PARTS):
            here = F.pmod(F.xxhash64("did", "tk"), F.lit(TEXT_PARTS)) == part
            found.append(materialize(_set_words(rows.where(here), by_row.where(here))))
            release(rows.sparkSession)  # the part's texts
        found = reduce(DataFrame.union, found)
    # most candidates are long lines that 64 bits cannot tell apart; these are told apart on narrow rows, so that no words are shuffled for them
    x, y = found.select("sid", "n", "b").toDF("x", "xn", "xb"), found.select("sid", "n", "b").toDF("y", "yn", "yb")
    differ = reduce(Column.__add__, (F.bit_count(F.get("xb", F.lit(q)).bitwiseXOR(F.get("yb", F.lit(q)))) for q in range(PARITIES)))
    close = pairs.join(x, "x").join(y, "y").where(differ <= F.col("xn") + F.col("yn") - 2 * _need(F.col("xn"), F.col("yn")))
    close = materialize(close.select("x", "y"))
    x, y = found.select("sid", "k").toDF("x", "xk"), found.select("sid", "k").toDF("y", "yk")
    both = close.join(x, "x").join(y, "y")
    return both.where(F.size(F.array_intersect("xk", "yk")) >= _need(F.size("xk"), F.size("yk"))).select("x").distinct()


def _led(sets: DataFrame) -> DataFrame:
    """Distinct (x, y) of sets and their leaders, the earliest set and the one before x with a key, that pass the filters."""
    some_keys = sets.select("sid", "n", "bits", F.posexplode("keys").alias("q", "e")).where((F.col("q") < LEADERS) | (F.col("q") % 2 == 0))
    entries = some_keys.select(_key("e").alias("key"), F.struct("sid", _packed("n", "e", F.lit(0)).alias("p"), "bits").alias("e"))
    in_order = Window.partitionBy("key").orderBy("e.sid")
    led = entries.withColumn("first", F.first("e").over(in_order)).withColumn("last", F.lag("e").over(in_order)).where("last IS NOT NULL")
    each = led.select("e", F.explode(F.array_distinct(F.array("first", "last"))).alias("y"))
    return each.where(_passes(F.col("e.p"), F.col("e.bits"), F.col("y.p"), F.col("y.bits"))).select(F.col("e.sid").alias("x"), F.col("y.sid").alias("y")).distinct()


def _partners(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """Distinct (x, y) of sets x that are not settled and earlier sets y that share a key and pass the filters."""
    found = []
    for part in range(PARTS):
        found.append(materialize(_partners_by(sets, settled, part)))
        release(sets.sparkSession)  # the part's entries
    return reduce(DataFrame.union, found).distinct()


def _partners_by(sets: DataFrame, settled: DataFrame, part: int) -> DataFrame:
    """What ``_partners`` gives by the keys of one part."""
    marked = sets.select("sid", "n", "bits", "wide", "head", _of_part("keys", part).alias("keys"))  # no other keys are shuffled
    marked = marked.join(settled.select(F.col("x").alias("sid"), F.lit(True).alias("settled")), "sid", "left")
    entries = marked.select("sid", "n", "bits", "wide", "head", "settled", F.explode("keys").alias("e"))
    head = F.when(F.get("head", F.col("e").bitwiseAND(0x7FFFFFFF).cast("int")) >= _hot(), F.col("head"))  # of entries that are pairs
    entries = entries.select(_key("e").alias("key"), "sid", _packed("n", "e", F.col("settled").isNull()).alias("p"), "bits", "wide", head.alias("head"))
    entries = entries.where("key IS NOT NULL AND sid IS NOT NULL AND p IS NOT NULL AND bits IS NOT NULL")  # or else the sides would differ in that
    # both sides are the same rows, so that they are shuffled once; hence openness is judged with the order of the two
    one, two = (entries.select("key", F.col("sid").alias(x), F.col("p").alias(f"{x}p"), F.col("bits").alias(f"{x}b"), F.col("wide").alias(f"{x}w"), F.col("head").alias(f"{x}h")) for x in "xy")
    earlier = F.col("y") < F.when(F.col("xp").bitwiseAND(1) == 1, F.col("x")).otherwise(F.lit(-(1 << 63)))
    n, m = F.shiftright("xp", 32), F.shiftright("yp", 32)
    bits = reduce(Column.__add__, (F.bit_count(F.get("xw", F.lit(q)).bitwiseXOR(F.get("yw", F.lit(q)))) for q in range(PARITIES)))
    close = F.coalesce(bits <= n + m - 2 * _need(n, m), F.lit(True))  # of two long lines
    meets = F.col("xh").isNull() | F.col("yh").isNull() | _meets("key", n, m)
    return one.join(two, "key").where(earlier & _passes(F.col("xp"), F.col("xb"), F.col("yp"), F.col("yb")) & close & meets).select("x", "y").distinct()


@settled
def removed_lines(docs: DataFrame) -> DataFrame:
    """(did, tk, removed): sorted positions of the lines to remove, of the documents that have some."""
    counted = rarity(docs)
    release(docs.sparkSession)
    places = counted.scalar()
    rows = _row_keys(docs.select("doc_id", "text"))
    lines = rows.select("did", "tk", F.posexplode(F.split(_spaced(_text()), "\n")).alias("pos", "line"))
    lines = lines.select("did", "tk", "pos", F.trim("line").alias("line")).where("line <> ''").select("did", "tk", "pos", _words("line").alias("w"))
    # a lambda may not hold a subquery; the two selections are collapsed into one, so that no row carries the places
    lines = lines.select("did", "tk", "pos", "w", places.alias("places")).select("did", "tk", "pos", tokens(F.col("w"), F.col("places")).alias("k"))
    size = F.size("k")
    lines = materialize(lines.select("did", "tk", "pos", F.xxhash64("k").alias("s"), F.xxhash64(F.lit(1), F.col("k")).alias("t"), size.alias("n"), _parity("k").alias("bits"), F.when(size >= LONG, _parities("k")).alias("wide"), _head("k", size).alias("head"), _keys("k", size).alias("keys")))
    lines = _with_places(lines)
    sets = materialize(lines.groupBy("s", "t").agg(F.min_by(F.struct("sid", "did", "tk", "pos", "n", "bits", "wide", "head", "keys"), "sid").alias("v")).select("s", "t", "v.*"))
    every = lines
    lines = materialize(every.select("did", "tk", "pos", "sid", "s", "t"))
    discard(every)  # its keys stand in the sets

    release(docs.sparkSession)
    later = materialize(_verified(_led(sets), sets, rows))
    release(docs.sparkSession)
    later = later.union(_verified(_partners(sets, broadcast_if_small(later, BROADCAST_ROWS)), sets, rows))

    verdict = sets.select("s", "t", F.col("sid").alias("first")).join(later.toDF("first").withColumn("later", F.lit(True)), "first", "left")
    gone = lines.select("did", "tk", "pos", "sid", "s", "t").join(verdict, ["s", "t"]).where(F.coalesce("later", F.lit(False)) | (F.col("sid") > F.col("first")))
    return gone.groupBy("did", "tk").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs (doc_id, text), n_lines, n_removed, and removed, the sorted positions of removed lines."""
    gone = removed_lines(docs).toDF("_did", "_tk", "removed")
    rows = _row_keys(docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), "doc_id", "text"))
    rows = rows.select(*(f"_k{i}" for i in range(len(keep))), F.col("did").alias("_did"), F.col("tk").alias("_tk"), F.size(F.split(_text(), "\n")).alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = rows.join(gone, ["_did", "_tk"], "left")
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the remaining lines of their texts; columns as before. Null texts stay null."""
    names = docs.columns
    moved = docs.toDF(*(n if n in ("doc_id", "text") else f"_c{i}" for i, n in enumerate(names)))
    out = _row_keys(moved).join(removed_lines(moved), ["did", "tk"], "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.withColumn("text", text).select(*moved.columns).toDF(*names)
