"""Operator 9: near-duplicate line removal by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct shingles of `width` lower-cased words (words are separated by ASCII white
space); a line of 1 to width - 1 words has one token, its whole word sequence. Two lines match when
100 * intersection >= percent * union of their token sets. Lines have a rank, by document id (null last), text hash,
then line number. A line is removed if a line of smaller rank matches it, whether that line is itself removed or not; lines
of equal rank (rows repeated with id and text) don't remove one another. Lines without a word are kept.

1. One pass over the texts makes a narrow table: place, a 128-bit hash of the words, and the prefix (see 3) of every line. Texts are read again only for candidates, and to cut lines out.
2. Equal lines form a class, represented by its first line; copies of any number meet in a map-side aggregate.
3. Prefix filter: tokens have a global order, by the hash of their first word, then by their own. With at most N tokens, a
   line's prefix is its N - ceil(percent * N / 100) + 1 least ones, so it holds at least the prefix that the exact number
   asks for, and tokens of later first words needn't be computed.
   Matching classes share a token of their prefixes, and it's among the first N - ceil(2 * percent * N / (100 + percent)) + 1
   of the one with fewer tokens, the short prefix. A prefix is indexed where another class shares the token, and one of them
   has it in its short prefix: tokens are counted by an aggregate and joined back, so that a token in a third of all lines
   isn't gathered in one task.
4. Rarity: where prefixes hold tokens of more than OFTEN classes, all tokens of these classes are counted, frequent ones
   are put last in the order, and the classes get new prefixes. The order decides speed only.
5. Candidates meet in two rounds: first each class with the earliest class of each of its index entries; classes
   that match are settled, since one earlier match is enough. The rest meet all earlier classes of the entry. The length
   filter and the positional filter (the most tokens they can still share, by the place of the common token) are part of
   the join's condition.
6. Verification intersects whole token sets.

Each intermediate table is deleted after its last read.

Nulls: a null text has no lines; a null id ranks last; an empty table gives an empty result; long lines and texts
are whole. Other columns aren't read by `removed_lines`; `dedup_lines` passes them on unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import discard, written

#: Tokens in more classes than this are frequent.
OFTEN = 32
#: A token's number: the upper bits of its first word's hash, then the lower bits of its own.
_UPPER, _LOWER = -(1 << 40), (1 << 40) - 1

# Generators are outer ones on purpose: for inner ones Spark infers a filter on the size of the array and pushes it below
# the projections, where it computes all of the array again. For the same reason hashes come out of a generator: a filter
# on them can't be pushed below it. And a column that a lambda reads is referred to twice at least: a projection that
# is read once is merged into its reader, where a lambda would compute it for each element.


def _line_texts(text: Column) -> Column:
    """Array of a text's lines in lower case, with spaces for other white space."""
    lower = F.lower(text)
    has = lambda x: F.contains(text, F.lit(x))
    other = has("\t") | has("\r") | has("\x0b") | has("\x0c")
    return F.split(F.when(other, F.translate(lower, "\t\x0b\x0c\r", "    ")).otherwise(lower), "\n")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _numbers(hashes: str, places: Column, width: int) -> Column:
    """Distinct numbers of the tokens that begin at some places, from the hashes of the words."""
    number = lambda i: F.get(hashes, i).bitwiseAND(F.lit(_UPPER)).bitwiseOR(F.xxhash64(*(F.get(hashes, i + k) for k in range(width))).bitwiseAND(F.lit(_LOWER)))
    return F.array_distinct(F.transform(places, number))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _least(n: Column, percent: int) -> Column:
    """Length of the prefix of n tokens."""
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _short(n: Column, percent: int) -> Column:
    """Length of the prefix of n tokens that is enough against sets of n tokens or more."""
    return (n - F.ceil(n * (2 * percent) / (100 + percent)) + 1).cast("int")


def _lines(documents: DataFrame, percent: int, width: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, line_no, k1, k2 of the lines with a word; n (the most tokens) and prefix of those with a shingle."""
    docs = documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))

    def hashed(line: Column) -> Column:
        """Of a line's words only hashes leave the generator. Words are the element of an array of one, so they're split once."""
        both = lambda words: F.struct(F.xxhash64(F.lit(width), words).alias("k1"), _hashes(words).alias("hashes"))
        return F.get(F.transform(F.array(_words(line)), both), F.lit(0))

    lines = docs.select("doc_id", "text_hash", F.posexplode_outer(F.transform(_line_texts(F.col("text")), hashed)).alias("line_no", "line")).where(F.size("line.hashes") > 0)
    place = ["doc_id", "text_hash", "line_no", "k1", "k2", "n"]
    most = F.when(F.size("hashes") >= width, F.size("hashes") - (width - 1))
    keyed = lines.select("doc_id", "text_hash", "line_no", "line.*").select("*", F.xxhash64("hashes").alias("k2"), most.alias("n"))
    # the upper bits of the words' hashes, which tokens go by, and the words' places, which are sorted along
    first = F.transform(F.slice("hashes", 1, F.col("n")), lambda h, i: h.bitwiseAND(F.lit(_UPPER)).bitwiseOR(i))
    firsts = keyed.select(*place, "hashes", F.sort_array(first).alias("firsts"))
    needed = _least(F.col("n"), percent)
    bounded = firsts.select(*place, "hashes", "firsts", F.get("firsts", needed - 1).bitwiseOR(F.lit(_LOWER)).alias("bound"))
    # words of the same upper bits belong together, as their tokens' order is that of the lower ones
    near = F.when(F.get("firsts", needed) <= F.col("bound"), F.filter("firsts", lambda x: x <= F.col("bound"))).otherwise(F.slice("firsts", F.lit(1), needed))
    early = bounded.select(*place, "hashes", F.transform(near, lambda x: x.bitwiseAND(F.lit(_LOWER)).cast("int")).alias("early"))
    some = early.select(*place, "hashes", F.sort_array(_numbers("hashes", F.col("early"), width)).alias("some"))
    # a line that repeats a shingle can have too few different ones there
    every = F.sort_array(_numbers("hashes", F.sequence(F.lit(0), F.col("n") - 1), width))
    enough = F.when(F.size("some") < needed, every).otherwise(F.col("some"))
    return some.select(*place, F.when(F.col("n").isNotNull(), F.slice(enough, F.lit(1), needed)).alias("prefix"))


def _token_sets(documents: DataFrame, wanted: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """cid, crowded, tokens, n of wanted classes (cid, crowded, first); repeated rows give a class's set once each."""
    by_doc = wanted.groupBy(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")).agg(F.collect_list(F.struct("cid", "crowded", "first.line_no")).alias("wanted"))
    docs = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    # the generator makes lines a column of their own, or they'd be split again for each wanted one
    found = docs.join(by_doc.hint("shuffle_hash"), here).select("wanted", F.explode_outer(F.array(_line_texts(F.col("text")))).alias("lines"))
    rows = found.select(F.inline_outer(F.transform("wanted", lambda x: F.struct(x["cid"].alias("cid"), x["crowded"].alias("crowded"), _hashes(_words(F.get("lines", x["line_no"]))).alias("hashes")))))
    return rows.select("cid", "crowded", _numbers("hashes", F.sequence(F.lit(0), F.size("hashes") - width), width).alias("tokens")).withColumn("n", F.size("tokens"))


def _shared(index: DataFrame) -> DataFrame:
    """Index rows (cid, pos, short, t) whose token another class has too, and one in its short prefix, with the number of classes df and the earliest one, the hub."""
    counts = index.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("cid").alias("hub"), F.max("short").alias("any")).where("df > 1 and any").drop("any")
    return index.join(counts.hint("shuffle_hash"), "t")


def _reordered(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The index with new prefixes for classes whose prefix has a frequent token.

    A class without one keeps its prefix, since skipping frequent tokens doesn't change it.
    """
    counted = sets.where("crowded").select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    hot = written(counted.where(F.col("df") > OFTEN).select("t"), "line-frequent")
    again = written(index.join(hot, "t", "left_semi").select("cid").distinct(), "line-again")
    spread = sets.join(again, "cid", "left_semi").select("cid", "n", F.explode("tokens").alias("t")).join(hot.withColumn("hot", F.lit(True)), "t", "left")
    rare, often = F.sort_array(F.collect_set(F.when(F.col("hot").isNull(), F.col("t")))), F.sort_array(F.collect_set(F.when(F.col("hot"), F.col("t"))))
    spread = spread.groupBy("cid", "n").agg(F.concat(rare, often).alias("order"))
    renewed = spread.select("cid", "n", F.posexplode(F.slice("order", 1, _least(F.col("n"), percent))).alias("pos", "t")).select("cid", "pos", (F.col("pos") < _short(F.col("n"), percent)).alias("short"), "t")
    kept = index.join(again, "cid", "left_anti").select("cid", "pos", "short", "t")
    both = written(kept.unionByName(renewed), "line-reordered")
    out = written(_shared(both), "line-shared")
    discard(hot, again, both)
    return out


def _fate(documents: DataFrame, classes: DataFrame, percent: int, width: int, id_column: str, text_column: str) -> DataFrame:
    """k1, k2, first, gone of the classes with a line to remove: the class's first line is gone too, or stays."""
    entries = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "t"))
    index = written(_shared(entries.select("cid", "pos", (F.col("pos") < _short(F.col("n"), percent)).alias("short"), "t")), "line-shared")
    some = index.groupBy("cid").agg((F.max("df") > OFTEN).alias("crowded"))
    sets = written(_token_sets(documents, classes.select("cid", "first").join(some, "cid"), width, id_column, text_column), "line-tokens")
    if sets.where("crowded").take(1):
        reordered = _reordered(index, sets, percent)
        discard(index)
        index = reordered
    placed = written(index.drop("df", "short").join(sets.select("cid", "n").distinct(), "cid"), "line-index")
    discard(index)

    def plausible(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
        """Length filter, and positional filter for the first common token: all that's common begins there."""
        least, most = F.least(n_a, n_b), F.greatest(n_a, n_b)
        return (100 * least >= percent * most) & ((100 + percent) * F.least(n_a - pos_a, n_b - pos_b) >= percent * (n_a + n_b))

    def verified(met: DataFrame) -> DataFrame:
        """Classes b of the meetings (a, n_a, pos_a, b, n_b, pos_b) that match."""
        pairs = met.where(plausible(*(F.col(c) for c in ("n_a", "pos_a", "n_b", "pos_b")))).select("a", "b").distinct()
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("set_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("set_b")), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select(F.col("b").alias("cid")).distinct()

    def side(x: str, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("t", F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("pos").alias(f"pos_{x}"), *more)

    first = side("b", placed.where("cid != hub")).join(side("a", placed.where("cid = hub")), "t")
    settled = written(verified(first), "line-settled")
    later = side("b", placed.join(settled, "cid", "left_anti"), "hub")
    met = later.join(side("a", placed), "t").where((F.col("a") != F.col("hub")) & (F.col("a") < F.col("b")))
    second = written(verified(met), "line-matched")
    discard(placed, sets)

    matched = settled.unionByName(second)
    # lines of matched classes go, as do the later lines of any other class
    fate = classes.select("cid", "k1", "k2", "first", "times").join(matched.withColumn("gone", F.lit(True)), "cid", "left").where("gone or times > 1")
    fate = written(fate.select("k1", "k2", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "line-fate")
    discard(settled, second, classes)
    return fate


def _removed(documents: DataFrame, percent: int, width: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, line_no of the lines to remove."""
    lines = written(_lines(documents, percent, width, id_column, text_column), "lines")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line_no")
    classes = lines.groupBy("k1", "k2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # numbers follow the rank, so the earlier of two classes is the one of smaller number
    classes = written(classes.repartitionByRange("first").sortWithinPartitions("first").withColumn("cid", F.monotonically_increasing_id()), "line-classes")
    # prefixes, most of the table, have been read for the last time
    places = written(lines.drop("n", "prefix"), "line-places")
    discard(lines)
    fate = _fate(documents, classes, percent, width, id_column, text_column)
    return places.select("k1", "k2", rank.alias("rank")).join(fate, ["k1", "k2"]).where("gone or rank > first").select("rank.doc_id", "rank.text_hash", "rank.line_no")


def removed_lines(documents: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lines to remove: doc_id, line_no (from 0, of the text split at \\n)."""
    return _removed(documents, percent, width, id_column, text_column).select("doc_id", "line_no")


def dedup_lines(documents: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with all their columns, and texts without the removed lines. Documents are told by id and text."""
    gone = _removed(documents, percent, width, id_column, text_column).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("line_no").alias("gone"))
    rows = documents.select(F.struct("*").alias("row"))
    here = F.col("row")[id_column].eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row")[text_column]) == F.col("hash"))
    joined = rows.join(gone.hint("shuffle_hash"), here, "left")
    # lines are a column of their own, or each step of the lambda would split the text again
    parted = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.split(F.col("row")[text_column], "\n")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_column]).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return parted.select(*(text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in documents.columns))


def line_dedup_sql(percent: int, width: int) -> str:
    """The deduplicated texts as SQL for DuckDB over `documents`: doc_id and text."""
    return f"""
WITH lines AS (SELECT doc_id, line, line_no - 1 AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
worded AS (SELECT *, list_filter(string_split(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '') AS words FROM lines),
classes AS (SELECT array_to_string(words, ' ') AS normal, any_value(words) AS words, min((doc_id IS NULL, doc_id, line_no)) AS rank FROM worded WHERE len(words) > 0 GROUP BY 1),
tokens AS (SELECT normal, rank, unnest(list_distinct(list_transform(range(1, greatest(2, len(words) - {width - 2})), lambda i: array_to_string(words[i:i + {width - 1}], ' ')))) AS t FROM classes),
sizes AS (SELECT normal, count(*) AS n FROM tokens GROUP BY 1),
common AS (SELECT a.normal AS a, b.normal AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.rank < b.rank GROUP BY 1, 2),
matched AS (SELECT DISTINCT b FROM common JOIN sizes x ON x.normal = a JOIN sizes y ON y.normal = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
kept AS (SELECT w.doc_id, w.line, w.line_no FROM worded w LEFT JOIN classes k ON k.normal = array_to_string(w.words, ' ')
         WHERE len(w.words) = 0 OR NOT ((w.doc_id IS NULL, w.doc_id, w.line_no) > k.rank OR k.normal IN (SELECT b FROM matched)))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY line_no) FROM kept WHERE kept.doc_id = d.doc_id), '') END AS text FROM documents d"""
