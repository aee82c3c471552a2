"""Fuzzy line dedup, DataFrame functions only.

Lines are normalised to lower-cased words; equal ones are one node. The distinct words of a node are laid on a circle by
their hash; the fingerprint has a block for each of 8 fixed places, the SimHash (bits that more than half have) of the four
words that follow there. A word that changes touches only the blocks next to it, so lines that differ in few words agree
in a block (pigeonhole) and meet there. Lines of few words meet where all words but one agree. What meets is verified
by edit similarity, and of each connected group of lines one occurrence stays.

In a first round each block's group compares one leader with all others, and what is similar takes the leader's mark
(lines of one mark are connected). Groups with several marks then compare all pairs of different marks, if they are
small; larger ones go in rounds: some of their nodes (LEADERS) are compared with all others of another mark and then
leave, until a group's nodes have one mark. The first rounds have few leaders, and what they join takes the mark of the
group's main part at once, so that similar lines don't all lead; and a pair goes on to its texts only if the counts of
its words (or of letter pairs) allow it to be similar. So the pairs verified grow with the nodes, no group is capped,
and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import shuffles_freed
from .common import connected_components, materialize

SIMILARITY, SMALL = 0.8, 16
#: Leaders of a group in a round: 8 at first, twice as many in each next round up to 1,024, but from the second round on no
#: more than compare ROUND_PAIRS pairs (8 at least).
LEADERS, ROUND_PAIRS = (8, 1_024), 4_194_304
#: Places of the blocks on the circle of word hashes, and words in a block.
PLACES, FOLLOWING = tuple(i << 60 for i in range(8)), 4
#: Named one by one, not as ranges, so that a pattern looks them up.
COMMON = "abcdefghijklmnopqrstuvwxyz0123456789"
#: A line has a key for each place or, if it has fewer than LEAST_WORDS words, one for each word and one for all.
MOST_KEYS = 8
KEYS = [f"k{i}" for i in range(MOST_KEYS)]
#: Words of fewer letters don't count in blocks, unless fewer than LEAST_WORDS are left; lines of still fewer words have no blocks.
WORD_LETTERS, LEAST_WORDS = 4, 8
#: What is left of a short line without one of its words must have so many letters and blanks.
LEFT_LETTERS = 9
#: Lines of so many words are compared word by word, in an alphabet of so many characters (from 4096, all below the surrogates).
BY_WORDS, DIFFERENT = 16, 51_000
#: Lines of fewer words are never similar to one of BY_WORDS words, so they have no code.
LEAST_CODED = int(BY_WORDS * SIMILARITY)
#: Random numbers gain nothing from a dictionary.
PLAIN = "lz4", {"parquet.enable.dictionary": "false"}
#: Groups are dealt by document to so many parts first, so that a line in a third of all documents is no single task.
SALTS = 32


def _words(lower: Column) -> Column:
    """Runs of letters and digits (\\p{L}, \\p{N}) of a lower-cased line. The common ones are told by a table of bits, and LD, letters
    and decimal digits, is one test for most others."""
    return F.array_remove(F.split(lower, rf"[^{COMMON}\p{{LD}}\p{{N}}]+"), "")


def normalised(line: Column) -> Column:
    """The lower-cased words of a line, joined by one space."""
    return F.array_join(_words(F.lower(line)), " ")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; an alias would be written out at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def simhash(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The bits that more than half of four hashes have."""
    return a.bitwiseAND(b).bitwiseAND(c.bitwiseOR(d)).bitwiseOR(c.bitwiseAND(d).bitwiseAND(a.bitwiseOR(b)))


def _hash(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(_long((1 << 63) - 1))


def with_keys(lines: DataFrame) -> DataFrame:
    """Replaces words array<string> by k0, k1, ..., MOST_KEYS longs (null where there are fewer): what similar lines have in common."""
    names = [c for c in lines.columns if c != "words"]
    hashes = lambda words: F.sort_array(F.array_distinct(F.transform(words, _hash)))
    rows = lines.select(*names, "words", hashes(F.filter("words", lambda w: F.length(w) >= WORD_LETTERS)).alias("h"))
    rows = rows.select(*names, "words", F.when(F.size("h") >= LEAST_WORDS, F.col("h")).otherwise(hashes("words")).alias("h"))
    # from here on only short lines need their words: arrays of words are most of a row
    rows = rows.select(*names, F.when(F.size("h") < LEAST_WORDS, F.col("words")).alias("words"), "h")
    # the circle: hashes in order, and in s the places among them, each after as many hashes as a block begins with
    rows = rows.select(*names, "words", F.size("h").alias("n_h"), "h", F.sort_array(F.concat("h", F.array(*map(_long, PLACES)))).alias("s"))
    before = [(F.array_position("s", _long(place)).cast("int") - (i + 1)).alias(f"q{i}") for i, place in enumerate(PLACES)]
    # the first hashes follow the last ones once more; what a block takes is in columns, else it would be taken at each use
    rows = rows.select(*names, "words", F.concat("h", F.slice("h", 1, FOLLOWING)).alias("h"), "n_h", *before)
    after = [F.get("h", F.col(f"q{i}") + j).alias(f"h{i}_{j}") for i in range(len(PLACES)) for j in range(FOLLOWING)]
    rows = rows.select(*names, "words", "n_h", *after)
    blocks = [F.xxhash64(F.lit(i), simhash(*(F.col(f"h{i}_{j}") for j in range(FOLLOWING)))) for i in range(len(PLACES))]
    # short lines: the exclusive or of all hashes but one, and of all
    words = F.array_distinct("words")
    total = F.aggregate(words, _long(0), lambda a, w: a.bitwiseXOR(_hash(w)))
    letters = F.aggregate("words", F.size("words") - 1, lambda a, w: a + F.length(w))
    left = lambda t, n: F.transform(words, lambda w: F.when(n - F.length(w) >= LEFT_LETTERS, F.xxhash64(F.lit(-1), t.bitwiseXOR(_hash(w)))))
    but_one = _with(F.struct(total.alias("t"), letters.alias("n")), lambda x: F.array_append(left(x["t"], x["n"]), F.xxhash64(F.lit(-1), x["t"])))
    few_keys = F.when(F.col("n_h") < LEAST_WORDS, F.array_distinct(F.array_compact(but_one))).alias("few_keys")
    rows = rows.select(*names, few_keys, *[F.when(F.col("n_h") >= LEAST_WORDS, b).alias(f"b{i}") for i, b in enumerate(blocks)])
    return rows.select(*names, *[F.coalesce(f"b{i}", F.get("few_keys", F.lit(i))).alias(k) for i, k in enumerate(KEYS)])


def _n_lines(text: Column) -> Column:
    """The number of lines of a text, 0 of null: its line ends and one, without an array of lines."""
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(ends + 1, F.lit(0))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_lines, line_no, line_id, line_check, n_words, k0, k1, ...) of every line, n_words 0 if it has no word; row tells
    rows that repeat a doc_id apart, n_lines is the document's."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    src = src.select("doc_id", F.xxhash64("text").alias("row"), _n_lines(F.col("text")).alias("n_lines"), F.split(F.lower("text"), "\n").alias("parts"))
    lines = src.select("doc_id", "row", "n_lines", F.posexplode("parts").alias("line_no", "line"))
    # lines without a word go when this is read: a filter here would make the words once more
    named = lines.select("doc_id", "row", "n_lines", "line_no", _words(F.col("line")).alias("words"))
    return with_keys(named.withColumns({"line_id": F.xxhash64("words"), "line_check": F.xxhash64(F.lit(1), "words"), "n_words": F.size("words")}))


def _texts(docs: DataFrame, places: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, line): the normalised text of the lines asked for, read from one document each."""
    where = places.join(wanted, "line_id", "left_semi")
    by_doc = where.groupBy("at.doc_id", "at.row").agg(F.collect_list(F.struct("at.line_no", "line_id")).alias("asked"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    # the lines are taken out before the explode, which else copies the whole document for each of them
    taken = _with(F.split("text", "\n"), lambda x: F.transform("asked", lambda a: F.struct(a["line_id"].alias("line_id"), F.get(x, a["line_no"]).alias("line"))))
    held = src.join(by_doc.hint("shuffle_hash"), ["doc_id", "row"]).select(F.explode(taken).alias("a"))
    # dealt out first: the texts are then sorted once and not once more before they go
    return held.select("a.line_id", normalised(F.col("a.line")).alias("line")).repartition("line_id").dropDuplicates(["line_id"])


def _let(name: str, value: str, body: str) -> str:
    """As _with, in SQL."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _as_letters(words: str, number: str) -> str:
    """A string with a character for each word w, of its number, so that an edit of a word is one of a letter."""
    return f"decode(unhex(array_join(transform({words}, w -> hex(4096 + {number})), '')), 'UTF-16BE')"


def with_codes(texts: DataFrame) -> DataFrame:
    """(line_id, line, code): a letter by hash for each word, of lines of LEAST_CODED words or more; once a line, not once a pair."""
    code = _let("x", "split(line, ' ')", f"if(size(x) >= {LEAST_CODED}, {_as_letters('x', f'pmod(xxhash64(w), {DIFFERENT})')}, null)")
    return texts.select("line_id", "line", F.expr(code).alias("code"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of line ids whose edit similarity is SIMILARITY or more: 1 - distance / the longer length, in
    words (a word put in, left out or replaced is one edit) where a line has BY_WORDS words or more, else in letters."""
    # dealt out as lines, once for both sides: arrays of words are a multiple of the line
    dealt = (texts if "code" in texts.columns else with_codes(texts)).repartition("line_id")
    x = dealt.select(F.col("line_id").alias("a"), F.col("line").alias("lx"), F.col("code").alias("cx"))
    y = dealt.select(F.col("line_id").alias("b"), F.col("line").alias("ly"), F.col("code").alias("cy"))
    most = lambda a, b: f"int(floor(greatest({a}, {b}) * {1 - SIMILARITY:.6f} + 1e-9D))"
    words = most("length(cx)", "length(cy)")
    # a pair with few edits is told in a narrow band
    near = lambda x, y, limit: f"(levenshtein({x}, {y}, int({limit} div 4)) >= 0 or levenshtein({x}, {y}, {limit}) >= 0)"
    by_letters = near("lx", "ly", most("length(lx)", "length(ly)"))
    # letters by hash: words that share one make the distance smaller, so a pair with such words is measured by their places in d
    x_, y_ = "split(lx, ' ')", "split(ly, ' ')"
    alone = f"size(array_union(split(cx, ''), split(cy, ''))) = size(array_union({x_}, {y_}))"
    place = lambda of: _as_letters(of, f"pmod(array_position(d, w), {DIFFERENT})")
    exact = _let("d", f"array_union({x_}, {y_})", f"levenshtein({place(x_)}, {place(y_)}, {words}) >= 0")
    within = f"(abs(length(cx) - length(cy)) <= {words} and {near('cx', 'cy', words)})"
    both = pairs.join(x, "a").join(y, "b")
    # a line without a code has few words
    long = f"greatest(coalesce(length(cx), 0), coalesce(length(cy), 0)) >= {BY_WORDS}"
    return both.where(f"if({long}, {within} and ({alone} or {exact}), {by_letters})").select(*pairs.columns)


def with_counted(texts: DataFrame) -> DataFrame:
    """(line_id, t array<int>): the line's words, hashed with how many equal ones come before; of lines under BY_WORDS words
    the pairs of neighbouring letters instead."""
    pair = F.transform(F.sequence(F.lit(1), F.length("line") - 1), lambda i: F.xxhash64(F.substr("line", i, F.lit(2))))
    pairs_ = F.when(F.length("line") > 1, pair).otherwise(F.array().cast("array<long>"))
    words = F.split("line", " ")
    hashed = F.sort_array(F.when(F.size(words) >= BY_WORDS, F.transform(words, lambda w: F.xxhash64(w))).otherwise(pairs_))
    counted = _with(hashed, lambda h: F.transform(h, lambda x, i: F.hash(x, i - F.array_position(h, x))))
    return texts.select("line_id", counted.alias("t"))


def _may_be_similar(na: str, nb: str, ta: str, tb: str) -> Column:
    """False only for pairs that can't be similar: an edit takes away one of the words, or two of the letter pairs."""
    most = lambda n: F.floor(n * (1 - SIMILARITY) + 1e-9)
    by_words, by_letters = F.least(na, nb) >= BY_WORDS, F.greatest(na, nb) < BY_WORDS
    limit = F.when(by_words, most(F.greatest(na, nb))).when(by_letters, 2 * most(F.greatest(F.size(ta), F.size(tb)) + 1))
    return limit.isNull() | ((F.size(F.array_except(ta, tb)) <= limit) & (F.size(F.array_except(tb, ta)) <= limit))


def nodes(lines: DataFrame) -> DataFrame:
    """(line_id, at, n_words, k0, k1, ..., n, clean): each line_id once, with the place of any one occurrence and their number.

    An id that two different lines share by chance is not clean. Plain numbers, keys in columns of their own: so that
    the aggregate hashes and doesn't sort. Occurrences have the same keys, so any goes (max needs less room than first).
    """
    firsts = [F.first(c).alias(c) for c in ("doc_id", "row", "line_no")] + [F.max(c).alias(c) for c in ("n_words", *KEYS)]
    once = lines.groupBy("line_id").agg(*firsts, F.count("*").alias("n"), (F.min("line_check") == F.max("line_check")).alias("clean"))
    return once.select("line_id", F.struct("doc_id", "row", "line_no").alias("at"), "n_words", *KEYS, "n", "clean")


def components(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, component): the lines (nodes) linked with others, by the smallest line id that can be reached over lines of
    similar text that meet. Lines of unclean ids take no part."""
    places = places.where("clean").drop("n", "clean")
    keyed = places.select("line_id", "n_words", F.explode(F.array(*KEYS)).alias("key")).where("key is not null")
    group = Window.partitionBy("key")
    members = keyed.withColumn("n", F.count("*").over(group)).where("n > 1")
    # the leader of the first round goes with each member: the group's line of least hash
    led = members.withColumn("lead", F.min_by(F.struct("line_id", "n_words"), F.xxhash64("line_id")).over(group))
    led = materialize(led.select("key", "line_id", "n_words", F.col("line_id").alias("c"), F.col("lead.line_id").alias("lead"), F.col("lead.n_words").alias("lead_words")), "members")
    pending = led.drop("lead", "lead_words")
    texts = materialize(with_codes(_texts(docs, places, pending.select("line_id").distinct())), "texts")
    found: list[DataFrame] = []

    def active() -> DataFrame:
        """The members of groups with several marks; n and main (the commonest mark) of the group beside."""
        sizes = pending.groupBy("key", "c").agg(F.count("*").alias("m"))
        groups = sizes.groupBy("key").agg(F.max_by("c", "m").alias("main"), F.sum("m").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        return pending.join(groups, "key")

    def like(na: str, nb: str) -> Column:
        """Of like length. A line under BY_WORDS words is compared by letters: its words may differ in number."""
        return (F.greatest(na, nb) < BY_WORDS) | (F.abs(F.col(na) - F.col(nb)) <= F.greatest(na, nb) * (1 - SIMILARITY) + 1e-9)

    def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
        """(a, b, ca, cb, hub): pairs of different marks and like length within groups."""
        counted = "t" in left.columns
        a = left.select("key", F.col("line_id").alias("a"), F.col("c").alias("ca"), F.col("n_words").alias("na"), *[F.col("t").alias("ta")] * counted)
        hub = F.col("main" if "main" in right.columns else "c").alias("hub")
        b = right.select("key", F.col("line_id").alias("b"), F.col("c").alias("cb"), F.col("n_words").alias("nb"), hub, *[F.col("t").alias("tb")] * counted)
        may = like("na", "nb")
        if counted:
            may &= _may_be_similar("na", "nb", "ta", "tb")
        return a.join(b, "key").where((F.col("a") != F.col("b")) & (F.col("ca") != F.col("cb")) & may).select("a", "b", "ca", "cb", "hub").dropDuplicates(["a", "b"])

    def linked(met: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        return materialize(_verified(met, texts), "links")

    def marked(rows: DataFrame, on: str, to: DataFrame) -> DataFrame:
        """rows with the mark that to (node, component) gives for column on, where it has one."""
        return rows.join(to, rows[on] == to["node"], "left").select(*[c for c in rows.columns if c != "c"], F.coalesce("component", "c").alias("c"))

    first = led.where((F.col("lead") != F.col("line_id")) & like("lead_words", "n_words"))
    first = first.select(F.col("lead").alias("a"), F.col("line_id").alias("b")).distinct()
    found.append(linked(first))
    to_leader = found[0].groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.xxhash64("a")).alias("component"))
    pending = materialize(marked(pending, "line_id", to_leader), "pending")
    left = materialize(active(), "active")
    few = left.where(F.col("n") <= SMALL)
    found.append(linked(crossed(few, few).where("a < b")).select("a", "b"))
    groups = connected_components(reduce(DataFrame.union, found))
    found.clear()
    many = left.where(F.col("n") > SMALL).select("key", "line_id", "n_words", "c")
    many = materialize(marked(many, "line_id", groups), "pending")
    # the rounds read the texts again and again, so only those of their own lines
    texts = materialize(texts.join(many.select("line_id").distinct(), "line_id", "left_semi"), "texts")
    pending = materialize(many.join(with_counted(texts), "line_id"), "pending")
    at_most = LEADERS[0]
    while True:
        rows = materialize(active(), "active")
        # lines without the group's commonest mark lead, the fewer the larger the group
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("line_id"), "line_id"))
        most = F.greatest(F.lit(LEADERS[0]), F.least(F.lit(at_most), F.floor(F.lit(ROUND_PAIRS) / F.col("n"))))
        lead = rows.where(F.col("c") != F.col("main")).withColumn("turn", turn).where(F.col("turn") <= most)
        lead = materialize(lead.select(*pending.columns), "leaders")
        if lead.isEmpty():
            break
        rest = rows.select(*pending.columns).join(lead.select("key", "line_id"), ["key", "line_id"], "left_anti")
        # a mark that is linked with the commonest mark of a group becomes that one, and so do those that its leader finds
        met = linked(crossed(lead, rows))
        found.append(met.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        near = met.where("cb = hub").select(F.col("ca").alias("node"), "hub")
        further = met.where("cb <> hub").select("ca", F.col("cb").alias("node")).join(near.withColumnRenamed("node", "ca"), "ca").where("node <> hub").select("node", "hub")
        to_hub = near.union(further).groupBy("node").agg(F.min_by("hub", F.xxhash64("hub")).alias("component"))
        pending = materialize(marked(rest, "c", to_hub), "pending")
        at_most = min(2 * at_most, LEADERS[1])
    if not found:
        return groups
    # the rounds linked marks, which are components or lines without one: only they are joined further
    joined = connected_components(reduce(DataFrame.union, found)).select(F.col("node").alias("mark"), F.col("component").alias("joined"))
    both = groups.join(joined, groups["component"] == joined["mark"], "full_outer")
    return both.select(F.coalesce("node", "mark").alias("node"), F.coalesce("joined", "component").alias("component"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, removed array<int>) by judge()."""
    with shuffles_freed(docs.sparkSession):
        return judge(docs, materialize(occurrences(docs), "lines", *PLAIN))


def judge(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, row, removed array<int>): the line numbers (from 0) that go, for documents that lose any.

    Of each connected group the first line of the smallest doc_id stays. Lines without a letter or digit stay, as do
    rows with a null doc_id or text; rows that repeat a doc_id are each judged against smaller doc_ids and themselves. Rows that repeat doc_id and text
    are judged as one row, and all of them keep the same lines.
    """
    lines = lines.where("n_words > 0")
    once = materialize(nodes(lines), "nodes", *PLAIN)
    groups = components(docs, once).select(F.col("node").alias("line_id"), "component")
    # a line that occurs once and has no link stays, whatever the others do
    judged = once.where("n > 1").select("line_id").join(groups, "line_id", "full_outer")
    # lines without a link are named by both hashes, lines with one by their component
    grouped = lines.select("doc_id", "row", "line_no", "line_id", "line_check").join(judged, "line_id").select(
        "doc_id", "row", "line_no", F.coalesce("component", "line_id").alias("g"), F.when(F.col("component").isNull(), F.col("line_check")).alias("g2")
    )
    # judged among the documents of one salt first; the first document of each salt goes on
    salted = Window.partitionBy("g", "g2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    dealt = grouped.withColumns({"first_doc": F.min("doc_id").over(salted), "first_line": F.min("line_no").over(Window.partitionBy("g", "g2", "doc_id", "row"))})
    dealt = materialize(dealt, "dealt")
    goes = (F.col("doc_id") > F.col("first_doc")) | (F.col("line_no") > F.col("first_line"))
    last = dealt.where(~goes).withColumn("first_doc", F.min("doc_id").over(Window.partitionBy("g", "g2"))).where("doc_id > first_doc")
    gone = dealt.where(goes).select("doc_id", "row", "line_no").union(last.select("doc_id", "row", "line_no"))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _without(lines: Column, removed: Column) -> Column:
    """The lines that stay: the stretches between the (sorted) numbers of those that go."""
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda i: i + 1))
    ends = F.concat(removed, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents, their texts without repeated lines; n_chars, where there is one, follows the text."""
    gone = repeated_lines(docs).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, (docs["doc_id"] == gone["__doc"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__row"]), "left")
    kept = _with(F.split("text", "\n"), lambda x: F.array_join(_without(x, F.col("__removed")), "\n"))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)
    values = {"text": text, "n_chars": F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return joined.withColumns(values).select(*docs.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A row a document: its lines, how many of them go, and which."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with shuffles_freed(spark):
        lines = materialize(occurrences(docs), "lines", *PLAIN)
        gone = judge(docs, lines)
    # every document has a first line, but for those that have no line at all or no id
    others = docs.where("doc_id is null or text is null").select("doc_id", F.xxhash64("text").alias("row"), _n_lines(F.col("text")).alias("n_lines"))
    mine = lines.where("line_no = 0").select("doc_id", "row", "n_lines").union(others)
    none = F.array().cast("array<int>")
    return mine.join(gone, ["doc_id", "row"], "left").select("doc_id", "n_lines", F.size(F.coalesce("removed", none)).alias("n_removed"), F.coalesce("removed", none).alias("removed"))
