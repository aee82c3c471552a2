"""What the steps of the line dedup carry along: only lines that they still need."""

import random
import time

from pyspark.sql import functions as F

from pixelrel.llm import lines
from pixelrel.operators import graph

from test_text_operators import similar_lines

WORDS = [a + b + c for a in ("kal", "mor", "ven", "tis") for b in ("ade", "ilo", "uro", "ena", "oby") for c in ("st", "rn", "lk", "mp", "x", "d")]


def test_line_dedup_carries_only_lines_it_needs(spark, monkeypatch):
    rnd = random.Random(3)
    passage = rnd.sample(WORDS, 30)
    common = [" ".join(rnd.sample(WORDS, 9) + passage + rnd.sample(WORDS, 9)) for _ in range(60)]
    alone = [" ".join(rnd.sample(WORDS, 20)) for _ in range(300)]
    twice = [f"once more {k} the same short line {k}" for k in range(5)]
    rows = list(enumerate(common + [f"{a}\n--" for a in alone] + twice + twice))
    dealt, texts = [], []
    table, verified = lines.materialize, lines._verified

    def recorded(df, name, *more):
        out = table(df, name, *more)
        if name == "dealt":
            dealt.append(out.count())
        return out

    def counted(pairs, of):
        texts.append({r.line_id for r in of.collect()})
        return verified(pairs, of)

    monkeypatch.setattr(lines, "materialize", recorded)
    monkeypatch.setattr(lines, "_verified", counted)
    got = {r.doc_id: r.removed for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(365 + k) == [0] for k in range(5))  # the copies of the short lines go
    # lines that occur once and have no link are not judged, and rounds over large groups read the texts of those alone
    assert 10 <= dealt[0] <= 70
    assert all(t <= texts[0] for t in texts) and len(texts[-1]) < len(texts[0])


def test_line_dedup_counts_lines_of_every_row(spark, tmp_path):
    """Null ids, null and empty texts, lines without a word and repeated rows keep their row and their number of lines."""
    rows = [(1, "one line of words\n--\n"), (1, "one line of words\n--\n"), (2, ""), (3, None), (None, "a\nb\nc"), (None, None), (4, "--"), (5, "One line, of words!\nÄ\n世")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id or 0, r.n_lines, r.n_removed, r.removed) for r in lines.op10_line_dedup(spark, str(tmp_path)).collect()))
    assert got == [(0, 0, 0, []), (0, 3, 0, []), (1, 3, 0, []), (1, 3, 0, []), (2, 1, 0, []), (3, 0, 0, []), (4, 1, 0, []), (5, 3, 1, [0])]


def test_a_star_of_links_is_contracted_in_few_rounds(spark, monkeypatch):
    """Lines linked with one leader are a star: each round costs the driver some ten jobs."""
    rounds, table = [], graph.materialize

    def counted(df, name, *more):
        rounds.append(name)
        return table(df, name, *more)

    monkeypatch.setattr(graph, "materialize", counted)
    edges = [(1000, k) for k in range(1, 600)] + [(2000 + k, 2001 + k) for k in range(3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in (*range(1, 600), 1000)}, **{2000 + k: 2000 for k in range(4)}}
    assert rounds.count("moves") <= 4


def test_line_dedup_contracts_its_links_once(spark, monkeypatch):
    """What rounds over large groups link is joined to the components before, which aren't made once more."""
    rnd = random.Random(5)
    passage = rnd.sample(WORDS, 30)
    rows = [(k, " ".join(rnd.sample(WORDS, 9) + passage + rnd.sample(WORDS, 9))) for k in range(60)]
    same = [rnd.sample(WORDS, 40) for _ in range(40)]
    rows += [(100 + 2 * k + i, " ".join(w if i == 0 or at != 7 else "other" for at, w in enumerate(words))) for k, words in enumerate(same) for i in (0, 1)]
    sizes, contract = [], lines.connected_components

    def counted(edges):
        sizes.append(edges.count())
        return contract(edges)

    monkeypatch.setattr(lines, "connected_components", counted)
    got = {r.doc_id: r.removed for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(101 + 2 * k) == [0] for k in range(40))
    assert sizes[0] >= 40 and sum(sizes[1:]) < sizes[0]


def test_line_dedup_tells_words_of_one_letter_apart(spark):
    """Words that share a character by hash are still different words."""
    words = spark.range(4000).select(F.format_string("w%d", "id").alias("w"))
    shared = words.groupBy(F.expr(f"pmod(xxhash64(w), {lines.DIFFERENT})")).agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) > 1")
    pairs = [r.w[:2] for r in shared.collect()][:20]
    assert len(pairs) == 20
    x, y = [a for a, _ in pairs], [b for _, b in pairs]
    texts = {1: x + ["end"], 2: ["more"] + y + ["end"], 3: ["more"] + x + ["end"]}
    flat = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "line_id long, line string")
    met = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [tuple(r) for r in lines._verified(met, flat).collect()] == [(1, 3)]


def test_line_dedup_leaves_no_shuffle_files(spark):
    """What a table's shuffles wrote goes with its write; else all steps' files add up until the driver collects garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key, None)
    gone = lines.repeated_lines(spark.createDataFrame([(k, f"line {k % 7} of some words\nother") for k in range(40)], "doc_id long, text string"))
    until = time.time() + 10
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key, None) == was
    assert gone.count() == 39


def test_line_dedup_codes_a_line_once(spark, monkeypatch):
    """Pairs are measured by codes that the table of texts has, also where only one line has enough words to go by words."""
    rnd = random.Random(6)
    texts = []
    for k in range(200):
        line = rnd.sample(WORDS, rnd.choice((3, 11, 12, 13, 15, 16, 17, 18, 40)))
        other = [w for w in line if rnd.random() > 0.12] or line
        texts.append((" ".join(line), " ".join(other + rnd.sample(WORDS, k % 4))))
    flat = spark.createDataFrame([(2 * k + i, t) for k, both in enumerate(texts) for i, t in enumerate(both)], "line_id long, line string")
    coded = lines.with_codes(flat)
    assert {r.line_id for r in coded.where("code is not null").collect()} == {2 * k + i for k, both in enumerate(texts) for i, t in enumerate(both) if len(t.split()) >= 12}
    met = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(200)], "a long, b long")
    want = sorted(2 * k for k, (x, y) in enumerate(texts) if similar_lines(x, y))
    coded = spark.createDataFrame(coded.collect(), coded.schema)
    monkeypatch.setattr(lines, "with_codes", None)
    assert sorted(r.a for r in lines._verified(met, coded).collect()) == want and 40 < len(want) < 180
