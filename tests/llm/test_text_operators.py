"""Operators on documents against brute force, on texts that repeat, nearly repeat, are null, empty, long or many times the same."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelrel.llm import common, decontaminate, langid, lines, packing, simhash, substring

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to") for b in ("n", "ra", "st", "ve", "lo", "ck", "th", "pe")]


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    passage = text(30)
    rows = []
    for i in range(n):
        body = [text(rnd.randint(8, 40)) for _ in range(rnd.randint(1, 4))]
        if i % 7 == 0:
            body.insert(1, passage)
        rows.append([i, "\n".join(body)])
    for i in range(n, n + 20):  # near copies of document 2
        words = rows[2][1].split(" ")
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append([i, " ".join(words)])
    rows += [[n + 20 + k, t] for k, t in enumerate([None, "", "  \n\t ", "one", "one", "Two words", "a\n\na\nA!", rows[2][1], rows[2][1], "x " * 3000, text(5000)])]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"fp": F.lit("clash"), "row": F.lit(1), "component": F.lit(2), "n_chars": F.length("text")})


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_components_without_links(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sorted_runs_keep_groups_whole():
    import pyarrow as pa

    rnd = random.Random(1)
    keys = sorted(rnd.randrange(30) for _ in range(500))
    batches, at = [], 0
    while at < len(keys):
        n = rnd.randrange(0, 40)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64())], ["k"]))
        at += n
    parts = [p["k"].tolist() for p in common.sorted_runs(iter(batches), "k")]
    assert [k for p in parts for k in p] == keys
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    f = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    parent, find = union_find(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            parent[find(max(i, j))] = find(min(i, j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (f"{int(f[i]):016x}", least[find(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("split_at", [simhash.SPLIT_AT, 1])
def test_simhash(docs, rows, monkeypatch, split_at):
    monkeypatch.setattr(simhash, "SPLIT_AT", split_at)
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.components(docs).collect()}
    assert got == slow_components(rows)


def test_simhash_of_spark_is_the_same_hash(spark):
    text = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == simhash.fingerprint(text)


def test_simhash_keeps_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (3, "")]
    got = sorted(tuple(r) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).select(F.coalesce("doc_id", F.lit(-1)), "component_id").collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 2), (3, 2)]
    kept = simhash.keep_one(spark.createDataFrame([*rows, (9, "a b c d")], "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "None"]


def slow_removal(rows):
    first, words = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words[doc] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k in range(len(words[doc]) - 12):
            first.setdefault(tuple(words[doc][k : k + 13]), doc)
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < doc:
                gone[k : k + 13] = [True] * 13
        out[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("group", [substring.GROUP, 3])
def test_substring_removal(docs, rows, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "PASSAGE", 64 if group > 3 else 2)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.text) for r in substring.remove_repeats(docs).collect()}
    want = slow_removal(rows)
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_substring_edge_rows(spark):
    same = " ".join(WORDS[:20])
    rows = [(5, same), (5, same), (5, "other"), (None, same), (7, "z " + same), (8, None)]
    got = sorted((str(r.doc_id), r.n_words, r.text) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", 20, same), ("5", 20, same), ("5", 1, "other"), ("None", 20, same), ("7", 21, "z"), ("8", 0, "")])
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def similar_lines(a, b):
    """By letters, or by words from 16 words on; nothing but the definition."""
    x, y = a.split(), b.split()
    if max(len(x), len(y)) < 16:
        x, y = a, b
    most = int(0.2 * max(len(x), len(y)) + 1e-9)
    more, less = Counter(x), Counter(y)
    # no edit takes away more than one of what only one side has
    return max((more - less).total(), (less - more).total()) <= most and edit_distance(x, y) <= most


def slow_lines(rows):
    """Brute force over all pairs of lines, by similarity alone."""
    seen, names = [], {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            w = [x for x in re.split(r"[\W_]+", line.lower()) if x]
            if w:
                seen.append((doc, k, " ".join(w)))
                names.setdefault(" ".join(w), len(names))
    keys = list(names)
    parent, find = union_find(len(names))
    for i, j in combinations(range(len(keys)), 2):
        if similar_lines(keys[i], keys[j]):
            parent[find(j)] = find(i)
    kept, out = set(), {}
    for doc, k, name in sorted(seen):
        g = find(names[name])
        if g in kept:
            out.setdefault(doc, []).append(k)
        kept.add(g)
    return out


@pytest.mark.parametrize("small", [lines.SMALL, 2])
def test_line_dedup(docs, rows, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "LEADERS", (1, 2) if small == 2 else lines.LEADERS)
    got = {r.doc_id: r.removed for r in lines.repeated_lines(docs).collect()}
    want = slow_lines(rows)
    assert got == want and len(want) > 20


def test_line_dedup_finds_substitutions(spark):
    """One or two words replaced, left out or put in, in lines of 4 to 60 words."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("lmnrstvk") for _ in range(3))
    rows = []
    for k in range(300):
        line = [word() for _ in range(rnd.choice((4, 6, 9, 14, 20, 35, 60)))]
        other = list(line)
        for _ in range(1 if len(line) < 14 else 2):
            at = rnd.randrange(len(other))
            other[at : at + 1] = rnd.choice(([], [word()], [other[at], word()])) if len(line) > 9 else [other[at][:-1] + "x"]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {b for (_, x), (b, y) in zip(rows[::2], rows[1::2]) if similar_lines(x, y)}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 250


def test_line_dedup_verifies_few_pairs_of_a_common_passage(spark, monkeypatch):
    """Lines around one passage meet in a few groups; some are similar, some not. Verified pairs grow with the lines."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("lmnrstvk") for _ in range(3))
    passage, ends = [word() for _ in range(40)], [word() for _ in range(12)]
    made = lambda k: [word() for _ in range(8)] + passage + ([word() for _ in range(9)] if k % 3 else rnd.sample(ends, 9))
    rows = [(k, " ".join(made(k) if k % 2 else passage + [word() for _ in range(5)])) for k in range(160)]
    verified, counts = lines._verified, []

    def counted(pairs, texts):
        counts.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(lines, "_verified", counted)
    got = {r.doc_id: r.removed for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_lines(rows) and 60 < len(got) < 140
    assert sum(counts) < 8 * len(rows)


def test_line_dedup_counts_never_rule_out_similar_lines(spark):
    rnd = random.Random(8)
    texts = []
    for _ in range(300):
        line = [rnd.choice(("aa", "ab", "ba", "bab", "abba")) for _ in range(rnd.choice((1, 2, 5, 14, 15, 16, 17, 20, 40)))]
        other = [w for w in line if rnd.random() > 0.08] or line
        other.insert(rnd.randrange(len(other) + 1), rnd.choice(("aa", "x")))
        texts.append((" ".join(line), " ".join(other)))
    flat = spark.createDataFrame([(2 * k + i, t) for k, both in enumerate(texts) for i, t in enumerate(both)], "line_id long, line string")
    t = {r.line_id: list(r.t) for r in lines.with_counted(flat).collect()}
    rows = [(k, len(a.split()), len(b.split()), t[2 * k], t[2 * k + 1]) for k, (a, b) in enumerate(texts)]
    may = {r.k: r.may for r in spark.createDataFrame(rows, "k int, na int, nb int, ta array<int>, tb array<int>").select("k", lines._may_be_similar("na", "nb", "ta", "tb").alias("may")).collect()}
    like = [k for k, (a, b) in enumerate(texts) if similar_lines(a, b)]
    assert all(may[k] for k in like) and len(like) > 100 and not all(may.values())


def test_line_dedup_rewrites_texts(spark):
    rows = [(1, "same line here\nother text", 26), (2, "--\nSame, line here!\n", 20), (2, "fresh words", 11), (None, "same line here", 14), (3, None, None)]
    got = {(str(r.doc_id), r.text, r.n_chars) for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert got == {("1", rows[0][1], 26), ("2", "--\n", 3), ("2", "fresh words", 11), ("None", "same line here", 14), ("3", None, None)}
    assert lines.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(5)
    item = [rnd.choice(WORDS) for _ in range(30)]
    swapped = [w if k % 9 != 4 else "swapped" for k, w in enumerate(item)]
    filler = " ".join(rnd.choice(WORDS) for _ in range(50))
    docs = [(1, f"{filler} {' '.join(item)} {filler}"), (2, f"{filler}, {' '.join(swapped).upper()}!"), (3, filler), (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(item[:16])), (7, " ".join(item[:7]))]
    bench = [(10, " ".join(item)), (11, "too short"), (12, None), (None, filler)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(d, b).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10)} and got[1, 10] == 13 and got[2, 10] in (11, 12)
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(d, b).collect()) == ["3", "4", "5", "7", "None"]
    assert decontaminate.overlaps(d.limit(0), b).count() == decontaminate.overlaps(d, b.limit(0)).count() == 0


def test_decontamination_equals_its_sql(spark, docs, rows):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    bench = [(k, rows[k][1]) for k in (0, 2, 9)]
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", bench)):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    want = set(c.execute(f"SELECT doc_id, item_id, matched, compared FROM ({decontaminate.ORACLE_SQL})").fetchall())
    got = {tuple(r) for r in decontaminate.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", "item_id", "matched", "compared").collect()}
    assert got == want and len(want) > 20


def test_packing(spark, docs, rows):
    tokenizers, tables = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    exact = tokenizers.Tokenizer.from_file(tables.path("byte_bpe_50k.json"))
    more = [(900, "a <|endoftext|> b"), (901, "tab\tand  spaces\n\né中 \U0001f600"), (None, "no id"), (902, None)]
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = packing.pack(whole, 64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in [*rows, *more]:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, s, n) for k, (s, n) in enumerate(packing.cut_points(len(ids), 64))]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces]
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_seq) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert packing.pack(whole.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_sequence():
    rnd = random.Random(2)
    lengths = np.array(sorted((rnd.randint(1, 50) for _ in range(400)), reverse=True))
    seq, offset = packing.best_fit(lengths, 50)
    room = {}
    for n, s, o in zip(lengths, seq, offset):
        fits = [r for r in room.values() if r >= n]
        assert room.get(s, 50) == (min(fits) if fits else 50) and o == 50 - room.get(s, 50)
        room[s] = room.get(s, 50) - n


def test_language_id(spark):
    rnd = random.Random(4)
    sounds = {"aa": "ka ki ko tak mik", "bb": "schl urg wend pfl", "cc": "eau oui ieux tre"}
    rows = [(i, " ".join("".join(rnd.choice(sounds[lang].split()) for _ in range(2)) for _ in range(30)), lang) for i, lang in enumerate(list(sounds) * 60)]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 !?", "bb"), (None, rows[0][1], "aa"), (503, rows[1][1] * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(i, lang) for i, _, lang in rows[:180] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out and got[i].lang_pred == lang for i, lang in held) and len(held) > 20
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {r[0] for r in rows} - {500, 501, 502}
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_kept_text_digest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b\tc"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op6_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, hashlib.sha256(b"a b c").hexdigest()), 2: (0, 0, hashlib.sha256(b"").hexdigest())}
