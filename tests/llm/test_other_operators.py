"""WARC, top-k, toxicity, HTML and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelrel.llm import common, html, queries, topk, toxicity, warc


def pages():
    big = "<p>" + "payload " * 40 + "</p>"
    rows = [(i, f"http://{'ab'[i % 2]}.Example.com:80/p/{i}?q=1#frag", f"<p>{i}</p>" * (1 + i % 90)) for i in range(300)]
    rows += [(500 + i, "https://user@hot.example.org/", big) for i in range(60)]
    rows += [(700, None, big), (701, "no url\nat all", None), (702, "http://x.y/", ""), (703, "http://x.y/", "short"), (704, "http://x.y/", "short"), (705, "http://x.y/", "é" * 60 + "\r\n\r\n")]
    return [*rows, (None, "http://x.y/", big), (None, "http://x.y/", big), (500, "https://user@hot.example.org/", big)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "digest": F.lit("clash")}).repartition(6)
    folder, shards = warc.archive(df)
    found = warc.lookup(df.select(*warc.capture_key(df)), shards, folder)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.read_records(found, folder).collect()))
    first = {}
    for page, _, text in rows:
        if page is not None and len((text or "").encode()) >= 100:
            first[text] = min(page, first.get(text, page))
    want = []
    for page, _, text in rows:
        data = (text or "").encode()
        refers = first.get(text) if page is not None and first.get(text, page) != page else None
        want.append((page if page else -1 if page is None else page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", -1 if refers is None else refers))
    norm = lambda rs: sorted((-1 if p in (0, -1) else p, *rest) for p, *rest in rs)
    assert norm(got) == norm(want)


def test_warc_looks_up_single_keys(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    folder, shards = warc.archive(df)
    asked = spark.createDataFrame([("com,example,b)/p/7?q=1", 7), ("com,example,b)/p/7?q=1", 8), ("zz", 1)], "key string, capture long")
    (record,) = warc.read_records(warc.lookup(asked, shards, folder), folder).collect()
    assert record.page_id == 7 and record.payload.decode() == "<p>7</p>" * 8 and record.url.endswith("/p/7?q=1#frag")


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder, shards = warc.archive(df)
    assert shards == [] and warc.lookup(df.select(*warc.capture_key(df)), shards, folder).count() == 0


def slow_topk(rows, every=50):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if q % every == 0:
            best = sorted(((-int(x @ y), i) for i, y in good if i != q))[:5]
            out |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("n", [3, 400])
def test_topk_is_exact(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PACK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 6) for i in range(120)]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2050, [float("nan")] * 6), (2002, [float("inf")] * 6), (None, [1.0] * 6), (2100, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash"))
    got = {tuple(r) for r in topk.search(df.where("vec_id % 50 = 0"), df).collect()}
    assert got == slow_topk(rows)


def test_topk_of_uneven_lengths_and_ties(spark):
    rows = [(50 * i, [0.0, 0.0]) for i in range(3)] + [(1 + i, [float(i % 7), 1.0]) for i in range(40)] + [(500, [1.0]), (501, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.search(df.where("vec_id % 50 = 0"), df).collect()}
    assert got == slow_topk([r for r in rows if len(r[1]) == 2])


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, one).count() == 0


def test_toxicity(spark):
    rnd = random.Random(8)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    bad = ["zzorkle", "vuxxing", "qwerpish", "xylofug", "zzorba", "yuckomat"]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        if toxic := i % 6 == 0:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "s", "ly", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (None, "zzorkle"), (2002, "zzorkle " * 5000)], "doc_id long, text string").withColumn("toxic", F.lit(9))
    known = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in got if i is not None and got[i].held_out and i < 900] and all(got[i].held_out for i in held)
    wrong = [i for i in held if got[i].predicted != labels[i][1]]
    assert len(wrong) <= len(held) // 50
    assert got[2000].score == got[2001].score < 0.3 and got[2002].predicted == 1
    none = toxicity.score(docs, toxicity.train(docs, known.limit(0))).collect()
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in none)


def test_toxicity_of_words_that_count_only_when_dense(spark):
    rnd = random.Random(11)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(400)]
        for _ in range(8 if i % 5 == 0 else rnd.randint(0, 1)):  # every clean text may have the word once
            words[rnd.randrange(len(words))] = "mulmo" + rnd.choice(["", "rat", "sin"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known)).where("held_out").collect()
    assert len(got) > 200 and sum(r.predicted != int(r.doc_id % 5 == 0) for r in got) <= len(got) // 50


def test_dense_terms():
    assert toxicity.terms("") == set()
    text = "Foobar " + "x " * (toxicity.DENSE - 1)
    assert {"foobar", "+foobar", "foob*", "+foob*", "x", "+x"} <= toxicity.terms(text)
    assert {"foobar", "foob*"} <= toxicity.terms(text + "x") and not {"+foobar", "+foob*"} & toxicity.terms(text + "x")


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda hit, miss: np.where(y, rng.random(4000) < hit, rng.random(4000) < miss)
    a, b = vote(0.9, 0.05), vote(0.6, 0.2)
    post, voters = toxicity.label_model(np.column_stack([a, a, b]), y ^ (rng.random(4000) < 0.1))
    assert ((post > 0.5) == y).mean() > 0.9
    assert voters["correlation"][0, 1] > 0.9 > 0.3 > voters["correlation"][0, 2]
    assert voters["discount"][0] < voters["discount"][2]


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad-banner">Buy &amp; save</div><div id=cookie-notice>We use cookies</div>
<article><header><h1>Title &eacute;</h1></header><p>First   <b>bold</b>
text<p>Second<br>line &#8212; end.<form>Mail<input></form><aside>Related</aside><p>Er.</p><section class="comments"><p>I disagree with all of this very long article</p></section></article>
<footer>&copy; Site</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Title é First bold text Second line — end. Er."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>Menu</nav>") == ""
    plain = "<body><ul><li><a>x</a></li><li><a>y</a></li></ul><div>" + "<p>A paragraph of plain text without an article element.</p>" * 4 + "</div></body>"
    assert html.main_text(plain).count("A paragraph of plain text") == 4
    assert html.main_text("<article><p>" + "long " * 50_000 + "</p></article>").count("long") == 50_000
    assert html.main_text("<article><p>cut off in the middle of a tag <b") == "cut off in the middle of a tag"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.url, len(r.text)) for r in html.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", 46), (1, "u", 46), (None, None, 0)], key=str)


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_every_operator_is_registered_once():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    leak, copied, line = text(40), text(60), text(12)
    rows = [(i, text(50), "en", "s", 1) for i in range(40)]
    rows += [(100, copied, "en", "s", 1), (101, copied, "en", "s", 1), (102, "123 456", "en", "s", 1), (103, f"{text(20)} {leak} {text(20)}", "en", "s", 1), (104, f"{line}\n{text(30)}", "en", "s", 1), (105, f"{line}\n{text(30)}", "en", "s", 1), (106, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.materialize(stage(spark, kept, str(tmp_path)), name)
        seen[name] = {r.doc_id for r in kept.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in kept.collect()}
            assert line in texts[104] and line not in texts[105]
            assert texts[101] == ""  # its one line stays in 100
    everything = {r[0] for r in rows}
    assert seen["language_id"] == everything - {102, 106}
    assert seen["line_dedup"] == seen["language_id"]
    assert seen["near_dedup"] == seen["line_dedup"]
    assert seen["decontamination"] == seen["near_dedup"] - {103}
    assert seen["best_fit_packing"] == seen["decontamination"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in again.select("doc_id").collect()} == seen["best_fit_packing"]
