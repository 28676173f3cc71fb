"""Each operator against a brute-force version on small inputs, and on rows that are null, empty, long, repeated or missing."""

import html as html_module
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chunklake.llm import audio, common, components, decontam, langid, line_dedup, main_text, mixing, quality, shards, simhash, toxicity
from chunklake.llm.common import crc_mod

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, score double, size long, label int, `count` long, hits string"


def frame(spark, rows):
    """Documents with odd further columns."""
    return spark.createDataFrame([(i, t, lang, src, 1.0, 1, 1, 1, "x") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", "src1"), (2, "", "en", None), (3, " \n\t ", None, "src1"), (4, long, "en", "src1"), (5, long, "en", "src1"), (5, long, "en", "src1"), (None, "a null id here", "en", "src2"), (None, None, None, None), (9, "퟿ é 漢字 \x00 end", "fr", "src2"), (10, "###", "en", "src9"), (11, "x", "en", "src9")]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()


# --- 1 line dedup


def test_lines_by_hand(spark, odd, none):
    rows = [(i, f"top\nbody {i}\n\nfoot" if i < 9 else "top\nother", "en", "s") for i in range(10)] + [(20, "top\na", "en", "t"), (21, "top\nb", "en", "t")]
    got = {r.doc_id: r.line_dedup for r in line_dedup.drop_boilerplate(frame(spark, rows), F.col("source"), 0.9, 3).collect()}
    assert (got[0].text, got[0].n_lines, got[0].n_dropped) == ("body 0\n\nfoot", 4, 1)  # foot: 0.9 isn't over the ratio
    assert got[20].text == "top\na"  # too few pages
    out = line_dedup.drop_boilerplate(odd, F.col("source"), 0.01, 3)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "line_dedup"]
    assert out.filter("doc_id = 1").first().line_dedup[:] == (None, 0, 0)
    assert line_dedup.drop_boilerplate(none, F.col("source")).count() == 0


def test_lines_without_broadcast(spark, docs, monkeypatch):
    a = sorted((r.doc_id, r.line_dedup.text) for r in line_dedup.drop_boilerplate(docs, F.col("source")).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_SITES", 0)
    assert a == sorted((r.doc_id, r.line_dedup.text) for r in line_dedup.drop_boilerplate(docs, F.col("source")).collect())


def test_hosts(spark):
    urls = {"https://Me@A.example.org:80/x?y": "a.example.org", "http://b.net": "b.net", "nothing": "", None: ""}
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.host(F.col("u"))).collect()] == list(urls.values())


# --- 2 language


def test_language(spark, docs, odd, none):
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held))
    out = langid.identify(docs, model).filter(held).select("lang", "language.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.language for r in langid.identify(odd, model).filter("doc_id is not null").collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and got[9].lang_pred in model.languages
    assert langid.identify(odd, model).count() == odd.count()
    empty = langid.fit(none)
    assert {r.language.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    langid.fit(odd)


def test_no_letter_is_und(spark, docs):
    """Letters are those of category L; numbers in superscript, circles and fractions, marks and signs aren't."""
    model = langid.fit(docs)
    texts = {"²": "und", "½ ①": "und", "١٢": "und", "_ - 5": "und", "\u0301": "und", "ª": None, "漢": None, "ǅ": None}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(rows, model).collect():
        assert (r.language.lang_pred == "und") == (texts[r.text] == "und"), r.text


def test_nearest_centroid_equals_brute_force(docs):
    """Each text's cosine with every centroid, by hashes of its n-grams counted one at a time."""
    model, rows = langid.fit(docs), docs.limit(40).collect()

    def bucket(gram):
        h = gram[0] * 0x9E3779B1 ^ gram[1] * 0x85EBCA77
        if len(gram) == 3:
            h = (h & 0xFFFFFFFF) * 0x27D4EB2F ^ gram[2] * 0x165667B1
        return (h & 0xFFFFFFFF) >> 19

    language, score, _ = model.predict(pa.array([r.text for r in rows]))
    for r, name, cosine in zip(rows, language, score, strict=True):
        kept = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in f" {r.text.lower()} ".encode())
        while b"  " in kept:
            kept = kept.replace(b"  ", b" ")
        grams = Counter(bucket(kept[i : i + n]) for n in (2, 3) for i in range(len(kept) - n + 1))
        x = np.zeros(langid.BUCKETS)
        for b, n in grams.items():
            x[b] = np.sqrt(n) * model.idf[b]
        near = model.centroids @ (x / np.linalg.norm(x))
        assert abs(near.max() - cosine) < 1e-4 and (model.languages[int(near.argmax())] == name or np.sort(near)[-2] > near.max() - 1e-4)


def test_ngrams_by_hand():
    text = "Ab1c é"
    counts = langid.ngram_counts(pa.array([text, None, ""]))
    assert counts.shape == (3, langid.BUCKETS)
    padded = " ab c é ".encode()
    assert counts[0].sum() == 2 * len(padded) - 3 and counts[2].sum() == 0
    alone = langid.ngram_counts(pa.array(["zz", text, "the quick brown fox"]))
    assert (alone[1] == counts[0]).all()


# --- 3 audio


def test_keys_shared_in_a_row_meet_once(spark, monkeypatch):
    """Near copies: every offset with a shared key comes out, once for each row of shared keys."""
    rng, rows = np.random.default_rng(3), [(0, [7, 7, 7]), (1, [7] * 9), (2, [1, 2, 1, 2, 1, 2]), (3, [2, 1, 2, 1])]
    base = rng.integers(-5, 5, 60)
    for i in range(4, 24):
        near = base.copy()
        near[rng.integers(0, 60, 2)] = 2**31 - 1
        rows.append((i, [int(x) for x in near[i % 3 :]]))
    found = spark.createDataFrame(rows, "node long, prints array<int>")

    def keys(p):
        runs = [k for k in range(len(p)) if k == 0 or p[k] != p[k - 1]]
        return [(0, p[0])] if len(runs) == 1 else [(a, (p[a], p[b], b - a)) for a, b in zip(runs, runs[1:], strict=False)]

    want, alone = set(), 0
    for q, a in rows:
        for node, b in rows:
            shared = [t - s for s, x in keys(a) for t, y in keys(b) if x == y and q != node]
            want |= {(q, node, offset) for offset in shared}
            alone += len(shared)
    for most in (audio.BROADCAST_ROWS, 0):
        monkeypatch.setattr(audio, "BROADCAST_ROWS", most)
        monkeypatch.setattr(audio, "HOT", 5)
        posted = audio._postings(found)
        got = [tuple(r) for r in audio._met(posted.withColumnRenamed("node", "q"), posted).collect()]
        assert set(got) == want and len(got) < alone / 3, (len(got), len(want), alone)


def test_search_equals_brute_force(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(150).toPandas()
    rng, rows = np.random.default_rng(1), []
    for i, v in enumerate(e.embedding):
        rows.append((i, [float(x) for x in v]))
        if i % 10 == 0:  # a copy that begins later, and a noisy one
            rows.append((1000 + i, [float(x) for x in v[6:]]))
            rows.append((2000 + i, [float(x + y) for x, y in zip(v, rng.normal(0, 0.004, len(v)), strict=True)]))
    short = [float(x) for x in e.embedding[3][:11]]  # under OVERLAP frames
    rows += [(5001, None), (5003, [0.5]), (None, rows[0][1]), (5100, short), (5101, [*short, 0.9]), (None, [*short, 0.9])]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", decode=audio.notes).cache()
    p = {r.id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.filter("id is not null").collect()}
    member = {r.id: r.class_id for r in audio.membership(prints).collect()}
    for most in (audio.BROADCAST_ROWS, 0):  # a broadcast, and a salted shuffle join
        monkeypatch.setattr(audio, "BROADCAST_ROWS", most)
        monkeypatch.setattr(audio, "HOT", 5)
        rows_ = audio.search(prints, F.col("id") % 20 == 0).collect()
        got = defaultdict(dict)
        for r in rows_:
            got[r.id] |= {r.match_class: r} if r.n_recordings else {}
        want = defaultdict(set)
        for q in (i for i in p if i % 20 == 0):
            for i in p:
                shorter = min(len(p[q]), len(p[i]))
                least = max(min(audio.OVERLAP, shorter), shorter / 2, 1)
                for offset in range(-len(p[q]), len(p[i])):
                    errors, n = audio.align(p[q], p[i], offset)
                    if i != q and n >= least and errors <= audio.BIT_ERRORS * min(1, n / audio.OVERLAP):
                        want[q].add(member[i])
        assert {r.id for r in rows_} == {i for i in p if i % 20 == 0}
        own = {q: {member[q]} for q in p}  # whose other rows are counted, below
        assert all(set(got[q]) - own[q] <= want[q] for q in p)
        pairs = sum(len(want[q] - own[q]) for q in p)
        found_pairs = sum(len(set(got[q]) - own[q]) for q in p)
        assert found_pairs >= 0.9 * pairs > 9, (found_pairs, pairs, {q: (len(p[q]), len(got[q]), len(want[q])) for q in want if len(got[q]) < len(want[q])}, want[80], len(p[5100]), len(p[5101]))
        for q, found in got.items():
            for c, r in found.items():
                if c != member[q]:
                    assert (r.bit_errors, r.frames) == pytest.approx(audio.align(p[q], p[c], r.offset))
        assert got[0][0].n_recordings == 1 and got[5100][5101].n_recordings == 2 and got[5100][5101].offset == 0  # a null id counts; short ones match


def test_search_of_odd_tables(spark):
    silent = b"\0\0" * 60_000
    rng = np.random.default_rng(5)
    long = (rng.normal(0, 3000, 400_000)).astype("<i2").tobytes()
    rows = [(0, silent), (1, silent), (2, silent[:-4000]), (20, long), (20, long), (3, long[200_000:]), (40, None), (60, b""), (None, long), (None, None)]
    d = spark.createDataFrame([(i, m, 1, "x", 2) for i, m in rows], "id long, media binary, node long, prints string, q int")
    prints = audio.fingerprints(d, "id", "media").cache()
    got = {(r.id, r.match_class): r.n_recordings for r in audio.search(prints, F.col("id") % 20 == 0).collect()}
    assert got == {(0, 0): 1, (0, 2): 1, (20, 20): 2, (20, 3): 1, (40, None): 0, (60, None): 0}
    short = {r.id: (r.n_matches, r.n_classes, r.best_class) for r in audio.summary(audio.search(prints, F.col("id") % 20 == 0)).collect()}
    assert short == {0: (2, 2, 0), 20: (3, 2, 20), 40: (0, 0, None), 60: (0, 0, None)}
    none = audio.fingerprints(d.limit(0), "id", "media")
    assert audio.search(none, F.col("id") % 20 == 0).count() == 0 and audio.membership(none).count() == 0
    assert audio.membership(prints).count() == len(rows)


def test_pcm_and_silence():
    assert len(audio.pcm(None)) == 0 and audio.pcm(b"\x01\x00\x02").tolist() == [1]
    assert audio.chroma(np.zeros(5000, np.int16), 4000).sum() == 0
    assert len(audio.fingerprint(np.zeros((15, 12)))) == 0 and len(audio.fingerprint(np.zeros((16, 12)))) == 1
    c = audio.chroma(audio.notes([0.0] * 8), 4000)
    assert c.shape[1] == 12 and set(c[2:-2].argmax(axis=1)) == {6}


# --- 4 decontamination


def brute_contamination(docs, items, width=10):
    found = {}
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            wins[tuple(w[k : k + width])].add(i)
    for i, t in docs:
        w, hit, ids = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in own if x is not None}
        found[i] = (len(w), len(hit), sorted(ids))
    return found


def contaminated(df):
    return {r.doc_id: (r.contamination.n_words, r.n, list(r.contamination["items"])) for r in df.withColumn("n", decontam.n_hit()).collect()}


def test_contamination_equals_brute_force(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert contaminated(decontam.contamination(docs, items)) == want and any(v[1] for v in want.values())
    assert contaminated(decontam.contamination(docs, items, block_nodes=5000)) == want


def test_contamination_odd(spark, odd, none):
    a = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, a), (2, "Short ITEM"), (2, "Short ITEM"), (3, None), (4, "!!"), (None, "null id item"), (7, " ".join(f"w{i}" for i in range(2, 12)))], "item_id long, text string")
    texts = [(1, f"x {a.upper()} y"), (2, "a short-item here"), (3, "shorter item"), (4, "null id item"), (5, ", ".join(a.split()[:9])), (6, "w0 " * 12), (7, "é " + a + " " + a), (8, None), (9, "")]
    d = frame(spark, [(i, t, "en", "s") for i, t in texts])
    got = decontam.contamination(d, items)
    assert got.columns == [*d.columns, "contamination"]
    assert contaminated(got) == brute_contamination(texts, [tuple(r) for r in items.collect()])
    spans = {r.doc_id: [r.text[s.start : s.end] for s in r.spans] for r in decontam.with_spans(got).collect()}
    assert spans[1] == [a.upper()] and spans[2] == ["short-item"] and spans[8] == [] and spans[7] == [a + " " + a]
    assert decontam.drop_contaminated(odd, items.limit(0)).count() == odd.count()
    assert decontam.contamination(odd, items).count() == odd.count() and decontam.contamination(none, items).count() == 0
    assert {r.doc_id for r in decontam.drop_contaminated(d, items).collect()} == {3, 5, 6, 8, 9}


def test_long_benchmark_items(spark, monkeypatch):
    """An item of many pieces, dealt into several automata, finds each of its windows; its memory stays small."""
    words = [f"w{i * 7919 % 100_003}" for i in range(900)]
    monkeypatch.setattr(decontam, "PIECE", 100)
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:7]))], "item_id long, text string")
    texts = [(k, " ".join(["x", *words[k : k + 10], "y"])) for k in range(0, 891, 11)] + [(5000, " ".join(words)), (5001, " ".join(words[200:209]))]
    got = contaminated(decontam.contamination(frame(spark, [(i, t, "en", "s") for i, t in texts]), items, block_nodes=2500))
    assert got == brute_contamination(texts, [tuple(r) for r in items.collect()])
    tracemalloc.start()
    a = decontam.Automaton([(str(i), " ".join(f"w{(i * 97 + j * j) % 50_021}" for j in range(500))) for i in range(100)], 10)
    assert len(a.found) > 45_000 and tracemalloc.get_traced_memory()[0] < 100e6


# --- 5 sharding


def check_shards(rows, n_shards=24):
    sizes = Counter(r.shard for r in rows)
    if rows:
        counts = [sizes.get(s, 0) for s in range(n_shards)]
        assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_shards(spark, docs, odd, none):
    rows = shards.shard(docs).collect()
    check_shards(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == crc32(text[r.doc_id].encode()) for r in rows)
    where = defaultdict(Counter)
    for r in rows:
        where[r.text_crc32][r.shard] += 1
    many = [c for c in where.values() if sum(c.values()) > 1]
    assert sum(max(c.values()) for c in many) >= 0.9 * sum(sum(c.values()) for c in many)
    check_shards(shards.shard(odd).collect())
    assert shards.shard(odd).count() == odd.count() and shards.shard(none).count() == 0


def test_shards_split_a_large_group(spark):
    d = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)], "doc_id long, text string")
    rows = shards.shard(d, 6).collect()
    check_shards(rows, 6)
    same = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert sum(sorted(same.values())[-3:]) >= 0.9 * 1000  # in as few shards as hold it, nearly


@pytest.mark.parametrize("linked", [0.9, 1.0])
def test_shards_of_mostly_copies(spark, linked):
    """Groups of 2, 5 and 20 copies: hardly any is cut, although no shard has room to spare."""
    n = 6000
    many = int(n * linked)
    text = [f"g{i // (2, 5, 20)[i * 3 // many]}-{i * 3 // many}" if i < many else f"alone {i}" for i in range(n)]
    rows = shards.shard(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()
    check_shards(rows)
    where = defaultdict(Counter)
    for r in rows:
        where[text[r.doc_id]][r.shard] += 1
    groups = [c for c in where.values() if sum(c.values()) > 1]
    assert sum(len(c) > 1 for c in groups) <= 0.05 * len(groups)
    assert sum(sum(c.values()) - max(c.values()) for c in groups) <= 0.04 * many


def test_flows():
    assert shards.flows({(0, 1): 10, (1, 0): 10}, [0, 0]) == {(0, 1): 10, (1, 0): 10}  # places are changed
    assert shards.flows({(0, 1): 10, (1, 0): 4}, [0, 0])[0, 1] == pytest.approx(4, abs=0.1)
    assert shards.flows({(0, 1): 10}, [0, 3])[0, 1] == pytest.approx(3, abs=0.1)
    rng = np.random.default_rng(6)
    for _ in range(20):
        wanted = {(a, b): int(rng.integers(0, 100)) for a in range(6) for b in range(6) if a != b}
        room = rng.integers(0, 30, 6).tolist()
        got = shards.flows(wanted, room)
        for s in range(6):
            come, go = (sum(x for k, x in got.items() if k[i] == s) for i in (1, 0))
            assert come <= (room[s] + go) * 1.01 + 0.1
        assert all(0 <= got.get(k, 0) <= n for k, n in wanted.items())


# --- 6 main text


def test_main_text_of_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = main_text.main_text(pages, main_text.fit(pages)).collect()

    def plain(page):
        body = re.search("<article>(.*?)(</article>|$)", page, re.S)
        parts = re.split("</?(?:p|h1)>", body[1]) if body else []
        return "\n".join(x for p in parts if (x := " ".join(html_module.unescape(re.sub("<[^>]*>", "", p)).split())))

    assert [r.main_text for r in out] == [plain(r.html) for r in out]


@pytest.mark.parametrize("weights", ["learned", "published"])
def test_main_text_by_hand(spark, sf, weights):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    w = main_text.fit(pages) if weights == "learned" else {}
    for odd in (None, "", "<", "<p", "</article>", "<script>x", "<!-- x", "<p>" * 2000, "&amp;"):
        main_text.extract(odd or "", w)
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2><a href=/>Home</a></header><nav><ul><li><a>One</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><main><h1>Real title</h1><p>First paragraph &amp; more, with a good number of words in it to read.</p>"
        "<aside>Buy this</aside><div class=ad-box><div>inner</div>Advert</div><p>Second <b>para</b>graph\n goes   on, &lt;so&gt; it does, for a while longer.</p><form><input>Mail</form></main>"
        "<section id=comments><p>A reader says a great many things here, at length, and to no end.</p></section><footer>(c)</footer></body></html>"
    )
    text = main_text.extract(page, w)
    assert "First paragraph & more, with" in text and "Second paragraph goes on, <so> it does" in text
    for bad in ("Site", "Home", "One", "cookies", "Buy", "Advert", "Mail", "reader", "(c)"):
        assert bad not in text
    comments = page.replace("<section id=comments>", "<section id=comments><article class=comment>").replace("</section>", "</article></section>")
    assert "reader" not in main_text.extract(comments, w)
    unclosed = "<body><nav><li>One<article><p>The words of the article, which are many and go on for a while.</p></article></body>"
    assert main_text.extract(unclosed, w).startswith("The words")
    assert main_text.best_run([]) == (0, 0) and main_text.best_run([-1, 2, -1, 2, -5, 3]) == (1, 4)


@pytest.mark.parametrize("weights", ["learned", "published"])
def test_main_text_loses_nothing(spark, sf, weights):
    """Whatever stands in an article, but for what names itself boilerplate, is kept."""
    w = main_text.fit(spark.read.parquet(f"{sf}/pages.parquet")) if weights == "learned" else {}
    before, after = "<nav><a>Home</a></nav><article><p>The first paragraph has some words.</p>", "<p>The second paragraph comes after it.</p></article><footer>(c)</footer>"
    kept = {
        '<h2 id="related-work">Related work</h2>': "Related work", '<h2 id="share-prices">Share prices</h2>': "Share prices", '<section id="search"><p>A search.</p></section>': "A search.",
        '<p class="alert">Look out!</p>': "Look out!", '<svg-icon name="x"></svg-icon>': "", "<title-bar>Bar</title-bar>": "Bar", "<template-x>X</template-x>": "X", "<svg/>": "", "<script src=x />": "",
        "<p>It is <math><mi>x</mi></math> here.</p>": "It is x here.", "<table><tr><th>a<th>b<tr><td>1</td><td>2</td></table>": "a b\n1 2", "<xmp><b>&amp;</xmp>": "<b>&amp;", "<p title=Bob's>one</p>": "one",
        '<p title=">">two</p>': "two", "<p>a < b <3</p>": "a < b <3", "<header><h2>A head</h2></header>": "A head", "<ul><li>one<li>two</ul>": "one\ntwo", "<!--> <p>three</p>": "three", "<noscript>": "",
        '<section id="comments-on-the-theory"><p>Some say so.</p></section>': "Some say so.", "<p>x&nbsp;&eacute;\n y</p>": "x é y", '<ol class="refs"><li><a href=x>A link</a><li><a>Another</a></ol>': "A link\nAnother",
        "".join(f"<table><tr><td>{i}</td><td></td><td></td></tr></table>" for i in range(60)): "\n".join(map(str, range(60))),
    }
    for html, text in kept.items():
        want = "\n".join(x for x in ("The first paragraph has some words.", text, "The second paragraph comes after it.") if x)
        assert main_text.extract(before + html + after, w) == want, html
        assert main_text.extract(f'<body><form id="aspnetForm"><div class="menu">Menu</div>{before}{html}{after}</form>', w).endswith("comes after it.")
    for html in ("<aside><p>Buy this now, it is very cheap and good.</p></aside>", "<div class=comments><p>I say a thing or two.</p></div>", "<nav><p>All of it</p></nav>", '<div class="adBox"><p>Cheap</p></div>', "<form><p>Your name</p></form>", "<div role=navigation>Go</div>"):
        assert main_text.extract(before + html + after, w) == "The first paragraph has some words.\nThe second paragraph comes after it.", html


def test_main_text_is_linear():
    for piece in ('<div class="', "<a b='\">", '<a =">"', "<article>", "<nav><article>", "<!--", "<script>", "<script/>", "</div>", "<", "<p", "<noscript>", "<div>", "&lt"):
        began = time.process_time()
        main_text.extract(piece * (1_000_000 // len(piece)), {})
        assert time.process_time() - began < 15, piece


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(4)
    for n in [*range(9), 40] * 5:
        scores = rng.integers(-3, 4, n).tolist()
        best = max([(sum(scores[i:j]), -j, i) for i in range(n) for j in range(i + 1, n + 1) if sum(scores[i:j]) > 0], default=(0, 0, 0))
        assert main_text.best_run(scores) == (best[2], -best[1])


def test_main_text_frames(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "<p>hello there</p>", "y")], "page_id long, html string, main_text string")
    assert [r.main_text for r in main_text.main_text(d, {}).orderBy("page_id").collect()] == ["", "hello there"]
    assert main_text.fit(d.limit(0)) == {} and main_text.main_text(d.limit(0), {}).count() == 0


# --- 7 near duplicates


def brute_fingerprint(text, width=3):
    w = (text or "").translate(LOW).encode()
    w = w.split()
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def brute_groups(fps, budget=3):
    at = list(range(len(fps)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                at[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, brute_groups(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("piece", [2, 20_000])
def test_trie_equals_brute_force(spark, piece):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)})
    d = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "id long, fp binary")
    got = {int.from_bytes(bytes(r.fp), "big"): r.component for r in simhash.groups(d, 3, 4, piece).collect()}
    assert got == {f: g for f, g in zip(fps, brute_groups(fps), strict=True)}


def test_near_duplicates_odd(spark, odd, none):
    out = simhash.near_duplicates(odd)
    assert out.count() == odd.count() and simhash.near_duplicates(none).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].fingerprint == "0" * 16 and got[3].component_id == 1 and got[5].component_id == 4
    assert got[11].fingerprint == f"{brute_fingerprint('x'):016x}"


def test_drop_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[vocabulary[i] for i in rng.integers(0, 3000, 300)] for _ in range(30)]
    rows = []
    for k, words in enumerate(base):
        rows.append((k, " ".join(words)))
        rows.append((100 + k, " ".join(words)))
        near = list(words)
        for i in rng.choice(300, 5, replace=False):  # Jaccard of five-word shingles about 0.85
            near[i] = "changed"
        rows.append((200 + k, " ".join(near)))
        half = words[:150] + [vocabulary[i] for i in rng.integers(0, 3000, 150)]
        rows.append((300 + k, " ".join(half)))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(30), *range(300, 330)}
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 4, 9, 10, 11]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_drop_near_duplicates_ids(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (None, c), (7, c), (8, "one text"), (8, "another text"), (9, "another text"), (5, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1_000_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(common, "BROADCAST_IDS", most)
        kept = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
        assert sorted((str(i), t) for i, t in kept if t not in (a, a + " end")) == [("5", "another text"), ("7", c), ("None", b)]
        assert sum(t in (a, a + " end") for _, t in kept) == 1


def test_many_near_copies(spark):
    """3,000 copies of one text with one word changed each, cut into chunks by rows, and then by bytes."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[: i % 100], f"x{i}", *words[i % 100 + 1 :]])) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (4000, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs, chunk=500).collect()} == {0, 4000}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(500, 500 + i) for i in range(200)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 if i <= 300 else 500 for i in [*range(301), *range(500, 700)]}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 8 toxicity


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    t = np.array([[0.3, -0.8], [-0.5, 1.7]])
    lengths = np.array([1, 0, 5, 400, 3, 70])
    e = rng.normal(0, 2, lengths.sum())
    got = toxicity.Model({}, 0.0, t).marginals(e, lengths)
    at = 0
    for n in lengths:
        x = e[at : at + n]
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        for k in range(n):
            f[k] = [0, x[k]] if k == 0 else np.logaddexp(f[k - 1, 0] + t[0], f[k - 1, 1] + t[1]) + [0, x[k]]
        for k in range(n - 2, -1, -1):
            b[k] = np.logaddexp(t[:, 0] + b[k + 1, 0], t[:, 1] + x[k + 1] + b[k + 1, 1])
        if n:
            p = f + b
            want = 1 / (1 + np.exp(p[:, 0] - p[:, 1]))
            assert np.allclose(got[at : at + n], want, atol=1e-9)
        at += n


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abdeghklmnoprstu"), 6)) for _ in range(400)]
    rows, marks = [], []
    for i in range(400):
        text = [words[k] for k in rng.integers(0, 400, 60)]
        if bad := i % 4 == 0:
            for k in rng.choice(60, 3, replace=False):
                text[k] = str(rng.choice(["Vile!", "awful", "nastyone"]))
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, quality.learn_fold(labels))
    out = toxicity.score(d, model).join(labels, "doc_id").filter(crc_mod("doc_id", 3) == 1).collect()
    assert all((r.toxicity.score >= 0.7) == (r.toxic == 1) for r in out)
    for r in out:
        assert {r.text[s.start : s.end].lower().strip("!") for s in r.toxicity.spans} == set(r.text.lower().replace("!", "").split()) & {"vile", "awful", "nastyone"}
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and {r.doc_id: r.toxicity.score for r in got.collect()}[1] == 0.0
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, labels)
    assert max(r.toxicity.score for r in toxicity.score(odd, blank).collect()) < 0.5
    toxicity.fit(d, labels.filter("toxic = 1"))
    toxicity.fit(odd, labels)


# --- 9 mixing


def test_budgets_by_hand(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 10), ("b", "y", "3", 100), ("c", "z", "4", 0)], "domain string, lang string, source string, tokens long")
    w = {"a": 1, "b": 1, "a/x": 1, "b/y": 1, "a/x/1": 1, "a/x/2": 1, "b/y/3": 1}
    got = {r.source: r.budget for r in mixing.budgets(leaves, 0.5, 1, w).collect()}
    assert got == {"1": 43, "2": 10, "3": 52}  # leaf 2 is short, its sibling takes the rest; domain a gets the odd token
    got = {r.source: r.budget for r in mixing.budgets(leaves, 0.9, 1, {**w, "b": 9}).collect()}
    assert got == {"1": 79, "2": 10, "3": 100}  # b is short as a whole, a takes the rest
    anywhere = {r.source: r.budget for r in mixing.budgets(leaves, 0.2, 1, {"a": 1, "b": 3, "*/1": 9, "*/2": 1}).collect()}
    assert anywhere == {"1": 10, "2": 1, "3": 31}
    dealt = mixing.budgets(spark.createDataFrame([("d", "l", f"s{i:02}", 1000 + i) for i in range(37)], "domain string, lang string, source string, tokens long"), 0.5, 1)
    assert sum(r.budget for r in dealt.collect()) == sum(1000 + i for i in range(37)) // 2  # no token is lost


def test_mix(spark, docs, odd, none):
    rows = mixing.mix(docs, 1.5, 2).collect()
    leaf = defaultdict(list)
    for r in rows:
        leaf[r.domain, r.lang, r.source].append(r)
    for own in leaf.values():
        used = sum(r.tokens * r.copies for r in own)
        assert used <= own[0].budget and all(0 <= r.copies <= 2 for r in own)
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
        more = [r for r in own if r.copies == min(x.copies for x in own)]
        assert used == own[0].budget or own[0].budget - used < max((r.tokens for r in more), default=1)
    out = mixing.mix(odd)
    assert out.count() == odd.select("doc_id", "lang", "source").distinct().count() and mixing.mix(none).count() == 0
    assert sorted(map(str, mixing.mix(docs, 0.5).collect())) == sorted(map(str, mixing.mix(docs.repartition(7), 0.5).collect()))


def test_mix_does_not_depend_on_buckets(spark, docs, monkeypatch):
    want = sorted(map(str, mixing.mix(docs, 0.5).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix(docs, 0.5).collect())) == want


# --- 10 quality


def test_quality(spark, docs, labels, odd, none):
    model = quality.fit(docs, quality.learn_fold(labels))
    out = quality.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in out if crc32(str(r.doc_id).encode()) % 3 == 1]) > 0.9
    got = quality.score(odd, model)
    assert got.count() == odd.count() and got.columns == [*(c for c in odd.columns if c != "score"), "score"]
    assert {r.doc_id: r.score for r in got.collect()}[2] == 0.0
    assert quality.score(none, model).count() == 0
    blank = quality.fit(none, labels)
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}
    quality.fit(odd, labels.union(labels))


def test_votes_equal_brute_force(docs, labels):
    model = quality.fit(docs, labels)
    counts = quality.term_counts(pa.array([r.text for r in docs.limit(20).collect()]))
    for c, s in zip(counts, model.scores(counts), strict=True):
        near = sorted(((float(v @ model.latent(c[None])[0]), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(x, 0) ** quality.SHARPNESS for x, _ in near]
        assert abs(sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w) - s) < 1e-3


def test_terms_by_hand():
    texts = ["Ab ab ab x1!", None, "", "ab"]
    counts = quality.term_counts(pa.array(texts))
    token = [quality._token(w) for w in texts[0].split()]
    want = Counter(t // quality.WORDS for t in token)
    want.update(quality.SHAPES + (a // quality.WORDS * 31 + b // quality.WORDS) % quality.PAIRS for a, b in pairwise(token))
    want.update(quality.SHAPES + quality.PAIRS + quality.REPEATS + t % quality.WORDS for t in token)
    want[quality.SHAPES + quality.PAIRS + 1] += 1
    assert {i: int(n) for i, n in enumerate(counts[0]) if n} == dict(want)
    assert not counts[1:3].any() and counts[3].sum() == 2
    alike = quality.term_counts(pa.array(["x" * 64 + "1a" * 40 + end for end in ("b", "?", "B9" * 100)]))
    assert len({c.tobytes() for c in alike}) == 3  # the whole of a long token counts
    assert (quality.term_counts(pa.array(["ab" * 64]))[0, : quality.SHAPES].sum(), quality.term_counts(pa.array(["ab" * 32]))[0, : quality.SHAPES].sum()) == (2, 1)


# --- pipeline stages on odd and empty tables


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, sf, odd, none, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, sf)
    assert out.count() <= odd.count()
    if k < 4:
        assert out.columns == odd.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd.collect()}
    else:
        check_shards(out.collect())
    assert stage(spark, none, sf).count() == 0


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("chunk", [10, simhash.CHUNK])
def test_drop_near_duplicates_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(11)
    share = 1 / np.arange(1, 4001) / (1 / np.arange(1, 4001)).sum()

    def words(n):
        return [f"w{i}" for i in rng.choice(4000, n, p=share)]

    def changed(w, n):  # n words in a row, so that few shingles go
        at = int(rng.integers(0, len(w) - n))
        return [*w[:at], *words(n), *w[at + n :]]

    texts, families = [], []
    for k in range(120):
        w = words((60, 200, 500)[k % 3])
        n = len(w)
        ways = [w, w + words(n // 5), w + words(n // 10), w[: n * 17 // 20], w[n // 6 :], changed(w, n // 20), changed(w, n // 6), changed(w, n // 4), w[n // 20 :] + w[: n // 20], w[n // 2 :] + w[: n // 2], w + words(n // 3)]
        families.append(range(len(texts), len(texts) + len(ways)))
        texts += [" ".join(x) for x in ways]
    order = rng.permutation(len(texts)).tolist()  # the id of each text
    texts_by = [""] * len(texts)
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(order):
        texts_by[x] = texts[i]
    for family in families:
        for i in family:
            for j in family:
                if i < j and jaccard(texts[i], texts[j]) >= 0.8:
                    a, b = top(order[i]), top(order[j])
                    root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts_by)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, chunk=chunk).collect()}
    assert kept == {top(i) for i in range(len(texts))}
