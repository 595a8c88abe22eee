"""The dealt operators against brute force, libraries, exact round trips, and odd tables."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quivera.llm import html_text, line_dedup, media, mixing, pieces, quality_rules, rule_ensemble, sharding, simhash, toxicity
from quivera.llm.common import write_table
from quivera.llm.components import components
from quivera.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, most string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5, "x", "y", "z"), (2, None, None, None, None, None, None, None), (3, "", "en", None, 0, None, None, None),
        (3, "", "en", None, 0, None, None, None), (4, " \t\r\n", None, "b", 4, "s", "t", "u"), (5, long, "en", "a", len(long), None, None, None), (6, "same text here again and again", "fr", "b", 1, None, None, None),
        (7, "same text here again and again", "fr", "b", 1, None, None, None), (None, "no id at all", "fr", "b", 1, None, None, None), (9, "é ü 日本語 😀\n\nb", "de", "c", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name]) == ""


# ---- 1 SentencePiece ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_like_library(texts, library):
    t = pieces.Transducer(pieces.load_model())
    rng = random.Random(1)
    odd_texts = ["", " ", "  a", "a  b", "日本語 😀\n\tq", "<s> </s> <0x41>", "▁▁a▁b", "a" * 100, " " * 40, "​\x00x"]
    odd_texts += ["".join(rng.choice(" abctheéß.,▁\n0😀") for _ in range(60)) for _ in range(300)]
    for text in [*texts[:60], *odd_texts]:
        ids = library.encode(text)
        assert t.encode(text) == ids
        assert t.decode(ids) == library.decode(ids)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 300), rng.randrange(32000)]) for _ in range(8)]
        assert t.decode(ids) == library.decode(ids)


def test_unigram_is_the_lightest_path():
    scores = {"▁a": -1.0, "▁": -3.0, "a": -2.5, "b": -2.0, "ab": -2.2, "▁ab": -3.5, "ba": -1.5, "c": -4.0}
    listed = [("<unk>", 0.0, pieces.UNKNOWN), *[(p, s, pieces.NORMAL) for p, s in scores.items()]]
    t = pieces.Transducer(pieces.Model(tuple(listed), pieces.UNIGRAM, True, False, False, 0))

    def best(s):  # all segmentations
        if not s:
            return 0.0, []
        found = [(scores[s[:k]] + best(s[k:])[0], [s[:k], *best(s[k:])[1]]) for k in range(1, len(s) + 1) if s[:k] in scores]
        return max(found)

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(8)).strip() or "a"
        whole = t.normalise(text)
        path = [t.text[i] for i in t.shortest_path(whole)]
        assert "".join(path) == whole and abs(sum(scores[p] for p in path) - best(whole)[0]) < 1e-9
    assert t.encode("xy") == [t.ids["▁"], 0]


def test_normaliser_like_library():
    """A compiled character map as rewriting rules, against the library's normaliser."""
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    rules = tuple(library.decompile())
    normalise = pieces.Normaliser(pieces.Model((("<unk>", 0.0, pieces.UNKNOWN),), pieces.UNIGRAM, True, True, False, 0, rules))
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(" abc\t\n▁①ｈǺéガﾞ\u200b\x01🇩🇪ﬁ½\u00a0　") for _ in range(rng.randint(0, 12)))
        assert normalise(text) == library.normalize(text)


def test_user_symbols_are_whole(library):
    """Symbols defined by the user are pieces wherever they stand; the rest is encoded as before."""
    model = pieces.load_model()
    t = pieces.Transducer(pieces.Model((*model.pieces, ("<sep>", 0.0, pieces.USER_DEFINED)), *[getattr(model, f) for f in ("kind", "dummy_prefix", "remove_extra_blanks", "byte_fallback", "unknown")]))
    sep = len(model.pieces)
    plain = pieces.Transducer(model)
    assert t.encode("the cat<sep>sat there") == [*library.encode("the cat"), sep, *[i for w in ("sat", "▁there") for i in plain._path_ids(w, plain.shortest_path(w))]]
    assert t.decode(t.encode("a <sep><sep> b")) == "a <sep><sep> b" and t.encode("no symbol here") == library.encode("no symbol here")


def test_long_texts_in_windows(library, monkeypatch):
    t = pieces.Transducer(pieces.load_model())
    monkeypatch.setattr(pieces, "WINDOW", 50)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 4000)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 100)
    for text in ("the quick  brown fox. " * 200, "x" * 3000, "日本語" * 500, " " * 500, "a.b,c " * 300):
        assert t.encode(text) == library.encode(text)


def test_pieces_query_like_library(spark, library, texts):
    """Every row of the query against the library."""
    rows = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    ids = sorted(rows)
    assert len(ids) == len(texts) and all(rows[i]["token_ids"] == library.encode(t) and rows[i]["n_tokens"] == len(rows[i]["token_ids"]) and rows[i]["round_trip"] for i, t in zip(ids, texts))


def test_pieces_odd_rows(odd, empty):
    made = pieces.encode(odd, decoded="decoded")
    rows = made.withColumn("same", pieces.round_trip_column("text", "decoded")).collect()
    assert len(rows) == 10 and all(r["same"] for r in rows)
    assert all(r["n_tokens"] == 0 and r["token_ids"] == [] for r in rows if not r["text"])
    assert {"size", "fp"} <= set(made.columns) and pieces.encode(empty).count() == 0
    again = pieces.decode(made.select("doc_id", "token_ids"))
    assert {r["doc_id"]: r["decoded"] for r in again.collect()}[9] == "é ü 日本語 😀\n\nb"


def test_pairs_stay_and_bytes_decode(texts, monkeypatch):
    """Weights of pairs outlive a task in two bounded generations and change no encoding; decoding by Arrow is decoding."""
    t = pieces.Transducer(pieces.load_model())
    some = [x for x in texts if x][:60] + ["", " ", "\ud83d\ude00 ".encode("utf-16", "surrogatepass").decode("utf-16"), "\u0e01\u00e9x", "\u2581a"]
    blobs = [t.encode_bytes(x) for x in some]
    weighed, finite = [], t._finite
    monkeypatch.setattr(t, "_finite", lambda before, arc: weighed.append(arc) or finite(before, arc))
    t.forget()
    assert [t.encode_bytes(x) for x in some] == blobs and not weighed
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 50)
    t.pairs, t.older_pairs = {}, {}
    t.forget()
    assert [t.encode_bytes(x) for x in some] == blobs and weighed and len(t.pairs) <= 25 and len(t.older_pairs) <= 25
    assert [t.decode_bytes(b) for b in blobs] == [t.decode(np.frombuffer(b, np.int32).tolist()) for b in blobs]
    rng = random.Random(35)  # bytes that are no characters, control pieces
    for _ in range(50):
        ids = [rng.randrange(300) for _ in range(rng.randint(0, 12))]
        assert t.decode_bytes(np.array(ids, np.int32).tobytes()) == t.decode(ids)
    for bad in (-1, len(t.out)):
        with pytest.raises(IndexError):
            t.decode_bytes(np.array([5, bad], np.int32).tobytes())


# ---- 2 and 7 classifiers -----------------------------------------------------------------------------------


def _labelled(spark, n=1200, seed=5):
    """Texts of which some are junk (quality 0) and some hold a slur in one of many forms (toxic 1)."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 120))]
        junk, toxic = rng.random() < 0.25, rng.random() < 0.3
        if junk:
            words = [w + rng.choice(["***", "|", "%%%"]) for w in words] if k % 2 else words[:4] * 20
        if toxic:
            words.insert(rng.randrange(len(words)), "zork" + rng.choice(["ed", "ing", "s"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if junk else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _held_out_accuracy(scored, labels, label):
    got = scored.withColumn("held", rule_ensemble.fold() == 0).where("held").join(labels, "doc_id").select("predicted", label).collect()
    assert len(got) > 100
    return sum(r[0] == r[1] for r in got) / len(got)


def test_classifiers_learn(spark):
    docs, labels = _labelled(spark)
    quality = rule_ensemble.classify(docs, rule_ensemble.train(docs, labels), keep=["doc_id"])
    assert _held_out_accuracy(quality, labels, "quality") > 0.97
    toxic = toxicity.classify(docs, toxicity.train(docs, labels), keep=["doc_id"])
    assert _held_out_accuracy(toxic, labels, "toxic") > 0.95


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, len(rule_ensemble.STATISTICS)))
    model = rule_ensemble.fit(x, ((x[:, 2] > 0.5) & (x[:, 5] < 0.3)).astype(float))
    assert model.rules and all(len(r.terms) <= rule_ensemble.DEPTH for r in model.rules)
    rows = spark.createDataFrame(x[:50].tolist(), list(rule_ensemble.STATISTICS)).select(model.score().alias("s"), "*").collect()
    for r in rows:
        total = model.intercept + sum(w.weight for w in model.rules if all((r[s] > b) if above else (r[s] <= b) for s, above, b in w.terms))
        assert abs(r["s"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_classifiers_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 0, 1), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for module, threshold in ((rule_ensemble, 0.3), (toxicity, 0.5)):
        for part in (labels, labels.limit(0)):
            model = module.train(odd, part)
            rows = module.classify(odd, model, threshold=threshold).collect()
            assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
        assert module.classify(empty, model).count() == 0
        assert module.train(empty, labels) is not None


def test_held_out_rows_are_not_learnt(spark):
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    picked = {r[0] for r in rule_ensemble.labelled_sample(labels, "quality", 1000).collect()}
    assert picked == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5}
    assert rule_ensemble.labelled_sample(labels, "quality", 10).count() == 10


# ---- 3 HTML ------------------------------------------------------------------------------------------------

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c",
    "<ol start=9><li>a<li>b</ol>": "9. a\n10. b",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<table><tr><td>long cell<td>1<tr><td>x<td>22</table>": "long cell  1\nx          22",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "wide  z\na  b  c",
    "a <b>bold</b>, <i>it</i>": "a bold, it",
    "x<script>var a='<p>no</p>'</script>y<style>b{}</style>z": "xyz",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes": "yes",
    "<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "a<br>b<br/>c": "a\nb\nc",
    "a &amp; b &lt;c&gt; &copy; &#65;": "a & b <c> © A",
    "<head><title>no</title></head><body>yes": "yes",
    "<title>no</title>text <!-- no --> more": "text more",
    "1 < 2 and <unknown>3</unknown>": "1 < 2 and 3",
    "</div></p>stray<p>": "stray",
    "<a href='x>y'>q</a>": "q",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<textarea><b>&amp;</textarea>": "<b>&",
    "<p>a<table><tr><td>b</table>c": "a\n\nb\n\nc",
    "<select><option>a<option>b</select>": "a\nb",
    "x<div><p>a</p></div><div><p>b</p></div>": "x\n\na\n\nb",
    "<form>q <input type=text value=no><input type=submit value=Go></form>": "q Go",
    "<table><tr><td>" + "w" * 90 + "<td>1<tr><td>x<td>2</table>": "w" * 90 + "  1\nx" + " " * 91 + "2",
    "<ul><li>a<ul><li>b<ul><li>c<ul><li>d</ul></ul></ul></ul>": "- a\n  - b\n    - c\n      - d",
    "<noscript>no</noscript><template>no</template>yes": "yes",
    "": "",
}


@pytest.mark.parametrize("page", sorted(PAGES))
def test_render(page):
    assert html_text.render(page) == PAGES[page]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (3, "", None), (4, "<div>" * 3000 + "deep", None), (5, "<a href=\"x" * 2000, None), (1, "<p>a", "t")], "page_id long, html string, text string")
    got = html_text.extract_text(pages).select("page_id", "text").collect()
    assert sorted((r[0], r[1] or "") for r in got)[:3] == [(1, "a"), (1, "a"), (2, "")] and {r[0]: r[1] for r in got}[4] == "deep"
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<ul><li>" * 300 + "x", "<div>" * 30_000 + "x" + "</y>" * 30_000, "<b>" * 30_000 + "x", "<blockquote>" * 900 + "x", "<table><tr><td>" * 800 + "x"])
def test_deep_pages(page):
    assert html_text.render(page).replace("- ", "").strip() == "x"


def test_wide_tables_take_linear_time():
    import time

    began = time.time()
    assert html_text.render("<table><tr>" + "<td colspan=1000>x" * 3000).count("x") == 3000
    assert html_text.render("<table>" + "<tr><td rowspan=9000 colspan=900>x<td>y" * 300).count("x") == 300
    assert time.time() - began < 5


def test_html_query_keeps_all_visible_words(spark):
    """Brute force on the driver's pages: words outside of invisible elements, tags cut out."""
    import html as lib

    rows = {r["page_id"]: r["text"] for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        cut = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", p["html"])
        words = Counter(WORD.findall(lib.unescape(re.sub(r"<[^>]*>", " ", cut)).replace("\xa0", " ")))
        have = Counter(WORD.findall(rows[p["page_id"]].replace("\xa0", " ")))
        assert not {w for w in words if w not in have and len(w) > 6} or sum((words & have).values()) > 0.97 * sum(words.values())


# ---- 4 quality rules ---------------------------------------------------------------------------------------


def _measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    spots = {}
    for k in range(len(words) - 4):
        spots.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + i for ks in spots.values() if len(ks) > 1 for k in ks for i in range(5)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(lines)


def test_measures(texts):
    rng = random.Random(4)
    for text in [*texts, None, "", " ", "a b c d e a b c d e", "\x1c\x85  x", *[" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(100)]]:
        assert quality_rules.measure_text(None if text is None else text.encode()) == _measures(text)


def test_quality_odd_rows(odd, empty):
    for docs, n in ((odd, 10), (empty, 0)):
        measured = write_table(quality_rules.measure(docs), "t")
        judged = quality_rules.judge(measured, write_table(quality_rules.thresholds(quality_rules.sketches(measured)), "t"))
        rows = judged.collect()
        assert len(rows) == n and all(not r["kept"] for r in rows if r["base_failed"])
        assert set(docs.columns) <= set(judged.columns)


def _fences(rows):
    """Brute force: quartiles of the group's buckets, drawn towards the language's and all, group by group."""
    def bucket(x):
        return math.ceil(math.log(x) / math.log(quality_rules.GAMMA))

    def ratios(n, chars, symbols, dup, repeat, lines):
        return {"symbols": (symbols + 1) / (n + 20), "dup_lines": (dup + 0.5) / (lines - dup + 0.5), "repeats": (repeat + 0.5) / (n - repeat + 0.5), "word_length": (chars + 100) / (n + 20)}

    measured = [(r["lang"], r["source"], {k: bucket(v) for k, v in ratios(*_measures(r["text"])).items()}) for r in rows if _measures(r["text"])[0]]
    fences = {}
    for rule, (_, sides, width, _) in quality_rules.RULES.items():
        def quartiles(values):
            values = sorted(values)
            return len(values), values[math.ceil(len(values) / 4) - 1], values[math.ceil(3 * len(values) / 4) - 1]

        def drawn(own, wide):
            return [(own[0] * own[k + 1] + quality_rules.PRIOR_ROWS * wide[k]) / (own[0] + quality_rules.PRIOR_ROWS) for k in (0, 1)]

        every = quartiles([x[rule] for _, _, x in measured])[1:]
        for lang, source in {(a, b) for a, b, _ in measured}:
            wide = drawn(quartiles([x[rule] for a, _, x in measured if a == lang]), every)
            q1, q3 = drawn(quartiles([x[rule] for a, b, x in measured if (a, b) == (lang, source)]), wide)
            fences[lang, source, rule] = (q1 - width * (q3 - q1) if sides == "both" else -math.inf, q3 + width * (q3 - q1))

    def outside(text, lang, source):
        n, chars, symbols, dup, repeat, lines = _measures(text)
        counted = {"symbols": symbols, "dup_lines": dup, "repeats": repeat, "word_length": n}
        return any(counted[k] and not fences[lang, source, k][0] <= bucket(v) <= fences[lang, source, k][1] for k, v in ratios(n, chars, symbols, dup, repeat, lines).items())

    return outside


def test_fences_follow_the_group(spark):
    """Sources with other symbol rates get other fences, which decide; without the sketches the verdicts are others."""
    rng = random.Random(21)
    rows = []
    for k in range(900):
        rate, symbols = (1.0, 3) if k % 60 == 0 else ((0.01, 0.5)[k % 2], 1)
        words = []
        for _ in range(rng.randint(60, 90)):
            word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 7)))
            words.append("#" * symbols + word[symbols:] if rng.random() < rate else word)
        rows.append((k, " ".join(words), "en", "ab"[k % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = write_table(quality_rules.measure(docs), "t")
    limits = write_table(quality_rules.thresholds(write_table(quality_rules.sketches(measured), "t")), "t")
    high = {r["source"]: r["symbols_high"] for r in limits.collect()}
    assert high["b"] > high["a"] + 150
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(measured, limits).collect()}
    assert not any(kept[k] for k in range(0, 900, 60))
    assert sum(kept.values()) > 850
    merged = write_table(quality_rules.thresholds(quality_rules.sketches(measured.withColumn("source", F.lit("a")))), "t")
    alike = merged.unionByName(merged.withColumn("source", F.lit("b")))
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(measured, write_table(alike, "t")).collect()} != kept


@pytest.mark.parametrize("rule", sorted(quality_rules.RULES))
def test_every_rule_can_reject(spark, rule):
    rng = random.Random(22)
    word = lambda n=5: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, "\n".join(" ".join(word(rng.randint(4, 6)) for _ in range(rng.randint(9, 12))) for _ in range(rng.randint(4, 40)))) for k in range(300)]
    line = [" ".join(word(5) for _ in range(4)) for _ in range(12)]
    phrase = " ".join(word(5) for _ in range(5))
    bad = {
        "symbols": " ".join(word() + "###" for _ in range(200)),
        "dup_lines": "\n".join(x for y in line for x in (y, word(9), y, word(8))),
        "repeats": " ".join([phrase, *(word() for _ in range(25)), phrase, *(word() for _ in range(25))]),
        "word_length": " ".join(word(18) for _ in range(200)),
    }
    docs = spark.createDataFrame([*rows, (999, bad[rule])], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    measured = write_table(quality_rules.measure(docs), "t")
    limits = write_table(quality_rules.thresholds(quality_rules.sketches(measured)), "t")
    judged = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(measured, limits).collect()}
    assert judged[999] == (False, False) and sum(k for _, k in judged.values()) >= 290


def test_sketches_merge(documents):
    """Sketches of two halves add up to the sketch of the whole."""
    measured = write_table(quality_rules.measure(documents, keep=["doc_id", "lang", "source"]), "t")
    key = ["lang", "source", "rule", "bucket"]
    halves = quality_rules.sketches(measured.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(measured.where("doc_id % 2 = 1")))
    merged = {tuple(r[k] for k in key): r["n"] for r in halves.groupBy(*key).agg(F.sum("n").alias("n")).collect()}
    assert merged == {tuple(r[k] for k in key): r["n"] for r in quality_rules.sketches(measured).collect()}


# ---- 5 line dedup ------------------------------------------------------------------------------------------


def _masked(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))


def _dropped(docs):
    """Brute force over whole texts and lines, without hashes: (doc_id, line number) of what goes."""
    holders = {}
    for text in {t for _, t in docs if t}:
        for line in text.split("\n"):
            if _masked(line):
                holders.setdefault(_masked(line), set()).add(text)
    gone = {t for t, texts in holders.items() if len(texts) >= 3}
    leaves = {}
    for t in holders.keys() - gone:
        leaves.setdefault((len(t), t[:3]), []).append(t)
    templates = {}
    for leaf, lines in leaves.items():
        counts = Counter((k, w) for t in lines for k, w in enumerate(t))
        for t in lines:
            often = [(k, w) for k, w in enumerate(t) if counts[k, w] >= 3]
            if len(often) >= 0.6 * len(t):
                size = sorted((counts[x] for x in often), reverse=True)[math.ceil(0.6 * len(t)) - 1]
                constant = tuple(x for x in often if counts[x] >= 0.1 * size)
                if any(k >= 3 for k, _ in constant):
                    templates.setdefault((leaf, constant), []).append(t)
    for lines in templates.values():
        if len(set().union(*(holders[t] for t in lines))) >= 3:
            gone |= set(lines)
    return {(i, k) for i, t in docs for k, line in enumerate((t or "").split("\n")) if _masked(line) in gone}


def test_line_dedup_brute_force(spark, documents, texts):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(60):
        body = [" ".join(word() for _ in range(9)) for _ in range(3)]
        if k % 2:
            body.insert(1, f"Posted by user{k} on {k} May in the forum")
        if k % 3 == 0:
            body.append(f"All rights of this page belong to {word()} and partners today")
        rows.append((k, "\n".join(body)))
    copies = [(100 + k, rows[1][1]) for k in range(5)]
    docs = spark.createDataFrame([*rows, *copies, rows[0]], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.recurring_lines(docs).collect()}
    want = _dropped([*rows, *copies, rows[0]])
    assert got == want and {(k, 1) for k in range(1, 60, 2)} <= got and any(k % 3 == 0 for k, _ in got)
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(docs, count_into="n").collect()}
    assert "Posted" not in out[3]["text"] and out[3]["n"] == 2 and out[2]["text"] == rows[2][1]
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.recurring_lines(documents).collect()} == _dropped(list(zip([r[0] for r in documents.orderBy("doc_id").select("doc_id").collect()], texts)))


def test_line_dedup_joined(spark, documents, monkeypatch):
    """Beyond the bound for shipped hashes the joins give the same."""
    key = lambda: {tuple(r) for r in line_dedup.drop_recurring_lines(documents, count_into="n").collect()}
    shipped = key()
    monkeypatch.setattr(line_dedup, "SHIPPED", 0)
    assert key() == shipped and any(r[-1] for r in shipped)


def test_line_dedup_odd_rows(odd, empty):
    rows = line_dedup.drop_recurring_lines(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, odd.collect()))
    assert line_dedup.drop_recurring_lines(empty).count() == 0


def _own_lines(rng, n):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9)) for _ in range(n)]


def test_line_dedup_copies_do_not_count(spark):
    """A thousand copies of one document leave a passage of twenty others found, and do not make lines of their own recur."""
    rng, passage = random.Random(11), "this passage stands in many pages that share nothing else"
    rows = [(k, "\n".join([*_own_lines(rng, 3), passage])) for k in range(20)]
    rows += [(1000 + k, rows[0][1]) for k in range(1000)]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, 3) for k, _ in rows}


def test_line_dedup_boilerplate_of_several_lines(spark):
    """All lines of shared passages are found, however long they are, for ten passages of each length."""
    rng, rows, want = random.Random(12), [], set()
    for shared, own in ((2, 3), (10, 5), (30, 10)):
        for _ in range(10):
            passage = _own_lines(rng, shared)
            for _ in range(40):
                rows.append((len(rows), "\n".join([*passage, *_own_lines(rng, own)])))
                want |= {(len(rows) - 1, k) for k in range(shared)}
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_short_lines_and_whole_texts(spark):
    """Lines of one word recur like any other; a text of recurring lines alone becomes empty; two texts are too few."""
    rows = [(k, f"Menu\n{_own_lines(random.Random(k), 1)[0]}") for k in range(5)] + [(10, "Menu"), (11, "Menu\n\n Menu"), (12, "only here"), (13, "only here"), (14, None)]
    out = {r["doc_id"]: (r["text"], r["n"]) for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), count_into="n").collect()}
    assert out[10] == ("", 1) and out[11] == ("", 2) and out[12] == ("only here", 0) and out[14] == (None, 0)
    assert all(out[k] == (rows[k][1].split("\n")[1], 1) for k in range(5))


@pytest.mark.parametrize("n", [30, 300, 10_000])
def test_line_dedup_template_at_any_size(spark, n):
    """One template with three fields of 200 values is found whole, in a leaf of 30 lines and of 10,000."""
    rng = random.Random(13)
    field = lambda kind: f"{kind}{''.join(chr(97 + int(d)) for d in str(rng.randrange(200)))}"
    rows = []
    for k in range(n):
        a, b, c = field("user"), field("host"), field("path")
        line = f"session opened for user {a} on host {b} by service login with path {c} at once today"
        rows.append((k, f"{line}\n{_own_lines(rng, 1)[0]}"))
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, 0) for k, _ in rows}


# ---- 6 SimHash ---------------------------------------------------------------------------------------------


def _fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    """doc_id -> smallest doc_id reachable, by all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark, documents, texts):
    ids = [r[0] for r in documents.select("doc_id").orderBy("doc_id").collect()]
    prints = {i: _fingerprint(t) for i, t in zip(ids, texts)}
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash_near_dedup"](spark, SF).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == _classes(prints)


def test_links_of_hot_shards(spark):
    """A dense ball of fingerprints, in slices of a few rows, keeps the components of all pairs."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(150):
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = _classes({v: v for v in values})
    for shard_rows, levels in ((5, 1), (5, 3), (20, 2), (4096, 3)):
        found = simhash.links(fps, shard_rows=shard_rows, levels=levels)
        roots = {r["node"]: r["root"] for r in components(write_table(found, "t")).collect()}
        groups = {}
        for v in values:
            groups.setdefault(roots.get(signed(v), signed(v)), set()).add(want[v])
        assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want.values()))


def test_bk_tree():
    rng = random.Random(9)
    tree, values = simhash.BKTree(), [rng.getrandbits(16) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert Counter(tree.near(q, 3)) == Counter(v for v in values if (v ^ q).bit_count() <= 3)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 99), (7, 7)]
    rows = components(write_table(spark.createDataFrame(chain, "a long, b long"), "t")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got) and got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 101: 99}
    assert components(write_table(spark.createDataFrame([], "a long, b long"), "t")).count() == 0


def _wide(text, bits=256):
    """Votes of five-word shingles, bit by bit."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = []
    for k in range(max(1, len(words) - 4)):
        h = xxhash.xxh64(" ".join(words[k : k + 5]).encode(), 42).intdigest()
        whole = h
        for j in range(1, bits // 64):
            x = (h + j * 0x9E3779B97F4A7C15) % (1 << 64)
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
            whole |= (x ^ x >> 31) << 64 * j
        hashes.append(whole)
    return sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _similar_classes(prints):
    """doc_id -> smallest doc_id reachable: all pairs that are near and agree in a sample of bits."""
    rng = random.Random(42)
    masks = [sum(1 << b for b in rng.sample(range(256), 20)) for _ in range(80)]
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (x := prints[a] ^ prints[b]).bit_count() <= 44 and any(not x & m for m in masks):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_similar_brute_force(spark, documents, texts):
    ids = [r[0] for r in documents.select("doc_id").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_similar(documents).collect()}
    assert got == _similar_classes({i: _wide(t) for i, t in zip(ids, texts)})


def _edited(rng, words, n):
    """The words with a run of ``n`` new ones at their end."""
    return [*words[: len(words) - n], *("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))]


def _shingle_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_similar_texts(spark):
    """All pairs of a Jaccard similarity of 0.8 or more and no others, with common shingles, copies, short and null texts;
    near_similar leaves none of them apart."""
    rng = random.Random(31)
    passage, texts = _edited(rng, [], 12), []
    for k in range(60):
        own = _edited(rng, passage, 0) + _edited(rng, [], rng.randint(150, 200)) if k % 2 else _edited(rng, [], rng.randint(8, 204))
        near = [_edited(rng, own, rng.randint(max(1, len(own) // 12), len(own) // 8)) for _ in range(rng.randint(1, 4))]
        texts += [" ".join(x) for x in [own, *near]]
    texts += [" ".join(passage), "a b", "a b c d", "", texts[0].upper(), texts[3] + " " + texts[3]]
    docs = spark.createDataFrame([*enumerate(texts), (998, texts[7]), (999, None)], "doc_id long, text string").repartition(3)
    sets = [_shingle_set(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    rows = docs.select(F.xxhash64("text").alias("t"), "text")
    number = {r["t"]: r["doc_id"] for r in docs.where("doc_id < 998").select("doc_id", F.xxhash64("text").alias("t")).collect()}
    found = simhash.similar_texts(rows, rows.select("t", F.col("t").alias("root")).distinct()).collect()
    assert {tuple(sorted((number[r["a"]], number[r["b"]]), reverse=True)) for r in found} == want and len(found) == len(want) > 60
    near = simhash.near_similar(docs).collect()
    got = {r["doc_id"]: r["component_id"] for r in near}
    assert len(near) == docs.count() and all(got[a] == got[b] <= b for a, b in want) and got[998] == got[7]
    roots = {}
    for r in near:
        roots.setdefault(r["root"], set()).add(r["component_id"])
    assert all(len(x) == 1 for x in roots.values()) and len(roots) == len(set(got.values()))


def test_shingle_bits():
    """Bitmaps never rule out a similar pair, and rule out pairs of half the shingles."""
    rng, ruled = random.Random(34), 0
    for _ in range(80):
        own = _edited(rng, [], rng.randint(1, 400))
        other = _edited(rng, own + _edited(rng, [], rng.choice([0, 0, len(own) // 5])), rng.randint(0, len(own) // rng.choice([2, 8])))
        a, b = (" ".join(x).encode() for x in (own, other))
        sets = [np.unique(simhash.shingle_hashes(x, 5)).tobytes() for x in (a, b)]
        x, y = _shingle_set(" ".join(own)), _shingle_set(" ".join(other))
        assert simhash.sets_agree(*sets) == (5 * len(x & y) >= 4 * len(x | y))
        allowed = simhash.bits_allow(simhash.shingle_bits(a, 5), simhash.shingle_bits(b, 5))
        assert allowed or not simhash.sets_agree(*sets)
        ruled += not allowed
    half = " ".join([*own[: len(own) // 2], *_edited(rng, [], 100)]).encode()
    assert ruled and not simhash.bits_allow(simhash.shingle_bits(" ".join(own).encode(), 5), simhash.shingle_bits(half, 5))


def test_candidate_pairs():
    """Of one shingle's texts: each pair of different groups that may be similar once, whatever the groups' sizes."""
    rng = random.Random(32)
    for groups in (1, 2, 5, 40):
        n = np.array(sorted(rng.randint(5, 60) for _ in range(40)))
        at, root = np.array([rng.randrange(max(1, x // 5)) for x in n]), np.array([rng.randrange(groups) for _ in n])
        got = Counter((min(k, j), max(k, j)) for k, others in simhash.candidate_pairs(n, at, root) for j in others.tolist())
        want = {(a, b) for b in range(40) for a in range(b) if root[a] != root[b] and simhash._may_be_similar(n[a], at[a], n[b], at[b])}
        assert set(got) == want and set(got.values()) <= {1} and (want or groups == 1)


def test_similar_links_of_hot_shards(spark):
    """Fingerprints of a hot shard, in slices of a few rows, have the components of all pairs that the samples bring together."""
    rng = random.Random(33)
    centres, values = [rng.getrandbits(256) for _ in range(3)], {}
    for _ in range(120):
        v = rng.choice(centres)
        for bit in rng.sample(range(256), rng.randint(10, 34)):
            v ^= 1 << bit
        values[v] = v
    want, n = _similar_classes(values), 4
    words = lambda v: [(v >> 64 * k) % (1 << 64) for k in range(n)]
    signed = lambda v: [x - (1 << 64) if x >> 63 else x for x in words(v)]
    fps = spark.createDataFrame([(*signed(v), str(v)) for v in values], "fp0 long, fp1 long, fp2 long, fp3 long, v string")
    name = {r["node"]: int(r["v"]) for r in fps.select(F.xxhash64("fp0", "fp1", "fp2", "fp3").alias("node"), "v").collect()}
    for shard_rows in (3, 4096):
        found = simhash.similar_links(fps.drop("v"), shard_rows=shard_rows)
        roots = {name[r["node"]]: r["root"] for r in components(write_table(found, "t")).collect()}
        groups = {}
        for v in values:
            groups.setdefault(roots.get(v, v), set()).add(want[v])
        assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want.values()))


def test_keep_one(spark):
    """One row of each group stays: repeated rows, ids with several texts, null ids, near copies."""
    rng = random.Random(24)
    long = lambda: [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))]
    a, b, c = long()[0], long()[0], long()[0]
    near = " ".join(["changed", *a.split()[1:]])
    rows = [(5, a, "x"), (5, a, "x"), (4, near, "y"), (None, a, "z"), (7, b, "x"), (7, c, "x"), (7, c, "x"), (None, "", "e"), (None, None, "f"), (None, long()[0], "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["text"], r["node"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert sum(1 for r in got if r[0] is None and not r[1]) == 1
    assert [r for r in got if r[1]] == sorted([(4, near, "y"), (7, b, "x"), (7, c, "x"), rows[-1]], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == 10 and {r[2] for r in rows if r[1] == 0} == {2} and dict((r[0], r[2]) for r in rows)[7] == 6
    assert simhash.near_duplicates(empty).count() == 0


# ---- 8 media -----------------------------------------------------------------------------------------------


def test_media_round_trip(spark, documents, texts):
    rows, store = media.store_media(documents, keep=["doc_id"])
    got = media.describe(rows, store).orderBy("doc_id").collect()
    assert len({r["media_sha256"] for r in got}) == len({(r["shard"], r["offset"]) for r in got}) < len(got)
    members = {}
    folder = store.removeprefix("file://")
    import os

    for name in os.listdir(folder):
        with tarfile.open(f"{folder}/{name}") as tar:
            for m in tar.getmembers():
                members[m.name] = tar.extractfile(m).read()
    for r, text in zip(got, texts):
        body = text.encode()
        payload = body + b" " * ((-len(body)) % 192 if body else 192)
        image = members[r["media_sha256"] + ".png"]
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["n_bytes"] == len(body) and r["payload_bytes"] == len(payload)
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and hashlib.sha256(image).hexdigest() == r["media_sha256"] and len(image) == r["media_bytes"]
        assert (r["width"], r["height"], r["bit_depth"], r["color_type"]) == (192, len(payload) // 192, 8, 0) and media.from_png(image).tobytes() == payload
    by_text = {}
    for r, text in zip(got, texts):
        assert by_text.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_media_odd_rows(odd, empty):
    rows, store = media.store_media(odd)
    got = media.describe(rows, store).collect()
    assert len(got) == 10 == media.read_media(rows, store).count() and {r["payload_bytes"] for r in got if not r["n_bytes"]} == {192}
    rows, store = media.store_media(empty)
    assert media.describe(rows, store).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_media_has_one_place_a_digest(spark, monkeypatch, most):
    """Copies that several tasks store get one address, by broadcast and by salted joins."""
    monkeypatch.setattr(media, "BROADCAST_PLACES", most)
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(200)], "doc_id long, text string").repartition(4)
    rows, store = media.store_media(docs)
    got = media.describe(rows, store).collect()
    assert len(got) == 200 and len({(r["media_sha256"], r["shard"], r["offset"]) for r in got}) == 7


def test_media_rolls_shards_and_checks_bytes(tmp_path):
    writer = media.ShardWriter(f"file://{tmp_path}", 3, 7, shard_bytes=600)
    places = [writer.add(bytes([k]), lambda k=k: media.to_png(media.to_payload(bytes([k]) * 500))) for k in (1, 2, 1, 3)]
    writer.close()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted({p[1] for p in places}) and len({p[1] for p in places}) > 1
    for digest, shard, offset, length in places:
        assert hashlib.sha256((tmp_path / shard).read_bytes()[offset : offset + length]).hexdigest() == digest
    with pytest.raises(ValueError):
        media.parse_header(b"\x00" * 33)
    assert tarfile.open(fileobj=io.BytesIO((tmp_path / places[0][1]).read_bytes())).getnames()


# ---- 9 mixing ----------------------------------------------------------------------------------------------


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Deal the share by weight; whoever is above its most stops there and the rest is dealt again."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if unit * w[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {**{f"s{k}": rng.choice([0, 1, 50, 1000, 100_000]) * rng.randint(0, 9) for k in range(9)}, None: 77, "Ä": 5, "z": 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got.keys() == sizes.keys() and all(abs(got[s] - t) < 1e-6 * max(1, t) for s, t in _targets(sizes).items())


def test_mix_is_near_its_targets(spark):
    rng = random.Random(11)
    rows = [(k, "w " * (rng.randint(0, 30) if k % 50 else 2000), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(write_table(mixing.sized(docs), "t")).collect()
    for s in {r["source"] for r in mixed}:
        own = [r for r in mixed if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mixed)
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert all(copies.get(r["doc_id"], 0) == r["times"] for r in mixed)


def test_mixing_odd_rows(odd, empty, spark):
    mixed = mixing.mix(write_table(mixing.sized(odd), "t")).collect()
    assert len(mixed) == 10 and all(r["taken"] <= 2 * r["size"] for r in mixed)
    assert mixing.mix(write_table(mixing.sized(empty), "t")).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(write_table(mixing.sized(blank), "t")).collect()] == [0, 0]


# ---- 10 sharding -------------------------------------------------------------------------------------------


def test_sharding_balance(spark):
    """A group of copies with a third of all bytes is cut by id; small groups stay together; slots are gapless."""
    rng = random.Random(12)
    rows = [(k, f"text {k} " + "x" * rng.randint(0, 400)) for k in range(600)] + [(1000 + k, "hot " * 40) for k in range(400)] + [(5000 + k, "pair") for k in range(2)]
    keys = write_table(sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string")), "t")
    got = sharding.shard(keys, shards=10, ranges=4, heavy=0.02).collect()
    total, biggest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(10):
        own = [r for r in got if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 10) <= 2 * biggest + 0.02 * total / 10, s
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert len({r["shard"] for r in got if r["doc_id"] >= 5000}) == 1
    assert {r["text_crc32"] for r in got if r["doc_id"] == 1000} == {zlib.crc32(("hot " * 40).encode())}


def test_equal_texts_share_a_shard(spark):
    """Groups of up to a mean shard are whole, and the shards still near equal."""
    rng = random.Random(23)
    rows = [(k, f"text {k} " + "x" * rng.randint(0, 300)) for k in range(3000)]
    for g in range(60):
        rows += [(10_000 + 100 * g + k, f"group {g} " + "y" * 200) for k in range(rng.randint(2, 60))]
    keys = write_table(sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string")), "t")
    got = sharding.shard(keys, shards=20).collect()
    shards_of, bytes_of = {}, Counter()
    text = dict(rows)
    for r in got:
        shards_of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        bytes_of[r["shard"]] += r["size"]
    mean = sum(bytes_of.values()) / 20
    assert len(got) == len(rows) and all(len(x) == 1 for x in shards_of.values())
    assert max(abs(bytes_of[k] - mean) for k in range(20)) < 0.03 * mean


def test_budgets_fill_to_a_level():
    assert sharding.budgets([0, 0, 0], 30) == [10, 10, 10] and sharding.budgets([50, 4, 0], 10) == [0, 3, 7]
    assert sharding.budgets([5, 5], 0) == [0, 0]


def test_sharding_odd_rows(odd, empty):
    got = sharding.shard(write_table(sharding.keyed(odd), "t")).collect()
    assert len(got) == 10 and {r["size"] for r in got if r["doc_id"] == 2} == {16} and all(0 <= r["shard"] < 40 for r in got)
    assert sharding.shard(write_table(sharding.keyed(empty), "t")).count() == 0
