"""What larger tables brought to light: queries against their SQL, and steps that must not grow."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curate as C
from millrace.operators import fertility as L
from millrace.plans import catalogue


def differs(spark, name, folder):
    """The rows that only the query or only its SQL gives, over the Parquet tables of a folder."""
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    want = [tuple(r) for r in con.execute(catalogue.ORACLES[name]).fetchall()]
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()]
    return sorted(set(got) ^ set(want), key=str), len(got) - len(want)


def test_pages_with_entities_that_do_not_end(spark, tmp_path):
    rows = [(0, "u", "<title>ores anndenti&&&amp</title> &amp;lt; &copy; café"), (1, "u", "cut at &am"), (2, "u", "&quot;x&quot &middot;"), (3, "u", "plain &amp;amp; café Å")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert differs(spark, "page_rules", tmp_path) == ([], 0)
    assert T.unescape("&&amp &copy &#65 &#65; &lt; &nosuch;", closed=True) == "&&amp &copy &#65 A < &nosuch;" and T.unescape("&amp") == "&"


def test_only_texts_that_may_change_are_sent_to_python(spark):
    import html
    import unicodedata

    r, some = random.Random(3), [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)))]
    texts = ["".join(some[k : k + 1]) for k in range(len(some))] + ["".join(r.choice(["a", "e", "&amp;", "ᄀ", "ᅡ", "ᆨ", "é", "ﬁ", "क", *r.sample(some, 4)]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(k, "x" + t) for k, t in enumerate(texts)], "k long, text string")
    got = {x.k: x.p for x in df.select("k", T.unescape_nfc(F.col("text")).alias("p")).collect()}
    assert all(got[k] == unicodedata.normalize("NFC", html.unescape("x" + t)) for k, t in enumerate(texts))
    plain = spark.createDataFrame([("café “quoted” Привет 中文 가",), ("ascii",)], "text string")
    assert plain.where(T._open(F.col("text")).isNotNull()).count() == 0


def test_training_tells_how_many_symbols_words_have():
    """What encode_word finds of every word, also where pairs come up again after they were merged; no word is read for each merge."""
    r = random.Random(11)
    for letters, merges in (("ab", 12), ("abc", 60), ("abcdef", 400)):
        for _ in range(40):
            words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(80)})
            table = [(["▁", *w], r.choice((0, 1, 1, 2, 9))) for w in words]
            learned, sizes = L.bpe_train(table, merges)
            ranks = {p: k for k, p in enumerate(learned)}
            assert all(n in (None, len(L.encode_word(w, ranks))) for w, n in zip(words, sizes))


def test_grams_of_a_long_text_take_no_square_of_its_words(spark):
    """A text of 100,000 words, whose grams were each cut from a copy of all words."""
    import time

    held = spark.createDataFrame([(" ".join(f"v{k}" for k in range(20)),)], "text string")
    rows = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(100_000)) + " " + " ".join(f"v{k}" for k in range(13))), (1, "v0 v1"), (2, "")], "id long, text string")
    began = time.time()
    assert [r.id for r in C.heldout_rows(rows, held, "id", ["text"]).collect()] == [0]
    assert time.time() - began < 60


def test_quick_tests_let_no_text_pass_that_changes(spark):
    """what a look by RE2 leaves alone, Java's patterns leave alone too: characters alone and within a word, and strange mixtures."""
    r = random.Random(5)
    every = [chr(c) for c in (*range(0x3100), *range(0x3100, 0x110000, 97)) if not 0xD800 <= c <= 0xDFFF]
    parts = [" ", "\n", "\t", " ", " ", "a", "Z", "é", "’", "1", "23", ".", "@", "(", "-", "://", "http", "a@b.co", "10.0.0.1", "&amp;", "​", "\r", "é", "१", "\U0001d7d8"]
    texts = [c for c in every] + [f"a{c}b" for c in every] + ["".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(4_000)]
    digits = [f"x {c}.{c} {c * 9} y" for c in map(chr, range(0x20000)) if c.isdecimal()]
    df = spark.createDataFrame([(t,) for t in [*texts, *digits]], "text string").repartition(8)
    x = F.col("text")
    plain = T._tidied(F.coalesce(T._composed_closed(x)["plain"], x))
    assert df.where(T._stays(x)).where(plain != x).count() == 0 and df.where(T.normalize(x, closed=True) != plain).count() == 0
    found = x.rlike("@") | x.rlike("://") | x.rlike(T.MAY_HOLD["ipv4"]) | x.rlike(T.MAY_HOLD["phone"])
    assert df.where(found & ~T.may_hold_any(x)).count() == 0 and df.where(T.may_hold_any(x)).count() < len(texts) / 4 + len(digits)


def test_plain_texts_meet_no_pattern_of_java(spark, monkeypatch):
    """a text with nothing to change or to mask is not read by any of the slow patterns, which are made to fail here."""
    monkeypatch.setattr(T, "_tidied", lambda text: F.raise_error(F.lit("read")).cast("string"))
    monkeypatch.setattr(T, "may_hold", lambda text, kind: F.raise_error(F.lit("read")).cast("boolean"))
    rows = [(0, "A plain text, with “quotes” and 12 or 3.\nTwo lines of café.")]
    d = spark.createDataFrame(rows, "id long, text string").select("id", T.normalize(F.col("text"), closed=True).alias("c"))
    assert [(x.out, x._n_phone) for x in C.masked_text(d, "c", "out").collect()] == [(rows[0][1], 0)]


def test_tidying_is_as_before(spark):
    """the patterns behind their tests give what they give alone."""
    r = random.Random(6)
    parts = [" ", "  ", "\n", "\n\n", "\t", " ", "　", " ", "\u0085", "\x01", "​", "�", "‍", "\r", "a", "bé", "क"]
    df = spark.createDataFrame([(None,), ("",), *[("".join(r.choices(parts, k=r.randint(1, 12))),) for _ in range(4_000)]], "text string").repartition(4)
    out = F.coalesce(F.col("text"), F.lit(""))
    for pattern, by in ((T._CONTROL, ""), ("\\t[ \\t]*| [ \\t]+", " "), (" \\n ?|\\n ", "\n"), ("\\n{3,}", "\n\n"), ("(?U)^\\s+|\\s+$", "")):
        out = F.regexp_replace(out, pattern, by)
    assert df.where(T.tidy(F.col("text")) != out).count() == 0 and df.where(T.tidy(F.col("text")).isNull()).count() == 0


def test_quick_look_names_the_texts_with_known_grams(spark):
    """against brute force, with short texts, other blanks, words and grams over the ends of slices and of texts."""
    import pyarrow as pa

    from millrace.functions import grams as G

    r = random.Random(8)
    for n in (2, 3, 13):
        word = lambda: r.choice("abcdé") if n < 13 else r.choice("ab")
        known = {" ".join(word() for _ in range(n)) for _ in range(12)} | {" ".join(word() for _ in range(k)) for k in range(1, n)}
        look = G.KnownGrams(pa.array(sorted(known)), n)
        texts = [None, "", " \n "] + ["".join(r.choice([word(), word(), "zz"]) + r.choice([" ", "\n", "  ", " ", "\t", "  "]) for _ in range(r.choice([1, 2, 3, n, 3 * n]))) for _ in range(2_000)] + sorted(known)
        want = []
        for text in texts:
            w = (text or "").split()
            want.append(bool(w) and any(" ".join(w[k : k + n]) in known for k in range(max(len(w) - n + 1, 1))))
        assert look.held(pa.array(texts)).to_pylist() == want and 0 < sum(want) < len(want)
        before, G._SLICE = G._SLICE, 50
        try:
            assert look.held(pa.array(["zz", *texts])[1:]).to_pylist() == want
        finally:
            G._SLICE = before
    assert G.KnownGrams(pa.array([], pa.string()), 13).held(pa.array(["a", None])).to_pylist() == [False, False]


def test_rows_that_share_nothing_are_not_hashed(spark, monkeypatch):
    """a row without known words goes no further than the quick look; grams are put together for the others alone."""
    plain = T.gram_words
    monkeypatch.setattr(T, "gram_words", lambda w, at, n=13: [F.when(F.array_contains(w, "never"), F.raise_error(F.lit("hashed"))).otherwise(x) for x in plain(w, at, n)])
    held = spark.createDataFrame([("One straße of Words",), (" ".join(f"v{k}" for k in range(20)),)], "text string")
    rows = spark.createDataFrame([(0, "never " * 30), (1, "one  STRASSE\nof words"), (2, None), (3, "x " + " ".join(f"V{k}" for k in range(3, 17)))], "id long, text string")
    assert {x.id for x in C.heldout_rows(rows, held, "id", ["text"]).collect()} == {1, 3}
