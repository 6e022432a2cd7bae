"""The cleaner's semantics on hand-written rows."""

import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curate as C
from millrace.sources import io


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()[0]


def test_normalisation(spark):
    n = lambda t: one(spark, t, T.normalize(F.col("text")))
    assert n("a​b﻿c‮d") == "abcd"
    assert n("क‍ष ‌") == "क‍ष ‌".strip(" ")
    assert n("é") == "é"
    assert n(unicodedata.normalize("NFD", "नुक़्ता")) == unicodedata.normalize("NFC", "नुक़्ता")
    assert n("a\rb") == "ab" and n("a\r\nb") == "a\nb" and n("a \t b\n\n\n\nc  ") == "a b\n\nc"
    assert n("&amp;lt; &unknownthing;") == "&lt; &unknownthing;"
    assert n(None) == "" and n("�") == ""


def test_normalisation_counts(spark):
    c = T.composed(F.col("text"))
    got = one(spark, "e\u0301\u200b\u200b\u200d\ufffd\x01", T.operation_counts(c["plain"], c["changed"], "src"))
    assert got == {"src_unicode_nfc_changed": 1, "src_removed_U+200B": 2, "src_indic_joiner_preserved": 1, "src_replacement_character_removed": 1, "src_other_control_removed": 1}


def test_scripts(spark):
    assert one(spark, "नमस्ते", T.letters(F.col("text"))) == 4
    assert one(spark, "abc नम", T.script_ratio(F.col("text"), "Latin")) == 0.6
    assert one(spark, "12 !", T.script_ratio(F.col("text"), "Latin")) == 0.0


def test_masks_in_order(spark):
    mask = lambda t: one(spark, t, T.mask_pii(F.col("text")))
    assert mask("a.b+c@d-e.co.uk x") == "[EMAIL] x"
    assert mask("at 10.0.0.255 now") == "at [IP_ADDRESS] now"
    assert mask("call +91 98765 43210!") == "call [PHONE]!"
    assert mask("see https://x.y/z?a=1 now") == "see [URL] now"
    assert mask("on 2020 01 31 12") == "on [PHONE]"
    assert mask("९८७६५४३२१०") == "[PHONE]"
    got = C.masked_text(spark.createDataFrame([("http://10.0.0.1/a a@b.co",)], "text string"), "text", "out").first()
    assert (got._n_email, got._n_ipv4, got._n_phone, got._n_url) == (1, 1, 0, 1) and got.out == "[URL] [EMAIL]"


def test_keys_and_grams(spark):
    assert one(spark, "  Straße\t ΣΑΣ ", T.casefold_key(F.col("text"))) == "strasse σασ"
    assert one(spark, " A  b ", T.key_of(F.col("text"))) == "a b"
    words = " ".join(f"w{k}" for k in range(15))
    assert len(one(spark, words, T.word_grams(F.col("text")))) == 3
    assert one(spark, "a b", T.word_grams(F.col("text"))) == ["a b"]
    assert one(spark, "  ", T.word_grams(F.col("text"))) == []


def test_mono_rules(spark):
    rows = [
        (0, "aaaaaaaaaaaa good text here", "en"), (1, "aaaaaaaaaaa good text here", "en"), (2, None, "en"), (3, "x", "en"), (4, "y" * 5001, "en"),
        (5, "fine <b>text</b>", "EN"), (6, "fine text", "xx"), (7, "प्रिय मित्र नमस्कार", "en"), (8, "mail a@b.co", "en"),
    ]
    d = C.evaluate_text(spark.createDataFrame(rows, "id long, text string, language string"), C.Limits(registry=T.LATIN))
    got = {r.id: (r.reasons, r.flags) for r in d.collect()}
    assert got[0][0] == ["repeated_character_run"] and got[1] == ([], [])
    assert got[2][0] == ["empty_text", "missing_or_nonstring_text"]
    assert got[3] == ([], ["very_short_text"]) and got[4][0] == ["extreme_text_length", "repeated_character_run"]
    assert got[5] == ([], ["html_markup_present"]) and got[6][0] == ["missing_or_unknown_language"]
    assert got[7] == ([], ["script_mismatch"]) and got[8] == ([], ["structured_pii_masked"])


def test_pair_rules(spark):
    rows = [
        (0, "Hello there my friend", "नमस्ते मेरे दोस्त आप", "hi", "0.9"), (1, "aaaaaa", "aaaaaa", "hi", "abc"), (2, "Hello {name} %s", "नमस्ते {name}", "hi", None),
        (3, "short", "x" * 60, "hi", "0.7"), (4, "Good long text", "good  LONG text", "hi", "0.1"), (5, "Mail a@b.co here", "मेल यहाँ भेजें", "hi", "NaN"), (6, "plain latin words", "plain latin words too", "zz", "0.8"),
    ]
    d = C.evaluate_pairs(spark.createDataFrame(rows, "id long, src string, tgt string, language string, score string"), C.Limits(), score="score")
    got = {r.id: (r.reasons, r.flags) for r in d.collect()}
    assert got[0] == ([], [])
    assert got[1][0] == ["repeated_character_run"] and "invalid_semantic_score" in got[1][1]
    assert got[2] == ([], ["placeholder_mismatch", "semantic_alignment_not_scored"])
    assert got[3][0] == ["extreme_length_ratio", "repeated_character_run"]
    assert got[4][0] == ["low_semantic_alignment_score"] and "identical_source_target" in got[4][1]
    assert got[5] == ([], ["pii_alignment_asymmetry", "structured_pii_masked"])
    assert got[6][0] == ["missing_or_unknown_language"] and "target_script_mismatch" in got[6][1]


def test_duplicates_count_kept_rows_only(spark):
    rows = [(0, "d", ["bad"]), (1, "d", []), (2, "d", []), (3, "e", [])]
    d = C.flag_duplicates(spark.createDataFrame(rows, "id long, digest string, reasons array<string>"), "id")
    assert {r.id: r.reasons for r in d.collect()} == {0: ["bad"], 1: [], 2: ["exact_text_duplicate"], 3: []}


def test_many_targets(spark):
    rows = [(k, "hi", "s", t, []) for k, t in enumerate("ABA")]
    d = C.flag_many_targets(spark.createDataFrame(rows, "id long, resolved string, masked_src string, masked_tgt string, flags array<string>"), "id")
    assert [r.flags for r in d.orderBy("id").collect()] == [[], ["source_has_multiple_targets"], []]


def test_heldout(spark):
    item = " ".join(f"w{k}" for k in range(12))
    held = spark.createDataFrame([(item,), ("  ",), (" ".join(f"v{k}" for k in range(20)),)], "text string")
    rows = spark.createDataFrame([(0, item.upper()), (1, "x " + item), (2, "x " + " ".join(f"v{k}" for k in range(3, 17))), (3, "")], "id long, text string")
    assert {r.id for r in C.heldout_rows(rows, held, "id", ["text"]).collect()} == {0, 2}
    assert {r.id for r in C.heldout_rows(rows, held, "id", ["text"], broadcast_up_to=0).collect()} == {0, 2}


def test_manifest(spark):
    rows = [(0, "good text", "en"), (1, "good  text", "en"), (2, "", "en"), (3, "a@b.co", "fr")]
    d = C.decide(spark.createDataFrame(rows, "id long, text string, language string"), "id", C.Limits(registry=T.LATIN))
    m = C.manifest(d, dataset={"id": "mine"})
    assert m["counts"] == {"input_rows": 4, "cleaned_rows": 2, "rejected_rows": 2} and m["schema_version"] == 3
    assert m["rejection_reasons"] == {"empty_text": 1, "exact_text_duplicate": 1} and m["structured_pii_masks"] == {"text_email": 1}
    digests = sorted(r.digest for r in C.accepted(d).collect())
    assert m["output"]["aggregate_content_sha256"] == hashlib.sha256("".join(digests).encode()).hexdigest()
    assert m["dataset"] == {"id": "mine", "languages": ["from_rows"], "license_note": None, "text_field": "text", "src_field": None, "tgt_field": None}
    tree = C.digest_tree(d)
    assert tree == C.digest_tree(d.repartition(3)) and tree != C.digest_tree(d.where("id > 0").withColumn("digest", F.md5("digest")))
    assert C.corpus_digest(d.where("false")) == hashlib.sha256().hexdigest()


def test_language_columns_in_order(spark):
    rows = [("hi", "en", "fr"), (None, "EN", "fr"), ("", None, "fr"), (None, None, None)]
    df = spark.createDataFrame([(k, "some plain words", *r) for k, r in enumerate(rows)], "id long, text string, _language string, language string, lang string")
    assert [r.resolved for r in C.evaluate_text(df, C.Limits(registry=T.LATIN)).orderBy("id").collect()] == ["unknown", "en", "fr", "unknown"]
    assert [r.resolved for r in C.evaluate_text(df, C.Limits(registry=T.LATIN), fixed="DE").orderBy("id").collect()] == ["unknown", "en", "fr", "de"]


def test_exact_keys_fold_all_of_unicode(spark):
    df = spark.createDataFrame([(0, "ΣΑΣ ὈΔΥΣΣΕΎΣ", "en"), (1, "σασ ὀδυσσεύσ", "en")], "id long, text string, language string")
    digests = {r.digest for r in C.evaluate_text(df, C.Limits(registry=T.LATIN, exact_keys=True)).collect()}
    assert len(digests) == 1


def test_strict_languages_reject(spark):
    df = spark.createDataFrame([(0, "Кириллица вместо латиницы", "en")], "id long, text string, language string")
    assert C.evaluate_text(df, C.Limits(registry=T.LATIN, strict_language=True)).first().reasons == ["script_mismatch"]


def test_cleaner_run(spark, tmp_path):
    rows = [(0, "Good text here", "en", "web", None), (1, "good  TEXT here", "en", "web", 71), (2, None, "en", "web", 72), (3, "mail a@b.co caf\u00e9 please", "fr", None, 73)]
    df = spark.createDataFrame(rows, "n long, text string, language string, data_source string, idx long")
    held = spark.createDataFrame([("nothing like it",)], "text string")
    m = C.run_cleaner(df, "n", str(tmp_path / "a"), C.Limits(registry=T.LATIN), heldout=held)
    assert m["counts"] == {"input_rows": 4, "cleaned_rows": 2, "rejected_rows": 2} and m["cleaner"]["decontamination"].startswith("13-word")
    kept = sorted(r.value for r in spark.read.text(str(tmp_path / "a" / "cleaned")).collect())
    digest = hashlib.sha256(b"en\0good text here").hexdigest()
    assert kept[0] == '{"cleaning":{"content_sha256":"' + digest + '","flags":[],"script_ratios":{"expected_script":1.0}},"data_source":"web","idx":null,"language":"en","text":"Good text here"}'
    assert '"data_source":null,"idx":73,"language":"fr","text":"mail [EMAIL] caf\u00e9 please"' in kept[1]
    gone = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "a" / "rejected")).collect()]
    assert {(g["row"]["idx"], tuple(g["reasons"])) for g in gone} == {(71, ("exact_text_duplicate",)), (72, ("empty_text", "missing_or_nonstring_text"))}
    assert io.read_document(spark, str(tmp_path / "a" / "audit_manifest")) == m
    with pytest.raises(Exception):
        C.run_cleaner(df, "n", str(tmp_path / "a"), C.Limits(registry=T.LATIN))
    bare = C.run_cleaner(df.drop("idx", "data_source"), "n", str(tmp_path / "b"), C.Limits(registry=T.LATIN), limit=2)
    assert bare["counts"] == {"input_rows": 2, "cleaned_rows": 1, "rejected_rows": 1}
    assert '"idx":0' in spark.read.text(str(tmp_path / "b" / "cleaned")).first().value


def test_cleaner_run_over_pairs(spark, tmp_path):
    rows = [(0, "Hello my friend", "Hola mi amigo", "es", 0.9), (1, "hello MY friend", "Otra cosa distinta", "es", 0.8), (2, "Hello my friend", "hola mi amigo", "es", 0.9), (3, "low score pair", "par de baja nota", "es", 0.1)]
    df = spark.createDataFrame(rows, "n long, src string, tgt string, language string, score double")
    m = C.run_cleaner(df, "n", str(tmp_path / "p"), C.Limits(registry=T.LATIN), pairs=True, score="score")
    assert m["mode"] == "bilingual_pair" and m["cleaner"]["semantic_filter"] == "score >= 0.7" and m["dataset"]["tgt_field"] == "tgt"
    assert m["rejection_reasons"] == {"exact_pair_duplicate": 1, "low_semantic_alignment_score": 1} and m["review_flags"] == {"source_has_multiple_targets": 1}
    kept = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "p" / "cleaned")).collect()]
    assert {k["idx"] for k in kept} == {0, 1} and all(set(k["cleaning"]) == {"flags", "pair_sha256", "script_ratios", "semantic_score"} for k in kept)
