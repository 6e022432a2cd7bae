"""Schedules, packing, stability, fertility, curriculum, readers and the stream, on small inputs."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import curriculum as U
from millrace.operators import fertility as L
from millrace.operators import packing as P
from millrace.operators import pools as O
from millrace.operators import ranges as R
from millrace.operators import schedule as S
from millrace.operators import stability as W
from millrace.operators.curate import Limits
from millrace.functions import text as T
from millrace.sources import io
from millrace.streaming.dedup import clean_pair_stream, clean_stream, many_targets_stream

HARD = S.Plan(20_000_000_000, 10_000_000_000, 640, 200)
SMALL = S.Plan(20_000, 10_000, 10, 100, transition_tokens=4_000, mode="linear")


def test_default_plan(spark):
    assert (HARD.steps, HARD.shift) == (156_250, 78_125)
    got = {r.source: (r.sequences, r.tokens) for r in S.totals(S.step_counts(spark, HARD), 640).collect()}
    assert got == {"fineweb": (20_312_500, 13_000_000_000), "indic": (10_937_500, 7_000_000_000)}


def test_linear_plan_is_exact(spark):
    counts = [r.fineweb for r in S.step_counts(spark, SMALL).orderBy("step").collect()]
    total, want = Fraction(0), []
    for k in range(4):
        total += 100 * (Fraction(1, 2) + Fraction(3, 10) * Fraction(2 * k + 1, 8))
        want.append(int(total + Fraction(1, 2)) - sum(want))
    assert counts == [50] * 8 + want + [80] * 8 and sum(counts) == 1300
    bases = {(r.step, r.source): r.base for r in S.draw_bases(spark, SMALL).collect()}
    assert all(bases[k, "fineweb"] == sum(counts[:k]) and bases[k, "indic"] == 100 * k - sum(counts[:k]) for k in range(20))


@pytest.mark.parametrize("bad", [dict(total_tokens=20_001), dict(shift_tokens=0), dict(before=Fraction(1, 3)), dict(transition_tokens=3_000), dict(transition_tokens=40_000), dict(mode="x")])
def test_bad_plans(bad):
    with pytest.raises(ValueError):
        S.Plan(**(dict(total_tokens=20_000, shift_tokens=10_000, block_size=10, batch=100, transition_tokens=4_000, mode="linear") | bad))


def test_draws_are_a_partition(spark):
    rows = S.local_draws(spark, SMALL, (9, 11), 4, 5).collect()
    counts = {r.step: r.fineweb for r in S.step_counts(spark, SMALL).collect()}
    for step in (9, 10):
        first = sum(counts[k] for k in range(step))
        mine = sorted(r.draw_ordinal for r in rows if r.step == step and r.source == "fineweb")
        assert mine == list(range(first, first + counts[step]))
    assert {(r.rank, r.micro_step, r.slot) for r in rows if r.step == 9} == {(a, b, c) for a in range(4) for b in range(5) for c in range(5)}


def test_permutation(spark):
    got = S.permuted(spark.range(202).withColumnRenamed("id", "draw_ordinal"), 101, 42, 201).collect()
    for number in (0, 1):
        assert sorted(r.block_id for r in got if r["pass"] == number) == list(range(101))


def test_patterns(spark):
    counts = S.step_counts(spark, SMALL)
    got = {(r.step, r.source): r.n for r in S.pattern_counts(S.exact_patterns(counts, 1)).collect()}
    assert all(got[r.step, "fineweb"] == r.fineweb for r in counts.collect())
    tiny = S.Plan(400, 200, 10, 10)
    patterns = {r.step: r.pattern for r in S.exact_patterns(S.step_counts(spark, tiny), 42).collect()}
    for step, n in ((0, 5), (3, 8)):
        want = np.array([0] * n + [1] * (10 - n), np.int8)
        np.random.default_rng(np.random.SeedSequence([42, step, 0x5037])).shuffle(want)
        assert patterns[step] == want.tolist()
    assert patterns[0] == [0, 0, 0, 0, 1, 1, 1, 1, 0, 1] and patterns[3] == [0, 0, 0, 1, 0, 1, 0, 0, 0, 0]


def test_metric_records(spark):
    got = {r.step: r for r in S.metric_records(spark, SMALL, (300, 250), 5, 7).collect()}
    counts = [r.fineweb for r in S.step_counts(spark, SMALL).orderBy("step").collect()]
    assert len(got) == 20 and got[20].tokens == 20_000 and got[9].phase == "linear_transition"
    for done, r in got.items():
        first = sum(counts[:done])
        assert r.max_source_pass_seen == max((first - 1) // 300, (100 * done - first - 1) // 250)
        beside = done - 1 in {7, 8, 9, 10, 11, 12, 13}
        assert r.logged == (done % 5 == 0 or beside or done == 20) and r.evaluated == (done % 7 == 0 or beside)
    assert S.boundary_steps(SMALL) == [7, 8, 9, 10, 11, 12, 13]


def test_round_trip_of_blocks(spark):
    pool = P.Pool(block_size=10, target_tokens=50, eval_tokens=10, shard_sequences=2)
    docs = spark.createDataFrame([(0, list(range(17))), (1, list(range(17, 60)))], "id long, tokens array<int>").withColumn("n", F.size("tokens").cast("long"))
    packed = P.blocks(P.slices(P.token_offsets(docs, "id", "n"), "tokens", "n", pool), pool)
    rows = packed.orderBy("block_id").collect()
    assert [x for r in rows for x in r.token_ids] == list(range(50))
    assert [r.split for r in rows] == ["train"] * 4 + ["eval"]
    assert [r.tokens for r in P.shard_totals(packed).orderBy("shard_id").collect()] == [20, 20, 10]
    assert P.check_filled(packed, pool) == 50
    with pytest.raises(ValueError):
        P.check_filled(packed.where("block_id > 0"), pool)
    with pytest.raises(ValueError):
        P.Pool(10, 55, 0, 2)
    with pytest.raises(ValueError):
        P.compatible({"block_size": 10}, {"block_size": 20}, 10)


def test_offsets_in_two_levels(spark):
    docs = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"))
    got = P.token_offsets(docs, "id", "n", rows=77).orderBy("id").collect()
    assert all(r.start == sum(k % 7 for k in range(r.id)) for r in got[::97])


def test_places_and_ranks_do_not_depend_on_the_ranges(spark):
    docs = spark.range(500).select(F.col("id"), F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (F.col("id") % 7 % 3 + 1).cast("int")).alias("s"))
    turns = {r.id: r.place for r in P.interleave(docs, "s", "id", 3).collect()}
    assert sorted(turns.values()) == list(range(1, 501))
    values = spark.createDataFrame([(k, k * 7 % 13) for k in range(300)] + [(999, None)], "id long, v long")
    ranks = {r.id: r.r for r in R.average_ranks(values, "v", "r", rows=20).collect()}
    v = {k: k * 7 % 13 for k in range(300)}
    assert ranks.pop(999) is None and all(r == sum(x < v[k] for x in v.values()) + (sum(x == v[k] for x in v.values()) + 1) / 2 for k, r in ranks.items())


def words_tokenizer(**more):
    return O.Tokenizer("Lengths", lambda c: F.transform(F.regexp_extract_all(c, F.lit("\\S+"), F.lit(0)), lambda x: F.length(x)), {"a": 1, "b": 2}, **more)


def test_tokenizer_checks():
    with pytest.raises(ValueError):
        O.checked(words_tokenizer(), 2)
    with pytest.raises(ValueError):
        O.checked(words_tokenizer(end_id=0), 3)
    assert O.checked(words_tokenizer(end_id=0), 3, allow_mismatch=True).padding_id == 0 and O.checked(words_tokenizer(end_id=0, padding_id=9), 2).padding_id == 9
    text = '{"class":"Lengths","vocab":[["a",1],["b",2]],"special_tokens":{"eos_token":"é"},"added_vocab":[["é",3]]}'
    assert O.fingerprint(words_tokenizer(special_tokens={"eos_token": "é"}, added={"é": 3})) == hashlib.sha256(text.encode()).hexdigest()


def test_pool_is_prepared(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a bb ccc", "en"), (1, "  ", "en"), (2, None, "fr"), (3, "dddd e", "fr"), (4, "f " * 30, "en"), (5, "late", "de")], "id long, text string, lang string")
    pool = P.Pool(block_size=5, target_tokens=25, eval_tokens=5, shard_sequences=2)
    path = str(tmp_path / "pool")
    m = O.prepare_pool(docs, "id", "lang", words_tokenizer(end_id=0), pool, path, 2, source_name="mine", seed=3)
    stream = [1, 2, 3, 0, 4, 1, 0] + [1] * 18
    assert (m["documents_consumed"], m["train_sequences"], m["eval_sequences"], m["actual_tokens"]) == (3, 4, 1, 25) and m["source_name"] == "mine"
    assert m["per_split_documents"] == {"en": 2, "fr": 1} and m["per_split_tokens"] == {"en": 22, "fr": 3}
    assert [(s["sequences"], s["tokens"], s["sha256"]) for s in m["shards"]] == [(n // 5, n, hashlib.sha256(np.array(stream[a : a + n], "<u4").tobytes()).hexdigest()) for a, n in ((0, 10), (10, 10), (20, 5))]
    assert io.read_document(spark, path + "/manifest") == m and P.with_defaults({k: v for k, v in m.items() if k != "eval_tokens"})["eval_tokens"] == 5
    blocks = spark.read.parquet(path + "/blocks").orderBy("block_id").collect()
    assert [x for b in blocks for x in b.token_ids] == stream and [b.split for b in blocks] == ["train"] * 4 + ["eval"]
    with pytest.raises(Exception):
        O.prepare_pool(docs, "id", "lang", words_tokenizer(end_id=0), pool, path, 2)
    with pytest.raises(Exception, match="ran out"):
        O.prepare_pool(docs, "id", "lang", words_tokenizer(end_id=0), P.Pool(5, 500, 5, 2), path, 2, overwrite=True)
    assert O.index_of_pools({"x": m})["x"]["train_sequences"] == 4
    assert [r.text for r in P.shuffled(docs, "id", 5).collect()] == [r.text for r in P.shuffled(docs.repartition(3), "id", 5).collect()]
    P.compatible(m, dict(m), 5)
    assert {r.label for r in P.shuffled(docs, "id", 5, "en").collect()} == {"en"}


def series(spark, rows):
    return spark.createDataFrame(rows, "step long, loss double, grad double")


def test_stability(spark):
    calm = [(k, 2.0, 1.0) for k in range(1, 40)]
    out = W.summarize(series(spark, calm), 10, 20, 100, 10).first()
    assert out.passes and out.recovery_steps == 0
    high = [(k, 2.0, 3.0 if 10 < k < 25 else 1.0) for k in range(1, 40)]
    out = W.summarize(series(spark, high), 10, 20, 100, 10).first()
    assert not out.passes and out.grad_multiplier == 3.0 and out.recovery_steps == 5
    out = W.summarize(series(spark, [(8, 1.0, 1.0)]), 10, 20, 100, 5).first()
    assert not out.passes and out.recovery_steps is None
    out = W.summarize(series(spark, [(k, 0.0, 0.0) for k in range(1, 40)]), 10, 20, 100, 10).first()
    assert not out.passes
    bad = [(k, float("nan") if k == 15 else 2.0, 1.0) for k in range(1, 40)]
    assert not W.summarize(series(spark, bad), 10, 20, 100, 10).first().passes


def test_preference(spark):
    hard = W.summarize(series(spark, [(k, 2.0, 3.0 if 10 < k < 25 else 1.0) for k in range(1, 40)]), 10, 10, 100, 20)
    soft = W.summarize(series(spark, [(k, 2.0, 1.1) for k in range(1, 40)]), 10, 20, 100, 10)
    assert W.compare(hard, soft, True).first().linear_preferred and not W.compare(hard, soft, False).first().linear_preferred


def test_comparison_document(spark):
    hard = W.summarize(series(spark, [(k, 2.0, 3.0 if 10 < k < 25 else 1.0) for k in range(1, 40)]), 10, 10, 100, 20)
    soft = W.summarize(series(spark, [(k, 2.0, 1.1) for k in range(1, 40)]), 10, 20, 100, 10)
    none = spark.createDataFrame([], "key string")
    doc = W.comparison(hard, soft, none)
    assert doc["warm_transition_preferred"] and doc["matched_configuration"] and doc["hard"]["grad_multiplier"] == 3.0
    assert not W.comparison(hard, soft, spark.createDataFrame([("seed",)], "key string"))["warm_transition_preferred"]
    assert W.arms(["linear", "hard"]) == (1, 0)
    with pytest.raises(ValueError):
        W.arms(["hard", "hard"])
    rows = spark.createDataFrame([(1, 10, 2.0, 1.0), (1, 20, 3.0, 1.0), (2, 30, None, 1.0)], "step long, tokens long, loss double, grad double")
    assert [r.loss for r in W.training_rows(rows, latest=True).collect()] == [3.0] and W.training_rows(rows).count() == 2


def test_whole_batches(spark):
    rows = spark.range(23)
    assert W.whole_batches(rows, "id", 5).count() == 20 and W.whole_batches(rows, "id", 5, 9).count() == 5 and W.whole_batches(rows, "id", 50).count() == 0


def test_loss_gate(spark):
    rows = spark.createDataFrame([("a", k, 2.0 if 5 <= k < 60 else 1.0) for k in range(80)], "g string, step long, loss double").withColumn("base", F.lit(1.0))
    assert [r.step for r in W.loss_gate(rows, "step", "loss", "base", ["g"]).where("stops").orderBy("step").collect()] == [54, 55, 56, 57, 58, 59]


def test_extract(spark):
    assert spark.createDataFrame([("e\u0301",)], "t string").select(L.truncate_extract(F.col("t")).alias("x")).first().x == "\u00e9\n"
    text = "== Title ==\n one \n\n=== Part ===\ntwo\n== see also ==\nthree"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(L.truncate_extract(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["Title\none\nPart\ntwo\n", "\n"]


def test_candidates_and_selection(spark):
    assert len(L.candidates()) == 48 and L.candidates()[0] == {"English": 4.0, "Hindi": 1.0, "Telugu": 1.0, "Marathi": 1.0}
    rows = [(0, {"English": 1.3, "Hindi": 1.3}), (1, {"English": 1.1, "Hindi": 1.9}), (2, {"English": 1.2, "Hindi": 1.9}), (3, {"English": 1.2, "Hindi": 1.9})]
    assert L.select_trial(spark.createDataFrame(rows, "trial long, ratios map<string,double>")).first().trial == 2


def test_bpe():
    merges = L.bpe_merges([(list("abab"), 3), (list("abc"), 2)], 2)
    assert merges == [("a", "b"), ("ab", "ab")]
    assert L.encode_word("abab", {m: k for k, m in enumerate([("a", "b"), ("▁", "ab")])}) == ["▁ab", "ab"]


def test_repeats_round_half_even(spark):
    got = spark.createDataFrame([(36_000, 1.0), (90_000_000, 1.0), (60_000, 1.0)], "w long, x double").select(L.repeats(F.col("w"), F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == [2, 1, 2]


def test_tokens_and_metrics(spark):
    merges = {("▁", "a"): 0, ("▁a", "b"): 1}
    df = spark.createDataFrame([("ab a b",), (None,)], "t string")
    assert [r.n for r in df.select(L.count_tokens(merges)("t").alias("n")).collect()] == [1 + 1 + 2, 0]
    a = spark.createDataFrame([("en", 10, 12, 1.2), ("fr", 5, 9, 1.8)], "language string, words long, tokens long, ratio double")
    b = spark.createDataFrame([("en", 10, 12, 1.2), ("fr", 5, 10, 2.0)], "language string, words long, tokens long, ratio double")
    assert {(r.language, r.field) for r in L.verify_metrics(a, b).collect()} == {("fr", "tokens"), ("fr", "ratio")}
    # the ratios, spread and score that were published for a tokenizer follow from its words and tokens
    published = [("English", 9933, 11762, 1.184134), ("Hindi", 7972, 14896, 1.868540), ("Marathi", 4529, 9284, 2.049901), ("Telugu", 2320, 4931, 2.125431)]
    for _, words, tokens, ratio in published:
        assert abs(tokens / words - ratio) < 5e-7
    s = L.spread(spark.createDataFrame([(t / w,) for _, w, t, _ in published], "ratio double")).first()
    assert abs(s.spread - 0.941297) < 1e-6 and abs(s.score - 1062.3636) < 1e-3


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_selector_is_brute_force(spark, at_once):
    import random

    r = random.Random(at_once)
    rows = [(k, float(r.choice((1, 1, 1, 2, 3, k % 11)))) for k in r.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "id long, score double")
    ordered = sorted(((s, k) for k, s in rows), key=lambda x: (-x[0], x[1]))
    for n in (1, 40, 77, 120):
        assert U.cut_at(df, n, "score", "id", at_once) == ordered[n - 1]
    assert U.cut_at(df, 121, "score", "id", at_once) is None and U.cut_at(df, 0, "score", "id") is None


def test_gates_of_the_curriculum(spark):
    lanes = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "lane string, share double")
    after = spark.createDataFrame([("a", 0.505), ("b", 0.48), ("c", 0.015)], "lane string, share double")
    assert {r.lane: r.within for r in U.lane_drift(lanes, after).collect()} == {"a": True, "b": False, "c": False}
    assert [r.licence for r in spark.createDataFrame([("Licensed under the MIT",), ("CC BY-NC 4.0",), ("CC BY 4.0",), ("plain",)], "t string").select(U.licence_of(F.col("t")).alias("licence")).collect()] == ["mit", "cc-by-nc", "cc-by", None]


def test_curriculum(spark):
    lanes = spark.createDataFrame([("a", 6.0, 3.0, 1.0, 10.0, 0.5), ("b", 6.0, 3.0, 2.0, 10.0, 0.5)], "lane string, `unique` double, replay double, anneal double, total double, share double")
    assert {r.lane: r.closes for r in U.lane_closure(lanes, 20.0).collect()} == {"a": True, "b": False}
    rows = spark.createDataFrame([(k, float(k % 5), "g" if k < 3 else "h") for k in range(20)], "id long, score double, grp string")
    got = U.select_best(rows, "id", "score", "grp", 0.4, 2)
    assert got.count() == 8 and got.where("grp = 'g'").count() >= 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text":"one","idx":5}\n\n{"text":"two","_input_line":9}\n')
    rows = io.read_json_lines(spark, str(tmp_path / "in"), "text string, idx long, _input_line long").orderBy("_input_line").collect()
    assert [(r.text, r.idx, r._input_line) for r in rows] == [("one", 5, 1), ("two", None, 9)]
    assert [r.ordinal.line for r in rows] == [1, 3]
    (tmp_path / "in" / "aa.jsonl").write_text('not json\n{"text":"three"}\n')
    with pytest.raises(Exception, match="not a JSON object"):
        io.read_json_lines(spark, str(tmp_path / "in"), "text string").collect()
    kept = io.numbered(io.read_json_lines(spark, str(tmp_path / "in"), "text string", "keep")).orderBy("number").collect()
    assert [(r.number, r.text, r._malformed) for r in kept] == [(0, "one", None), (1, "two", None), (2, None, "not json"), (3, "three", None)]
    (tmp_path / "in" / "aa.jsonl").unlink()
    big = "".join(f'{{"text":"line {k}"}}\n' for k in range(5000))
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "x.jsonl").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = io.read_json_lines(spark, str(tmp_path / "big"), "text string")
    assert len(spark.read.text(str(tmp_path / "big")).inputFiles()) == 1 and all(r.text == f"line {r._input_line - 1}" for r in got.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "in" / "b.csv").write_text('text,n\n"a, ""b""\nc",1\n')
    assert io.read_csv(spark, str(tmp_path / "in")).select("text", "n").collect()[0] == ('a, "b"\nc', "1")
    spark.createDataFrame([("three", 3)], "text string, idx long").coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    (tmp_path / "in" / "notes.md").write_text("passed over")
    mixed = io.read_local(spark, str(tmp_path / "in"), "text string, idx long, _input_line long").collect()
    assert sorted(r.text for r in mixed) == ['a, "b"\nc', "one", "three", "two"]
    assert io.read_parquet(spark, str(tmp_path / "in")).first().text == "three"
    calls = []
    fetch = lambda: calls.append(1) or spark.createDataFrame([("extract",)], "text string")
    for refresh in (False, False, True):
        assert io.snapshot(spark, str(tmp_path / "snap"), fetch, refresh).first().text == "extract"
    assert len(calls) == 2
    (tmp_path / "held.txt").write_text("first\n\n  \nsecond\n")
    assert [r.text for r in io.read_heldout(spark, str(tmp_path / "held.txt")).collect()] == ["first", "second"]
    assert io.is_monolingual("ai/IndicCorpV2") and not io.is_monolingual("pairs") and io.split_buffers(10_000, 4, 7) == [(2500, 8), (2500, 9), (2500, 10), (2500, 11)]
    log = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0)], "step long, loss double, grad_norm_pre_clip double")
    io.append_metrics(log, str(tmp_path / "log"))
    io.append_metrics(log, str(tmp_path / "log"))
    assert io.read_metrics(spark, str(tmp_path / "log"), "step long, loss double, grad_norm_pre_clip double").count() == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        io.read_metrics(spark, str(tmp_path / "empty"), "step long, loss double, grad_norm_pre_clip double")
    io.write_window(log, str(tmp_path / "window"))
    window = io.read_csv(spark, str(tmp_path / "window")).drop("_input_file")
    assert len(window.columns) == 10 and [r.step for r in window.orderBy("step").collect()] == ["1", "2"]
    decided = spark.createDataFrame([(1, []), (2, ["bad"])], "id long, reasons array<string>")
    io.write_split(decided, str(tmp_path / "split"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "split")).where("fate = 'accepted'").collect()] == [1]
    vocabulary = spark.createDataFrame([(1, "▁the", -1.5), (0, "<unk>", 0.0)], "id int, piece string, score double")
    io.write_tokenizer(spark, {"vocab_size": 2}, vocabulary, str(tmp_path / "tok"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "tok" / "tokens_tsv")).collect()) == ["0\t<unk>\t0.00000000", "1\t▁the\t-1.50000000"]
    assert io.read_document(spark, str(tmp_path / "tok" / "metrics")) == {"vocab_size": 2}
    nested = spark.createDataFrame([((2, {"z": 1, "a": 2}, [(1, None)]), "é")], "b struct<y:int,x:map<string,int>,w:array<struct<q:int,p:string>>>, a string")
    assert io.canonical_json(nested).first().value == '{"a":"é","b":{"w":[{"p":null,"q":1}],"x":{"a":2,"z":1},"y":2}}'
    (tmp_path / "v.tsv").write_text("<unk>\t0\n▁the\t-1.5\n")
    assert [(r.id, r.piece, r.score) for r in io.read_vocabulary(spark, str(tmp_path / "v.tsv")).collect()] == [(0, "<unk>", 0.0), (1, "▁the", -1.5)]
    df = spark.createDataFrame([("é", None)], "b string, a string")
    assert io.canonical_json(df).first().value == '{"a":null,"b":"é"}'
    io.write_json(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        io.write_json(df, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        io.read_languages(spark, str(tmp_path), ["xx"], monolingual=True)
    assert [r.path for r in io.latest(spark.createDataFrame([("c-9",), ("c-10",), ("c-x",)], "path string"), 2).collect()] == ["c-10", "c-9"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("good text", "en"), ("Good  text", "en"), ("", "en")], "text string, language string").write.parquet(str(src))
    stream = spark.readStream.schema("text string, language string").parquet(str(src))
    q = clean_stream(stream, Limits(registry=T.LATIN, composed=True)).writeStream.format("memory").queryName("clean").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("clean").count() == 1


def test_first_targets_in_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(k, "same source here", t, "en") for k, t in enumerate(("uno", "dos", "UNO"))] + [(3, "other source here", "dos", "en")]
    schema = "id long, src string, tgt string, language string"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = many_targets_stream(stream, "id", Limits(registry=T.LATIN, composed=True)).writeStream.format("memory").queryName("targets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r.ordinal: r.many for r in spark.table("targets").collect()} == {0: False, 1: True, 2: False, 3: False}
    q = clean_pair_stream(spark.readStream.schema(schema).parquet(str(src)), Limits(registry=T.LATIN, composed=True)).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("pairs").count() == 3


def test_tokenizer_search_is_brute_force(spark):
    import random

    r = random.Random(5)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(60)})
    rows = [(lang, w, r.choice((1, 2, 3, 70))) for lang in L.LANGUAGES for w in r.sample(words, 30)]

    def naive(table, merges):
        learned = []
        for _ in range(merges):
            counts = {}
            for s, f in table:
                for p in zip(s, s[1:]):
                    counts[p] = counts.get(p, 0) + f
            if not counts:
                break
            best = min(counts, key=lambda p: (-counts[p], p))
            learned.append(best)
            for s, _ in table:
                k = 0
                while k < len(s) - 1:
                    if (s[k], s[k + 1]) == best:
                        s[k : k + 2] = ["".join(best)]
                    k += 1
        return learned

    size, want = 39, {}
    for trial, weights in enumerate(L.candidates()):
        freq = {}
        for lang, w, n in rows:
            freq[w] = freq.get(w, 0) + round(n * weights[lang] * 1000)
        table = [(["▁", *w], f) for w, f in sorted(freq.items())]
        learned = naive([(list(s), f) for s, f in table], size - 4 - 5)
        assert L.bpe_merges(table, size - 4 - 5) == learned and len(learned) == 30
        ranks = {p: k for k, p in enumerate(learned)}
        want[trial] = {lang: sum(n * len(L.encode_word(w, ranks)) for x, w, n in rows if x == lang) / sum(n for x, _, n in rows if x == lang) for lang in L.LANGUAGES}
    got = {x.trial: x.ratios for x in L.search(spark.createDataFrame(rows, "language string, word string, freq long"), L.candidate_table(spark), size).collect()}
    assert got == want and len(got) == 48
    assert L.bpe_merges([(list(w), 1) for w in words], 10_000) == naive([(list(w), 1) for w in words], 10_000)


def test_tokenizer_search_takes_every_word_and_candidate(spark, monkeypatch, tmp_path):
    from millrace.plans import catalogue

    seen = []
    monkeypatch.setattr(L, "search", lambda words, trials, size: seen.append((words.count(), trials.count(), size)) or trials.select("trial", "weights").withColumnRenamed("weights", "ratios"))
    spark.createDataFrame([("en", "one two two"), ("fr", "un")], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    catalogue.QUERIES["tokenizer_search"](spark, str(tmp_path)).collect()
    assert seen == [(3, 48, 10_000)]
