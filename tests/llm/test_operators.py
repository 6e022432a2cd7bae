"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import itertools
import random
import re
import time
import unicodedata
from collections import defaultdict
from math import log2, log10

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bytecnn, deobfuscate, hilbert, jaccard, packing, rulelists, secrets, suffixes, templates, tiling
from millrace.llm import tokens as K

VOCABULARY = [f"{a}{b}" for a in ("ta", "ro", "mé", "lin", "ÄB", "Qu", "zi9") for b in ("no", "per", "x", "ß", "end", "ul")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", ",", "."]) for _ in range(n))


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randrange(999)}" for w in text.split())


@pytest.fixture(scope="module")
def rows():
    base = [prose(k, 30 + 17 * k) for k in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, changed(base[k], k, 0.03)) for k in range(12)]
    out += [(200, base[3]), (201, base[3]), (202, base[3].upper()), (300, prose(99, 4000)), (301, changed(prose(99, 4000), 5, 0.01))]
    out += [(400, None), (401, ""), (402, " \n . "), (403, "one"), (404, "one"), (405, "two words"), (None, base[1]), (5, base[5])]
    return out


def frame(spark, rows, extra=False):
    data = [(i, t, None if i == 7 else "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    if extra:  # names that operators use themselves
        for name in ("shard", "hilbert", "a", "b", "_key", "_doc", "quality", "set_key", "rule", "_b0", "_v0", "_parts", "_from", "_bad", "_gone", "_of", "_hashes", "_w", "_t", "_first", "_group", "h", "seed", "n"):
            df = df.selectExpr("*", f"'own' as {name}")
    return df


def test_words_agree_with_the_definition(rows):
    texts = [t for _, t in rows] + ["“q”É×÷", "日本、語", "a b"]
    seen = {}
    for words in K.tokenize(pa.array(texts), chunk=2000):
        for d in range(len(words.ptr) - 1):
            want = K.words_of(texts[words.row + d])
            got = words.hash[words.ptr[d] : words.ptr[d + 1]].tolist()
            assert len(want) == len(got)
            for w, h in zip(want, got):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def gram_set(text, n):
    w = K.words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def links(rows, n, threshold):
    """The similar pairs of documents, by brute force."""
    sets = {i: gram_set(t, n) for i, t in rows if i is not None}
    found = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= threshold:
                found[a, b] = j
    return sets, found


def classes(nodes, pairs):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("n,threshold", [(2, 0.7), (1, 0.8)])
def test_jaccard_join_is_brute_force(spark, rows, n, threshold):
    sets, want = links(rows, n, threshold)
    root, number = classes(sets, want), defaultdict(int)
    for a, b in want:
        number[a] += 1
        number[b] += 1
    alike = {i: min(j for j in sets if sets[j] == sets[i]) for i in number}
    table = frame(spark, rows, True)
    got = {r.doc_id: r for r in jaccard.similar_documents(table, n, threshold).collect()}
    assert {i: (r.class_id, r.set_id, r.links) for i, r in got.items()} == {i: (root[i], alike[i], number[i]) for i in number}
    pairs = {(r.set_a, r.set_b): r.jaccard for r in jaccard.set_pairs(table, n, threshold).collect()}
    assert pairs.keys() == {k for k in want if all(alike[i] == i for i in k)}
    assert all(abs(pairs[k] - want[k]) < 1e-9 for k in pairs)


def test_short_near_pairs_are_never_lost(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 7)  # buckets are dealt over grids too
    r = random.Random(11)
    rows, k = [], 0
    for size in [2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 31, 40, 63, 66, 90] * 12:
        # a word left out, a word changed or a word more at an end: near the threshold for the short ones
        base = [f"w{r.randrange(4000)}" for _ in range(size + 1)]
        rows += [(k, " ".join(base)), (k + 1, " ".join(base[:-1])), (k + 2, " ".join([*base, "tail"])), (k + 3, " ".join([*base[: size // 2], "new", *base[size // 2 + 1 :]]))]
        k += 4
    _, want = links(rows, 2, 0.7)
    got = {(r.set_a, r.set_b) for r in jaccard.set_pairs(frame(spark, rows), 2, 0.7).collect()}
    assert got == want.keys() and len(want) > 400


def test_one_of_each_group_stays(spark, rows):
    sets, pairs = links(rows, 2, 0.7)
    root = classes(sets, pairs)
    df = frame(spark, rows, True)
    kept = jaccard.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {i for i in root if root[i] == i}
    assert None in ids and {400, 401, 402} <= set(ids) and ids.count(5) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.similar_documents(none).count() == 0 and jaccard.set_pairs(none).count() == 0
    assert jaccard.keep_one_of_each_group(none).count() == 0
    assert tiling.contamination(none, bench).count() == 0
    assert suffixes.repeated_passages(none).count() == 0
    assert packing.pack_by_retrieval(none).count() == 0
    assert hilbert.hilbert_shards(none).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.mask_secrets(none).count() == 0
    assert deobfuscate.find_pii(none).count() == 0
    assert bytecnn.fit_quality(none, labels) is None and bytecnn.keep_good(none, None).count() == 0
    assert rulelists.judge(none, rulelists.fit_rules(none, labels)).count() == 0
    assert templates.remove_templates(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    root = classes({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: low for x, low in root.items() if low != x}


def brute_tiling(text, item, least):
    """Greedy string tiling by exhaustive search of the longest match."""
    mt, mi, tiles = [False] * len(text), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                k = 0
                while a + k < len(text) and b + k < len(item) and not mt[a + k] and not mi[b + k] and text[a + k] == item[b + k]:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        if best[0] < least:
            return tiles
        for k in range(best[0]):
            mt[best[1] + k] = mi[best[2] + k] = True
        tiles += best[0]


def test_tiling_is_brute_force():
    r = random.Random(1)
    for _ in range(60):
        item = [r.randrange(50) for _ in range(r.randrange(5, 30))]
        parts = [item[i : i + 7] for i in range(0, len(item), 7)]
        r.shuffle(parts)
        text = [r.randrange(50, 60) for _ in range(5)] + [x for p in parts for x in p] + [r.randrange(60)]
        got = sum(t[2] for t in tiling.greedy_string_tiling(np.array(text, np.uint64), np.array(item, np.uint64), 3))
        assert got == brute_tiling(text, item, 3)


def test_contamination_finds_reordered_passages(spark, rows):
    item = prose(500, 40)
    w = item.split()
    moved = " ".join(w[25:] + ["between"] + w[:25])
    some = rows + [(900, "start " + item + " end"), (901, prose(7, 50) + " " + moved), (902, " ".join(w[:10]))]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in tiling.contamination(frame(spark, some, True), bench).collect()}
    assert set(got) == {(900, 1), (901, 1)}
    assert got[901, 1].tiles == 2 and got[901, 1].coverage == 1.0
    left = tiling.decontaminate(frame(spark, some), bench)
    assert left.count() == len(some) - 2


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeats_are_brute_force(spark, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    shared = prose(77, 70)
    some = rows + [(600, prose(1000, 40) + " " + shared + " tail é"), (601, "é " + shared.upper() + " " + prose(1001, 20)), (602, " ".join(["same"] * 200)), (603, " ".join(["same"] * 180))]
    found, seen = {}, defaultdict(set)
    for i, t in some:
        if i is None or t is None:
            continue
        found[i] = [(m.group(), m.start(), m.end()) for m in K.WORD.finditer(t.translate(K.FOLD))]
        for k in range(len(found[i]) - 49):
            seen[tuple(w for w, _, _ in found[i][k : k + 50])].add(i)
    want = []
    for i, m in found.items():
        spans = []
        for k in range(len(m) - 49):
            if len(seen[tuple(w for w, _, _ in m[k : k + 50])]) > 1:
                a, b = m[k][1], m[k + 49][2]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        want += [(i, a, b) for a, b in spans]
    got = [tuple(r) for r in suffixes.repeated_passages(frame(spark, some, True)).collect()]
    assert sorted(got) == sorted(want)


def test_suffix_sort_orders_like_python():
    r = np.random.default_rng(4)
    words = r.integers(0, 3, 400).astype(np.uint64)
    start = r.permutation(350)[:200]
    group = np.sort(r.integers(0, 4, 200))
    order = suffixes.SuffixSort(words, 20).sort(start, group)
    for g in range(4):
        mine = [tuple(words[s : s + 20].tolist()) for s in start[order][group == g]]
        assert mine == sorted(tuple(words[s : s + 20].tolist()) for s in start[group == g])


def test_packing_is_brute_force(spark, rows):
    window = 500
    got = packing.pack_by_retrieval(frame(spark, rows, True), window).collect()
    pieces = [(i, a, b) for r in got for i, a, b in zip(r.doc_ids, r.starts, r.ends)]
    want = defaultdict(int)
    for i, t in rows:
        if i is not None:
            want[i] += len(K.words_of(t))
    have = defaultdict(int)
    for i, a, b in pieces:
        have[i] += b - a
    assert have == {i: n for i, n in want.items() if n}
    assert all(r.n_words == sum(r.ends) - sum(r.starts) <= window for r in got)
    assert len(set((i, a) for i, a, _ in pieces)) == len(pieces) - 1  # doc 5 is there twice


def brute_packing(docs, window, every, chunk):
    """Windows by language and seed: BM25 of all seeds against all documents, word by word."""
    words = [(i, lang, K.words_of(t)) for i, t, lang, *_ in docs if K.words_of(t)]
    rows, average = len(words), sum(len(w) for _, _, w in words) / len(words)
    df = defaultdict(int)
    for _, _, w in words:
        for t in set(w):
            df[t] += 1
    idf = {t: float(packing.inverse_frequency(np.float64(n), rows)) for t, n in df.items()}
    seeds = [(i, lang, set(w)) for i, lang, w in words if i % every == 0]
    groups, exact, agree = defaultdict(list), 0, 0
    for i, lang, w in words:
        if i % every == 0:
            groups[lang, i].append((-1e9, i, len(w)))
            continue
        weight = {t: float(packing.bm25_weights(np.float64(w.count(t)), np.float64(len(w)), np.float64(idf[t]), average)) for t in set(w)}
        whole = {t: float(packing.impacts(np.float64(x), rows)) for t, x in weight.items()}
        scores, plain = [], []
        for s, its, terms in seeds:
            if its == lang:
                length = sum(idf[t] ** 2 for t in terms) ** 0.5
                scores.append((-sum(whole[t] for t in terms & weight.keys()) / length, s))
                plain.append((-sum(weight[t] for t in terms & weight.keys()) / length, s))
        best = min(scores, default=(0, None))
        groups[lang, best[1] if best[0] else None].append((best[0], i, len(w)))
        exact += 1
        agree += min(plain, default=(0, None))[1] == best[1]
    out = []
    for (lang, seed), members in groups.items():
        chunks, total = defaultdict(list), 0
        for _, i, n in sorted(members):
            rest = (n - 1) % window + 1
            chunks[total // (chunk * window)].append((i, n, rest))
            total += rest
        for c, waiting in chunks.items():
            for i, n, rest in waiting:
                out += [(lang or "", seed, c, [i], [a], [a + window]) for a in range(0, n - rest, window)]
            while waiting:
                left, members, later = window, [], []
                for i, n, rest in waiting:
                    if rest <= left:
                        left -= rest
                        members.append((i, n - rest, n))
                    else:
                        later.append((i, n, rest))
                out.append((lang or "", seed, c, *map(list, zip(*members))))
                waiting = later
    return out, agree / exact


def test_retrieval_packing_is_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    topics = [r.sample(words, 60) for _ in range(8)]
    docs = [(k, " ".join(r.choice(r.choice((topics[k % 8], words))) for _ in range(r.choice((5, 20, 60, 150, 500)))), r.choice(("en", "de", None)), "s", 0) for k in range(300)]
    docs += [(k, "only here", "xx", "s", 0) for k in (1001, 1002)] + [(1003, "nothing shared", "en", "s", 0)]
    docs += [(k, t, lang, s, 0) for k, t, lang, s, _ in docs[:30]] + [(2000 + k, t, lang, s, 0) for k, t, lang, s, _ in docs[:30]]
    want, recall = brute_packing(docs, 300, 10, 4)
    assert recall >= 0.9  # of integer impacts against unrounded scores
    key = lambda x: (x[0], x[1] is None, x[1] or 0, *x[2:])
    for partitions, shard_words, block_terms in ((5, 3000, 1_000_000), (2, 1_000_000, 700)):
        table = spark.createDataFrame(docs, SCHEMA).repartition(partitions)
        got = packing.pack_by_retrieval(table, 300, 10, shard_words, block_terms, 4).collect()
        assert sorted(((r.lang or "", r.seed, r.chunk, r.doc_ids, r.starts, r.ends) for r in got), key=key) == sorted(want, key=key)


def brute_cost(s):
    costs = {}
    for i in range(len(s)):
        for j, c in secrets.pattern_costs(s, i):
            costs[i, j] = min(c, costs.get((i, j), 99))
        for j in range(i + 2, len(s) + 1):
            for u in range(1, (j - i) // 2 + 1):
                if (j - i) % u == 0 and s[i : i + u] * ((j - i) // u) == s[i:j]:
                    costs[i, j] = min(costs.get((i, j), 99), brute_cost(s[i : i + u]) + log10((j - i) // u))
    best = [0.0] + [99.0] * len(s)
    for j in range(1, len(s) + 1):
        best[j] = min(best[i] + secrets.SEGMENT + min(sum(map(secrets.brute_cost, s[i:j])), costs.get((i, j), 99)) for i in range(j))
    return min(best[-1], secrets.CEILING)


def test_guess_cost_is_the_minimum():
    r = random.Random(2)
    values = ["".join(r.choice(["a", "12", "pass", "P4ss", "qwe", "2020", "x!", "abab"]) for _ in range(r.randint(1, 4)))[:10] for _ in range(60)]
    values += [r.choice(["password", "secret", "dog", "20"]) + r.choice("drgt0") * r.randint(1, 7) + r.choice(["", "dog", "xy"]) for _ in range(40)]
    values += ["".join(r.choice("ab") for _ in range(r.randint(10, 40))) for _ in range(20)] + ["ab" * 40 + "c" + "ab" * 9, "abcdefghijklmnopqrstuvwxyz!?" * 3, ("q7Lk2mZ9x" * 4 + "#") * 2 + "q7"]
    for s in values:
        assert abs(secrets.guess_cost(s) - brute_cost(s)) < 1e-9, s


def test_long_values_are_quick():
    began = time.perf_counter()
    r = random.Random(5)
    noise = "".join(r.choice("abcdefghij0123456789") for _ in range(1_000_000))
    for value in ("ab" * 500_000, noise, "a" * 999_999 + "b", noise[:500_000] * 2, "password" * 100_000, "qw" * 300_000, ("ab" * 20 + "c") * 20_000):
        assert 0 < secrets.guess_cost(value) <= secrets.CEILING
    assert secrets.guess_cost(noise) == secrets.CEILING
    assert list(secrets.findings("pass" * 250_000 + " x", secrets.Guesses())) == []
    assert time.perf_counter() - began < 20


def test_secrets(spark):
    value = "9f8Zk2Lq7Xw1Tn5B"
    some = [(1, f'db_password = "{value}" end'), (2, "password: changeme"), (3, None), (4, ""), (None, f"api_key={value}"), (5, "the token of love"), (6, "é token: " + "ab" * 2000)]
    some += [(7, f"password:      {value}"), (8, "token = os.environ['TOKEN'] secret: {{vault_token}} pwd=$PWD"), (9, "the elephant is an elephant; password: elephant")]
    some += [(10, "a_password_that_has_a_very_long_name_indeed : " + value), (11, "pass = " + "k3" * 400_000 + value)]
    got = secrets.scan(frame(spark, some, True)).collect()
    assert {(r.doc_id, r.verdict) for r in got} == {(1, "strong"), (2, "placeholder"), (None, "strong"), (6, "secret"), (7, "strong"), (8, "reference"), (9, "placeholder"), (10, "strong"), (11, "strong")}
    assert sum(r.verdict == "reference" for r in got) == 3
    assert all(t[r.start : r.end] == r.value for r in got for i, t in some if i == r.doc_id)
    df = frame(spark, some, True)
    masked = {r.doc_id: r for r in secrets.mask_secrets(df).collect()}
    assert value not in masked[1].text and masked[1].n_chars == len(masked[1].text) and masked[3].text is None
    assert all(masked[i].text == dict(some)[i] for i in (2, 4, 5, 8, 9))
    # every finding and mask, by the plain functions
    guesses = secrets.Guesses(secrets.ranked_words(df))
    assert sorted((r.doc_id or 0, r.start, r.end) for r in got) == sorted((i or 0, a, b) for i, t in some for a, b, *_ in secrets.findings(t or "", guesses))
    assert all(r.text == (secrets.masked(dict(some)[i], guesses) if dict(some)[i] else dict(some)[i]) for i, r in masked.items())


def test_dictionary_is_counted_over_all_texts(spark):
    texts = ["Beta alpha beta", "gamma, beta; ALPHA", None, "", "password = zebrazebra zebra"]
    ranks = secrets.ranked_words(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert (ranks["beta"], ranks["alpha"], ranks["gamma"], ranks["zebra"]) == (1, 2, 3, 4) and "zebrazebra" not in ranks


@pytest.mark.parametrize(
    "text,kind,source,value",
    [
        ("mail jane [at] site [dot] org now", "email", "jane [at] site [dot] org", "jane@site.org"),
        ("jane at site dot co dot uk", "email", "jane at site dot co dot uk", "jane@site.co.uk"),
        ("jаne@sitе.org", "email", "jаne@sitе.org", "jane@site.org"),
        ("call five five five one two three four five six seven ok", "phone", "five five five one two three four five six seven", "5551234567"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111"),
        ("ja​ne@site.org!", "email", "ja​ne@site.org", "jane@site.org"),
        ("host 10.0.0.255.", "ipv4", "10.0.0.255", "10.0.0.255"),
        ("IBAN DE89370400440532013000", "iban", "DE89370400440532013000", "DE89370400440532013000"),
    ],
)
def test_disguised_identifiers(text, kind, source, value):
    assert [(k, text[a:b], v) for k, a, b, v in deobfuscate.detect(text)] == [(kind, source, value)]


@pytest.mark.parametrize("text", ["look at example.com", "one two three go", "born 2020-01-31 there", "version 1.2.3", "we sat at the dot", "1234567890123456"])
def test_clean_text_has_no_identifiers(text):
    assert not [x for x in deobfuscate.detect(text) if x[0] != "phone" or "-" in text]


def test_pii_spans(spark, rows):
    some = rows + [(800, "é x@y.org " * 3), (None, "a@b.org")]
    got = deobfuscate.find_pii(frame(spark, some, True)).collect()
    assert sum(r.doc_id == 800 for r in got) == 3 and any(r.doc_id is None for r in got)
    assert all(dict(some)[r.doc_id][r.start : r.end] == r.source for r in got if r.doc_id == 800)


DISGUISES = [f"write to john.smith{at}example{dot}com please" for at in ("@", " [at] ", " (at) ", "<at>", "{at}", " [[at]] ", " [arroba] ", " (ät) ", " (ÄT) ", " [@] ", "_at_", "-at-", "_AT-") for dot in (".", " [dot] ", "(.)", "[.]", "<punkt>", " {punto} ", "(point)")] + ["to john at example dot com", "to john\tat\texample\tdot\tcom", "to john @ example.com"]


def found(spark, texts):
    out = defaultdict(list)
    for r in deobfuscate.find_pii(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect():
        out[r.doc_id].append((r.kind, r.start, r.end, r.value))
    return [sorted(out[k], key=lambda x: (x[1], x[2])) for k in range(len(texts))]


def test_every_disguise_passes_the_filter(spark):
    assert all(deobfuscate.detect(t) for t in DISGUISES)
    assert found(spark, DISGUISES) == [deobfuscate.detect(t) for t in DISGUISES]


def test_random_disguises_are_found(spark):
    r = random.Random(9)
    alike = {"a": "аɑ", "e": "е", "o": "оο", "i": "іı", "c": "с", "p": "рρ", "x": "х"}
    spelled = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))

    def strange(word):
        return "".join(r.choice(alike[c]) if c in alike and r.random() < 0.4 else c + ("\u200b" if r.random() < 0.15 else "") for c in word)

    texts, want = [], []
    for _ in range(120):
        before = " ".join(r.choice(["plain", "words", "stand", "here", "naïve"]) for _ in range(r.randint(1, 6))) + ": "
        if r.random() < 0.5:
            name, host = r.choice(["jane", "pope", "cox"]), r.choice(["example", "site"])
            at, dot = r.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "(.)"), (" at ", " dot ")])
            value, written = f"{name}@{host}.com", f"{strange(name)}{at}{strange(host)}{dot}com"
        else:
            value = "".join(r.choice("23456789") for _ in range(10))
            written = r.choice([" ", "\u00a0"]).join(strange(spelled[d]) for d in value)
        texts.append(before + written + "; end")
        want.append((value, written))
    for text, spans, (value, written) in zip(texts, found(spark, texts), want):
        assert [(v, text[a:b].strip(" \u200b")) for _, a, b, v in spans] == [(value, written.strip("\u200b"))], text


def test_long_texts_are_searched_quickly():
    began = time.perf_counter()
    for text in ("one " * 250_000, "a@" * 400_000, "1" * 1_000_000, "1 " * 500_000, "a at b dot " * 90_000, "[at]" * 250_000, "a." * 500_000 + " at x dot y", "x" * 1_000_000 + " at y dot com"):
        deobfuscate.detect(text)
    assert time.perf_counter() - began < 60


def test_combined_disguises_are_found(spark):
    plain = "call five five five one two three four five six seven ok"
    texts = [plain.translate(str.maketrans("eio", "еіо")), plain.replace("fi", "f\u200bi").replace("ne", "n\u200be"), plain.replace(" ", "\u00a0"), "pay four 1 " + "one 1 " * 7, "write to jоhn [аt] exаmple [dоt] com"]
    assert all(deobfuscate.detect(t) for t in texts)
    assert found(spark, texts) == [deobfuscate.detect(t) for t in texts]


def test_hilbert_curve():
    for n, bits in ((2, 4), (3, 3)):
        digits, following = hilbert.automaton(n)
        order = {}
        for p in itertools.product(range(1 << bits), repeat=n):
            state = index = 0
            for level in range(bits - 1, -1, -1):
                corner = 0
                for x in p:
                    corner = corner * 2 + (x >> level & 1)
                index = index << n | digits[state << n | corner]
                state = following[state << n | corner]
            assert index == hilbert.hilbert_index(p, bits)
            order[index] = p
        steps = [sum(abs(a - b) for a, b in zip(order[k], order[k + 1])) for k in range(len(order) - 1)]
        assert set(steps) == {1}


def test_hilbert_shards(spark, rows):
    df = frame(spark, rows, True)
    got = hilbert.hilbert_shards(df, target_chars=3000).collect()
    assert len(got) == len(rows)
    by_curve = sorted((r.hilbert, r.shard) for r in got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += len(r.text or "")
    assert len(sizes) > 3 and [s for _, s in by_curve if sizes[s] <= 3000] == sorted(s for _, s in by_curve if sizes[s] <= 3000)


def test_shards_are_pruned_by_their_ranges(spark, tmp_path):
    r = random.Random(6)
    docs = [(k, "x" * (n := r.randrange(1, 400)), r.choice(("en", "de", "fr", "es")), f"s{r.randrange(20):02}", n) for k in range(4000)]
    sharded = hilbert.hilbert_shards(spark.createDataFrame(docs, SCHEMA), target_chars=20_000, partitions=5)
    assert sharded.rdd.getNumPartitions() == 5
    hilbert.write_shards(sharded, str(tmp_path / "out"))
    box = {"lang": ("de", "de"), "n_chars": (10, 60)}
    got = hilbert.read_box(spark, str(tmp_path / "out"), **box)
    assert sorted(x.doc_id for x in got.collect()) == sorted(i for i, _, lang, _, n in docs if lang == "de" and 10 <= n <= 60)
    ranges = spark.read.parquet(str(tmp_path / "out" / "ranges")).collect()
    hit = [x for x in ranges if x.min_lang <= "de" <= x.max_lang and x.min_n_chars <= 60 and x.max_n_chars >= 10]
    assert len(ranges) > 30 and len(hit) < len(ranges) / 3
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_templates(spark):
    nav = "<nav class='m'><ul><li>Home page</li><li>About us</li></ul></nav>"
    pages = [(k, "http://Site.org/p", f"<html><body>{nav}<p>Own words {k}</p><footer>Fine print</footer></body></html>") for k in range(6)]
    pages += [(10, "http://other.org", f"<body>{nav}</body>"), (11, None, f"<body>{nav}</body>"), (12, "http://site.org/x", None), (13, "http://site.org/y", ""), (14, "http://site.org:80/z", "<p>open <b>tags"), (0, "http://site.org/p", pages[0][2])]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, removed string").selectExpr("*", *[f"'own' as {c}" for c in ("_of", "_hashes", "_host", "_hash", "_pages")])
    for limit in (1000, 0):  # broadcast, then joined
        got = {(r.page_id, r.url): r for r in templates.remove_templates(df, 5, 0.5, limit).collect()}
        assert got[1, "http://Site.org/p"].html == "<html><body><p>Own words 1</p></body></html>" and got[1, "http://Site.org/p"].removed == 2
        assert got[10, "http://other.org"].html == f"<body>{nav}</body>" and got[11, None].removed == 0
        assert got[12, "http://site.org/x"].html is None and got[13, "http://site.org/y"].html == "" and got[14, "http://site.org:80/z"].html == "<p>open <b>tags"


def brute_templates(pages, min_pages, min_share):
    """The cleaned pages: elements by a simple parser of well-formed markup, compared as text."""

    def elements(html):
        out, stack = [], []
        for m in re.finditer(r"<(/?)(\w+)[^>]*>", html):
            if not m[1]:
                stack.append((m[2], m.start()))
            else:
                name, start = stack.pop()
                assert name == m[2]
                if name not in ("html", "body") and m.end() - start >= templates.MIN_CHARS:
                    out.append((start, m.end(), re.sub(r"\s+", " ", html[start : m.end()])))
        return out

    count, total = defaultdict(int), defaultdict(int)
    for host, html in pages:
        total[host] += 1
        for text in {e[2] for e in elements(html)}:
            count[host, text] += 1
    cleaned = []
    for host, html in pages:
        gone = [e for e in elements(html) if count[host, e[2]] >= min_pages and count[host, e[2]] >= min_share * total[host] and total[host] >= min_pages]
        outer = [e for e in gone if not any(x[0] <= e[0] and e[1] <= x[1] and x != e for x in gone)]
        for a, b, _ in sorted(outer, reverse=True):
            html = html[:a] + html[b:]
        cleaned.append((html, len(outer)))
    return cleaned


def test_templates_are_brute_force(spark):
    r = random.Random(3)

    def tree(depth):
        name = r.choice(["div", "ul", "section", "b"])
        inner = "".join(tree(depth - 1) for _ in range(r.randint(1, 3))) if depth else r.choice(["home page", "about us", f"own {r.randrange(40)}"])
        return f"<{name} class='c{r.randrange(2)}'>{inner}</{name}>"

    shared = [tree(r.randrange(3)) for _ in range(30)]
    pages = [(f"h{k % 3}.org", "<html><body>" + "".join(r.choice(shared) if r.random() < 0.7 else tree(2) for _ in range(6)) + "</body></html>") for k in range(60)]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", t) for k, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    want = brute_templates(pages, 5, 0.1)
    got = {x.page_id: (x.html, x.removed) for x in templates.remove_templates(df, 5, 0.1).collect()}
    assert [got[k] for k in range(60)] == want and sum(n for _, n in want) > 60


def test_broken_markup_is_read_in_linear_time():
    began = time.perf_counter()
    for text in ("<a " * 350_000, "<b>" * 300_000 + "</i>" * 200_000, '<a "' * 250_000, "<!" * 500_000, "</a " * 250_000, "<a '<a '" * 120_000 + ">", "<script>" * 120_000):
        templates.subtrees(text)
    assert time.perf_counter() - began < 30


def labelled(n, seed):
    r = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = prose(seed * 1000 + k, r.randrange(20, 200)).split()
        bad = k % 3 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 2 else [w + r.choice(["$$$", "###"]) for w in words]
        texts.append(" ".join(words))
        labels.append(0 if bad else 1)
    return texts, np.array(labels, np.float32)


def test_network_gradients_and_accuracy():
    texts, labels = labelled(6, 3)
    net = bytecnn.Network.fresh(1)
    data, first = bytecnn.padded([t.encode() for t in texts])
    grads = net.gradients(data, first, labels)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(data, first, net.tables())["logit"].astype(float)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for w, g in zip(net.weights(), grads):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[k].copy()
        w[k] = old + 1e-3
        up = loss()
        w[k] = old - 1e-3
        down = loss()
        w[k] = old
        assert abs((up - down) / 2e-3 - g[k]) < 0.05 * abs(g[k]) + 1e-3
    train, y = labelled(240, 5)
    net = bytecnn.train([t.encode() for t in train], y, epochs=8)
    held, z = labelled(120, 6)
    p = bytecnn.score_column(net, pa.array([*held, None, ""]))
    assert ((p[:-2] >= 0.5) == (z == 1)).mean() > 0.95 and p[-1] == p[-2] == 0


def test_network_is_brute_force():
    r = np.random.default_rng(5)
    net = bytecnn.Network.fresh(4)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (1, 7, 128, 129, 300, 700)]
    got = bytecnn.score_column(net, pa.array([t.decode() for t in texts]))
    for text, p in zip(texts, got):
        cells = -(-(len(text) + bytecnn.WIDTH) // bytecnn.HOP)
        codes = [*[256] * bytecnn.WIDTH, *text, *[256] * (cells * bytecnn.HOP - len(text))]
        top = []
        for c in range(cells):
            best = np.full(bytecnn.FILTERS, -np.inf)
            for i in range(c * bytecnn.HOP, (c + 1) * bytecnn.HOP, bytecnn.STRIDE):
                best = np.maximum(best, sum(net.embed[codes[i + k]].astype(float) @ net.filters[k] for k in range(bytecnn.WIDTH)))
            top.append(best)
        chunks = [np.maximum(top[c], top[min(c + 1, cells - 1)]) for c in range(cells)]
        hidden = np.array([np.maximum(np.maximum(x + net.bias, 0) @ net.dense + net.dense_bias, 0) for x in chunks])
        logit = np.concatenate((hidden.max(0), hidden.mean(0))) @ net.out + net.out_bias[0]
        assert abs(p - 1 / (1 + np.exp(-logit))) < 1e-4


def test_network_reads_whole_texts():
    net = bytecnn.Network.fresh(2)
    text = prose(1, 60_000)
    assert len(text) > 4 * bytecnn._BLOCK
    one = bytecnn.score_column(net, pa.array([text]))[0]
    assert one != bytecnn.score_column(net, pa.array([text[:-4000]]))[0]


def test_quality_stage_keeps_columns(spark, monkeypatch):
    texts, y = labelled(90, 9)
    docs = frame(spark, list(enumerate(texts)), True)
    labels = spark.createDataFrame([(k, int(v), 0) for k, v in enumerate(y)] + [(None, 1, 0), (3, None, 0), (4, int(y[4]), 1), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in docs.collect()} == set(range(90))
    taught = []
    original = bytecnn.train
    monkeypatch.setattr(bytecnn, "train", lambda texts, labels: taught.append(len(texts)) or original(texts, labels))
    kept = bytecnn.keep_good(docs, bytecnn.fit_quality(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(k in ids) == (v == 1) for k, v in enumerate(y)]) > 0.95
    assert taught == [89]  # the document that is labelled good and bad teaches nothing


def test_decision_list(spark):
    texts, y = labelled(300, 12)
    docs = frame(spark, [*enumerate(texts), (None, None), (999, "")], True)
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y) if k < 200], "doc_id long, quality int")
    rules = rulelists.fit_rules(docs, labels)
    got = rulelists.judge(docs, rules).collect()
    assert len(got) == len(texts) + 2
    held = [(r.good, y[r.doc_id] == 1) for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert np.mean([a == b for a, b in held]) > 0.95
    table = rulelists.statistics(docs).toPandas()
    x = {s: table[s].to_numpy() for s in rulelists.STATISTICS}
    first = np.zeros(len(table), int)
    for k in range(len(rules), 0, -1):
        first[rules[k - 1].holds(x)] = k
    want = dict(zip(table["doc_id"].fillna(-1).astype(int), first))
    assert {(-1 if r.doc_id is None else r.doc_id): r.rule for r in got} == want
    assert all(r.reason == (str(rules[r.rule - 1]) if r.rule else None) for r in got)
    # the statistics by plain Python
    for i, text in [*enumerate(texts[:40]), (999, "")]:
        row, words = table[table.doc_id == i].iloc[0], text.split()
        n = len(text)
        assert (row.n_chars, row.n_words) == (n, len(words)) and row.capitals == (sum(unicodedata.category(c) == "Lu" for c in text) / n if n else 0)
        assert row.distinct_words == (len({w.lower() for w in words}) / len(words) if words else 0) and row.exclaims == (text.count("!") / n if n else 0)
