"""Language, quality, secrets, licenses, mixture and packing against plain Python."""

import hashlib
import math
import random
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import language_id, license_scan, mixing, packing, quality, queries, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Language


def test_language_held_out_accuracy(spark, sf_dir):
    out = queries.op1_language_id(spark, sf_dir)
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = out.join(lang, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out.collect())


def test_language_by_brute_force(spark, prose):
    import numpy as np

    texts = [prose(i, 60) for i in range(4)] + [prose(i, 60, ("xi", "qua", "zo", "bre")) for i in range(4)]
    langs = ["aa"] * 4 + ["bb"] * 4
    model = language_id.train(spark.createDataFrame(list(zip(langs, texts)), "lang string, text string"), dims=256)
    enc = language_id.Encoder(256, 7)

    def profile(text):
        s = f" {text.rstrip('.')} "
        total = np.zeros(256)
        for a, b, c in zip(s, s[1:], s[2:]):
            total += np.roll(enc.letter(ord(a)).astype(int), 2) * np.roll(enc.letter(ord(b)).astype(int), 1) * enc.letter(ord(c))
        return total / np.linalg.norm(total)

    for k, lang in enumerate(model.langs):
        p = sum(profile(t) for t, x in zip(texts, langs) if x == lang)
        assert np.allclose(model.prototypes[k], p / np.linalg.norm(p), atol=1e-5)
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        cosines = model.prototypes @ profile(t)
        assert got[i]["lang_pred"] == model.langs[cosines.argmax()] and got[i]["score"] == pytest.approx(cosines.max(), abs=1e-5)


def test_language_segments_do_not_matter(monkeypatch, prose):
    import numpy as np

    texts = [prose(1, 300), None, "", "12 %", prose(2, 5), "x"]
    whole = language_id.Encoder(64, 7).profiles(texts, range(6), 6)
    monkeypatch.setattr(language_id, "SEGMENT", 100)
    assert np.array_equal(whole, language_id.Encoder(64, 7).profiles(texts, range(6), 6))
    assert not whole[[1, 2, 3]].any() and whole[5].any()


def test_letters_are_those_of_unicode():
    apart, letter = language_id._patterns()
    assert apart.split("हिन्दी भाषा, a½b ²Ⅷ_ déjà") == ["हिन्दी", "भाषा", "a", "b", "déjà"]
    enc = language_id.Encoder(64, 7)
    assert not enc.profiles(["½ ² Ⅷ", "12_%", "́̀"], range(3), 3).any() and enc.profiles(["ह", "ａ", "ʰ"], range(3), 3).any(axis=1).all()
    assert all((letter.match(chr(c)) is not None) == unicodedata.category(chr(c)).startswith("L") for c in range(0x30000))


@given(st.text(max_size=30))
def test_words_are_found_either_way(text):
    apart, letter = language_id._patterns()
    assert language_id.words_apart(text) == (apart.sub(" ", text.lower()).strip() if letter.search(text.lower()) else "")


def test_language_odd(odd_docs, no_docs):
    model = language_id.train(odd_docs)
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {r["lang_pred"] for r in rows} == {"aa", "und"}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == r["und"] for r in rows)
    assert {r["doc_id"] for r in rows if r["und"]} == {2, 3, 4, None}
    empty = language_id.train(no_docs)
    assert empty.langs == () and {r["lang_pred"] for r in language_id.predict(odd_docs, empty).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


# Quality


def brute_features(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_quality_rules(spark, sf_dir).collect():
        want = brute_features(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab c\n\t#|\x0b ", max_size=40), max_size=4))
def test_quality_counts_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    names = ["q_n_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat_words"]
    got = quality.with_features(df).select("row.doc_id", *names).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == {i: brute_features(t) for i, t in enumerate(texts)}


def test_quality_posterior_by_hand():
    rng = random.Random(5)
    truth, patterns = [], Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = tuple((1 if rng.random() < 0.97 else -1) if good else (-1 if rng.random() < p else 1) for p in (0.7, 0.6, 0.8))
        truth.append((good, votes))
        patterns[votes] += 1
    m = quality.fit(list(patterns.items()), 3)
    assert m.prior == pytest.approx(0.8, abs=0.04) and m.given_bad[2][-1] == pytest.approx(0.8, abs=0.1)

    def posterior(votes):
        good = m.prior * math.prod(g[v] for g, v in zip(m.given_good, votes))
        return good / (good + (1 - m.prior) * math.prod(b[v] for b, v in zip(m.given_bad, votes)))

    assert sum((posterior(v) >= 0.5) == good for good, v in truth) / len(truth) > 0.95


def test_quality_keeps_good_and_drops_bad_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op7_quality_rules(spark, sf_dir).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.98


def test_quality_odd(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(not r["q_kept"] for r in rows if r["doc_id"] in (2, 3, 4, 5, 12))
    assert quality.judge(no_docs).count() == 0 and quality.kept_rows(no_docs).count() == 0
    kept = quality.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["q_kept"])


# Secrets


def brute_spans(text):
    t, out = text or "", []
    for kind, pattern, least, group in ((0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), (1, "AKIA[A-Z0-9]+", 20, 0), (2, "[0-9a-f]+", 24, 0)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t, re.A) if len(m[group]) >= least]
    return sorted(out)


def test_secret_base_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_secret_scan(spark, sf_dir).collect():
        want = brute_spans(texts[r["doc_id"]])
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "apikey", "=", ": ", ":", '"', "'", "abcdef", "abcde", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", " ", "Key", "tokſen", "é"]), max_size=12))
def test_secret_spans_of_any_text(parts):
    assert secret_scan.base_spans("".join(parts)) == brute_spans("".join(parts))


def test_random_strings_are_found_and_prose_is_not(spark, prose):
    r = random.Random(3)
    alnum = string.ascii_letters + string.digits
    keys = ["".join(r.choice(alnum) for _ in range(n)) for n in (24, 32, 40, 64) * 10]
    camel = ["getTheNumberOfAllOpenFilesInTheFolder2", "ABOUT-this-very-long-hyphenated-name-of-a-page", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111111", "JavaScriptObjectNotation1"]
    docs = [(i, f"{prose(i, 30)} {k} {prose(i + 1, 30)}") for i, k in enumerate(keys)] + [(100 + i, f"{prose(i, 30)} {c} end") for i, c in enumerate(camel)]
    rows = {x["doc_id"]: x["spans"] for x in secret_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(any(s["kind"] == 3 and docs[i][1][s["start"] : s["end"]] == k for s in rows[i]) for i, k in enumerate(keys))
    assert found >= 0.9 * len(keys) and not any(s["kind"] == 3 for i in range(4) for s in rows[100 + i])


def test_p_values_are_uniform_on_random_strings():
    r = random.Random(1)
    for name, n in (("hex", 20), ("base36", 24), ("base62", 32), ("base64", 90)):
        ps = [f[1] for f in (secret_scan.randomness("".join(r.choices(secret_scan.ENCODINGS[name], k=n))) for _ in range(800)) if f]
        for p in (0.02, 0.1, 0.5, 0.9):
            assert sum(x <= p for x in ps) / len(ps) == pytest.approx(p, abs=0.05)
    assert secret_scan.combined((1e-9, 0.5, 0.5)) < 1e-6


#: Names, slugs and paths that look somewhat random.
LOOKALIKES = ("user-profile-picture-large-version-2-final", "Lorem-Ipsum-Dolor-Sit-Amet-Consectetur-1", "https/en/wiki/HistoryOfTheWorld/Chapter12/Section3", "getTheNumberOfAllOpenFilesInTheFolder2",
              "ABOUT-this-very-long-hyphenated-name-of-a-page", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111111", "JavaScriptObjectNotation1", "2024-01-05T00-00-00Z", "content/uploads/2019/07/IMG_20190703", "org/apache/hadoop/mapreduce/Job2")


def test_precision_and_recall_on_planted_secrets(spark, prose):
    """Random strings of all encodings and lengths from 16 on, beside as many names, slugs and paths made of words."""
    r = random.Random(12)
    kinds = list(secret_scan.ENCODINGS)[3:]
    secrets = ["".join(r.choices(secret_scan.ENCODINGS[kinds[i % len(kinds)]], k=r.choice([16, 20, 24, 32, 40, 64]))) for i in range(400)]
    word = lambda: prose(r.randrange(10**6), 1).rstrip(".")
    made = lambda: r.choice(["-", "_", "/", ""]).join(r.choice([str.title, str, str.upper])(word()) for _ in range(r.randint(3, 6))) + str(r.choice([1, 2, 2024, 77]))
    names = [*LOOKALIKES, *(made() for _ in range(390))]
    docs = [(i, f"{prose(i, 9)} {x} {prose(i + 1, 9)}") for i, x in enumerate([*secrets, *names])]
    rows = {x["doc_id"]: [docs[x["doc_id"]][1][s["start"] : s["end"]] for s in x["spans"] if s["kind"] == 3] for x in secret_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hits = sum(any(len(y) > 0.6 * len(s) and y in s for y in rows[i]) for i, s in enumerate(secrets))
    false = sum(bool(rows[len(secrets) + i]) for i in range(len(names)))
    print(f"recall {hits / len(secrets):.3f}, precision {hits / (hits + false):.3f}")
    assert hits >= 0.95 * len(secrets) and false <= 0.1 * (hits + false)
    assert [rows[len(secrets) + i] for i in range(len(LOOKALIKES)) if rows[len(secrets) + i]] == []


def test_thresholds_rise_where_prose_passes():
    cell = lambda p: int(-math.log10(p) * 20)
    clean = Counter(cell((i + 0.5) / 1000) for i in range(1000))
    low = secret_scan._threshold(clean, 0.05, 0.01, 20)
    mixed = clean + Counter({cell(0.05): 300})
    assert low < 0.012 and 0.05 < secret_scan._threshold(mixed, 0.05, 0.01, 20) < 0.5


def test_secret_odd_and_redaction(spark, odd_docs, no_docs):
    rows = secret_scan.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and secret_scan.scan(no_docs).count() == 0
    out = secret_scan.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    plain = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] != 12)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] != 12) == plain
    t = spark.createDataFrame([(1, "a token = deadbeefdeadbeefdeadbeef01 b")], "doc_id long, text string")
    assert secret_scan.redact(t).first()["text"] == "a [assign] b"


# Licenses


def test_license_lines(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lines = {v: k for k, v in license_scan.TEMPLATES.items() if k.endswith("-line")}
    want = {(i, lines[x.strip()]) for i, t in texts.items() for x in t.split("\n") if x.strip() in lines}
    assert {(r["doc_id"], r["license"]) for r in queries.op4_license_scan(spark, sf_dir).where("differences = 0").collect()} == want


def test_license_texts_with_changes_and_lookalikes(prose):
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.3, 0.2)
    for name in (k for k in license_scan.TEMPLATES if not k.endswith("-line")):
        text = license_scan.TEMPLATES[name]
        whole = f"{prose(1)}\n{text}\n{prose(2)}"
        (a, b, found, _, differences, _), *rest = s.text(whole)
        assert (found, differences, rest) == (name, 0, []) and whole[a:b] in text
        assert text[: len(text) - 3] in whole[a : b + 3]
        changed = " ".join("changed" if i in (5, 11) else w for i, w in enumerate(text.split()))
        assert s.text(changed)[0][2] == name and s.text(changed)[0][4] > 0
    assert s.text("The driver needs a license. " + prose(4)) == [] and s.text(prose(5)) == []


def test_license_recall_on_altered_notices(prose):
    """Every template with up to an eighth of its words changed, dropped or added, wrapped at odd widths, several to a text."""
    import textwrap

    r = random.Random(7)
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.3, 0.2)
    planted = found = wrong = 0
    for k in range(40):
        names = r.sample(list(license_scan.TEMPLATES), 6)
        parts = []
        for name in names:
            w = license_scan.TEMPLATES[name].split()
            for _ in range(len(w) // 8 if r.random() < 0.5 else 0):
                i = r.randrange(1, len(w) - 1)
                w[i : i + 1] = r.choice([["changed"], [], [w[i], "added"]])
            parts.append("\n".join(textwrap.wrap(" ".join(w), r.choice([30, 72, 200]), break_on_hyphens=False, break_long_words=False)))
        got = [x[2] for x in s.text(f"\n{prose(k, 12)}\n".join(parts))]
        hit = sum((Counter(got) & Counter(names)).values())
        planted, found, wrong = planted + len(names), found + hit, wrong + len(got) - hit
    print(f"recall {found / planted:.3f}, precision {found / (found + wrong):.3f}")
    assert found >= 0.95 * planted and wrong <= 0.05 * found


def test_license_odd(odd_docs, no_docs):
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0


# Mixture


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    left = sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check_mix(docs, rows):
    sizes = defaultdict(int)
    for source, size in docs:
        sizes[source] += size
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max((z for x, z in docs if x == s), default=0)
    # complete epochs come first: within a source numbers of copies differ by one at most
    for s in sizes:
        copies = {r["taken"] // r["size"] for r in rows if r["source"] == s and r["size"]}
        assert max(copies, default=0) - min(copies, default=0) <= 1


def test_mix_by_brute_force(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["a", "a", "a", "b", "c", "d", "é", None]), r.randint(0, 300)) for i in range(900)] + [(1000, "tiny", 3), (1001, "none", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    mix = lambda d, **how: mixing.mix(d, size=F.col("size"), **how).selectExpr("doc_id", "source", "size", "mix_source_size source_size", "mix_target target", "size * mix_copies taken").collect()
    rows = mix(df)
    check_mix([(s, z) for _, s, z in docs], rows)
    for how in ({"broadcast_sources": 0}, {"edge_rows": 3}):
        again = mix(df.repartition(7), **how)
        assert {(x["doc_id"], x["taken"]) for x in rows} == {(x["doc_id"], x["taken"]) for x in again}


def test_mix_where_weights_crowd_the_keys(spark):
    r = random.Random(4)
    docs = [(i, r.choice("aab"), r.randint(0, 50), r.choice([0.01, 1.0, 500.0])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, w double")
    rows, again = ({(x["doc_id"], x["mix_copies"]) for x in mixing.mix(df, size=F.col("size"), weight=F.col("w"), weights=(1.0, 3.0), edge_rows=n).collect()} for n in (10**6, 2))
    assert rows == again and len(rows) == 3000


def test_weights_of_labels_however_they_are_joined(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    for n in (100, 0):
        rows = mixing.quality_weights(docs, labels, broadcast_labels=n).collect()
        assert sorted((str(r["doc_id"]), r["mix_weight"]) for r in rows) == [("1", 2.0), ("2", 2.0), ("2", 2.0), ("3", 0.5), ("None", 1.0)]


def test_mix_prefers_heavy_documents(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 10, 9.0 if i % 4 == 0 else 1.0) for i in range(800)], "doc_id long, source string, size long, w double")
    rows = mixing.mix(df, size=F.col("size"), weight=F.col("w"), weights=(1.0, 3.0)).where("source = 'a'").collect()
    took = Counter((x["w"], x["mix_copies"]) for x in rows)
    assert took[9.0, 1] / 200 > 0.7 > 0.3 > took[1.0, 1] / 200


def test_mix_odd(odd_docs, no_docs):
    rows = mixing.mix(odd_docs.withColumn("mix_copies", F.lit("x"))).selectExpr("doc_id", "source", "mix_size size", "mix_source_size source_size", "mix_target target", "mix_size * mix_copies taken").collect()
    texts = [(r["source"], len(WORD.findall(r["text"] or ""))) for r in odd_docs.collect()]
    assert len(rows) == len(texts)
    # repeated rows are taken or left together, so allow for each source its three equal rows
    sizes = defaultdict(int)
    for s, z in texts:
        sizes[s] += z
    assert {r["source"]: r["target"] for r in rows} == {s: pytest.approx(t) for s, t in brute_targets(dict(sizes)).items()}
    assert mixing.mix(no_docs).count() == 0


# Packing


def test_word_ids_are_the_tokenizers(spark, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    words, whole = packing.WordIds(path), Tokenizer.from_file(path)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += ["", " ", "\n\n", "It's DON'T we'll", "x\x1cy\x85z w v", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ straße ǅ é e ́ ﬁ", "漢字かな🙂🙂🏽", "a_b-c…“q”", "1234 ½ ² ª", "\x00�", "don't 's 'T 'Re"]
    for t in texts:
        assert words(t) == b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids), t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_word_ids_of_any_text(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    held = test_word_ids_of_any_text.__dict__.setdefault("held", (packing.WordIds(path), Tokenizer.from_file(path)))
    assert held[0](text) == b"".join(i.to_bytes(4, "little") for i in held[1].encode(text, add_special_tokens=False).ids)


def check_places(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at and n > 0
            at += n
        assert at <= limit
    return len(by)


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins, at, fills = packing.best_fit(sorted(lengths, reverse=True), 50)
    n = check_places([{"sequence_id": b, "offset": a, "length": x} for b, a, x in zip(bins, at, sorted(lengths, reverse=True))], 50)
    assert n == len(fills) and sum(fills) == sum(lengths) and n <= max(1, -(-sum(lengths) * 11 // (9 * 50)) + 1) + len([x for x in lengths if x > 25])
    assert all(f + min(fills) > 50 for f in sorted(fills)[1:])


@pytest.mark.parametrize("how", [{}, {"per_task": 60}, {"per_task": 60, "slack": 0}])
def test_pack_rounds(spark, how):
    r = random.Random(4)
    items = [(i, min(100, int(r.expovariate(1 / 30)) + 1)) for i in range(800)] + [(1000 + i, 60) for i in range(50)]
    out = packing.pack(spark.createDataFrame(items, "item long, fill long"), limit=100, **how).collect()
    assert Counter(x["item"] for x in out) == Counter(i for i, _ in items)
    fill = dict(items)
    n = check_places([{"sequence_id": x["sequence_id"], "offset": x["offset"], "length": fill[x["item"]]} for x in out], 100)
    assert n <= 1.12 * sum(fill.values()) / 100 + 8


def test_pack_in_parts_loses_a_bin_a_part_at_most(spark):
    r = random.Random(8)
    mixed = [r.randint(2100, 3000) for _ in range(1000)] + [r.randint(50, 900) for _ in range(2200)]
    for lengths in (mixed, [3000] * 500, [10] * 700, [2049] * 300 + [2047] * 300):
        once = len(packing.best_fit(sorted(lengths, reverse=True), 4096)[2])
        out = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "item long, fill long"), per_task=200).collect()
        n = check_places([{"sequence_id": x["sequence_id"], "offset": x["offset"], "length": lengths[x["item"]]} for x in out], 4096)
        assert len(out) == len(lengths) and n <= once + -(-len(lengths) // 200)


def test_bins_that_can_take_another_stay_open():
    assert packing.still_open({4090: 5, 3000: 4, 1096: 2, 4000: 1}, 4096, 8) == (3000, 6)
    assert packing.still_open({3000: 9, 4096: 1}, 4096, 8) == packing.still_open({100: 1}, 4096, 8) == packing.still_open({}, 4096, 8) == (0, 0)


def test_pack_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = [*whole.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + 4096]))) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(by[d["doc_id"]]) == want
    assert check_places(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_pack_odd(odd_docs, no_docs):
    path = queries.tokenizer_path()
    rows = packing.pack_documents(odd_docs, path, limit=64).collect()
    check_places(rows, 64)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in odd_docs.collect())
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert packing.pack_documents(no_docs, path).count() == 0


def test_licenses_are_nominated_by_compression_before_their_wording(monkeypatch):
    notice = "any one may use it for all of us now and let it go on as is if so"
    scanner = license_scan.Scanner({"T": notice}, 0.3, 0.2)
    held = []
    places = scanner.places
    monkeypatch.setattr(scanner, "places", lambda words, name: held.append(name) or places(words, name))
    # all words of the notice, none beside its neighbour: knowing it saves nothing
    apart = " ".join(f"{w} {i * 7919 % 100003:x}" for i, w in enumerate(reversed(notice.split())))
    assert scanner.text(f"license {apart}") == [] and held == []
    filler = " ".join(f"word{i * i % 997}" for i in range(400))
    assert [x[2] for x in scanner.text(f"{filler} license {notice} {filler}")] == ["T"] and set(held) == {"T"}
