"""Cases that the operators once left out."""

import random
import string
import textwrap
import unicodedata

import corpus_pipeline
from tidemark.llm import license_scan, quality, secret_scan


def test_wrapped_and_repeated_notices_are_found(prose):
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.3, 0.2)
    for name in (k for k in license_scan.TEMPLATES if not k.endswith("-line")):
        text = license_scan.TEMPLATES[name]
        cut = text.index(" ", len(text) // 2)
        for width in (40, 80):
            wrapped = "\n\n".join("\n".join(f"# {x}" for x in textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False)) for part in (text[:cut], text[cut:]))
            found = s.text(f"{prose(1)}\n{wrapped}\n{prose(2, 9)}\n{wrapped}\n{wrapped}\n{prose(3)}")
            assert [(x[2], x[4]) for x in found] == [(name, 0)] * 3
    # an altered copy beside an exact one, and all templates next to each other
    mit = license_scan.TEMPLATES["MIT"]
    assert [x[2] for x in s.text(mit.replace("without", "w/o").replace("Software", "Program") + "\n" + mit)] == ["MIT"] * 2
    every = s.text("\n".join(license_scan.TEMPLATES.values()))
    assert [(x[2], x[4]) for x in every] == [(k, 0) for k in license_scan.TEMPLATES]


def test_clean_texts_of_other_scripts_are_plain(spark):
    hindi = "यह एक साफ़ वाक्य है जिसमें हिन्दी के सामान्य शब्द लिखे गए हैं। "
    texts = [hindi * 5, "এটি বাংলা ভাষায় লেখা একটি পরিষ্কার বাক্য " * 5, "இது தமிழ் மொழியில் எழுதப்பட்ட வாக்கியம் " * 5, unicodedata.normalize("NFD", "déjà vu à l'été près de la forêt ") * 5, "In 2021 the 14 plants made 3,450.5 units, 12% of 28,000 " * 5]
    df = quality.with_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    votes = {r["i"]: r["v"] for r in df.select("row.doc_id", quality.default_rules()[3].vote().alias("v")).toDF("i", "v").collect()}
    assert votes == dict.fromkeys(range(len(texts)), quality.GOOD)


def test_random_tokens_within_paths_are_found(spark, prose):
    r = random.Random(9)
    token = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    keys = [token(n) for n in (24, 32, 40, 64) * 10]
    shapes = ("https://example.com/hooks/v1-a/{}", "see files/my_app/{}/index", "https://example.com/reset/en/{}", "name_of-{}")
    docs = [(i, f"{prose(i, 30)} {shapes[i % 4].format(k)} {prose(i + 1, 30)}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = dict(docs)
    rows = {x["doc_id"]: [texts[x["doc_id"]][s["start"] : s["end"]] for s in x["spans"] if s["kind"] == 3] for x in secret_scan.scan(df).collect()}
    assert sum(any(k in s for s in rows[i]) for i, k in enumerate(keys)) >= 0.9 * len(keys)
    left = {x["doc_id"]: x["text"] for x in secret_scan.redact(df).collect()}
    assert sum(k not in left[i] for i, k in enumerate(keys)) >= 0.9 * len(keys)


def test_pipeline_mixes_by_quality(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three four five", "ab"[i % 2]) for i in range(800)], "doc_id long, text string, source string")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 800, 2)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    took = {r["doc_id"]: r["count"] for r in corpus_pipeline.mixing_stage(spark, docs, f"file://{tmp_path}").groupBy("doc_id").count().collect()}
    good, bad = (sum(took.get(i, 0) for i in range(k, 800, 4)) for k in (0, 2))
    assert good > 1.15 * bad
