"""The pipeline's stages, each against brute force on what the stage before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import queries, secrets
from starloom.llm.shared import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        kept[name] = docs
        if name != "pack":
            assert docs.columns == columns and docs.filter("n_chars <> length(text)").count() == 0
    verdict = {r.doc_id for r in queries.op10_quality_rules(spark, sf).filter("kept").collect()}
    assert {r.doc_id for r in kept["quality_rules"].collect()} == verdict

    before = {r.doc_id: r.text for r in kept["quality_rules"].collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.encode().translate(low).split()) for i, t in before.items())}
    left = {r.doc_id for r in kept["near_dedup"].collect()}
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    order = sorted(left)
    assert not any(linked(sets[i], sets[j]) for k, i in enumerate(order) for j in order[k + 1 :])
    assert all(any(linked(sets[i], sets[j]) for j in sets if j != i) for i in set(before) - left)

    words = {r.doc_id: r.text.encode().split() for r in kept["near_dedup"].collect()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    after = {r.doc_id: r.text.encode().split() for r in kept["substring_dedup"].collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        assert after.get(i, []) == [x for x, g in zip(w, gone) if not g]

    clean = kept["secret_scan"].collect()
    assert len(clean) == len(after) and not any(secrets.find_spans(r.text) for r in clean)
    packed = kept["pack"].collect()
    assert {r.doc_id for r in packed} == set(after) and all(len(r.ids) == r.length for r in packed)
    assert corpus_pipeline.ORACLE_SQL is None


WORDS = [f"w{i}" for i in range(60)]
AWKWARD = [
    (1, " ".join(WORDS), "en", "a", 0), (1, " ".join(WORDS), "en", "a", 0), (2, " ".join(["x", *WORDS[:50], "y"]), None, None, None), (None, " ".join(WORDS[::-1]), "en", "b", 0),
    (None, None, None, None, None), (3, "", "de", "a", 0), (4, None, "fr", "a", 0), (5, "  \n\t ", "en", "a", 4), (6, "password: hunter22 " + "z " * 20_000, "en", "c", 0),
    (7, "one", "en", "a", 3), (8, "password: hunter22 and more", "en", "a", 27),
]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("a", "b", "id", "n", "key", "spans", "quality", "substring", "chosen", "root", "blob__", "length"):
        docs = docs.withColumn(name, F.lit(1))
    return docs.cache()


def kept(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, sf, awkward, name):
    out = STAGES[name](spark, awkward.filter("doc_id = 99"), sf)
    assert out.count() == 0 and (name == "pack" or out.columns == awkward.columns)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "pack"])
def test_extra_columns_pass(spark, sf, awkward, name):
    out = STAGES[name](spark, awkward, sf)
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    assert out.filter("a <> 1 or `blob__` <> 1 or length <> 1 or `key` <> 1").count() == 0


def test_quality_stage_on_awkward_rows(spark, sf, awkward):
    prose = [r.text for r in queries.op10_quality_rules(spark, sf).filter("kept").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").limit(1).collect()][0]
    more = spark.createDataFrame([(50, prose, None), (50, prose, None), (None, prose, "EN")], "doc_id bigint, text string, lang string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    assert kept(STAGES["quality_rules"](spark, docs, sf)) == sorted([(-1, prose), (50, prose), (50, prose)], key=str)


def test_near_dedup_stage_on_awkward_rows(spark, sf, awkward):
    got = kept(STAGES["near_dedup"](spark, awkward, sf))
    text = {r[0]: r[1] for r in AWKWARD if r[0] is not None}
    # of 1 (twice) and 2, which share 46 of 60 shingles (0.77), all ids stay; texts without words stay; one of two equal rows goes
    want = [(i, text[i]) for i in (1, 2, 3, 4, 5, 6, 7, 8)] + [(-1, None), (-1, " ".join(WORDS[::-1]))]
    assert got == sorted(want, key=str)


def test_substring_stage_on_awkward_rows(spark, sf, awkward):
    got = dict(kept(STAGES["substring_dedup"](spark, awkward, sf)))
    # the run of equal words in 6 goes, the two words before it stay
    assert set(got) == {-1, 2, 6, 7, 8} and got[6] == "password: hunter22"
    assert got[2] == "x y" and got[7] == "one" and got[-1] == " ".join(WORDS[::-1]) and got[8] == AWKWARD[-1][1]


def test_secret_stage_on_awkward_rows(spark, sf, awkward):
    got = STAGES["secret_scan"](spark, awkward, sf).collect()
    assert len(got) == len(AWKWARD)
    text = {r.doc_id: r for r in got if r.doc_id is not None}
    assert text[8].text == "[REDACTED] and more" and text[8].n_chars == 19 and text[6].text.startswith("[REDACTED] z z")
    assert text[4].text is None and text[3].text == "" and text[5].text == "  \n\t "


def test_pack_stage_on_awkward_rows(spark, sf, awkward):
    got = STAGES["pack"](spark, awkward, sf).collect()
    assert sum(r.start == 0 for r in got) == len(AWKWARD) and all(r.length == len(r.ids) <= 2048 for r in got)
    assert sum(r.doc_id is None for r in got) == 2 and [r.ids for r in got if r.doc_id in (3, 4)] == [[0], [0]]


def test_run_leaves_only_its_result(spark, sf, tmp_path):
    from starloom.llm.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    import os

    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, sf).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert rows > 0 and left <= {"pack"}
