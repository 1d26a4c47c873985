"""Reading levels: held-out accuracy on texts of known level, bounded fitting, empty and odd inputs."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandweb.llm.reading import code_of, features, fit_documents, with_levels, word_grades

DOCS, LABELS = "doc_id long, text string, level string", "doc_id long, grader string, grade int"
OWN = {g: [f"{stem}{'abcdefghij'[g]}" for stem in ("lor", "mip", "sud", "dol", "ame", "con", "sec", "adi")] for g in range(1, 6)}
COMMON = ["the", "of", "and", "page", "warn"]


def text_of(level, rnd, length=60):
    near = [level] * 8 + [max(1, level - 1), min(5, level + 1)]
    return " ".join(rnd.choice(COMMON) if rnd.random() < 0.5 else rnd.choice(OWN[rnd.choice(near)]) for _ in range(length)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(6)
    levels = [rnd.randrange(1, 6) for _ in range(500)]
    docs = [(i, text_of(g, rnd, rnd.randrange(40, 200)), "x") for i, g in enumerate(levels)]
    labels = [(i, f"g{k}", min(5, max(1, levels[i] + rnd.choice([0] * 8 + [1, -1])))) for i in range(250) for k in range(rnd.randrange(1, 3))]
    labels += [(1, "g9", None), (None, "g1", 3), (2, "g1", 99), labels[0]]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), levels


def test_held_out_accuracy(corpus):
    docs, labels, levels = corpus
    model = fit_documents(docs, "doc_id", "text", labels, "doc_id", "grade")
    assert not set(model.codes) & set(COMMON)
    got = {r.doc_id: r.estimate for r in with_levels(docs, "text", model, name="estimate").collect()}
    held = range(250, 500)
    assert np.mean([got[i] == levels[i] for i in held]) > 0.9
    assert np.mean([(got[i] >= 4) == (levels[i] >= 4) for i in held]) > 0.97


def test_bound_and_odd_texts(spark, corpus):
    docs, labels, _ = corpus
    model = fit_documents(docs, "doc_id", "text", labels, "doc_id", "grade", most=60)
    odd = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "12 34 !!", ""), (4, "unknown words only here", ""), (5, " ".join(OWN[5]) * 20_000, ""), (6, "lorb mipb sudb dolb amec", "")], DOCS)
    got = {r.doc_id: r.level_ for r in with_levels(odd, "text", model, name="level_").collect()}
    assert got[1] is got[2] is got[3] is got[4] is None and got[5] == 5
    least = {r.doc_id: r.l for r in with_levels(odd, "text", model, 6, "l").collect()}
    assert least[6] is None


def test_no_labels(spark, corpus):
    docs, labels, _ = corpus
    for own in (labels.limit(0), labels.where("grade is null")):
        model = fit_documents(docs, "doc_id", "text", own, "doc_id", "grade")
        assert with_levels(docs, "text", model, name="l").where("l is not null").count() == 0
    assert fit_documents(docs.limit(0), "doc_id", "text", labels, "doc_id", "grade").codes == {}


def test_word_grades(spark):
    rows = [("easy any", [0.9, 0.1, 0.0, 0.0, 0.0])] * 50 + [("hard any", [0.0, 0.0, 0.0, 0.1, 0.9])] * 50 + [("once", [1.0, 0.0, 0.0, 0.0, 0.0])] + [("any", [0.0, 0.5, 0.5, 0.0, 0.0])] * 50
    got = {r.word: (r.n_texts, code_of(r.grade)) for r in word_grades(spark.createDataFrame(rows, "text string, votes array<double>")).collect()}
    assert set(got) == {"easy", "hard"} and got["easy"][0] == 50 and got["easy"][1] < 60 < 190 < got["hard"][1]


def test_no_word_is_left_out(spark):
    """All informative words of the graded texts count, however many they are."""
    rows = [(" ".join(f"w{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}{'xyz'[j]}" for k in range(100)), [float(j == i) for i in range(5)]) for j in range(3) for _ in range(4)]
    assert word_grades(spark.createDataFrame(rows, "text string, votes array<double>")).count() == 300


def test_batches_agree(spark, corpus, monkeypatch):
    docs, labels, _ = corpus
    model = fit_documents(docs, "doc_id", "text", labels, "doc_id", "grade")
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", "lorb"]
    assert model.levels(texts) == [model.levels([t])[0] for t in texts]


def test_held_out_accuracy_on_documents(spark):
    """Half of the graded documents of a table fit the model, the others judge it, where their graders agree."""
    sf_dir = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lower(lang) like 'en%'")
    labels = spark.read.parquet(f"{sf_dir}/grade_labels.parquet").where("grade is not null")
    model = fit_documents(documents, "doc_id", "text", labels.where("pmod(xxhash64(doc_id), 2) = 0"), "doc_id", "grade")
    agreed = labels.where("pmod(xxhash64(doc_id), 2) = 1").groupBy("doc_id").agg(F.min("grade").alias("low"), F.max("grade").alias("high")).where("low = high")
    rows = with_levels(documents.join(agreed, "doc_id"), "text", model).where("level is not null").select("low", "level").collect()
    exact, demanding = np.mean([r.low == r.level for r in rows]), np.mean([(r.low >= 4) == (r.level >= 4) for r in rows])
    print(f"held out: {len(rows)} texts, exact {exact:.4f}, level 4 or 5 {demanding:.4f}")
    assert len(rows) > 200 and exact > 0.9 and demanding > 0.97


def test_features():
    counts = np.zeros((1, 250), int)
    counts[0, 0], counts[0, 249] = 90, 10
    f = features(counts)[0]
    assert f[2] < 1.1 and f[3] < 1.1 and abs(f[5] - (0.9 * 1.008 + 0.1 * 4.992)) < 0.01
