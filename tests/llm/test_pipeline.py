import corpus_pipeline
from lodestone.llm import queries
from tests.llm.fixtures import SF, docs


def test_stages_keep_their_promises(spark):
    names = corpus_pipeline.COLUMNS
    now = spark.read.parquet(f"{SF}/documents.parquet")
    before = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.keep(stage(spark, now, SF))
        assert now.columns == names, name
        assert 0.8 * before <= now.count() <= before
    assert now.where("text like '%token = \"________________________________________\"%'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.columns == ["doc_id", "ids"] and last.count() == now.count()
    assert last.where("ids is null or size(ids) = 0").count() == now.where("text is null or text = ''").count()


def test_odd_rows(spark):
    now = docs(spark, 20)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.keep(stage(spark, now, SF))
    assert now.count() > 15


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_near_copies_at_eight_tenths(spark):
    from tests.llm.test_minhash import brute

    rows = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(104)]  # 100 shingles
        # the last 8 to 12 words are new: similarities from 0.85 to 0.79
        other = base[: 104 - (8 + k % 5)] + [f"v{k}x{i}" for i in range(8 + k % 5)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, SF).collect()}
    assert kept == {i for i, (_, _, first) in brute(rows, 80).items() if first}
    assert kept != {i for i, (_, _, first) in brute(rows, 85).items() if first}


def test_the_order_of_the_mix_survives(spark, tmp_path):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, f"the small house of number {i} stands by the river and " + " ".join(f"w{i}x{j}" for j in range(9)), "en", "big" if i % 5 else "small", 9) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    # many files, read back in another order
    reread = corpus_pipeline.keep(corpus_pipeline.mixed(spark, frame, SF)).repartition(7, "n_chars", F.rand(1))
    rows = corpus_pipeline.positioned_pieces(reread).collect()
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows) and len(rows) == 2000
    ids = [r.doc_id for r in corpus_pipeline.pieces(spark, reread, SF).collect()]
    assert ids == [r.doc_id for r in rows]
    for n in (64, 160, 480, 800):
        assert abs(sum(i % 5 == 0 for i in ids[:n]) - n / 2) <= 16


def test_run_returns_positions(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert len({r.mix_position for r in out}) == len(out) > 100
    assert [r.mix_position for r in out] == sorted(r.mix_position for r in out)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_ids_with_different_texts_lose_none(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(0, base), (1, base + " more"), (1, other), (1, other), (2, other), (3, None), (None, base), (4, "short text"), (4, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, frame, SF).collect()), key=str)
    # the other text of id 1 is a copy of id 2's, which is smaller than a hash
    assert kept == sorted([(0, base), (2, other), (3, None), (None, base), (4, "short text"), (4, None)], key=str)


def test_unlabelled_documents_stay(spark):
    frame = spark.createDataFrame([(i, f"some words here {i}", None, "s", 1) for i in range(3)], COLUMNS)
    assert corpus_pipeline.language_id(spark, frame, SF).count() == 3


def test_empty_table(spark):
    now = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.keep(stage(spark, now, SF))
        assert now.count() == 0
