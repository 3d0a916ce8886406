from scholia.llm import mixing

TARGETS = "mix_id string, source string, target_share double, max_repeats int"
DOCS = "doc_id bigint, source string, n_tokens bigint, weight double"


def test_shares_repeats_and_absent_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b", 5 + i % 7, 0.5) for i in range(2000)] + [(5000, None, 9, 1.0), (5001, "c", 9, None)], DOCS)
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.4, 4), ("m", "gone", 0.1, 3), ("n", "a", 1.0, 2)], TARGETS)
    picked, report = mixing.mixed(docs, targets)
    rows = {(r.mix_id, r.source): r for r in report.collect()}
    assert not rows["m", "gone"].met and rows["m", "gone"].used_tokens == 0
    a, b = rows["m", "a"], rows["m", "b"]
    assert abs(a.used_tokens / b.used_tokens - 0.5 / 0.4) < 0.01
    times = {(r.mix_id, r.source): r[2] for r in picked.groupBy("mix_id", "source").max("times").collect()}
    assert times["m", "a"] == 1 and times["m", "b"] <= 4
    least = picked.where("mix_id = 'm' AND source = 'b'").groupBy().min("times").first()[0]
    assert times["m", "b"] - least <= 1  # complete epochs before any further use
    assert picked.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    again, _ = mixing.mixed(docs.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked.collect()))


def test_total_beyond_supply_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", 10, 1.0), (2, "a", 0, -1.0)], DOCS)
    targets = spark.createDataFrame([("m", "a", 1.0, 3)], TARGETS)
    picked, report = mixing.mixed(docs, targets, total=1000)
    assert report.first().used_tokens == 30 and not report.first().met
    none, report = mixing.mixed(docs.limit(0), targets)
    assert none.count() == 0 and report.count() == 1
    assert mixing.mixed(docs, targets.limit(0))[0].count() == 0


def test_heavier_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "a", 1, 1.0 if i % 2 else 0.2) for i in range(4000)] + [(9999, "b", 1000, 1.0)], DOCS)
    picked, _ = mixing.mixed(docs, spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], TARGETS))
    odd = picked.where("source = 'a' AND doc_id % 2 = 1").count()
    assert odd > 650


def test_nothing_that_is_left_fits_in_what_is_left(spark):
    sizes = {i: 1 + (i * 37) % 101 for i in range(90)} | {90: 2000, 91: 3000}
    docs = spark.createDataFrame([(i, "a", n, 1.0) for i, n in sizes.items()], DOCS)
    for seed in range(3):
        picked, _ = mixing.mixed(docs, spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS), total=3333, seed=seed)
        taken = {r.doc_id for r in picked.collect()}
        gap = 3333 - sum(sizes[i] for i in taken)
        assert 0 <= gap < min(n for i, n in sizes.items() if i not in taken)
