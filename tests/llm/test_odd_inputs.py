"""Every operator over nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

from driftline.llm import chat_tree, decontamination, license_scan, near_dedup, packing, pii, quality_rules, secret_scan, shared, token_counts, toxicity
from driftline.llm.shared import cut


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "The same text of seven words here"), (2, None), (3, ""), (None, "x y z"), (4, "word")], "item_id long, text string")


CASES = {
    "licenses": lambda s, d: license_scan.digest(license_scan.scan(d)),
    "tokens": lambda s, d: token_counts.recount(d),
    "secrets": lambda s, d: secret_scan.digest(secret_scan.scan(d, secret_scan.fit(d))),
    "redacted": lambda s, d: secret_scan.redact(d),
    "toxicity": lambda s, d: toxicity.predict(d, toxicity.train(d, labels(s))),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "quality": lambda s, d: quality_rules.rate(d),
    "pii": lambda s, d: pii.pseudonymise(d, pii.DEMO_KEY),
}


@pytest.mark.parametrize("name", CASES)
def test_a_row_for_each_row(spark, odd_docs, no_docs, name):
    got = CASES[name](spark, odd_docs).toPandas()
    assert sorted(got["doc_id"].dropna()) == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10]
    assert got["doc_id"].isna().sum() == 1
    assert CASES[name](spark, no_docs).count() == 0


def test_cleaning_takes_every_row(spark, odd_docs, no_docs):
    left = toxicity.clean(odd_docs, labels(spark))
    assert left.columns == odd_docs.columns
    assert left.count() == 12
    assert toxicity.clean(no_docs, labels(spark)).count() == 0
    assert toxicity.clean(odd_docs, labels(spark).limit(0)).count() == 12


def test_packing_takes_every_row(spark, odd_docs, no_docs):
    got = packing.digest(odd_docs).toPandas()
    first = got[got["piece"] == 0]
    assert len(first) == 12
    assert set(got[got["doc_id"].isin([1, 2, 3])]["length"]) == {1}
    assert packing.digest(no_docs).count() == 0


def test_decontamination_names_the_copies(spark, odd_docs, no_docs):
    got = decontamination.contaminated(odd_docs, items(spark)).toPandas()
    assert {(int(a), int(b)) for a, b in zip(got["doc_id"], got["item_id"], strict=True)} == {(6, 1), (7, 1), (4, 4)}
    left = decontamination.decontaminate(odd_docs, items(spark))
    assert sorted(r["doc_id"] or 0 for r in left.select("doc_id").collect()) == [0, 1, 2, 3, 5, 8, 9, 10]
    assert left.columns == odd_docs.columns
    assert decontamination.decontaminate(no_docs, items(spark)).count() == 0
    assert decontamination.contaminated(no_docs, items(spark)).count() == 0
    assert decontamination.contaminated(odd_docs, items(spark).limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    got = near_dedup.near_duplicates(odd_docs).toPandas()
    assert set(got[got["doc_id"] == 7]["component_id"]) == {6}
    assert got[got["doc_id"].isin([1, 2, 3])]["n_shingles"].tolist() == [0, 0, 0]
    assert got[got["doc_id"].isna()]["kept"].tolist() == [True]
    assert near_dedup.deduplicate(odd_docs).filter("doc_id = 7").count() == 0
    assert near_dedup.deduplicate(odd_docs).filter("doc_id is null").count() == 1


def test_chats_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "<|im_end|>\\n"), (1, 0, "user", "<|im_end|>\\n"), (None, 1, "assistant", ""), (None, 0, "user", "x"), (2, 0, "a\nb\\", "<"), (2, 1, "assistant", "|x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "'x' as ids")
    got = chat_tree.digest(chat_tree.sequences(turns)).toPandas().set_index("conv_id")
    assert got["n_turns"].to_dict()[1] == 3
    assert got.loc[2, "loss_chars"] == 2
    assert len(got) == 4
    assert got[got.index.isna()]["n_turns"].tolist() == [1, 1]
    assert chat_tree.digest(chat_tree.sequences(turns.limit(0))).count() == 0


def test_a_cut_table_reads_back(spark, odd_docs):
    assert cut(odd_docs, "docs").count() == 12


def test_scratch_tables_of_a_stage_go_with_it(spark, odd_docs):
    import os

    home = shared._home(spark).removeprefix("file:")
    cut(odd_docs, "docs")
    before = set(os.listdir(home))
    left = shared.settled(spark, lambda: near_dedup.deduplicate(odd_docs), "left")
    new = set(os.listdir(home)) - before
    assert {n.rpartition("-")[0] for n in new} == {"left"}
    assert left.filter("doc_id = 6").count() == 1


def test_near_duplicates_write_few_files_for_many_tasks(spark):
    import os

    home = shared._home(spark).removeprefix("file:")
    texts = [" ".join(f"t{i // 2}w{j}" for j in range(40 - i % 2)) for i in range(64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    before = set(os.listdir(home)) if os.path.exists(home) else set()
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(64)}
    files = {n.rpartition("-")[0]: sum(f.endswith(".parquet") for f in os.listdir(f"{home}/{n}")) for n in set(os.listdir(home)) - before}
    assert {n: files[n] for n in ("signatures", "members", "hubs", "buckets", "sets", "checked")} == dict.fromkeys(("signatures", "members", "hubs", "buckets", "sets", "checked"), 1)


def test_the_pipeline_takes_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs, rows in ((odd_docs, 10), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = cut(stage(spark, docs, sf), name)
            assert docs.columns == columns
        assert docs.count() == rows
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert packed.filter("piece = 0").count() == rows
